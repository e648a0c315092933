import pytest

PASSAGE = " ".join(f"shared{i} passage" for i in range(30))


def odd_documents() -> list[tuple]:
    """Nulls, empty and long texts, copies, a repeated row, a row without an id, blanks of all kinds, accents, and long repeats."""
    base = " ".join(f"w{i * i % 97} x{i % 13}" for i in range(150))
    return [
        (1, base, "en", "a", 0), (2, base, "en", "a", 0), (3, base.replace("w4 ", "v4 "), "en", "b", 0), (4, None, None, None, None),
        (5, "", "en", "b", 0), (6, " \t\n ", "fr", None, 0), (7, "un", "fr", "b", 0), (8, PASSAGE + " tail one two", "en", "c", 0),
        (9, "head " + PASSAGE, "en", "c", 0), (10, "é" * 300 + " mid " + "é" * 300, "fr", "c", 0), (11, "a b " * 400, "en", "d", 0),
        (12, "tab\tand\x0bother\x0cblanks\r\nhere  twice", "en", "d", 0), (13, "日本語 テキスト 😀 <|endoftext|> don't", "ja", "é", 0),
        (14, base.upper(), "en", "d", 0), (15, " ".join(f"n{i}" for i in range(6000)), "en", "Z", 0), (15, " ".join(f"n{i}" for i in range(6000)), "en", "Z", 0),
        (None, "a row without an id " + base, "en", "a", 0), (20, "x" * 5000, "en", "a", 0), (21, "one two three", "en", "b", 0), (22, "one two three", "en", "b", 0),
    ]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Small documents with everything that is odd."""
    return spark.createDataFrame(odd_documents(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def plain(spark):
    """The odd documents less repeated and null ids: what the brute-force versions are defined on."""
    seen, rows = set(), []
    for row in odd_documents():
        if row[0] is not None and row[0] not in seen:
            seen.add(row[0])
            rows.append(row)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
