"""Source divergence against a plain version, over whole and cut cubes."""

import re
from collections import Counter, defaultdict
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlane.llm import divergence
from siftlane.llm.terms import term_parts

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_divergence(rows, min_docs, top=10):
    counts, docs, totals = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        terms = TERM.findall((text or "").translate(LOWER))
        counts[lang or "", source or ""].update(terms)
        totals[lang or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang in {g[0] for g in counts}:
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        q = share(totals[lang])
        p = {source: share(c) for (own, source), c in counts.items() if own == lang}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for source, own in p.items():
            pairs = [(-sum(f(own[t], p[other][t]) for t in kept), other.encode(), other) for other in p if other != source]
            out += [(lang, source, "pair", item, -v, i + 1) for i, (v, _, item) in enumerate(sorted(pairs))]
            terms = [(-f(own[t], q[t]), t.encode(), t) for t in kept if counts[lang, source][t] and own[t] > q[t]]
            out += [(lang, source, "term", item, -v, i + 1) for i, (v, _, item) in enumerate(sorted(terms)[:top])]
    return sorted(out)


def told(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def many(spark):
    """Two languages of many sources; one source holds a third of all rows, some have no terms, one language keeps none."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        words = [f"t{'abcdefghij'[x // 10]}{'abcdefghij'[x % 10]}" for x in rng.zipf(1.4, rng.integers(0, 40)) % 100]
        rows.append(("xx" if i % 5 else "yy", "big" if i % 3 == 0 else f"s{i % 41}", " ".join(words)))
    rows += [("xx", "mute", "12 34"), ("xx", None, None), ("zz", "a", "rare"), ("zz", "b", "words"), (None, "a", "Only ONE"), ("é", "ß", "")]
    return spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)


def test_equals_plain_version(many):
    rows = [tuple(r) for r in many.collect()]
    got = told(divergence.source_divergence(many, min_docs=3))
    assert got == plain_divergence(rows, 3)
    assert {r[4] for r in got if r[0] == "zz"} == {0} and ("xx", "mute") in {r[:2] for r in got}


def test_small_blocks_change_nothing(many, monkeypatch):
    whole = told(divergence.source_divergence(many, min_docs=3))
    monkeypatch.setattr(divergence, "GROUPS_PER_BLOCK", 7)
    monkeypatch.setattr(divergence, "TERMS_PER_BLOCK", 9)
    assert told(divergence.source_divergence(many, min_docs=3)) == whole


def test_odd_rows(odd, nothing):
    rows = [(r.lang, r.source, r.text) for r in odd.collect()]
    clash = odd.withColumns({"term": F.lit("clash"), "n": F.lit(None).cast("int"), "value": F.lit(1)})
    assert told(divergence.source_divergence(clash, min_docs=2)) == plain_divergence(rows, 2)
    assert divergence.source_divergence(nothing).collect() == []


def test_tally_flushes_alike(monkeypatch, many):
    rows = [tuple(r) for r in many.collect()]
    monkeypatch.setattr(divergence, "BYTES_AT_ONCE", 100)
    monkeypatch.setattr(divergence, "MOST_ENTRIES", 20)
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"lang": [r[0] or "" for r in rows], "source": [r[1] or "" for r in rows], "text": [(r[2] or "").encode() for r in rows]})
    sums, docs = Counter(), Counter()
    for out in divergence._tallied(iter([batch])):
        for r in out.to_pylist():
            sums[r["lang"], r["source"], r["term"]] += r["n"]
            docs[r["lang"], r["source"], r["term"]] += r["docs"]
    want, want_docs = Counter(), Counter()
    for lang, source, text in rows:
        terms = TERM.findall((text or "").translate(LOWER))
        want.update((lang or "", source or "", t.encode()) for t in [*terms, ""])
        want_docs.update((lang or "", source or "", t.encode()) for t in {*terms, ""})
    assert sums == want and docs == want_docs


def test_shares_beyond_64_bits():
    counts, total = np.array([[7, 3 * 10**12]]), np.array([[10**13]])
    assert divergence.shares(counts, total).tolist() == [[1 + 10**9 * 9 // 10**13, 1 + 10**9 * (3 * 10**12 + 2) // 10**13]]


@pytest.mark.parametrize("text", ["", "A b-C_d é1É\x00x 日本 z y", "x" * 300 + " y" * 300, "no" * 200])
def test_terms_of_long_texts(monkeypatch, text):
    import siftlane.llm.terms as terms
    monkeypatch.setattr(terms, "AT_ONCE", 50)
    assert [t.decode() for part in term_parts(text.encode()) for t in part] == TERM.findall(text.translate(LOWER))


def test_ranks_have_no_gaps(many):
    rows = told(divergence.source_divergence(many, min_docs=3))
    for _, some in groupby(rows, key=lambda r: r[:3]):
        some = sorted(some, key=lambda r: r[5])
        assert [r[5] for r in some] == list(range(1, len(some) + 1))
        assert some == sorted(some, key=lambda r: (-r[4], r[3].encode()))
