"""Both SimHash operators: fingerprints, links, components, radius tables."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import brute
from siftlane.llm import fingerprints, graph
from siftlane.llm import simhash_covering as S
from siftlane.llm.fingerprints import edited_fingerprints, within_radius


def brute_print(text) -> int:
    words = brute.words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints: dict, radius: int) -> dict:
    root = {d: d for d in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def test_near_duplicates(plain):
    prints = {r.doc_id: brute_print(r.text) for r in plain.collect()}
    roots = brute_components(prints, 4)
    rows = S.near_duplicates(plain).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {d: (f"{p:016x}", roots[d]) for d, p in prints.items()}


def test_odd_rows(odd, nothing):
    rows = S.near_duplicates(odd.withColumns({"fp": F.lit(1), "component_id": F.lit("x")})).collect()
    assert len(rows) == odd.count() and S.near_duplicates(nothing).count() == 0
    kept = S.keep_one(odd.withColumns({"fp": F.lit(1), "id": F.lit("x")}))
    assert kept.columns == [*odd.columns, "fp", "id"] and S.keep_one(nothing).count() == 0
    assert kept.count() == len({r.component_id for r in rows} - {None}) + len({r.fingerprint for r in rows if r.component_id is None})
    assert kept.where("doc_id = 15").count() == 1 and kept.where("doc_id = 1").count() == 1 and kept.where("doc_id = 2").count() == 0


def near_pairs(values, radius):
    cells, fps, home = S.anchor_entries(values)
    return {(min(int(a), int(b)), max(int(a), int(b))) for u, v in S.near_pairs(cells, fps, home, radius) for a, b in zip(u, v)}


def flipped(rng, values, most):
    out = values.copy()
    for i in range(len(out)):
        for bit in rng.choice(64, rng.integers(0, most + 1), replace=False):
            out[i] ^= np.uint64(1) << np.uint64(bit)
    return out


def test_every_link_meets_at_an_anchor():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**64, 2000, dtype=np.uint64)
    b = flipped(rng, a, 6)
    want = {(min(int(x), int(y)), max(int(x), int(y))) for x, y in zip(a, b) if 0 < (int(x) ^ int(y)).bit_count() <= 4}
    assert want <= near_pairs(np.unique(np.r_[a, b]), 4) and len(want) > 500


@pytest.mark.parametrize("walked", [4, 10_000])
def test_large_groups_are_walked(spark, monkeypatch, walked):
    """A dense group of near copies gives the same components, walked or paired."""
    monkeypatch.setattr(S, "WALKED", walked)
    rng = np.random.default_rng(6)
    centre = rng.integers(0, 2**64, 4, dtype=np.uint64)
    values = np.unique(flipped(rng, np.repeat(centre, 80), 3))
    cells, fps, home = S.anchor_entries(values)
    place = {int(v): i for i, v in enumerate(values)}
    links = [(place[int(a)], place[int(b)]) for u, v in S.near_pairs(cells, fps, home, 4) for a, b in zip(u, v)]
    found = graph.local_roots(len(values), *np.array(links).T)
    want = brute_components({i: int(v) for i, v in enumerate(values)}, 4)
    assert found.tolist() == [want[i] for i in range(len(values))]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(-5, 7), (7, 7)]
    edges = spark.createDataFrame(links, "u long, v long")
    roots = {r.node: r.root for r in graph.components(edges).collect()}
    assert roots == {**{i: -5 for i in [-5, *range(41)]}, **{i: 100 for i in range(100, 160)}}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_edited_texts(odd, plain, nothing):
    texts = sorted((r.doc_id, r.text or "") for r in plain.collect())
    rows = {r.doc_id: r for r in edited_fingerprints(plain.withColumns({"block": F.lit("x"), "next": F.lit(1)})).collect()}
    for i, (d, text) in enumerate(texts):
        following, half = texts[(i + 1) % len(texts)], len(text) // 2
        r = rows[d]
        assert (r.n_chars, r.edited_sha256) == (len(text), brute.sha(text[:len(text) - half] + following[1][:half]))
        bits = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 64
        assert r.near_edited == bits(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == bits(r.fingerprint, rows[following[0]].fingerprint)
    assert rows[1].fingerprint == rows[2].fingerprint and rows[1].near_next == 1 and rows[4].fingerprint == "0" * 16
    lone = edited_fingerprints(odd).where("doc_id is null").collect()
    assert len(lone) == 1 and lone[0].near_next is None
    assert edited_fingerprints(odd).count() == odd.count() and edited_fingerprints(nothing).count() == 0


def test_within_radius(spark):
    rng = np.random.default_rng(8)
    a = rng.integers(0, 2**64, 150, dtype=np.uint64)
    values = np.unique(np.r_[a, flipped(rng, a, 5)]).view(np.int64).tolist()
    prints = spark.createDataFrame([(v,) for v in values + [None, values[0]]], "fp long")
    want = {(x, y, n) for x in values for y in values if x < y and (n := ((x ^ y) & (2**64 - 1)).bit_count()) <= 3}
    assert set(map(tuple, within_radius(prints, 3).collect())) == want


@pytest.mark.parametrize("ranges,per_block", [(4096, 8), (256, 3), (4, 8), (1, 1024)])
def test_blocks_follow_the_ids(spark, monkeypatch, ranges, per_block):
    """Ids far from all others leave the blocks of the others as they are; the fingerprints do not depend on blocks."""
    ids = [-(1 << 63), (1 << 63) - 1, 10**12, *range(1000), *range(5000, 5400, 3), 5000, 5000]
    rows = spark.createDataFrame([(i, f"text {i} of {n} words {i % 7}") for n, i in enumerate(ids)] + [(None, "none"), (None, None)], "doc_id long, text string")
    want = sorted(map(str, fingerprints.edited_fingerprints(rows).collect()))
    monkeypatch.setattr(fingerprints, "RANGES", ranges)
    monkeypatch.setattr(fingerprints, "DOCS_PER_BLOCK", per_block)
    blocks = fingerprints.in_blocks(rows).where("doc_id is not null").groupBy("block").agg(F.count("*").alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).orderBy("block").collect()
    assert blocks[0].block >= 0 and all(x.b < y.a for x, y in zip(blocks, blocks[1:]))
    if ranges > 4:
        assert max(b.n for b in blocks) <= 2 * per_block + 4
    assert sorted(map(str, fingerprints.edited_fingerprints(rows).collect())) == want


def test_fingerprints_against_a_plain_simhash(spark):
    texts = ["", None, "one", "two words", "a b a b a b c", "über straße\tnaïve\nÜber", " ".join(f"w{i % 17}" for i in range(300)), "same same same same"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def plain(text) -> str:
        words = brute.words(text or "")
        hashes = [xxhash.xxh64_intdigest(b, xxhash.xxh64_intdigest(a, 42)) for a, b in zip(words, words[1:])]
        hashes += [xxhash.xxh64_intdigest(words[-1], 42)] if words else []
        return f"{sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes)):016x}"

    for r in edited_fingerprints(rows).collect():
        text, after = texts[r.doc_id] or "", texts[(r.doc_id + 1) % len(texts)] or ""
        cut = len(text) // 2
        assert (r.fingerprint, r.edited_fingerprint) == (plain(text), plain(text[:len(text) - cut] + after[:cut]))


def test_blocks_without_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert edited_fingerprints(none).count() == 0
    rows = edited_fingerprints(spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")).collect()
    assert len(rows) == 2 and all(r.near_next is None for r in rows)
