"""The corpus pipeline stage by stage, each against a plain version on its own input; registered queries and their SQL."""

import importlib
import os
import sys
from collections import Counter

import pytest

import brute
from check_queries import compare, connect
from test_mixing import brute_targets
from test_similar import brute_kept

import corpus_pipeline
from siftlane.llm.queries import ORACLES, QUERIES
from siftlane.session import stored

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = stored(stage(spark, docs, SF_DIR), name)
    return out


def texts(rows):
    return {r.doc_id: r.text for r in rows.collect()}


def test_language_keeps_documents_with_letters(steps):
    before, after = texts(steps["documents"]), texts(steps["language"])
    assert set(after) == {d for d, t in before.items() if t and any(c.isalpha() for c in t)}
    assert all(after[d] == before[d] for d in after)


def test_one_of_each_component_stays(steps):
    before, after = texts(steps["language"]), texts(steps["near_dedup"])
    assert after == {d: before[d] for d in brute_kept(before)} and len(after) < len(before)


def test_repeated_bytes_go(steps):
    before, after = texts(steps["near_dedup"]), texts(steps["suffix_dedup"])
    marks = brute.removed_units({d: t.encode() for d, t in before.items()}, 100)
    want = {d: bytes(b for b, m in zip(t.encode(), marks[d]) if not m).decode("utf-8", "ignore") for d, t in before.items()}
    assert after == want and after != before


def test_mix_is_near_its_targets(steps):
    size = lambda t: len(brute.words(t))
    before, after = steps["suffix_dedup"].collect(), steps["mixing"].collect()
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in before:
        sizes[r.source] += size(r.text)
        largest[r.source] = max(largest[r.source], size(r.text))
    for r in after:
        taken[r.source] += size(r.text)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    for s, t in zip(order, brute_targets([sizes[s] for s in order], [1 + i % 3 for i in range(len(order))])):
        assert abs(taken[s] - t) <= largest[s] / 2 + 1
    assert max(Counter(r.doc_id for r in after).values()) <= 3
    assert {(r.doc_id, r.text, r.lang, r.source) for r in after} <= {(r.doc_id, r.text, r.lang, r.source) for r in before}


def test_tokens_decode_to_their_texts(steps):
    want = Counter((r.doc_id, brute.sha(r.text)) for r in steps["mixing"].collect())
    rows = steps["tokens"].collect()
    assert Counter((r.doc_id, r.decoded_sha256) for r in rows) == want
    assert all(r.n_tokens == len(r.ids) and r.ids_sha256 == brute.sha(",".join(map(str, r.ids))) for r in rows)


def test_stages_keep_the_columns(steps):
    assert all(steps[name].columns == steps["documents"].columns for name in ("language", "near_dedup", "suffix_dedup", "mixing"))


@pytest.mark.parametrize("name", list(ORACLES))
def test_sql(spark, name):
    assert compare(QUERIES[name](spark, SF_DIR), connect(SF_DIR), ORACLES[name]) is None


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_entry_without_the_subpackage(monkeypatch):
    """The other queries do not need the subpackage."""
    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name == "corpus_pipeline" or name.startswith("siftlane.llm"):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("siftlane.llm") or n == "__spark_entry__"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    entry = importlib.import_module("__spark_entry__")
    assert entry.queries() and not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in entry.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__")
