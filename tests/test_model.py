"""Operators against the sequential model, on random event sequences."""

import pytest
from pyspark.sql import functions as F

from siftlane.operators import catalog as C
from siftlane.operators import lineage as L
from siftlane.operators import openapi as A

from events import Model, frame, random_events

SEEDS = (1, 2)
KEY = ["session_id", "method", "path"]


@pytest.fixture(scope="module", params=[(s, p) for s in SEEDS for p in ("v1", "v2")], ids=lambda x: f"{x[0]}-{x[1]}")
def case(request, spark):
    seed, profile = request.param
    rows = random_events(seed, 140)
    return frame(spark, rows).cache(), profile, Model(profile).run(rows)


def test_catalog(case):
    events, profile, model = case
    got = {tuple(r[k] for k in KEY): r for r in C.endpoint_catalog(events, profile, mask=False).collect()}
    assert set(got) == set(model.endpoints)
    for key, e in model.endpoints.items():
        row = got[key]
        assert (row.first_seq, row.url) == (e["first_seq"], e["url"])
        assert [s.body for s in row.sample_payloads] == e["samples"]
        assert row.response_statuses == sorted(e["statuses"])
        if profile == "v2":
            assert [s.sample for s in row.response_samples] == e["responses"]


@pytest.mark.parametrize("block", [1 << 16, 3])
def test_lineage(case, block):
    events, profile, model = case
    uses = L.lineage_uses(events, profile, block).drop("ord").collect()
    assert sorted(map(tuple, uses)) == sorted(model.uses)
    edges = L.lineage_edges(events, profile, block).collect()
    want = dict(sorted(model.edges.items(), key=lambda e: e[1]))
    got = {tuple(r)[:5]: r.first_seq for r in edges}
    assert got == want if len(want) <= 100 else set(got.items()) <= set(want.items())


def test_edge_limit(case):
    events, profile, model = case
    uses = L.lineage_uses(events, profile)
    kept = L.distinct_edges(uses, 3).groupBy("session_id").agg(F.max("first_seq").alias("m"), F.count("*").alias("n"))
    for row in kept.collect():
        order = sorted(s for e, s in model.edges.items() if e[0] == row.session_id)
        assert row.n == min(3, len(order)) and row.m == order[row.n - 1]


def test_openapi(case):
    events, profile, model = case
    got = {(*[r[k] for k in KEY],): (r.content_type, r.example) for r in A.openapi_requests(events, profile).collect()}
    assert got == model.requests_fold
    answers = {(*[r[k] for k in KEY], r.status): (r.content_type, r.example) for r in A.openapi_responses(events, profile).collect()}
    if profile == "v2":  # v1 keeps no bodies of responses
        assert answers == model.responses_fold
