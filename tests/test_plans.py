"""Plans: what reaches the scan, and what must never appear."""

import re

import pytest

from siftlane.operators import catalog as C
from siftlane.operators import dom as D
from siftlane.operators import lineage as L
from siftlane.operators import openapi as A
from siftlane.operators import fold as E
from siftlane.operators.capture import network_log, store_log

from events import frame, random_events


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("log") / "capture")
    frame(spark, random_events(5, 50)).write.parquet(path)
    return spark.read.parquet(path)


def scans(spark, df) -> str:
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, events):
    text = scans(spark, C.endpoint_statuses(events, "v1"))
    pushed, columns = re.findall(r"PushedFilters: (.*)", text), re.findall(r"ReadSchema: struct<(.*)>", text)
    assert len(pushed) == 1 and "In(resource_type, [fetch,xhr])" in pushed[0] and "EqualTo(kind,request)" in pushed[0]
    assert "body" not in columns[0] and "headers" not in columns[0]


def test_statuses_read_the_log_once(events):
    assert plan(C.endpoint_statuses(events, "v2")).count("FileScan") == 1


def test_samples_are_limited_before_the_shuffle(events):
    assert plan(C.sample_picks(events, "v2")).count("WindowGroupLimit") == 2
    assert "ArrowEvalPython" not in plan(C.sample_picks(events, "v2"))


def exchanged(spark, df) -> list[str]:
    """The columns of each exchange, joins being sort-merge joins, as they are with many picks."""
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", scans(spark, df.select("*")))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


@pytest.mark.parametrize("build", [
    lambda e: C.endpoint_catalog(e, "v2"), lambda e: E.fold(e, "v2"), lambda e: A.openapi_requests(e, "v2"), lambda e: A.openapi_responses(e, "v2")])
def test_a_stored_log_is_not_shuffled(spark, events, build):
    held = store_log(events, "v2")
    columns = exchanged(spark, build(held))
    assert columns and not any("body#" in c for c in columns)
    assert any("body#" in c for c in exchanged(spark, build(events)))
    text = plan(build(held))
    assert "Python" not in text and "SortMergeJoin" not in plan(held)


def test_a_stored_log_gives_the_same(spark, events):
    held = store_log(events, "v1", buckets=7)
    for build in (lambda e: C.endpoint_catalog(e, "v1"), lambda e: E.catalog_of(E.fold(e, "v1"), "v1"), lambda e: L.lineage_edges(e, "v1"), lambda e: network_log(e, "v1")):
        assert sorted(map(str, build(held).collect())) == sorted(map(str, build(events).collect()))
    with pytest.raises(ValueError, match="another profile"):
        C.endpoint_catalog(held, "v2")


def test_an_empty_log_is_stored(spark):
    assert C.endpoint_catalog(store_log(frame(spark, []))).count() == 0


def test_producers_nobody_uses_are_dropped_before_the_shuffle(spark, tmp_path):
    rows = [("s", seq, 0, "e", "f", f"t{seq % 50}", 1) for seq in range(1000)] + [("s", 1000, 0, "e", "f", "t7", 0), ("t", 1001, 0, "e", "f", "t8", 0)]
    spark.createDataFrame(rows, "session_id string, seq long, ord int, endpoint string, field_path string, token string, side int").write.parquet(str(tmp_path / "l"))
    leaves = spark.read.parquet(str(tmp_path / "l"))
    used = L.used_leaves(leaves)
    assert sorted(r.seq for r in used.where("side = 1").collect()) == [s for s in range(1000) if s % 50 == 7] and used.where("side = 0").count() == 2
    found = L.value_lineage(leaves)
    assert [(r.seq, r.source_field) for r in found.collect()] == [(1000, "f")]
    written = []

    def walk(node):
        if node.nodeName() == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if node.nodeName().endswith("QueryStage"):
            return walk(node.plan())
        if node.nodeName() == "Exchange":
            written.append(node.metrics().apply("shuffleRecordsWritten").value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    kept = L.value_lineage(leaves)
    kept._jdf.collectToPython()
    walk(kept._jdf.queryExecution().executedPlan())
    assert written and max(written) <= 22


def test_unused_json_facts_are_not_computed(events):
    assert "Python" not in plan(network_log(events, "v2").select("seq", "path"))


@pytest.mark.parametrize("build", [
    lambda e: C.endpoint_catalog(e, "v2"), lambda e: L.lineage_edges(e, "v1"), lambda e: A.openapi_requests(e, "v2"),
    lambda e: A.openapi_responses(e, "v2"), lambda e: C.response_sample_rows(e, "v2")])
def test_no_products(events, build):
    text = plan(build(events))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_pages_are_parsed_once_and_not_shuffled(spark):
    pages = spark.createDataFrame([("s", 1, 0, "https://h/", "<form>")], "session_id string, page_id long, frame_index int, url string, html string")
    text = plan(D.frame_data(D.page_elements(pages)))
    assert text.count("ArrowEvalPython") == 1 and "Exchange" not in text
