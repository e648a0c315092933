"""Damaged lines: none vanishes, none becomes a row of nulls."""

import pytest
from pyspark.sql import Observation

from siftlane import sources
from siftlane.sources import checked as S

GOOD = ['{"session_id":"a","seq":1,"kind":"request","headers":{"h":"v"},"ts":"2024-01-01T00:00:00Z"}', '{"kind":"response","seq":2,"session_id":"a","extra":[1]}',
        '  {"session_id":"a","seq":3,"kind":"request"} trailing']
BAD = {'{"session_id":"a","seq":4,"kind":"requ': S.NOT_JSON, "not a record": S.NOT_JSON, '{"session_id":"a","seq":"five","kind":"x"}': S.WRONG_TYPE,
       '{"session_id":"a","seq":1.5,"kind":"x"}': S.WRONG_TYPE, '{"session_id":"a","seq":6,"kind":"x","ts":"yesterday"}': S.WRONG_TYPE, "[1]": S.WRONG_TYPE, "5": S.WRONG_TYPE,
       '{"session_id":"a","seq":7,"kind":"x","headers":[]}': S.WRONG_TYPE, "{}": S.MISSING, '{"session_id":null,"seq":8,"kind":"x"}': S.MISSING}


@pytest.fixture
def log(tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.json").write_text("\n".join([*GOOD[:2], "", *list(BAD)[:5], "   "]))
    (tmp_path / "log" / "b.json").write_text("\n".join([*list(BAD)[5:], GOOD[2]]))
    return str(tmp_path / "log")


def test_lines_are_good_or_kept_and_counted(spark, log):
    told = Observation("log")
    checked = sources.counted(sources.read_checked(spark, log), told)
    rows = checked.collect()
    assert told.get == {"lines": len(GOOD) + len(BAD), "not_json": 2, "wrong_type": 6, "missing_field": 2}
    assert {r._line: r._problem for r in rows} == {**{g: None for g in GOOD}, **BAD}
    good = sources.good_rows(sources.read_checked(spark, log))
    assert sorted(r.seq for r in good.collect()) == [1, 2, 3] and good.schema == sources.read_capture(spark, log).schema
    bad = sources.bad_lines(sources.read_checked(spark, log)).collect()
    assert {r.line: r.problem for r in bad} == BAD and {r.file.rsplit("/", 1)[1] for r in bad} == {"a.json", "b.json"}


def test_stream_splits_each_batch(spark, log, tmp_path):
    stream = sources.counted(sources.stream_checked(spark, log, files_per_batch=1), "log")
    query = (stream.writeStream.foreachBatch(sources.split_batches(str(tmp_path / "good"), str(tmp_path / "bad")))
             .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
    query.awaitTermination()
    assert sorted(r.seq for r in spark.read.parquet(str(tmp_path / "good")).collect()) == [1, 2, 3]
    assert {r.line: r.problem for r in spark.read.parquet(str(tmp_path / "bad")).collect()} == BAD


def test_nothing_to_read(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.json").write_text("\n\n")
    checked = sources.read_checked(spark, str(tmp_path / "log"))
    assert sources.good_rows(checked).collect() == sources.bad_lines(checked).collect() == []
