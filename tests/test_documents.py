"""Documents in shared files: what is written is read back, by session, and only what was committed."""

import json
import random

import pytest
from pyspark.sql import functions as F

from siftlane.sinks import read_documents, read_manifest, write_lines

SCHEMA = "session_id string, section int, ord long, line string"


def table(spark, sessions, seed=1):
    rng = random.Random(seed)
    rows = [(s, rng.randrange(3), i, rng.choice(["x", "é — 日本", "two\nlines", "", "a" * 300]) + str(i)) for s, n in sessions.items() for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5), rows


def want(rows):
    out = {}
    for s, _, _, line in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2], r[3].encode())):
        out.setdefault(s, []).extend(line.split("\n"))
    return out


def held(df):
    out = {}
    for r in df.orderBy("session_id", "line_no").collect():
        out.setdefault(r.session_id, []).append(r.line)
        assert r.line_no == len(out[r.session_id])
    return out


def test_round_trip_with_a_hot_session(spark, tmp_path):
    """One session has nine lines in ten; it spreads over files, the others share them."""
    df, rows = table(spark, {"hot": 3000, **{f"s{i}": i for i in range(20)}, "ü": 9, None: 4})
    path = str(tmp_path / "docs")
    write_lines(df, path, files=7)
    assert held(read_documents(spark, path)) == want(rows)
    manifest = read_manifest(spark, path).collect()
    assert len({m.file for m in manifest if m.session_id == "hot"}) > 1
    assert len({m.file for m in manifest}) < len({m.session_id for m in manifest})
    firsts = sorted((m.file, m.first_line, m.lines) for m in manifest if m.session_id == "hot")
    at = 1
    for _, first, lines in firsts:
        assert first == at
        at += lines
    assert not list((tmp_path / "docs").rglob("session_id=*"))


@pytest.mark.parametrize("sessions", [["s3"], ["s3", "hot"], ["none such"], []])
def test_reads_the_sessions_asked_for(spark, tmp_path, sessions):
    df, rows = table(spark, {"hot": 400, **{f"s{i}": 5 for i in range(30)}})
    path = str(tmp_path / "docs")
    write_lines(df, path, files=4)
    asked = read_documents(spark, path, sessions)
    assert held(asked) == {s: lines for s, lines in want(rows).items() if s in sessions}
    assert asked.rdd.getNumPartitions() <= read_documents(spark, path).rdd.getNumPartitions()


def test_overwrite_replaces_and_leaves_no_old_files(spark, tmp_path):
    path = str(tmp_path / "docs")
    write_lines(table(spark, {"old": 50})[0], path)
    df, rows = table(spark, {"new": 30, "b": 2})
    write_lines(df, path)
    assert held(read_documents(spark, path)) == want(rows)
    told = json.loads((tmp_path / "docs" / "_current").read_text())
    assert {f.name for f in (tmp_path / "docs").iterdir()} == {"_current", told["commit"]}


def failing(df):
    return df.withColumn("line", F.when(F.col("ord") == 17, F.raise_error(F.lit("broken line")).cast("string")).otherwise(F.col("line")))


def test_aborted_write_leaves_nothing_readable(spark, tmp_path, monkeypatch):
    from siftlane.sinks import documents
    monkeypatch.setattr(documents, "stored", lambda df, name: df)  # so that it fails inside the write
    path = str(tmp_path / "docs")
    df, rows = table(spark, {"a": 40, "b": 40})
    with pytest.raises(Exception, match="broken line"):
        write_lines(failing(df), path)
    with pytest.raises(Exception, match="no documents have been published"):
        read_documents(spark, path).collect()
    with pytest.raises(FileNotFoundError):
        read_manifest(spark, path)


def test_writer_aborts_after_tasks_have_written(tmp_path):
    """The protocol by hand: files of two tasks, one of them twice; abort removes them, commit names one attempt each."""
    import pyarrow as pa

    from siftlane.sinks import documents as S

    class Context:
        number = 0

        def get(self):
            return self

        def partitionId(self):
            return self.number

    context, path = Context(), str(tmp_path / "docs")
    batch = lambda *rows: pa.RecordBatch.from_pydict({"session_id": [r[0] for r in rows], "line": [r[1] for r in rows]})
    old, S.TaskContext = S.TaskContext, context
    try:
        for end in ("abort", "commit", "abort"):
            writer = S._Writer(path)
            context.number = 0
            first = writer.write(iter([batch(("a", "1"), ("a", "2"))]))
            writer.write(iter([batch(("a", "lost"))]))  # an attempt that does not count
            context.number = 1
            second = writer.write(iter([batch(("a", "3"), ("b", "4"))]))
            empty = writer.write(iter([]))
            getattr(writer, end)([second, first, empty])
            if end == "abort":
                assert not (tmp_path / "docs" / writer.commit_id).exists()
            else:
                kept = writer.commit_id
    finally:
        S.TaskContext = old
    told = json.loads((tmp_path / "docs" / "_current").read_text())
    assert told["commit"] == kept and [f["before"] for f in told["files"]] == [0, 2]
    assert len(list((tmp_path / "docs" / kept).iterdir())) == 4


def test_failed_overwrite_keeps_the_version_before(spark, tmp_path, monkeypatch):
    from siftlane.sinks import documents
    path = str(tmp_path / "docs")
    df, rows = table(spark, {"a": 40, "b": 40})
    write_lines(df, path)
    monkeypatch.setattr(documents, "stored", lambda df, name: df)
    with pytest.raises(Exception, match="broken line"):
        write_lines(failing(df), path)
    assert held(read_documents(spark, path)) == want(rows)


def test_no_lines(spark, tmp_path):
    path = str(tmp_path / "docs")
    write_lines(spark.createDataFrame([], SCHEMA), path)
    assert read_documents(spark, path).collect() == [] and read_manifest(spark, path).collect() == []


def test_only_overwrite(spark, tmp_path):
    from siftlane.sinks import documents as S
    spark.dataSource.register(S.SessionDocuments)
    with pytest.raises(Exception, match="overwrite"):
        table(spark, {"a": 3})[0].select("session_id", "line").write.format(S.FORMAT).mode("append").option("path", str(tmp_path)).save()
