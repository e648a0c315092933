import json
import os

import pytest
from pyspark.sql import functions as F

from siftlane import schemas, streaming
from siftlane.operators import catalog as C
from siftlane.operators.lineage import lineage_uses
from siftlane.operators.ordered import changed_only
from siftlane.sources import stream_capture, stream_pages
from siftlane.streaming import drain, settle_catalog

from events import frame, random_events


def write_at(path, lines, order):
    """Write a file with a modification time that fixes its place in the stream."""
    path.write_text("\n".join(lines))
    os.utime(path, (1_700_000_000 + order, 1_700_000_000 + order))


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    """Events in three files, in event order, and the same events as a batch table."""
    rows = random_events(11, 90)
    folder = tmp_path_factory.mktemp("feed")
    names = [f.name for f in schemas.CAPTURE]
    for part in range(3):
        lines = [json.dumps(dict(zip(names, r))) for r in rows[part * 30:(part + 1) * 30]]
        write_at(folder / f"part-{part}.json", lines, part)
    streaming.use_rocksdb(spark)
    return str(folder), frame(spark, rows)


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_lineage_stream_equals_batch(spark, feed):
    folder, batch = feed
    got = drain(streaming.lineage_stream(stream_capture(spark, folder, files_per_batch=1), "v2"))
    want = lineage_uses(batch, "v2")
    assert rows_of(got, *want.columns) == rows_of(want, *want.columns)
    assert got.select("batch").distinct().count() > 1


def test_lineage_stream_corrects_itself(spark, tmp_path):
    """The events in parts out of order, one file at a time: after a batch the settled rows are the batch operator's answer for the events so far."""
    rows = [(*r[:5], "xhr", "GET", f"https://h/p{i * i % 5}", {"content-type": "application/json"}, f'{{"id":"tok-{i % 2}"}}', r[10])
            for i, r in enumerate(random_events(13, 60))]
    names = [f.name for f in schemas.CAPTURE]
    parts = [rows[at * 10:(at + 1) * 10] for at in (5, 0, 3, 1, 4, 2)]
    for i, part in enumerate(parts):
        write_at(tmp_path / f"part-{i}.json", [json.dumps(dict(zip(names, r))) for r in part], i)
    got = drain(streaming.lineage_stream(stream_capture(spark, str(tmp_path), files_per_batch=1), "v2"))
    assert got.where("change < 0").count() > 0
    columns = streaming.settle_lineage(got).columns
    for i in (2, 5):
        want = lineage_uses(frame(spark, sum(parts[:i + 1], [])), "v2")
        assert rows_of(streaming.settle_lineage(got.where(F.col("batch") <= i)), *columns) == rows_of(want, *columns)


def test_stream_lineage_reads_whole_texts(spark, tmp_path):
    """Words far behind the tenth are matched, on both sides."""
    from siftlane.plans import QUERIES
    filler = [f"w{i:03}" for i in range(300)]
    turns = [(1, 0, "user", " ".join([*filler[:150], "given"])), (1, 1, "assistant", " ".join(["ab", *filler, "given", "given"])),
             (1, 2, "user", " ".join(["one"] * 40 + ["given", "ab", filler[299]])), (2, 3, "user", "given"),
             (1, 4, "assistant", "now " * 20 + "given"), (1, 5, "user", "then " * 11 + "given")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["stream_lineage"](spark, str(tmp_path))
    source, use = "POST /assistant", "POST /user"
    assert rows_of(got, "session_id", "seq", "ord", "source_endpoint", "source_field", "consumer_endpoint", "consumer_field") == [
        ("c1", 2, 40, source, "[302]", use, "[40]"), ("c1", 2, 42, source, "[300]", use, "[42]"), ("c1", 5, 11, source, "[20]", use, "[11]")]


class Handle:
    """State in dictionaries that count what is read and written."""

    def __init__(self):
        self.map, self.value, self.reads, self.writes = {}, None, 0, 0

    def getMapState(self, *_):
        return self

    def getValueState(self, *_):
        handle = self

        class Value:
            def exists(self):
                return handle.value is not None

            def get(self):
                return handle.value

            def update(self, value):
                handle.value = value
        return Value()

    def getValue(self, key):
        self.reads += 1
        return self.map.get(key)

    def updateValue(self, key, value):
        self.writes += 1
        self.map[key] = value


def fed(processor, rows):
    import pandas as pd
    parts = iter([pd.DataFrame(rows, columns=["side", "seq", "ord", "endpoint", "field_path"])])
    return [tuple(r) for out in processor.handleInputRows(("s", "t"), parts, None) for r in out.itertuples(index=False)]


def plain_uses(rows):
    out = []
    for side, seq, ord_, endpoint, path in rows:
        given = [r for r in rows if r[0] and r[1] < seq]
        if not side and given:
            last = max(given, key=lambda r: (r[1], r[2]))
            out.append(("s", seq, ord_, *last[3:], endpoint, path))
    return sorted(out)


@pytest.mark.parametrize("seed", range(6))
def test_lineage_state_in_any_order(seed):
    """Events of one token in random order and batches, blocks of three positions."""
    import random
    from collections import Counter
    from siftlane.streaming.lineage import _Lineage
    rng = random.Random(seed)
    rows = [(int(rng.random() < 0.4), seq, ord_, f"e{rng.randrange(3)}", f"f{ord_}") for seq in rng.sample(range(200), 60) for ord_ in range(rng.choice([1, 1, 2]))]
    rng.shuffle(rows)
    processor, held, seen = _Lineage(None, 3), Counter(), []
    processor.init(Handle())
    for i in range(0, len(rows), 7):
        for *row, change in fed(processor, rows[i:i + 7]):
            held[tuple(row)] += change
        seen += rows[i:i + 7]
        assert sorted(held.elements()) == plain_uses(seen) and min(held.values(), default=0) >= 0


def test_lineage_state_per_batch_is_bounded():
    """A token that alternates between endpoints for 20,000 positions: a batch reads and writes a few blocks, not the history."""
    from siftlane.streaming.lineage import SPAN, _Lineage
    handle = Handle()
    processor, most = _Lineage(None), 0
    processor.init(handle)
    for begin in range(0, 20_000, 100):
        before = handle.reads + handle.writes
        fed(processor, [(int(i % 4 > 0), i, 0, f"e{i % 2}", "f") for i in range(begin, begin + 100)])
        most = max(most, handle.reads + handle.writes - before)
    assert len(handle.map) == -(-20_000 // SPAN) and most <= 8
    before = handle.reads + handle.writes
    out = fed(processor, [(1, 301, 5, "late", "f"), (1, 9_000, 0, "late", "f")])
    assert handle.reads + handle.writes - before <= 6 and len(out) <= 4
    assert max(len(text) for (text,) in handle.map.values()) < 60 * SPAN


def test_catalog_stream_equals_batch(spark, feed):
    folder, batch = feed
    rows = drain(streaming.catalog_stream(stream_capture(spark, folder, files_per_batch=1), "v1"), "update")
    key = ["session_id", "method", "path", "status"]
    current = (rows.groupBy(*key).agg(F.max_by(F.struct("first_seq", "url", "last_seq"), "batch").alias("r"))
               .select(*key, "r.*"))
    got = settle_catalog(current)
    want = C.endpoint_statuses(batch, "v1")
    assert rows_of(got, *want.columns) == rows_of(want, *want.columns)


def test_first_samples_stream_equals_batch(spark, feed):
    folder, batch = feed
    stream = streaming.first_samples_stream(stream_capture(spark, folder, files_per_batch=1), "v2")
    got, want = drain(stream), C.sample_rows(batch, "v2").drop("rank")
    assert rows_of(got, *want.columns) == rows_of(want, *want.columns)


def test_changed_pages_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "pages"
    folder.mkdir()
    states = ["A", "A", "B", "B", "A", "A"]
    names = [f.name for f in schemas.PAGES]
    rows = [("s", i, f"2024-01-01T00:00:0{i}Z", 0, "https://h/x", html) for i, html in enumerate(states)]
    for i in range(0, len(rows), 2):
        write_at(folder / f"p{i}.json", [json.dumps(dict(zip(names, r))) for r in rows[i:i + 2]], i)
    got = drain(streaming.changed_pages_stream(stream_pages(spark, str(folder), files_per_batch=1)))
    batch = spark.createDataFrame([(r[0], r[1], r[5]) for r in rows], "session_id string, page_id long, html string")
    want = changed_only(batch, ["session_id"], "page_id", "html")
    assert [r.page_id for r in got.orderBy("page_id").collect()] == [r.page_id for r in want.orderBy("page_id").collect()] == [0, 2, 4]


def test_drop_late_removes_replays(spark, feed):
    folder, batch = feed
    stream = stream_capture(spark, folder, files_per_batch=1).withColumn("ts", F.timestamp_seconds("seq"))
    twice = stream.unionByName(stream_capture(spark, folder, files_per_batch=1).withColumn("ts", F.timestamp_seconds("seq")))
    got = drain(streaming.drop_late(twice, "1 hour").drop("headers"))
    assert got.count() == batch.count()


def page_files(folder, parts):
    names = [f.name for f in schemas.PAGES]
    folder.mkdir()
    for i, part in enumerate(parts):
        lines = [json.dumps(dict(zip(names, (s, p, f"2024-01-01T00:{t // 60:02d}:{t % 60:02d}Z", 0, "https://h/x", html)))) for s, p, t, html in part]
        write_at(folder / f"p{i}.json", lines, i)
    return str(folder)


def test_ordered_pages_over_shuffled_parts(spark, tmp_path):
    """States that come in any order within the delay are compared in event order, across micro-batches; a clock row releases the rest."""
    import random
    rng = random.Random(2)
    rows = [(f"s{i % 3}", i, i, rng.choice("AB")) for i in range(120)]
    shuffled = sorted(rows, key=lambda r: r[2] + rng.randrange(50))
    parts = [shuffled[i:i + 20] for i in range(0, 120, 20)] + [[("clock", 999, 3000, "-")]]
    got = drain(streaming.ordered_pages_stream(stream_pages(spark, page_files(tmp_path / "in", parts), files_per_batch=1), "1 minute")).where("session_id <> 'clock'")
    batch = spark.createDataFrame([(s, p, html) for s, p, _, html in rows], "session_id string, page_id long, html string")
    want = changed_only(batch, ["session_id"], "page_id", "html")
    assert rows_of(got, "session_id", "page_id") == rows_of(want, "session_id", "page_id") and got.where("late").count() == 0
    assert got.select("batch").distinct().count() > 2
    seconds = got.select(F.col("page_id"), F.unix_seconds("ts").alias("t")).collect()
    assert {r.t - r.page_id for r in seconds} == {1704067200}


def test_late_pages_come_out_marked(spark, tmp_path):
    """What comes behind the watermark changes nothing and is not lost."""
    on_time = [("s", i, i * 10, html) for i, html in enumerate("AABBA")]
    late = [("s", 50, 5, "Z"), ("s", 51, 15, "A")]
    parts = [on_time, [("clock", 999, 1800, "-")], [("clock", 1000, 1801, "-")], late, [("s", 60, 1900, "A"), ("s", 61, 1910, "C")], [("clock", 1001, 3000, "-")]]
    got = drain(streaming.ordered_pages_stream(stream_pages(spark, page_files(tmp_path / "in", parts), files_per_batch=1), "1 minute")).where("session_id = 's'")
    assert [r.page_id for r in got.where("late").orderBy("page_id").collect()] == [50, 51]
    assert [r.page_id for r in got.where("not late").orderBy("ts").collect()] == [0, 2, 4, 61]


def test_late_events_are_what_drop_late_drops(spark, tmp_path):
    rows = spark.range(200).select(F.concat(F.lit("s"), F.col("id") % 4).alias("session_id"), F.col("id").alias("seq"), F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    for i, part in enumerate([rows.where("seq % 5 > 0"), rows.where("seq = 199"), rows.where("seq % 5 = 0")]):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        for f in (tmp_path / f"in/{i}").glob("part-*"):
            os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    feed = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    kept, late = drain(streaming.drop_late(feed(), "59 minutes")), drain(streaming.late_events(feed(), "59 minutes"))
    assert sorted(r.seq for r in kept.select("seq").union(late.select("seq")).collect()) == list(range(200))
    assert sorted(r.seq for r in late.collect()) == list(range(0, 141, 5))


@pytest.mark.parametrize("order", [(0, 1, 2, 3, 4), (4, 3, 2, 1, 0), (2, 0, 4, 1, 3)])
def test_samples_in_any_order(spark, tmp_path, order):
    rows = random_events(17, 150)
    names = [f.name for f in schemas.CAPTURE]
    for i, at in enumerate(order):
        write_at(tmp_path / f"part-{i}.json", [json.dumps(dict(zip(names, r))) for r in rows[at * 30:(at + 1) * 30]], i)
    batch = frame(spark, rows)
    feed = lambda: stream_capture(spark, str(tmp_path), files_per_batch=1)
    first, answers = drain(streaming.first_samples_stream(feed(), "v2")), drain(streaming.response_samples_stream(feed(), "v2"))
    want = C.sample_rows(batch, "v2").drop("rank")
    assert rows_of(streaming.settle_samples(first), *want.columns) == rows_of(want, *want.columns)
    want = C.response_sample_rows(batch, "v2")
    assert rows_of(streaming.settle_samples(answers), *want.columns) == rows_of(want, *want.columns)
    taken_back = first.where("change < 0").count(), answers.where("change < 0").count()
    assert taken_back == (0, 0) if order == (0, 1, 2, 3, 4) else min(taken_back) > 0


class Entries:
    """State of one key in dictionaries, with a count of calls."""

    def __init__(self):
        self.calls, self.timers = 0, set()

    def getMapState(self, *_):
        entries, held = self, {}

        class Map:
            def getValue(self, key):
                entries.calls += 1
                return held.get(key)

            def updateValue(self, key, value):
                entries.calls += 1
                held[key] = value

            def removeKey(self, key):
                entries.calls += 1
                del held[key]
        return Map()

    def getValueState(self, *_):
        class Value:
            found = None

            def exists(self):
                return self.found is not None

            def get(self):
                return self.found

            def update(self, value):
                self.found = value

            def clear(self):
                self.found = None
        return Value()

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


def called(processor, rows, columns, watermark=0):
    import pandas as pd

    class Times:
        def getCurrentWatermarkInMs(self):
            return watermark
    return [r for out in processor.handleInputRows((0,), iter([pd.DataFrame(rows, columns=columns)]), Times()) for r in out.itertuples(index=False, name=None)]


def started(processor):
    handle = Entries()
    processor.init(handle)
    return processor, handle


def test_one_state_key_serves_many_endpoints():
    """A call costs two entries of state per endpoint; what an earlier event pushes out is taken back; endpoints may hold nulls."""
    from siftlane.streaming.samples import _FirstN
    columns = ["session_id", "method", "path", "seq", "body", "kind"]
    processor, handle = started(_FirstN(2))
    rows = [(f"s{i % 500}" if i % 500 else None, "GET", "/", i, f"b{i}", "text") for i in range(500, 2000)]
    assert sorted(r[3] for r in called(processor, rows, columns)) == list(range(500, 1500)) and handle.calls <= 1000
    assert called(processor, [(None, "GET", "/", 3, "b3", "text")], columns) == [(None, "GET", "/", 1000, "b1000", "text", -1), (None, "GET", "/", 3, "b3", "text", 1)]


def test_hot_endpoint_sends_few_rows():
    import pandas as pd
    from siftlane.streaming.samples import _first_of_batch
    rows = pd.DataFrame([("hot", "GET", "/", i) for i in range(1000)][::-1] + [(None, "GET", "/", 5)], columns=["session_id", "method", "path", "seq"])
    (out,) = _first_of_batch(2)(iter([rows]))
    assert sorted(out["seq"]) == [0, 1, 5]


@pytest.mark.parametrize("seed", range(4))
def test_response_samples_state_in_any_order(seed):
    """Events of three endpoints in any order and batches, chunks of three early responses: what holds is what all events so far give."""
    import random
    from collections import Counter
    from siftlane.streaming.samples import _ResponseSamples
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", None]), "GET", "/", i, rng.choice(["request", "text", "object", "text"]), f"r{i}") for i in range(90)]
    rng.shuffle(rows)
    (processor, _), held, seen = started(_ResponseSamples(2, 3)), Counter(), []
    for i in range(0, 90, 9):
        for *row, change in called(processor, rows[i:i + 9], ["session_id", "method", "path", "seq", "kind", "sample"]):
            held[tuple(row)] += change
        seen += rows[i:i + 9]
        want = []
        for own in ("a", "b", None):
            asked = [r[3] for r in seen if r[0] == own and r[4] == "request"]
            able = sorted((r for r in seen if asked and r[0] == own and r[4] != "request" and r[3] >= min(asked)), key=lambda r: r[3])
            want += [r for n, r in enumerate(able) if n == 0 or r[4] != "text"][:2]
        assert sorted(held.elements(), key=repr) == sorted(want, key=repr)


def test_waiting_pages_take_few_entries():
    """20,000 states of 100 pages, one a second, out of order: leaves, not rows, are read and written, and what the watermark passes comes in order."""
    import random
    from siftlane.streaming.event_time import LEAF, _InOrder
    rng = random.Random(1)
    rows = [(f"s{i % 100}" if i % 100 else None, "u", i, i * 1_000_000, rng.choice("AB")) for i in range(20_000)]
    shuffled = rng.sample(rows, len(rows))
    (processor, handle), out = started(_InOrder()), []
    for i in range(0, 20_000, 5_000):
        out += called(processor, shuffled[i:i + 5_000], ["session_id", "url", "page_id", "at", "digest"])
    assert out == [] and handle.calls < 8 * 20_000 // LEAF * 4 and len(handle.timers) == 1
    out = called(processor, [("s1", "u", 7, 5, "A")], ["session_id", "url", "page_id", "at", "digest"], 10_000_000)
    rest = called(processor, [], ["session_id", "url", "page_id", "at", "digest"], 30_000_000)
    last, want = {}, []
    for session, _, page, at, digest in rows:
        if last.get(session) != digest:
            want.append(page)
        last[session] = digest
    assert out[0][2:] == (7, 5, True) and [r[2] for r in out[1:] + rest] == want and handle.timers == set()


def test_one_state_key_serves_many_pages_and_tokens():
    import pandas as pd
    from siftlane.streaming.lineage import _Tokens
    from siftlane.streaming.online import _Changed
    processor, _ = started(_Changed(["session_id", "page_id"]))
    columns = ["session_id", "page_id", "ts", "digest"]
    at = pd.Timestamp("2024-01-01")
    assert called(processor, [("a", 2, at, "X"), (None, 1, at, "X"), ("a", 1, at, "X"), ("b", 3, at, "Y")], columns) == [(None, 1), ("a", 1), ("b", 3)]
    assert called(processor, [("a", 4, at, "X"), (None, 5, at, "Z"), ("b", 6, at, "Y"), ("b", 7, at, "X")], columns) == [(None, 5), ("b", 7)]
    processor, handle = started(_Tokens(None))
    columns = ["session_id", "token", "side", "seq", "ord", "endpoint", "field_path"]
    rows = [(f"s{i}", t, side, 1 + 2 * (1 - side), 0, "e", "f") for i in range(50) for t in "xy" for side in (1, 0)]
    assert sorted(r[:2] for r in called(processor, rows, columns)) == sorted((f"s{i}", 3) for i in range(50) for _ in "xy") and handle.calls <= 400


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now


TOKEN_ROW = ["session_id", "token", "side", "seq", "ord", "endpoint", "field_path"]


@pytest.mark.parametrize("seed, digits", [(0, 0), (1, 0), (2, 1), (3, 2)])
def test_lineage_pages_in_any_order(seed, digits):
    """Tokens of two sessions and of none in random order and batches; pages of four tokens, blocks of three positions."""
    import random
    from collections import Counter
    from hashlib import sha1

    import pandas as pd
    import pyarrow as pa
    from siftlane.streaming.lineage import _bundles, _Tokens
    rng = random.Random(seed)
    tokens = [sha1(str(i).encode()).hexdigest() for i in range(300)]
    rows = [(rng.choice(["a", "b", None]), rng.choice(tokens[:5] + [rng.choice(tokens)]), int(rng.random() < 0.4), seq, ord_, f"e{rng.randrange(3)}", f"f{ord_}")
            for seq in rng.sample(range(300), 200) for ord_ in range(rng.choice([1, 1, 2, 6]))]
    rng.shuffle(rows)
    processor, held, seen = _Tokens(None, 3, 4), Counter(), []
    _, handle = started(processor)
    for i in range(0, len(rows), 60):
        part = pd.DataFrame(rows[i:i + 60], columns=TOKEN_ROW)
        if digits:
            leaves = pa.RecordBatch.from_pandas(part, preserve_index=False)
            part = pa.Table.from_batches(_bundles(iter([leaves, leaves.slice(0, 0)]), digits)).to_pandas()
            assert {len(begin) for begin in part["begin"]} == {digits}
        for out in processor.handleInputRows((0,), iter([part]), None):
            for *row, change in out.itertuples(index=False, name=None):
                held[tuple(row)] += change
        seen += rows[i:i + 60]
        want = [(s, *r[1:]) for s, t in {r[:2] for r in seen} for r in plain_uses([r[2:] for r in seen if r[:2] == (s, t)])]
        assert sorted(held.elements(), key=repr) == sorted(want, key=repr) and min(held.values(), default=0) >= 0


def test_a_page_is_read_and_written_once():
    """Calls of the state follow the pages, not the tokens, and a page of too many tokens is cut."""
    from hashlib import sha1
    from siftlane.streaming.lineage import PAGE, _Tokens
    tokens = [sha1(str(i).encode()).hexdigest() for i in range(60 * PAGE)]
    processor, handle = started(_Tokens(None))
    called(processor, [("s", t, 1, 1, 0, "e", "f") for t in tokens[:1600]], TOKEN_ROW)
    assert handle.calls == 32
    assert len(called(processor, [("s", t, 0, 2, 0, "e", "f") for t in tokens[:1600]], TOKEN_ROW)) == 1600 and handle.calls == 64
    called(processor, [("s", t, 1, 3, 0, "e", "f") for t in tokens], TOKEN_ROW)
    assert handle.calls == 64 + 16 + 16 * 17
    assert len(called(processor, [("s", t, 0, 4, 0, "e", "f") for t in tokens], TOKEN_ROW)) == len(tokens) and handle.calls == 64 + 16 + 16 * 17 + 16 + 256 * 2


def test_lineage_forgets_what_is_not_touched():
    """A token that nobody has touched for the time to live is gone, though others keep its page."""
    from siftlane.streaming.lineage import _Tokens
    import pandas as pd
    processor, _ = started(_Tokens(100))

    def at(now, *rows):
        return [r[1] for out in processor.handleInputRows((0,), iter([pd.DataFrame(rows, columns=TOKEN_ROW)]), Clock(now)) for r in out.itertuples(index=False, name=None)]
    assert at(0, ("s", "a1", 1, 1, 0, "e", "f"), ("s", "a2", 1, 1, 0, "e", "f")) == []
    assert at(60, ("s", "a1", 0, 2, 0, "e", "f")) == [2]
    assert at(120, ("s", "a1", 0, 3, 0, "e", "f"), ("s", "a2", 0, 3, 0, "e", "f")) == [3]


def test_late_rows_share_state_keys(spark, monkeypatch):
    """Rows are dealt to a bounded number of state keys, however many sessions there are."""
    from siftlane.streaming.online import BUCKETS, bucket_of
    rows = spark.range(20_000).select(F.concat(F.lit("s"), "id").alias("session_id"), F.col("id").alias("seq"))
    assert rows.select(bucket_of("session_id", "seq")).distinct().count() == BUCKETS
