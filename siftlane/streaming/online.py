"""Online catalog, page changes and late data; ``lineage``, ``samples`` and ``event_time`` have the rest.

Endpoints, sessions and tokens are dealt to ``BUCKETS`` state keys by hash, and a key holds a map
with an entry for each of its own: calling Python and building a frame costs milliseconds a key, an
entry of a map far less.  State lives in RocksDB.  A micro-batch is bounded by the source's file
limit, which bounds what one key can bring to one task at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from siftlane.functions.text import content_hash
from siftlane.operators.capture import ENDPOINT, both_sides
from siftlane.profiles import CaptureProfile, profile_of
from siftlane.session import ensure_checkpoint_dir

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: State keys of a stream.
BUCKETS = 1024
#: Rows of a frame that a state key puts out.
ROWS_AT_ONCE = 1 << 13


def bucket_of(*columns: str) -> Column:
    """The state key that serves these values."""
    return F.pmod(F.xxhash64(*columns), F.lit(BUCKETS)).cast("int").alias("bucket")


def name_of(*values) -> str:
    """Values, also null ones, as the key of a map entry."""
    return json.dumps(values)


def frames_of(rows: Iterable[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= ROWS_AT_ONCE:
            yield pd.DataFrame(held, columns=columns)
            held = []
    if held:
        yield pd.DataFrame(held, columns=columns)


def use_rocksdb(spark: SparkSession) -> None:
    """State store that the stateful operators below need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what its source holds now and read back what it put out.

    Every micro-batch goes to the shared folder with its number in ``batch``.
    """
    place = f"{ensure_checkpoint_dir(stream.sparkSession)}/siftlane/drained-{uuid.uuid4().hex}"
    written = []

    def keep(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{place}/out/batch={number}")  # a replay overwrites
        written.append(number)

    query = (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/state")
             .foreachBatch(keep).trigger(availableNow=True).start())
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    if not written:  # the source held nothing
        return stream.sparkSession.createDataFrame([], schema)
    return stream.sparkSession.read.schema(schema).parquet(f"{place}/out")


def drop_late(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Drop events later than the watermark, and replays of an event within it."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["session_id", "seq"])


def catalog_stream(events: DataFrame, profile: str | CaptureProfile = "v2") -> DataFrame:
    """Endpoints with first URL and statuses, for update mode.

    One row per endpoint and status (null for its requests) with the last response of that
    status; ``settle_catalog`` folds them.  Aggregates combine on the map side, so hot
    endpoints are no concern.
    """
    use_rocksdb(events.sparkSession)
    is_request = F.col("kind") == "request"
    asked = F.when(is_request, F.col("seq"))
    return (both_sides(events, profile).groupBy(*ENDPOINT, F.when(~is_request, F.col("status")).alias("status"))
            .agg(F.min(asked).alias("first_seq"), F.min_by("url", asked).alias("url"),
                 F.max(F.when(~is_request, F.col("seq"))).alias("last_seq")))


def settle_catalog(rows: DataFrame) -> DataFrame:
    """Fold the current rows of ``catalog_stream`` to one row per endpoint."""
    first = rows.where(F.col("status").isNull()).select(*ENDPOINT, "first_seq", "url")
    seen = (rows.where(F.col("status").isNotNull()).select(*ENDPOINT, "status", "last_seq")
            .join(first.select(*ENDPOINT, "first_seq"), ENDPOINT).where(F.col("last_seq") >= F.col("first_seq"))
            .groupBy(*ENDPOINT).agg(F.sort_array(F.collect_set("status")).alias("response_statuses")))
    return (first.join(seen, ENDPOINT, "left")
            .withColumn("response_statuses", F.coalesce("response_statuses", F.array().cast("array<int>"))))


class _Changed(StatefulProcessor):
    """State: digest of the last state of each page.  Lets changed states pass."""

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getMapState("last", "page string", "digest string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "page_id"], kind="stable")
        page = batch["session_id"].map(name_of)
        first, last = ~page.duplicated(), ~page.duplicated(keep="last")
        previous = {}
        for name in page[first]:
            held = self.last.getValue((name,))
            previous[name] = held[0] if held else ""
        before = batch.groupby(page, sort=False)["digest"].shift().where(~first, page.map(previous))
        for name, digest in zip(page[last], batch.loc[last, "digest"]):
            if digest != previous[name]:
                self.last.updateValue((name,), (digest,))
        changed = batch.loc[batch["digest"] != before, self.columns]
        if len(changed):
            yield changed

    def close(self) -> None:
        pass


def changed_pages_stream(pages: DataFrame) -> DataFrame:
    """Page states that differ from the state before; run it with a two-second trigger.

    A session is one page that navigates: its states follow each other whatever their address,
    and only the top frame's state counts.  Only digests travel to the state operator:
    ``(session_id, url, page_id, ts)`` of changed states come out, for a join with the pages
    inside ``foreachBatch``.
    """
    use_rocksdb(pages.sparkSession)
    columns = ["session_id", "url", "page_id", "ts"]
    return (pages.where(F.col("html").isNotNull() & (F.coalesce("frame_index", F.lit(0)) == 0))
            .select(*columns, content_hash(F.col("html")).alias("digest"), bucket_of("session_id"))
            .groupBy("bucket")
            .transformWithStateInPandas(_Changed(columns), outputMode="append", timeMode="None",
                                        outputStructType="session_id string, url string, page_id long, ts timestamp"))
