"""Streams put back into event order: a reorder buffer that the watermark releases, and late rows kept.

Rows wait in the state of the sessions that share a key, in leaves of consecutive times, until the
watermark has passed them; then they go on in the order of their time, whichever micro-batch brought
them.  An event time timer per key releases what waits when no more rows of it come.  A row that comes
after the watermark has passed it is too late to be put in order: it comes out marked, for a table of
its own, and changes nothing.  What waits is bounded by the delay, what a micro-batch reads by the
leaves it touches; a leaf that grows beyond ``LEAF`` rows is cut.

Event times travel as microseconds: Spark filters rows behind the watermark out silently where it
sees the time column itself.
"""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from siftlane.functions.text import content_hash
from siftlane.streaming.online import bucket_of, frames_of, name_of, use_rocksdb

#: Waiting rows in a leaf; rows of one time stay together.
LEAF = 1024
_COLUMNS = ["session_id", "url", "page_id", "at", "late"]


def _leaves(rows: list, most: int) -> Iterator[list]:
    """Ascending rows cut into leaves of equal size, ``most`` or fewer, at places where the time changes."""
    size = -(-len(rows) // -(-len(rows) // most))
    begin = 0
    while begin < len(rows):
        end = begin + size
        while end < len(rows) and rows[end][0] == rows[end - 1][0]:
            end += 1
        yield rows[begin:end]
        begin = end


class _InOrder(StatefulProcessor):
    """State of some sessions: waiting rows by leaf, the first times of the leaves, the timer, and the digest that came out last for each session.

    A waiting row is [time, page_id, url, digest, session_id].
    """

    def __init__(self, leaf: int = LEAF):
        self.leaf = leaf

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.leaves = handle.getMapState("leaves", "first long", "waiting string")
        self.used = handle.getValueState("used", "firsts string")
        self.timer = handle.getValueState("timer", "at long")
        self.last = handle.getMapState("last", "session string", "digest string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        passed = timer_values.getCurrentWatermarkInMs() * 1000
        stored = self._used()
        used = list(stored)
        for part in rows:
            is_late = part["at"] < passed
            late = part.loc[is_late, ["session_id", "url", "page_id", "at"]].assign(late=True)
            if len(late):
                yield late[_COLUMNS]
            used = self._wait(used, part.loc[~is_late])
        yield from self._release(stored, used, passed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        stored = self._used()
        yield from self._release(stored, list(stored), timerValues.getCurrentWatermarkInMs() * 1000)

    def _used(self) -> list[int]:
        return json.loads(self.used.get()[0]) if self.used.exists() else []

    def _held(self, first: int) -> list:
        return json.loads(self.leaves.getValue((first,))[0])

    def _wait(self, used: list[int], part: pd.DataFrame) -> list[int]:
        """Rows go to the leaf that holds their time; the first times of all leaves from then on."""
        rows = sorted(([int(a), int(p), u, d, s] for a, p, u, d, s in zip(part["at"], part["page_id"], part["url"], part["digest"], part["session_id"])),
                      key=lambda r: r[:4])
        out, begin, done = [], 0, 0
        while begin < len(rows):
            n = max(bisect_right(used, rows[begin][0]) - 1, 0)
            end = bisect_left(rows, used[n + 1], begin, key=lambda r: r[0]) if n + 1 < len(used) else len(rows)
            waiting = sorted([*self._held(used[n]), *rows[begin:end]], key=lambda r: r[:4]) if used else rows
            cut = list(_leaves(waiting, self.leaf))
            if used and used[n] != cut[0][0][0]:
                self.leaves.removeKey((used[n],))
            for leaf in cut:
                self.leaves.updateValue((leaf[0][0],), (json.dumps(leaf),))
            out += [*used[done:n], *(leaf[0][0] for leaf in cut)]
            done, begin = n + 1, end
        return out + used[done:]

    def _release(self, stored: list[int], used: list[int], passed: int) -> Iterator[pd.DataFrame]:
        """What lies before the watermark goes out, leaf by leaf; states equal to the one before are left out."""
        first: dict[str, str] = {}
        digest: dict[str, str] = {}

        def differs(session: str | None, own: str) -> bool:
            name = name_of(session)
            if name not in digest:
                held = self.last.getValue((name,))
                first[name] = digest[name] = held[0] if held else ""
            before, digest[name] = digest[name], own
            return own != before

        def changed() -> Iterator[tuple]:
            while used and used[0] < passed:
                waiting = self._held(used[0])
                n = bisect_left(waiting, passed, key=lambda r: r[0])
                self.leaves.removeKey((used[0],))
                if n < len(waiting):
                    used[0] = waiting[n][0]
                    self.leaves.updateValue((used[0],), (json.dumps(waiting[n:]),))
                else:
                    del used[0]
                for at, page_id, url, own, session in waiting[:n]:
                    if differs(session, own):
                        yield session, url, page_id, at, False

        yield from frames_of(changed(), _COLUMNS)
        for name, own in digest.items():
            if own != first[name]:
                self.last.updateValue((name,), (own,))
        if used != stored:
            self.used.update((json.dumps(used),))
        self._set_timer(used)

    def _set_timer(self, used: list[int]) -> None:
        """One timer, at the millisecond behind the first row that waits."""
        old = self.timer.get()[0] if self.timer.exists() else None
        new = used[0] // 1000 + 1 if used else None
        if old == new:
            return
        if old is not None:
            self.handle.deleteTimer(old)
        if new is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(new)
            self.timer.update((new,))

    def close(self) -> None:
        pass


def ordered_pages_stream(pages: DataFrame, delay: str = "1 minute") -> DataFrame:
    """Page states that differ from the state before them in event time: ``(session_id, url, page_id, ts, late)``.

    Rows may come up to ``delay`` out of order and over any number of micro-batches.  States of one time
    are ordered by ``page_id``.  What comes later still is returned with ``late`` true, whether it
    differs or not, and takes no part.  Rows without a time or without an address take no part.
    The newest states of a stream wait until the watermark passes them.  Otherwise as
    ``changed_pages_stream``.
    """
    use_rocksdb(pages.sparkSession)
    top = pages.where(F.col("html").isNotNull() & (F.coalesce("frame_index", F.lit(0)) == 0) & F.col("ts").isNotNull())
    narrow = (top.withWatermark("ts", delay)
              .select("session_id", F.coalesce("url", F.lit("")).alias("url"), "page_id", F.unix_micros("ts").alias("at"), content_hash(F.col("html")).alias("digest"),
                      bucket_of("session_id")))
    found = narrow.groupBy("bucket").transformWithStateInPandas(
        _InOrder(), outputStructType="session_id string, url string, page_id long, at long, late boolean", outputMode="append", timeMode="EventTime")
    return found.select("session_id", "url", "page_id", F.timestamp_micros("at").alias("ts"), "late")


class _Late(StatefulProcessor):
    """Lets rows pass that are not ahead of the watermark; holds nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        passed = timer_values.getCurrentWatermarkInMs() * 1000
        for part in rows:
            late = part.loc[part["at"] <= passed, ["session_id", "seq", "at"]]
            if len(late):
                yield late

    def close(self) -> None:
        pass


def late_events(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The events that ``drop_late`` with the same delay drops as late: ``(session_id, seq, ts)``.

    Run it beside ``drop_late``, into a table of its own: nothing vanishes uncounted.  Replays of a
    late event are all returned.
    """
    use_rocksdb(events.sparkSession)
    narrow = (events.where(F.col("ts").isNotNull()).withWatermark("ts", delay)
              .select("session_id", "seq", F.unix_micros("ts").alias("at"), bucket_of("session_id", "seq")))
    found = narrow.groupBy("bucket").transformWithStateInPandas(
        _Late(), outputStructType="session_id string, seq long, at long", outputMode="append", timeMode="EventTime")
    return found.select("session_id", "seq", F.timestamp_micros("at").alias("ts"))
