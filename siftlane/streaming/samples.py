"""Online samples that take back what an earlier event replaces.

The batch operators choose by position: the first N payloads of an endpoint, and of its responses
two JSON bodies or one text.  Events may come in any order, so a choice is provisional: rows
come out with ``change`` 1 when they are chosen and -1 when an earlier event has pushed them out,
and ``settle_samples`` of all rows is at every moment the batch answer for the events so far.
"""

from __future__ import annotations

import heapq
import json
from bisect import insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from siftlane.functions import text as X
from siftlane.operators.capture import ENDPOINT, both_sides, requests, with_json_facts
from siftlane.profiles import CaptureProfile, profile_of
from siftlane.streaming.online import bucket_of, frames_of, name_of, use_rocksdb


#: Responses before the first request of an endpoint that lie in one entry of the state.
CHUNK = 256


def _changes(endpoint: tuple, old: list, new: list) -> list[tuple]:
    """Rows taken back and rows chosen; entries are lists."""
    return [(*endpoint, *e, -1) for e in old if e not in new] + [(*endpoint, *e, 1) for e in new if e not in old]


def _first_of_batch(n: int):
    """The first ``n`` rows per endpoint of each Arrow batch, so that a hot endpoint sends few rows to its state key."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.sort_values("seq", kind="stable").groupby(ENDPOINT, sort=False, dropna=False).head(n)
    return run


class _FirstN(StatefulProcessor):
    """State per endpoint: the first ``n`` rows so far, by ``seq``.  Rows pushed out are taken back."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "endpoint string", "rows string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        found: dict[tuple, list] = {}
        for part in rows:  # no more than n rows of an endpoint are ever held
            for session, method, path, seq, body, kind in part[[*ENDPOINT, "seq", "body", "kind"]].itertuples(index=False, name=None):
                insort(some := found.setdefault((session, method, path), []), [int(seq), body, kind], key=lambda r: r[0])
                del some[self.n:]
        yield from frames_of((c for endpoint, some in found.items() for c in self._settled(endpoint, some)), [*ENDPOINT, "seq", "body", "kind", "change"])

    def _settled(self, endpoint: tuple, some: list) -> list[tuple]:
        name = (name_of(*endpoint),)
        held = self.held.getValue(name)
        old = json.loads(held[0]) if held else []
        new = heapq.nsmallest(self.n, [*old, *(e for e in some if e not in old)], key=lambda r: r[0])
        if new == old:
            return []
        self.held.updateValue(name, (json.dumps(new),))
        return _changes(endpoint, old, new)

    def close(self) -> None:
        pass


def first_samples_stream(events: DataFrame, profile: str | CaptureProfile = "v2") -> DataFrame:
    """First-N sample payloads per endpoint as they become known, in any order of arrival.

    What is sent to the state of an endpoint is the first N of each Arrow batch, a superset of
    the answer.  The profile must set a sample limit.
    """
    p = profile_of(profile)
    if p.sample_limit is None:
        raise ValueError("without a sample limit every payload is a sample: read the log instead")
    use_rocksdb(events.sparkSession)
    parsed = with_json_facts(requests(events, p).where("parse"))
    if not p.raw_text_samples:
        parsed = parsed.where(F.col("json_kind").isNull() | F.col("json_truthy"))
    samples = parsed.select(*ENDPOINT, "seq", "body",
                            F.when(F.col("json_truthy"), F.col("json_kind")).otherwise(F.lit("text")).alias("kind"))
    few = samples.mapInPandas(_first_of_batch(p.sample_limit), samples.schema)
    return few.withColumn("bucket", bucket_of(*ENDPOINT)).groupBy("bucket").transformWithStateInPandas(
        _FirstN(p.sample_limit), outputMode="append", timeMode="None",
        outputStructType="session_id string, method string, path string, seq long, body string, kind string, change int")


class _Responses:
    """An endpoint: the position of its first request, the responses from there on that can count (the first
    one and the first JSON bodies), the number of chunks that hold all responses before it, and new ones of those."""

    def __init__(self, text: str | None):
        self.first, self.able, self.chunks = json.loads(text) if text else (None, [], 0)
        self.text, self.before, self.stored, self.early = text, self.first, list(self.able), []


class _ResponseSamples(StatefulProcessor):
    """State per endpoint: what ``_Responses`` has, and the chunks.

    The first request only ever moves back.  So of responses behind it no more than ``limit`` + 1
    can ever count; those before it may all count one day and are read when it does move.
    """

    def __init__(self, limit: int, chunk: int = CHUNK):
        self.limit, self.chunk = limit, chunk

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "endpoint string", "content string")
        self.early = handle.getMapState("early", "endpoint string, chunk long", "rows string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        found: dict[tuple, _Responses] = {}
        for part in rows:
            part = part[[*ENDPOINT, "seq", "kind", "sample"]]
            asked = part["kind"] == "request"
            for session, method, path, seq, _, _ in part[asked].itertuples(index=False, name=None):
                own = self._own(found, (session, method, path))
                own.first = int(seq) if own.first is None else min(own.first, int(seq))
            for session, method, path, seq, kind, sample in part[~asked].itertuples(index=False, name=None):
                endpoint = session, method, path
                own = self._own(found, endpoint)
                if own.first is not None and seq >= own.first:
                    insort(own.able, [int(seq), kind, sample])
                    own.able = self._useful(own.able)
                else:
                    own.early.append([int(seq), kind, sample])
                    if len(own.early) >= self.chunk:
                        self._put(endpoint, own, own.early)
                        own.early = []
        yield from frames_of((c for endpoint, own in found.items() for c in self._settled(endpoint, own)), [*ENDPOINT, "seq", "kind", "sample", "change"])

    def _own(self, found: dict[tuple, _Responses], endpoint: tuple) -> _Responses:
        if endpoint not in found:
            held = self.held.getValue((name_of(*endpoint),))
            found[endpoint] = _Responses(held[0] if held else None)
        return found[endpoint]

    def _put(self, endpoint: tuple, own: _Responses, rows: list) -> None:
        self.early.updateValue((name_of(*endpoint), own.chunks), (json.dumps(rows),))
        own.chunks += 1

    def _settled(self, endpoint: tuple, own: _Responses) -> list[tuple]:
        if own.first != own.before:
            name, n = name_of(*endpoint), own.chunks
            rows = [e for i in range(n) for e in json.loads(self.early.getValue((name, i))[0])] + own.early
            rows = list({e[0]: e for e in rows}.values())  # of responses at one position the last one
            own.able = self._useful(sorted(own.able + [e for e in rows if e[0] >= own.first]))
            rest = [e for e in rows if e[0] < own.first]
            own.chunks, own.early = 0, []
            for i in range(0, len(rest), self.chunk):
                self._put(endpoint, own, rest[i:i + self.chunk])
            for i in range(own.chunks, n):
                self.early.removeKey((name, i))
        elif own.early:
            if own.chunks:  # the last chunk is filled up first
                own.chunks -= 1
                own.early = json.loads(self.early.getValue((name_of(*endpoint), own.chunks))[0]) + own.early
            for i in range(0, len(own.early), self.chunk):
                self._put(endpoint, own, own.early[i:i + self.chunk])
        text = json.dumps([own.first, own.able, own.chunks])
        if text != own.text:
            self.held.updateValue((name_of(*endpoint),), (text,))
        return _changes(endpoint, self._chosen(own.stored), self._chosen(own.able))

    def _useful(self, able: list) -> list:
        """The first response and the first ``limit`` JSON bodies."""
        structured = [e[0] for e in able if e[1] != "text"][:self.limit]
        return [e for i, e in enumerate(able) if i == 0 or e[0] in structured]

    def _chosen(self, able: list) -> list:
        """A text counts only if it is the first response; JSON bodies fill what is left."""
        return able[:self.limit]

    def close(self) -> None:
        pass


def response_samples_stream(events: DataFrame, profile: str | CaptureProfile = "v2") -> DataFrame:
    """Response samples per endpoint as they become known: endpoint, ``seq, kind, sample, change``.

    Requests and responses may come in any order.  The state of an endpoint holds its samples and
    whatever responses came before its first request.  The profile must set a limit above 0.
    """
    p = profile_of(profile)
    if not p.response_sample_limit:
        raise ValueError("the profile keeps no response samples, or all of them: read the log instead")
    use_rocksdb(events.sparkSession)
    both = both_sides(events, p).where((F.col("kind") == "request") | F.col("body").isNotNull())
    answered = F.col("kind") == "response"
    facts = with_json_facts(both.withColumn("parse", F.col("parse") & answered))
    kind = F.when(answered, F.coalesce("json_kind", F.lit("text"))).otherwise(F.lit("request"))
    sample = F.when(answered, F.when(kind == "text", X.text_sample(F.col("body"), p.text_sample)).otherwise(F.col("body")))
    narrow = facts.select(*ENDPOINT, "seq", kind.alias("kind"), sample.alias("sample"), bucket_of(*ENDPOINT))
    return narrow.groupBy("bucket").transformWithStateInPandas(
        _ResponseSamples(p.response_sample_limit), outputMode="append", timeMode="None",
        outputStructType="session_id string, method string, path string, seq long, kind string, sample string, change int")


def settle_samples(changes: DataFrame) -> DataFrame:
    """The rows that hold after all changes."""
    columns = [c for c in changes.columns if c not in ("change", "batch")]
    return changes.groupBy(*columns).agg(F.sum("change").alias("__n")).where("__n > 0").select(*columns)
