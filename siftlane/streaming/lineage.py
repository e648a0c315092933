"""Online lineage that takes back what a late response proves wrong.

State is kept by (session, token) and cut into blocks of ``seq``.  A block holds the producers and
the uses in its span, its neighbours among the blocks in use, and one carried producer: the last
one of all blocks before.  A request finds its source in its own block.  A response that comes
late changes the source of the uses after it up to the next producer; for these the old edge is
retracted and the new one inserted, in its own block and in following ones as far as the next
producer.  So a micro-batch reads and writes the blocks of its own rows, those whose answers
change, and for a row that opens a block behind the newest one, the blocks in between.

A call of the state costs as much as dozens of tokens do in Python, so the tokens of a session
whose hashes begin alike lie in one page, which a micro-batch reads and writes once, and travel in
one row per event.  A token with more than one block has its blocks beside the page.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from siftlane.operators.leaves import capture_leaves
from siftlane.profiles import CaptureProfile
from siftlane.streaming.online import bucket_of, frames_of, name_of, use_rocksdb

#: Positions in a block.
SPAN = 256
#: Tokens in a page; one with more is cut by the next digit of their hashes.
PAGE = 256
#: Digits of a hash.
_DIGITS = 40
_json = json.JSONEncoder(separators=(",", ":")).encode
COLUMNS = ["session_id", "seq", "ord", "source_endpoint", "source_field", "consumer_endpoint", "consumer_field", "change"]
SCHEMA = ("session_id string, seq long, ord int, source_endpoint string, source_field string, "
          "consumer_endpoint string, consumer_field string, change int")
_ROW = ["side", "seq", "ord", "endpoint", "field_path"]
_EVENT = ["session_id", "seq", "side", "endpoint"]
_BUNDLE = {"session_id": pa.string(), "seq": pa.int64(), "side": pa.int32(), "endpoint": pa.string(), "begin": pa.string(),
           "tokens": pa.binary(), "places": pa.string()}
_BUNDLE_SCHEMA = "session_id string, seq long, side int, endpoint string, begin string, tokens binary, places string"


class _Block:
    """``given``: [seq, ord, endpoint, field] by seq, one per response; ``asked``: [seq, ord, endpoint, field], sorted; ``carried``: [endpoint, field] or None."""

    def __init__(self, before=None, after=None, carried=None, given=None, asked=None):
        self.before, self.after, self.carried, self.given, self.asked = before, after, carried, given or [], asked or []

    def text(self) -> str:
        return json.dumps([self.before, self.after, self.carried, self.given, self.asked])

    def last(self) -> list | None:
        """The last producer up to the block's end."""
        return self.given[-1][2:] if self.given else self.carried


class _Lineage(StatefulProcessor):
    """One token of one session."""

    def __init__(self, ttl_ms: int | None, span: int = SPAN):
        self.ttl_ms, self.span = ttl_ms, span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.blocks = handle.getMapState("blocks", "block long", "content string", self.ttl_ms)
        self.newest = handle.getValueState("newest", "block long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        yield from frames_of(self.changes(key[0], (r for part in rows for r in _columns(part, _ROW))), COLUMNS)

    def changes(self, session: str | None, rows: Iterable) -> list[tuple]:
        found = self.newest.get() if self.newest.exists() else None
        stored_tail = None if found is None else int(found[0])
        out = self.apply(session, rows, stored_tail, {})
        self.keep(self.dirty)
        if self.tail != stored_tail:
            self.newest.update((self.tail,))
        return out

    def apply(self, session: str | None, rows: Iterable, tail: int | None, held: dict[int, _Block]) -> list[tuple]:
        """Changes of the edges; ``tail`` is the newest block, ``held`` has blocks that need not be read."""
        self.tail, self.held = tail, held
        self.dirty: set[int] = set()
        self.out: dict[tuple, int] = {}
        asked = []
        for side, seq, ord_, endpoint, field in rows:
            if side:
                self._give([int(seq), int(ord_), endpoint, field])
            else:
                asked.append([int(seq), int(ord_), endpoint, field])
        for use in asked:
            self._ask(use)
        return [(session, seq, ord_, *source, *consumer, n) for (seq, ord_, consumer, source), n in self.out.items() if n]

    def keep(self, blocks: Iterable[int]) -> None:
        for b in blocks:
            self.blocks.updateValue((b,), (self.held[b].text(),))

    def _load(self, b: int) -> _Block | None:
        if b not in self.held:
            row = self.blocks.getValue((b,))
            if row is None:
                return None
            self.held[b] = _Block(*json.loads(row[0]))
        return self.held[b]

    def _block(self, b: int) -> _Block:
        """The block, linked between its neighbours if it is new."""
        block = self._load(b)
        if block is not None:
            return block
        block = self.held[b] = _Block()
        at = self.tail
        while at is not None and at > b:
            block.after, at = at, self._near(at).before
        block.before = at
        if at is not None:
            earlier = self._near(at)
            earlier.after, block.carried = b, earlier.last()
            self.dirty.add(at)
        if block.after is not None:
            self._near(block.after).before = b
            self.dirty.add(block.after)
        if self.tail is None or b > self.tail:
            self.tail = b
        self.dirty.add(b)
        return block

    def _near(self, b: int) -> _Block:
        """A neighbour, which is there unless its time to live has passed."""
        block = self._load(b)
        if block is None:
            block = self.held[b] = _Block()
        return block

    def _give(self, producer: list) -> None:
        seq, ord_, *new = producer
        b = seq // self.span
        block = self._block(b)
        i = bisect_left(block.given, [seq])
        if i < len(block.given) and block.given[i][0] == seq:
            if block.given[i][1] >= ord_:
                return
            old, block.given[i] = block.given[i][2:], producer
        else:
            old = block.given[i - 1][2:] if i else block.carried
            block.given.insert(i, producer)
        self.dirty.add(b)
        if old == new:
            return
        following = block.given[i + 1][0] if i + 1 < len(block.given) else None
        self._correct(block, seq, following, old, new)
        while following is None and block.after is not None:
            b = block.after
            block = self._near(b)
            block.carried = new
            self.dirty.add(b)
            following = block.given[0][0] if block.given else None
            self._correct(block, None, following, old, new)

    def _correct(self, block: _Block, after: int | None, up_to: int | None, old: list | None, new: list) -> None:
        """Uses behind ``after`` and not behind ``up_to`` have another source now."""
        begin = 0 if after is None else bisect_right(block.asked, [after + 1])
        end = len(block.asked) if up_to is None else bisect_left(block.asked, [up_to + 1])
        for use in block.asked[begin:end]:
            self._tell(use, old, -1)
            self._tell(use, new, 1)

    def _ask(self, use: list) -> None:
        block = self._block(use[0] // self.span)
        i = bisect_left(block.given, [use[0]])
        self._tell(use, block.given[i - 1][2:] if i else block.carried, 1)
        insort(block.asked, use)
        self.dirty.add(use[0] // self.span)

    def _tell(self, use: list, source: list | None, n: int) -> None:
        if source is not None:
            edge = use[0], use[1], (use[2], use[3]), tuple(source)
            self.out[edge] = self.out.get(edge, 0) + n

    def close(self) -> None:
        pass


class _Under:
    """The blocks of one token in a map; where there are ``none`` yet, the map is not asked."""

    def __init__(self, entries, token: tuple, none: bool):
        self.entries, self.token, self.none = entries, token, none

    def getValue(self, key: tuple) -> tuple | None:
        return None if self.none else self.entries.getValue((name_of(*self.token), *key))

    def updateValue(self, key: tuple, value: tuple) -> None:
        self.entries.updateValue((name_of(*self.token), *key), value)


class _Tokens(StatefulProcessor):
    """The tokens that share a state key, each as ``_Lineage`` has it.

    Entry of a token in its page: newest block, producers, uses and, with a time to live, when it was
    touched.  From its second block on, producers and uses are None and each block is an entry of
    ``blocks``.  A page that has been cut holds null.
    """

    def __init__(self, ttl_ms: int | None, span: int = SPAN, page: int = PAGE):
        self.ttl_ms, self.span, self.page = ttl_ms, span, page

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pages = handle.getMapState("pages", "page string", "content binary", self.ttl_ms)
        self.blocks = handle.getMapState("blocks", "token string, block long", "content string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        self.now = timer_values.getCurrentProcessingTimeInMs() if self.ttl_ms else None
        found: dict[str | None, dict[str, list]] = {}
        for part in rows:
            for session, token, *row in _unbundled(part):
                found.setdefault(session, {}).setdefault(token, []).append(row)
        yield from frames_of((c for session, tokens in found.items() for c in self._below(session, "", tokens)), COLUMNS)

    def _below(self, session: str | None, begin: str, tokens: dict[str, list]) -> Iterator[tuple]:
        """Changes of tokens whose pages have one digit more."""
        for longer, some in _by_digit(begin, tokens).items():
            name = name_of(session, longer)
            found = self.pages.getValue((name,))
            entries = {} if found is None else json.loads(zlib.decompress(found[0]))
            if entries is None:
                if self.ttl_ms:
                    self._write(session, longer, None)  # lives as long as what is below it
                yield from self._below(session, longer, some)
                continue
            if self.ttl_ms:
                entries = {t: e for t, e in entries.items() if e[3] + self.ttl_ms > self.now}
            for token, rows in some.items():
                yield from self._changes(session, token, rows, entries)
            self._write(session, longer, entries)

    def _write(self, session: str | None, begin: str, entries: dict[str, list] | None) -> None:
        if entries is not None and len(entries) > self.page:
            for longer, some in _by_digit(begin, entries).items():
                self._write(session, longer, some)
            entries = None
        self.pages.updateValue((name_of(session, begin),), (zlib.compress(_json(entries).encode(), 1),))

    def _changes(self, session: str | None, token: str, rows: list, entries: dict[str, list]) -> list[tuple]:
        known, touched = token in entries, [self.now] if self.ttl_ms else []
        if not known and len(rows) == 1:  # as most are
            ((side, seq, *rest),) = rows
            leaf = [[int(seq), int(rest[0]), *rest[1:]]]
            entries[token] = [int(seq) // self.span, *((leaf, []) if side else ([], leaf)), *touched]
            return []
        tail, given, asked = entries[token][:3] if known else (None, [], [])
        inside = given is not None
        own = _Lineage(self.ttl_ms, self.span)
        own.blocks = _Under(self.blocks, (session, token), inside)
        out = own.apply(session, rows, tail, {tail: _Block(given=given, asked=asked)} if inside and known else {})
        if inside and len(own.held) == 1:
            (block,) = own.held.values()
            given, asked = block.given, block.asked
        else:
            own.keep(own.held if inside else own.dirty)
            given = asked = None
        entries[token] = [own.tail, given, asked, *touched]
        return out

    def close(self) -> None:
        pass


def _by_digit(begin: str, tokens: dict[str, list]) -> dict[str, dict[str, list]]:
    """Tokens by their first digits, one more than ``begin`` has."""
    out: dict[str, dict[str, list]] = {}
    for token, found in tokens.items():
        out.setdefault(token[:len(begin) + 1], {})[token] = found
    return out


def _columns(part: pd.DataFrame, names: list[str]) -> Iterator[tuple]:
    return zip(*(part[c].tolist() for c in names))


def _bundles(batches: Iterator[pa.RecordBatch], digits: int = 1) -> Iterator[pa.RecordBatch]:
    """The leaves of an event whose tokens begin with the same digits as one row, as far as an Arrow batch has them."""
    for batch in batches:
        found: dict[tuple, list] = {}
        for *event, token, ord_, field in zip(*(batch.column(c).to_pylist() for c in [*_EVENT, "token", "ord", "field_path"])):
            found.setdefault((*event, token[:digits]), []).append((token, ord_, field))
        tokens = [bytes.fromhex("".join(leaf[0] for leaf in some)) for some in found.values()]
        places = [_json([leaf[1:] for leaf in some]) for some in found.values()]
        columns = [*zip(*found)] or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip([*columns, tokens, places], _BUNDLE.values())], names=[*_BUNDLE])


def _unbundled(part: pd.DataFrame) -> Iterator[tuple]:
    """Session, token, and the row that ``_Lineage`` takes, of each leaf."""
    if "tokens" not in part:
        yield from _columns(part, ["session_id", "token", *_ROW])
        return
    for session, seq, side, endpoint, tokens, places in _columns(part, [*_EVENT, "tokens", "places"]):
        digits = bytes(tokens).hex()
        for i, (ord_, field) in enumerate(json.loads(places)):
            yield session, digits[i * _DIGITS:(i + 1) * _DIGITS], side, seq, ord_, endpoint, field


def lineage_stream(events: DataFrame, profile: str | CaptureProfile = "v2", ttl_ms: int | None = None, digits: int = 1) -> DataFrame:
    """Matched uses as they become known: ``change`` is 1 for an edge that holds and -1 for one that held before.

    Requests and responses may come in any order; ``settle_lineage`` of all rows is at every
    moment what the batch operator gives for the events so far.  Where responses come before the
    requests they precede, nothing is ever retracted.  Distinct edges and caps belong downstream.
    ``ttl_ms`` forgets blocks not touched for that long (default: never); a token's first block goes with the token.
    The first ``digits`` of a token's hash deal it to a state key: a session is spread over 16 keys,
    or with two digits over 256, for sessions that are most of the stream; a stream keeps its number.
    """
    use_rocksdb(events.sparkSession)
    rows = capture_leaves(events, profile).mapInArrow(lambda batches: _bundles(batches, digits), _BUNDLE_SCHEMA)
    return (rows.withColumn("bucket", bucket_of("session_id", "begin")).drop("begin").groupBy("bucket")
            .transformWithStateInPandas(_Tokens(ttl_ms), outputStructType=SCHEMA,
                                        outputMode="append", timeMode="ProcessingTime" if ttl_ms else "None"))


def settle_lineage(changes: DataFrame) -> DataFrame:
    """The uses that hold after all changes, as ``lineage_uses`` gives them."""
    columns = COLUMNS[:-1]
    held = changes.groupBy(*columns).agg(F.sum("change").cast("int").alias("__n")).where("__n > 0")
    return held.select(*columns, F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*columns)
