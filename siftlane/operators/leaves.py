"""JSON leaves as rows, on the producer and the consumer side of lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlane.functions import predicates as P
from siftlane.functions.bodies import leaf_array, maybe_container, maybe_json
from siftlane.functions.text import token_hash
from siftlane.functions.urls import endpoint_label
from siftlane.operators.capture import both_sides, requests, responses
from siftlane.profiles import CaptureProfile, profile_of


def json_leaves(df: DataFrame, body: str = "body", max_items: int = 10,
                types: tuple[str, ...] | None = None) -> DataFrame:
    """One row per leaf: the columns of ``df`` but ``body``, then
    ``ord, path, typ, value, root_kind``.

    Filter ``df`` first: whatever reaches this operator is parsed.
    """
    kept = [c for c in df.columns if c != body]
    return df.select(*kept, F.inline(leaf_array(maybe_json(F.col(body)), max_items, types)))


_LEAF = ["session_id", "seq", "ord", "endpoint", "field_path", "token"]


def _bodies(df: DataFrame, side: int) -> DataFrame:
    body = F.col("body") if side else maybe_container(F.col("body"))
    return df.where("parse").select("session_id", "seq", endpoint_label(F.col("method"), F.col("path")).alias("endpoint"),
                                    F.lit(side).alias("side"), body.alias("body"))


def _tokens(bodies: DataFrame, p: CaptureProfile, collapse: bool) -> DataFrame:
    kept = [c for c in bodies.columns if c != "body"]
    latest = (F.col("side") == 1) if collapse else None
    rows = bodies.select(*kept, F.inline(leaf_array(maybe_json(F.col("body")), p.max_items, ("string", "int"), latest)))
    # Producers must meet the length rule; equal hashes then make it hold for consumers too,
    # so filtering both sides only saves shuffle.
    tokens = rows.where(P.is_token_type(F.col("typ"))
                        & P.token_length_ok(F.col("value"), p.min_token, p.max_token)
                        & ((F.col("side") == 1) | P.is_container(F.col("root_kind"))))
    return tokens.select("session_id", "seq", "ord", "endpoint", F.col("path").alias("field_path"),
                         token_hash(F.col("value")).alias("token"), "side")


def request_leaves(events: DataFrame, profile: str | CaptureProfile = "v2") -> DataFrame:
    """Consumer leaves ``(session_id, seq, ord, endpoint, field_path, token)``."""
    p = profile_of(profile)
    return _tokens(_bodies(requests(events, p), 0), p, False).select(*_LEAF)


def response_leaves(events: DataFrame, profile: str | CaptureProfile = "v2") -> DataFrame:
    """Producer leaves, same columns; noise URLs included."""
    p = profile_of(profile)
    return _tokens(_bodies(responses(events, p), 1), p, False).select(*_LEAF)


def capture_leaves(events: DataFrame, profile: str | CaptureProfile = "v2") -> DataFrame:
    """Both sides in one scan, with ``side`` (0 consumer, 1 producer).

    Of a value that one response holds at several places only the last is kept: a later leaf
    overwrites an earlier one, and a response is one row, so this needs no shuffle.
    """
    p = profile_of(profile)
    both = both_sides(events, p)
    label = endpoint_label(F.col("method"), F.col("path"))
    side = F.when(F.col("kind") == "response", 1).otherwise(0)
    body = F.when(side == 1, F.col("body")).otherwise(maybe_container(F.col("body")))
    return _tokens(both.where("parse").select("session_id", "seq", label.alias("endpoint"), side.alias("side"),
                                              body.alias("body")), p, True)
