"""Trace tables: DOM mutations, function calls, event listeners."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlane.functions import predicates as P
from siftlane.functions import text as X


def mutation_log(mutations: DataFrame) -> DataFrame:
    """Mutations of targets that have an id or a class, as ``time, type, target_id, added_nodes``."""
    return (mutations.where(P.has_mutation_target(F.col("id"), F.col("class_name")))
            .select("session_id", X.epoch_ms(F.col("time")).alias("time"), "type",
                    X.mutation_target(F.col("id"), F.col("class_name"), F.col("tag")).alias("target_id"),
                    F.coalesce("added_nodes", F.lit(0)).alias("added_nodes")))


def call_log(calls: DataFrame, names: Iterable[str]) -> DataFrame:
    """Calls of the named functions; arguments and results stay JSON text."""
    return (calls.where(P.in_names(F.col("function"), list(names)))
            .select("session_id", "function", "arguments", "returned", X.epoch_ms(F.col("timestamp")).alias("ts")))


def listener_map(listeners: DataFrame) -> DataFrame:
    """Event names per selector key, one row each; the last element with a key wins."""
    key = X.selector_key(F.col("el_id"), F.col("class_name"), F.col("tag"))
    return (listeners.groupBy("session_id", key.alias("selector"))
            .agg(F.max_by("events", "ord").alias("events")))
