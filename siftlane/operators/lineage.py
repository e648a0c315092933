"""Value lineage: which earlier response supplied a value that a request sends.

An as-of equi join without a join: both sides are unioned and a window carries the last
producer forward, so a frequent token costs its row count and never a product of the two
sides.  The window is cut into blocks (see ``ordered``): a token or session that owns a third of
all leaves is spread over as many tasks as it has blocks of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlane.operators.capture import both_sides
from siftlane.operators.leaves import capture_leaves
from siftlane.operators.ordered import BLOCK, asof_last, first_n, with_index
from siftlane.profiles import CaptureProfile, profile_of
from siftlane.session import stored

_SIDE = "__side"
_EDGE = ["session_id", "source_endpoint", "source_field", "consumer_endpoint", "consumer_field"]


def _sides(consumers: DataFrame, producers: DataFrame, columns: list[str], origin: str) -> DataFrame:
    """Both sides in one table; consumers sort before producers of the same position."""
    asked = consumers.withColumn(_SIDE, F.lit(0))
    given = producers.select(*columns, origin).withColumn(_SIDE, F.lit(1))
    return asked.unionByName(given, allowMissingColumns=True)


def asof_match(consumers: DataFrame, producers: DataFrame, key: Sequence[str], pos: str = "seq",
               origin: str = "origin", block: int = BLOCK) -> DataFrame:
    """Consumers with the ``origin`` of the last producer at a strictly smaller ``pos``.

    No match, no row.  Producers must be unique per ``(key, pos)``.
    """
    both = _sides(consumers, producers, [*key, pos], origin)
    matched = asof_last(both, key, pos, origin, "__found", [_SIDE], block)
    return (matched.where((F.col(_SIDE) == 0) & F.col("__found").isNotNull())
            .withColumn(origin, F.col("__found")).drop("__found", _SIDE))


def used_leaves(leaves: DataFrame) -> DataFrame:
    """Leaves without the producers of tokens that no request of their session sends.

    Most of what responses hold is never sent back.  The semi-join has the key of the window
    that follows; where the tokens sent fit a broadcast, by Spark's own check, producers of other
    tokens are dropped before any shuffle, and beyond that in the shuffle that sorts them by key.
    """
    asked = leaves.where(F.col("side") == 0)
    sent = asked.select("session_id", "token").distinct()
    return asked.unionByName(leaves.where(F.col("side") == 1).join(sent, ["session_id", "token"], "left_semi"))


def value_lineage(leaves: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every use of a known value: edge columns with the position ``(seq, ord)`` of the use.

    ``leaves`` has both sides (``capture_leaves``) and is read more than once: pass it stored.  A
    use sees producers of smaller ``seq`` only; of those the last one counts, and within one
    response its last leaf.
    """
    origin = F.when(F.col("side") == 1, F.struct("endpoint", "field_path"))
    found = asof_last(used_leaves(leaves).withColumn("origin", origin), ["session_id", "token"], "seq", "origin", "source", ["side", "ord"], block,
                      carry_from=leaves.withColumn("origin", origin))
    return found.where((F.col("side") == 0) & F.col("source").isNotNull()).select(
        "session_id", "seq", "ord",
        F.col("source.endpoint").alias("source_endpoint"), F.col("source.field_path").alias("source_field"),
        F.col("endpoint").alias("consumer_endpoint"), F.col("field_path").alias("consumer_field"))


def lineage_uses(events: DataFrame, profile: str | CaptureProfile = "v2", block: int = BLOCK) -> DataFrame:
    """All uses in a capture log.

    Bodies are read and parsed once: the leaves are stored, as narrow rows, and the blocks, what
    is carried between them and the window are computed from those.
    """
    leaves = stored(capture_leaves(both_sides(events, profile), profile), "leaves")
    return value_lineage(leaves, block)


def distinct_edges(matches: DataFrame, edge_limit: int | None = None) -> DataFrame:
    """Distinct edges with their first use; at most ``edge_limit`` per session if given."""
    # One decimal holds (seq, ord), so this stays a hash aggregate; a struct would be sorted.
    place = F.col("seq").cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(11,0)") + F.col("ord")
    edges = (matches.groupBy(*_EDGE).agg(F.min("seq").alias("first_seq"), F.min(place).alias("first_at")))
    if edge_limit is not None:
        edges = first_n(edges, ["session_id"], ["first_at"], edge_limit)
    return edges


def lineage_edges(events: DataFrame, profile: str | CaptureProfile = "v2", block: int = BLOCK) -> DataFrame:
    """Distinct lineage edges of a capture log under a profile."""
    p = profile_of(profile)
    return distinct_edges(lineage_uses(events, p, block), p.edge_limit)


def edge_lines(edges: DataFrame) -> DataFrame:
    """Flow-chart line per edge, ``(session_id, ord, line)``; fresh nodes for every edge.

    Numbering reads the edges more than once: pass a stored table (``session.stored`` makes one).
    """
    # first_at is unique per session only with its tie columns; sort by all of them.
    numbered = with_index(edges, ["session_id"], "first_seq", "ord", 0, ["first_at", *_EDGE[1:]])

    def node(side: str, endpoint: str, field: str):
        return F.concat(F.lit("Node"), F.col("ord"), F.lit(f'{side}["'), F.col(endpoint),
                        F.lit("\\n("), F.col(field), F.lit(')"]'))

    return numbered.select(
        "session_id", "ord",
        F.concat(F.lit("    "), node("A", "source_endpoint", "source_field"), F.lit(" --> "),
                 node("B", "consumer_endpoint", "consumer_field")).alias("line"))
