"""Order-dependent operators that survive hot keys.

A window partition never splits, so ``partitionBy(key)`` puts a key that owns a third of all
rows into one task.  The operators here work as a prefix scan: keys with more than ``block`` rows
are cut into blocks of about equal row counts at positions taken from a sample, the window runs
inside ``(key, block)``, and what earlier blocks contribute comes in as one extra *carry* row per
block.  Carries come from a window over per-block summaries, which are aggregated with a partial
step before they are shuffled.

The cuts follow the rows, not the scale of the positions: microseconds, negative or dense
positions are cut alike.  Where they lie decides only what a task holds, never the result, which
is exactly that of the plain window.  A key has at most 1,024 blocks, and rows of one position
stay together.  A table without such a key has no blocks and no carry, just the plain window.

The sample reads keys and positions once, when the operator is called.  Callers whose rows are
costly to compute pass them stored as ``carry_from``.
"""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlane.session import stored

#: Rows of one key that a task may hold, about.
BLOCK = 1 << 20
#: Sampled rows per ``block`` rows of a key; blocks of a key at most.
SAMPLED, MOST_BLOCKS = 256, 1024
_CARRY, _BLOCK, _CUTS = "__carry", "__block", "__cuts"


def cuts_of_hot_keys(df: DataFrame, key: Sequence[str], pos: str, block: int = BLOCK) -> DataFrame | None:
    """The keys that have more than ``block`` rows, by a sample, with the positions at which their
    blocks begin: columns ``__key0 ...`` and ``__cuts``; None if there is no such key.

    The table is stored, so that all who read it see the same cuts.
    """
    share = min(1.0, SAMPLED / block)
    rows = df.select(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(key)], F.col(pos).cast("long").alias("__pos"))
    sample = rows.sample(fraction=share, seed=17) if share < 1 else rows
    keys = [f"__key{i}" for i in range(len(key))]
    hot = F.col("__n") > share * block
    if sample.groupBy(*keys).agg(F.count("*").alias("__n")).where(hot).isEmpty():
        return None
    places = F.percentile_approx("__pos", [i / MOST_BLOCKS for i in range(1, MOST_BLOCKS)], 10 * MOST_BLOCKS)
    found = sample.groupBy(*keys).agg(F.count("*").alias("__n"), places.alias("__places")).where(hot)
    blocks = F.least(F.lit(MOST_BLOCKS), F.ceil(2 * F.col("__n") / (share * block))).cast("int")
    cuts = F.transform(F.sequence(F.lit(1), blocks - 1), lambda i: F.get("__places", (i * MOST_BLOCKS / blocks).cast("int") - 1))
    return stored(found.select(*keys, F.array_distinct(cuts).alias(_CUTS)), "cuts")


def _with_cuts(df: DataFrame, cuts: DataFrame, key: Sequence[str], how: str) -> DataFrame:
    """Rows with the cuts of their key; the table of cuts is small, and Spark decides by its size how to join."""
    same = [df[k].eqNullSafe(cuts[f"__key{i}"]) for i, k in enumerate(key)]
    return df.join(cuts, reduce(operator.and_, same), how).drop(*[f"__key{i}" for i in range(len(key))])


def _blocked(df: DataFrame, cuts: DataFrame, key: Sequence[str], pos: str, how: str = "left") -> DataFrame:
    """Rows with the number of their block, 0 where the key has no cuts."""
    place = F.coalesce(F.size(F.filter(_CUTS, lambda cut: cut <= F.col(pos))), F.lit(0))
    return _with_cuts(df, cuts, key, how).withColumn(_BLOCK, F.when(F.col(_CUTS).isNull(), 0).otherwise(place)).drop(_CUTS)


def _with_carry(body: DataFrame, carry: DataFrame) -> DataFrame:
    """Rows with their block, plus the carry rows, which sort first in their block."""
    return body.withColumn(_CARRY, F.lit(0)).unionByName(carry.withColumn(_CARRY, F.lit(1)), allowMissingColumns=True)


def _in_block(key: Sequence[str], order: Sequence[Column]) -> Window:
    return Window.partitionBy(*key, _BLOCK).orderBy(F.col(_CARRY).desc(), *order)


def _before() -> tuple[int, int]:
    return Window.unboundedPreceding, -1


def asof_last(df: DataFrame, key: Sequence[str], pos: str, value: str, out: str,
              ties: Sequence[str] = (), block: int = BLOCK,
              carry_from: DataFrame | None = None) -> DataFrame:
    """Add ``out``: the last non-null ``value`` before each row of its key.

    Rows are ordered by ``pos`` (BIGINT) and then by ``ties``; a row does not see itself.
    Rows that only ask have a null ``value``.
    """
    key, order = list(key), [F.col(pos), *[F.col(t) for t in ties]]
    source = df if carry_from is None else carry_from
    cuts = cuts_of_hot_keys(source, key, pos, block)
    if cuts is None:
        return df.withColumn(out, F.last(value, ignorenulls=True).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(*_before())))
    rank = F.when(F.col(value).isNotNull(), F.struct(*order) if ties else F.col(pos))
    summary = (_blocked(source, cuts, key, pos, "inner").groupBy(*key, _BLOCK)
               .agg(F.max_by(value, rank).alias(value)))
    earlier = Window.partitionBy(*key).orderBy(_BLOCK).rowsBetween(*_before())
    carry = (summary.select(*key, _BLOCK, F.last(value, ignorenulls=True).over(earlier).alias(value))
             .where(F.col(value).isNotNull()))
    window = _in_block(key, order).rowsBetween(*_before())
    return (_with_carry(_blocked(df, cuts, key, pos), carry)
            .withColumn(out, F.last(value, ignorenulls=True).over(window))
            .where(F.col(_CARRY) == 0).drop(_BLOCK, _CARRY))


def running_total(df: DataFrame, key: Sequence[str], pos: str, weight: str, out: str,
                  ties: Sequence[str] = (), block: int = BLOCK,
                  carry_from: DataFrame | None = None) -> DataFrame:
    """Add ``out``: the sum of ``weight`` up to and including each row of its key."""
    key, order = list(key), [F.col(pos), *[F.col(t) for t in ties]]
    source = df if carry_from is None else carry_from
    cuts = cuts_of_hot_keys(source, key, pos, block)
    so_far = Window.unboundedPreceding, Window.currentRow
    if cuts is None:
        return df.withColumn(out, F.sum(weight).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(*so_far)))
    summary = _blocked(source, cuts, key, pos, "inner").groupBy(*key, _BLOCK).agg(F.sum(weight).alias(weight))
    earlier = Window.partitionBy(*key).orderBy(_BLOCK).rowsBetween(*_before())
    carry = (summary.select(*key, _BLOCK, F.sum(weight).over(earlier).alias(weight))
             .where(F.col(weight).isNotNull()))
    return (_with_carry(_blocked(df, cuts, key, pos), carry)
            .withColumn(out, F.sum(weight).over(_in_block(key, order).rowsBetween(*so_far)))
            .where(F.col(_CARRY) == 0).drop(_BLOCK, _CARRY))


def with_index(df: DataFrame, key: Sequence[str], pos: str, out: str = "index", start: int = 0,
               ties: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """Number the rows of each key by ``pos``, from ``start``."""
    one = "__one"
    numbered = running_total(df.withColumn(one, F.lit(1).cast("long")), key, pos, one, out, ties, block)
    return numbered.withColumn(out, F.col(out) + F.lit(start - 1)).drop(one)


def first_n(df: DataFrame, key: Sequence[str], order: Sequence[str], n: int | None,
            rank: str | None = None) -> DataFrame:
    """Keep the first ``n`` rows per key; all of them for None.

    The rank filter becomes a ``WindowGroupLimit`` below the shuffle, so a hot key sends at
    most ``n`` rows per map task.
    """
    name = rank or "__rank"
    window = Window.partitionBy(*key).orderBy(*order)
    if n is None and rank is None:
        return df
    kept = df.withColumn(name, F.row_number().over(window))
    kept = kept if n is None else kept.where(F.col(name) <= n)
    return kept if rank else kept.drop(name)


def changed_only(df: DataFrame, key: Sequence[str], pos: str, content: str,
                 ties: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """Keep a row iff its content differs from that of the row before it in its key.

    The first row of a key is always kept; A, B, A keeps all three.  Only the MD5 of the
    content is compared and carried between blocks.
    """
    digest, previous = "__digest", "__previous"
    hashed = df.withColumn(digest, F.md5(content))
    seen = asof_last(hashed, key, pos, digest, previous, ties, block)
    return (seen.where(F.coalesce(F.col(previous), F.lit("")) != F.col(digest))
            .drop(digest, previous))
