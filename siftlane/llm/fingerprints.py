"""Document fingerprints by SimHash, in DataFrame functions only.

Terms are pairs of adjacent words (and the last word alone), each counted as often as it occurs. A term's 64-bit hash votes for a one or a zero at every bit; the signed
sums give the bits. Votes are added two bits to a number (bit i in the lower half, bit i + 32 in the upper half), so 32 sums serve 64 bits.

``within_radius`` finds fingerprints near each other with permuted block tables: the bits are cut into radius + 2 blocks, and for every choice of two blocks a
table is keyed by them. Two fingerprints that differ in at most ``radius`` bits agree on two blocks at least.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlane.session import stored

BITS, LANE = 64, 0x0000000100000001
#: Documents in a block of neighbouring doc_ids, on average.
DOCS_PER_BLOCK = 1024
#: Blocks that quantiles cut at most.
RANGES = 4096


def term_hashes(words: Column) -> Column:
    """Hashes of the pairs of adjacent words; the last word stands alone."""
    return F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.xxhash64(a, b))


def simhash(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One fingerprint (``fp``, long) for the text of each key. Keys whose text has no word get no row."""
    words = rows.select(*keys, F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "").alias("words"))
    terms = words.select(*keys, F.explode(term_hashes(F.col("words"))).alias("h"))
    half = BITS // 2
    sums = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(LANE))).alias(f"s{i}") for i in range(half)]
    votes = terms.groupBy(*keys).agg(F.count("*").alias("n"), *sums)
    low = [F.when(F.col(f"s{i}").bitwiseAND(F.lit(0xFFFFFFFF)) * 2 > F.col("n"), F.lit(1 << i)).otherwise(F.lit(0).cast("long")) for i in range(half)]
    high = [F.when(F.shiftrightunsigned(f"s{i}", 32) * 2 > F.col("n"), F.shiftleft(F.lit(1).cast("long"), i + half)).otherwise(F.lit(0).cast("long"))
            for i in range(half)]
    return votes.select(*keys, reduce(lambda a, b: a.bitwiseOR(b), low + high).alias("fp"))


def likeness(a: Column | str, b: Column | str) -> Column:
    """The share of equal bits."""
    return 1 - F.bit_count(F.col(a).bitwiseXOR(F.col(b)) if isinstance(a, str) else a.bitwiseXOR(b)) / F.lit(float(BITS))


def _cuts_at_or_below(cuts: list[int], at: Column) -> Column:
    """How many of the ascending ``cuts`` are not above ``at``: first by every 64th of them, then by the 64 that follow."""
    if not cuts:
        return F.lit(0).cast("long")
    parts = [cuts[i:i + 64] for i in range(0, len(cuts) + 1, 64)]  # the last one may be empty
    many = F.array(*[F.array(*[F.lit(c).cast("long") for c in part]).cast("array<long>") for part in parts])
    above = F.size(F.filter(F.array(*[F.lit(part[-1]).cast("long") for part in parts if len(part) == 64]).cast("array<long>"), lambda c: c <= at))
    return (above * 64 + F.size(F.filter(F.get(many, above), lambda c: c <= at))).cast("long")


def in_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, text and the number of a block of neighbouring ids. Blocks ascend with the ids; rows without an id get blocks below zero.

    Blocks are cut at quantiles of the ids, whatever gaps these have. Beyond ``RANGES`` blocks each range between two quantiles is cut into parts of equal width, so that
    uneven ids put about 1 / RANGES of the rows into one block at most. Rows of one id stay together.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    quantiles = F.percentile_approx("doc_id", [i / RANGES for i in range(1, RANGES)], 4 * RANGES)
    low, high, n, found = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count("doc_id"), quantiles).first()
    wanted = max(1, -(-n // DOCS_PER_BLOCK))
    ranges, parts = min(RANGES, wanted), -(-wanted // RANGES)
    cuts = sorted({found[i * RANGES // ranges - 1] for i in range(1, ranges)}) if n else []
    number = F.when(F.col("doc_id").isNotNull(), _cuts_at_or_below(cuts, F.col("doc_id")))
    if parts > 1:
        # in doubles, which cannot overflow and keep the order
        edges = [float(low), *map(float, cuts), float(high)]
        begin, width = (F.get(F.array(*map(F.lit, values)), number.cast("int")) for values in (edges[:-1], [max(1.0, (b - a) / parts) for a, b in zip(edges, edges[1:])]))
        part = F.floor((F.col("doc_id").cast("double") - begin) / width)
        number = number * parts + F.greatest(F.lit(0), F.least(part, F.lit(parts - 1)))
    # never null, also to the optimizer: branches that join on it then share one shuffle of the texts
    return docs.withColumn("block", F.coalesce(number.cast("long"), -1 - F.pmod(F.xxhash64("text"), F.lit(1024)), F.lit(-1)))


def _previous(blocks: DataFrame) -> DataFrame:
    """For each block in use the one before it (before the first: the last). One row per about a thousand documents."""
    named = blocks.where("block >= 0").select("block").distinct()
    order = Window.orderBy("block")
    last = F.max("block").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return named.select("block", F.coalesce(F.lag("block").over(order), last).alias("before"))


def with_next(rows: DataFrame, previous: DataFrame, order: list, what: str) -> DataFrame:
    """Add ``next``: ``what`` of the following row in the order of blocks and, inside them, of ``order``; after the last row comes the first."""
    inside = Window.partitionBy("block").orderBy(*order)
    own = rows.withColumns({"rn": F.row_number().over(inside), "next": F.lead(what).over(inside)})
    first = own.where("rn = 1").select("block", F.col(what).alias("first")).join(previous, "block").select(F.col("before").alias("block"), "first")
    return own.join(first, "block", "left").withColumn("next", F.when(F.col("block") >= 0, F.coalesce("next", "first"))).drop("first")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint every text and its edited text, whose last floor(n_chars / 2) code points are replaced by the first as many (or all) of the next document.

    Next is by ascending doc_id, rows that repeat a doc_id by text; after the last document comes the first. Returns doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint (16 hex digits), near_edited, near_next (share of equal bits). A null or empty text has fingerprint zero. A row without
    a doc_id has no next document and is none: its edited text is its first half, near_next is null. Other columns are ignored; an empty table gives no rows.
    """
    base = in_blocks(docs)
    previous = stored(_previous(base), "blocks")
    rows = with_next(base, previous, ["doc_id", "text"], "text")
    n = F.length("text")
    cut = (n / 2).cast("int")
    edited = F.concat(F.left("text", n - cut), F.left(F.coalesce("next", F.lit("")), cut))
    facts = rows.select("block", "rn", "doc_id", n.cast("long").alias("n_chars"), F.sha2(edited, 256).alias("edited_sha256"))
    both = rows.select("block", "rn", F.inline(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("text")),
                                                       F.struct(F.lit(1).alias("kind"), edited.alias("text")))))
    prints = simhash(both, ["block", "rn", "kind"]).groupBy("block", "rn").agg(
        F.max(F.when(F.col("kind") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("kind") == 1, F.col("fp"))).alias("edited_fp"))
    found = facts.join(prints, ["block", "rn"], "left").fillna(0, ["fp", "edited_fp"])
    found = stored(found.withColumnRenamed("rn", "place"), "fingerprints")
    found = with_next(found, previous, ["place"], "fp")
    hexed = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return found.select("doc_id", "n_chars", "edited_sha256", hexed("fp").alias("fingerprint"), hexed("edited_fp").alias("edited_fingerprint"),
                        likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next").alias("near_next"))


def within_radius(prints: DataFrame, radius: int = 3) -> DataFrame:
    """All pairs of distinct fingerprints (``fp``, long) that differ in 1 to ``radius`` bits, each once: a, b, bits. Nulls take no part."""
    if not 0 <= radius <= 14:
        raise ValueError("a radius of 0 to 14 bits")
    cuts = [round(i * BITS / (radius + 2)) for i in range(radius + 3)]

    def block(i: int) -> Column:
        mask = (1 << (cuts[i + 1] - cuts[i])) - 1
        return F.shiftrightunsigned("fp", cuts[i]).bitwiseAND(F.lit(mask).cast("long"))

    tables = [F.struct(F.lit(t).alias("t"), block(i).alias("x"), block(j).alias("y")) for t, (i, j) in enumerate(combinations(range(radius + 2), 2))]
    keyed = prints.where("fp is not null").select("fp").distinct().select("fp", F.inline(F.array(*tables)))
    other = keyed.withColumnRenamed("fp", "other")
    pairs = keyed.join(other, ["t", "x", "y"]).where("fp < other").withColumn("bits", F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))))
    return pairs.where(F.col("bits") <= radius).select(F.col("fp").alias("a"), F.col("other").alias("b"), "bits").distinct()
