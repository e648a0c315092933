"""Source divergence audit: how far the sources of a language differ in the terms they use, by three-dimensional cube partitioning.

Terms are counted by language and source. Sources of a language are dealt to group blocks and its kept terms to term blocks. A task owns one cell
(group block, group block, term block): it receives the two slices of counts that meet there, computes the partial divergences of their pairs, and the partials of
a pair are added up along the term axis. A slice is replicated to as many cells as its language has group blocks; no task holds more than two slices, whatever
the number of sources and terms. All arithmetic is on integers.

Terms that neither of two slices holds add the same amount to a pair each; they are not sent, but added at the end by their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlane.llm.terms import term_parts
from siftlane.llm.worker import release
from siftlane.session import stored

#: Sources of a group block and kept terms of a term block, about (blocks are dealt by hash).
GROUPS_PER_BLOCK, TERMS_PER_BLOCK = 32, 1 << 13
#: Bytes of texts that are counted at once; distinct (group, term) that a task gathers before it sends them on.
BYTES_AT_ONCE, MOST_ENTRIES = 8 << 20, 1 << 19
#: A share is 1 + floor(SCALE * (count + SMOOTH) / (sum + SMOOTH * terms)).
SCALE, SMOOTH = 1_000_000_000, 2
_GROUP_SHIFT = 40
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])


class _Tally:
    """Counts of one task by (group, term): occurrences and documents. The empty term counts a group's documents."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[bytes, int] = {b"": 0}
        self.groups: dict[tuple[str, str], int] = {}
        self.keys, self.n, self.docs = (np.zeros(0, np.int64) for _ in range(3))
        self.waiting: list[np.ndarray] = []
        self.of: list[int] = []
        self.size = 0

    def add(self, lang: str, source: str, text: bytes | None) -> None:
        numbers = self.numbers
        found = [np.zeros(1, np.int64)]
        for terms in term_parts(text):
            for term in set(terms).difference(numbers):
                numbers[term] = len(numbers)
            found.append(np.fromiter(map(numbers.__getitem__, terms), np.int64, len(terms)))
        self.waiting.append(np.concatenate(found))
        self.of.append(self.groups.setdefault((lang, source), len(self.groups)))
        self.size += len(text or b"")

    def settle(self) -> None:
        """Add up what waits: first by document, then by group."""
        if not self.waiting:
            return
        lens = [len(x) for x in self.waiting]
        one = np.repeat(np.arange(len(lens)) << _GROUP_SHIFT, lens) | np.concatenate(self.waiting)
        one, times = np.unique(one, return_counts=True)
        number = one & ((1 << _GROUP_SHIFT) - 1)
        keys = np.r_[self.keys, (np.array(self.of)[one >> _GROUP_SHIFT] << _GROUP_SHIFT) | number]
        n, docs = np.r_[self.n, times], np.r_[self.docs, np.ones(len(one), np.int64)]
        order = np.argsort(keys, kind="stable")
        begin = np.flatnonzero(np.r_[True, np.diff(keys[order]) != 0])
        self.keys, self.n, self.docs = keys[order][begin], np.add.reduceat(n[order], begin), np.add.reduceat(docs[order], begin)
        self.waiting, self.of, self.size = [], [], 0

    def rows(self) -> Iterator[pa.RecordBatch]:
        groups, terms = list(self.groups), list(self.numbers)
        for i in range(0, len(self.keys), 1 << 16):
            keys = self.keys[i:i + (1 << 16)]
            of = [groups[g] for g in (keys >> _GROUP_SHIFT).tolist()]
            yield pa.RecordBatch.from_arrays([
                pa.array([g[0] for g in of], pa.string()), pa.array([g[1] for g in of], pa.string()),
                pa.array([terms[t] for t in (keys & ((1 << _GROUP_SHIFT) - 1)).tolist()], pa.binary()),
                pa.array(self.n[i:i + (1 << 16)]), pa.array(self.docs[i:i + (1 << 16)])], schema=_COUNTS)


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tally = _Tally()
    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            tally.add(lang, source, text.as_py())
            if tally.size >= BYTES_AT_ONCE:
                tally.settle()
                if len(tally.keys) >= MOST_ENTRIES or len(tally.numbers) >= MOST_ENTRIES:
                    yield from tally.rows()
                    tally.clear()
                    release()
    tally.settle()
    yield from tally.rows()
    release()


def term_tables(docs: DataFrame, min_docs: int) -> DataFrame:
    """Kept terms by group: lang, source, term, n (occurrences), total (in the language), first (true in one row of each kept term).

    One row with the empty term stands for each occurring group, so that groups without terms are not lost.
    """
    def read(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)

    rows = docs.select(read("lang"), read("source"), F.col("text").cast("string").cast("binary").alias("text"))
    sent = rows.mapInArrow(_tallied, "lang string, source string, term binary, n long, docs long").withColumn("term", F.col("term").cast("string"))
    counts = sent.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    counts = counts.select("lang", "source", "term", "n", F.sum("n").over(of_term).alias("total"), F.sum("docs").over(of_term).alias("docs"),
                           (F.row_number().over(of_term.orderBy("source")) == 1).alias("first"))
    return stored(counts.where((F.col("docs") >= min_docs) | (F.col("term") == "")).drop("docs"), "terms")


def _share(count: str, total: str) -> Column:
    return F.expr(f"1 + (cast({count} + {SMOOTH} as decimal(20,0)) * cast({SCALE} as decimal(10,0))) div cast({total} + {SMOOTH} * terms as decimal(20,0))")


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """The shares of counts (any shape) against denominators of a shape that broadcasts; exact also where SCALE * count leaves 64 bits."""
    if counts.size and int(counts.max()) > (1 << 62) // SCALE:
        counts, totals = counts.astype(object), totals.astype(object)
    return (1 + (SCALE * (counts + SMOOTH)) // totals).astype(np.int64)


def _cell(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Partial divergences of the pairs of a cell: rows without a term name the sources of the blocks, the others are the slices."""
    lang, i, j = key[0], key[1], key[2]
    member = pdf["term"].isna().to_numpy()
    sources = pdf.loc[member].sort_values(["block", "source"])
    slices = pdf.loc[~member]
    place = {s: at for at, s in enumerate(sources["source"])}
    codes, names = pd.factorize(slices["term"])
    counts = np.zeros((len(sources), len(names) + 1), np.int64)  # the last column is a term that nobody has
    counts[slices["source"].map(place).to_numpy(np.int64), codes] = slices["n"].to_numpy(np.int64)
    terms = int(sources["terms"].iloc[0])
    p = shares(counts, np.maximum(1, sources["n"].to_numpy(np.int64) + SMOOTH * terms)[:, None])
    block, name = sources["block"].to_numpy(), sources["source"].to_numpy(object)
    out: dict[str, list] = {"a": [], "b": [], "part": [], "none": []}
    for a in np.flatnonzero(block == i):
        others = np.flatnonzero(block == j)
        others = others[others > a] if i == j else others
        f = (p[a] - p[others]) ** 2 // (p[a] + p[others])
        for column, found in zip(out.values(), ([name[a]] * len(others), name[others], f[:, :-1].sum(axis=1), f[:, -1] if terms else [0] * len(others))):
            column.extend(found)
    n = len(out["part"])
    names_of = {c: np.array(v, object) for c, v in (("lang", [lang] * n), ("a", out["a"]), ("b", out["b"]))}
    return pd.DataFrame({**names_of, "part": np.array(out["part"], np.int64), "none": np.array(out["none"], np.int64), "seen": np.full(n, len(names)), "terms": np.full(n, terms)})


def _pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    cells = F.expr("explode(transform(sequence(0L, group_blocks - 1), x -> struct(least(x, block) as i, greatest(x, block) as j)))").alias("c")
    members = (groups.withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("term_blocks") - 1)))
               .select("lang", "t", "block", "source", F.lit(None).cast("string").alias("term"), F.col("sum_n").alias("n"), "terms", cells))
    slices = (kept.where("term <> ''").select("lang", "source", "term", "n").join(groups.drop("sum_n", "lang_n"), ["lang", "source"])
              .select("lang", F.pmod(F.xxhash64("term"), F.col("term_blocks")).alias("t"), "block", "source", "term", "n", "terms", cells))
    rows = members.unionByName(slices).select("lang", F.col("c.i").alias("i"), F.col("c.j").alias("j"), "t", "block", "source", "term", "n", "terms")
    partial = rows.groupBy("lang", "i", "j", "t").applyInPandas(_cell, "lang string, a string, b string, part long, none long, seen long, terms long")
    value = F.sum("part") + (F.max("terms") - F.sum("seen")) * F.max("none")
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return partial.groupBy("lang", "a", "b").agg(value.alias("value")).select("lang", both.alias("p"), "value").select("lang", "p.source", "p.item", "value")


def source_divergence(docs: DataFrame, min_docs: int = 10, top_terms: int = 10) -> DataFrame:
    """Compare every source of a language with its others, and name the terms in which it exceeds its language.

    Reads lang, source and text; null is ''. Terms are [^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+ with A-Z lower-cased; a language keeps the terms of ``min_docs`` of its documents
    or more (every row counts, also if it repeats another). Each occurring (lang, source) and each language gives every kept term the share
    p = 1 + floor(10^9 * (n + 2) / (N + 2V)); two shares differ by floor((p - q)^2 / (p + q)). Returns lang, source, part, item, value, rank:

    * part ``pair``: item is each other source of the language, value the difference summed over all V kept terms (0 if there are none), all ranks;
    * part ``term``: item is a kept term that the source has, with a share above its language's, value their difference, ranks to ``top_terms``.

    Ranks go by value descending, then item ascending in UTF-8. Texts are taken whole; a very long text takes eight bytes of numbers per term. A language with one
    source has no pairs. Other columns are ignored; an empty table gives no rows. The pairs returned are quadratic in the sources of a language, as is the result.
    """
    kept = term_tables(docs, min_docs)
    real = F.col("term") != ""
    langs = kept.groupBy("lang").agg(F.sum((real & F.col("first")).cast("long")).alias("terms"), F.sum(F.when(real, F.col("n")).otherwise(0)).alias("lang_n"),
                                     F.sum((~real).cast("long")).alias("sources"))
    langs = langs.select("lang", "terms", "lang_n", F.ceil(F.col("sources") / GROUPS_PER_BLOCK).alias("group_blocks"),
                         F.greatest(F.lit(1), F.ceil(F.col("terms") / TERMS_PER_BLOCK)).cast("long").alias("term_blocks"))
    groups = kept.groupBy("lang", "source").agg(F.sum(F.when(real, F.col("n")).otherwise(0)).alias("sum_n")).join(langs, "lang")
    groups = stored(groups.withColumn("block", F.pmod(F.xxhash64("lang", "source"), F.col("group_blocks"))), "groups")
    told = kept.where(real).join(groups.select("lang", "source", "sum_n", "terms", "lang_n"), ["lang", "source"])
    told = told.withColumns({"p": _share("n", "sum_n"), "q": _share("total", "lang_n")}).where("p > q")
    terms = told.select("lang", "source", F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    def ranked(rows: DataFrame, part: str) -> DataFrame:
        return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(by_value).alias("rank"))

    return ranked(_pairs(kept, groups), "pair").unionByName(ranked(terms, "term").where(F.col("rank") <= top_terms))
