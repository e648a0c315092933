"""Offline pages: style sheets inlined, base address injected, steps named."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlane.functions.html import absolutise_css, inject_base
from siftlane.functions.text import content_hash, step_name
from siftlane.operators.ordered import BLOCK, changed_only, with_index
from siftlane.session import stored


def stylesheet_links(parsed: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Style sheet links with their place in the page: ``key, ord, href, start, size``."""
    sheets = F.filter("els", lambda e: (e["tag"] == "link") & e["target"].isNotNull() & ~e["inert"]
                      & F.coalesce(F.try_element_at(e["attrs"], F.lit("rel")) == "stylesheet", F.lit(False)))
    return parsed.select(*key, F.inline(F.transform(sheets, lambda e: F.struct(
        e["ord"].alias("ord"), e["target"].alias("href"), e["start"].alias("start"), e["size"].alias("size")))))


def linked_css(links: DataFrame, stylesheets: DataFrame) -> DataFrame:
    """Links with their style sheet's text, addresses in it made absolute; null if unknown.

    Nothing is broadcast by hint.  One sheet may serve a third of all links: the join is the
    last operator before the next exchange, so AQE may split that skewed side.
    """
    sheets = stylesheets.select(F.col("url").alias("href"), absolutise_css(F.col("css"), F.col("url")).alias("css"))
    return links.join(sheets, "href", "left")


def inline_css(pages: DataFrame, parsed: DataFrame, stylesheets: DataFrame,
               key: tuple[str, ...] = ("session_id", "page_id")) -> DataFrame:
    """Pages with each known style sheet link replaced by a ``<style>`` element.

    Links whose sheet is unknown stay as they are.  The grouping collects one page's links.
    """
    found = linked_css(stylesheet_links(parsed, key), stylesheets).where(F.col("css").isNotNull())
    cuts = (found.groupBy(*key)
            .agg(F.array_sort(F.collect_list(F.struct("start", "size", "css"))).alias("cuts")))
    # Piece i runs from the end of cut i-1 to the start of cut i, followed by its style element.
    pieces = F.transform("cuts", lambda c, i: F.concat(
        _between("html", F.when(i > 0, _end(F.col("cuts")[i - 1])).otherwise(F.lit(0)), c["start"]),
        F.lit("<style>"), c["css"], F.lit("</style>")))
    last = F.element_at("cuts", -1)
    rebuilt = F.concat(F.array_join(pieces, ""), _between("html", _end(last), F.length("html")))
    return (pages.join(cuts, list(key), "left")
            .withColumn("html", F.when(F.col("cuts").isNotNull(), rebuilt).otherwise(F.col("html")))
            .drop("cuts"))


def _end(cut):
    return cut["start"] + cut["size"]


def _between(text: str, start, end):
    return F.substring(F.col(text), start + 1, end - start)


def page_steps(states: DataFrame, block: int = BLOCK) -> DataFrame:
    """Number the kept page states of each session and name the steps.

    Numbers start at 1 and have no gaps; ``ts`` orders the states, ``page_id`` breaks ties.
    """
    placed = states.withColumn("__at", F.unix_micros("ts"))
    numbered = with_index(placed, ["session_id"], "__at", "step", 1, ["page_id"], block)
    return numbered.withColumn("step_name", step_name(F.col("step"), F.col("ts"))).drop("__at")


def changed_pages(states: DataFrame, block: int = BLOCK) -> DataFrame:
    """Steps of the page states that differ from the state before: ``session_id, page_id, step, step_name``.

    ``(session_id, page_id)`` is unique.  Pages are read and hashed once: the digests are stored,
    and only they go through windows; join the result with the states to get their pages.
    """
    narrow = stored(states.select("session_id", "page_id", "ts", content_hash(F.col("html")).alias("digest")), "digests")
    kept = changed_only(narrow.where(F.col("digest").isNotNull()), ["session_id"], "page_id", "digest", block=block)
    return page_steps(kept.drop("digest"), block).select("session_id", "page_id", "step", "step_name")


def offline_states(states: DataFrame) -> DataFrame:
    """Changed page states, named by step, with the base address injected; pages are fetched once."""
    return (changed_pages(states).join(states, ["session_id", "page_id"])
            .select("session_id", "step_name", inject_base(F.col("html"), F.col("url")).alias("html")))


def offline_pages(states: DataFrame) -> DataFrame:
    """``(session_id, step_name, html)`` ready to write, base address injected."""
    return page_steps(states).select("session_id", "step_name", inject_base(F.col("html"), F.col("url")).alias("html"))
