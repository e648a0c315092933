"""Report and document lines.

Documents of a session are tables of lines, ``(session_id, section, ord, line)``: sorting
and writing them is distributed, so a session of any size is a file set and never one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlane.functions import text as X
from siftlane.functions.bodies import canonical_json
from siftlane.operators.lineage import edge_lines

#: The headings of the report, by which its readers find their way.
TITLE, TARGET, GENERATED, ENDPOINTS = "# Investigation Report", "**Target URL:** `", "**Generated:** `", "## Discovered Business Endpoints"
FULL_URL, STATUSES, SAMPLE = "- **Full URL:** `", "- **Observed HTTP Statuses:** `", "- **Sample Request Schema:**\n```json\n"
CHART = "## Field Dependency Flow (Data Chains)\n```mermaid\ngraph TD"


def json_entries(entries: DataFrame, ord_: str = "ord", key: str | None = "key", value: str = "value",
                 head: str | Column = "{", tail: str = "}", section: int = 1) -> DataFrame:
    """Lines of one JSON object (or array, without ``key``) per session.

    ``value`` holds JSON text.  Every entry but the session's last ends in a comma.
    """
    item = F.col(value) if key is None else F.concat(X.json_quote(F.col(key)), F.lit(": "), F.col(value))
    tie = key or value
    # A narrow aggregate finds each session's last entry; it joins back on the session.
    last = entries.groupBy("session_id").agg(F.max(F.struct(ord_, tie)).alias("__last"))
    body = (entries.join(last, "session_id")
            .select("session_id", F.lit(section).alias("section"), F.col(ord_).cast("decimal(38,0)").alias("ord"),
                    F.concat(item, F.when(F.struct(ord_, tie) == F.col("__last"), F.lit(""))
                             .otherwise(F.lit(","))).alias("line")))
    ends = last.select("session_id", F.explode(F.array(
        F.struct(F.lit(section - 1).alias("section"), (F.lit(head) if isinstance(head, str) else head).alias("line")),
        F.struct(F.lit(section + 1).alias("section"), F.lit(tail).alias("line")))).alias("e"))
    return body.unionByName(ends.select(
        "session_id", "e.section", F.lit(0).cast("decimal(38,0)").alias("ord"), "e.line"))


def sample_json(sample: Column, indent: int | None = None) -> Column:
    """JSON text of a sample payload: JSON kinds in canonical form, texts quoted."""
    return F.when(sample["kind"] == "text", X.json_quote(sample["body"])).otherwise(
        canonical_json(F.when(sample["kind"] != "text", sample["body"]), indent))


def report_rows(catalog: DataFrame, edges: DataFrame, meta: DataFrame) -> DataFrame:
    """The Markdown report as rows ``(session_id, section, ord, line)``.

    ``meta`` has one row per session: ``session_id, target, generated`` (text).  Section 0 is
    the header, 1 the endpoints, 2 to 4 the edge chart, which is absent without edges.
    """
    header = meta.select("session_id", F.concat_ws(
        "\n", F.lit(TITLE),
        F.concat(F.lit(TARGET), F.col("target"), F.lit("`  ")),
        F.concat(F.lit(GENERATED), F.col("generated"), F.lit("`  ")),
        F.lit(""), F.lit(ENDPOINTS), F.lit("")).alias("line"))
    sample = F.try_element_at("sample_payloads", F.lit(1))
    shown = catalog.withColumn("__sample", F.when(sample.isNotNull(), sample_json(sample, indent=2)))
    endpoint_block = F.concat_ws(
        "\n",
        F.concat(F.lit("### `"), F.col("method"), F.lit("` `"), F.col("path"), F.lit("`")),
        F.concat(F.lit(FULL_URL), F.col("url"), F.lit("`")),
        F.concat(F.lit(STATUSES), X.status_text(F.col("response_statuses")), F.lit("`")),
        F.when(F.col("__sample").isNotNull(), F.concat(
            F.lit(SAMPLE), F.col("__sample"), F.lit("\n```"))),
        F.lit(""))
    chart = edge_lines(edges)
    charted = chart.select("session_id").distinct()
    zero = F.lit(0).cast("long").alias("ord")
    return (header.select("session_id", F.lit(0).alias("section"), zero, "line")
            .unionByName(shown.select("session_id", F.lit(1).alias("section"), F.col("first_seq").alias("ord"),
                                      endpoint_block.alias("line")))
            .unionByName(charted.select("session_id", F.lit(2).alias("section"), zero, F.lit(CHART).alias("line")))
            .unionByName(chart.select("session_id", F.lit(3).alias("section"), "ord", "line"))
            .unionByName(charted.select("session_id", F.lit(4).alias("section"), zero, F.lit("```\n").alias("line"))))
