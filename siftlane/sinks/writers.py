"""Table and document sinks.

Tables go out as JSON lines or parquet, range partitioned by session and order: a session of
any size spreads over many files and small sessions share one.  Documents go out through
``documents.write_lines``, which shares files among sessions in the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlane.functions import text as X
from siftlane.operators.openapi import openapi_path_items
from siftlane.operators.report import json_entries, report_rows, sample_json
from siftlane.sinks.documents import write_lines

# Keeps files of a large session at a readable size.
RECORDS_PER_FILE = 2_000_000


def _write(df: DataFrame, path: str, fmt: str, order: list[str]) -> None:
    (df.repartitionByRange(*order).sortWithinPartitions(*order)
     .write.mode("overwrite").option("maxRecordsPerFile", RECORDS_PER_FILE).format(fmt).save(path))


def write_network_log(log: DataFrame, path: str, fmt: str = "json") -> None:
    _write(log, path, fmt, ["session_id", "seq"])


def write_dom(snapshots: DataFrame, path: str, fmt: str = "json") -> None:
    _write(snapshots, path, fmt, ["session_id", "page_id"])


def write_edges(edges: DataFrame, path: str, fmt: str = "json") -> None:
    """Edges as ``{source: {...}, consumer: {...}}`` in first-use order."""
    nested = edges.select(
        "session_id", "first_at",
        F.struct(F.col("source_endpoint").alias("origin_endpoint"), F.col("source_field").alias("field_path")).alias("source"),
        F.struct(F.col("consumer_endpoint").alias("endpoint"), F.col("consumer_field").alias("field_path")).alias("consumer"))
    _write(nested, path, fmt, ["session_id", "first_at"])


def endpoint_map_rows(catalog: DataFrame) -> DataFrame:
    """``(session_id, ord, key, value)`` with the endpoint's JSON text; headers are left out."""
    samples = (catalog.select("session_id", "method", "path", F.posexplode("sample_payloads").alias("i", "s"))
               .select("session_id", "method", "path", F.struct("i", sample_json(F.col("s")).alias("json")).alias("s"))
               .groupBy("session_id", "method", "path").agg(F.array_sort(F.collect_list("s")).alias("s"))
               .select("session_id", "method", "path", F.array_join(F.transform("s", lambda x: x["json"]), ", ").alias("s")))
    return (catalog.join(samples, ["session_id", "method", "path"], "left")
            .select("session_id", F.col("first_seq").alias("ord"), F.concat_ws(" ", "method", "path").alias("key"),
                    F.concat(F.lit('{"url": '), X.json_quote(F.col("url")), F.lit(', "response_statuses": ['),
                             F.array_join(F.col("response_statuses").cast("array<string>"), ", "),
                             F.lit('], "sample_payloads": ['), F.coalesce("s", F.lit("")), F.lit("]}")).alias("value")))


def write_endpoint_map(catalog: DataFrame, path: str) -> None:
    """One JSON object per session, keyed ``"METHOD path"`` in first-seen order."""
    write_lines(json_entries(endpoint_map_rows(catalog)), path)


def write_report(catalog: DataFrame, edges: DataFrame, meta: DataFrame, path: str) -> None:
    """Markdown report per session."""
    write_lines(report_rows(catalog, edges, meta), path)


def write_catalogs(catalogs: DataFrame, path: str, fmt: str = "json") -> None:
    """Dropdown catalogs, one row per page and key."""
    _write(catalogs, path, fmt, [c for c in ("session_id", "page_id", "key") if c in catalogs.columns])


def write_listeners(listeners: DataFrame, path: str, fmt: str = "json") -> None:
    _write(listeners, path, fmt, ["session_id", "selector"])


def write_traces(calls: DataFrame, mutations: DataFrame, path: str, fmt: str = "json") -> None:
    """Two tables below ``path``: ``function_calls`` and ``dom_mutations``."""
    _write(calls, f"{path}/function_calls", fmt, ["session_id", "ts"])
    _write(mutations, f"{path}/dom_mutations", fmt, ["session_id", "time"])


def openapi_lines(requests_fold: DataFrame, responses_fold: DataFrame, title: str, version: str = "1.0") -> DataFrame:
    """The API description of each session as document lines."""
    items = openapi_path_items(requests_fold, responses_fold)
    head = F.concat(F.lit('{"openapi": "3.0.0", "info": {"title": '), X.json_quote(F.lit(title)),
                    F.lit(', "version": '), X.json_quote(F.lit(version)), F.lit('}, "paths": {'))
    return json_entries(items, "first_seq", "path", "path_item", head=head, tail="}}")


def write_openapi(requests_fold: DataFrame, responses_fold: DataFrame, path: str, title: str,
                  version: str = "1.0") -> None:
    write_lines(openapi_lines(requests_fold, responses_fold, title, version), path)


def write_pages(pages: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Offline pages ``(session_id, step_name, html)`` as a table, not as loose files."""
    _write(pages, path, fmt, ["session_id", "step_name"])
