"""Capture data derived row by row from the driver tables.

The tables hold no traffic, forms or style sheets, so the queries read captures that Spark
derives from them.  Every derivation is a list of scalar SQL expressions over one table, valid
in Spark and in DuckDB alike: the SQL counterparts start from the same expressions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlane.session import ensure_checkpoint_dir, store
from siftlane.sources.readers import read_capture, spread


def _s(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


# events -> requests (even ids) and responses (odd ids), one session per user.
EVENT_CAPTURE = {
    "session_id": f"concat('user-', {_s('user_id')})",
    "seq": "event_id",
    "request_id": f"concat('r', {_s('event_id')})",
    "kind": "CASE WHEN event_id % 2 = 1 THEN 'response' ELSE 'request' END",
    "resource_type": "CASE WHEN event_id % 10 IN (8, 9) THEN 'image' WHEN event_id % 10 IN (6, 7) THEN 'document' "
                     "WHEN event_id % 10 IN (4, 5) THEN 'fetch' ELSE 'xhr' END",
    "method": "CASE WHEN event_type = 'view' THEN 'get' WHEN event_type = 'error' AND event_id % 7 < 2 "
              "THEN 'OPTIONS' WHEN event_type = 'purchase' THEN 'PUT' ELSE 'POST' END",
    "url": "CASE WHEN event_id % 17 = 0 THEN 'https://api.example.com' "
           "WHEN event_id % 11 = 0 THEN concat('https://lib.usejimo.com/v1/', event_type) "
           "WHEN event_id % 11 = 1 THEN concat('https://www.Google-Analytics.com/v1/', event_type, '?x') "
           "WHEN event_id % 13 = 0 THEN concat('https://cdn.example.com/v1/', event_type, '.PNG') "
           "WHEN event_id % 13 = 1 THEN concat('https://cdn.example.com/v1/', event_type, '.mp4#t') "
           f"ELSE concat('https://u@API.example.com:8443/v1/', event_type, ';v=1?e=', {_s('event_id')}) END",
    "content_type": "CASE WHEN event_id % 9 = 0 THEN 'text/plain' WHEN event_id % 9 < 3 "
                    "THEN 'application/JSON; charset=utf-8' ELSE 'application/json' END",
    "body": "CASE event_id % 16 WHEN 0 THEN NULL WHEN 2 THEN '' "
            f"WHEN 4 THEN concat('a=1&token=tok-', {_s('event_id % 23')}) WHEN 6 THEN '{{}}' WHEN 8 THEN props "
            f"WHEN 10 THEN concat('{{\"ref\":\"tok-', {_s('event_id % 23')}, '\",\"n\":[', {_s('event_id')}, ',7]}}') "
            f"WHEN 12 THEN concat('[{{\"ref\":\"tok-', {_s('event_id % 23')}, '\"}},{{\"who\":', {_s('user_id + 100')}, '}}]') "
            "WHEN 14 THEN '{\"a\":1} x' ELSE CASE event_id % 6 "
            f"WHEN 1 THEN concat('{{\"id\":\"tok-', {_s('(event_id * 7) % 23')}, '\",\"ok\":true,\"rows\":[{{\"k\":\"', "
            f"{_s('user_id + 100')}, '\"}},', {_s('event_id % 1000')}, ',1.5]}}') "
            "WHEN 3 THEN repeat('long text é ', CAST(1 + event_id % 60 AS INT)) "
            f"ELSE concat('\"tok-', {_s('event_id % 29')}, '\"') END END",
    "status": "CASE WHEN event_id % 2 = 0 THEN NULL WHEN event_type = 'error' THEN 500 "
              "WHEN event_id % 4 = 1 THEN 201 ELSE 200 END",
}

# customer -> one page with a form and a loose select per customer.
FORM_PAGES = {
    "page_id": "c_custkey",
    "url": f"concat('https://shop.example.com/c/', {_s('c_custkey')}, '/edit?tab=1')",
    "html": f"concat('<html><head><link rel=stylesheet href=\"/css/n', {_s('c_nationkey')}, '.css\"></head><body>"
            f"<form id=f', {_s('c_custkey')}, ' name=main method=', CASE WHEN c_custkey % 3 = 0 THEN 'post' WHEN c_custkey % 3 = 1 "
            "THEN 'GET' ELSE 'put' END, CASE WHEN c_custkey % 2 = 0 THEN ' action=\"../save\"' ELSE '' END, '>"
            "<input name=who value=\"', c_name, '\" required><input type=checkbox name=vip', "
            "CASE WHEN c_acctbal > 5000 THEN ' checked' ELSE '' END, '>"
            "<select id=seg name=s><option value=\"\">none<option', CASE WHEN c_mktsegment = 'MACHINERY' THEN ' selected' ELSE '' END, "
            "'> MACHINERY </option><option value=x>', c_mktsegment, '</option></select>"
            "<textarea name=note>', c_mktsegment, ' &amp; more</textarea><button>Go</button></form>"
            "<div role=listbox class=\"app dropdown\" data-seg-name=\"', c_mktsegment, '\"> Pick <b>', c_name, '</b> </div>"
            f"<input name=q placeholder=find><select name=k', {_s('c_custkey % 2')}, '><option>A</option></select>"
            f"<select name=k0><option value=', {_s('c_custkey')}, '>Z</option></select><button>no</button></body></html>')",
}

# nation -> one style sheet per nation; that of nation 7 lies at an address that no page links.
STYLESHEETS = {
    "url": f"concat('https://shop.example.com/css/', CASE WHEN n_nationkey = 7 THEN 'old' ELSE 'n' END, {_s('n_nationkey')}, '.css')",
    "css": "concat('body{background:url(\"../img/', n_name, '.png\")} i{src:url(data:x)}')",
}

# events -> mutations, calls and listeners.
MUTATIONS = {
    "session_id": f"concat('user-', {_s('user_id')})",
    "time": "1700000000000 + event_id * 37",
    "type": "CASE WHEN event_id % 2 = 0 THEN 'childList' ELSE 'attributes' END",
    "id": "CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN '' END",
    "class_name": f"CASE WHEN event_id % 4 < 2 THEN concat('c', {_s('event_id % 5')}) ELSE '' END",
    "tag": "'DIV'",
    "added_nodes": "CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 7 AS INT) END",
}
CALLS = {
    "session_id": f"concat('user-', {_s('user_id')})",
    "function": "event_type",
    "arguments": f"concat('[', {_s('event_id')}, ']')",
    "returned": "props",
    "timestamp": "1700000000000 + event_id * 41",
}
LISTENERS = {
    "session_id": f"concat('user-', {_s('user_id')})",
    "ord": "event_id",
    "el_id": f"CASE WHEN event_id % 3 = 0 THEN concat('b', {_s('event_id % 9')}) ELSE '' END",
    "class_name": "CASE WHEN event_id % 3 = 1 THEN event_type ELSE NULL END",
    "tag": "'INPUT'",
    "events": f"concat(event_type, ',', {_s('event_id')})",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_select(exprs: dict[str, str]) -> list[str]:
    return [f"{expr} AS {name}" for name, expr in exprs.items()]


def derive(df: DataFrame, exprs: dict[str, str]) -> DataFrame:
    return df.selectExpr(*as_select(exprs))


def capture_of(events: DataFrame) -> DataFrame:
    """Capture log of the ``events`` table."""
    flat = derive(events, EVENT_CAPTURE)
    headers = F.create_map(
        F.lit("content-type"), F.col("content_type"), F.lit(":path"), F.lit("/"), F.lit("Host"), F.lit("api"),
        F.lit("content-length"), F.lit("9"), F.lit("authorization"), F.concat(F.lit("Bearer "), "session_id"))
    return flat.select("session_id", "seq", "request_id", "kind", F.lit(None).cast("timestamp").alias("ts"),
                       "resource_type", "method", "url", headers.alias("headers"), "body", "status")


_CAPTURES: dict[tuple[str, str], str] = {}


def event_capture_path(spark: SparkSession, sf_dir: str) -> str:
    """Where the capture log of ``events`` is stored; written on first use in a session.

    A capture log is a stored table: without the copy every filter of a query would run on
    the derivation's expressions instead of on columns.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CAPTURES:
        _CAPTURES[key] = store(capture_of(spread(table(spark, sf_dir, "events"))), "capture")
    return _CAPTURES[key]


def event_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_capture(spark, event_capture_path(spark, sf_dir), "parquet")


def form_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spread(table(spark, sf_dir, "customer")), FORM_PAGES)


def stylesheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(table(spark, sf_dir, "nation"), STYLESHEETS)


def fed(parts: list[DataFrame], name: str, files: int = 2) -> str:
    """A folder of Parquet files that a stream reads part by part, ``files`` of them in each."""
    place = f"{ensure_checkpoint_dir(parts[0].sparkSession)}/siftlane/{name}-{uuid.uuid4().hex}"
    for part in parts:
        part.repartition(files).write.mode("append").parquet(place)
    return place


def chat_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as traffic: assistants answer, everyone else asks; bodies are lists of all words, of which a profile with ``max_items`` reads the first."""
    return spread(table(spark, sf_dir, "conversations")).select(
        F.concat(F.lit("c"), "conv_id").alias("session_id"), F.col("turn").alias("seq"),
        F.concat(F.lit("r"), "turn").alias("request_id"),
        F.when(F.col("role") == "assistant", "response").otherwise("request").alias("kind"),
        F.lit(None).cast("timestamp").alias("ts"), F.lit("xhr").alias("resource_type"), F.lit("POST").alias("method"),
        F.concat(F.lit("https://chat.example.com/"), "role").alias("url"),
        F.create_map(F.lit("content-type"), F.lit("application/json")).alias("headers"),
        F.to_json(F.split("text", " ")).alias("body"), F.lit(200).alias("status"))
