"""Requests and responses of a capture log, as the operators want them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlane.functions import predicates as P
from siftlane.functions.bodies import json_facts
from siftlane.functions.urls import endpoint_path, path_or_root, url_path
from siftlane.profiles import CaptureProfile, profile_of
from siftlane.session import ensure_checkpoint_dir

ENDPOINT = ["session_id", "method", "path"]


def _test(kind: str, profile: CaptureProfile) -> Column:
    """Cheap filters on plain columns: they reach the scan and precede any parsing."""
    test = (F.col("kind") == kind) & P.of_type(F.col("resource_type"), profile.resource_types)
    if profile.drop_preflight:
        test &= P.not_preflight(F.col("method"))
    if kind == "request" and profile.noise_fragments:
        test &= ~P.is_noise(F.col("url"), profile.noise_fragments)
    return test


def _parse_eligible(profile: CaptureProfile) -> Column:
    eligible = F.coalesce(F.col("body"), F.lit("")) != ""
    if profile.json_needs_content_type:
        eligible &= P.is_json_content_type(F.col("headers"))
    return eligible


_MARK = "siftlane.profile"


def _prepared(events: DataFrame, test: Column, p: CaptureProfile) -> DataFrame:
    """Filtered events with their endpoint key; the metadata of ``parse`` says for which profile."""
    rows = events.where(test).withColumns({
        "method": F.upper("method"), "path": endpoint_path(F.col("url"), p.empty_path), "parse": _parse_eligible(p)})
    return rows.withMetadata("parse", {_MARK: repr(p)})


def _is_prepared(events: DataFrame, p: CaptureProfile) -> bool:
    """Whether ``both_sides`` made these rows; rows prepared for another profile are refused."""
    made_for = events.schema["parse"].metadata.get(_MARK) if "parse" in events.columns else None
    if made_for not in (None, repr(p)):
        raise ValueError(f"these events were prepared for another profile than {p.name}")
    return made_for is not None


def requests(events: DataFrame, profile: str | CaptureProfile = "v2") -> DataFrame:
    """Logged requests with endpoint key; adds ``parse`` (body may be read as JSON)."""
    p = profile_of(profile)
    if _is_prepared(events, p):
        return events.where(F.col("kind") == "request")
    return _prepared(events, _test("request", p), p)


def responses(events: DataFrame, profile: str | CaptureProfile = "v2") -> DataFrame:
    """Responses with the endpoint key of their request; noise URLs stay in."""
    p = profile_of(profile)
    if _is_prepared(events, p):
        return events.where(F.col("kind") == "response")
    return _prepared(events, _test("response", p), p)


def both_sides(events: DataFrame, profile: str | CaptureProfile = "v2") -> DataFrame:
    """Requests and responses in one scan; ``kind`` tells them apart.

    The result can be passed wherever operators take ``events`` with the same profile; it is
    not prepared again then.
    """
    p = profile_of(profile)
    if _is_prepared(events, p):
        return events
    return _prepared(events, _test("request", p) | _test("response", p), p)


_FACTS = ["json_kind", "json_truthy"]


def _has_facts(df: DataFrame) -> bool:
    """Whether ``json_kind`` is the one that ``store_log`` made."""
    return "json_kind" in df.columns and _MARK in df.schema["json_kind"].metadata


def with_json_facts(df: DataFrame) -> DataFrame:
    """Add ``json_kind`` and ``json_truthy``; both null unless the body parses.

    Whatever reaches this is parsed, unless it comes from a stored log: filter and pick first.
    """
    if _has_facts(df):
        return df
    facts = df.withColumn("__facts", json_facts(F.when(F.col("parse"), F.col("body"))))
    return facts.withColumns({
        "json_kind": F.col("__facts.kind"),
        "json_truthy": F.coalesce(F.col("__facts.truthy"), F.lit(False))}).drop("__facts")


def fetch(picks: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """Wide columns for picked events.

    Operators choose events on narrow rows and bring bodies and headers in here.  The key
    ``(session_id, seq)`` is unique, so no key is hot; AQE broadcasts the picks if they turn
    out small, and then the wide side is scanned without a shuffle.  Rows of a stored log
    (``store_log``) are never shuffled, however many picks there are.
    """
    facts = _FACTS if "parse" in columns and _has_facts(rows) else []
    return picks.join(rows.select("session_id", "seq", *columns, *facts), ["session_id", "seq"])


def store_log(events: DataFrame, profile: str | CaptureProfile = "v2", buckets: int | None = None) -> DataFrame:
    """The prepared log as a table, bucketed and sorted by ``(session_id, seq)``, parsed facts included.

    Bodies are parsed and shuffled here, once; the result can be passed wherever operators take
    ``events`` with the same profile.  ``fetch`` is then a join by buckets: only the picks
    travel.  The key is unique, so no bucket is hot.  ``buckets`` (default: the number of shuffle
    partitions; with fewer, Spark may shuffle the log for parallelism) should give files of a few
    hundred MB.  The files lie in the shared folder, the table is known to the session's catalog.
    """
    p, spark = profile_of(profile), events.sparkSession
    rows = with_json_facts(both_sides(events, p))
    name = f"siftlane_log_{uuid.uuid4().hex}"
    number = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = ("session_id", "seq")
    (rows.repartition(number, *key).write.format("parquet").bucketBy(number, *key).sortBy(*key)
     .option("path", f"{ensure_checkpoint_dir(spark)}/siftlane/{name}").saveAsTable(name))
    return spark.table(name).withMetadata("parse", {_MARK: repr(p)}).withMetadata("json_kind", {_MARK: repr(p)})


def pair_responses(events: DataFrame) -> DataFrame:
    """Give responses the method, URL and type of their request.

    For sources whose responses only carry ``request_id``.  The key is unique per request, so
    the join has no hot key; responses that already carry a URL are left alone.  ``paired`` is
    false for responses whose request is not in the log: they stay, without method, URL and type.
    """
    described = ["method", "url", "resource_type"]
    asked = (events.where(F.col("kind") == "request")
             .select("session_id", "request_id", *[F.col(c).alias(f"__{c}") for c in described]))
    bare = events.where((F.col("kind") == "response") & F.col("url").isNull())
    asked = asked.withColumn("paired", F.lit(True))
    filled = (bare.drop(*described).join(asked, ["session_id", "request_id"], "left")
              .withColumnsRenamed({f"__{c}": c for c in described})
              .withColumn("paired", F.coalesce("paired", F.lit(False))))
    rest = events.where((F.col("kind") != "response") | F.col("url").isNotNull())
    return rest.withColumn("paired", F.lit(True)).unionByName(filled)


def network_log(events: DataFrame, profile: str | CaptureProfile = "v2", drop_blocked: bool = False,
                mask: bool = True) -> DataFrame:
    """One row per logged request.

    ``block_reason`` flags what the route filter would stop; flagged rows stay unless
    ``drop_blocked``.  ``body_is_json`` says whether the body counts as its JSON value
    (parsed and truthy) or as raw text.
    """
    p = profile_of(profile)
    logged = requests(events, p).withColumn(
        "block_reason", P.block_reason(F.col("url"), p.tracker_domains, p.static_extensions))
    if drop_blocked:
        logged = logged.where(F.col("block_reason").isNull())
    headers = P.mask_secrets(F.col("headers")) if mask else F.col("headers")
    return with_json_facts(logged).select(
        "session_id", "seq", "ts", "method", "url", path_or_root(url_path(F.col("url"))).alias("path"),
        headers.alias("headers"), "body",
        F.col("json_truthy").alias("body_is_json"), "block_reason")
