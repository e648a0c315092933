"""Endpoint catalog: one row per (session, method, path), host and query ignored.

Everything is chosen on narrow rows first (keys, positions, flags) and wide columns are
fetched once for the events chosen.  Choosing is reduced on the map side before its shuffle,
so an endpoint that owns a third of the traffic sends a handful of rows per task: partial
``min`` and ``max`` on BIGINT buffers (hash aggregation), ``WindowGroupLimit`` for the first-N
samples.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlane.functions import predicates as P
from siftlane.functions import text as X
from siftlane.operators.capture import ENDPOINT, both_sides, fetch, requests, responses, with_json_facts
from siftlane.operators.ordered import first_n
from siftlane.profiles import CaptureProfile, profile_of

# Splits the rows of one endpoint when they meet the endpoint table in a shuffled join.
SALTS = 32


def first_seen(events: DataFrame, profile: str | CaptureProfile = "v2") -> DataFrame:
    """Endpoint keys with ``first_seq``, the position of their first request."""
    return requests(events, profile).groupBy(*ENDPOINT).agg(F.min("seq").alias("first_seq"))


def endpoints(events: DataFrame, profile: str | CaptureProfile = "v2") -> DataFrame:
    """First sighting of each endpoint: ``first_seq`` with the URL and headers of that request."""
    asked = requests(events, profile)
    first = first_seen(asked, profile).withColumn("seq", F.col("first_seq"))
    return fetch(first, asked, ["url", "headers"]).drop("seq")


def sample_picks(events: DataFrame, profile: str | CaptureProfile = "v2", n: int | None = None) -> DataFrame:
    """Positions of the first-N sample payloads: ``(endpoint, seq, rank)``.

    ``n`` (also 0) overrides the profile's limit; a profile whose limit is None keeps all.  Where
    any body is a sample, none is parsed here.
    """
    p = profile_of(profile)
    bodies = requests(events, p).where("parse")
    if not p.raw_text_samples:
        # A body under a JSON type counts as its raw text if it does not parse.
        bodies = with_json_facts(bodies).where(F.col("json_kind").isNull() | F.col("json_truthy"))
    return first_n(bodies.select(*ENDPOINT, "seq"), ENDPOINT, ["seq"], p.sample_limit if n is None else n, rank="rank")


def _payload_kind():
    return F.when(F.col("json_truthy"), F.col("json_kind")).otherwise(F.lit("text"))


def sample_rows(events: DataFrame, profile: str | CaptureProfile = "v2", n: int | None = None) -> DataFrame:
    """First-N sample payloads as rows ``(endpoint, seq, rank, body, kind)``.

    ``kind`` is the JSON kind, or ``text`` where the sample is the raw text.
    """
    asked = requests(events, profile)
    found = with_json_facts(fetch(sample_picks(asked, profile, n), asked, ["body", "parse"]))
    return found.select(*ENDPOINT, "seq", "rank", "body", _payload_kind().alias("kind"))


def status_positions(both: DataFrame) -> DataFrame:
    """``(endpoint, first_seq, seen)`` with the last position of each status in ``seen``."""
    is_request = F.col("kind") == "request"
    per_status = (both.where(is_request | F.col("status").isNotNull())
                  .groupBy(*ENDPOINT, F.when(~is_request, F.col("status")).alias("status"))
                  .agg(F.min(F.when(is_request, F.col("seq"))).alias("asked"),
                       F.max(F.when(~is_request, F.col("seq"))).alias("answered")))
    return (per_status.groupBy(*ENDPOINT)
            .agg(F.min("asked").alias("first_seq"),
                 F.collect_list(F.when(F.col("status").isNotNull(), F.struct("status", "answered"))).alias("seen"))
            .where(F.col("first_seq").isNotNull()))


def endpoint_statuses(events: DataFrame, profile: str | CaptureProfile = "v2") -> DataFrame:
    """``(endpoint, first_seq, response_statuses)`` in one pass over both sides.

    A status counts if one of its responses came after the endpoint's first request, which
    holds iff its last response did.  The list collected has one entry per status.
    """
    folded = status_positions(both_sides(events, profile))
    kept = F.filter("seen", lambda s: s["answered"] >= F.col("first_seq"))
    return folded.select(*ENDPOINT, "first_seq",
                         F.sort_array(F.transform(kept, lambda s: s["status"])).alias("response_statuses"))


def attached_statuses(events: DataFrame, profile: str | CaptureProfile = "v2") -> DataFrame:
    """Distinct statuses per endpoint, as rows."""
    return endpoint_statuses(events, profile).select(*ENDPOINT, F.explode("response_statuses").alias("status"))


def response_picks(events: DataFrame, profile: str | CaptureProfile = "v2") -> DataFrame:
    """Positions of the response samples: ``(endpoint, seq, kind)``.

    The rule is sequential: a JSON body is kept while fewer than two samples are held, a text
    only while none is.  So a text counts iff it is the first response, and JSON bodies fill
    what is left.
    """
    p = profile_of(profile)
    events = both_sides(events, p)
    held = p.response_sample_limit
    answered = responses(events, p).where(F.col("body").isNotNull())
    facts = with_json_facts(answered).select(*ENDPOINT, "seq", "json_kind").withColumn(
        "salt", F.pmod(F.xxhash64("seq"), F.lit(SALTS)).cast("int"))
    salted = first_seen(events, p).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    known = (facts.join(salted, [*ENDPOINT, "salt"]).where(F.col("seq") >= F.col("first_seq"))
             .select(*ENDPOINT, "seq", "json_kind", F.col("json_kind").isNotNull().alias("is_json")))
    leading = first_n(known, [*ENDPOINT, "is_json"], ["seq"], held, rank="class_rank")
    # At most 2 * held rows per endpoint are left; the lists below hold no more.
    entry = F.struct("seq", "class_rank", "is_json", "json_kind")
    lists = leading.groupBy(*ENDPOINT).agg(F.array_sort(F.collect_list(entry)).alias("e"))
    text_first = F.when(F.col("e")[0]["is_json"], 0).otherwise(1)
    kept = F.filter("e", lambda x, i: F.when(x["is_json"], (x["class_rank"] + text_first <= held) if held is not None
                                             else F.lit(True)).otherwise(i == 0))
    return (lists.select(*ENDPOINT, F.explode(kept).alias("x"))
            .select(*ENDPOINT, "x.seq", F.coalesce("x.json_kind", F.lit("text")).alias("kind")))


def response_sample_rows(events: DataFrame, profile: str | CaptureProfile = "v2") -> DataFrame:
    """Response samples as rows ``(endpoint, seq, kind, sample)``; texts cut at 500 characters."""
    p = profile_of(profile)
    events = both_sides(events, p)
    found = fetch(response_picks(events, p), responses(events, p), ["body"])
    return found.select(*ENDPOINT, "seq", "kind", _response_sample(p).alias("sample"))


def _response_sample(p: CaptureProfile):
    return (F.when(F.col("kind") == "text", X.text_sample(F.col("body"), p.text_sample))
            .otherwise(F.col("body")))


def endpoint_catalog(events: DataFrame, profile: str | CaptureProfile = "v2", mask: bool = True) -> DataFrame:
    """The catalog with samples and statuses; ``first_seq`` gives insertion order.

    All picks (first request, samples, response samples) are fetched in one scan.
    """
    p = profile_of(profile)
    events = both_sides(events, p)
    known = endpoint_statuses(events, p)
    picks = [first_seen(events, p).select(*ENDPOINT, F.col("first_seq").alias("seq"), F.lit("first").alias("role")),
             sample_picks(events, p).select(*ENDPOINT, "seq", F.lit("sample").alias("role"))]
    wide = requests(events, p)  # v1 picks nothing else
    if p.response_sample_limit != 0:
        picks.append(response_picks(events, p).select(*ENDPOINT, "seq", F.lit("response").alias("role")))
        wide = events
    found = with_json_facts(fetch(reduce(DataFrame.unionByName, picks), wide, ["url", "headers", "body", "parse"]))
    kind = F.when(F.col("role") == "response", F.coalesce("json_kind", F.lit("text"))).otherwise(_payload_kind())
    headers = P.mask_secrets(F.col("headers")) if mask else F.col("headers")
    first = F.when(F.col("role") == "first", F.struct("url", headers.alias("headers")))

    def listed(role: str, **fields):
        item = F.struct("seq", *[c.alias(name) for name, c in fields.items()])
        return F.array_sort(F.collect_list(F.when(F.col("role") == role, item)))

    lists = [listed("sample", body=F.col("body"), kind=F.col("kind")).alias("__samples")]
    if p.response_sample_limit != 0:
        lists.append(listed("response", sample=_response_sample(p), kind=F.col("kind")).alias("__responses"))
    folded = found.withColumn("kind", kind).groupBy(*ENDPOINT).agg(F.any_value(first, True).alias("__first"), *lists)
    columns = [*ENDPOINT, "first_seq", "__first.url", "__first.headers", "response_statuses",
               F.transform("__samples", lambda s: s.dropFields("seq")).alias("sample_payloads")]
    if p.response_sample_limit != 0:
        columns.append(F.transform("__responses", lambda s: s.dropFields("seq")).alias("response_samples"))
    return known.join(folded, ENDPOINT).select(*columns)


def client_spec(catalog: DataFrame, profile: str | CaptureProfile = "v2") -> DataFrame:
    """What a client needs per endpoint: name, method, URL, clean headers, first sample body.

    ``name_clash`` marks names that more than one endpoint of a session shares.
    """
    p = profile_of(profile)
    first = F.try_element_at("sample_payloads", F.lit(1))
    body = F.when(first["kind"] == "object", first["body"]) if p.spec_needs_object else first["body"]
    named = catalog.withColumn("fn_name", X.fn_name(F.col("method"), F.col("path")))
    shared = named.groupBy("session_id", "fn_name").agg(F.count("*").alias("__n"))
    return (named.join(shared, ["session_id", "fn_name"])
            .select("session_id", "first_seq", "fn_name", "method", "url",
                    P.clean_headers(F.col("headers")).alias("headers"), body.alias("body"),
                    (F.col("__n") > 1).alias("name_clash")))
