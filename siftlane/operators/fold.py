"""Everything that documents need to know of an endpoint, folded once and extended day by day.

``fold`` chooses all events that count for an endpoint (first request, sample payloads, response
samples, last payload, last response of each status) on narrow rows and fetches them in one join.
Its result, one row per endpoint, is small next to the log and is meant to be stored: catalog,
client table, API description and report are read from it, each without another look at
the log.  ``extend`` folds only new events and merges; of the events before, nothing but the stored
rows is read.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlane import schemas
from siftlane.functions import predicates as P
from siftlane.functions import text as X
from siftlane.operators.capture import ENDPOINT, both_sides, fetch, with_json_facts
from siftlane.operators.catalog import response_picks, sample_picks
from siftlane.profiles import CaptureProfile, profile_of
from siftlane.session import stored

_SEEN, _SAMPLE = "array<struct<status:int,answered:bigint>>", "array<struct<seq:bigint,body:string,kind:string>>"
_RESPONSE, _ANSWER = "array<struct<seq:bigint,sample:string,kind:string>>", "array<struct<status:int,seq:bigint,body:string,kind:string>>"


def _positions(both: DataFrame) -> DataFrame:
    """Per endpoint its first request, its last payload, and per status the last response and the last one with a body; one pass over narrow columns."""
    asked = F.col("kind") == "request"
    per_status = (both.where(asked | F.col("status").isNotNull())
                  .groupBy(*ENDPOINT, F.when(~asked, F.col("status")).alias("status"))
                  .agg(F.min(F.when(asked, F.col("seq"))).alias("asked"),
                       F.max(F.when(asked & (F.coalesce("body", F.lit("")) != ""), F.col("seq"))).alias("payload"),
                       F.max(F.when(~asked, F.col("seq"))).alias("answered"),
                       F.max(F.when(~asked & F.col("body").isNotNull(), F.col("seq"))).alias("with_body")))
    seen = F.collect_list(F.when(F.col("status").isNotNull(), F.struct("status", "answered", "with_body")))
    return (per_status.groupBy(*ENDPOINT)
            .agg(F.min("asked").alias("first_seq"), F.max("payload").alias("payload_seq"), seen.alias("seen"))
            .where(F.col("first_seq").isNotNull()))


#: What a fold may hold beside first requests and statuses.
PARTS = ("samples", "responses", "payload", "answers")


def fold(events: DataFrame, profile: str | CaptureProfile = "v2", parts: Sequence[str] = PARTS) -> DataFrame:
    """One row per endpoint: ``first_seq``, ``first`` (url, headers, resource_type), ``seen`` (statuses with their
    last position), ``samples``, ``responses``, ``payload`` and ``answers``; store it.

    Lists hold at most the profile's limits, or one entry per status.  ``parts`` leaves out what no
    reader needs: those columns are empty then.
    """
    p = profile_of(profile)
    if set(parts) - set(PARTS):
        raise ValueError(f"parts of a fold are {', '.join(PARTS)}")
    both = both_sides(events, p)
    known = stored(_positions(both), "positions")

    def pick(rows: DataFrame, seq: str, role: str, status: Column | None = None) -> DataFrame:
        return rows.select(*ENDPOINT, F.col(seq).alias("seq"), F.lit(role).alias("role"), (F.lit(None) if status is None else status).cast("int").alias("of"))

    last = known.select(*ENDPOINT, "first_seq", F.explode("seen").alias("s")).where(F.col("s.with_body") >= F.col("first_seq"))
    picks = [pick(known, "first_seq", "first")]
    if "payload" in parts:
        picks.append(pick(known.where("payload_seq is not null"), "payload_seq", "payload"))
    if "answers" in parts:
        picks.append(pick(last.withColumn("at", F.col("s.with_body")), "at", "answer", F.col("s.status")))
    if "samples" in parts:
        picks.append(pick(sample_picks(both, p), "seq", "sample"))
    if "responses" in parts and p.response_sample_limit != 0:
        picks.append(pick(response_picks(both, p), "seq", "response"))
    found = with_json_facts(fetch(reduce(DataFrame.unionByName, picks), both, ["url", "headers", "resource_type", "body", "parse"]))
    sent = F.when(F.col("json_truthy"), F.col("json_kind")).otherwise(F.lit("text"))
    got = F.coalesce("json_kind", F.lit("text"))
    sample = F.when(got == "text", X.text_sample(F.col("body"), p.text_sample)).otherwise(F.col("body"))

    def listed(role: str, *fields: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct(*fields)))).alias(role)

    folded = found.groupBy(*ENDPOINT).agg(
        F.any_value(F.when(F.col("role") == "first", F.struct("url", "headers", "resource_type")), True).alias("first"),
        listed("sample", F.col("seq"), F.col("body"), sent.alias("kind")), listed("response", F.col("seq"), sample.alias("sample"), got.alias("kind")),
        listed("payload", F.col("seq"), F.col("body"), sent.alias("kind")), listed("answer", F.col("of").alias("status"), F.col("seq"), F.col("body"), got.alias("kind")))
    return known.drop("payload_seq").join(folded, ENDPOINT).select(
        *ENDPOINT, "first_seq", "first", F.transform("seen", lambda s: s.dropFields("with_body")).cast(_SEEN).alias("seen"), F.col("sample").cast(_SAMPLE).alias("samples"),
        F.col("response").cast(_RESPONSE).alias("responses"), F.get("payload", F.lit(0)).alias("payload"), F.col("answer").cast(_ANSWER).alias("answers"))


def extend(base: DataFrame, events: DataFrame, profile: str | CaptureProfile = "v2", parts: Sequence[str] = PARTS) -> DataFrame:
    """The fold of all events, from the stored fold of those before and the new events.

    The new events of a session must come after those folded (their ``seq`` is greater).  The first requests
    known so far join the new events, so that a response counts whose request came on another day.
    """
    p = profile_of(profile)
    known = {"seq": F.col("first_seq"), "kind": F.lit("request"), "resource_type": F.col("first.resource_type"), "url": F.col("first.url"), "headers": F.col("first.headers")}
    columns = [(known.get(f.name, F.col(f.name) if f.name in ENDPOINT else F.lit(None))).cast(f.dataType).alias(f.name) for f in schemas.CAPTURE]
    new = fold(events.select(*[f.name for f in schemas.CAPTURE]).unionByName(base.select(*columns)), p, parts)
    both = new.alias("n").join(base.alias("b"), ENDPOINT, "left")

    def either(name: str) -> tuple[Column, Column]:
        return F.col(f"b.{name}"), F.col(f"n.{name}")

    def joined(name: str, kind: str) -> Column:
        old, more = either(name)
        return F.array_sort(F.concat(F.coalesce(old, F.array().cast(kind)), more))

    def by_status(name: str, kind: str, rest: list[str]) -> Column:
        """Of each status the entry with the greatest position."""
        old, more = (F.map_from_entries(F.transform(c, lambda s: F.struct(s["status"], F.struct(*[s[r].alias(r) for r in rest]))))
                     for c in (F.coalesce(either(name)[0], F.array().cast(kind)), either(name)[1]))
        held = F.map_entries(F.map_zip_with(old, more, lambda _, a, b: F.greatest(a, b)))
        return F.array_sort(F.transform(held, lambda e: F.struct(e["key"].alias("status"), *[e["value"][r].alias(r) for r in rest]))).cast(kind).alias(name)

    def some(c: Column, limit: int | None) -> Column:
        return c if limit is None else F.slice(c, 1, limit) if limit else F.slice(c, 1, 0)

    earlier = F.col("b.first_seq") <= F.col("n.first_seq")
    payload = F.when(F.col("n.payload.seq") >= F.coalesce(F.col("b.payload.seq"), F.lit(-(1 << 63))), F.col("n.payload")).otherwise(F.col("b.payload"))
    responses = F.filter(joined("responses", _RESPONSE), lambda r, i: (r["kind"] != "text") | (i == 0))
    return both.select(
        *ENDPOINT, F.least("b.first_seq", "n.first_seq").alias("first_seq"), F.when(earlier, F.col("b.first")).otherwise(F.col("n.first")).alias("first"),
        by_status("seen", _SEEN, ["answered"]), some(joined("samples", _SAMPLE), p.sample_limit).alias("samples"), some(responses, p.response_sample_limit).alias("responses"),
        payload.alias("payload"), by_status("answers", _ANSWER, ["seq", "body", "kind"]))


def catalog_of(folded: DataFrame, profile: str | CaptureProfile = "v2", mask: bool = True) -> DataFrame:
    """The endpoint catalog, as ``endpoint_catalog`` gives it."""
    p = profile_of(profile)
    counted = F.filter("seen", lambda s: s["answered"] >= F.col("first_seq"))
    columns = [*ENDPOINT, "first_seq", "first.url", (P.mask_secrets(F.col("first.headers")) if mask else F.col("first.headers")).alias("headers"),
               F.sort_array(F.transform(counted, lambda s: s["status"])).alias("response_statuses"),
               F.transform("samples", lambda s: s.dropFields("seq")).alias("sample_payloads")]
    if p.response_sample_limit != 0:
        columns.append(F.transform("responses", lambda s: s.dropFields("seq")).alias("response_samples"))
    return folded.select(*columns)


def openapi_requests_of(folded: DataFrame) -> DataFrame:
    """As ``openapi_requests``."""
    return folded.select(*ENDPOINT, "first_seq", F.when(F.col("payload").isNotNull(), X.request_content_type(F.col("payload.kind"))).alias("content_type"),
                         F.col("payload.body").alias("example"), F.col("payload.kind").alias("example_kind"))


def openapi_responses_of(folded: DataFrame, profile: str | CaptureProfile = "v2") -> DataFrame:
    """As ``openapi_responses``."""
    p, kind = profile_of(profile), F.col("a.kind")
    return folded.select(*ENDPOINT, F.explode("answers").alias("a")).select(
        *ENDPOINT, F.col("a.status").cast("string").alias("status"), X.response_content_type(kind).alias("content_type"),
        F.when(kind == "text", X.leading(F.col("a.body"), p.text_sample)).otherwise(F.col("a.body")).alias("example"), kind.alias("example_kind"))
