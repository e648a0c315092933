"""API description folded from observed traffic.

Two flat tables come first: the last truthy request payload per endpoint and the last
response per (endpoint, status).  Both pick positions with partial ``max`` on narrow rows,
fetch the picked bodies and parse only those.  The nested form is one JSON text per (session,
path), never one per session: a session with millions of paths stays millions of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlane.functions import text as X
from siftlane.functions.bodies import canonical_json
from siftlane.operators.capture import ENDPOINT, both_sides, fetch, requests, responses, with_json_facts
from siftlane.operators.catalog import status_positions
from siftlane.profiles import CaptureProfile, profile_of

#: Descriptions in the API document.
ANSWERED, SUMMARY = "Auto-captured response", "Auto-captured "


def openapi_requests(events: DataFrame, profile: str | CaptureProfile = "v2") -> DataFrame:
    """One row per endpoint: ``first_seq`` and the last truthy payload.

    ``content_type``, ``example`` and ``example_kind`` are null without a payload.  Falsy JSON
    counts as its raw text, so any non-empty body is a payload.
    """
    asked = requests(events, profile)
    has_payload = F.coalesce(F.col("body"), F.lit("")) != ""
    known = asked.groupBy(*ENDPOINT).agg(
        F.min("seq").alias("first_seq"), F.max(F.when(has_payload, F.col("seq"))).alias("payload_seq"))
    last = known.where(F.col("payload_seq").isNotNull()).select(*ENDPOINT, F.col("payload_seq").alias("seq"))
    found = with_json_facts(fetch(last, asked, ["body", "parse"]))
    kind = F.when(F.col("json_truthy"), F.col("json_kind")).otherwise(F.lit("text"))
    payload = found.select(*ENDPOINT, X.request_content_type(kind).alias("content_type"),
                           F.col("body").alias("example"), kind.alias("example_kind"))
    return (known.join(payload, ENDPOINT, "left")
            .select(*ENDPOINT, "first_seq", "content_type", "example", "example_kind"))


def openapi_responses(events: DataFrame, profile: str | CaptureProfile = "v2") -> DataFrame:
    """One row per (endpoint, status): the last response, if it came after the endpoint's
    first request.  Other responses of that status cannot matter: the last one is the latest."""
    p = profile_of(profile)
    events = both_sides(events, p)
    answered = F.col("body").isNotNull() | (F.col("kind") == "request")
    seen = status_positions(events.where(answered))
    last = (seen.select(*ENDPOINT, F.explode(F.filter("seen", lambda s: s["answered"] >= F.col("first_seq"))).alias("s"))
            .select(*ENDPOINT, "s.status", F.col("s.answered").alias("seq")))
    found = with_json_facts(fetch(last, responses(events, p), ["body", "parse"]))
    kind = F.coalesce(F.col("json_kind"), F.lit("text"))
    example = F.when(kind == "text", X.leading(F.col("body"), p.text_sample)).otherwise(F.col("body"))
    return found.select(*ENDPOINT, F.col("status").cast("string").alias("status"),
                        X.response_content_type(kind).alias("content_type"),
                        example.alias("example"), kind.alias("example_kind"))


def json_example(example: Column, kind: Column) -> Column:
    """JSON text of an example: JSON bodies in canonical form, texts quoted."""
    return F.when(kind == "text", X.json_quote(example)).otherwise(canonical_json(F.when(kind != "text", example)))


def _object(entries: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}"))


def openapi_path_items(requests_fold: DataFrame, responses_fold: DataFrame) -> DataFrame:
    """``(session_id, path, first_seq, path_item)`` with the path item as JSON text.

    The arrays collected here hold one entry per status and per method.
    """
    answer = F.concat(
        X.json_quote(F.col("status")), F.lit(f':{{"description":"{ANSWERED}","content":{{'),
        X.json_quote(F.col("content_type")), F.lit(':{"example":'),
        json_example(F.col("example"), F.col("example_kind")), F.lit("}}}"))
    answers = (responses_fold.select(*ENDPOINT, F.struct("status", answer.alias("json")).alias("a"))
               .groupBy(*ENDPOINT).agg(F.sort_array(F.collect_list("a")).alias("a"))
               .select(*ENDPOINT, F.transform("a", lambda x: x["json"]).alias("answers")))
    request_body = F.when(F.col("content_type").isNotNull(), F.concat(
        F.lit(',"requestBody":{"content":{'), X.json_quote(F.col("content_type")),
        F.lit(':{"schema":{"type":"object"},"example":'),
        json_example(F.col("example"), F.col("example_kind")), F.lit("}}}"))).otherwise(F.lit(""))
    operation = F.concat(
        X.json_quote(F.lower("method")), F.lit(':{"summary":'),
        X.json_quote(F.concat(F.lit(SUMMARY), F.col("path"))),
        F.lit(',"responses":'), _object(F.coalesce("answers", F.array().cast("array<string>"))),
        request_body, F.lit("}"))
    return (requests_fold.join(answers, ENDPOINT, "left")
            .select("session_id", "path", F.struct("first_seq", operation.alias("json")).alias("op"))
            .groupBy("session_id", "path").agg(F.sort_array(F.collect_list("op")).alias("ops"))
            .select("session_id", "path", F.col("ops")[0]["first_seq"].alias("first_seq"),
                    _object(F.transform("ops", lambda o: o["json"])).alias("path_item")))
