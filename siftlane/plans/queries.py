"""Queries over the driver tables: ``name -> callable(spark, sf_dir)``.

Results are flat: nested values are exploded or rendered as text, so that any engine can
compare them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlane.functions import html as H
from siftlane.functions import predicates as P
from siftlane.functions import text as X
from siftlane.functions import urls as U
from siftlane.operators import catalog as C
from siftlane.operators import dom as D
from siftlane.operators import fold as E
from siftlane.operators import lineage as L
from siftlane.operators import offline as O
from siftlane.operators import openapi as A
from siftlane.operators import report as R
from siftlane.operators import trace as T
from siftlane.operators.capture import both_sides, network_log, pair_responses, store_log
from siftlane.operators.leaves import json_leaves, request_leaves, response_leaves
from siftlane.operators.ordered import changed_only, first_n, with_index
from siftlane.plans import derived as V
from siftlane.profiles import MEDIA_EXTENSIONS, NOISE_FRAGMENTS, STATIC_EXTENSIONS, TRACKER_DOMAINS
from siftlane.session import stored
from siftlane.sources import spread, stream_capture
from siftlane.sinks.writers import endpoint_map_rows, openapi_lines
from siftlane.streaming.online import catalog_stream, drain, settle_catalog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def _long(name: str) -> Column:
    return F.col(name).cast("long").alias(name)


def map_text(name: str) -> Column:
    """A map as sorted text."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(name), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")


def _day(ts: str) -> Column:
    return F.unix_date(F.col(ts).cast("date")).cast("long")


def _page_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as GET requests of one session."""
    return V.table(spark, sf_dir, "pages").select(
        F.lit("crawl").alias("session_id"), F.col("page_id").alias("seq"), F.lit("request").alias("kind"),
        F.lit("document").alias("resource_type"), F.lit("GET").alias("method"), "url",
        F.create_map(F.lit("accept"), F.lit("*/*")).alias("headers"), F.lit(None).cast("string").alias("body"))


# --- URLs and predicates --------------------------------------------------------------


@query
def url_parts(spark, sf_dir):
    url = F.col("url")
    return V.table(spark, sf_dir, "pages").select(
        "page_id", U.url_path(url).alias("path"), U.url_host(url).alias("host"), U.scope_domain(url).alias("domain"))


@query
def capture_url_parts(spark, sf_dir):
    url = F.col("url")
    return V.event_capture(spark, sf_dir).select(
        "seq", U.url_path(url).alias("raw_path"), U.path_or_root(U.url_path(url)).alias("path"),
        U.url_host(url).alias("host"), U.scope_domain(url).alias("domain"), F.upper("method").alias("method"))


@query
def normalised_targets(spark, sf_dir):
    typed = F.concat(F.lit("  "), F.when(F.col("page_id") % 2 == 0, F.regexp_replace("url", "^https?://", ""))
                     .otherwise(F.col("url")), F.lit(" "))
    return V.table(spark, sf_dir, "pages").select("page_id", U.normalise_target(typed).alias("target"))


@query
def route_decision(spark, sf_dir):
    return V.event_capture(spark, sf_dir).select(
        "seq", P.block_reason(F.col("url"), TRACKER_DOMAINS, STATIC_EXTENSIONS).alias("block_reason_v1"),
        P.block_reason(F.col("url"), (), MEDIA_EXTENSIONS).alias("block_reason_v2"))


@query
def noise_filtered_pages(spark, sf_dir):
    pages = V.table(spark, sf_dir, "pages")
    return pages.where(~P.is_noise(F.col("url"), ("spam-farm", "cheap-pills"))
                       & ~P.is_static(F.col("url"), (".html",))
                       & ~P.is_tracker(F.col("url"), ("example.net",))).select("page_id", "url")


@query
def noise_requests(spark, sf_dir):
    rows = V.event_capture(spark, sf_dir).where(F.col("kind") == "request")
    return rows.where(P.is_noise(F.col("url"), NOISE_FRAGMENTS)).select("session_id", "seq", "url")


@query
def json_content_types(spark, sf_dir):
    return (V.event_capture(spark, sf_dir).where(P.is_json_content_type(F.col("headers")))
            .groupBy("kind").agg(F.count("*").alias("n")))


@query
def cleaned_headers(spark, sf_dir):
    kept = P.mask_secrets(P.clean_headers(F.col("headers")))
    text = F.array_join(F.array_sort(F.transform(
        F.map_entries(kept), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")
    return V.event_capture(spark, sf_dir).select("seq", text.alias("headers"))


# --- Requests, responses, catalog -----------------------------------------------------


def _log(spark, sf_dir, profile):
    return network_log(V.event_capture(spark, sf_dir), profile).select(
        "session_id", "seq", "method", "url", "path", "body", "body_is_json", "block_reason")


@query
def network_log_v1(spark, sf_dir):
    return _log(spark, sf_dir, "v1")


@query
def network_log_v2(spark, sf_dir):
    return _log(spark, sf_dir, "v2")


@query
def paired_responses(spark, sf_dir):
    """Responses stripped of their URL get it back from the request with the same id."""
    events = V.event_capture(spark, sf_dir)
    asked = events.where(F.col("kind") == "request")
    bare = asked.select(
        "session_id", (F.col("seq") + 1).alias("seq"), "request_id", F.lit("response").alias("kind"), "ts",
        F.lit(None).cast("string").alias("resource_type"), F.lit(None).cast("string").alias("method"),
        F.lit(None).cast("string").alias("url"), "headers", "body", F.lit(200).alias("status"))
    paired = pair_responses(asked.unionByName(bare)).where(F.col("kind") == "response")
    return paired.select("session_id", "seq", "request_id", "method", "url", "resource_type")


@query
def unpaired_responses(spark, sf_dir):
    """Of bare responses every third has lost its request; all of them stay."""
    events = V.event_capture(spark, sf_dir)
    asked = events.where(F.col("kind") == "request")
    lost = F.when(F.col("seq") % 3 == 0, F.concat(F.lit("lost-"), "request_id")).otherwise(F.col("request_id"))
    none = F.lit(None).cast("string")
    bare = asked.withColumns({"request_id": lost, "kind": F.lit("response"), "method": none, "url": none, "resource_type": none})
    paired = pair_responses(asked.unionByName(bare)).where(F.col("kind") == "response")
    return paired.select("session_id", "seq", "request_id", "method", "url", "resource_type", "paired")


@query
def endpoint_catalog(spark, sf_dir):
    """Distinct endpoints of the crawled pages with the URL first seen."""
    return (C.endpoints(_page_requests(spark, sf_dir), "v2")
            .select("method", "path", "url", F.col("first_seq").alias("first_page")))


def _folded(spark, sf_dir, profile, *parts):
    return stored(E.fold(V.event_capture(spark, sf_dir), profile, parts), "fold")


def _extended(spark, sf_dir, profile):
    """The fold of the first half of the log, extended by the second."""
    events = V.event_capture(spark, sf_dir)
    half = events.agg(F.max("seq")).first()[0] // 2
    base = stored(E.fold(events.where(F.col("seq") <= half), profile), "fold")
    return stored(E.extend(base, events.where(F.col("seq") > half), profile), "fold")


def _catalog(rows):
    return rows.select(
        "session_id", "method", "path", "url", "first_seq", X.status_text(F.col("response_statuses")).alias("statuses"),
        F.array_join(F.transform("sample_payloads", lambda s: s["body"]), " | ").alias("samples"),
        F.size("sample_payloads").cast("long").alias("n_samples"))


@query
def endpoint_catalog_v1(spark, sf_dir):
    return _catalog(C.endpoint_catalog(V.event_capture(spark, sf_dir), "v1"))


@query
def stored_log_catalog(spark, sf_dir):
    """The catalog from the log stored in buckets: picks are joined with it where it lies."""
    return _catalog(C.endpoint_catalog(store_log(V.event_capture(spark, sf_dir), "v2"), "v2"))


@query
def stored_log_openapi(spark, sf_dir):
    """The API description from the fold of the log stored in buckets."""
    folded = stored(E.fold(store_log(V.event_capture(spark, sf_dir), "v2"), "v2", ("payload", "answers")), "fold")
    lines = openapi_lines(E.openapi_requests_of(folded), E.openapi_responses_of(folded, "v2"), "Captured API")
    return lines.select("session_id", _long("section"), _long("ord"), "line")


@query
def endpoint_catalog_v2(spark, sf_dir):
    return _catalog(C.endpoint_catalog(V.event_capture(spark, sf_dir), "v2"))


@query
def catalog_extended(spark, sf_dir):
    return _catalog(E.catalog_of(_extended(spark, sf_dir, "v2"), "v2"))


@query
def sample_payloads_v1(spark, sf_dir):
    return C.sample_rows(V.event_capture(spark, sf_dir), "v1").withColumn("rank", _long("rank"))


@query
def sample_payloads_v2(spark, sf_dir):
    return C.sample_rows(V.event_capture(spark, sf_dir), "v2").withColumn("rank", _long("rank"))


@query
def attached_statuses_v1(spark, sf_dir):
    return C.attached_statuses(V.event_capture(spark, sf_dir), "v1").withColumn("status", _long("status"))


@query
def attached_statuses_v2(spark, sf_dir):
    return C.attached_statuses(V.event_capture(spark, sf_dir), "v2").withColumn("status", _long("status"))


@query
def response_samples(spark, sf_dir):
    return C.response_sample_rows(V.event_capture(spark, sf_dir), "v2")


@query
def first_n_payloads(spark, sf_dir):
    events = V.table(spark, sf_dir, "events")
    return (first_n(events, ["event_type"], ["event_id"], 5, rank="rank")
            .select("event_type", "event_id", "props", _long("rank"), (F.col("rank") <= 2).alias("in_short_list")))


@query
def user_statuses(spark, sf_dir):
    """Distinct event types per user as text, ``None`` for users without an error or view."""
    events = V.table(spark, sf_dir, "events")
    code = F.when(F.col("event_type") == "error", 500).when(F.col("event_type") == "view", 200)
    held = events.groupBy("user_id").agg(F.sort_array(F.collect_set(code)).alias("s"))
    return held.select("user_id", X.status_text(F.col("s")).alias("statuses"))


@query
def client_spec(spark, sf_dir):
    pages = C.endpoints(_page_requests(spark, sf_dir), "v2").withColumn(
        "sample_payloads", F.array().cast("array<struct<body:string,kind:string>>"))
    return C.client_spec(pages, "v2").select("fn_name", "method", "url", "body", "name_clash")


@query
def client_spec_v2(spark, sf_dir):
    spec = C.client_spec(E.catalog_of(_folded(spark, sf_dir, "v2", "samples"), "v2"), "v2")
    return spec.select("session_id", "fn_name", "method", "url", "body", "name_clash", map_text("headers").alias("headers"))


@query
def client_spec_v1(spark, sf_dir):
    spec = C.client_spec(E.catalog_of(_folded(spark, sf_dir, "v1", "samples"), "v1"), "v1")
    return spec.select("session_id", "fn_name", "method", "url", "body", "name_clash")


# --- JSON leaves and lineage ----------------------------------------------------------


@query
def json_leaf_table(spark, sf_dir):
    rows = spread(V.table(spark, sf_dir, "events").select("event_id", F.col("props").alias("body")))
    return json_leaves(rows).select("event_id", _long("ord"), "path", "typ", "value", "root_kind")


@query
def request_tokens(spark, sf_dir):
    return request_leaves(V.event_capture(spark, sf_dir), "v1").withColumn("ord", _long("ord"))


@query
def response_tokens(spark, sf_dir):
    return response_leaves(V.event_capture(spark, sf_dir), "v2").withColumn("ord", _long("ord"))


@query
def value_lineage(spark, sf_dir):
    """Words of a user turn that an earlier assistant turn used: all uses."""
    return L.lineage_uses(V.chat_capture(spark, sf_dir), "v2").withColumn("ord", _long("ord"))


@query
def lineage_edges_v1(spark, sf_dir):
    return L.lineage_edges(V.event_capture(spark, sf_dir), "v1").drop("first_at")


@query
def lineage_edges_capped(spark, sf_dir):
    """All traffic as one session of the first profile, which keeps 100 edges of a session."""
    events = V.event_capture(spark, sf_dir).withColumn("session_id", F.lit("all"))
    return L.lineage_edges(events, "v1").drop("first_at")


@query
def lineage_edges_v2(spark, sf_dir):
    return L.lineage_edges(V.event_capture(spark, sf_dir), "v2").drop("first_at")


@query
def lineage_one_session(spark, sf_dir):
    """All traffic as a single session: every use of a value, tokens shared by thousands of
    events, and more than one block of positions at the larger scales."""
    events = V.event_capture(spark, sf_dir).withColumn("session_id", F.lit("all"))
    return L.lineage_uses(events, "v2").withColumn("ord", _long("ord"))


@query
def order_lineage(spark, sf_dir):
    """Line items (consumers) matched to their order (producer) if it is strictly older."""
    def token(col: str) -> Column:
        text = F.col(col).cast("string")
        return F.when(P.token_length_ok(text, 3, 120), X.token_hash(text))

    orders = V.table(spark, sf_dir, "orders").select(
        token("o_orderkey").alias("token"), _day("o_orderdate").alias("seq"), _day("o_orderdate").alias("origin"))
    items = V.table(spark, sf_dir, "lineitem").select(
        token("l_orderkey").alias("token"), _day("l_shipdate").alias("seq"), "l_orderkey", "l_linenumber")
    found = L.asof_match(items.where(F.col("token").isNotNull()), orders.where(F.col("token").isNotNull()), ["token"])
    return found.select("l_orderkey", "l_linenumber", F.col("seq").alias("ship_day"), F.col("origin").alias("order_day"))


@query
def edge_chart(spark, sf_dir):
    return L.edge_lines(stored(L.lineage_edges(V.event_capture(spark, sf_dir), "v2")))


# --- API description and report -------------------------------------------------------


@query
def openapi_requests(spark, sf_dir):
    return A.openapi_requests(V.event_capture(spark, sf_dir), "v2")


@query
def openapi_responses(spark, sf_dir):
    return A.openapi_responses(V.event_capture(spark, sf_dir), "v2")


@query
def openapi_escaped(spark, sf_dir):
    """Bodies with a repeated key and a number that JSON does not have."""
    body = F.concat(F.lit('{"x":NaN,"a":1,"a":'), "seq", F.lit("}"))
    rows = A.openapi_requests(V.event_capture(spark, sf_dir).withColumn("body", body), "v2")
    return rows.select("session_id", "method", "path", A.json_example(F.col("example"), F.col("example_kind")).alias("example"))


@query
def openapi_last_write(spark, sf_dir):
    """Last payload per (event type, user) with its content type."""
    events = V.table(spark, sf_dir, "events")
    return (events.groupBy("event_type", "user_id")
            .agg(F.max_by("props", "event_id").alias("example"), F.max("event_id").alias("last_event"))
            .withColumn("content_type", X.request_content_type(F.lit("object"))))


@query
def openapi_documents(spark, sf_dir):
    folded = _folded(spark, sf_dir, "v2", "payload", "answers")
    lines = openapi_lines(E.openapi_requests_of(folded), E.openapi_responses_of(folded, "v2"), "Captured API")
    return lines.select("session_id", _long("section"), _long("ord"), "line")


@query
def openapi_extended(spark, sf_dir):
    """The API description from a fold of the first half of the log, extended by the second."""
    folded = _extended(spark, sf_dir, "v2")
    lines = openapi_lines(E.openapi_requests_of(folded), E.openapi_responses_of(folded, "v2"), "Captured API")
    return lines.select("session_id", _long("section"), _long("ord"), "line")


@query
def endpoint_map(spark, sf_dir):
    lines = R.json_entries(endpoint_map_rows(E.catalog_of(_folded(spark, sf_dir, "v1", "samples"), "v1")))
    return lines.select("session_id", _long("section"), _long("ord"), "line")


@query
def report_lines(spark, sf_dir):
    events = V.event_capture(spark, sf_dir)
    meta = (events.groupBy("session_id").agg(F.lit("https://api.example.com").alias("target"))
            .withColumn("generated", F.lit("2024-01-01T00:00:00")))
    events = both_sides(events, "v1")
    edges = stored(L.lineage_edges(events, "v1"))
    rows = R.report_rows(E.catalog_of(_folded(spark, sf_dir, "v1", "samples"), "v1"), edges, meta)
    return rows.select("session_id", _long("section"), "ord", "line")


# --- Pages ----------------------------------------------------------------------------


@query
def base_injected(spark, sf_dir):
    return V.table(spark, sf_dir, "pages").select("page_id", H.inject_base(F.col("html"), F.col("url")).alias("html"))


@query
def link_catalog(spark, sf_dir):
    parsed = D.page_elements(spread(V.table(spark, sf_dir, "pages")), ("a",), (), ())
    links = D.link_catalog(parsed)
    return (links.groupBy("page_id", "id", "label").agg(F.count("*").alias("n")))


@query
def picker_by_class(spark, sf_dir):
    parsed = D.page_elements(spread(V.table(spark, sf_dir, "pages")), (), (), ("ad",))
    return D.custom_pickers(parsed, (), ("ad",)).select(
        "page_id", _long("index"), "tag", "class_name", "current_text")


@query
def element_counts(spark, sf_dir):
    parsed = D.page_elements(spread(V.table(spark, sf_dir, "pages")), (), (), ())
    return D.elements(parsed).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


def _parsed_forms(spark, sf_dir):
    return D.page_elements(V.form_pages(spark, sf_dir))


@query
def forms(spark, sf_dir):
    return D.forms(_parsed_forms(spark, sf_dir)).select(
        "page_id", _long("index"), "id", "name", "action", "method", F.size("fields").cast("long").alias("n_fields"))


@query
def form_fields(spark, sf_dir):
    return D.form_fields(D.forms(_parsed_forms(spark, sf_dir))).select(
        "page_id", "tag", "type", "name", "id", "required", "value", "checked", _long("options_count"))


@query
def select_options(spark, sf_dir):
    return D.select_options(D.form_fields(D.forms(_parsed_forms(spark, sf_dir)))).select(
        "page_id", _long("position"), "value", "text", "selected")


@query
def standalone_inputs(spark, sf_dir):
    return D.standalone_inputs(_parsed_forms(spark, sf_dir)).select("page_id", "tag", "type", "name", "placeholder")


@query
def custom_pickers(spark, sf_dir):
    return D.custom_pickers(_parsed_forms(spark, sf_dir)).select(
        "page_id", "tag", "role", "class_name", "current_text", F.col("dataset")["segName"].alias("seg_name"))


@query
def dropdown_catalog(spark, sf_dir):
    rows = D.dropdown_catalog(_parsed_forms(spark, sf_dir))
    return rows.select("page_id", "key", F.array_join(
        F.transform("options", lambda o: F.concat_ws("=", o["id"], o["label"])), ";").alias("options"))


def _frames(spark, sf_dir):
    """Customer pages as the frames of pages: four neighbouring customers make one page."""
    customers = spread(V.table(spark, sf_dir, "customer"))
    return V.derive(customers, {**V.FORM_PAGES, "page_id": "CAST(floor(c_custkey / 4) AS BIGINT)", "session_id": "c_mktsegment",
                                "frame_index": "c_custkey % 4"})


@query
def snapshot_totals(spark, sf_dir):
    totals = D.snapshot_totals(D.frame_data(D.page_elements(_frames(spark, sf_dir))))
    return totals.select("session_id", "page_id", "frames", "forms", "pickers")


@query
def dom_snapshots(spark, sf_dir):
    pages = D.dom_snapshot(D.frame_data(D.page_elements(_frames(spark, sf_dir))))
    return pages.select("session_id", "page_id", F.array_join(
        F.transform("frames", lambda f: F.concat_ws(":", f["frame_index"], f["forms"][0]["id"])), ";").alias("frames"))


def _failing_frames(spark, sf_dir):
    """Every fifth customer's frame holds a character reference of more digits than can be read."""
    digits = F.concat(F.lit("<p title='&#"), F.repeat(F.lit("9"), 5000), F.lit(";'>"))
    frames = _frames(spark, sf_dir)
    fails = F.pmod(F.col("page_id") * 4 + F.col("frame_index"), F.lit(5)) == 0
    return frames.withColumn("html", F.when(fails, F.concat("html", digits)).otherwise(F.col("html")))


@query
def snapshots_with_gaps(spark, sf_dir):
    """Frames that fail leave a gap in the numbers of their page and nothing else."""
    parsed = D.page_elements(_failing_frames(spark, sf_dir), error="error")
    pages = D.dom_snapshot(D.frame_data(parsed))
    return pages.select("session_id", "page_id", F.array_join(F.transform("frames", lambda f: F.concat_ws(
        ":", f["frame_index"], f["forms"][0]["id"], F.size(f["forms"][0]["fields"]))), ";").alias("frames"))


@query
def unread_frames(spark, sf_dir):
    parsed = D.page_elements(_failing_frames(spark, sf_dir), error="error")
    rows = D.unread_frames(parsed)
    return rows.select("session_id", "page_id", "unread", _long("frame_index"), F.split("error", ":")[0].alias("reason"))


@query
def inlined_css(spark, sf_dir):
    pages = V.form_pages(spark, sf_dir)
    rows = O.inline_css(pages, D.page_elements(pages), V.stylesheets(spark, sf_dir), ("page_id",))
    return rows.select("page_id", "html")


@query
def css_with_bad_address(spark, sf_dir):
    """One reference of each sheet forms no address and stays as it is."""
    sheets = V.table(spark, sf_dir, "nation").select(
        "n_nationkey", F.concat(F.lit("a{b:url(//["), "n_name", F.lit(")} c{d:url('../i/"), "n_name", F.lit(".png')}")).alias("css"))
    return sheets.select("n_nationkey", H.absolutise_css(F.col("css"), F.lit("https://shop.example.com/css/n.css")).alias("css"))


@query
def frozen_values(spark, sf_dir):
    """Live values come by element, for every field of every page."""
    key = ("page_id", "form_index", "ord")
    fields = D.form_fields(D.forms(_parsed_forms(spark, sf_dir))).select(*key, "name", "value", "checked")
    typed = F.when((F.col("name") == "who") & (F.col("page_id") % 2 == 0), F.lit("typed"))
    ticked = F.when((F.col("name") == "vip") & (F.col("page_id") % 3 == 0), F.lit(True))
    live = fields.select(*key, typed.alias("live_value"), ticked.alias("live_checked"))
    return D.frozen_values(fields, live, key).select("page_id", "name", "value", "checked")


# --- Change detection, steps, traces --------------------------------------------------


@query
def page_change(spark, sf_dir):
    """Turns whose role differs from the turn before it."""
    turns = V.table(spark, sf_dir, "conversations")
    return changed_only(turns, ["conv_id"], "turn", "role").select("conv_id", "turn", "role")


@query
def user_state_changes(spark, sf_dir):
    events = V.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return changed_only(events, ["user_id"], "event_id", "event_type")


@query
def feed_changes(spark, sf_dir):
    """One key that holds every row: the change feed of all events."""
    events = V.table(spark, sf_dir, "events").select(F.lit("feed").alias("feed"), "event_id", "event_type")
    return changed_only(events, ["feed"], "event_id", "event_type").select("event_id", "event_type")


@query
def event_index(spark, sf_dir):
    """Rank of every event in one global order and within its type."""
    events = V.table(spark, sf_dir, "events").select(F.lit("feed").alias("feed"), "event_id", "event_type")
    ranked = with_index(events, ["feed"], "event_id", "position")
    return with_index(ranked, ["event_type"], "event_id", "type_position").drop("feed")


@query
def page_steps(spark, sf_dir):
    """Changed states of every user, numbered and named."""
    events = V.table(spark, sf_dir, "events").select(
        F.concat(F.lit("user-"), "user_id").alias("session_id"), F.col("event_id").alias("page_id"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("html"))
    steps = O.page_steps(changed_only(events, ["session_id"], "page_id", "html"))
    return steps.select("session_id", "page_id", "step", "step_name")


@query
def mutation_log(spark, sf_dir):
    rows = V.derive(V.table(spark, sf_dir, "events"), V.MUTATIONS)
    return T.mutation_log(rows).select(
        "session_id", F.unix_millis("time").alias("time_ms"), "type", "target_id", _long("added_nodes"))


@query
def call_log(spark, sf_dir):
    rows = V.derive(V.table(spark, sf_dir, "events"), V.CALLS)
    return T.call_log(rows, ("purchase", "signup")).select(
        "session_id", "function", "arguments", "returned", F.unix_millis("ts").alias("ts_ms"))


@query
def listener_map(spark, sf_dir):
    rows = V.derive(V.table(spark, sf_dir, "events"), V.LISTENERS).withColumn("events", F.split("events", ","))
    return T.listener_map(rows).select("session_id", "selector", F.array_join("events", "+").alias("events"))


@query
def text_digests(spark, sf_dir):
    """Samples and digests of whole documents."""
    text = F.col("text")
    return V.table(spark, sf_dir, "documents").select(
        "doc_id", X.text_sample(text).alias("sample"), X.content_hash(text).alias("md5"), X.token_hash(text).alias("sha1"))


@query
def cookie_values(spark, sf_dir):
    jar = F.concat(F.lit("uid="), F.col("user_id"), F.lit("; kind="), F.col("event_type"), F.lit(";raw="), F.col("props"),
                   F.lit("=x; uid="), F.col("event_id"))
    cookies = X.cookie_map(jar)
    return V.table(spark, sf_dir, "events").select(
        "event_id", cookies["uid"].alias("uid"), cookies["kind"].alias("kind"), cookies["raw"].alias("raw"))


# --- Streams --------------------------------------------------------------------------


@query
def stream_catalog(spark, sf_dir):
    """The catalog as a stream over the stored capture log, folded to its final state.

    Its aggregates do not depend on arrival order, so it equals the batch result however the
    source cuts its micro-batches.
    """
    feed = stream_capture(spark, V.event_capture_path(spark, sf_dir), "parquet")
    key = ["session_id", "method", "path", "status"]
    updates = drain(catalog_stream(feed, "v2"), "update")
    current = updates.groupBy(*key).agg(F.max_by(F.struct("first_seq", "url", "last_seq"), "batch").alias("r"))
    final = settle_catalog(current.select(*key, "r.*"))
    return final.select("session_id", "method", "path", "url", "first_seq", X.status_text(F.col("response_statuses")).alias("statuses"))
