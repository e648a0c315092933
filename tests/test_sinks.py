import json

from pyspark.sql import functions as F

from siftlane import schemas, sinks, sources
from siftlane.operators import catalog as C
from siftlane.operators import dom as D
from siftlane.operators import lineage as L
from siftlane.operators import openapi as A
from siftlane.operators import trace as T
from siftlane.operators.capture import network_log, pair_responses

from events import Model, frame, random_events


def document(spark, path, session):
    rows = sinks.read_documents(spark, str(path), [session]).orderBy("line_no").collect()
    assert [r.line_no for r in rows] == list(range(1, len(rows) + 1)) and {r.session_id for r in rows} == {session}
    return "\n".join(r.line for r in rows)


def rows_of(spark, path):
    return spark.read.json(str(path)).collect()


def test_capture_tables_and_documents(spark, tmp_path):
    rows = random_events(7, 120)
    names = [f.name for f in schemas.CAPTURE]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps(dict(zip(names, r))) for r in rows))
    events = sources.read_capture(spark, str(tmp_path / "in")).cache()
    assert events.count() == 120
    for profile in ("v1", "v2"):
        model = Model(profile).run(rows)
        out = tmp_path / profile
        catalog, edges = C.endpoint_catalog(events, profile).cache(), L.lineage_edges(events, profile).cache()
        sinks.write_network_log(network_log(events, profile), str(out / "log"))
        sinks.write_edges(edges, str(out / "edges"))
        sinks.write_endpoint_map(catalog, str(out / "map"))
        sinks.write_openapi(A.openapi_requests(events, profile), A.openapi_responses(events, profile), str(out / "api"), "T")
        meta = spark.createDataFrame([("s0", "https://t", "now"), ("s1", "https://t", "now")], "session_id string, target string, generated string")
        sinks.write_report(catalog, edges, meta, str(out / "report"))
        assert {(r.source.origin_endpoint, r.consumer.field_path) for r in rows_of(spark, out / "edges")} == {(e[1], e[4]) for e in model.edges}
        for session in ("s0", "s1"):
            mine = {k: e for k, e in model.endpoints.items() if k[0] == session}
            held = json.loads(document(spark, out / "map", session))
            assert list(held) == [f"{k[1]} {k[2]}" for k, e in sorted(mine.items(), key=lambda x: x[1]["first_seq"])]
            for (_, method, path), e in mine.items():
                assert held[f"{method} {path}"]["response_statuses"] == sorted(e["statuses"])
                assert len(held[f"{method} {path}"]["sample_payloads"]) == len(e["samples"])
            api = json.loads(document(spark, out / "api", session))
            assert api["openapi"] == "3.0.0" and api["info"] == {"title": "T", "version": "1.0"}
            assert {(m.upper(), p) for p, ops in api["paths"].items() for m in ops} == {k[1:] for k in mine}
            for (s, method, path), (ctype, _) in model.requests_fold.items():
                if s == session:
                    body = api["paths"][path][method.lower()].get("requestBody")
                    assert (list(body["content"])[0] if body else None) == ctype
            report = document(spark, out / "report", session).split("\n")
            assert report[:2] == ["# Investigation Report", "**Target URL:** `https://t`  "]
            assert sum(line.startswith("### `") for line in report) == len(mine)
            assert ("graph TD" in report) == any(e[0] == session for e in model.edges)


def test_network_log_masks_credentials_and_flags_blocked(spark):
    row = ("s", 1, "r", "request", None, "xhr", "get", "https://www.facebook.com/x", {"Authorization": "secret", "a": "b"}, "{}", None)
    log = network_log(frame(spark, [row]), "v1").first()
    assert log.headers == {"Authorization": "***", "a": "b"} and log.block_reason == "tracker" and log.body_is_json is False
    assert network_log(frame(spark, [row]), "v1", drop_blocked=True).count() == 0
    assert network_log(frame(spark, [row]), "v1", mask=False).first().headers["Authorization"] == "secret"


def test_client_spec_marks_clashing_names(spark):
    rows = [("s", i, f"r{i}", "request", None, "xhr", "GET", f"https://h{p}", {"content-type": "application/json", ":x": "1", "Host": "h"}, b, None)
            for i, (p, b) in enumerate([("/a/b", '{"k":1}'), ("/a_b", "[1]"), ("/c", None)])]
    for profile, bodies in (("v1", ['{"k":1}', "[1]", None]), ("v2", ['{"k":1}', None, None])):
        spec = C.client_spec(C.endpoint_catalog(frame(spark, rows), profile), profile).orderBy("first_seq").collect()
        assert [(r.fn_name, r.name_clash, r.body) for r in spec] == list(zip(["get_a_b", "get_a_b", "get_c"], [True, True, False], bodies))
        assert spec[0].headers == {"content-type": "application/json"}


def test_pairing_fills_only_bare_responses(spark):
    rows = [("s", 1, "r1", "request", None, "xhr", "GET", "https://h/a", {}, None, None),
            ("s", 2, "r1", "response", None, None, None, None, {}, "{}", 200),
            ("s", 3, "r9", "response", None, "xhr", "PUT", "https://h/z", {}, "{}", 201)]
    got = {r.seq: (r.method, r.url, r.resource_type) for r in pair_responses(frame(spark, rows)).collect()}
    assert got == {1: ("GET", "https://h/a", "xhr"), 2: ("GET", "https://h/a", "xhr"), 3: ("PUT", "https://h/z", "xhr")}


def test_traces_pages_and_listeners(spark, tmp_path):
    def feed(name, schema, rows):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.json").write_text("\n".join(json.dumps(dict(zip([f.name for f in schema], r))) for r in rows))
        return str(tmp_path / name)

    mutations = T.mutation_log(sources.read_mutations(spark, feed("m", schemas.MUTATIONS, [
        ("s", 1500, "childList", "", "c", "DIV", None), ("s", 1600, "attributes", "i", "c", "DIV", 2), ("s", 1700, "attributes", "", "", "P", 1)])))
    calls = T.call_log(sources.read_calls(spark, feed("c", schemas.CALLS, [("s", "f", "[1]", "2", 10), ("s", "g", "[]", "null", 20)])), ["f"])
    listeners = T.listener_map(sources.read_listeners(spark, feed("l", schemas.LISTENERS, [
        ("s", 1, "a", "c", "P", ["click"]), ("s", 2, "", "c", "P", ["blur"]), ("s", 3, "a", "", "P", ["input", "change"]), ("s", 4, None, None, "P", ["x"])])))
    sinks.write_traces(calls, mutations, str(tmp_path / "traces"))
    sinks.write_listeners(listeners, str(tmp_path / "listeners"))
    assert [(r.target_id, r.added_nodes) for r in rows_of(spark, tmp_path / "traces" / "dom_mutations")] == [("c", 0), ("i", 2)]
    assert [(r.function, r.arguments) for r in rows_of(spark, tmp_path / "traces" / "function_calls")] == [("f", "[1]")]
    assert {r.selector: r.events for r in rows_of(spark, tmp_path / "listeners")} == {"#a": ["input", "change"], ".c": ["blur"], "P": ["x"]}

    (tmp_path / "html").mkdir()
    (tmp_path / "html" / "p.html").write_text("<select id=k><option value=1>One</select>\n<p>é")
    files = sources.read_html_files(spark, str(tmp_path / "html")).withColumn("session_id", F.lit("s")).withColumn("page_id", F.lit(1).cast("long"))
    sinks.write_catalogs(D.dropdown_catalog(D.page_elements(files)), str(tmp_path / "catalogs"))
    assert [(r.key, r.options[0].label) for r in rows_of(spark, tmp_path / "catalogs")] == [("k", "One")]
    sinks.write_dom(D.dom_snapshot(D.frame_data(D.page_elements(files.withColumn("frame_index", F.lit(0))))), str(tmp_path / "dom"))
    assert len(rows_of(spark, tmp_path / "dom")) == 1
    files.write.parquet(str(tmp_path / "pages"))
    pages = sources.read_pages(spark, str(tmp_path / "pages"))
    assert pages.first().frame_index == 0 and pages.first().html.endswith("é")
    sinks.write_pages(pages.select("session_id", F.lit("step_001_000000").alias("step_name"), "html"), str(tmp_path / "offline"))
    assert spark.read.parquet(str(tmp_path / "offline")).count() == 1
