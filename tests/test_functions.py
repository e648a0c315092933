import json
from urllib.parse import urlparse

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftlane.functions import html as H
from siftlane.functions import predicates as P
from siftlane.functions import text as X
from siftlane.functions import urls as U
from siftlane.functions.bodies import canonical_json, json_facts
from siftlane.operators.leaves import json_leaves
from siftlane.profiles import PROFILES, STATIC_EXTENSIONS, TRACKER_DOMAINS


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first().x


URLS = ["https://h.example/a/b;jsessionid=1?q#f", "http://U:p@H.Example:8080", "https://h/x;y/z", "HTTPS://my_host.com/a b|c",
        "//cdn.example/x", "/only/path", "mailto:a@b", "https://[::1]:80/v6", "", "https://h?x=/y", "data:text/plain,x;y"]


def test_url_parts_follow_the_standard_parser(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "u string")
    for r in df.select("u", U.url_path(F.col("u")).alias("path"), U.url_host(F.col("u")).alias("host"),
                       U.scope_domain(F.col("u")).alias("domain")).collect():
        want = urlparse(r.u)
        if want.scheme not in ("mailto", "data"):
            assert r.path == want.path, r.u
        assert r.host == (want.hostname or ""), r.u
        assert r.domain == want.netloc.lower(), r.u


@pytest.mark.parametrize("url,want", [(" shop.example ", "https://shop.example"), ("http://x", "http://x"), ("httpbin.org", "httpbin.org")])
def test_normalise_target(spark, url, want):
    assert one(spark, U.normalise_target(F.col("u")), u=url) == want


@pytest.mark.parametrize("url,v1,v2", [
    ("https://notfacebook.com.example/x", "tracker", None), ("https://h/A.PNG", "static", None), ("https://h/A.MP4?x", "static", "static"),
    ("https://sentry.io/a.css", "tracker", None), ("https://h/x.css/y", None, None), ("https://h/a.wav", None, "static")])
def test_block_reason(spark, url, v1, v2):
    assert one(spark, P.block_reason(F.col("u"), TRACKER_DOMAINS, STATIC_EXTENSIONS), u=url) == v1
    p = PROFILES["v2"]
    assert one(spark, P.block_reason(F.col("u"), p.tracker_domains, p.static_extensions), u=url) == v2


def test_noise_is_case_sensitive(spark):
    noise = P.is_noise(F.col("u"), PROFILES["v2"].noise_fragments)
    assert one(spark, noise, u="https://h/events/log/1") is True
    assert one(spark, noise, u="https://h/Events/Log/1") is False


@pytest.mark.parametrize("body,kind,truthy", [
    ("{}", "object", False), ("[]", "array", False), ("0", "int", False), ("-0.0", "float", False), ('""', "string", False),
    ("null", "null", False), ("false", "boolean", False), ("[0]", "array", True), ('{"a":NaN}', "object", True), (" 5 ", "int", True),
    ('{"a":1} x', None, None), ("{'a':1}", None, None), ("", None, None), ("a=1", None, None), ("﻿{}", None, None)])
def test_json_facts(spark, body, kind, truthy):
    assert tuple(one(spark, json_facts(F.col("b")), b=body)) == (kind, truthy)


def test_leaf_paths_and_caps(spark):
    body = json.dumps({"a": {"b": [[1, {"c": "x"}]]}, "n": list(range(12)), "f": 1.5, "t": True, "z": None, "a.b": "dot"})
    rows = json_leaves(spark.createDataFrame([(1, body), (2, '"abc"'), (3, '[7,"\\ud800q"]')], "id long, body string")).collect()
    first = {r.path: (r.typ, r.value) for r in rows if r.id == 1}
    assert first["a.b[0][1].c"] == ("string", "x") and first["a.b"] == ("string", "dot")
    assert "n[9]" in first and "n[10]" not in first
    assert [first[k][0] for k in "ftz"] == ["float", "boolean", "null"]
    assert [(r.path, r.root_kind) for r in rows if r.id == 2] == [("", "string")]
    assert [(r.path, r.value) for r in rows if r.id == 3] == [("[0]", "7"), ("[1]", "q")]


_json = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=8),
                     lambda c: st.lists(c, max_size=12) | st.dictionaries(st.text(max_size=4), c, max_size=4), max_leaves=20)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(_json, min_size=20, max_size=40))
def test_leaves_of_random_json(spark, values):
    from events import _leaves
    rows = [(i, json.dumps(v)) for i, v in enumerate(values)]
    got = json_leaves(spark.createDataFrame(rows, "id long, body string"), types=("string", "int")).orderBy("id", "ord").collect()
    clean = lambda s: s.encode("utf-8", "ignore").decode()
    want = [(i, clean(p), clean(t)) for i, v in enumerate(values) for p, t in _leaves(v)]
    assert [(r.id, r.path, r.value) for r in got] == want


@pytest.mark.parametrize("page,want", [
    ("<html><head><head>", '<html><head>\n    <base href="U"><head>'), ("<HEAD></HEAD>", '<base href="U">\n<HEAD></HEAD>'), ("x", '<base href="U">\nx')])
def test_inject_base(spark, page, want):
    assert one(spark, H.inject_base(F.col("h"), F.col("u")), h=page, u="U") == want


def test_absolutise_css(spark):
    css = "a{b:url(x.png)} c{d:URL('/y.png')} e{f:url(\"../z.png\")} g{h:url(data:q)} i{j:url('https://k/l')}"
    assert one(spark, H.absolutise_css(F.col("c"), F.col("u")), c=css, u="https://h/css/a.css") == (
        "a{b:url('https://h/css/x.png')} c{d:url('https://h/y.png')} e{f:url('https://h/z.png')} g{h:url(data:q)} i{j:url('https://k/l')}")


def test_text_helpers(spark):
    assert one(spark, X.text_sample(F.col("t")), t="abc") == "abc..."
    assert one(spark, X.text_sample(F.col("t")), t="é" * 600) == "é" * 500 + "..."
    assert one(spark, X.picker_text(F.col("t")), t="  " + "x" * 200) == "x" * 150
    assert one(spark, X.fn_name(F.col("m"), F.col("p")), m="GET", p="/a-b//c.d/") == "get_a_b_c_d"
    assert one(spark, X.cookie_map(F.col("c")), c="a=1; b=2=3;a=9; flag") == {"a": "9", "b": "2=3", "flag": None}
    assert one(spark, X.json_quote(F.col("t")), t='a"é\n') == '"a\\"é\\n"'
    assert one(spark, canonical_json(F.col("t")), t='{"a":1,"a":"é"}') == '{"a": "é"}'
    assert one(spark, X.status_text(F.array(F.lit(200), F.lit(404))), t="") == "200, 404"
    assert one(spark, X.status_text(F.array().cast("array<int>")), t="") == "None"
    assert one(spark, X.selector_key(F.lit(""), F.lit("c d"), F.lit("P")), t="") == ".c d"
    assert one(spark, X.mutation_target(F.lit(None), F.lit(""), F.lit("P")), t="") == "P"


def test_headers(spark):
    held = F.create_map(*[F.lit(x) for x in (":path", "/", "Host", "h", "content-length", "1", "Cookie", "c", "x", "y")])
    assert one(spark, P.mask_secrets(P.clean_headers(held)), t="") == {"Cookie": "***", "x": "y"}
