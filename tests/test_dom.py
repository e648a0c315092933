import pytest
from pyspark.sql import functions as F

from siftlane import schemas
from siftlane.operators import dom as D
from siftlane.operators import offline as O
from siftlane.operators.ordered import changed_only

PAGE = """<!DOCTYPE html><html><head><title>a <b>no tag</title><link rel="stylesheet" href="/css/a.css">
<link rel=stylesheet href="b.css"><script>var x = "<form><input>";</script></head><body>
<!-- <form id=hidden></form> -->
<form id=f1 action="/go?x=1" method=post><input name=who required placeholder="Name &amp; co"><select id=s1 name=n1>
<option value=1>One<option value=2 selected> Two  words <option disabled>Three</select>
<select name=multi multiple><optgroup label=g><option selected>A</option><option selected>B</option></optgroup></select>
<input type=checkbox name=c checked value=yes><input type=RADIO name=r disabled><input type=odd name=o value=5>
<textarea name=t>
first &lt;b&gt;</textarea><button name=b>Go</button><form id=nested></form></form>
<form method=put><button type=reset></button></form>
<p>one<p>two<div role=combobox class="my-select" data-foo-bar="1" data-x="2" name=pick>  pick <b>me</b> </div>
<ul role=listbox><li>x<li>y</ul><input name=loose><button>no</button><select name=n1><option>last</select>
<select id=s1><option value=9>Nine</select><select><option>keyless</select>
<my-x><template shadowrootmode=open><form id=shadow><input name=inner></form><input name=shadowloose></template></my-x>
<template><form id=inert><input name=dead></form></template></body></html>"""
FRAMES = [("s", 1, 0, "https://h.example/a/b", PAGE), ("s", 1, 1, "https://h.example/f", None),
          ("s", 1, 2, "https://h.example/g", "<base href='/deep/x/'><form action=y></form><p>hi"), ("s", 2, 0, "https://h.example/", "")]


@pytest.fixture(scope="module")
def parsed(spark):
    frames = spark.createDataFrame(FRAMES, "session_id string, page_id long, frame_index int, url string, html string")
    return D.page_elements(frames).cache()


def test_forms(parsed):
    rows = [(r.frame_index, r['index'], r.id, r.action, r.method, [f.name for f in r.fields]) for r in D.forms(parsed).collect()]
    assert rows == [
        (0, 0, "f1", "https://h.example/go?x=1", "POST", ["who", "n1", "multi", "c", "r", "o", "t", "b"]),
        (0, 1, None, "https://h.example/a/b", "GET", [None]),
        (0, 2, "shadow", "https://h.example/a/b", "GET", ["inner"]),
        (2, 0, None, "https://h.example/deep/x/y", "GET", [])]


def test_fields(parsed):
    fields = {r.name: r for r in D.form_fields(D.forms(parsed)).where("frame_index = 0 and form_index = 0").collect()}
    assert {n: f.type for n, f in fields.items()} == {
        "who": "text", "n1": "select-one", "multi": "select-multiple", "c": "checkbox", "r": "radio", "o": "text", "t": "textarea", "b": "submit"}
    assert (fields["who"].required, fields["who"].placeholder, fields["who"].value) == (True, "Name & co", "")
    assert (fields["c"].value, fields["c"].checked, fields["r"].value, fields["r"].checked, fields["r"].disabled) == ("yes", True, "on", False, True)
    assert (fields["o"].value, fields["t"].value, fields["n1"].value, fields["n1"].options_count) == ("5", "first <b>", None, 3)
    assert fields["who"].options is None and fields["who"].checked is None


def test_options(parsed):
    rows = D.select_options(D.form_fields(D.forms(parsed))).where("frame_index = 0").collect()
    assert [(r.name, r.position, r.value, r.text, r.selected) for r in rows] == [
        ("n1", 0, "1", "One", False), ("n1", 1, "2", "Two words", True), ("n1", 2, "Three", "Three", False),
        ("multi", 0, "A", "A", True), ("multi", 1, "B", "B", True)]


def test_standalone_inputs_leave_out_buttons_forms_and_shadow_content(parsed):
    rows = D.standalone_inputs(parsed).collect()
    assert [(r.tag, r.name, r.id) for r in rows] == [
        ("input", "loose", None), ("select", "n1", None), ("select", None, "s1"), ("select", None, None)]


def test_pickers(parsed):
    rows = D.custom_pickers(parsed).collect()
    assert [(r['index'], r.tag, r.role, r.name, r.class_name, r.current_text, r.dataset) for r in rows] == [
        (0, "div", "combobox", "pick", "my-select", "pick me", {"fooBar": "1", "x": "2"}), (1, "ul", "listbox", None, None, "xy", {})]


def test_dropdown_catalog_keeps_the_last_of_a_key(parsed):
    rows = D.dropdown_catalog(parsed).collect()
    assert {r.key: [tuple(o) for o in r.options] for r in rows} == {
        "s1": [("9", "Nine")], "multi": [("A", "A"), ("B", "B")], "n1": [("last", "last")]}


def test_snapshots_drop_unreadable_frames_and_keep_the_gap(parsed):
    frames = D.frame_data(parsed)
    pages = {r.page_id: r for r in D.dom_snapshot(frames).collect()}
    assert [f.frame_index for f in pages[1].frames] == [0, 2] and pages[1].frames[1].forms[0].action.endswith("/deep/x/y")
    totals = {r.page_id: (r.frames, r.forms, r.pickers) for r in D.snapshot_totals(frames).collect()}
    assert totals == {1: (2, 4, 2), 2: (1, 0, 0)}


def test_storage_is_masked_by_default(spark, parsed):
    storage = spark.createDataFrame([("s", 1, {"k": "v"}, {}, "a=1")], schemas.STORAGE)
    snaps = D.dom_snapshot(D.frame_data(parsed))
    assert D.with_storage(snaps, storage).where("page_id = 1").first().storage.asDict() == {"local_storage": {"k": "***"}, "session_storage": {}, "cookies": "***"}
    assert D.with_storage(snaps, storage, mask=False).where("page_id = 1").first().storage.cookies == "a=1"


def test_inline_css_replaces_known_sheets_only(spark, parsed):
    pages = spark.createDataFrame(FRAMES[:1], "session_id string, page_id long, frame_index int, url string, html string")
    sheets = spark.createDataFrame([("https://h.example/a/b.css", "p{q:url(../i.png)}")], "url string, css string")
    html = O.inline_css(pages, D.page_elements(pages), sheets).first().html
    assert html == PAGE.replace("<link rel=stylesheet href=\"b.css\">", "<style>p{q:url('https://h.example/i.png')}</style>")


def test_frozen_values(spark, parsed):
    fields = D.form_fields(D.forms(parsed)).where("frame_index = 0 and name in ('who', 'c')").select("page_id", "name", "value", "checked")
    live = spark.createDataFrame([(1, "who", "typed", None), (1, "c", None, False)], "page_id long, name string, live_value string, live_checked boolean")
    assert {(r.name, r.value, r.checked) for r in D.frozen_values(fields, live, ("page_id", "name")).collect()} == {("who", "typed", None), ("c", "yes", False)}


def test_frozen_values_are_not_broadcast(spark, tmp_path):
    """Live rows made from pages look as small as the stored pages to Spark, but grow with them; repeated and null keys give the rows of a left join."""
    fields = spark.createDataFrame([(1, "a", "old", False), (1, "b", None, None), (None, "a", "x", None)], "page_id long, name string, value string, checked boolean")
    live = spark.createDataFrame([(1, "a", "typed", None), (1, "a", None, True), (None, "a", "y", None)], "page_id long, name string, live_value string, live_checked boolean")
    live.write.parquet(f"{tmp_path}/live")
    rows = D.frozen_values(fields, spark.read.parquet(f"{tmp_path}/live"), ("page_id", "name"))
    assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, rows.collect()), key=str) == sorted(
        [(1, "a", "typed", False), (1, "a", "old", True), (1, "b", None, None), (None, "a", "x", None)], key=str)


def test_offline_pages_number_changed_states(spark):
    rows = [("s", i, f"2024-01-01 10:00:0{i}", "https://h/x", h) for i, h in enumerate(["<head>1", "<head>1", "2", "<head>1"])]
    states = spark.createDataFrame(rows, "session_id string, page_id long, at string, url string, html string").withColumn("ts", F.to_timestamp("at"))
    kept = changed_only(states, ["session_id"], "page_id", "html")
    out = O.offline_pages(kept).orderBy("step_name").collect()
    assert [r.step_name for r in out] == ["step_001_100000", "step_002_100002", "step_003_100003"]
    assert out[0].html == '<head>\n    <base href="https://h/x">1' and out[1].html == '<base href="https://h/x">\n2'


@pytest.mark.parametrize("page,tags", [
    ("<a href=x", []), ("<a title='it>s'>t</a>", ["a"]), ("<p don't>x</p><b>", ["p", "b"]), ("a < b <i>c", ["i"]),
    ("<!-- x <a> --><br/><A HREF=1>", ["br", "a"]), ("<style>p>a{}</style><u>", ["style", "u"]), ("<script>if (a<b) '</p>'</SCRIPT><u>", ["script", "u"]),
    ("<!-- never closed <a>", []), ("<table><tr><td>1<td>2<tr><td>3</table>", ["table", "tr", "td", "td", "tr", "td"])])
def test_markup_corner_cases(spark, page, tags):
    df = spark.createDataFrame([("u", page)], "url string, html string")
    assert [r.tag for r in D.elements(D.page_elements(df)).collect()] == tags


def test_subtree_intervals(spark):
    df = spark.createDataFrame([("u", "<table><tr><td>1<td>2<tr><td>3</table><ul><li>a<ul><li>b</ul><li>c</ul>")], "url string, html string")
    rows = D.elements(D.page_elements(df)).collect()
    assert [(r.tag, r.parent_ord, r.last_ord) for r in rows] == [
        ("table", None, 5), ("tr", 0, 3), ("td", 1, 2), ("td", 1, 3), ("tr", 0, 5), ("td", 4, 5),
        ("ul", None, 10), ("li", 6, 9), ("ul", 7, 9), ("li", 8, 9), ("li", 6, 10)]


def test_nested_texts_share_one_buffer():
    """Sixteen times the nested hits take no sixteen-squared times; each element still has all the text inside it."""
    import time
    from siftlane.functions.html import _ElementBatch

    def took(n):
        batch, began = _ElementBatch(lambda tag, attrs: tag == "button"), time.perf_counter()
        batch.add("<b><button>x" * n, "https://h/")
        assert [len(t) for t in batch.text[1::2]] == list(range(n, 0, -1))
        return time.perf_counter() - began

    assert took(8000) < 60 * max(took(1000), 0.01)


def test_a_page_that_fails_leaves_the_others(spark):
    bad = "<form id=x><p title='&#" + "9" * 5000 + ";'>"
    good = "<form id='{0}'><input name=a value='&amp;'><div role=listbox class=dropdown>{0}</div></form>"
    rows = [("s", 1, 0, "https://h/", good.format("a")), ("s", 1, 1, "https://h/", bad), ("s", 1, 2, None, good.format("c")), ("s", 1, 3, "https://h/", None),
            ("s", 2, 0, "https://h/", bad), ("s", 2, 1, "https://h/", bad), ("t", 3, 0, "https://h/", "")]
    pages = spark.createDataFrame(rows, "session_id string, page_id long, frame_index int, url string, html string").coalesce(1)
    parsed = D.page_elements(pages, error="why")
    frames = D.dom_snapshot(D.frame_data(parsed)).collect()
    assert {(r.page_id, f.frame_index): [x.id for x in f.forms] for r in frames for f in r.frames} == {(1, 0): ["a"], (1, 2): ["c"], (3, 0): []}
    alone = D.frame_data(D.page_elements(pages.where("html not like '%9999%'"))).drop("why").collect()
    assert sorted(map(str, D.frame_data(parsed).drop("why").collect())) == sorted(map(str, alone))
    unread = {r.page_id: (r.unread, r.frame_index, r.why.split(":")[0]) for r in D.unread_frames(parsed, "why").collect()}
    assert unread == {1: (1, 1, "ValueError"), 2: (2, 0, "ValueError")}
    with pytest.raises(Exception, match="ValueError"):
        D.page_elements(pages).collect()


def test_pages_are_parsed_a_few_at_a_time(monkeypatch):
    """A batch of 1,000 pages is never held as Python objects whole, and gives what its pages give one by one."""
    import pyarrow as pa
    from siftlane.functions import html as H
    most, plain = [], H._ElementBatch.to_arrow

    def counted(batch):
        most.append(len(batch.errors))
        return plain(batch)

    monkeypatch.setattr(H._ElementBatch, "to_arrow", counted)
    pages = pa.array([None if i % 7 == 0 else f"<form id=f{i}><input name=a></form>" for i in range(1000)])
    urls = pa.array([f"https://h/{i}" for i in range(1000)])
    every = H._parsed(pages, urls, lambda tag, attrs: False, True).to_pylist()
    assert max(most) <= H.PAGES_AT_ONCE < 1000 and sum(most) == 1000
    ones = [H._parsed(pages.slice(i, 1), urls.slice(i, 1), lambda tag, attrs: False, True).to_pylist()[0] for i in (0, 1, 255, 256, 511, 512, 999)]
    assert ones == [every[i] for i in (0, 1, 255, 256, 511, 512, 999)]
    assert H._parsed(pages.slice(0, 0), urls.slice(0, 0), lambda tag, attrs: False, False).to_pylist() == []
