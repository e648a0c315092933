"""Forms, fields, options and pickers of HTML pages.

``page_elements`` parses each page once; every other operator is array work inside the page's
row, or a projection of it, so nothing here shuffles except ``dom_snapshot`` (frames of one
page, grouped on narrow results).  Subtrees are array slices (``ord`` .. ``last_ord``), which
keeps nested lookups linear in the page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlane.functions import text as X
from siftlane.functions.html import element_array

# --- Fixed values of the HTML standard ------------------------------------------------

INPUT_TYPES = (
    "hidden", "text", "search", "tel", "url", "email", "password", "date", "month", "week", "time",
    "datetime-local", "number", "range", "color", "checkbox", "radio", "file", "submit", "image",
    "reset", "button",
)
BUTTON_TYPES = ("submit", "reset", "button")
FORM_METHODS = ("get", "post", "dialog")

# --- Fixed values of the capture rules ------------------------------------------------

FORM_FIELDS = ("input", "select", "textarea", "button")
LOOSE_FIELDS = ("input", "select", "textarea")
PICKER_ROLES = ("combobox", "listbox")
PICKER_CLASSES = ("select", "dropdown")

# --- End of fixed values --------------------------------------------------------------


def page_elements(pages: DataFrame, text_tags: tuple[str, ...] = ("option", "textarea"),
                  text_roles: tuple[str, ...] = PICKER_ROLES,
                  text_classes: tuple[str, ...] = PICKER_CLASSES, error: str | None = None) -> DataFrame:
    """Replace ``html`` by ``els``, the page's element array; ``url`` resolves addresses.

    With ``error`` a page that cannot be read does not end the job: its ``els`` are null and the
    column of that name says why.
    """
    kept = [c for c in pages.columns if c != "html"]
    els = element_array(F.col("html"), F.col("url"), text_tags, text_roles, text_classes, error is not None)
    if error is None:
        return pages.select(*kept, els.alias("els"))
    return pages.select(*kept, els.alias("__read")).select(*kept, "__read.els", F.col("__read.error").alias(error))


def unread_frames(parsed: DataFrame, error: str = "error", key: tuple[str, ...] = ("session_id", "page_id")) -> DataFrame:
    """Pages with frames that failed: how many, the first of them and why it failed.

    ``parsed`` comes from ``page_elements`` with ``error``.  Frames without a text have no elements either, but did not fail.
    """
    failed = parsed.where(F.col(error).isNotNull())
    return failed.groupBy(*key).agg(F.count("*").alias("unread"), F.min("frame_index").alias("frame_index"), F.min_by(error, "frame_index").alias(error))


def elements(parsed: DataFrame) -> DataFrame:
    """One row per element."""
    kept = [c for c in parsed.columns if c != "els"]
    return parsed.select(*kept, F.inline("els"))


def _attr(el: Column, name: str) -> Column:
    return F.try_element_at(el["attrs"], F.lit(name))


def _or_null(value: Column) -> Column:
    return F.when(value != "", value)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once; lambdas do not share subexpressions."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _subtree(el: Column) -> Column:
    return F.slice(F.col("els"), el["ord"] + 2, el["last_ord"] - el["ord"])


def _hits(els: Column, test) -> Column:
    """Matching live elements: light tree first, then shadow content by host."""
    def in_hit_order(found: Column) -> Column:
        # Page order already is hit order unless shadow content is present.
        return F.when(F.exists(found, lambda e: F.size(e["hosts"]) > 0),
                      F.array_sort(found, _by_hosts_then_ord)).otherwise(found)

    return _let(F.filter(els, lambda e: ~e["inert"] & test(e)), in_hit_order)


def _by_hosts_then_ord(a: Column, b: Column) -> Column:
    return (F.when(a["hosts"] < b["hosts"], -1).when(a["hosts"] > b["hosts"], 1)
            .when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).otherwise(0))


def _field_type(e: Column) -> Column:
    stated = F.lower(F.coalesce(_attr(e, "type"), F.lit("")))
    return (F.when(e["tag"] == "select",
                   F.when(_attr(e, "multiple").isNotNull(), F.lit("select-multiple")).otherwise(F.lit("select-one")))
            .when(e["tag"] == "textarea", F.lit("textarea"))
            .when(e["tag"] == "button", F.when(stated.isin(*BUTTON_TYPES), stated).otherwise(F.lit("submit")))
            .otherwise(F.when(stated.isin(*INPUT_TYPES), stated).otherwise(F.lit("text"))))


def _option_text(e: Column) -> Column:
    return F.regexp_replace(X.js_trim(F.coalesce(e["text"], F.lit(""))), r"\s+", " ")


def _options(select: Column) -> Column:
    """Options of a select as ``(value, text, selected)``.

    A single-choice list shows its last marked option, or else its first enabled one.
    """
    raw = F.transform(
        F.filter(_subtree(select), lambda o: (o["tag"] == "option") & ~o["inert"]),
        lambda o: F.struct(F.coalesce(_attr(o, "value"), _option_text(o)).alias("value"),
                           _option_text(o).alias("text"),
                           _attr(o, "selected").isNotNull().alias("marked"),
                           _attr(o, "disabled").isNotNull().alias("disabled")))
    many = _attr(select, "multiple").isNotNull()
    shown_rows = F.coalesce(F.try_to_number(_attr(select, "size"), F.lit("99999")), F.lit(1))

    def chosen(options: Column) -> Column:
        spots = F.transform(options, lambda o, i: F.when(o["marked"], i))
        enabled = F.transform(options, lambda o, i: F.when(~o["disabled"], i))
        return F.coalesce(F.array_max(spots), F.when(shown_rows <= 1, F.array_min(enabled)), F.lit(-1))

    def shown(options: Column, choice: Column) -> Column:
        return F.transform(options, lambda o, i: F.struct(
            o["value"].alias("value"), o["text"].alias("text"),
            F.when(many, o["marked"]).otherwise(i == choice).alias("selected")))

    return _let(raw, lambda options: _let(chosen(options), lambda choice: shown(options, choice)))


def _field(e: Column) -> Column:
    def built(typ: Column, options: Column) -> Column:
        ticked, is_select = typ.isin("checkbox", "radio"), e["tag"] == "select"
        value = (F.when(ticked, F.coalesce(_attr(e, "value"), F.lit("on")))
                 .when(is_select, F.lit(None).cast("string"))
                 .when(e["tag"] == "textarea", F.regexp_replace(F.coalesce(e["text"], F.lit("")), r"\A\r?\n", ""))
                 .otherwise(F.coalesce(_attr(e, "value"), F.lit(""))))
        return F.struct(
            e["ord"].alias("ord"), e["tag"].alias("tag"), typ.alias("type"),
            _or_null(_attr(e, "name")).alias("name"), _or_null(_attr(e, "id")).alias("id"),
            _or_null(_attr(e, "placeholder")).alias("placeholder"),
            (_attr(e, "required").isNotNull() & (e["tag"] != "button")).alias("required"),
            _attr(e, "disabled").isNotNull().alias("disabled"),
            options.alias("options"), F.when(is_select, F.size(options)).alias("options_count"),
            value.alias("value"), F.when(ticked, _attr(e, "checked").isNotNull()).alias("checked"))

    parts = F.struct(_field_type(e).alias("type"), F.when(e["tag"] == "select", _options(e)).alias("options"))
    return _let(parts, lambda p: built(p["type"], p["options"]))


def _form_array() -> Column:
    def form(f: Column, index: Column) -> Column:
        method = F.lower(F.coalesce(_attr(f, "method"), F.lit("")))
        return F.struct(
            index.alias("index"), _or_null(_attr(f, "id")).alias("id"), _or_null(_attr(f, "name")).alias("name"),
            F.coalesce(f["target"], F.col("url")).alias("action"),
            F.upper(F.when(method.isin(*FORM_METHODS), method).otherwise(F.lit("get"))).alias("method"),
            F.transform(_hits(_subtree(f), lambda e: e["tag"].isin(*FORM_FIELDS)), _field).alias("fields"))

    return F.transform(_hits(F.col("els"), lambda e: e["tag"] == "form"), form)


def forms(parsed: DataFrame) -> DataFrame:
    """One row per form: ``index, id, name, action, method, fields``.

    A form without action submits to the page's ``url``.
    """
    kept = [c for c in parsed.columns if c != "els"]
    return parsed.select(*kept, F.inline(_form_array()))


def form_fields(forms_df: DataFrame) -> DataFrame:
    """One row per field of a form; ``form_index`` names the form."""
    out = ("index", "id", "name", "action", "method", "fields")
    kept = [c for c in forms_df.columns if c not in out]
    return forms_df.select(*kept, F.col("index").alias("form_index"), F.inline("fields"))


def select_options(fields: DataFrame) -> DataFrame:
    """One row per option of a select; ``position`` counts from 0."""
    kept = [c for c in fields.columns if c not in ("options", "value")]
    return (fields.where(F.col("tag") == "select")
            .select(*kept, F.posexplode("options").alias("position", "o"))
            .select(*kept, "position", "o.value", "o.text", "o.selected"))


def _loose_array() -> Column:
    loose = F.filter("els", lambda e: ~e["inert"] & e["tag"].isin(*LOOSE_FIELDS)
                     & e["form_ord"].isNull() & (F.size(e["hosts"]) == 0))
    return F.transform(loose, _field)


def standalone_inputs(parsed: DataFrame) -> DataFrame:
    """Inputs, selects and text areas of the light tree that no form encloses."""
    kept = [c for c in parsed.columns if c != "els"]
    return parsed.select(*kept, F.inline(_loose_array()))


def _dataset(attrs: Column) -> Column:
    """``data-*`` attributes under their script names (``data-a-b`` becomes ``aB``)."""
    def camel(name: Column) -> Column:
        parts = F.split(F.substring(name, F.lit(6), F.length(name)), "-")
        rest = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.when(
            p.rlike("^[a-z]"), F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p))))
            .otherwise(F.concat(F.lit("-"), p)))
        return F.concat(parts[0], F.array_join(rest, ""))

    return F.transform_keys(F.map_filter(attrs, lambda k, v: k.startswith("data-")), lambda k, v: camel(k))


def _picker_array(roles: tuple[str, ...], class_substrings: tuple[str, ...], text_size: int | None = 150) -> Column:
    def test(e: Column) -> Column:
        hit = F.coalesce(_attr(e, "role").isin(*roles), F.lit(False)) if roles else F.lit(False)
        for fragment in class_substrings:
            hit |= F.coalesce(_attr(e, "class").contains(fragment), F.lit(False))
        return hit

    def picker(e: Column, index: Column) -> Column:
        return F.struct(
            index.alias("index"), e["tag"].alias("tag"), _attr(e, "role").alias("role"),
            _or_null(_attr(e, "id")).alias("id"), _or_null(_attr(e, "name")).alias("name"),
            _or_null(_attr(e, "class")).alias("class_name"),
            X.picker_text(F.coalesce(e["text"], F.lit("")), text_size).alias("current_text"),
            _dataset(e["attrs"]).alias("dataset"))

    return F.transform(_hits(F.col("els"), test), picker)


def custom_pickers(parsed: DataFrame, roles: tuple[str, ...] = PICKER_ROLES,
                   class_substrings: tuple[str, ...] = PICKER_CLASSES, text_size: int | None = 150) -> DataFrame:
    """Elements that act as pickers, by role or class fragment; ``text_size`` (None: no limit) cuts their text.

    Parse the pages with the same roles and fragments, else ``current_text`` is empty.
    """
    kept = [c for c in parsed.columns if c != "els"]
    return parsed.select(*kept, F.inline(_picker_array(roles, class_substrings, text_size)))


def dropdown_catalog(parsed: DataFrame) -> DataFrame:
    """One row per page and select key: ``options ARRAY<STRUCT<id,label>>``.

    The key is the id, else the name; of selects that share a key the last one wins.
    """
    def entry(s: Column) -> Column:
        return F.struct(
            F.coalesce(_or_null(_attr(s, "id")), _or_null(_attr(s, "name"))).alias("key"),
            F.transform(_options(s), lambda o: F.struct(o["value"].alias("id"), o["text"].alias("label"))).alias("options"))

    light = F.filter("els", lambda e: (e["tag"] == "select") & ~e["inert"] & (F.size(e["hosts"]) == 0))
    kept = [c for c in parsed.columns if c != "els"]
    keyed = parsed.select(*kept, F.filter(F.transform(light, entry), lambda x: x["key"].isNotNull()).alias("entries"))
    names = F.array_distinct(F.transform("entries", lambda x: x["key"]))
    last = F.transform(names, lambda n: F.element_at(F.filter("entries", lambda x: x["key"] == n), -1))
    return keyed.select(*kept, F.inline(last))


def link_catalog(parsed: DataFrame) -> DataFrame:
    """Anchors with a target, as ``(id, label)`` like a dropdown entry; parse text of ``a``."""
    kept = [c for c in parsed.columns if c != "els"]
    anchors = F.filter("els", lambda e: (e["tag"] == "a") & _attr(e, "href").isNotNull() & ~e["inert"])
    return parsed.select(*kept, F.inline(F.transform(anchors, lambda a: F.struct(
        a["ord"].alias("ord"), _attr(a, "href").alias("id"), X.js_trim(F.coalesce(a["text"], F.lit(""))).alias("label")))))


def frame_data(parsed: DataFrame) -> DataFrame:
    """Forms, standalone inputs and pickers of each frame as arrays in the frame's row.

    Frames that could not be read are dropped; the others keep their ``frame_index``.
    """
    kept = [c for c in parsed.columns if c != "els"]
    return parsed.where(F.col("els").isNotNull()).select(
        *kept, _form_array().alias("forms"), _loose_array().alias("standalone_inputs"),
        _picker_array(PICKER_ROLES, PICKER_CLASSES).alias("custom_pickers"))


def dom_snapshot(frames: DataFrame, key: tuple[str, ...] = ("session_id", "page_id")) -> DataFrame:
    """One row per page with its frames in ``frame_index`` order.

    The group is one page's frames, which a single browser page held at once.
    """
    frame = F.struct("frame_index", F.col("url").alias("frame_url"), "forms", "standalone_inputs", "custom_pickers")

    def by_index(a: Column, b: Column) -> Column:
        return (F.when(a["frame_index"] < b["frame_index"], -1)
                .when(a["frame_index"] > b["frame_index"], 1).otherwise(0))

    return frames.groupBy(*key).agg(F.array_sort(F.collect_list(frame), by_index).alias("frames"))


def snapshot_totals(frames: DataFrame, key: tuple[str, ...] = ("session_id", "page_id")) -> DataFrame:
    """Counts of frames, forms and pickers per page."""
    return frames.groupBy(*key).agg(
        F.count("*").alias("frames"), F.sum(F.size("forms")).alias("forms"),
        F.sum(F.size("custom_pickers")).alias("pickers"))


def with_storage(snapshots: DataFrame, storage: DataFrame, mask: bool = True) -> DataFrame:
    """Attach browser storage to snapshots; values are masked unless ``mask`` is off."""
    def hidden(c: str) -> Column:
        return F.transform_values(c, lambda k, v: F.lit("***")) if mask else F.col(c)

    cookies = F.when(F.col("cookies").isNotNull(), F.lit("***")) if mask else F.col("cookies")
    held = storage.select("session_id", "page_id", F.struct(
        hidden("local_storage").alias("local_storage"), hidden("session_storage").alias("session_storage"),
        cookies.alias("cookies")).alias("storage"))
    return snapshots.join(held, ["session_id", "page_id"], "left")


def frozen_values(fields: DataFrame, live: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Field rows with what the user had entered: live value and tick state over the attributes.

    The join is sorted and spills: Spark takes rows made from pages for as small as the stored pages, and would send all of them to every executor.
    """
    entered = live.select(*key, "live_value", "live_checked").hint("merge")
    return (fields.join(entered, list(key), "left")
            .withColumn("value", F.coalesce("live_value", "value"))
            .withColumn("checked", F.coalesce("live_checked", "checked"))
            .drop("live_value", "live_checked"))
