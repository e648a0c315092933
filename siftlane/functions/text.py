"""Small text, key and time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _non_empty(col: Column) -> Column:
    return F.when(col != "", col)


def fn_name(method: Column, path: Column) -> Column:
    """Identifier for an endpoint: ``get_users_17`` for ``GET /users/17``."""
    label = F.concat(F.lower(method), F.lit("_"), F.regexp_replace(path, r"^/+|/+\z", ""))
    return F.regexp_replace(label, r"[^a-zA-Z0-9_]+", "_")


def token_hash(value: Column) -> Column:
    return F.sha1(value)


def content_hash(value: Column) -> Column:
    return F.md5(value)


def leading(text: Column, size: int | None) -> Column:
    """The first ``size`` characters; all of them for None."""
    return text if size is None else F.substring(text, 1, size)


def text_sample(text: Column, size: int | None = 500) -> Column:
    """Leading text followed by an ellipsis, which is added in any case."""
    return F.concat(leading(text, size), F.lit("..."))


def js_trim(text: Column) -> Column:
    """Trim the white space that browsers trim, line separators and no-break space included."""
    return F.regexp_replace(text, r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+\z", "")


def picker_text(text: Column, size: int | None = 150) -> Column:
    return leading(js_trim(text), size)


def request_content_type(json_kind: Column) -> Column:
    return (F.when(json_kind.isin("object", "array"), F.lit("application/json"))
            .otherwise(F.lit("application/x-www-form-urlencoded")))


def response_content_type(json_kind: Column) -> Column:
    return (F.when(json_kind.isin("object", "array"), F.lit("application/json"))
            .otherwise(F.lit("text/html")))


def mutation_target(el_id: Column, class_name: Column, tag: Column) -> Column:
    return F.coalesce(_non_empty(el_id), _non_empty(class_name), tag)


def selector_key(el_id: Column, class_name: Column, tag: Column) -> Column:
    """``#id``, else ``.class``, else the tag name."""
    return F.coalesce(F.concat(F.lit("#"), _non_empty(el_id)),
                      F.concat(F.lit("."), _non_empty(class_name)), tag)


def epoch_ms(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def step_name(n: Column, ts: Column) -> Column:
    return F.format_string("step_%03d_%s", n, F.date_format(ts, "HHmmss"))


def cookie_map(cookies: Column) -> Column:
    """``a=1; b=2`` as a map; later duplicates win, as in the browser's own jar."""
    pairs = F.transform(
        F.filter(F.split(cookies, r"; ?"), lambda p: p != ""),
        lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"),
                           F.when(p.contains("="), F.regexp_replace(p, r"^[^=]*=", "")).alias("v")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(
        names, F.transform(names, lambda n: F.element_at(F.filter(pairs, lambda p: p["k"] == n), -1)["v"]))


def status_text(statuses: Column) -> Column:
    """Comma-separated statuses, ``None`` if there are none."""
    joined = F.array_join(F.transform(statuses, lambda s: s.cast("string")), ", ")
    return F.when(F.coalesce(joined, F.lit("")) == "", F.lit("None")).otherwise(joined)


def json_quote(text: Column) -> Column:
    """JSON string literal of a text; ``null`` for a null."""
    array_text = F.to_json(F.array(text))
    return F.when(text.isNull(), F.lit("null")).otherwise(
        F.substring(array_text, F.lit(2), F.length(array_text) - 2))
