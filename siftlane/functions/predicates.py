"""Filters on capture events, as boolean columns.

Lists of fragments become one regular expression of quoted literals.  An OR of ``contains``
would repeat its operand per fragment, and where that is itself an expression (the host of a
URL) code generation evaluates it again each time.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftlane.functions.urls import url_host, url_path


def _literals(texts: Iterable[str]) -> str:
    return "(?:" + "|".join(f"\\Q{t}\\E" for t in texts) + ")"


def contains_any(text: Column, fragments: Iterable[str]) -> Column:
    fragments = list(fragments)
    return text.rlike(_literals(fragments)) if fragments else F.lit(False)


def ends_with_any(text: Column, endings: Iterable[str]) -> Column:
    endings = list(endings)
    return text.rlike(_literals(endings) + r"\z") if endings else F.lit(False)


def is_tracker(url: Column, domains: Iterable[str]) -> Column:
    """Host contains a listed domain (substring, as the capture rule says)."""
    return contains_any(url_host(F.lower(url)), domains)


def is_static(url: Column, extensions: Iterable[str]) -> Column:
    return ends_with_any(url_path(F.lower(url)), extensions)


def block_reason(url: Column, domains: Iterable[str], extensions: Iterable[str]) -> Column:
    """``'tracker'``, ``'static'`` or null; trackers are tested first."""
    return (F.when(is_tracker(url, domains), F.lit("tracker"))
            .when(is_static(url, extensions), F.lit("static")))


def is_noise(url: Column, fragments: Iterable[str]) -> Column:
    """URL contains a listed fragment (case-sensitive)."""
    return contains_any(url, fragments)


def of_type(resource_type: Column, types: Iterable[str]) -> Column:
    return resource_type.isin(*types)


def not_preflight(method: Column) -> Column:
    """Raw method differs from ``OPTIONS``; lower-case methods pass."""
    return method != "OPTIONS"


def is_json_content_type(headers: Column) -> Column:
    """The content type names JSON; header names count in any case."""
    named = F.map_values(F.map_filter(headers, lambda k, v: F.lower(k) == "content-type"))
    return F.coalesce(F.exists(named, lambda v: F.lower(v).contains("application/json")), F.lit(False))


def clean_headers(headers: Column) -> Column:
    """Drop pseudo headers, ``content-length`` and ``host``."""
    return F.map_filter(
        headers, lambda k, v: ~k.startswith(":") & ~F.lower(k).isin("content-length", "host"))


def mask_secrets(headers: Column, names: Iterable[str] = ("authorization", "cookie", "set-cookie")) -> Column:
    """Replace the values of credential headers."""
    hidden = tuple(names)
    return F.transform_values(
        headers, lambda k, v: F.when(F.lower(k).isin(*hidden), F.lit("***")).otherwise(v))


def is_token_type(typ: Column) -> Column:
    """Only strings and integers take part in lineage; booleans do not."""
    return typ.isin("string", "int")


def token_length_ok(value: Column, shortest: int | None, longest: int | None) -> Column:
    """The length lies between the limits; None is no limit.  A null value never passes."""
    return F.length(value).between(shortest or 0, (1 << 31) - 1 if longest is None else longest)


def is_container(root_kind: Column) -> Column:
    return root_kind.isin("object", "array")


def has_mutation_target(el_id: Column, class_name: Column) -> Column:
    return (F.coalesce(el_id, F.lit("")) != "") | (F.coalesce(class_name, F.lit("")) != "")


def in_names(function: Column, names: Iterable[str]) -> Column:
    return function.isin(*names)
