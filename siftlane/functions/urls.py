"""URL parts as column expressions.

Spark's ``parse_url`` returns null for many URLs that browsers send (spaces, pipes,
underscores in hosts) and keeps path parameters, so the parts come from the generic URI
grammar instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCHEME = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?"
_NETLOC = _SCHEME + r"//([^/?#]*)"
_PATH = _SCHEME + r"(?://[^/?#]*)?([^?#]*)"


def _clean(url: Column) -> Column:
    # Tabs and line breaks are not part of a URL.
    return F.translate(url, "\t\r\n", "")


def url_path(url: Column) -> Column:
    """Path without query, fragment and the parameters of its last segment."""
    return F.regexp_replace(F.regexp_extract(_clean(url), _PATH, 1), r";[^/]*\z", "")


def url_netloc(url: Column) -> Column:
    return F.regexp_extract(_clean(url), _NETLOC, 1)


def url_host(url: Column) -> Column:
    """Lower-case host without user info and port; ``''`` if there is none."""
    host_port = F.regexp_replace(url_netloc(url), r"^.*@", "")
    bracketed = F.regexp_extract(host_port, r"\[([^\]]*)", 1)
    plain = F.substring_index(host_port, ":", 1)
    return F.lower(F.when(host_port.contains("["), bracketed).otherwise(plain))


def scope_domain(url: Column) -> Column:
    """Lower-case network location, port kept."""
    return F.lower(url_netloc(url))


def path_or_root(path: Column, root: str = "/") -> Column:
    return F.when(path == "", F.lit(root)).otherwise(path)


def normalise_target(url: Column) -> Column:
    """Trim and prefix ``https://`` unless the text already starts with ``http``."""
    trimmed = F.regexp_replace(url, r"^\s+|\s+\z", "")
    return F.when(trimmed.startswith("http"), trimmed).otherwise(F.concat(F.lit("https://"), trimmed))


def endpoint_path(url: Column, empty_path: str) -> Column:
    """Path as used in endpoint keys of a profile."""
    return path_or_root(url_path(url), empty_path) if empty_path else url_path(url)


def endpoint_label(method: Column, path: Column) -> Column:
    return F.concat_ws(" ", method, path)
