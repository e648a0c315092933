"""JSON bodies: validity, truthiness and leaves.

Capture bodies follow Python's JSON rules (last duplicate key wins, document order kept,
``NaN`` accepted, trailing text rejected, integers of any size), which none of Spark's JSON
functions share.  Two Arrow UDFs cover this; both see a whole batch at a time and return
columnar arrays.  Texts that cannot be JSON are nulled on the JVM side first, so HTML pages
and forms never travel to Python.
"""

from __future__ import annotations

import json
import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Built from types: a DDL text would need a session at import time.
_FACTS = T.StructType([T.StructField("kind", T.StringType()), T.StructField("truthy", T.BooleanType())])
_LEAVES = "array<struct<ord int, path string, typ string, value string, root_kind string>>"
_KINDS = {dict: "object", list: "array", str: "string", bool: "boolean", int: "int", float: "float"}


def _parse(text):
    """(is_json, value)"""
    if text is None:
        return False, None
    try:
        return True, json.loads(text)
    except (ValueError, RecursionError):
        return False, None


def _printable(text: str) -> str:
    # JSON escapes can spell lone surrogates, which UTF-8 cannot carry.
    return text if text.isascii() else text.encode("utf-8", "ignore").decode("utf-8")


def walk_leaves(value, max_items: int | None):
    """Yield ``(path, leaf)`` in document order; arrays are cut per level."""
    stack = [("", value)]
    while stack:
        path, node = stack.pop()
        if isinstance(node, dict):
            children = [(f"{path}.{k}" if path else k, v) for k, v in node.items()]
            stack.extend(reversed(children))
        elif isinstance(node, list):
            children = [(f"{path}[{i}]", v) for i, v in enumerate(node[:max_items])]
            stack.extend(reversed(children))
        else:
            yield path, node


@F.arrow_udf(_FACTS)
def _json_facts(texts: pa.Array) -> pa.Array:
    kinds, truthy = [], []
    for text in texts.to_pylist():
        ok, value = _parse(text)
        kinds.append(_KINDS.get(type(value), "null") if ok else None)
        truthy.append(bool(value) if ok else None)
    return pa.StructArray.from_arrays(
        [pa.array(kinds, pa.string()), pa.array(truthy, pa.bool_())], names=["kind", "truthy"])


_json_facts = _json_facts.asNondeterministic()  # keeps Catalyst from evaluating it once per use


def _leaf_udf(max_items: int | None, types: tuple[str, ...] | None):
    @F.arrow_udf(_LEAVES)
    def leaves(texts: pa.Array, latest: pa.Array) -> pa.Array:
        offsets, ords, paths, kinds, values, roots = [0], [], [], [], [], []
        for text, only_latest in zip(texts.to_pylist(), latest.to_pylist()):
            ok, parsed = _parse(text)
            if ok:
                root = _KINDS.get(type(parsed), "null")
                found = []
                for ord_, (path, leaf) in enumerate(walk_leaves(parsed, max_items)):
                    kind = _KINDS.get(type(leaf), "null")
                    if types is None or kind in types:
                        found.append((ord_, path, kind, None if leaf is None else leaf if kind == "string"
                                      else json.dumps(leaf)))
                if only_latest:
                    found = list({row[3]: row for row in found}.values())
                for ord_, path, kind, value in found:
                    ords.append(ord_)
                    paths.append(_printable(path))
                    kinds.append(kind)
                    values.append(value and _printable(value))
                    roots.append(root)
            offsets.append(len(ords))
        rows = pa.StructArray.from_arrays(
            [pa.array(ords, pa.int32()), pa.array(paths, pa.string()), pa.array(kinds, pa.string()),
             pa.array(values, pa.string()), pa.array(roots, pa.string())],
            names=["ord", "path", "typ", "value", "root_kind"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)

    return leaves


def maybe_json(text: Column) -> Column:
    """The text if its first character can start a JSON value, else null."""
    return F.when(text.rlike(r'^[ \t\r\n]*[\[{"\-0-9tfnNI]'), text)


def maybe_container(text: Column) -> Column:
    """The text if it can be a JSON object or array, else null."""
    return F.when(text.rlike(r"^[ \t\r\n]*[\[{]"), text)


def json_facts(text: Column) -> Column:
    """``struct(kind, truthy)``; both null if the text is not JSON.

    ``kind`` is object, array, string, int, float, boolean or null; ``truthy`` is false
    for empty containers, empty strings, zero, false and null.
    """
    return _json_facts(maybe_json(text))


def leaf_array(text: Column, max_items: int | None = 10, types: tuple[str, ...] | None = None,
               latest: Column | None = None) -> Column:
    """Array of leaves ``(ord, path, typ, value, root_kind)`` in document order.

    Where ``latest`` is true, only the last leaf of each value is kept.
    """
    return _leaf_udf(max_items, types)(text, F.lit(False) if latest is None else latest)


def _finite(text: str) -> float | None:
    number = float(text)
    return number if math.isfinite(number) else None


def _canonical_udf(indent: int | None):
    @F.arrow_udf("string")
    def canonical(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            ok, _ = _parse(text)
            # JSON has no NaN and no infinity: both become null
            value = json.loads(text, parse_constant=lambda _: None, parse_float=_finite) if ok else None
            out.append(_printable(json.dumps(value, indent=indent, ensure_ascii=False)) if ok else None)
        return pa.array(out, pa.string())

    return canonical


def canonical_json(text: Column, indent: int | None = None) -> Column:
    """JSON text re-written from its value: duplicate keys resolved, NaN and infinities as null; null if it is not JSON."""
    return _canonical_udf(indent)(text)
