"""Fixed schemas of the capture envelope and the trace tables.

Payloads stay raw strings: their shape is free and is never inferred.
"""

from pyspark.sql import types as T

_STR_MAP = T.MapType(T.StringType(), T.StringType())


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


# One row per request or response; `seq` is the event order inside a session.
CAPTURE = _struct(
    ("session_id", T.StringType()),
    ("seq", T.LongType()),
    ("request_id", T.StringType()),
    ("kind", T.StringType()),
    ("ts", T.TimestampType()),
    ("resource_type", T.StringType()),
    ("method", T.StringType()),
    ("url", T.StringType()),
    ("headers", _STR_MAP),
    ("body", T.StringType()),
    ("status", T.IntegerType()),
)

# One row per frame of a captured page; `html` is null when the frame could not be read.
PAGES = _struct(
    ("session_id", T.StringType()),
    ("page_id", T.LongType()),
    ("ts", T.TimestampType()),
    ("frame_index", T.IntegerType()),
    ("url", T.StringType()),
    ("html", T.StringType()),
)

STORAGE = _struct(
    ("session_id", T.StringType()),
    ("page_id", T.LongType()),
    ("local_storage", _STR_MAP),
    ("session_storage", _STR_MAP),
    ("cookies", T.StringType()),
)

MUTATIONS = _struct(
    ("session_id", T.StringType()),
    ("time", T.LongType()),
    ("type", T.StringType()),
    ("id", T.StringType()),
    ("class_name", T.StringType()),
    ("tag", T.StringType()),
    ("added_nodes", T.IntegerType()),
)

CALLS = _struct(
    ("session_id", T.StringType()),
    ("function", T.StringType()),
    ("arguments", T.StringType()),
    ("returned", T.StringType()),
    ("timestamp", T.LongType()),
)

LISTENERS = _struct(
    ("session_id", T.StringType()),
    ("ord", T.LongType()),
    ("el_id", T.StringType()),
    ("class_name", T.StringType()),
    ("tag", T.StringType()),
    ("events", T.ArrayType(T.StringType())),
)

STYLESHEETS = _struct(("url", T.StringType()), ("css", T.StringType()))
