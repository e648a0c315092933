"""SQL counterparts of the queries, for DuckDB.

They share the row-level derivations of ``derived`` and nothing else: paths, JSON kinds,
leaves, matches and folds are computed again in plain SQL.
"""

from __future__ import annotations

from siftlane.plans.derived import (
    CALLS, EVENT_CAPTURE, FORM_PAGES, LISTENERS, MUTATIONS, as_select,
)
from siftlane.profiles import MEDIA_EXTENSIONS, NOISE_FRAGMENTS, STATIC_EXTENSIONS, TRACKER_DOMAINS

ORACLES: dict[str, str] = {}


def _derived(exprs: dict[str, str], table: str) -> str:
    return f"SELECT {', '.join(as_select(exprs))} FROM {table}"


def _path(url: str) -> str:
    return (f"regexp_replace(regexp_extract({url}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), "
            "';[^/]*$', '')")


def _netloc(url: str) -> str:
    return f"regexp_extract({url}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)"


def _host(url: str) -> str:
    return f"lower(regexp_replace(regexp_replace({_netloc(url)}, '^.*@', ''), ':[0-9]*$', ''))"


def _root(path: str) -> str:
    return f"CASE WHEN {path} = '' THEN '/' ELSE {path} END"


def _noise(url: str) -> str:
    return "(" + " OR ".join(f"contains({url}, '{f}')" for f in NOISE_FRAGMENTS) + ")"


def _endings(extensions: tuple[str, ...]) -> str:
    return "'(" + "|".join(e.replace(".", "[.]") for e in extensions) + ")$'"


def _block_v1(url: str) -> str:
    tracker = " OR ".join(f"contains({_host(url)}, '{d}')" for d in TRACKER_DOMAINS)
    return (f"CASE WHEN {tracker} THEN 'tracker' "
            f"WHEN regexp_matches(lower({_path(url)}), {_endings(STATIC_EXTENSIONS)}) THEN 'static' END")


def _block_v2(url: str) -> str:
    return f"CASE WHEN regexp_matches(lower({_path(url)}), {_endings(MEDIA_EXTENSIONS)}) THEN 'static' END"


_KIND = ("CASE json_type(body) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' "
         "WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' WHEN 'DOUBLE' THEN 'float' ELSE 'int' END")

# Common tables: the capture log, and requests and responses of both profiles.
_CAP = f"cap AS ({_derived(EVENT_CAPTURE, 'events')})"
_JSON_CT = "contains(lower(content_type), 'application/json')"


def _side(kind: str, profile: str) -> str:
    if profile == "v1":
        where = "resource_type IN ('xhr', 'fetch')"
        parse = f"coalesce(body, '') <> '' AND {_JSON_CT}"
        path = _path("url")
    else:
        where = "resource_type IN ('xhr', 'fetch', 'document') AND method <> 'OPTIONS'"
        if kind == "request":
            where += f" AND NOT {_noise('url')}"
        parse = "coalesce(body, '') <> ''"
        path = _root(_path("url"))
    return f"""
      SELECT *, CASE WHEN valid THEN {_KIND} END AS json_kind,
             coalesce(valid AND body NOT IN ('{{}}', '[]', '""', '0', 'null', 'false'), false) AS truthy
      FROM (SELECT session_id, seq, url, content_type, upper(method) AS method, {path} AS path, body, status, {parse} AS parse,
                   CASE WHEN {parse} THEN json_valid(body) ELSE false END AS valid
            FROM cap WHERE kind = '{kind}' AND {where})"""


def _with(profile: str, *more: str) -> str:
    return ("WITH " + ", ".join([_CAP, f"req AS ({_side('request', profile)})", f"resp AS ({_side('response', profile)})",
                                 "firsts AS (SELECT session_id, method, path, min(seq) AS first_seq, "
                                 "min_by(url, seq) AS url FROM req GROUP BY ALL)", *more]) + " ")


_PAGES_FIRST = f"""
  SELECT 'GET' AS method, path, min_by(url, page_id) AS url, min(page_id) AS first_page
  FROM (SELECT page_id, url, {_root(_path('url'))} AS path FROM pages
        WHERE NOT {_noise('url')}) GROUP BY path"""

ORACLES["url_parts"] = f"""
  SELECT page_id, {_path('url')} AS path, {_host('url')} AS host, lower({_netloc('url')}) AS domain FROM pages"""

ORACLES["capture_url_parts"] = f"""
  WITH {_CAP} SELECT seq, {_path('url')} AS raw_path, {_root(_path('url'))} AS path, {_host('url')} AS host,
  lower({_netloc('url')}) AS domain, upper(method) AS method FROM cap"""

ORACLES["normalised_targets"] = """
  SELECT page_id, CASE WHEN page_id % 2 = 0 THEN
    CASE WHEN starts_with(regexp_replace(url, '^https?://', ''), 'http') THEN regexp_replace(url, '^https?://', '')
    ELSE 'https://' || regexp_replace(url, '^https?://', '') END ELSE url END AS target FROM pages"""

ORACLES["route_decision"] = f"""
  WITH {_CAP} SELECT seq, {_block_v1('url')} AS block_reason_v1, {_block_v2('url')} AS block_reason_v2 FROM cap"""

ORACLES["noise_filtered_pages"] = f"""
  SELECT page_id, url FROM pages WHERE NOT contains(url, 'spam-farm') AND NOT contains(url, 'cheap-pills')
  AND NOT ends_with(lower({_path('url')}), '.html') AND NOT contains({_host('url')}, 'example.net')"""

ORACLES["noise_requests"] = f"""
  WITH {_CAP} SELECT session_id, seq, url FROM cap WHERE kind = 'request' AND {_noise('url')}"""

ORACLES["json_content_types"] = f"WITH {_CAP} SELECT kind, count(*) AS n FROM cap WHERE {_JSON_CT} GROUP BY kind"

ORACLES["cleaned_headers"] = f"""
  WITH {_CAP} SELECT seq, 'authorization=***;content-type=' || content_type AS headers FROM cap"""

for _p, _block in (("v1", _block_v1("url")), ("v2", _block_v2("url"))):
    ORACLES[f"network_log_{_p}"] = _with(_p) + f"""
      SELECT session_id, seq, method, url, {_root(_path('url'))} AS path, body, truthy AS body_is_json,
             {_block} AS block_reason FROM req"""

ORACLES["paired_responses"] = f"""
  WITH {_CAP} SELECT session_id, seq + 1 AS seq, request_id, method, url, resource_type FROM cap WHERE kind = 'request'"""

ORACLES["endpoint_catalog"] = _PAGES_FIRST

# Samples: v1 wants truthy JSON or a JSON-typed text that failed to parse; v2 any body.
_SAMPLES = {p: f"""
  samples AS (SELECT * FROM (
    SELECT session_id, method, path, seq, body, CASE WHEN truthy THEN json_kind ELSE 'text' END AS kind,
           row_number() OVER (PARTITION BY session_id, method, path ORDER BY seq) AS rank
    FROM req WHERE {cond}) WHERE rank <= {n})""" for p, cond, n in (
    ("v1", "parse AND (NOT valid OR truthy)", 5), ("v2", "parse", 2))}
_ATTACHED = """
  attached AS (SELECT DISTINCT r.session_id, r.method, r.path, CAST(r.status AS BIGINT) AS status
    FROM resp r JOIN firsts f ON r.session_id = f.session_id AND r.method = f.method AND r.path = f.path
    AND r.seq >= f.first_seq)"""
_STATUS_LISTS = """
  lists AS (SELECT session_id, method, path, string_agg(CAST(status AS STRING), ', ' ORDER BY status) AS statuses
    FROM attached GROUP BY ALL)"""
_SAMPLE_LISTS = """
  sampled AS (SELECT session_id, method, path, string_agg(body, ' | ' ORDER BY seq) AS samples, count(*) AS n_samples
    FROM samples GROUP BY ALL)"""
for _p in ("v1", "v2"):
    ORACLES[f"endpoint_catalog_{_p}"] = _with(_p, _SAMPLES[_p], _ATTACHED, _STATUS_LISTS, _SAMPLE_LISTS) + """
      SELECT session_id, method, path, url, first_seq, coalesce(statuses, 'None') AS statuses,
             coalesce(samples, '') AS samples, coalesce(n_samples, 0) AS n_samples
      FROM firsts LEFT JOIN lists USING (session_id, method, path) LEFT JOIN sampled USING (session_id, method, path)"""
    ORACLES[f"sample_payloads_{_p}"] = _with(_p, _SAMPLES[_p]) + """
      SELECT session_id, method, path, seq, body, kind, rank FROM samples"""
    ORACLES[f"attached_statuses_{_p}"] = _with(_p, _ATTACHED) + "SELECT session_id, method, path, status FROM attached"

# A text is kept iff it is the first response; JSON bodies fill up to two.
ORACLES["response_samples"] = _with("v2", """
  known AS (SELECT r.*, row_number() OVER w AS n, coalesce(sum(CAST(valid AS INT)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING
      AND 1 PRECEDING), 0) AS earlier, first_value(valid) OVER w AS first_is_json
    FROM resp r JOIN firsts f ON r.session_id = f.session_id AND r.method = f.method AND r.path = f.path
      AND r.seq >= f.first_seq WHERE r.body IS NOT NULL
    WINDOW w AS (PARTITION BY r.session_id, r.method, r.path ORDER BY r.seq))""") + """
  SELECT session_id, method, path, seq, coalesce(json_kind, 'text') AS kind,
         CASE WHEN valid THEN body ELSE substr(body, 1, 500) || '...' END AS sample
  FROM known WHERE CASE WHEN valid THEN earlier + CASE WHEN first_is_json THEN 0 ELSE 1 END < 2 ELSE n = 1 END"""

ORACLES["first_n_payloads"] = """
  SELECT event_type, event_id, props, rank, rank <= 2 AS in_short_list FROM (SELECT *, row_number() OVER
  (PARTITION BY event_type ORDER BY event_id) AS rank FROM events) WHERE rank <= 5"""

ORACLES["user_statuses"] = """
  SELECT user_id, coalesce(string_agg(DISTINCT CASE event_type WHEN 'error' THEN '500' WHEN 'view' THEN '200' END, ', '
  ORDER BY CASE event_type WHEN 'error' THEN '500' WHEN 'view' THEN '200' END), 'None') AS statuses FROM events GROUP BY user_id"""

_FN = "regexp_replace(lower(method) || '_' || trim(path, '/'), '[^a-zA-Z0-9_]+', '_', 'g')"
ORACLES["client_spec"] = f"""
  WITH firsts AS ({_PAGES_FIRST}), named AS (SELECT *, {_FN} AS fn_name FROM firsts)
  SELECT fn_name, method, url, CAST(NULL AS STRING) AS body, count(*) OVER (PARTITION BY fn_name) > 1 AS name_clash FROM named"""
ORACLES["client_spec_v1"] = _with("v1", _SAMPLES["v1"], f"named AS (SELECT *, {_FN} AS fn_name FROM firsts)") + """
  SELECT n.session_id, fn_name, n.method, n.url, s.body, count(*) OVER (PARTITION BY n.session_id, fn_name) > 1 AS name_clash
  FROM named n LEFT JOIN samples s ON s.session_id = n.session_id AND s.method = n.method AND s.path = n.path AND s.rank = 1"""

# Leaves: scalar nodes in document order (no array here is longer than ten), paths without '$'.
_LEAF_TYPES = "('VARCHAR', 'UBIGINT', 'BIGINT')"


def _leaves(side: str) -> str:
    return f"""
      (SELECT * FROM (SELECT session_id, seq, method || ' ' || path AS endpoint, body,
           regexp_replace(fullkey, '^[$][.]?', '') AS field_path, leaf_type, json_extract_string(atom, '$') AS value,
           row_number() OVER (PARTITION BY session_id, seq ORDER BY id) - 1 AS ord
         FROM (SELECT r.session_id, r.seq, r.method, r.path, r.body, t.fullkey, t.atom, t.id, t.type AS leaf_type
               FROM (SELECT * FROM {side} WHERE valid) r, json_tree(r.body) t
               WHERE t.type NOT IN ('OBJECT', 'ARRAY')))
       WHERE leaf_type IN {_LEAF_TYPES} AND length(value) BETWEEN 3 AND 120)"""


_REQ_LEAVES = f"asked AS (SELECT * FROM {_leaves('req')} WHERE json_type(body) IN ('OBJECT', 'ARRAY'))"
_RESP_LEAVES = f"given AS (SELECT * FROM {_leaves('resp')})"

ORACLES["json_leaf_table"] = """
  SELECT event_id, CAST(0 AS BIGINT) AS ord, 'k' AS path, 'int' AS typ, json_extract_string(props, '$.k') AS value,
         'object' AS root_kind FROM events"""
ORACLES["request_tokens"] = _with("v1", _REQ_LEAVES) + """
  SELECT session_id, seq, ord, endpoint, field_path, sha1(value) AS token FROM asked"""
ORACLES["response_tokens"] = _with("v2", _RESP_LEAVES) + """
  SELECT session_id, seq, ord, endpoint, field_path, sha1(value) AS token FROM given"""


def _uses(session: str) -> str:
    """Every use of a value: the latest earlier producer of the same text."""
    return f"""
      uses AS (SELECT {session} AS session_id, a.seq, a.ord, g.endpoint AS source_endpoint, g.field_path AS source_field,
          a.endpoint AS consumer_endpoint, a.field_path AS consumer_field
        FROM (SELECT *, {session} AS s FROM asked) a ASOF JOIN
             (SELECT {session} AS s, value, seq, max_by(endpoint, ord) AS endpoint, max_by(field_path, ord) AS field_path
              FROM given GROUP BY ALL) g
        ON a.s = g.s AND a.value = g.value AND a.seq > g.seq)"""


_EDGES = """
  edges AS (SELECT session_id, source_endpoint, source_field, consumer_endpoint, consumer_field, min(seq) AS first_seq,
      min(seq * 1000 + ord) AS first_at FROM uses GROUP BY ALL)"""

ORACLES["value_lineage"] = """
  WITH words AS (SELECT 'c' || conv_id AS session_id, turn AS seq, role, unnest(string_split(text, ' ')[1:10]) AS value,
      generate_subscripts(string_split(text, ' ')[1:10], 1) - 1 AS ord FROM conversations),
    tokens AS (SELECT *, 'POST /' || role AS endpoint, '[' || ord || ']' AS field_path FROM words
      WHERE length(value) BETWEEN 3 AND 120),
    asked AS (SELECT * FROM tokens WHERE role <> 'assistant'), given AS (SELECT * FROM tokens WHERE role = 'assistant'),
  """ + _uses("session_id") + " SELECT * FROM uses"

for _p in ("v1", "v2"):
    _cap = "QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY first_at) <= 100" if _p == "v1" else ""
    ORACLES[f"lineage_edges_{_p}"] = _with(_p, _REQ_LEAVES, _RESP_LEAVES, _uses("session_id"), _EDGES) + f"""
      SELECT session_id, source_endpoint, source_field, consumer_endpoint, consumer_field, first_seq FROM edges {_cap}"""

ORACLES["lineage_one_session"] = _with("v2", _REQ_LEAVES, _RESP_LEAVES, _uses("'all'")) + "SELECT * FROM uses"

ORACLES["order_lineage"] = """
  WITH o AS (SELECT o_orderkey, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS d FROM orders
      WHERE length(CAST(o_orderkey AS STRING)) >= 3),
    l AS (SELECT l_orderkey, l_linenumber, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS d FROM lineitem)
  SELECT l_orderkey, l_linenumber, l.d AS ship_day, o.d AS order_day
  FROM l ASOF JOIN o ON l.l_orderkey = o.o_orderkey AND l.d > o.d"""

_NUMBERED = """
  numbered AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY first_at) - 1 AS i FROM edges)"""
_EDGE_LINE = ("'    Node' || i || 'A[\"' || source_endpoint || '\\n(' || source_field || ')\"] --> Node' || i || 'B[\"' || "
              "consumer_endpoint || '\\n(' || consumer_field || ')\"]'")
ORACLES["edge_chart"] = _with("v2", _REQ_LEAVES, _RESP_LEAVES, _uses("session_id"), _EDGES, _NUMBERED) + f"""
  SELECT session_id, i AS ord, {_EDGE_LINE} AS line FROM numbered"""

# API description.
_OA_REQ = """
  oa_req AS (SELECT f.session_id, f.method, f.path, f.first_seq,
      CASE WHEN p.body IS NULL THEN NULL WHEN p.kind IN ('object', 'array') THEN 'application/json'
           ELSE 'application/x-www-form-urlencoded' END AS content_type, p.body AS example, p.kind AS example_kind
    FROM firsts f LEFT JOIN (SELECT session_id, method, path, max_by(body, seq) AS body,
        max_by(CASE WHEN truthy THEN json_kind ELSE 'text' END, seq) AS kind
      FROM req WHERE coalesce(body, '') <> '' GROUP BY ALL) p USING (session_id, method, path))"""
_OA_RESP = """
  oa_resp AS (SELECT session_id, method, path, CAST(status AS STRING) AS status,
      CASE WHEN json_kind IN ('object', 'array') THEN 'application/json' ELSE 'text/html' END AS content_type,
      CASE WHEN valid THEN body ELSE substr(body, 1, 500) END AS example, coalesce(json_kind, 'text') AS example_kind
    FROM (SELECT r.*, row_number() OVER (PARTITION BY r.session_id, r.method, r.path, r.status ORDER BY r.seq DESC) AS back
      FROM resp r JOIN firsts f ON r.session_id = f.session_id AND r.method = f.method AND r.path = f.path
        AND r.seq >= f.first_seq WHERE r.body IS NOT NULL AND r.status IS NOT NULL) WHERE back = 1)"""
ORACLES["openapi_requests"] = _with("v2", _OA_REQ) + "SELECT * FROM oa_req"
ORACLES["openapi_responses"] = _with("v2", _OA_RESP) + "SELECT * FROM oa_resp"
ORACLES["openapi_last_write"] = """
  SELECT event_type, user_id, max_by(props, event_id) AS example, max(event_id) AS last_event,
         'application/json' AS content_type FROM events GROUP BY event_type, user_id"""

# Canonical text of a JSON body: the bodies here only lack the spaces.
_SPACED = "replace(replace(replace({x}, '\":', '\": '), ',', ', '), ':  ', ': ')"
_EXAMPLE = f"CASE WHEN example_kind = 'text' THEN CAST(to_json(example) AS STRING) ELSE {_SPACED.format(x='example')} END"
_DOCS = f"""
  answers AS (SELECT session_id, method, path, string_agg('"' || status || '":{{"description":"Auto-captured response","content":{{"'
      || content_type || '":{{"example":' || {_EXAMPLE} || '}}}}}}', ',' ORDER BY status) AS a FROM oa_resp GROUP BY ALL),
  ops AS (SELECT r.session_id, r.path, r.first_seq, '"' || lower(r.method) || '":{{"summary":"Auto-captured ' || r.path
      || '","responses":{{' || coalesce(a, '') || '}}' || CASE WHEN content_type IS NULL THEN '' ELSE
      ',"requestBody":{{"content":{{"' || content_type || '":{{"schema":{{"type":"object"}},"example":' || {_EXAMPLE} || '}}}}}}' END
      || '}}' AS op FROM oa_req r LEFT JOIN answers USING (session_id, method, path)),
  items AS (SELECT session_id, path, min(first_seq) AS ord, '{{' || string_agg(op, ',' ORDER BY first_seq) || '}}' AS item
    FROM ops GROUP BY ALL)"""


def _document(rows: str, key: str, value: str, head: str, tail: str) -> str:
    return f"""
      SELECT session_id, CAST(1 AS BIGINT) AS section, ord, '"' || {key} || '": ' || {value} || CASE WHEN ord = max(ord)
        OVER (PARTITION BY session_id) THEN '' ELSE ',' END AS line FROM {rows}
      UNION ALL SELECT DISTINCT session_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), '{head}' FROM {rows}
      UNION ALL SELECT DISTINCT session_id, CAST(2 AS BIGINT), CAST(0 AS BIGINT), '{tail}' FROM {rows}"""


ORACLES["openapi_documents"] = _with("v2", _OA_REQ, _OA_RESP, _DOCS) + _document(
    "items", "path", "item", '{"openapi": "3.0.0", "info": {"title": "Captured API", "version": "1.0"}, "paths": {', "}}")

_SAMPLE_JSON = f"CASE WHEN kind = 'text' THEN CAST(to_json(body) AS STRING) ELSE {_SPACED.format(x='body')} END"
ORACLES["endpoint_map"] = _with("v1", _SAMPLES["v1"], _ATTACHED, _STATUS_LISTS, f"""
  sampled AS (SELECT session_id, method, path, string_agg({_SAMPLE_JSON}, ', ' ORDER BY seq) AS samples
    FROM samples GROUP BY ALL), entries AS (SELECT session_id, first_seq AS ord, method || ' ' || path AS k,
      '{{"url": "' || url || '", "response_statuses": [' || coalesce(statuses, '') || '], "sample_payloads": ['
      || coalesce(samples, '') || ']}}' AS v
    FROM firsts LEFT JOIN lists USING (session_id, method, path) LEFT JOIN sampled USING (session_id, method, path))
  """) + _document("entries", "k", "v", "{", "}")

# The report: header, endpoint blocks, and the edge chart where there are edges.
_INDENTED = """CASE WHEN kind = 'text' THEN CAST(to_json(body) AS STRING)
  WHEN starts_with(body, '{"k"') THEN '{' || chr(10) || '  "k": ' || json_extract_string(body, '$.k') || chr(10) || '}'
  WHEN starts_with(body, '[') THEN '[' || chr(10) || '  {' || chr(10) || '    "ref": "' || json_extract_string(body, '$[0].ref')
    || '"' || chr(10) || '  },' || chr(10) || '  {' || chr(10) || '    "who": ' || json_extract_string(body, '$[1].who') || chr(10)
    || '  }' || chr(10) || ']'
  ELSE '{' || chr(10) || '  "ref": "' || json_extract_string(body, '$.ref') || '",' || chr(10) || '  "n": [' || chr(10) || '    '
    || json_extract_string(body, '$.n[0]') || ',' || chr(10) || '    7' || chr(10) || '  ]' || chr(10) || '}' END"""
_CAPPED = "QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY first_at) <= 100"
ORACLES["report_lines"] = _with(
    "v1", _SAMPLES["v1"], _ATTACHED, _STATUS_LISTS, _REQ_LEAVES, _RESP_LEAVES, _uses("session_id"),
    _EDGES.replace("edges AS", "all_edges AS"), f"edges AS (SELECT * FROM all_edges {_CAPPED})", _NUMBERED) + f"""
  SELECT session_id, CAST(0 AS BIGINT) AS section, CAST(0 AS BIGINT) AS ord, '# Investigation Report' || chr(10)
    || '**Target URL:** `https://api.example.com`  ' || chr(10) || '**Generated:** `2024-01-01T00:00:00`  ' || chr(10) || chr(10)
    || '## Discovered Business Endpoints' || chr(10) AS line FROM (SELECT DISTINCT session_id FROM cap)
  UNION ALL SELECT f.session_id, 1, first_seq, '### `' || f.method || '` `' || f.path || '`' || chr(10) || '- **Full URL:** `' || url
    || '`' || chr(10) || '- **Observed HTTP Statuses:** `' || coalesce(statuses, 'None') || '`' || chr(10)
    || CASE WHEN body IS NULL THEN '' ELSE '- **Sample Request Schema:**' || chr(10) || '```json' || chr(10) || {_INDENTED}
       || chr(10) || '```' || chr(10) END
    FROM firsts f LEFT JOIN lists USING (session_id, method, path) LEFT JOIN (SELECT * FROM samples WHERE rank = 1)
      USING (session_id, method, path)
  UNION ALL SELECT DISTINCT session_id, 2, 0, '## Field Dependency Flow (Data Chains)' || chr(10) || '```mermaid' || chr(10)
    || 'graph TD' FROM edges
  UNION ALL SELECT session_id, 3, i, {_EDGE_LINE} FROM numbered
  UNION ALL SELECT DISTINCT session_id, 4, 0, '```' || chr(10) FROM edges"""

# Pages.
ORACLES["base_injected"] = """
  SELECT page_id, CASE WHEN instr(html, '<head>') > 0 THEN substr(html, 1, instr(html, '<head>') + 5) || chr(10) || '    <base href="'
  || url || '">' || substr(html, instr(html, '<head>') + 6) ELSE '<base href="' || url || '">' || chr(10) || html END AS html FROM pages"""
_UNESCAPED = "replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"
ORACLES["link_catalog"] = f"""
  WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')) AS a FROM pages),
    parts AS (SELECT page_id, regexp_extract(a, 'href="([^"]*)"', 1) AS h, regexp_extract(a, '>([^<]*)<', 1) AS t FROM a)
  SELECT page_id, {_UNESCAPED.format(x='h')} AS id, trim({_UNESCAPED.format(x='t')}) AS label, count(*) AS n FROM parts GROUP BY ALL"""
ORACLES["picker_by_class"] = f"""
  WITH d AS (SELECT page_id, unnest(regexp_extract_all(html, '<div class="ad">[^<]*</div>')) AS d,
      generate_subscripts(regexp_extract_all(html, '<div class="ad">[^<]*</div>'), 1) - 1 AS i FROM pages)
  SELECT page_id, i AS "index", 'div' AS tag, 'ad' AS class_name,
         substr(trim({_UNESCAPED.format(x="regexp_extract(d, '>([^<]*)<', 1)")}), 1, 150) AS current_text FROM d"""
ORACLES["element_counts"] = """
  WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)[ >]', 1)) AS tag FROM pages)
  SELECT page_id, tag, count(*) AS n FROM t GROUP BY ALL"""

_C = "'https://shop.example.com/c/' || c_custkey || '/edit?tab=1'"
ORACLES["forms"] = f"""
  SELECT c_custkey AS page_id, CAST(0 AS BIGINT) AS "index", 'f' || c_custkey AS id, 'main' AS name,
    CASE WHEN c_custkey % 2 = 0 THEN 'https://shop.example.com/c/save' ELSE {_C} END AS action,
    CASE WHEN c_custkey % 3 = 0 THEN 'POST' ELSE 'GET' END AS method, CAST(5 AS BIGINT) AS n_fields FROM customer"""
ORACLES["form_fields"] = """
  SELECT c_custkey AS page_id, tag, type, name, id, required, CASE tag WHEN 'input' THEN CASE type WHEN 'text' THEN c_name ELSE 'on' END
      WHEN 'textarea' THEN c_mktsegment || ' & more' WHEN 'button' THEN '' END AS value,
    CASE WHEN type = 'checkbox' THEN c_acctbal > 5000 END AS checked, CASE WHEN tag = 'select' THEN CAST(3 AS BIGINT) END AS options_count
  FROM customer, (VALUES ('input', 'text', 'who', NULL, true), ('input', 'checkbox', 'vip', NULL, false),
    ('select', 'select-one', 's', 'seg', false), ('textarea', 'textarea', 'note', NULL, false),
    ('button', 'submit', NULL, NULL, false)) f(tag, type, name, id, required)"""
ORACLES["select_options"] = """
  SELECT c_custkey AS page_id, CAST(position AS BIGINT) AS position,
    CASE position WHEN 0 THEN '' WHEN 1 THEN 'MACHINERY' ELSE 'x' END AS value,
    CASE position WHEN 0 THEN 'none' WHEN 1 THEN 'MACHINERY' ELSE c_mktsegment END AS text,
    CASE WHEN c_mktsegment = 'MACHINERY' THEN position = 1 ELSE position = 0 END AS selected
  FROM customer, (VALUES (0), (1), (2)) p(position)"""
ORACLES["standalone_inputs"] = """
  SELECT c_custkey AS page_id, tag, type, CASE n WHEN 'k' THEN 'k' || (c_custkey % 2) ELSE n END AS name, placeholder
  FROM customer, (VALUES ('input', 'text', 'q', 'find'), ('select', 'select-one', 'k', NULL),
    ('select', 'select-one', 'k0', NULL)) f(tag, type, n, placeholder)"""
ORACLES["custom_pickers"] = """
  SELECT c_custkey AS page_id, 'div' AS tag, 'listbox' AS role, 'app dropdown' AS class_name, 'Pick ' || c_name AS current_text,
         c_mktsegment AS seg_name FROM customer"""
ORACLES["dropdown_catalog"] = """
  SELECT c_custkey AS page_id, 'seg' AS key, '=none;MACHINERY=MACHINERY;x=' || c_mktsegment AS options FROM customer
  UNION ALL SELECT c_custkey, 'k0', c_custkey || '=Z' FROM customer
  UNION ALL SELECT c_custkey, 'k1', 'A=A' FROM customer WHERE c_custkey % 2 = 1"""
ORACLES["snapshot_totals"] = """
  SELECT c_mktsegment AS session_id, c_custkey // 4 AS page_id, count(*) AS frames, count(*) AS forms, count(*) AS pickers
  FROM customer GROUP BY ALL"""
ORACLES["dom_snapshots"] = """
  SELECT c_mktsegment AS session_id, c_custkey // 4 AS page_id,
    string_agg((c_custkey % 4) || ':f' || c_custkey, ';' ORDER BY c_custkey) AS frames
  FROM customer GROUP BY ALL"""
ORACLES["inlined_css"] = f"""
  WITH p AS ({_derived(FORM_PAGES, 'customer')}), c AS (SELECT c_custkey, c_nationkey, n_name FROM customer
    LEFT JOIN (SELECT * FROM nation WHERE n_nationkey <> 7) ON c_nationkey = n_nationkey)
  SELECT p.page_id, CASE WHEN n_name IS NULL THEN html ELSE replace(html,
      '<link rel=stylesheet href="/css/n' || c_nationkey || '.css">',
      '<style>body{{background:url(''https://shop.example.com/img/' || n_name || '.png'')}} i{{src:url(data:x)}}</style>')
    END AS html FROM p JOIN c ON p.page_id = c.c_custkey"""
ORACLES["frozen_values"] = """
  SELECT c_custkey AS page_id, name, CASE name WHEN 'who' THEN CASE WHEN c_custkey % 2 = 0 THEN 'typed' ELSE c_name END
    WHEN 'vip' THEN 'on' WHEN 'note' THEN c_mktsegment || ' & more' WHEN 's' THEN NULL ELSE '' END AS value,
    CASE WHEN name = 'vip' THEN c_custkey % 3 = 0 OR c_acctbal > 5000 END AS checked
  FROM customer, (VALUES ('who'), ('vip'), ('s'), ('note'), (NULL)) f(name)"""

# Change detection and traces.
ORACLES["page_change"] = """
  SELECT conv_id, turn, role FROM conversations
  QUALIFY role <> coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn), '')"""
ORACLES["user_state_changes"] = """
  SELECT user_id, event_id, event_type FROM events
  QUALIFY event_type <> coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id), '')"""
ORACLES["feed_changes"] = """
  SELECT event_id, event_type FROM events QUALIFY event_type <> coalesce(lag(event_type) OVER (ORDER BY event_id), '')"""
ORACLES["event_index"] = """
  SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) - 1 AS position,
         row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS type_position FROM events"""
ORACLES["page_steps"] = """
  WITH kept AS (SELECT user_id, event_id, ts FROM events
    QUALIFY event_type <> coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id), '')),
  n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM kept)
  SELECT 'user-' || user_id AS session_id, event_id AS page_id, step,
    'step_' || CASE WHEN step < 1000 THEN lpad(CAST(step AS STRING), 3, '0') ELSE CAST(step AS STRING) END || '_'
    || strftime(ts, '%H%M%S') AS step_name FROM n"""
ORACLES["mutation_log"] = f"""
  SELECT session_id, time AS time_ms, type, CASE WHEN coalesce(id, '') <> '' THEN id WHEN coalesce(class_name, '') <> ''
    THEN class_name ELSE tag END AS target_id, CAST(coalesce(added_nodes, 0) AS BIGINT) AS added_nodes
  FROM ({_derived(MUTATIONS, 'events')}) WHERE coalesce(id, '') <> '' OR coalesce(class_name, '') <> ''"""
ORACLES["call_log"] = f"""
  SELECT session_id, "function", arguments, returned, "timestamp" AS ts_ms FROM ({_derived(CALLS, 'events')})
  WHERE "function" IN ('purchase', 'signup')"""
ORACLES["listener_map"] = f"""
  SELECT session_id, CASE WHEN el_id <> '' THEN '#' || el_id WHEN class_name IS NOT NULL THEN '.' || class_name ELSE tag END AS selector,
    replace(max_by(events, ord), ',', '+') AS events FROM ({_derived(LISTENERS, 'events')}) GROUP BY ALL"""
ORACLES["text_digests"] = """
  SELECT doc_id, substr(text, 1, 500) || '...' AS sample, md5(text) AS md5, sha1(text) AS sha1 FROM documents"""
ORACLES["cookie_values"] = """
  SELECT event_id, CAST(event_id AS STRING) AS uid, event_type AS kind, props || '=x' AS raw FROM events"""
ORACLES["stream_catalog"] = _with("v2", _ATTACHED, _STATUS_LISTS) + """
  SELECT session_id, method, path, url, first_seq, coalesce(statuses, 'None') AS statuses
  FROM firsts LEFT JOIN lists USING (session_id, method, path)"""

# Unpaired responses, odd bodies and sheets, a session past the edge limit.
ORACLES["unpaired_responses"] = f"""
  WITH {_CAP} SELECT session_id, seq, CASE WHEN seq % 3 = 0 THEN 'lost-' ELSE '' END || request_id AS request_id,
    CASE WHEN seq % 3 <> 0 THEN method END AS method, CASE WHEN seq % 3 <> 0 THEN url END AS url,
    CASE WHEN seq % 3 <> 0 THEN resource_type END AS resource_type, seq % 3 <> 0 AS paired FROM cap WHERE kind = 'request'"""
ORACLES["client_spec_v2"] = _with("v2", _SAMPLES["v2"], f"named AS (SELECT *, {_FN} AS fn_name FROM firsts)") + """
  SELECT n.session_id, fn_name, n.method, n.url, CASE WHEN s.kind = 'object' THEN s.body END AS body,
    count(*) OVER (PARTITION BY n.session_id, fn_name) > 1 AS name_clash, 'authorization=***;content-type=' || r.content_type AS headers
  FROM named n JOIN req r ON r.session_id = n.session_id AND r.seq = n.first_seq
  LEFT JOIN samples s ON s.session_id = n.session_id AND s.method = n.method AND s.path = n.path AND s.rank = 1"""
ORACLES["openapi_escaped"] = _with("v2") + """
  SELECT session_id, method, path, '{"x": null, "a": ' || max(seq) || '}' AS example FROM req GROUP BY ALL"""
ORACLES["css_with_bad_address"] = """
  SELECT n_nationkey, 'a{b:url(//[' || n_name || ')} c{d:url(''https://shop.example.com/i/' || n_name || '.png'')}' AS css FROM nation"""
ORACLES["lineage_edges_capped"] = _with("v1", _REQ_LEAVES, _RESP_LEAVES, _uses("'all'"), _EDGES) + """
  SELECT session_id, source_endpoint, source_field, consumer_endpoint, consumer_field, first_seq FROM edges
  QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY first_at) <= 100"""

# Sinks and readers.
ORACLES["log_roundtrip"] = _with("v2") + f"""
  SELECT session_id, seq, method, url, {_root(_path('url'))} AS path, body, truthy AS body_is_json, {_block_v2("url")} AS block_reason,
    ':path=/;Host=api;authorization=***;content-length=9;content-type=' || content_type AS headers FROM req"""


def _written(lines: str) -> str:
    """Lines of a document as its file has them, numbered by session."""
    return f"""
      SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY section, ord, line, i) AS line_no, part AS line
      FROM (SELECT *, unnest(string_split(line, chr(10))) AS part, generate_subscripts(string_split(line, chr(10)), 1) AS i FROM ({lines}))"""


for _name, _lines in (("endpoint_map_written", "endpoint_map"), ("openapi_written", "openapi_documents"), ("report_written", "report_lines")):
    ORACLES[_name] = _written(ORACLES[_lines])
ORACLES["edges_roundtrip"] = f"SELECT * EXCLUDE (first_seq) FROM ({ORACLES['lineage_edges_v2']})"
ORACLES["dom_roundtrip"] = """
  SELECT c_mktsegment AS session_id, c_custkey // 4 AS page_id, string_agg((c_custkey % 4) || ':f' || c_custkey || ':5:' || c_name
    || ':3:Pick ' || c_name, ';' ORDER BY c_custkey) AS frames FROM customer GROUP BY ALL"""
ORACLES["catalogs_roundtrip"] = ORACLES["dropdown_catalog"]
ORACLES["listeners_roundtrip"] = ORACLES["listener_map"]
ORACLES["traces_roundtrip"] = f"""
  SELECT session_id, 'call' AS trace, ts_ms AS "at", "function" AS what, arguments || returned AS detail FROM ({ORACLES['call_log']})
  UNION ALL SELECT session_id, 'mutation', time_ms, type, target_id || '+' || added_nodes FROM ({ORACLES['mutation_log']})"""
ORACLES["stored_snapshots"] = """
  SELECT DISTINCT c_mktsegment AS session_id, c_custkey // 4 AS page_id, CAST(c_custkey // 4 AS STRING) AS local, c_mktsegment AS session,
    'uid=' || (c_custkey // 4) AS cookies FROM customer"""
_STATES = """
  states AS (SELECT page_id * 3 + r AS place, url, CASE WHEN r = 2 THEN html || '<!-- seen -->' ELSE html END AS html
    FROM pages, (VALUES (0), (1), (2)) v(r)),
  kept AS (SELECT * FROM states QUALIFY html <> coalesce(lag(html) OVER (ORDER BY place), '')),
  steps AS (SELECT *, row_number() OVER (ORDER BY place) AS step FROM kept)"""
ORACLES["offline_pages"] = f"""
  WITH {_STATES} SELECT 'crawl' AS session_id, 'step_' || CASE WHEN step < 1000 THEN lpad(CAST(step AS STRING), 3, '0')
    ELSE CAST(step AS STRING) END || '_' || strftime(make_timestamp(place * 1000000), '%H%M%S') AS step_name,
    md5(CASE WHEN instr(html, '<head>') > 0 THEN substr(html, 1, instr(html, '<head>') + 5) || chr(10) || '    <base href="' || url
      || '">' || substr(html, instr(html, '<head>') + 6) ELSE '<base href="' || url || '">' || chr(10) || html END) AS md5 FROM steps"""

# Streams.
ORACLES["stream_lineage"] = ORACLES["value_lineage"].replace("[1:10]", "")  # whole texts
ORACLES["stream_lineage_late"] = ORACLES["value_lineage"]
ORACLES["stream_first_samples"] = f"SELECT * EXCLUDE (rank) FROM ({ORACLES['sample_payloads_v2']})"
ORACLES["stream_page_changes"] = f"""
  SELECT 'user-' || user_id AS session_id, event_id AS page_id, 'https://h/' || (event_id % 2) AS url FROM ({ORACLES['user_state_changes']})"""
ORACLES["stream_late_events"] = """
  WITH mark AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 DAY AS wm FROM events WHERE event_id % 10 <> 0)
  SELECT 'user-' || user_id AS session_id, event_id AS seq FROM events, mark WHERE event_id % 10 <> 0 OR ts > wm"""
ORACLES["stream_page_changes_shuffled"] = ORACLES["stream_page_changes"]
ORACLES["stream_late_pages"] = """
  WITH seen AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events WHERE event_id % 10 <> 0)
  SELECT 'user-' || user_id AS session_id, event_id AS page_id, 'https://h/' || (event_id % 2) AS url, false AS late
    FROM seen WHERE before IS DISTINCT FROM event_type
  UNION ALL SELECT 'user-' || user_id, event_id, 'https://h/' || (event_id % 2), true FROM events WHERE event_id % 10 = 0"""
ORACLES["stream_late_rows"] = """
  WITH mark AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 DAY AS wm FROM events WHERE event_id % 10 <> 0)
  SELECT 'user-' || user_id AS session_id, event_id AS seq FROM events, mark WHERE event_id % 10 = 0 AND ts <= wm"""
ORACLES["stream_first_samples_reversed"] = ORACLES["stream_first_samples"]
ORACLES["stream_response_samples"] = ORACLES["response_samples"]

# Damaged logs.
_HURT = "(event_id % 7 = 0 OR event_id % 11 = 0 OR event_id % 13 = 0)"
_DAMAGED = """CASE WHEN event_id % 7 = 0 THEN '{"session_id":"user-' || user_id || '","seq":' || event_id
  WHEN event_id % 11 = 0 THEN '{"session_id":"x","kind":"request","seq":"' || event_id || 'th"}' ELSE '{"seq":' || event_id || ',"kind":null}' END"""
_PROBLEM = "CASE WHEN event_id % 7 = 0 THEN 'not JSON' WHEN event_id % 11 = 0 THEN 'wrong type' ELSE 'missing field' END"
ORACLES["damaged_log"] = f"WITH {_CAP} SELECT session_id, seq, kind, method, url, body FROM cap WHERE seq NOT IN (SELECT event_id FROM events WHERE {_HURT})"
ORACLES["damaged_lines"] = f"SELECT {_DAMAGED} AS line, {_PROBLEM} AS problem FROM events WHERE {_HURT}"
ORACLES["stream_damaged_log"] = f"""
  SELECT kind, count(*) AS n FROM (SELECT {_PROBLEM} AS kind FROM events WHERE {_HURT} UNION ALL SELECT kind FROM ({ORACLES["damaged_log"]})) GROUP BY kind"""

# Folds of part of the log, extended by the rest.
ORACLES["catalog_extended"] = ORACLES["endpoint_catalog_v2"]
ORACLES["openapi_extended"] = ORACLES["openapi_documents"]
ORACLES["stored_log_catalog"] = ORACLES["endpoint_catalog_v2"]
ORACLES["stored_log_openapi"] = ORACLES["openapi_documents"]

# Frames of every fifth customer fail.
ORACLES["snapshots_with_gaps"] = """
  SELECT c_mktsegment AS session_id, c_custkey // 4 AS page_id,
    string_agg((c_custkey % 4) || ':f' || c_custkey || ':5', ';' ORDER BY c_custkey) AS frames
  FROM customer WHERE c_custkey % 5 <> 0 GROUP BY ALL"""
ORACLES["unread_frames"] = """
  SELECT c_mktsegment AS session_id, c_custkey // 4 AS page_id, count(*) AS unread,
    CAST(min(c_custkey % 4) AS BIGINT) AS frame_index, 'ValueError' AS reason
  FROM customer WHERE c_custkey % 5 = 0 GROUP BY ALL"""
