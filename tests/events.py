"""Random capture events and a sequential model of the operator rules."""

from __future__ import annotations

import json
import random

from siftlane import profile_of, schemas

BODIES = [
    None, "", "{}", "[]", "0", "null", "false", '""', "a=1&b=2", '{"a":1} x', "<html>hi</html>", "x" * 600,
    '{"id":"tok-1"}', '{"id":"tok-2","n":[1,2,3]}', '["tok-1","tok-2"]', '"tok-1"', "12345", '{"ref":12345}',
    '{"a":1,"a":"dup-last"}', '{"deep":{"list":[[{"x":"tok-3"}]]}}', '{"t":true,"f":1.5,"z":null,"s":"ab"}',
    json.dumps({"many": [f"item-{i}" for i in range(14)]}), '{"p":"tok-9","q":"tok-9"}', '[{"ref":"item-9"},{"ref":"item-10"}]',
]
PATHS = ["", "/", "/a", "/a;v=1?q", "/b/c.png", "/err/error-js", "/A.MP4"]
HOSTS = ["api.example.com", "u@API.example.com:8443", "notfacebook.com.example", "usejimo.com"]


def random_events(seed: int, n: int = 60, sessions: int = 2) -> list[tuple]:
    rng, rows = random.Random(seed), []
    for seq in range(1, n + 1):
        kind = rng.choice(["request", "response"])
        headers = {"content-type": rng.choice(["application/json", "Application/JSON; x", "text/plain"]), ":path": "/"}
        rows.append((f"s{rng.randrange(sessions)}", seq, f"r{seq}", kind, None,
                     rng.choice(["xhr", "fetch", "document", "image"]), rng.choice(["GET", "post", "POST", "OPTIONS"]),
                     f"https://{rng.choice(HOSTS)}{rng.choice(PATHS)}", headers, rng.choice(BODIES),
                     rng.choice([200, 404, 500]) if kind == "response" else None))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, schemas.CAPTURE)


def _path(url: str) -> str:
    rest = url.split("://", 1)[1]
    path = rest[rest.index("/"):] if "/" in rest else ""
    return path.split("?")[0].split(";")[0]


def _json(text):
    try:
        return True, json.loads(text)
    except (TypeError, ValueError):
        return False, None


def _leaves(value, path=""):
    if isinstance(value, dict):
        for name, child in value.items():
            yield from _leaves(child, f"{path}.{name}" if path else name)
    elif isinstance(value, list):
        for i in range(min(10, len(value))):
            yield from _leaves(value[i], f"{path}[{i}]")
    elif type(value) in (str, int):
        yield path, str(value)


class Model:
    """One pass over events in order, keeping what the rules say per session."""

    def __init__(self, profile: str):
        self.p = profile_of(profile)
        self.endpoints, self.origins, self.uses, self.edges = {}, {}, [], {}
        self.requests_fold, self.responses_fold = {}, {}

    def run(self, rows):
        for row in sorted(rows, key=lambda r: (r[0], r[1])):
            session, seq, _, kind, _, rtype, method, url, headers, body, status = row
            if rtype not in self.p.resource_types or (self.p.drop_preflight and method == "OPTIONS"):
                continue
            if kind == "request" and any(f in url for f in self.p.noise_fragments):
                continue
            key = (session, method.upper(), _path(url) or self.p.empty_path)
            typed = "application/json" in headers["content-type"].lower()
            eligible = bool(body) and (typed or not self.p.json_needs_content_type)
            ok, value = _json(body) if eligible else (False, None)
            (self._request if kind == "request" else self._response)(key, seq, url, body, status, eligible, ok, value)
        return self

    def _request(self, key, seq, url, body, _, eligible, ok, value):
        e = self.endpoints.setdefault(key, {"first_seq": seq, "url": url, "samples": [], "statuses": set(), "responses": []})
        sample = eligible and (self.p.raw_text_samples or not ok or bool(value))
        if sample and len(e["samples"]) < self.p.sample_limit:
            e["samples"].append(body)
        if body:
            structured = ok and bool(value) and isinstance(value, (dict, list))
            self.requests_fold[key] = ("application/json" if structured else "application/x-www-form-urlencoded", body)
        else:
            self.requests_fold.setdefault(key, (None, None))
        if ok and isinstance(value, (dict, list)):
            for path, text in _leaves(value):
                origin = self.origins.get((key[0], text))
                if origin:
                    edge = (key[0], *origin, f"{key[1]} {key[2]}", path)
                    self.uses.append((key[0], seq, *edge[1:]))
                    self.edges.setdefault(edge, seq)

    def _response(self, key, seq, url, body, status, eligible, ok, value):
        e = self.endpoints.get(key)
        if e:
            e["statuses"].add(status)
        if ok:
            for path, text in _leaves(value):
                if 3 <= len(text) <= 120:
                    self.origins[key[0], text] = (f"{key[1]} {key[2]}", path)
        if e and body is not None:
            if ok and len(e["responses"]) < 2:
                e["responses"].append(body)
            elif not ok and not e["responses"]:
                e["responses"].append(body[:500] + "...")
            kind = "application/json" if ok and isinstance(value, (dict, list)) else "text/html"
            self.responses_fold[*key, str(status)] = (kind, body if ok else body[:500])
