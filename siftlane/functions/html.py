"""HTML pages as element arrays, and the HTML and CSS text rewrites.

``element_array`` is the one parser: an Arrow UDF over a column of pages that returns each
page's elements in document order.  Everything else about a page (forms, fields, options,
pickers) is array work on that column, so it needs no shuffle: a page is one row.
"""

from __future__ import annotations

import re
from html import unescape
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- Fixed values of the HTML standard ------------------------------------------------

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

# Content of these is text up to the end tag; character references count in the second group.
_RAW = frozenset("script style xmp iframe noembed noframes".split())
_ESCAPABLE_RAW = frozenset("textarea title".split())

# A start tag closes these if they are the open element.
_CLOSES = {
    "option": {"option"}, "optgroup": {"option", "optgroup"}, "li": {"li"},
    "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "dt": {"dt", "dd"}, "dd": {"dt", "dd"},
}

# A start tag of these ends an open paragraph.
_ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())

# Paragraphs are not closed across these.
_PARAGRAPH_SCOPE = frozenset("body button caption html td template th".split())

# Which attribute holds the address of an element.
_REFERENCES = {"form": "action", "link": "href"}

# --- End of fixed values --------------------------------------------------------------

# Comments and declarations, or a start or end tag; quotes only count after an equals sign.
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""",
    re.DOTALL)
_UNCLOSED = re.compile("<[!?]")
_ATTRIBUTE = re.compile(r"""([^\s/=][^\s/=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s]*+)))?+""")

ELEMENTS = ("array<struct<ord int, last_ord int, parent_ord int, form_ord int, tag string, "
            "attrs map<string,string>, text string, target string, hosts array<int>, inert boolean, "
            "start int, size int>>")


#: Characters kept of the reason why a page could not be read.
MOST_ERROR = 200


def _join(base: str, reference: str) -> str | None:
    try:
        return urljoin(base, reference)
    except ValueError:
        return None


def _attributes(text: str) -> dict[str, str]:
    named: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(text):
        value = double or single or bare
        named.setdefault(name.lower(), unescape(value) if "&" in value else value)  # the first one counts
    return named


class _ElementBatch:
    """Element columns of a batch of pages; positions are relative to each page."""

    def __init__(self, wants_text):
        self.wants_text = wants_text
        self.offsets, self.absent, self.errors = [0], [], []
        self.last, self.parent, self.form, self.tag, self.text, self.target = [], [], [], [], [], []
        self.hosts, self.inert, self.start, self.size = [], [], [], []
        self.names, self.values, self.attr_offsets = [], [], [0]

    def add(self, page: str | None, url: str | None, keep_errors: bool = False) -> None:
        error = None
        if page is not None:
            try:
                self._read(page, url or "")
            except Exception as e:
                if not keep_errors:
                    raise
                error = f"{type(e).__name__}: {e}"[:MOST_ERROR]
                self._forget()
        self.absent.append(page is None or error is not None)
        self.errors.append(error)
        self.offsets.append(len(self.tag))

    def _forget(self) -> None:
        """Take back what the page that is being read has added."""
        first = self.offsets[-1]
        del self.attr_offsets[first + 1:]
        for column in (self.names, self.values):
            del column[self.attr_offsets[-1]:]
        for column in (self.last, self.parent, self.form, self.tag, self.text, self.target, self.hosts, self.inert, self.start, self.size):
            del column[first:]

    def _close(self, open_: list, depth: int, last: int) -> None:
        for ord_, _, begin in open_[depth:]:
            self.last[self.offsets[-1] + ord_] = last
            if begin is not None:
                self.text[self.offsets[-1] + ord_] = "".join(self.taken[begin:])
                self.wanting -= 1
        del open_[depth:]
        if not self.wanting:
            self.taken.clear()

    def _close_implied(self, open_: list, tag: str, last: int) -> None:
        closes = _CLOSES.get(tag)
        while closes and open_ and open_[-1][1] in closes:
            self._close(open_, len(open_) - 1, last)
        if tag in _ENDS_PARAGRAPH:
            for depth in range(len(open_) - 1, -1, -1):
                if open_[depth][1] == "p":
                    self._close(open_, depth, last)
                elif open_[depth][1] not in _PARAGRAPH_SCOPE:
                    continue
                break

    def _take_text(self, text: str) -> None:
        """One buffer serves all open elements; each holds the place where its text begins."""
        if self.wanting:
            self.taken.append(text)

    def _read(self, page: str, base: str) -> None:
        first, open_, at, based = self.offsets[-1], [], 0, False  # open_: (ord, tag, where its text begins)
        self.taken, self.wanting = [], 0
        closed = page.rfind(">") + 1  # no tag ends beyond: tags that never close are not looked at one by one
        while token := _TOKEN.search(page, at, closed):
            if token.start() > at and self.wanting:
                self._take_text(unescape(page[at:token.start()]))
            at, last = token.end(), len(self.tag) - first - 1
            slash, tag, rest = token.groups()
            if tag is None:
                if at == closed and token.group().startswith("<!--") and not token.group().endswith("-->"):
                    at = len(page)  # a comment that never ends
                continue
            tag = tag.lower()
            if slash:
                for depth in range(len(open_) - 1, -1, -1):
                    if open_[depth][1] == tag:
                        self._close(open_, depth, last)
                        break
                continue
            self._close_implied(open_, tag, last)
            parent = open_[-1][0] if open_ else None
            form = self.form[first + parent] if open_ else None
            if tag == "form" and form is not None:
                continue  # nested forms are dropped
            ord_, attrs = last + 1, _attributes(rest) if rest else {}
            hosts, inert = (self.hosts[first + parent], self.inert[first + parent]) if open_ else ([], False)
            if open_ and open_[-1][1] == "template":
                low, high = self.attr_offsets[first + parent], self.attr_offsets[first + parent + 1]
                if "shadowrootmode" in self.names[low:high]:
                    host = self.parent[first + parent]
                    hosts = [*hosts, -1 if host is None else host]
                else:
                    inert = True
            if tag == "base" and "href" in attrs and not based:
                base, based = _join(base, attrs["href"].strip()) or base, True
            reference = attrs.get(_REFERENCES[tag], "").strip() if tag in _REFERENCES else ""
            begin = len(self.taken) if self.wants_text(tag, attrs) else None
            self.last.append(ord_)
            self.parent.append(parent)
            self.form.append(ord_ if tag == "form" else form)
            self.tag.append(tag)
            self.text.append(None if begin is None else "")
            self.target.append(_join(base, reference) if reference else None)
            self.hosts.append(hosts)
            self.inert.append(inert)
            self.start.append(token.start())
            self.size.append(at - token.start())
            self.names.extend(attrs.keys())
            self.values.extend(attrs.values())
            self.attr_offsets.append(len(self.names))
            if tag in _VOID:
                continue
            open_.append((ord_, tag, begin))
            self.wanting += begin is not None
            if tag in _RAW or tag in _ESCAPABLE_RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(page, at)
                stop = end.start() if end else len(page)
                text = page[at:stop]
                self._take_text(unescape(text) if tag in _ESCAPABLE_RAW else text)
                at = stop
        if at < len(page):
            self._take_text(unescape(_UNCLOSED.split(page[at:], maxsplit=1)[0]))
        self._close(open_, 0, len(self.tag) - first - 1)

    def to_arrow(self) -> pa.Array:
        ords = [i for low, high in zip(self.offsets, self.offsets[1:]) for i in range(high - low)]
        attrs = pa.MapArray.from_arrays(pa.array(self.attr_offsets, pa.int32()), pa.array(self.names, pa.string()),
                                        pa.array(self.values, pa.string()))
        ints = {"ord": ords, "last_ord": self.last, "parent_ord": self.parent, "form_ord": self.form}
        columns = {name: pa.array(values, pa.int32()) for name, values in ints.items()}
        columns |= {
            "tag": pa.array(self.tag, pa.string()), "attrs": attrs, "text": pa.array(self.text, pa.string()),
            "target": pa.array(self.target, pa.string()), "hosts": pa.array(self.hosts, pa.list_(pa.int32())),
            "inert": pa.array(self.inert, pa.bool_()), "start": pa.array(self.start, pa.int32()),
            "size": pa.array(self.size, pa.int32())}
        rows = pa.StructArray.from_arrays(list(columns.values()), names=list(columns))
        return pa.ListArray.from_arrays(pa.array(self.offsets, pa.int32()), rows, mask=pa.array(self.absent, pa.bool_()))


#: Pages whose elements are Python objects at once; a batch has up to 10,000 pages.
PAGES_AT_ONCE = 256


def _parsed(pages: pa.Array, urls: pa.Array, wants_text, keep_errors: bool) -> pa.Array:
    """Elements of a batch of pages, parsed a few pages at a time."""
    found = []
    for i in range(0, max(len(pages), 1), PAGES_AT_ONCE):
        batch = _ElementBatch(wants_text)
        for page, at in zip(pages.slice(i, PAGES_AT_ONCE).to_pylist(), urls.slice(i, PAGES_AT_ONCE).to_pylist()):
            batch.add(page, at, keep_errors)
        els = batch.to_arrow()
        found.append(pa.StructArray.from_arrays([els, pa.array(batch.errors, pa.string())], names=["els", "error"]) if keep_errors else els)
    return pa.concat_arrays(found)


def element_array(html: Column, url: Column, text_tags: tuple[str, ...] = ("option", "textarea"),
                  text_roles: tuple[str, ...] = (), text_classes: tuple[str, ...] = (), keep_errors: bool = False) -> Column:
    """Elements of a page in document order.

    ``text`` (whole descendant text) is filled for the given tags, roles and class fragments
    and null elsewhere, so nesting does not multiply the page.  ``target`` is the absolute
    address of forms and links, ``<base href>`` respected.  ``ord`` is the array index,
    ``last_ord`` the index of the last descendant, ``hosts`` the enclosing shadow hosts,
    ``inert`` marks plain template content, ``start`` and ``size`` locate the start tag.
    Null pages give null.  A page that cannot be read ends the job; with ``keep_errors`` the
    result is a struct of the elements (``els``, null then) and the reason (``error``, null else).
    """
    def wants_text(tag, attrs):
        return (tag in text_tags or (text_roles and attrs.get("role") in text_roles)
                or (text_classes and "class" in attrs and any(c in attrs["class"] for c in text_classes)))

    @F.arrow_udf(f"struct<els: {ELEMENTS}, error: string>" if keep_errors else ELEMENTS)
    def parse(pages: pa.Array, urls: pa.Array) -> pa.Array:
        return _parsed(pages, urls, wants_text, keep_errors)

    # Marked so that a filter on the result does not make Catalyst parse a page twice.
    return parse.asNondeterministic()(html, url)


# Fixed pattern: which ``url(...)`` count as relative.
_CSS_URL = re.compile(r"""url\((?!['"]?(?:data:|https:|http:))['"]?([^'")]*)['"]?\)""", re.IGNORECASE)


@F.arrow_udf(T.StringType())
def absolutise_css(css: pa.Array, base: pa.Array) -> pa.Array:
    """Relative ``url(...)`` references of a style sheet made absolute.

    A reference that forms no address with the sheet's own stays as it is.
    """
    out = []
    for sheet, url in zip(css.to_pylist(), base.to_pylist()):
        def absolute(m: re.Match, url: str = url or "") -> str:
            joined = _join(url, m.group(1))
            return m.group(0) if joined is None else f"url('{joined}')"

        out.append(None if sheet is None else _CSS_URL.sub(absolute, sheet))
    return pa.array(out, pa.string())


def inject_base(html: Column, url: Column) -> Column:
    """Put ``<base href>`` after the first ``<head>`` (exact match), else in front."""
    tag = F.concat(F.lit('<base href="'), url, F.lit('">'))
    at = F.instr(html, "<head>")
    return F.when(at > 0, F.concat(
        F.substring(html, F.lit(1), at + 5), F.lit("\n    "), tag,
        F.substring(html, at + 6, F.length(html)))).otherwise(F.concat(tag, F.lit("\n"), html))
