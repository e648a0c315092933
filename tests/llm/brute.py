"""Plain, slow versions of the operators' definitions."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def removed_units(units: dict, window: int) -> dict:
    """For each document, which of its units lie in a window that also starts earlier."""
    first, marks = {}, {}
    for doc in sorted(units):
        seq = units[doc]
        marks[doc] = [False] * len(seq)
        for i in range(len(seq) - window + 1):
            key = tuple(seq[i:i + window]) if not isinstance(seq, bytes) else seq[i:i + window]
            if key in first:
                marks[doc][i:i + window] = [True] * window
            else:
                first[key] = (doc, i)
    return marks


def words(text) -> list:
    return WORD.findall(text or "")


def substring_rows(docs: dict, window: int = 20) -> dict:
    units = {d: words(t) for d, t in docs.items()}
    marks = removed_units(units, window)
    return {d: (len(units[d]), sum(marks[d]), sha(" ".join(w for w, m in zip(units[d], marks[d]) if not m))) for d in docs}


def byte_rows(docs: dict, window: int = 100) -> dict:
    units = {d: (t or "").encode() for d, t in docs.items()}
    marks = removed_units(units, window)
    out = {}
    for d, data in units.items():
        m = marks[d]
        spans = sum(1 for i, x in enumerate(m) if x and (i == 0 or not m[i - 1]))
        out[d] = (len(data), sum(m), spans, sha(bytes(b for b, x in zip(data, m) if not x)))
    return out
