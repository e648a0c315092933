"""Terms of texts: runs of ASCII letters and of bytes beyond ASCII, only A-Z lower-cased ([^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+)."""

from __future__ import annotations

from collections.abc import Iterator

#: What each byte of a text becomes: a lower-case letter, itself beyond ASCII, else a blank.
_FOLD = bytes(c | 0x20 if chr(c).isalpha() else 0x20 for c in range(128)) + bytes(range(128, 256))
#: Bytes of text that are split at once; a text is cut at blanks only.
AT_ONCE = 4 << 20


def term_parts(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of some MB, so that a very long text needs no list of all its terms."""
    folded = (text or b"").translate(_FOLD)
    begin = 0
    while begin < len(folded):
        end = len(folded)
        if end - begin > AT_ONCE:
            cut = folded.rfind(b" ", begin, begin + AT_ONCE)
            cut = cut if cut > begin else folded.find(b" ", begin + AT_ONCE)
            end = cut if cut >= 0 else end
        yield folded[begin:end].split()
        begin = end
