"""Character classes for texts of Latin letters, where the standard library's patterns suffice.

Vocabularies state their splits with Unicode properties. Over the code points below U+0250 and
common signs the same classes can be listed, and ``re`` splits such texts faster than a module
that knows all properties; other texts keep to the stated pattern.
"""

from __future__ import annotations

import re
import unicodedata

_END = 0x250
#: Signs beyond that range: dashes, curly quotes, ellipsis, euro.
_SIGNS = "‐-—‘-”…€"
_PLAIN = re.compile(rf"[\x00-\u{_END - 1:04x}{_SIGNS}]*")


def _ranges(first_of_category: str) -> str:
    out, start = [], None
    for c in range(_END + 1):
        inside = c < _END and unicodedata.category(chr(c))[0] == first_of_category
        if inside and start is None:
            start = c
        if not inside and start is not None:
            out.append(f"\\u{start:04x}-\\u{c - 1:04x}")
            start = None
    return "".join(out)


LETTERS, NUMBERS = _ranges("L"), _ranges("N")
SPACES = "\\t-\\r \\x85\\xa0"


def is_plain(text: str) -> bool:
    return text.isascii() or _PLAIN.fullmatch(text) is not None
