"""Words of whole texts: runs of ASCII letters, digits and all code points beyond
ASCII, with A-Z lower-cased, as UTF-8 bytes."""

from __future__ import annotations

import re

# 0-9, a-z and the bytes of code points beyond ASCII stay, A-Z go to a-z, the rest parts words.
KEPT = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
IN_TEXT = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
# The same words in DuckDB's regular expressions, after A-Z are lower-cased.
SQL_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SQL_WORDS = ("regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '"
             + SQL_PATTERN + "')")


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(KEPT).split() if text else []


def positions(text: str) -> list[tuple[int, int]]:
    """(start, end) in code points of each of ``words(text)``."""
    return [m.span() for m in IN_TEXT.finditer(text)]
