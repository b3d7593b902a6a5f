"""Small document tables for the text operators' tests."""

from __future__ import annotations

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "score string, n string, h string, id string, slot string, base string, component_id string")
FILLER = ("x", "y", "z", "i", "s", "b", "c")  # extra columns with names that operators use


def frame(spark, rows):
    """rows: (doc_id, text[, lang[, source]])."""
    full = []
    for r in rows:
        r = (*r, *[None] * (4 - len(r)))
        full.append((r[0], r[1], r[2], r[3], None if r[1] is None else len(r[1]), *FILLER))
    return spark.createDataFrame(full, SCHEMA)


def words(seed: int, n: int, vocabulary: int = 3000) -> list[str]:
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def edge_rows():
    """Nulls in any column, empty, blank and very long texts, ties and repeated rows."""
    long_text = " ".join(words(1, 60_000)) + "\n" + "7" * 30_000 + "\n" + "the cat " * 5_000
    return [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None), (4, "...!?", "en", "b"),
        (None, "a text without an id but with the word the and more words", None, "a"),
        (None, None, None, None), (6, long_text, "en", "a"), (7, "short", "de", "b"), (8, "short", "de", "b"),
        (9, "the same row twice and the same words again here", "en", "a"),
        (9, "the same row twice and the same words again here", "en", "a"),
        (10, "Écolé über \U0001f600 naïve straße 你好", "fr", None),
        (11, "line one\n\nline two\r\nline one", "en", "c"), (12, "\x00\x1c\x85 odd blanks here", "en", "c"),
    ]
