"""Token ids of whole texts with the ``tokenizers`` library, one call per new piece.

The vocabulary's normaliser lower-cases and its pre-tokeniser cuts a text into
runs of letters, single digits, runs of marks and a few endings; each piece is
encoded on its own.  So the ids of a text are those of its pieces one after
the other.  Arrow cuts a chunk of texts into pieces and numbers the distinct
ones; only pieces that a worker doesn't know go through the library, and numpy
puts the ids together.  A worker keeps two generations of ``GENERATION``
pieces, of which the older one goes when the younger is full, so common pieces
stay and memory is bounded.

Texts with characters beyond ASCII and the Latin-1 letters are cut word by
word, and words with such characters go through the library as a whole; so do
texts with white space that ``str.split`` would treat otherwise.  A vocabulary
file with another normaliser or pre-tokeniser goes through the library only.
"""

from __future__ import annotations

import functools
import json
import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GENERATION = 200_000
CHUNK_BYTES = 1 << 22
# The normaliser and pre-tokeniser that the pieces below follow.
NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
     "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
# The pieces of lower-cased text of ASCII and Latin-1 letters, which are in composed form.
APART = "('s|'t|'re|'ve|'m|'ll|'d|[0-9]|[!-/:-@\\[-`{-~]+)"  # letters are what lies between
PIECES = re.compile(APART + "|[a-zß-öø-ÿ]+")
LATIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
OTHER = "[^\\t-\\r -~À-ÖØ-öø-ÿ]|<\\|"
# White space outside the ASCII set, its controls, and the start of a special token's name.
UNUSUAL = re.compile("[\x1c-\x1f\x85\xa0  -     　]|<\\|")


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies (its public rule:
    printable Latin-1 bytes stand for themselves, the others follow from 256 on)."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(rest)}


def spread(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0], ... first[0] + sizes[0] - 1, first[1], ...: the positions of ranges."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(first - (ends - sizes), sizes)


class PieceIds(dict):
    """piece, or word beyond Latin-1 -> its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        super().__init__()
        self.older: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        steps = json.loads(self.tokenizer.to_str())
        self.by_pieces = (steps["normalizer"], steps["pre_tokenizer"], steps["model"]["type"]) == (NORMALIZER, PRE_TOKENIZER, "BPE")
        letters = byte_letters()
        self.letters = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(128, 256)}
        self.raw = [struct.pack("<I", i) for i in range(self.tokenizer.get_vocab_size())]

    def by_library(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def by_model(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = piece.translate(self.letters)
        raw = self.raw
        return b"".join([raw[t.id] for t in self.model.tokenize(piece)])

    def __missing__(self, piece: str) -> bytes:
        """Only pieces, and single words beyond Latin-1, are asked for."""
        ids = self.older.get(piece)
        if ids is None:
            ids = self.by_model(piece) if piece.isascii() and piece.isprintable() or LATIN.fullmatch(piece) else self.by_library(piece)
        self[piece] = ids
        return ids

    def _age(self) -> None:
        if len(self) > GENERATION:
            self.older = dict(self)
            self.clear()

    def text(self, text: str | None) -> bytes:
        """The ids of one text."""
        self._age()
        if not text:
            return b""
        if not self.by_pieces or UNUSUAL.search(text):
            return self.by_library(text)
        return b"".join([b"".join([self[m.group()] for m in PIECES.finditer(w.lower())]) if LATIN.fullmatch(w) else self[w]
                         for w in text.split()])

    def texts(self, texts: pa.Array):
        """(flat ids, offsets) of the texts of an array, chunk by chunk (null: no ids)."""
        texts = pc.fill_null(texts, "")
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        first = 0
        while first < len(sizes):
            last = first + max(1, int(np.searchsorted(np.cumsum(sizes[first:first + CHUNK_BYTES]), CHUNK_BYTES)))
            yield self._chunk(texts.slice(first, last - first))
            first = last

    def _chunk(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        self._age()
        plain = ~pc.match_substring_regex(texts, OTHER).to_numpy(zero_copy_only=False) if self.by_pieces \
            else np.zeros(len(texts), bool)
        lists = pc.ascii_split_whitespace(pc.replace_substring_regex(
            pc.utf8_lower(texts.filter(pa.array(plain))), APART, " \\1 "))
        coded = lists.flatten().dictionary_encode()
        known = [self[p] for p in coded.dictionary.to_pylist()]
        ids = np.frombuffer(b"".join(known), "<u4")
        of_piece = np.fromiter(map(len, known), np.int64, len(known)) // 4
        at, begin = coded.indices.to_numpy(), np.r_[0, np.cumsum(of_piece)]
        flat = ids[spread(begin[at], of_piece[at])]
        ends = np.r_[0, np.cumsum(of_piece[at])][lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        if plain.all():
            return flat, ends
        some = iter([flat[a:b] for a, b in zip(ends[:-1], ends[1:])])
        parts = [next(some) if p else np.frombuffer(self.text(t), "<u4") for p, t in zip(plain, texts.to_pylist())]
        return np.concatenate(parts), np.r_[0, np.cumsum([len(p) for p in parts])]


@functools.lru_cache(maxsize=1)
def word_ids(path: str) -> PieceIds:
    """One per Python worker: that of the last vocabulary file asked for."""
    return PieceIds(path)
