"""Token ids of words for the lower-casing word tokenizer, with a bounded cache.

White space never joins or changes tokens of that tokenizer, so a text's ids are those of its words one after
the other.  Words of settled Latin characters are cut and looked up here and only their merges are left to the
tokenizer's model; any other word, and one that could hold a special token, goes through the whole tokenizer.
"""

from __future__ import annotations

import re
import struct

import regex
from tokenizers import Tokenizer

from portvigil.llm.worker_cache import WorkerCache

LONGEST = 64
CACHED_WORDS = 320_000
CACHED_PIECES = 100_000
#: Below this code point characters are composed and Unicode versions agree on case and kind.
SETTLED = "ɐ"

#: Python splits at these four control characters, which are no white space to the tokenizer.
_PYTHON_ONLY = re.compile("[\x1c-\x1f]")
_SPACE = regex.compile(r"[\p{White_Space}]+")
# Fixed value: the tokenizer's pattern, with its meaning of white space.
_find = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+").findall
#: The same for lower-case words of ASCII characters, which hold no white space.
_find_ascii = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+").findall


def words(text: str) -> list[str]:
    return [w for w in _SPACE.split(text) if w] if _PYTHON_ONLY.search(text) else text.split()


def load(path: str) -> Tokenizer:
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next free one."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(others)) for b in range(256)]


class _Words(WorkerCache):
    """Words longer than ``LONGEST`` are computed each time."""

    def __missing__(self, word: str) -> bytes:
        return self.compute(word) if len(word) > LONGEST else super().__missing__(word)


class WordIds:
    """``encode(text)``: ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.letters = byte_letters()
        # every id as its four bytes, made once: joining them costs less than packing the ids of each piece
        self.four = [struct.pack("<I", i) for i in range(max(self.tokenizer.get_vocab().values()) + 1)]
        model = self.tokenizer.model
        model._resize_cache(0)  # what comes here is rare; looking it up there costs more than merging it
        self.merge = model.tokenize
        self.words = _Words(self.word, CACHED_WORDS)
        self.pieces = WorkerCache(self._piece, CACHED_PIECES)

    def _piece(self, piece: str) -> bytes:
        if not (piece.isascii() and piece.isprintable()):
            piece = "".join([self.letters[b] for b in piece.encode()])
        four = self.four
        return b"".join([four[token.id] for token in self.merge(piece)])

    def word(self, word: str) -> bytes:
        low = word.lower()
        if _is_latin(word) or (max(low) < SETTLED and max(word) < SETTLED):
            if low.isalpha():
                return self._piece(low)  # as a word it is in the other cache
            if low[:-1].isalpha():  # a word before a mark or digit is mostly known without it
                return self.words[low[:-1]] + self.pieces[low[-1]]
            if "<|" not in word:
                return self._joined((_find_ascii if word.isascii() else _find)(low))
        ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _joined(self, parts: list[str]) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[p] if len(p) <= LONGEST else self._piece(p) for p in parts])

    def encode(self, text: str) -> bytes:
        if _is_latin(text) and "<|" not in text:
            text = text.lower()  # no letter of these depends on its neighbours there; fewer words differ
        return b"".join(map(self.words.__getitem__, words(text)))


def _is_latin(text: str) -> bool:
    """Whether all code points are below 256; the attempt costs less than looking for the largest one."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True
