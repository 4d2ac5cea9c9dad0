"""Byte-level BPE by rank files: encoding with a segment tree, and decoding.

A text is cut by the pre-token pattern.  A pre-token that is itself in the vocabulary is one id.  Any other is
merged over its byte positions: a segment tree holds the rank of the pair that starts at each live position,
ordered by (rank, position), so its root is the leftmost pair of least rank.  A merge changes three leaves (the
merged pair, its left neighbour, the removed position), each a logarithmic update, so a pre-token of n bytes
takes O(n log n) however long it is.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portvigil.llm.worker_cache import WorkerCache, per_worker, small

NONE = 1 << 62
#: Cached pre-tokens and words a worker keeps (of each, at most twice this), and the longest that is cached.
CACHED_PIECES = 400_000
CACHED_WORDS = 150_000
CACHED_CHARS = 64
#: Below this code point Unicode versions agree on what a letter is.
LETTERS_SETTLED = "\u0250"


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    pairs = (line.split() for line in Path(path).read_bytes().splitlines() if line)
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token."""
    n = len(piece)
    size = 1
    while size < n:
        size *= 2
    shift = size.bit_length()
    get = ranks.get
    tree = [NONE] * (2 * size)
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            tree[size + i] = rank << shift | i
    for node in range(size - 1, 0, -1):
        a, b = tree[2 * node], tree[2 * node + 1]
        tree[node] = a if a < b else b
    after = list(range(1, n + 1))  # start of the next live token; n at the end
    before = list(range(-1, n - 1))

    mask = (1 << shift) - 1
    while (top := tree[1]) != NONE:
        i = top & mask
        gone = after[i]
        end = after[gone]
        after[i] = end
        rank = left_rank = None
        if end < n:
            before[end] = i
            rank = get(piece[i : after[end]])
        left = before[i]
        if left >= 0:
            left_rank = get(piece[left:end])
        for at, value in (
            (gone, NONE),
            (left, NONE if left_rank is None else left_rank << shift | left),
            (i, NONE if rank is None else rank << shift | i),
        ):
            node = size + at
            if at < 0 or tree[node] == value:
                continue
            tree[node] = value
            while node > 1:
                other = tree[node ^ 1]
                if other < value:
                    value = other
                node >>= 1
                if tree[node] == value:
                    break
                tree[node] = value
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class NotByWords(Exception):
    """The text has a run of white space, which the pattern cuts by what surrounds it."""


class Encoder:
    """Whole texts to little-endian unsigned 32-bit ids.

    The pattern takes white space only alone or as one space before a word.  In a text without runs of white
    space every word is therefore cut in the same way wherever it stands and can be looked up: "w" stands for
    the word after a space, "\nw" for the word after a line end.  Other texts are cut as a whole.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        # \\s of this module also takes four control characters that are no white space to the library
        self.find = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.pieces = WorkerCache(self._piece, CACHED_PIECES)
        self.words = WorkerCache(self._word, CACHED_WORDS)

    def _piece(self, piece: str) -> bytes:
        data = piece.encode("utf-8", "surrogatepass")
        rank = self.ranks.get(data)
        ids = [rank] if rank is not None else merge(data, self.ranks)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _text(self, text: str) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[p] if len(p) <= CACHED_CHARS else self._piece(p) for p in self.find(text)])

    def _word(self, word: str) -> bytes:
        if word.isalpha() and max(word) < LETTERS_SETTLED and len(word) < CACHED_CHARS:
            return self.pieces[" " + word]  # letters only: a single pre-token
        if not word or word == "\n" or word[-1].isspace() or (word[0].isspace() and word[0] != "\n"):
            raise NotByWords
        return self._text(word if word[0] == "\n" else " " + word)

    def encode(self, text: str) -> bytes:
        first, *rest = text.replace("\n", " \n").split(" ")
        words, word = self.words, self._word
        if first[-1:].isspace():
            return self._text(text)
        try:
            return self._text(first) + b"".join([words[w] if len(w) <= CACHED_CHARS else word(w) for w in rest])
        except NotByWords:
            return self._text(text)


def _vocabulary(ranks: dict[bytes, int]) -> list[bytes | None]:
    tokens: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


def _decoded(ids: bytes, tokens: list[bytes | None]) -> bytes:
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(
    df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False
) -> DataFrame:
    """(id, ids): ``ids`` binary, little-endian unsigned 32-bit; with ``decoded`` also the bytes they stand for.

    A null text is encoded as the empty one, to no ids.  One row per input row; other columns are not read.
    ``path`` is read by every worker, so it must be a file that all of them have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_worker(("byte_bpe", path, pattern), lambda: Encoder(load_ranks(path), pattern))
        tokens = per_worker(("vocabulary", path), lambda: _vocabulary(load_ranks(path)))
        for batch in small(batches):
            ids = [encoder.encode(t or "") for t in batch.column(1).to_pylist()]
            columns = {id_col: batch.column(0), "ids": pa.array(ids, pa.binary())}
            if decoded:
                columns["decoded"] = pa.array([_decoded(i, tokens) for i in ids], pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    rows = df.select(id_col, F.col(text_col).cast("string").alias("text"))
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, ids binary" + ", decoded binary" * decoded)


def decode(ids, path: str):
    """Column of the bytes that a binary column of ids stands for; null stays null."""

    @F.arrow_udf("binary")
    def run(column: pa.Array) -> pa.Array:
        tokens = per_worker(("vocabulary", path), lambda: _vocabulary(load_ranks(path)))
        return pa.array([None if v is None else _decoded(v, tokens) for v in column.to_pylist()], pa.binary())

    return run(ids)
