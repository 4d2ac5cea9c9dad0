"""Packing documents into sequences by lexical retrieval.

1. One pass over the texts: the ids of every document, two bytes each where the vocabulary allows, and the least hash
   of its ids.  Everything else is counted from these ids.
2. Document frequencies, the number of documents and their mean length are those of all documents: one aggregate
   bounded by the vocabulary, broadcast.
3. Documents are dealt by range of (least token hash, id, row) into shards of about ``SHARD_ROWS``: texts with much in
   common tend to share a shard, and any number of copies is spread evenly over as many as they need.
4. In a shard, a BM25 inverted index returns the unused documents that are nearest to a seed, and they fill its
   window one after the other; what does not fit is cut, and its rest is the next seed.  Documents of other shards
   are not asked: README.md has the measured share of neighbours that a shard holds.  Long documents have small least
   hashes and meet in few shards; such a shard is read in parts of ``SHARD_TOKENS`` at most, each with its own index.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portvigil.llm.word_bpe import WordIds
from portvigil.llm.worker_cache import forget, per_worker, small
from portvigil.storage import written

LENGTH = 4_096
END_ID = 2
SHARD_ROWS = 8_192
#: Ids of a shard that a task holds at a time, more only for a single longer document.
SHARD_TOKENS = 12 << 20
#: A query is made of the seed's terms of highest weight.
QUERY_TERMS = 16
K1, B = 1.2, 0.75
#: Neighbours looked up at a time; more are looked up while the window has room.
NEIGHBOURS = 32

#: Documents whose terms are counted together.
_COUNTED_AT_ONCE = 256


def narrow(ids: np.ndarray, tokens: np.ndarray) -> pa.Array:
    """The ids of several documents, 16 bits wide where all of them fit."""
    data = ids.astype("<u2") if ids.max(initial=0) < 65536 else ids
    offsets = np.r_[0, np.cumsum(tokens)] * data.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(tokens), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])


def widened(ids: bytes | pa.Buffer, tokens: int) -> np.ndarray:
    """The ids of a document; their width follows from their number."""
    return np.frombuffer(ids, "<u2" if len(ids) == 2 * tokens else "<u4")


def least_hashes(ids: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Least hash of every document's ids; none of them is empty."""
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (np.minimum.reduceat(mixed ^ (mixed >> np.uint64(29)), np.cumsum(tokens) - tokens) >> np.uint64(1)).astype(np.int64)


def term_counts(docs: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Different ids of every document and how often it has them, by one sort for many documents."""
    terms, counts = [], []
    for at in range(0, len(docs), _COUNTED_AT_ONCE):
        part = docs[at : at + _COUNTED_AT_ONCE]
        ids = np.concatenate(part)
        # number of the document above the id, as narrow as possible: narrow keys are sorted faster
        key, term, bits = (np.uint32, np.uint16, 16) if ids.max() < 65536 else (np.uint64, np.uint32, 32)
        keys = ids.astype(key)
        keys |= np.repeat(np.arange(len(part), dtype=key) << key(bits), [len(d) for d in part])
        keys.sort()
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        found = keys[first]
        cuts = np.searchsorted(found, np.arange(1, len(part), dtype=key) << key(bits))
        terms += np.split(found.astype(term), cuts)  # the upper half is cut off
        counts += np.split(np.diff(np.r_[first, len(keys)]).astype(np.int32), cuts)
    return terms, counts


def encoded(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tokens, ids, near, row) of every row; ``row`` tells rows apart that are equal in all else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(("word_ids", path))
        encoder = per_worker(("word_ids", path), lambda: WordIds(path))
        end = END_ID.to_bytes(4, "little")
        for batch in small(batches):
            coded = [encoder.encode(t or "") + end for t in batch.column(1).to_pylist()]
            tokens = np.array([len(x) // 4 for x in coded], dtype=np.int64)
            ids = np.frombuffer(b"".join(coded), "<u4")
            columns = pa.array(tokens), narrow(ids, tokens).cast(pa.binary()), pa.array(least_hashes(ids, tokens))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_col, "tokens", "ids", "near"])

    texts = df.select(id_col, F.col(text_col).cast("string").alias("text"))
    kind = texts.schema[id_col].dataType.simpleString()
    rows = texts.mapInArrow(run, f"`{id_col}` {kind}, tokens long, ids binary, near long")
    return rows.withColumn("row", F.monotonically_increasing_id())


@dataclass
class Statistics:
    """Of all documents: their number, mean length, and idf by term."""

    documents: int
    mean: float
    idf: np.ndarray


def _idf(documents: int, df: np.ndarray) -> np.ndarray:
    return np.log1p((documents - df + 0.5) / (df + 0.5)).astype(np.float32)


def _summed(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sums of (key, n), at most a few for every term of the vocabulary."""
    rows = counted.groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    return rows["key"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)


def _sums(total: np.ndarray, *more: tuple[int, int]) -> pa.RecordBatch:
    keys = np.flatnonzero(total)
    columns = np.r_[keys, [k for k, _ in more]], np.r_[total[keys], [n for _, n in more]]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["key", "n"])


def statistics(docs: DataFrame) -> Statistics:
    """Over all rows of ``encoded``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, documents, tokens = np.zeros(0, dtype=np.int64), 0, 0
        for batch in small(batches):
            length, ids = (c.to_pylist() for c in batch.columns)
            if length:
                terms, _ = term_counts([widened(x, n) for x, n in zip(ids, length, strict=True)])
                more = np.bincount(np.concatenate(terms), minlength=len(df))
                more[: len(df)] += df
                df, documents, tokens = more, documents + len(length), tokens + sum(length)
        yield _sums(df, (-1, documents), (-2, tokens))

    keys, sums = _summed(docs.select("tokens", "ids").mapInArrow(run, "key long, n long"))
    df = np.zeros(max(0, keys.max(initial=-1) + 1), dtype=np.int64)
    df[keys[keys >= 0]] = sums[keys >= 0]
    documents, tokens = (int(sums[keys == k].sum()) for k in (-1, -2))
    return Statistics(documents, tokens / max(1, documents), _idf(documents, df))


class Index:
    """BM25 inverted file of one shard, over the statistics of all documents; without them, over its own."""

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray], of_all: Statistics | None = None):
        sizes = np.fromiter(map(len, terms), dtype=np.int64, count=len(terms))
        self.terms = terms
        term = np.concatenate(terms)
        count = np.concatenate(counts).astype(np.float32)
        length = np.array([c.sum(dtype=np.int64) for c in counts], dtype=np.float32)
        self.n = len(terms)
        self.df = np.bincount(term)
        self.idf = of_all.idf if of_all else _idf(self.n, self.df)
        norm = K1 * (1 - B + B * length / (of_all.mean if of_all else length.mean()))
        weight = self.idf[term]
        weight *= count
        weight *= K1 + 1
        count += np.repeat(norm, sizes)
        weight /= count
        self.bounds = np.r_[0, np.cumsum(sizes)]
        self.own = weight  # by document, for the choice of query terms
        order = np.argsort(term.astype(np.uint16, copy=False) if len(self.df) <= 65536 else term, kind="stable")  # 16 bits are sorted by counting
        del term, count
        self.start = np.r_[0, np.cumsum(self.df)]
        self.weight = weight[order]
        # as wide as an index, else every look-up widens them again
        self.doc = np.repeat(np.arange(self.n, dtype=np.int32), sizes)[order].astype(np.intp)

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document for the seed's terms of highest weight."""
        terms, own = self.terms[seed], self.own[self.bounds[seed] : self.bounds[seed + 1]]
        if len(terms) > QUERY_TERMS:
            terms = terms[np.argpartition(-own, QUERY_TERMS - 1)[:QUERY_TERMS]]
        total = np.zeros(self.n, dtype=np.float32)
        for t in terms.tolist():
            at = slice(self.start[t], self.start[t + 1])
            total[self.doc[at]] += self.weight[at]
        return total


def pack(tokens: np.ndarray, index: Index, length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece of a shard."""
    unused = np.ones(len(tokens), dtype=bool)
    pieces: list[tuple[int, int, int, int, int]] = []
    sequence, at, next_seed = 0, 0, 0
    seed, start = -1, 0  # the document that is being placed, and what of it has been
    while True:
        if seed < 0:
            while next_seed < len(tokens) and not unused[next_seed]:
                next_seed += 1
            if next_seed == len(tokens):
                return pieces
            seed, start = next_seed, 0
            unused[seed] = False
        # the seed's rest, at the beginning of a window
        at = min(length, int(tokens[seed]) - start)
        pieces.append((seed, start, at, sequence, 0))
        if start + at < tokens[seed]:
            start += at
            sequence += 1
            continue
        rest = -1
        scores = None
        while at < length and rest < 0:
            if scores is None:
                scores = index.scores(seed)
            open_scores = np.where(unused, scores, -1)
            top = np.argpartition(-open_scores, min(NEIGHBOURS, len(tokens)) - 1)[:NEIGHBOURS]
            top = top[unused[top]]
            if not len(top):
                break
            for doc in top[np.lexsort((top, -open_scores[top]))].tolist():
                room = length - at
                size = int(tokens[doc])
                unused[doc] = False
                take = min(size, room)
                pieces.append((doc, 0, take, sequence, at))
                at += take
                if take < size:
                    rest, start = doc, take
                    break
                if at == length:
                    break
        sequence += 1
        seed = rest
        start = start if rest >= 0 else 0


def parts(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """The rows in order, in tables of at most ``limit`` tokens; a longer document is a table by itself."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        ends = np.cumsum(batch.column("tokens").to_numpy())
        at = done = 0
        while at < batch.num_rows:
            to = max(at + (not held), int(np.searchsorted(ends, done + limit - total, "right")))
            if to > at:
                held.append(batch.slice(at, to - at))
                total += int(ends[to - 1]) - done
                at, done = to, int(ends[to - 1])
            if at < batch.num_rows:
                full, held, total = held, [], 0
                yield pa.Table.from_batches(full)
                del full
    if held:
        yield pa.Table.from_batches(held)


def packed(
    df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
    shard_rows: int = SHARD_ROWS, shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset): every id of every row in exactly one piece.

    A null text counts as empty; an empty one is its end id alone.  Rows that repeat an id are packed each for
    itself, also where text and id, or null ids, are the same.  A sequence has ``length`` ids without gaps; only the
    last of a shard, or of its part of ``shard_tokens``, has fewer.  An empty table gives no rows; other columns are not read.
    """
    docs = written(encoded(df, path, id_col, text_col), "packing")
    of_all = statistics(docs)
    shards = max(1, math.ceil(of_all.documents / shard_rows))
    known = df.sparkSession.sparkContext.broadcast(of_all)
    out = T.StructType(
        [docs.schema[id_col]] + [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence", "offset")]
    )
    columns = out.fieldNames()

    def fill(docs: pa.Table, first: int) -> pa.RecordBatch:
        tokens = docs["tokens"].to_numpy()
        texts = [widened(x.as_buffer(), n) for x, n in zip(docs["ids"], tokens.tolist(), strict=True)]
        index = Index(*term_counts(texts), known.value)
        doc, start, size, sequence, offset = np.array(pack(tokens, index, length), dtype=np.int64).T
        pieces = zip(doc.tolist(), start.tolist(), (start + size).tolist(), strict=True)
        crc = np.array([zlib.crc32(texts[d][s:e].astype("<u4")) for d, s, e in pieces], dtype=np.int64)
        numbers = [pa.array(x) for x in (start, size, crc, tokens[doc], sequence + first, offset)]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(docs[id_col].take(pa.array(doc)).chunks), *numbers], columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()  # the words of the first pass serve no more; an index may have their memory
        first = 0
        for docs in parts(batches, shard_tokens):
            filled = fill(docs, first)
            first = filled.column("sequence")[-1].as_py() + 1
            yield filled

    order = ("near", id_col, "row")
    dealt = docs.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    pieces = dealt.mapInArrow(run, out)
    shard = F.spark_partition_id().cast("long")
    return pieces.select(
        id_col, "start", "length", "ids_crc32", "doc_tokens", (F.shiftleft(shard, 32) + F.col("sequence")).alias("sequence_id"), "offset"
    )


def sequences(df: DataFrame, pieces: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(sequence_id, ids): the packed ids themselves.  ``pieces`` is what ``packed`` returned for ``df``, written
    before, and ids must be unique: documents are joined to their pieces, cut, and gathered by sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_worker(("word_ids", path), lambda: WordIds(path))
        end = END_ID.to_bytes(4, "little")
        for batch in small(batches):
            text, start, size = (batch.column(i).to_pylist() for i in range(3))
            cut = [
                np.frombuffer(encoder.encode(t or "") + end, "<u4")[s : s + n].astype(np.int32)
                for t, s, n in zip(text, start, size, strict=True)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[3:], pa.array(cut, pa.list_(pa.int32()))], ["sequence_id", "offset", "ids"])

    joined = pieces.join(df.select(id_col, F.col(text_col).cast("string").alias("text")), id_col)
    cut = joined.select("text", "start", "length", "sequence_id", "offset").mapInArrow(run, "sequence_id long, offset long, ids array<int>")
    gathered = cut.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("pieces"))
    return gathered.select("sequence_id", F.flatten("pieces.ids").alias("ids"))
