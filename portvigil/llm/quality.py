"""Text quality from random-indexing word vectors and a small network.

1. Word vectors, from all documents: every word has a sparse random index vector; a word's context vector is the
   sum of the index vectors of its neighbours, over the whole corpus.  Words are hashed to ``BINS`` bins, so a
   task holds and hands on a table of fixed size; sums are whole numbers and do not depend on order.
2. Pooling, per document: mean and deviation of its words' vectors, the mean change from word to word (low where
   words are repeated), and its length.
3. A two-layer network on the pooled vectors of labelled rows, at most ``labelled`` of them (by a hash of the id;
   the only bounded sample here).  A temperature, fitted on a part that training does not see, calibrates the
   probabilities.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portvigil.llm.worker_cache import WorkerCache, per_worker, small
from portvigil.storage import written

BINS = 1 << 14
DIMENSIONS = 32
NONZERO = 4
WINDOW = 2
LABELLED = 20_000
HIDDEN = 32
FEATURES = 3 * DIMENSIONS + 1

_PLACES = 1 << 40
_CACHED = 200_000
_CACHED_CHARS = 64
_find = re.compile(r"\w+|[^\w\s]+").findall
#: Words of a very long text that are turned into vectors at a time.
_POOLED_AT_ONCE = 65_536


def _chunk_bins(chunk: str) -> tuple[int, ...]:
    return tuple(zlib.crc32(word.encode("utf-8", "surrogatepass")) & (BINS - 1) for word in _find(chunk))


def word_bins(text: str) -> np.ndarray:
    """Bins of the words and the runs of other signs of a text, in order."""
    cache = per_worker("quality_words", lambda: WorkerCache(_chunk_bins, _CACHED))
    found = [cache[c] if len(c) <= _CACHED_CHARS else _chunk_bins(c) for c in text.split()]
    return np.fromiter(chain.from_iterable(found), dtype=np.int64)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of every bin's index vector."""
    rng = np.random.default_rng(7)
    places = np.argsort(rng.random((BINS, DIMENSIONS)), axis=1)[:, :NONZERO]
    return places, rng.choice([-1.0, 1.0], (BINS, NONZERO))


def _context_sums(docs: list[np.ndarray], total: np.ndarray) -> None:
    places, signs = per_worker("quality_index", index_vectors)
    # documents one after the other, so far apart that no window spans two
    gap = np.full(WINDOW, -1)
    words = np.concatenate([x for d in docs for x in (d, gap)]) if docs else gap
    for offset in range(1, WINDOW + 1):
        a, b = words[:-offset], words[offset:]
        inside = (a >= 0) & (b >= 0)
        if offset > 1:
            for between in range(1, offset):
                inside &= words[between : len(words) - offset + between] >= 0
        a, b = a[inside], b[inside]
        for word, neighbour in ((a, b), (b, a)):
            for k in range(NONZERO):
                flat = word * DIMENSIONS + places[neighbour, k]
                total += np.bincount(flat, signs[neighbour, k], minlength=BINS * DIMENSIONS)


def word_vectors(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """Unit context vectors of all bins, from every text: BINS x DIMENSIONS."""
    names = [f"c{i}" for i in range(DIMENSIONS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS * DIMENSIONS)
        for batch in small(batches):
            _context_sums([word_bins(t or "") for t in batch.column(0).to_pylist()], total)
        table = total.reshape(BINS, DIMENSIONS).astype(np.int64)
        used = np.flatnonzero(table.any(axis=1))
        columns = [pa.array(used, pa.int64()), *(pa.array(table[used, i]) for i in range(DIMENSIONS))]
        yield pa.RecordBatch.from_arrays(columns, ["bin", *names])

    texts = df.select(F.col(text_col).cast("string").alias("text"))
    sums = texts.mapInArrow(run, "bin long, " + ", ".join(f"{n} long" for n in names))
    rows = sums.groupBy("bin").agg(*(F.sum(n).alias(n) for n in names)).toPandas()  # at most BINS rows
    vectors = np.zeros((BINS, DIMENSIONS))
    vectors[rows["bin"].to_numpy(dtype=np.int64)] = rows[names].to_numpy(dtype=float)
    return _unit(vectors)


def _unit(v: np.ndarray) -> np.ndarray:
    """Without what all words have in common, at length one."""
    length = np.sqrt((v * v).sum(axis=1, keepdims=True))
    v = np.divide(v, length, out=np.zeros_like(v), where=length > 0)
    v = np.where(length > 0, v - v.sum(axis=0) / max(1, (length > 0).sum()), 0.0)
    length = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return np.divide(v, length, out=np.zeros_like(v), where=length > 0).astype(np.float32)


def pool(words: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """FEATURES numbers of one document; zeros for one without words."""
    n = len(words)
    out = np.zeros(FEATURES)
    if not n:
        return out
    total, squares, change = (np.zeros(DIMENSIONS) for _ in range(3))
    for at in range(0, n, _POOLED_AT_ONCE):
        v = vectors[words[at : at + _POOLED_AT_ONCE + 1]]
        change += np.abs(v[1:] - v[:-1]).sum(axis=0)
        v = v[:_POOLED_AT_ONCE]
        total += v.sum(axis=0)
        squares += (v * v).sum(axis=0)
    mean = total / n
    out[:DIMENSIONS] = mean
    out[DIMENSIONS : 2 * DIMENSIONS] = np.sqrt(np.maximum(squares / n - mean * mean, 0))
    out[2 * DIMENSIONS : 3 * DIMENSIONS] = change / max(1, n - 1)
    out[-1] = np.log1p(n)
    return out


def pooled(
    df: DataFrame, vectors: np.ndarray, id_col: str = "doc_id", text_col: str = "text", carried: tuple[str, ...] = ()
) -> DataFrame:
    """(id, carried columns, pooled) for every row."""
    shared = df.sparkSession.sparkContext.broadcast(vectors)  # BINS x DIMENSIONS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in small(batches):
            rows = [pool(word_bins(t or ""), table).astype(np.float32) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, pa.list_(pa.float32()))], [*kept, "pooled"])

    kept = (id_col, *carried)
    texts = df.select(*kept, F.col(text_col).cast("string").alias("text"))
    schema = ", ".join(f"`{k}` {texts.schema[k].dataType.simpleString()}" for k in kept)
    return texts.mapInArrow(run, f"{schema}, pooled array<float>")


@dataclass
class Network:
    """Two layers on standardised inputs; ``temperature`` divides the last one's output."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x) / self.temperature)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, epochs: int = 60, batch: int = 256, rate: float = 3e-3, decay: float = 1e-4) -> Network:
    """Adam on the log loss; every fifth row is kept for the temperature."""
    rng = np.random.default_rng(11)
    if len(y) == 0:
        return Network(np.zeros(FEATURES), np.ones(FEATURES), np.zeros((FEATURES, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0)
    apart = np.arange(len(y)) % 5 == 4
    tx, ty = x[~apart], y[~apart]
    scale = tx.std(axis=0)
    net = Network(
        tx.mean(axis=0), np.where(scale > 1e-9, scale, 1.0), rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)),
        np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), 0.0,
    )
    z = (tx - net.mean) / net.scale
    values = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
    for epoch in range(epochs):
        order = rng.permutation(len(ty))
        now = rate * (1 - epoch / epochs)
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            hidden = np.maximum(z[pick] @ values[0] + values[1], 0)
            error = (_sigmoid(hidden @ values[2] + values[3]) - ty[pick]) / len(pick)
            back = np.outer(error, values[2]) * (hidden > 0)
            slopes = [z[pick].T @ back + decay * values[0], back.sum(axis=0), hidden.T @ error + decay * values[2], np.array([error.sum()])]
            step += 1
            for i, slope in enumerate(slopes):
                first[i] = 0.9 * first[i] + 0.1 * slope
                second[i] = 0.999 * second[i] + 0.001 * slope * slope
                values[i] = values[i] - now * first[i] / (1 - 0.9**step) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = values[0], values[1], values[2], float(values[3][0])
    if apart.any():
        z, t = net.logits(x[apart]), y[apart]

        def loss(temperature: float) -> float:
            p = np.clip(_sigmoid(z / temperature), 1e-12, 1 - 1e-12)
            return float(-(t * np.log(p) + (1 - t) * np.log(1 - p)).mean())

        net.temperature = float(min(np.geomspace(0.2, 20, 101), key=loss))
    return net


def held_out(id_col: str) -> Column:
    """Whether a row's label may not be learnt: crc32 of its id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score(
    df: DataFrame, labels: DataFrame, label_col: str = "quality", labelled: int = LABELLED, id_col: str = "doc_id", text_col: str = "text",
    carried: tuple[str, ...] = (),
) -> DataFrame:
    """(id, carried columns, held_out, score, predicted) for every row.

    Learns from rows that have a label 0 or 1 and are not held out; other labels and null ids teach nothing.
    Without such rows every score is 0.5.  A null text counts as empty; texts without words share one score;
    rows may repeat; an empty table gives no rows; of ``df`` only the id, the text and
    ``carried`` are read.
    """
    spark = df.sparkSession
    rows = written(pooled(df, word_vectors(df, text_col), id_col, text_col, carried), "pooled")
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).cast("double").alias("label"))
    train = rows.where(~held_out(id_col)).join(known, id_col)
    place = F.pmod(F.xxhash64(id_col), F.lit(_PLACES))
    share = min(1.0, 1.2 * labelled / max(1, train.count()))  # else every task would send ``labelled`` rows
    few = train.where(place < int(share * _PLACES) + 1)
    sample = few.orderBy(place, id_col).limit(labelled).select("pooled", "label").toPandas()
    x = np.array(sample["pooled"].tolist(), dtype=float).reshape(-1, FEATURES)
    network = spark.sparkContext.broadcast(fit(x, sample["label"].to_numpy(dtype=float)))

    @F.arrow_udf("double")
    def probability(column: pa.Array) -> pa.Array:
        values = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
        return pa.array(network.value.probability(values.astype(float)))

    scored = rows.select(id_col, *carried, held_out(id_col).alias("held_out"), probability("pooled").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
