"""Vectors against a stated query set, shard by shard.

The vectors are dealt by hash of id and vector into shards of about ``shard_rows``; every query goes to every shard.
A task reads a shard's vectors first, builds its index once, and then answers the queries as they stream by, so it
holds one shard and one batch of queries, whatever the table's size.  The best of all shards are merged by a window
over ``k`` rows per shard and query.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from portvigil.llm.worker_cache import small

SHARD_ROWS = 16_384
_QUERIES_AT_ONCE = 2_048

#: Of a shard's vectors: (query ids, query vectors) -> one (ids, scores) per query, at least its k best in this shard.
Answer = Callable[[np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]]
#: (ids, vectors) -> their index.
Kernel = Callable[[np.ndarray, np.ndarray], Answer]


def usable(df: DataFrame, id_col: str, vec_col: str, nonzero: bool) -> DataFrame:
    """(id, v) of rows whose id is given and whose vector has only finite components, as doubles."""
    v = F.col(vec_col).cast("array<double>")
    ok = F.col(id_col).isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
    ok &= F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    if nonzero:
        ok &= F.exists("v", lambda x: x != 0)
    return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(ok)


def dense(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    flat = [chunk.flatten().to_numpy(zero_copy_only=False) for chunk in column.chunks]
    return np.concatenate(flat).reshape(-1, width) if flat else np.zeros((0, width))


def search(vectors: DataFrame, kernel: Kernel, k: int, score_type: str, query_every: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best of every query, best first, ties to the smaller id.

    ``vectors`` is what ``usable`` returns.  Queries are the rows whose id is divisible by ``query_every``;
    a row is no candidate of the query with its own id.  Vectors of different lengths are never compared.
    Rows that repeat an id and a vector count once.  Rows that repeat an id with another vector all count, as
    candidates and as queries; the ``k`` best over all of an id's vectors are returned.
    """
    vectors = vectors.distinct()  # repeated rows are combined before they are shuffled
    is_query = F.col("id") % query_every == 0
    shards = max(1, math.ceil(vectors.count() / shard_rows))
    own = F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int").alias("shard")
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    dim = F.size("v").alias("dim")
    rows = vectors.select(dim, own, F.lit(False).alias("query"), "id", "v").unionByName(
        vectors.where(is_query).select(dim, every, F.lit(True).alias("query"), "id", "v")
    )
    number = pa.float64() if score_type == "double" else pa.int64()

    def best(answer: Answer, asked: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        out = ([], [], [])
        for query_id, (found, scores) in zip(asked[0], answer(*asked), strict=True):
            keep = found != query_id
            found, scores = found[keep], scores[keep]
            top = np.lexsort((found, -scores))[:k]
            out[0].append(np.full(len(top), query_id))
            out[1].append(found[top])
            out[2].append(scores[top])
        whole = [np.concatenate(x) if x else np.zeros(0) for x in out]
        kinds = (pa.int64(), pa.int64(), number)
        return pa.RecordBatch.from_arrays([pa.array(x.astype(t.to_pandas_dtype()), t) for x, t in zip(whole, kinds)], ["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, answer = None, [], None  # the shard that is read; its vectors come before its queries
        for batch in small(batches, _QUERIES_AT_ONCE):
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
            cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1), True])
            for at, to in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                width, number_, query = keys[at].tolist()
                part = batch.slice(at, to - at)
                rows = part.column(3).to_numpy(), dense(pa.chunked_array([part.column(4)]), width)
                if (width, number_) != shard:
                    shard, held, answer = (width, number_), [], None
                if not query:
                    held.append(rows)
                elif held:
                    if answer is None:
                        answer = kernel(np.concatenate([ids for ids, _ in held]), np.concatenate([v for _, v in held]))
                    yield best(answer, rows)

    order = ("dim", "shard", "query")
    dealt = rows.repartition("dim", "shard").sortWithinPartitions(*order)
    found = dealt.mapInArrow(run, f"query_id long, vec_id long, score {score_type}")
    by_score = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
