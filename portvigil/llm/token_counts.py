"""Token counts by a two-tier lookup on the map side.

A word (text between white space) always has the same tokens, so a text's count is the sum over its words.

1. One pass: every task counts its words and hands on a summary of its most frequent ones.  The summaries are
   summed and the most frequent words, at most ``frequent``, are encoded once; this table of word lengths in
   tokens is broadcast.  It holds ``frequent`` words of at most ``LONGEST`` characters, whatever the input.
2. One pass: lengths come from that table, and for the rest from a bounded cache of each worker, filled by the
   tokenizer.  No word leaves its task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portvigil.llm.word_bpe import LONGEST, WordIds, load, words
from portvigil.llm.worker_cache import WorkerCache, per_worker, small

FREQUENT = 32_768
SUMMARY = 4_096
#: Words a task counts at a time before it forgets those seen once.
COUNTED = 200_000
CACHED = 300_000


def frequent_words(df: DataFrame, text_col: str, frequent: int = FREQUENT, summary: int = SUMMARY) -> list[str]:
    """The most frequent words of all texts, nearly: each task forgets words it saw once when it has too many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in small(batches):
            for text in batch.column(0).to_pylist():
                counts.update(words(text or ""))
                if len(counts) > COUNTED:
                    kept = Counter({w: n for w, n in counts.items() if n > 1})
                    counts = kept if len(kept) <= COUNTED // 2 else Counter(dict(kept.most_common(COUNTED // 2)))
        top = [(w, n) for w, n in counts.most_common(summary) if len(w) <= LONGEST]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["word", "n"])

    summaries = df.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word string, n long")
    top = summaries.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(frequent)
    return [row.word for row in top.collect()]


def count_tokens(
    df: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row; over_limit is n_tokens > ``limit``.

    No special tokens are added; their strings inside a text are handled as the library does by default.  A null
    text counts as empty, with 0 bytes and 0 tokens; an empty table gives no rows; other columns are not read.
    ``path`` must be a file that every worker has.
    """
    tokenizer = load(path)
    top = frequent_words(df, text_col, frequent)
    table = {w: len(e.ids) for w, e in zip(top, tokenizer.encode_batch(top, add_special_tokens=False), strict=True)}
    shared = df.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make() -> WorkerCache:
            own = WordIds(path)
            return WorkerCache(lambda w: len(own.word(w)) // 4, CACHED)

        rare = per_worker(("token_counts", path), make)
        common = shared.value
        for batch in small(batches):
            sizes, counts = [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                found = list(map(common.get, (split := words(text))))
                if None in found:
                    total = sum([n for n in found if n is not None])
                    total += sum([rare[w] if len(w) <= LONGEST else rare.compute(w) for w, n in zip(split, found, strict=True) if n is None])
                else:
                    total = sum(found)
                sizes.append(len(text.encode()))
                counts.append(total)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], [id_col, "n_bytes", "n_tokens"])

    rows = df.select(id_col, F.col(text_col).cast("string").alias("text"))
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
