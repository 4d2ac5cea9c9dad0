"""Runs of repeating words: maximal stretches of a text that repeat their first words over and over.

The texts of a batch are numbered word by word, equal words of one text alike and words of different texts apart,
and searched together by an enhanced suffix array:

1. The suffix array comes from sorting prefixes of doubling length, its inverse (ISA) with it; only suffixes that are
   still tied are sorted again.
2. Longest common prefixes: where the words before two neighbouring suffixes are equal too, the prefix is one shorter
   than that of the suffixes one word earlier.  The others are compared word by word; together they are short.
3. Every LCP interval of depth d holds the suffixes that share d words.  Of its children, the ranges that share more,
   all but the largest are walked: a suffix i whose i + d or i - d lies in the interval, outside the child, by its
   ISA, begins (or ends) a branching square: two equal halves of d words after which the period breaks.
4. A branching square is rotated to the left as long as its words repeat; what it covers is a maximal run.  Squares
   whose half is itself a repetition end where the run of the shorter period ends and are left out.

No tree is built: intervals are index ranges, found for all of a batch by nearest smaller values.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portvigil.llm.worker_cache import small

#: A run repeats its first words at least so often, and holds at least so many words.
REPEATS, LEAST = 4, 6
#: Words that are searched together; a longer text is searched alone.
WORDS_AT_ONCE = 300_000
RUNS = "array<struct<start:long,length:long,period:long>>"


def suffix_array(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(SA, ISA) of ``x``; of a suffix and its own beginning the shorter one comes first."""
    n = len(x)
    order = np.argsort(x, kind="stable")
    rank = np.zeros(n, dtype=np.int64)  # of a suffix: the place where its group of equal prefixes begins
    sorted_x = x[order]
    heads = np.flatnonzero(np.r_[True, sorted_x[1:] != sorted_x[:-1]]) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[heads, n])
    rank[order] = np.repeat(heads, sizes)
    tied = np.repeat(sizes > 1, sizes).nonzero()[0]
    h = 1
    while len(tied):
        i = order[tied]
        group = rank[i]
        after = np.full(len(i), -1, dtype=np.int64)
        inside = i + h < n
        after[inside] = rank[i[inside] + h]
        by = np.lexsort((after, group))
        i, group, after = i[by], group[by], after[by]
        order[tied] = i
        head = np.r_[True, (group[1:] != group[:-1]) | (after[1:] != after[:-1])]
        at = np.flatnonzero(head)
        size = np.diff(np.r_[at, len(i)])
        rank[i] = np.repeat(tied[at], size)
        tied = tied[np.repeat(size > 1, size)]
        h *= 2
    return order, rank


def _common(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words from ``a`` on equal those from ``b`` on; ``x`` ends with a word of its own, a < b."""
    out = np.zeros(len(a), dtype=np.int64)
    left = np.arange(len(a))
    while len(left) > 32:
        same = x[a[left] + out[left]] == x[b[left] + out[left]]
        left = left[same]
        out[left] += 1
    for k in left.tolist():
        out[k] += _extent(x[a[k] + out[k] :], x[b[k] + out[k] :])
    return out


def _extent(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning of two arrays, read in blocks of growing size."""
    most, at, step = min(len(a), len(b)), 0, 16
    while at < most:
        to = min(at + step, most)
        differ = a[at:to] != b[at:to]
        if differ.any():
            return at + int(differ.argmax())
        at, step = to, step * 2
    return most


def common_prefixes(x: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """LCP of every suffix with the one before it in the suffix array; ``x`` ends with a word of its own."""
    n = len(x)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    follows = np.zeros(n, dtype=bool)  # the suffix one word earlier tells its length
    at = np.flatnonzero((before[1:] > 0)) + 1
    follows[at] = (x[at - 1] == x[before[at] - 1]) & (before[at - 1] == before[at] - 1)
    known = np.flatnonzero(~follows)
    compared = known[before[known] >= 0]
    length = np.zeros(n, dtype=np.int64)
    length[compared] = _common(x, np.minimum(compared, before[compared]), np.maximum(compared, before[compared]))
    source = known[np.repeat(np.arange(len(known)), np.diff(np.r_[known, n]))] if n else known
    length = np.maximum(length[source] - (np.arange(n) - source), 0)
    return length[order]


def nearest_smaller(v: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """For every place in ``wanted`` the next place to the right with a smaller value; the last value is the least."""
    out = np.arange(1, len(v) + 1)
    left = wanted
    while len(left):
        left = left[v[out[left]] >= v[left]]
        out[left] = out[out[left]]  # what the place found points to is no farther than the next smaller one
    return out[wanted]


def branching_squares(x: np.ndarray, least_members: int = REPEATS) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of the squares after which the period breaks, in intervals of ``least_members`` suffixes.

    A run that repeats its period r times is seen by at least r suffixes, so smaller intervals hold no such run.
    """
    x = np.r_[x, x.max(initial=0) + 1]
    order, rank = suffix_array(x)
    lcp = np.r_[common_prefixes(x, order, rank), 0]
    cuts = np.flatnonzero(lcp > 0)  # between the suffixes cut - 1 and cut
    flipped = lcp[::-1]
    if not len(cuts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    right = nearest_smaller(lcp, cuts)
    left = len(lcp) - 1 - nearest_smaller(np.r_[flipped, -1], len(lcp) - 1 - cuts)
    wide = right - left >= least_members
    cuts, left, right = cuts[wide], left[wide], right[wide]
    # children of an interval lie between its ends and its cuts, in order
    by = np.lexsort((cuts, right, left))
    cuts, left, right = cuts[by], left[by], right[by]
    new = np.r_[True, (left[1:] != left[:-1]) | (right[1:] != right[:-1])] if len(cuts) else np.zeros(0, bool)
    interval = np.cumsum(new) - 1
    last = np.r_[new[1:], True] if len(cuts) else new
    begin = np.r_[np.where(new, left, np.r_[0, cuts[:-1]]), cuts[last]] if len(cuts) else cuts
    end = np.r_[cuts, right[last]]
    owner = np.r_[interval, interval[last]]
    low, high, depth = np.r_[left, left[last]], np.r_[right, right[last]], np.r_[lcp[cuts], lcp[cuts[last]]]
    by = np.lexsort((begin - end, owner))  # the largest child of every interval comes first
    largest = np.zeros(len(by), dtype=bool)
    largest[by] = np.r_[True, owner[by][1:] != owner[by][:-1]] if len(by) else largest
    begin, end, low, high, depth = (c[~largest] for c in (begin, end, low, high, depth))
    starts, periods = [], []
    per = end - begin
    for part in np.split(np.arange(len(per)), np.flatnonzero(np.diff(np.cumsum(per) // (1 << 20))) + 1):
        size = per[part]
        child = np.repeat(part, size)
        place = begin[child] + np.arange(len(child)) - np.repeat(np.cumsum(size) - size, size)
        i, d = order[place], depth[child]
        for other, start in ((i + d, i), (i - d, i - d)):
            inside = np.flatnonzero((other >= 0) & (other < len(x)))
            at, c = rank[other[inside]], child[inside]
            hit = inside[(at >= low[c]) & (at < high[c]) & ((at < begin[c]) | (at >= end[c]))]
            starts.append(start[hit])
            periods.append(d[hit])
    pairs = np.unique(np.stack([np.concatenate(starts), np.concatenate(periods)], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def runs(x: np.ndarray, bounds: np.ndarray, repeats: int = REPEATS, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of ``x``, by start and period; texts begin at ``bounds``.

    Equal words of different texts must have different numbers.
    """
    start, period = branching_squares(x, repeats)
    end = start + 2 * period
    found: list[tuple[int, int, int]] = []
    shorter: list[tuple[int, int]] = []  # (period, first word) of the runs that end here
    ended = -1
    by = np.lexsort((period, end))
    begins = bounds[np.searchsorted(bounds, start, side="right") - 1] if len(start) else start
    for i, d, e, first in zip(start[by].tolist(), period[by].tolist(), end[by].tolist(), begins[by].tolist(), strict=True):
        if e != ended:
            shorter, ended = [], e
        if any(d % q == 0 and s <= i for q, s in shorter):
            continue
        # rotate to the left
        s = i - _extent(x[first:i][::-1], x[first + d : i + d][::-1])
        shorter.append((d, s))
        if e - s >= max(least, repeats * d):
            found.append((s, e - s, d))
    found.sort(key=lambda r: (r[0], r[2]))
    return tuple(np.array(column, dtype=np.int64) for column in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def _numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words of several texts, one after the other, and where the texts begin."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    out = np.empty(int(sizes.sum()), dtype=np.int64)
    at = base = 0
    for words in texts:
        numbers: dict[bytes, int] = {}
        out[at : at + len(words)] = [numbers.setdefault(w, len(numbers)) for w in words]
        out[at : at + len(words)] += base
        at, base = at + len(words), base + len(numbers)
    return out, np.cumsum(sizes) - sizes


def search(texts: list[list[bytes]], repeats: int = REPEATS, least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of every text, by start and period."""
    x, bounds = _numbered(texts)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not len(x):
        return out
    filled = np.flatnonzero(np.diff(np.r_[bounds, len(x)]))
    start, length, period = runs(x, bounds[filled], repeats, least)
    text = filled[np.searchsorted(bounds[filled], start, side="right") - 1] if len(start) else start
    for t, s, n, d in zip(text.tolist(), (start - bounds[text]).tolist(), length.tolist(), period.tolist(), strict=True):
        out[t].append((s, n, d))
    return out


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds after its first period, joined by one space."""
    if not found:
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in found:
        depth[start + period] += 1
        depth[start + length] -= 1
    kept = np.cumsum(depth[:-1]) == 0
    return b" ".join([words[i] for i in np.flatnonzero(kept).tolist()])


def _strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length / period, compared exactly; of smallest start, then period, among those."""

    def before(a: tuple[int, int, int], b: tuple[int, int, int]) -> int:
        return b[1] * a[2] - a[1] * b[2] or a[0] - b[0] or a[2] - b[2]

    return min(found, key=cmp_to_key(before), default=None)


def find(df: DataFrame, repeats: int = REPEATS, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, runs, strongest, collapsed) of every row: all runs of its whole text as (start, length, period) by start
    and period, the one that repeats most, and the text without repetitions.

    Words are what stands between ASCII white space.  A null or empty text has no words, no runs, a null strongest run
    and an empty collapsed text.  Ties are settled by start, then period.  Repeated rows and null ids get a row each;
    an empty table gives none; other columns are not read.  A text longer than a batch is searched alone, in memory in
    proportion to its words.
    """
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(ids: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
            found = search(texts, repeats, least)
            named = [[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in found]
            top = [dict(zip(("start", "length", "period"), s)) if (s := _strongest(rs)) else None for rs in found]
            short = [collapsed(words, rs).decode("utf-8", "surrogatepass") for words, rs in zip(texts, found, strict=True)]
            return pa.RecordBatch.from_arrays([ids, pa.array(named, pa.list_(run_type)), pa.array(top, run_type), pa.array(short, pa.string())], ["doc", "runs", "strongest", "collapsed"])

        for batch in small(batches):
            texts, held, at = [], 0, 0
            for row, text in enumerate(batch.column(1)):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()  # bytes: ASCII white space only
                if texts and held + len(words) > WORDS_AT_ONCE:
                    yield close(batch.column(0).slice(at, row - at), texts)
                    texts, held, at = [], 0, row
                texts.append(words)
                held += len(words)
            yield close(batch.column(0).slice(at), texts)

    rows = df.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()
    one = RUNS[len("array<") : -1]
    return rows.mapInArrow(run, f"doc {kind}, runs {RUNS}, strongest {one}, collapsed string").withColumnRenamed("doc", id_col)


def listing(found: Column) -> Column:
    """A run per line: start,length,period."""
    line = F.transform(found, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return F.when(F.size(found) > 0, F.concat(F.array_join(line, "\n"), F.lit("\n"))).otherwise(F.lit(""))


def planted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A tenth of the texts, by checksum of the id, with a tail that repeats; the rest, and null ids, as they are."""
    words = F.regexp_extract_all(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10)
    n = F.size("w").cast("long")
    first = (g % n).alias("a")
    chosen = df.withColumn("chosen", F.coalesce(h % 10 == 0, F.lit(False))).withColumn("w", F.when(F.col("chosen"), words))
    laid = chosen.withColumn("a", F.when(n > 0, first)).withColumn("p", F.when(n > 0, 1 + F.floor((n - F.col("a")) / (3 + g % 8))))
    a, p = F.col("a").cast("int"), F.col("p").cast("int")
    place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
    tail = F.transform(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.get("w", place(i)))
    text = F.when(F.col("chosen") & (F.size("w") > 0), F.array_join(tail, " ")).otherwise(F.col(text_col))
    return laid.select(F.col(id_col), text.alias(text_col))
