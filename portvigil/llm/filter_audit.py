"""How document filters interact: what every filter removes, in every order they may be applied.

1. One pass of a table-driven byte transducer over the UTF-8 texts of a batch.  Its states are "between words" and
   "in a word"; for every state and byte class a table holds what the step puts out: a word starts, a word ends, a
   capital, a code point, a symbol.  Any byte alone decides the next state, so the states before all bytes of a batch
   are known at once and the pass is two table look-ups per byte.
2. The word spans it puts out are inserted into a hash table with open addressing; a span that meets an occupied slot
   is compared with the span there byte by byte, so different words of equal hash stay different.
3. Equal texts are found by their SHA-256, in narrow rows that are aggregated before they are shuffled.
4. What is left is a histogram of failed filters per part, at most 32 x 4 rows each; all orders are read off it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Failure conditions: few words, few different words, many capitals, a symbol, an earlier equal text.
FILTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT = 50
MOST_CAPITALS = 3
SYMBOLS = b"#$%&*|"
SPACES = b" \t\n\v\f\r"

_OTHER, _SPACE, _CAPITAL, _SYMBOL, _CONTINUED, _END = range(6)
#: Ends every text; no UTF-8 text holds this byte.
_END_BYTE = 0xFF
_BETWEEN, _IN_WORD = 0, 1
_STARTS, _ENDS, _IS_CAPITAL, _IS_POINT, _IS_SYMBOL = 1, 2, 4, 8, 16
#: Texts that are read at a time, in bytes; a longer text is read alone.
BYTES_AT_ONCE = 4 << 20
#: Longer words are hashed as one string, shorter ones by eights of bytes, all words of a batch at once.
_LONG_WORD = 64
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def _transducer() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of every byte, state after every class, and what is put out for every (state, class)."""
    classes = np.full(256, _OTHER, dtype=np.uint8)
    classes[0x80:0xC0] = _CONTINUED
    for members, kind in ((SPACES, _SPACE), (SYMBOLS, _SYMBOL), (bytes(range(ord("A"), ord("Z") + 1)), _CAPITAL)):
        classes[list(members)] = kind
    classes[_END_BYTE] = _END
    after = np.array([_BETWEEN if k in (_SPACE, _END) else _IN_WORD for k in range(6)], dtype=np.uint8)
    puts = np.zeros((2, 6), dtype=np.uint8)
    for state in (_BETWEEN, _IN_WORD):
        for kind in range(6):
            if after[kind] != state:
                puts[state, kind] |= _ENDS if state == _IN_WORD else _STARTS
            if kind not in (_CONTINUED, _END):
                puts[state, kind] |= _IS_POINT
            puts[state, kind] |= {_CAPITAL: _IS_CAPITAL, _SYMBOL: _IS_SYMBOL}.get(kind, 0)
    return classes, after, puts.ravel()


_CLASSES, _AFTER, _PUTS = _transducer()
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


class Spans:
    """Words as spans of a byte array, compared and hashed eight bytes at a time."""

    def __init__(self, data: np.ndarray, start: np.ndarray, length: np.ndarray):
        self.data, self.start, self.length = np.concatenate([data, np.zeros(8, np.uint8)]), start, length
        self.eights = np.ndarray((len(data) + 1,), dtype="<u8", buffer=self.data, strides=(1,))
        self.first = self.part(np.arange(len(start)), 0)

    def part(self, words: np.ndarray, at: int) -> np.ndarray:
        """The eight bytes from ``at`` of words that are longer than that, zero beyond their ends."""
        return self.eights[self.start[words] + at] & _LOW_BYTES[np.minimum(self.length[words] - at, 8)]

    def hashes(self) -> np.ndarray:
        out = (self.first ^ self.length.astype(np.uint64)) * _MIX[0]
        rest = np.flatnonzero((self.length > 8) & (self.length <= _LONG_WORD))
        at = 8
        while len(rest):
            out[rest] = (out[rest] ^ (out[rest] >> np.uint64(29)) ^ self.part(rest, at)) * _MIX[1]
            at += 8
            rest = rest[self.length[rest] > at]
        for word in np.flatnonzero(self.length > _LONG_WORD).tolist():
            out[word] = xxhash.xxh3_64_intdigest(self.data[self.start[word] : self.start[word] + self.length[word]])
        return out

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the words ``a`` are those of ``b``, byte by byte."""
        same = (self.length[a] == self.length[b]) & (self.first[a] == self.first[b])
        rest = np.flatnonzero(same & (self.length[a] > 8) & (self.length[a] <= _LONG_WORD))
        at = 8
        while len(rest):
            differ = self.part(a[rest], at) != self.part(b[rest], at)
            same[rest[differ]] = False
            at += 8
            rest = rest[~differ]
            rest = rest[self.length[a[rest]] > at]
        for i in np.flatnonzero(same & (self.length[a] > _LONG_WORD)).tolist():
            one, two = self.start[a[i]], self.start[b[i]]
            same[i] = np.array_equal(self.data[one : one + self.length[a[i]]], self.data[two : two + self.length[a[i]]])
        return same


def first_of_equals(spans: Spans, text: np.ndarray, hashes: np.ndarray | None = None) -> np.ndarray:
    """Marks one word of every group of equal words of one text.  ``hashes`` decide only where the search starts."""
    hashes = spans.hashes() if hashes is None else hashes
    n = len(text)
    size = 1 << max(4, (2 * n).bit_length())
    table = np.full(size, -1, dtype=np.int64)
    own = (hashes ^ text.astype(np.uint64) * _MIX[1]) * _MIX[0]
    slot = (own >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)
    kept = np.zeros(n, dtype=bool)
    left = np.arange(n)
    while len(left):
        place = slot[left]
        free = table[place] < 0
        table[place[free]] = left[free]
        owner = table[place]
        mine = owner == left
        kept[left[mine]] = True
        left, owner = left[~mine], owner[~mine]
        same = text[owner] == text[left]
        same[same] = spans.equal(owner[same], left[same])
        left = left[~same]
        slot[left] = (slot[left] + 1) & (size - 1)
    return kept


def counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Of the texts ``data[offsets[i]:offsets[i + 1]]``: words, different words, capitals, code points, symbols."""
    n = len(offsets) - 1
    ended = np.full(len(data) + n, _END_BYTE, dtype=np.uint8)
    begins = offsets[:-1] + np.arange(n)
    inside = np.ones(len(ended), dtype=bool)
    inside[offsets[1:] + np.arange(n)] = False
    ended[inside] = data
    kinds = _CLASSES[ended]
    states = np.zeros(len(ended), dtype=np.uint8)
    states[1:] = _AFTER[kinds[:-1]]
    put = _PUTS[states * np.uint8(6) + kinds]

    def of_texts(flag: int) -> np.ndarray:
        return np.add.reduceat((put & flag) != 0, begins, dtype=np.int64) if n else np.zeros(0, np.int64)

    start = np.flatnonzero(put & _STARTS)
    words = of_texts(_STARTS)
    text = np.repeat(np.arange(n), words)
    spans = Spans(ended, start, np.flatnonzero(put & _ENDS) - start)
    return {
        "words": words,
        "distinct_words": np.bincount(text[first_of_equals(spans, text)], minlength=n),
        "capitals": of_texts(_IS_CAPITAL),
        "code_points": of_texts(_IS_POINT),
        "symbols": of_texts(_IS_SYMBOL),
    }


def in_bytes(batches: Iterator[pa.RecordBatch], column: int, most: int = BYTES_AT_ONCE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The same rows in batches of at most ``most`` bytes of text, or one row, with the text's bytes and offsets."""
    for batch in batches:
        texts = batch.column(column)
        wide = pa.types.is_large_string(texts.type)
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
            part = offsets[at : to + 1]
            yield batch.slice(at, to - at), data[part[0] : part[-1]], part - part[0]
            at = to


MEASURES = ("words", "distinct_words", "capitals", "code_points", "symbols")


def measures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, words, distinct_words, capitals, code_points, symbols, text_key) of every row, of its whole text.

    ``text_key`` is the SHA-256 of the text.  A null text counts as empty, a null part as the empty string.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in in_bytes(batches, 2):
            found = counts(data, offsets)
            keys = [hashlib.sha256(data[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            arrays = [pa.array(found[m], pa.int64()) for m in MEASURES]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays, pa.array(keys, pa.binary())], ["doc", "part", *MEASURES, "text_key"])

    rows = df.select(
        F.col(id_col).alias("doc"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    kind = rows.schema["doc"].dataType.simpleString()
    found = rows.mapInArrow(run, f"doc {kind}, part string, {', '.join(m + ' long' for m in MEASURES)}, text_key binary")
    return found.withColumnRenamed("doc", id_col)


def bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def own_failures() -> Column:
    """Bits of the filters A to D that a measured text fails."""
    failed = {
        "A": F.col("words") < LEAST_WORDS,
        "B": 100 * F.col("distinct_words") < LEAST_DISTINCT * F.col("words"),
        "C": 100 * F.col("capitals") > MOST_CAPITALS * F.col("code_points"),
        "D": F.col("symbols") > 0,
    }
    bits = [F.when(c, F.lit(bit(letter))).otherwise(F.lit(0)) for letter, c in failed.items()]
    return sum(bits[1:], bits[0])


def histogram(df: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, failed, good, toxic, n): documents of a part by the filters they fail, as bits, and by their labels.

    Every step is aggregated before its shuffle: rows of one id and text become one, then those of one text and
    part; so copies, or repeated ids, of a third of all rows do not meet in one task.
    """
    rows = measures(df).select("doc_id", "part", own_failures().alias("failed"), "text_key")
    once = rows.groupBy("doc_id", "part", "failed", "text_key").agg(F.count("*").alias("n"))
    known = labels.groupBy("doc_id").agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    labelled = once.join(known.where("doc_id is not null"), "doc_id", "left").withColumns(
        {c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")}
    )
    numbered = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))
    groups = labelled.groupBy("text_key", "part", "failed", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.min(numbered).alias("least"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("nameless"),
    )
    least = F.min("least.doc_id").over(Window.partitionBy("text_key"))
    originals = F.col("nameless") + F.when(F.col("least.doc_id") == F.col("least_id"), F.col("least.n")).otherwise(F.lit(0))
    split = groups.withColumn("least_id", least).select(
        "part",
        "good",
        "toxic",
        F.explode(
            F.array(
                F.struct(F.col("failed"), originals.alias("n")),
                F.struct((F.col("failed") + bit("E")).alias("failed"), (F.col("n") - originals).alias("n")),
            )
        ).alias("of"),
    )
    return split.groupBy("part", F.col("of.failed").alias("failed"), "good", "toxic").agg(F.sum("of.n").alias("n"))


def audit(df: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley (the filter's removed, summed over all orders).

    Rows without text count as empty texts; a null part is the empty string.  Of equal texts all but those of the
    smallest id fail E; rows that repeat that id do not, and rows without an id neither fail E nor make others fail.
    Several labels of an id count together, labels without an id not at all.  An empty table has no parts and gives
    no rows; other columns are not read.
    """
    orders = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    steps = F.sequence(F.lit(1), F.lit(len(FILTERS)))
    laid = histogram(df, labels).select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(steps).alias("step"))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    earlier = F.substring("filter_order", F.lit(1), F.col("step") - 1)

    def bits(of: Column) -> Column:
        return sum((F.when(F.instr(of, x) > 0, F.lit(bit(x))).otherwise(F.lit(0)) for x in FILTERS[1:]), F.when(F.instr(of, "A") > 0, F.lit(1)).otherwise(F.lit(0)))

    laid = laid.select("*", bits(letter).alias("mine"), bits(earlier).alias("before"))
    failed = F.col("failed")
    fails = failed.bitwiseAND(F.col("mine")) != 0
    reached = failed.bitwiseAND(F.col("before")) == 0
    # a document that fails s filters is removed by each of them in an equal share of all orders
    share = F.floor(F.lit(len(list(permutations(FILTERS)))) / F.bit_count("failed"))
    columns = {
        "kept": (reached & ~fails, F.col("n")),
        "removed": (reached & fails, F.col("n")),
        "redundant": (~reached & fails, F.col("n")),
        "unique_fails": (failed == F.col("mine"), F.col("n")),
        "good_lost": (reached & fails & F.col("good"), F.col("n")),
        "toxic_lost": (reached & fails & F.col("toxic"), F.col("n")),
        "shapley": (fails, F.col("n") * share),
    }
    sums = [F.sum(F.when(when, value).otherwise(F.lit(0))).cast("long").alias(name) for name, (when, value) in columns.items()]
    return laid.groupBy("part", "filter_order", "step").agg(*sums)


#: The same in DuckDB's SQL.
AUDIT_SQL = r"""
    with words as (
        select doc_id, coalesce(lang, '') as part, coalesce(text, '') as body,
               regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
        from documents
    ), known as (
        select doc_id, coalesce(bool_or(quality = 1), false) as good, coalesce(bool_or(toxic = 1), false) as toxic
        from labels group by doc_id
    ), judged as (
        select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
               [len(w) < 200,
                100 * len(list_distinct(w)) < 50 * len(w),
                100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 3 * length(body),
                regexp_matches(body, '[#$%&*|]'),
                coalesce(min(words.doc_id) over (partition by body) < words.doc_id, false)] as f
        from words left join known on words.doc_id = known.doc_id
    ), letters as (
        select unnest(['A', 'B', 'C', 'D', 'E']) as l, unnest([1, 2, 3, 4, 5]) as i
    ), orders as (
        select a.l || b.l || c.l || d.l || e.l as filter_order, [a.i, b.i, c.i, d.i, e.i] as o
        from letters a, letters b, letters c, letters d, letters e
        where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
    ), steps as (
        select filter_order, o, cast(unnest([1, 2, 3, 4, 5]) as integer) as step from orders
    ), seen as (
        select part, good, toxic, f, count(*) as n, len(list_filter(f, lambda x: x)) as failed
        from judged group by all
    ), laid as (
        select part, filter_order, step, good, toxic, n, failed, f[o[step]] as fails,
               len(list_filter(o[1:step - 1], lambda i: f[i])) = 0 as reached
        from seen, steps
    )
    select part, filter_order, step,
           cast(sum(case when reached and not fails then n else 0 end) as bigint) as kept,
           cast(sum(case when reached and fails then n else 0 end) as bigint) as removed,
           cast(sum(case when not reached and fails then n else 0 end) as bigint) as redundant,
           cast(sum(case when fails and failed = 1 then n else 0 end) as bigint) as unique_fails,
           cast(sum(case when reached and fails and good then n else 0 end) as bigint) as good_lost,
           cast(sum(case when reached and fails and toxic then n else 0 end) as bigint) as toxic_lost,
           cast(sum(case when fails then n * (120 // failed) else 0 end) as bigint) as shapley
    from laid group by part, filter_order, step
"""
