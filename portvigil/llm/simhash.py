"""Near duplicates by SimHash: 64-bit fingerprints that differ in few bits.

Index: with ``bits`` allowed differences a fingerprint is cut into ceil((bits + 1) / 2) segments, so of two
linked fingerprints at least one segment differs in one bit at most.  Every segment is posted once for each of
its bits, with that bit deleted (a wildcard); segments that differ in one bit, or none, meet in such a variant.
Candidates of equal variants are verified on the whole fingerprints.

Only different fingerprints are indexed, so copies cost nothing, and what leaves a group of equal variants is a
spanning forest of its links, not its pairs.  Components come from alternating star contractions.

``one_of_alike`` takes these components as candidates only: inside each, texts are linked when their fingerprints
are near and their shingle sets are alike as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portvigil.llm.worker_cache import small
from portvigil.storage import written

WORDS = 4
SEED = 42
BITS = 4
#: Runs of equal variants up to here are compared by vectorised offsets, longer ones by contraction.
SHORT_RUN = 16
#: Longer runs are split into blocks of this size, and every pair of blocks becomes a task of its own.
LONG_RUN = 65_536
_COUNTED_AT_ONCE = 65_536
#: Verified links: Jaccard similarity of the sets of five-word shingles.
ALIKE_WORDS, ALIKE = 5, 0.8
#: Candidate components beyond this many texts are split, and every pair of blocks becomes a group of its own.
ALIKE_BLOCK = 512
_TEXTS_REMEMBERED = 100_000


def shingles(text: str, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """Hashes of the shingles of ``words`` words, A-Z lower-cased; fewer words are one shingle, no word is none."""
    found = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and white space only
    if not found:
        return np.zeros(0, dtype="<u8")
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1) - 1
    last = min(words, len(found)) - 1
    starts = [0, *(ends[: len(found) - last - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[last:].tolist(), strict=True)], dtype="<u8")


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """Majority of every bit over the shingles' hashes; no word: zero."""
    hashes = shingles(text, words, seed)
    if not len(hashes):
        return 0
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _COUNTED_AT_ONCE):
        part = hashes[at : at + _COUNTED_AT_ONCE].view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(
    df: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", seeds: tuple[int, ...] = (SEED,)
) -> DataFrame:
    """(id, fp, text_hash) of every row; ``fp`` is the fingerprint as a signed long, ``text_hash`` tells apart
    rows that repeat an id with another text.  Fingerprints of further seeds follow as ``fp_1``, ``fp_2``, ..."""
    names = fingerprint_columns(len(seeds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            fps = [pa.array(np.array([fingerprint(t, words, seed) for t in texts], dtype=np.uint64).view(np.int64)) for seed in seeds]
            yield pa.RecordBatch.from_arrays([batch.column(0), fps[0], batch.column(2), *fps[1:]], [id_col, "fp", "text_hash", *names[1:]])

    text = F.col(text_col).cast("string")
    rows = df.select(id_col, text.alias("text"), text_hash(text).alias("text_hash"))
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, ", ".join([f"`{id_col}` {kind}, fp long, text_hash long", *(f"{n} long" for n in names[1:])]))


def fingerprint_columns(count: int) -> list[str]:
    return ["fp", *(f"fp_{i}" for i in range(1, count))]


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def segments(bits: int) -> list[tuple[int, int]]:
    """(first bit, number of bits) of each segment."""
    count = (bits + 2) // 2
    cuts = [64 * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def variants(fp: Column, bits: int) -> Column:
    """Array of the one-wildcard variants: the segment without one of its bits, marked with that bit's place."""
    keys = []
    for start, width in segments(bits):
        value = F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        for bit in range(width):
            deleted = value.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << bit)).cast("long"))
            keys.append(deleted.bitwiseXOR(F.lit((start + bit) << 32).cast("long")))
    return F.array(*keys)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))  # of signed numbers it would count the bits of the magnitude


def _links(fps: np.ndarray, bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """A spanning forest of the links among ``fps``: what is reached leaves the pool, so each pass is shorter."""
    left, right = [], []
    pool = fps
    while len(pool):
        todo, pool = [pool[0]], pool[1:]
        while todo and len(pool):
            one = todo.pop()
            near = _distance(pool, one) <= bits
            if near.any():
                reached = pool[near]
                left.append(np.full(len(reached), one))
                right.append(reached)
                todo.extend(reached)
                pool = pool[~near]
    return left, right


def _table(left: list, right: list, keys: list | None = None, block: list | None = None) -> pa.RecordBatch:
    a = np.concatenate(left) if left else np.zeros(0, dtype=np.int64)
    b = np.concatenate(right) if right else np.zeros(0, dtype=np.int64)
    n = len(a)
    return pa.RecordBatch.from_arrays(
        [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(keys or [None] * n, pa.int64()), pa.array(block or [None] * n, pa.int64())],
        ["a", "b", "key", "block"],
    )


def _pairs_in_runs(bits: int, short: int, long: int):
    """Over rows sorted by key: links in every run of one key; runs beyond ``long`` go on as blocks."""

    def closed(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        left, right = [], []
        if not len(key):
            return _table([], [])
        starts, sizes = runs(key)
        for at, size in zip(starts[sizes > short], sizes[sizes > short], strict=True):
            more = _links(fp[at : at + size], bits)
            left += more[0]
            right += more[1]
        ends = np.repeat(np.where(sizes > short, 0, starts + sizes), sizes)
        rows = np.arange(len(key))
        for offset in range(1, short):
            rows = rows[rows + offset < ends[rows]]
            if not len(rows):
                break
            near = rows[_distance(fp[rows], fp[rows + offset]) <= bits]
            left.append(fp[near])
            right.append(fp[near + offset])
        return _table(left, right)

    def runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        return starts, np.diff(np.r_[starts, len(key)])

    def blocks(key: int, fp: np.ndarray, first: int) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(fp), long):
            part = fp[at : at + long]
            yield _table([part], [part], [key] * len(part), [first + at // long] * len(part))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, held, passed = None, np.zeros(0, dtype=np.int64), 0  # the last run; its blocks handed on
        for batch in batches:
            key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            more = 0 if open_key is None else int(np.searchsorted(key, open_key, side="right"))
            held, key, fp = np.r_[held, fp[:more]], key[more:], fp[more:]
            if len(key):
                if passed:
                    yield from blocks(open_key, held, passed)
                elif len(held):
                    key, fp = np.r_[np.full(len(held), open_key), key], np.r_[held, fp]
                starts, sizes = runs(key)
                ended = np.arange(len(key)) < starts[-1]
                for at, size in zip(starts[:-1], sizes[:-1], strict=True):
                    if size > long:
                        ended[at : at + size] = False
                        yield from blocks(int(key[at]), fp[at : at + size], 0)
                yield closed(key[ended], fp[ended])
                open_key, held, passed = int(key[-1]), fp[starts[-1] :], 0
            whole = len(held) // long
            yield from blocks(open_key, held[: whole * long], passed)
            held, passed = held[whole * long :], passed + whole
        if passed:
            yield from blocks(open_key, held, passed)
        elif len(held):
            yield closed(np.full(len(held), open_key), held)

    return run


def links(fps: DataFrame, bits: int = BITS, short: int = SHORT_RUN, long: int = LONG_RUN) -> DataFrame:
    """(a, b) among different fingerprints: each pair differs in at most ``bits`` bits, and fingerprints are
    connected by these pairs exactly when they are by all such pairs."""
    posted = fps.select(F.explode(variants(F.col("fp"), bits)).alias("key"), "fp")
    sorted_runs = posted.repartition("key").sortWithinPartitions("key")
    found = written(sorted_runs.mapInArrow(_pairs_in_runs(bits, short, long), "a long, b long, key long, block long"), "simhash-links")
    blocks = found.where(F.col("key").isNotNull()).select("key", "block", F.col("a").alias("fp"))
    counts = blocks.groupBy("key").agg((F.max("block") + 1).alias("blocks"))
    met = blocks.join(counts, "key").select(
        "key", "fp", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    )

    def compare(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_table(*_links(table["fp"].to_numpy(), bits))]).select(["a", "b"])

    groups = met.groupBy("key", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))
    far = groups.applyInArrow(compare, "a long, b long")
    near = found.where(F.col("key").isNull()).select("a", "b")
    return near.unionByName(far).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node that is connected to it.

    Large-star and small-star steps in turn until nothing changes; every round is a written table, so lineage
    stays short and a lost executor costs one round at most.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        )
        e = written(small.select("e.*").where("u <> v").distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now


def near_duplicates(
    df: DataFrame, words: int = WORDS, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, fp, component_id, text_hash) for every row; component_id is the smallest id that is reachable over links.

    A null text counts as empty; texts without a word have fingerprint zero, which is linked like any other.
    A null id gets its row; a component of null ids only has a null component_id.  Rows that repeat an id are
    copies of each other only if their texts are alike.  An empty table gives no rows; other columns are not
    read.
    """
    docs = written(fingerprints(df, words, id_col, text_col), "fingerprints")
    fps = written(docs.groupBy("fp").agg(F.min(id_col).alias("least_id")), "fingerprints")
    roots = components(links(fps, bits))
    rooted = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return docs.join(rooted.join(least, "root").select("fp", "component_id"), "fp").select(id_col, "fp", "component_id", "text_hash")


def alike(a: np.ndarray, b: np.ndarray, least: float = ALIKE) -> bool:
    """Whether two sets, sorted arrays without repeats, have a Jaccard similarity of ``least``; empty sets are alike."""
    small_one, large_one = sorted((len(a), len(b)))
    if small_one < least * large_one - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both) - 1e-9


def _alike_links(texts: np.ndarray, fps: np.ndarray, sets: list[np.ndarray], bits: int, least: float) -> tuple[list[int], list[int]]:
    """A spanning forest of the verified links of a group, as in ``_links``; ``fps`` has a row per text, a column per seed."""
    left: list[int] = []
    right: list[int] = []
    pool = np.arange(len(texts))
    while len(pool):
        todo, pool = [pool[0]], pool[1:]
        while todo and len(pool):
            one = todo.pop()
            reached = np.zeros(len(pool), dtype=bool)
            for at in np.flatnonzero((_distance(fps[pool], fps[one]) <= bits).any(axis=1)).tolist():
                reached[at] = alike(sets[one], sets[pool[at]], least)
            if reached.any():
                right += texts[pool[reached]].tolist()
                left += [int(texts[one])] * int(reached.sum())
                todo.extend(pool[reached].tolist())
                pool = pool[~reached]
    return left, right


def candidate_groups(texts: DataFrame, bits: int, seeds: int, block: int = ALIKE_BLOCK) -> DataFrame:
    """``texts`` (text_hash, fp, fp_1, ...) that are candidates, with ``met``: their groups as (key, blocks).

    A group holds the texts whose fingerprints of one seed are connected by near ones.  Groups of several seeds that
    have the same texts have one key and are compared once.
    """
    members = F.xxhash64(F.count("*"), F.expr("bit_xor(xxhash64(text_hash))")).alias("key")
    found = []
    for name in fingerprint_columns(seeds):
        own = texts.withColumn("_fp", F.col(name))
        roots = components(links(own.select(F.col("_fp").alias("fp")).distinct(), bits)).withColumnRenamed("node", "_fp")
        rooted = own.join(roots, "_fp", "left").withColumn("_root", F.coalesce("root", "_fp")).drop("root", "_fp")
        sizes = rooted.groupBy("_root").agg(F.count("*").alias("texts"), F.ceil(F.count("*") / block).cast("int").alias("blocks"), members)
        found.append(rooted.join(sizes.where("texts > 1").drop("texts"), "_root").drop("_root"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.groupBy(*texts.columns).agg(F.collect_set(F.struct("key", "blocks")).alias("met"))


def alike_links(
    df: DataFrame,
    texts: DataFrame,
    bits: int,
    seeds: int = 1,
    words: int = ALIKE_WORDS,
    least: float = ALIKE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(a, b), text hashes: each pair's fingerprints of one seed differ in at most ``bits`` bits and its shingle sets are
    alike, and texts are connected by these pairs exactly when they are by all such pairs of one group.

    ``texts`` has every candidate once, with ``least_id`` and the groups of ``candidate_groups``.  A text is read from
    its row of that id, so its copies leave at the join.
    """
    column, names = F.col(text_col).cast("string"), fingerprint_columns(seeds)
    rows = df.select(F.col(id_col).alias("_id"), column.alias("_text"), text_hash(column).alias("_hash"))
    same = (F.col("_hash") == F.col("text_hash")) & F.col("_id").eqNullSafe(F.col("least_id"))
    wanted = rows.join(texts, same).select("text_hash", "_text", "met", *names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # saves work on repeated rows; those it lets through are dropped in their group
        for batch in small(batches):
            hashes, kept, found = batch.column(0).to_pylist(), [], []
            for i, (key, text) in enumerate(zip(hashes, batch.column(1).to_pylist(), strict=True)):
                if key in seen:
                    continue
                if len(seen) < _TEXTS_REMEMBERED:
                    seen.add(key)
                kept.append(i)
                found.append(np.unique(shingles(text or "", words)).tobytes())
            rest = batch.select([0, *range(2, batch.num_columns)]).take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(found, pa.binary())], ["text_hash", "met", *names, "shingles"])

    fps = ", ".join(f"{n} long" for n in names)
    sets = wanted.mapInArrow(read, f"text_hash long, met array<struct<key: long, blocks: int>>, {fps}, shingles binary")
    placed = sets.select("text_hash", *names, "shingles", F.inline("met"))
    mine = F.pmod(F.xxhash64("text_hash", F.lit(SEED)), F.col("blocks")).cast("int")
    # a single block meets itself; of more, every pair of different blocks meets, and with it each block
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: o != mine))
    met = placed.select("*", mine.alias("block"), F.explode(others).alias("other")).select(
        "key", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "text_hash", *names, "shingles"
    )
    group = ["key", "one", "two"]

    def close(rows: list[tuple]) -> tuple[list[int], list[int]]:
        different = {text: rest for text, *rest in rows}
        prints = np.array([rest[:-1] for rest in different.values()], dtype=np.int64).reshape(-1, seeds)
        found = [np.frombuffer(rest[-1], "<u8") for rest in different.values()]
        return _alike_links(np.array(list(different), dtype=np.int64), prints, found, bits, least)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in small(batches):
            left, right = [], []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != key:
                    a, b = close(held)
                    left += a
                    right += b
                    key, held = row[:3], []
                held.append(row[3:])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])
        a, b = close(held)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return met.repartition(*group).sortWithinPartitions(*group).mapInArrow(compare, "a long, b long")


def one_of_alike(
    df: DataFrame,
    words: int = WORDS,
    bits: int = BITS,
    id_col: str = "doc_id",
    text_col: str = "text",
    block: int = ALIKE_BLOCK,
    seeds: tuple[int, ...] = (SEED,),
) -> DataFrame:
    """(id, text_hash) of one document of every component of verified links: that of smallest id (null is last), of
    smallest text hash among those.

    SimHash only proposes: texts are linked when their fingerprints of one of the ``seeds`` differ in at most ``bits``
    bits and their sets of five-word shingles are alike to 0.8.  All different texts are compared, also those of one
    fingerprint.  A pair that one seed's hashes part is often met by another's.
    """
    names = fingerprint_columns(len(seeds))
    docs = fingerprints(df, words, id_col, text_col, seeds)
    texts = written(docs.groupBy("text_hash", *names).agg(F.min(id_col).alias("least_id")), "texts")
    groups = written(candidate_groups(texts, bits, len(seeds), block), "candidates")
    found = components(alike_links(df, groups, bits, len(seeds), id_col=id_col, text_col=text_col)).withColumnRenamed("node", "text_hash")
    grouped = texts.join(found, "text_hash", "left").withColumn("root", F.coalesce("root", "text_hash"))
    first = F.min(F.struct(F.col("least_id").isNull(), F.col("least_id").alias("id"), "text_hash")).alias("first")
    return grouped.groupBy("root").agg(first).select(F.col("first.id").alias(id_col), F.col("first.text_hash").alias("text_hash"))


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
