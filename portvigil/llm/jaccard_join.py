"""N-gram Jaccard join: documents whose sets of word shingles are alike, exactly, by signature trees.

1. One pass over the texts gives the set of every document's shingles; equal sets are one from here on.
2. Routing, without loss: sets of sizes a <= b that are alike differ in at most a * (100 - percent) / percent tokens.
   Tokens are dealt into more parts than that, so some part is the same in both; its hash is a key.  Parts that are
   empty tell nothing: where they may be all that agrees, the tokens are dealt anew by another hash.
3. Sets that share a key, directly or over others, are a family.  Every family is a signature tree (signature_tree.py)
   that is joined with itself: pairs of nodes are pruned by their largest possible overlap, sets that are left are
   compared, and what is linked already is not visited again.
4. A family of more than ``BLOCK_TOKENS`` tokens is dealt into blocks, a tree each.  One set of every component then
   stands for it in the next round.  Keys whose sets still lie in several components and blocks are joined by
   themselves, all pairs of blocks of the key, so no link is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import ExitStack, contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portvigil.llm.components import connected
from portvigil.llm.signature_tree import SignatureTree
from portvigil.llm.simhash import shingles, text_hash
from portvigil.llm.worker_cache import small
from portvigil.storage import materialized, written

WORDS = 3
PERCENT = 90
#: Tokens of one tree; a larger set is a tree by itself.
BLOCK_TOKENS = 2_000_000
#: Sizes of a class differ by less than this factor; sets that are alike lie in one class or in two next to each other.
_CLASS = 1.25
#: How often tokens are dealt anew before empty parts count as a key.
_DEALS = 3
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def token_set(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the different shingles; fewer words are one shingle, no word is none."""
    return np.unique(shingles(text, words))


def most_apart(size: int, percent: int) -> int:
    """How many tokens at most two sets do not share that are alike, ``size`` being that of the smaller one."""
    return size * (100 - percent) // percent


def class_bounds(size: int, percent: int) -> tuple[int, int, int]:
    """(least, beyond) sizes of the class of a size, and its number; the first class begins where sets can differ."""
    factor = max(_CLASS, 105 / percent)
    number, least = 0, -(-percent // (100 - percent))
    beyond = int(least * factor) + 1
    while size >= beyond:
        number, least, beyond = number + 1, beyond, int(beyond * factor) + 1
    return least, beyond, number


def keys(tokens: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Keys of a set: two different sets that are alike share at least one.  Sets too small to differ have none."""
    if percent >= 100 or most_apart(len(tokens), percent) == 0:
        return np.zeros(0, dtype=np.uint64)
    least, beyond, number = class_bounds(len(tokens), percent)
    classes = [(beyond, number)]
    if number and percent * len(tokens) <= 100 * (least - 1):
        classes.append((least, number - 1))  # a smaller set of the class below may be alike
    return np.concatenate([_class_keys(tokens, most_apart(top - 1, percent), n) for top, n in classes])


def _class_keys(tokens: np.ndarray, apart: int, number: int) -> np.ndarray:
    spare = (apart + 60) // 100  # so many parts may be empty and still one with tokens agrees
    parts = apart + 1 + spare
    out = []
    for deal in range(_DEALS):
        mixed = (tokens ^ np.uint64((deal << 32) + number)) * _MIX[0]
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX[1]
        part = ((mixed >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
        by = np.argsort(part, kind="stable")
        sums = np.r_[np.zeros(1, np.uint64), np.cumsum((mixed ^ (mixed >> np.uint64(31)))[by] * _MIX[0])]
        held = np.bincount(part, minlength=parts)
        ends = np.cumsum(held)
        full = np.flatnonzero(held)
        sums = sums[ends[full]] - sums[ends[full] - held[full]]
        name = (full.astype(np.uint64) + np.uint64(1)) * _MIX[1] + np.uint64((number * _DEALS + deal) << 40)
        key = (sums ^ name) * _MIX[0]
        out.append(key ^ (key >> np.uint64(32)))
        if parts - len(full) <= spare:
            return np.concatenate(out)
    return np.concatenate([*out, np.array([number], dtype=np.uint64)])


def document_sets(df: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, n_shingles, set, keys) of every row; ``set`` names the set by a 64-bit hash, null if empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            sets = [token_set(t or "", words) for t in batch.column(2).to_pylist()]
            names = [_signed(xxhash.xxh3_64_intdigest(s)) if len(s) else None for s in sets]
            listed = [keys(s, percent).view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(names, pa.int64()),
                    pa.array(listed, pa.list_(pa.int64())),
                ],
                ["doc", "text_hash", "n_shingles", "set", "keys"],
            )

    text = F.col(text_col).cast("string")
    rows = df.select(F.col(id_col).alias("doc"), text_hash(text).alias("text_hash"), text.alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc {kind}, text_hash long, n_shingles long, set long, keys array<long>")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def with_tokens(df: DataFrame, wanted: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(set, tokens) of the ``wanted`` sets, each read again from the one document that stands for it."""
    text = F.col(text_col).cast("string")
    rows = df.select(F.col(id_col).alias("doc"), text_hash(text).alias("text_hash"), text.alias("text"))
    # both sides grow with the table: sorted and merged at every size
    kept = rows.join(wanted.select("doc", "text_hash", "set").hint("merge"), (rows["doc"].eqNullSafe(wanted["doc"])) & (rows["text_hash"] == wanted["text_hash"]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # repeated rows of one id and text come one after the other
        for batch in small(batches):
            names, tokens = [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name != last:
                    names.append(name)
                    tokens.append(token_set(text or "", words).tobytes())
                    last = name
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(tokens, pa.binary())], ["set", "tokens"])

    return kept.select("set", "text").mapInArrow(read, "set long, tokens binary")


def tree_links(members: DataFrame, group: list[str], percent: int) -> DataFrame:
    """(a, b): links among the ``members`` (set, tokens, label) of every group, enough to connect what they connect."""

    def close(held: dict[int, tuple[np.ndarray, int]]) -> tuple[list[int], list[int]]:
        if len({label for _, label in held.values()}) < 2:
            return [], []
        names = sorted(held, key=lambda name: (int(held[name][0][0]), len(held[name][0]), name))  # alike sets often share their least token
        _, labels = np.unique([held[n][1] for n in names], return_inverse=True)
        found = SignatureTree([held[n][0] for n in names]).join(percent, labels)
        return [names[i] for i, _ in found], [names[j] for _, j in found]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}

        def rows(pairs: tuple[list[int], list[int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(p, pa.int64()) for p in pairs], ["a", "b"])

        for batch in small(batches):
            for name, tokens, label, *now in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != key:
                    yield rows(close(held))
                    key, held = now, {}
                held[name] = (np.frombuffer(tokens, dtype=np.uint64), label)
        yield rows(close(held))

    dealt = members.select("set", "tokens", "label", *group).repartition(*group).sortWithinPartitions(*group)
    return dealt.mapInArrow(compare, "a long, b long")


def _blocks(tokens: Column, block_tokens: int) -> Column:
    return F.ceil(tokens / block_tokens).cast("int")


def _block_of(blocks: Column, salt: int) -> Column:
    return F.pmod(F.xxhash64("set", F.lit(salt)), blocks).cast("int")


@contextmanager
def set_links(
    sets: DataFrame, tokens_of: Callable[[DataFrame], DataFrame], percent: int = PERCENT, block_tokens: int = BLOCK_TOKENS
) -> Iterator[DataFrame]:
    """(node, root) for all sets that are alike to another one; root is the smallest name connected to it.

    ``sets`` (set, n, keys, doc, text_hash) has every different set once; ``tokens_of`` reads the tokens of some of them.
    """
    with ExitStack() as stack:
        keep = lambda df, name: stack.enter_context(materialized(df, name))
        posted = sets.select("set", F.explode("keys").alias("key"))
        shared = posted.groupBy("key").agg(F.min("set").alias("hub"), F.max("set").alias("far")).where("hub <> far").drop("far")
        met = keep(posted.join(shared.hint("merge"), "key").select("key", "set", "hub"), "met")
        family = stack.enter_context(connected(met.select(F.col("set").alias("a"), F.col("hub").alias("b"))))
        either = family.select(F.col("node").alias("set"), F.col("root").alias("family"))
        either = either.unionByName(family.select(F.col("root").alias("set"), F.col("root").alias("family")).distinct())
        chosen = sets.select("set", "n", "doc", "text_hash").join(either, "set")
        chosen = keep(chosen, "members")
        tokens = keep(tokens_of(chosen), "tokens")
        links, turn = None, 0
        members = chosen.select("set", "n", "family", F.col("set").alias("label"))
        while True:
            sizes = members.groupBy("family").agg(_blocks(F.sum("n"), block_tokens).alias("blocks"))
            dealt = members.join(sizes, "family").withColumn("block", _block_of(F.col("blocks"), turn))
            dealt = keep(dealt, "dealt")
            if turn == 0:
                first = dealt
            found = keep(tree_links(dealt.join(tokens, "set"), ["family", "block"], percent), "links")
            links = found if links is None else links.unionByName(found)
            roots = stack.enter_context(connected(links))
            if not dealt.where("blocks > 1").head(1):
                break
            labelled = chosen.join(roots.withColumnRenamed("node", "set"), "set", "left").withColumn("label", F.coalesce("root", "set"))
            labelled = labelled.select("set", "n", "family", "label")
            wide = first.where("blocks > 1").select("family").distinct()
            left = keep(labelled.where("set = label").join(wide, "family", "left_semi"), "left")
            if 2 * left.count() > members.join(wide, "family", "left_semi").count():
                break  # few were linked: the keys decide
            members, turn = left, turn + 1
        if first.where("blocks > 1").head(1):
            links = links.unionByName(keep(_links_of_keys(met, first, tokens, roots, percent, block_tokens), "links"))
            roots = stack.enter_context(connected(links))
        yield roots


def _links_of_keys(met: DataFrame, first: DataFrame, tokens: DataFrame, roots: DataFrame, percent: int, block_tokens: int) -> DataFrame:
    """Links among the sets of every key that lie in several components and were not all of one block before."""
    wide = first.where("blocks > 1").select("set", "n", "block")
    rows = met.join(wide, "set").join(roots.withColumnRenamed("node", "set"), "set", "left")
    rows = rows.select("key", "set", "n", "block", F.coalesce("root", "set").alias("label"))
    apart = (F.min("label") != F.max("label")) & (F.min("block") != F.max("block"))
    open_keys = rows.groupBy("key").agg(apart.alias("apart"), _blocks(F.sum("n"), block_tokens).alias("blocks")).where("apart").drop("apart")
    dealt = rows.select("key", "set", "label").join(open_keys, "key").withColumn("mine", _block_of(F.col("blocks"), 0))
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(
        F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: o != F.col("mine"))
    )
    pairs = dealt.select("*", F.explode(others).alias("other")).select(
        "key", "set", "label", F.least("mine", "other").alias("one"), F.greatest("mine", "other").alias("two")
    )
    return tree_links(pairs.join(tokens, "set"), ["key", "one", "two"], percent)


def near_duplicates(
    df: DataFrame,
    words: int = WORDS,
    percent: int = PERCENT,
    block_tokens: int = BLOCK_TOKENS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, n_shingles, component_id) of every row; component_id is the smallest id that is reachable over links.

    Two documents are linked when 100 * intersection >= percent * union of their sets of shingles; with fewer words
    than a shingle has, all words are one.  A null text, or one without words, has no shingle and is linked with
    nothing: its component_id is its own id.  Equal texts are linked like others, so repeated rows share a
    component.  A null id gets its row; a component of null ids only has a null component_id.  An empty table gives no
    rows; other columns are not read.  Shingles and sets are named by 64-bit hashes.
    """
    stands = F.min(F.struct(F.col("doc").isNull().alias("nameless"), "doc", "text_hash"))
    with ExitStack() as stack:
        with materialized(document_sets(df, words, percent, id_col, text_col), "shingle-sets") as found:
            docs = written(found.select("doc", "n_shingles", "set"), "documents")
            sets = found.where("set is not null").groupBy("set").agg(
                F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), stands.alias("stands")
            )
            kept = stack.enter_context(materialized(sets.select("set", "n", "keys", "stands.doc", "stands.text_hash"), "sets"))
        with set_links(kept, lambda wanted: with_tokens(df, wanted, words, id_col, text_col), percent, block_tokens) as roots:
            rooted = kept.select("set", "doc").join(roots.withColumnRenamed("node", "set"), "set", "left")
            rooted = rooted.withColumn("root", F.coalesce("root", "set"))
            least = rooted.groupBy("root").agg(F.min("doc").alias("component_id"))
            named = written(rooted.join(least, "root").select("set", "component_id"), "components")
    component = F.when(F.col("set").isNull(), F.col("doc")).otherwise(F.col("component_id"))
    return docs.join(named, "set", "left").select(F.col("doc").alias(id_col), "n_shingles", component.alias("component_id"))
