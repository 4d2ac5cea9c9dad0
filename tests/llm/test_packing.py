import weakref
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from portvigil.llm import packing, worker_cache
from portvigil.llm.word_bpe import WordIds

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(6)
    words = [f"w{i}x" for i in range(400)]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 400))), "clash", 1) for i in range(250)]
    rows += [(1000 + i, "the same text " * 20, "clash", 1) for i in range(60)]
    rows += [(2000, None, "clash", 1), (2001, "", "clash", 1), (2002, "long " * 30_000, "clash", 1), (2003, "<|endoftext|> İ 中文", "clash", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, start string, tokens int")


@pytest.mark.parametrize("shard_rows", [8192, 40])
def test_every_id_once_in_gapless_sequences(spark, docs, shard_rows):
    pieces = packing.packed(docs, PATH, shard_rows=shard_rows).toPandas()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    library = Tokenizer.from_file(PATH)
    ids = {k: np.array(library.encode(t, add_special_tokens=False).ids + [2], "<u4") for k, t in texts.items()}
    assert set(pieces.doc_id) == set(ids)
    for doc, mine in pieces.sort_values("start").groupby("doc_id"):
        assert mine.start.tolist() == [0, *np.cumsum(mine.length)[:-1]] and mine.length.sum() == len(ids[doc])
        assert (mine.doc_tokens == len(ids[doc])).all()
        for r in mine.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[doc][r.start : r.start + r.length].tobytes())
    for _, mine in pieces.sort_values("offset").groupby("sequence_id"):
        assert mine.offset.tolist() == [0, *np.cumsum(mine.length)[:-1]] and mine.length.sum() <= packing.LENGTH
    full = pieces.groupby("sequence_id").length.sum()
    assert (full == packing.LENGTH).sum() >= len(full) - (1 if shard_rows == 8192 else 20)


def test_neighbours_share_words():
    terms = [np.array([1, 2, 3]), np.array([7, 8, 9]), np.array([1, 2, 4]), np.array([7, 8, 6])]
    index = packing.Index(terms, [np.ones(3, np.uint8)] * 4)
    assert np.argsort(-index.scores(0))[:2].tolist() == [0, 2]
    pieces = packing.pack(np.array([64, 64, 64, 64]), index, length=128)
    assert {frozenset(p[0] for p in pieces if p[3] == s) for s in (0, 1)} == {frozenset({0, 2}), frozenset({1, 3})}


def test_bm25_by_its_formula():
    rng = np.random.default_rng(1)
    terms = [np.unique(rng.integers(0, 50, 12)) for _ in range(30)]
    counts = [rng.integers(1, 5, len(t)).astype(np.uint8) for t in terms]
    index = packing.Index(terms, counts)
    mean = np.mean([c.sum(dtype=int) for c in counts])
    df = {t: sum(t in x for x in terms) for t in range(50)}
    for other in range(30):
        want = 0.0
        for t in terms[0]:
            at = np.flatnonzero(terms[other] == t)
            if len(at):
                tf, n = int(counts[other][at[0]]), counts[other].sum(dtype=int)
                want += np.log(1 + (30 - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))
        assert index.scores(0)[other] == pytest.approx(want, rel=1e-4)


def test_equal_and_null_ids_are_packed_each_for_itself_and_spread(spark):
    rows = [(1, "one text of some words")] * 300 + [(None, "one text of some words")] * 300 + [(None, None)] * 3
    pieces = packing.packed(spark.createDataFrame(rows, "doc_id long, text string"), PATH, shard_rows=100).toPandas()
    starts = pieces[pieces.start == 0]
    assert len(starts) == len(rows) and starts.doc_id.isna().sum() == 303
    assert pieces.sequence_id.floordiv(2**32).value_counts().max() < 250  # equal keys do not share a task


def test_sequences_and_no_rows(spark, docs, tmp_path):
    packing.packed(docs, PATH).write.parquet(str(tmp_path / "pieces"))
    pieces = spark.read.parquet(str(tmp_path / "pieces"))
    rows = {r.sequence_id: r.ids for r in packing.sequences(docs, pieces, PATH).collect()}
    for r in pieces.collect():
        part = np.array(rows[r.sequence_id][r.offset : r.offset + r.length], "<u4")
        assert zlib.crc32(part.tobytes()) == r.ids_crc32
    assert packing.packed(docs.limit(0), PATH).count() == 0


def test_statistics_are_of_all_documents(spark, docs):
    found = packing.statistics(packing.encoded(docs.repartition(5), PATH))
    library = Tokenizer.from_file(PATH)
    ids = [[*library.encode(r.text or "", add_special_tokens=False).ids, 2] for r in docs.collect()]
    assert found.documents == len(ids) and found.mean == pytest.approx(np.mean([len(x) for x in ids]))
    df = np.bincount(np.concatenate([np.unique(x) for x in ids]))
    assert found.idf == pytest.approx(np.log(1 + (len(ids) - df + 0.5) / (df + 0.5)), rel=1e-5)
    index = packing.Index([np.array([5, 9]), np.array([5])], [np.array([1, 1]), np.array([2])], packing.Statistics(1000, 7.0, np.full(10, 3.0)))
    assert index.scores(0)[1] == pytest.approx(3.0 * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 2 / 7)))


@pytest.mark.parametrize(("term", "times"), [(7, 3), (70_000, 3), (7, 300), (70_000, 70_000)])
def test_counts_are_whole(term, times):
    ids = np.array([term] * times + [2], "<u4")
    packed = packing.narrow(ids, np.array([len(ids)]))[0].as_py()
    assert len(packed) == len(ids) * (2 if term < 65536 else 4)
    terms, counts = packing.term_counts([packing.widened(packed, len(ids)), np.array([5, 5])])
    assert [x.tolist() for x in terms] == [[2, term], [5]] and [x.tolist() for x in counts] == [[1, times], [2]]


@pytest.mark.parametrize("last", [65_535, 65_536])
def test_postings_are_ordered_by_term_and_document(last):
    rng = np.random.default_rng(5)
    terms, counts = packing.term_counts([np.r_[rng.integers(0, last, 50), last] for _ in range(20)])
    index = packing.Index(terms, counts)
    assert index.doc.dtype == np.intp  # used as an index as it is
    for term in (last, int(terms[3][7])):
        assert index.doc[index.start[term] : index.start[term + 1]].tolist() == [d for d in range(20) if term in terms[d]]


def test_a_shard_of_long_documents_is_read_in_parts():
    given = [[3, 4, 3], [], [9, 1, 1], [30, 30], [2]]
    batches = [pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64())], ["tokens"]) for tokens in given]
    found = [t["tokens"].to_pylist() for t in packing.parts(iter(batches), 10)]
    assert found == [[3, 4, 3], [9, 1], [1], [30], [30], [2]]
    assert list(packing.parts(iter([]), 10)) == []


def test_parts_of_a_shard_hold_every_id_once(spark, docs):
    whole = packing.packed(docs, PATH).toPandas()
    pieces = packing.packed(docs, PATH, shard_tokens=9_000).toPandas()
    total = pieces.groupby("doc_id").length.sum()
    assert total.equals(whole.groupby("doc_id").length.sum())
    assert pieces.drop_duplicates("doc_id").doc_tokens.sum() == pieces.length.sum()
    for _, mine in pieces.sort_values("offset").groupby("sequence_id"):
        assert mine.offset.tolist() == [0, *np.cumsum(mine.length)[:-1]] and mine.length.sum() <= packing.LENGTH
    ids = sorted(pieces.sequence_id.unique())
    assert ids == list(range(ids[0], ids[0] + len(ids))) and len(ids) > whole.sequence_id.nunique()


def test_a_step_drops_what_others_kept():
    class Kept:
        pass

    made = {name: worker_cache.per_worker(name, Kept) for name in ("one step", "another")}
    seen = {name: weakref.ref(x) for name, x in made.items()}
    made.clear()
    worker_cache.forget("another")
    assert seen["one step"]() is None and worker_cache.per_worker("another", Kept) is seen["another"]()
    encoder = weakref.ref(worker_cache.per_worker(("word_ids", PATH), lambda: WordIds(PATH)))
    worker_cache.forget()
    assert encoder() is None and seen["another"]() is None  # also a cache that refers to itself
