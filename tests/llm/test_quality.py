import random
import zlib

import numpy as np
import pytest

from portvigil.llm import quality


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("aeionrst") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    docs, labels = [], []
    for i in range(900):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 120))]
        good = rng.random() < 0.7
        if not good:
            text = [w + "!!" for w in text] if i % 2 else [w for w in text[:9] for _ in range(12)]
        docs.append((i, " ".join(text), "xx", 1.0))
        if i % 3:
            labels.append((i, int(good), 0))
    docs += [(5000, None, "xx", 1.0), (5001, "", "xx", 1.0), (5002, "word " * 150_000, "xx", 1.0), (None, "some words", "xx", 1.0), docs[4]]
    labels += [(10_000, 1, 0), (10_001, None, 1), (None, 1, 0), (1, labels[0][1], 0)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, label string, pooled double"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_scores(spark, tables):
    docs, labels = tables
    rows = quality.score(docs, labels).collect()
    assert len(rows) == docs.count()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    right = [r.predicted == truth[r.doc_id] for r in rows if r.held_out and truth.get(r.doc_id) is not None]
    assert len(right) > 100 and np.mean(right) > 0.97
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    by_id = {r.doc_id: r.score for r in rows}
    assert by_id[5000] == by_id[5001]


def test_held_out_labels_teach_nothing(spark, tables):
    docs, labels = tables
    flipped = labels.withColumn("quality", quality.F.when(quality.held_out("doc_id"), 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    a, b = ({(r.doc_id, r.score) for r in quality.score(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_bounded_sample_and_no_rows(spark, tables):
    docs, labels = tables
    assert quality.score(docs, labels, labelled=50).where("score is null").count() == 0
    assert {r.score for r in quality.score(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.score(docs.limit(0), labels).count() == 0


def test_pooling_in_parts_equals_pooling_at_once(monkeypatch):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(quality.BINS, quality.DIMENSIONS)).astype(np.float32)
    words = rng.integers(0, quality.BINS, 1000)
    whole = quality.pool(words, vectors)
    monkeypatch.setattr(quality, "_POOLED_AT_ONCE", 64)
    assert np.allclose(quality.pool(words, vectors), whole, atol=1e-4)


def test_context_sums_by_plain_loops():
    places, signs = quality.index_vectors()
    docs = [np.array([5, 9, 5, 7]), np.array([], dtype=np.int64), np.array([9, 1])]
    total = np.zeros(quality.BINS * quality.DIMENSIONS)
    quality._context_sums(docs, total)
    want = np.zeros((quality.BINS, quality.DIMENSIONS))
    for d in docs:
        for i, word in enumerate(d):
            for j in range(max(0, i - quality.WINDOW), min(len(d), i + quality.WINDOW + 1)):
                if i != j:
                    want[word, places[d[j]]] += signs[d[j]]
    assert np.array_equal(total.reshape(want.shape), want)
