import random
import re

import numpy as np
import pytest

from portvigil.llm import jaccard_join as J
from portvigil.llm.signature_tree import SignatureTree, linked

ROWS = "doc_id long, text string, set string"


def brute_force(rows):
    """(n_shingles, component) of every row by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, one in enumerate(sets):
        for j in range(i):
            both = len(one & sets[j])
            if both and 100 * both >= 90 * (len(one) + len(sets[j]) - both):
                root[find(i)] = find(j)
    out = []
    for i, one in enumerate(sets):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((rows[i][0], len(one), min(ids, default=None)))
    return sorted(out, key=str)


def result(spark, rows, **settings):
    df = spark.createDataFrame([(*r, "clash") for r in rows], ROWS)
    return sorted(map(tuple, J.near_duplicates(df, **settings).collect()), key=str)


def changed_copies(seed, families, copies, length):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(families):
        base = [rng.choice(words) for _ in range(rng.choice(length))]
        for _ in range(rng.choice(copies)):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                text[rng.randrange(len(text))] = rng.choice(words)
            texts.append(" ".join(text))
    return texts


@pytest.mark.parametrize("block_tokens", [J.BLOCK_TOKENS, 2000, 300])
def test_components_equal_those_of_all_pairs(spark, block_tokens):
    texts = changed_copies(3, 8, [1, 3, 30], [3, 8, 12, 40, 150])
    rows = list(enumerate(texts))
    assert result(spark, rows, block_tokens=block_tokens) == brute_force(rows)


def test_empty_short_null_and_repeated_rows(spark):
    long = " ".join(f"t{i % 700}x{i // 700}" for i in range(5000))
    rows = [(1, None), (2, ""), (3, " \t"), (4, "One"), (5, "oNE"), (6, "one two"), (7, "a b c"), (7, "a b c"), (9, "A B C"),
            (None, "a b c"), (None, "d e f"), (None, None), (12, "é É ü"), (11, "é É ü"), (13, long), (14, long + " end")]
    assert result(spark, rows) == brute_force(rows)


def test_empty_table(spark):
    found = J.near_duplicates(spark.createDataFrame([], ROWS))
    assert found.columns == ["doc_id", "n_shingles", "component_id"] and found.count() == 0


def test_alike_sets_share_a_key():
    rng = np.random.default_rng(0)
    tried = 0
    for _ in range(3000):
        n = int(rng.choice([9, 10, 12, 18, 19, 27, 100, 400]))
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        apart = J.most_apart(n, 90)
        b = np.unique(np.r_[a[: n - rng.integers(0, apart + 1)], rng.integers(0, 2**63, rng.integers(0, apart + 1), dtype=np.uint64)])
        a = np.unique(a)
        if linked(a, b, 90) and not np.array_equal(a, b):
            tried += 1
            assert len(np.intersect1d(J.keys(a), J.keys(b)))
    assert tried > 500


def test_parts_without_tokens_are_not_a_key_by_themselves(monkeypatch):
    # with every token in one part the other parts are empty; sets that share nothing else must not meet there
    a, b = (np.unique(np.random.default_rng(s).integers(0, 2**63, 60, dtype=np.uint64)) for s in (1, 2))
    assert not len(np.intersect1d(J.keys(a), J.keys(b)))


def test_tree_prunes_and_finds_all_links():
    rng = np.random.default_rng(1)
    base = [rng.integers(0, 2**63, int(rng.integers(20, 60)), dtype=np.uint64) for _ in range(12)]
    sets = [np.unique(np.r_[b[rng.random(len(b)) > 0.03], rng.integers(0, 2**63, 1, dtype=np.uint64)]) for b in base for _ in range(15)]
    compared = []
    tree = SignatureTree(sets, fanout=4)
    import portvigil.llm.signature_tree as S

    real = S.linked
    try:
        S.linked = lambda a, b, p: compared.append(1) or real(a, b, p)
        found = tree.join(90, np.arange(len(sets)))
    finally:
        S.linked = real

    def roots(pairs):
        root = list(range(len(sets)))
        for a, b in pairs:
            one, two = root[a], root[b]
            root = [min(one, two) if r in (one, two) else r for r in root]
        return root

    pairs = [(i, j) for i in range(len(sets)) for j in range(i)]
    assert roots(found) == roots([p for p in pairs if linked(sets[p[0]], sets[p[1]], 90)])
    assert len(compared) < len(pairs) / 8  # families are told apart by their bitmaps, linked sets are not compared again
