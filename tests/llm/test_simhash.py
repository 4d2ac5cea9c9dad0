import re

import numpy as np
import pytest
import xxhash

from portvigil.llm import simhash


def plain(text, words):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    found = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not found:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(found[i : i + words]).encode(), 42) for i in range(max(1, len(found) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("text", ["", " \t\n", "One", "one two three", "A b C d", "É é ß x y z w v", "a b c d " * 200, "x\x1cy z\x0bw q"])
def test_fingerprint(text):
    assert simhash.fingerprint(text, 4) == plain(text, 4)
    assert simhash.fingerprint(text, 5) == plain(text, 5)


def test_segments_leave_one_with_one_difference_at_most():
    for bits in range(12):
        cut = simhash.segments(bits)
        assert sum(w for _, w in cut) == 64 and 2 * len(cut) > bits


@pytest.mark.parametrize(("short", "long"), [(16, 65_536), (2, 3), (4, 10)])
def test_links_connect_what_all_pairs_connect(spark, short, long):
    rng = np.random.default_rng(2)
    near = []
    for base in rng.integers(0, 2**63, 25, dtype=np.uint64):
        for _ in range(30):
            x = int(base)
            for bit in rng.integers(0, 64, rng.integers(1, 4)):
                x ^= 1 << int(bit)
            near.append(x)
    fps = np.unique(np.array(near, dtype=np.uint64))
    signed = fps.view(np.int64).tolist()
    pairs = [(signed[i], signed[i + 1 + int(j)]) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 4)]
    df = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3)
    links = [tuple(r) for r in simhash.links(df, 4, short, long).collect()]
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 4 for a, b in links)
    assert roots(links) == roots(pairs)


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (170, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    found = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {k: v for k, v in roots(edges).items() if k != v}


def test_near_duplicates_of_odd_rows(spark):
    long = "word " * 30_000
    rows = [(7, "a b c d e", 1), (3, "A B c d e", 1), (9, None, 1), (8, "", 1), (None, "a b c d e", 1), (5, long, 1), (5, long, 1), (4, "q r s t u", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    found = sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert found == [(False, 3, 3), (False, 4, 4), (False, 5, 5), (False, 5, 5), (False, 7, 3), (False, 8, 8), (False, 9, 8), (True, 0, 3)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    digits = df.limit(1).select(simhash.hex_digits(df.fp.cast("long")).alias("h")).first().h
    assert digits == "0000000000000001"


def jaccard(a, b):
    a, b = (set(zip(*(t.lower().split()[i:] for i in range(5)), strict=False)) for t in (a, b))
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("block", [512, 3])
def test_one_of_alike_verifies_every_link(spark, block):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(12):
        base = list(rng.choice(words, 120))
        texts.append(" ".join(base))
        for edits in (1, 1, 2, 2, 3, 6, 8):  # up to 2 edits are alike to 0.8; chains of copies of copies
            copy = list(base)
            for at in rng.integers(0, 120, edits):
                copy[at] = f"x{rng.integers(1000)}"
            texts.append(" ".join(copy))
            base = copy if edits < 3 else base
    fps = [simhash.fingerprint(t, 2) for t in texts]
    near = [(i, j) for j in range(len(texts)) for i in range(j) if bin(fps[i] ^ fps[j]).count("1") <= 7]
    pairs = [(i, j) for i, j in near if jaccard(texts[i], texts[j]) >= 0.8]
    assert roots(pairs) != roots(near)  # without shingles more would be joined
    found = roots(pairs)
    want = sorted({found.get(i, i) for i in range(len(texts))})
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (None, texts[3])], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.one_of_alike(df.repartition(3), 2, 7, block=block).collect()) == want


def test_one_of_alike_of_odd_rows(spark):
    rows = [(1, None), (2, " "), (3, "a b"), (None, "A  b"), (4, "c"), (5, "c d e f g h"), (5, "C d e f g h")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.one_of_alike(df, 2, 7).collect()) == [1, 3, 4, 5]
    assert simhash.one_of_alike(df.limit(0), 2, 7).count() == 0


def test_a_second_seed_finds_more_of_the_alike_and_all_it_links_are_verified(spark):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(60):
        base = list(rng.choice(words, 100))
        copy = list(base)
        for at in (20, 70):
            copy[at] = f"x{rng.integers(1000)}"
        texts += [" ".join(base), " ".join(copy)]
    pairs = [(i, i + 1) for i in range(0, 120, 2) if jaccard(texts[i], texts[i + 1]) >= 0.8]

    def near(i, j, seeds):
        return any(bin(simhash.fingerprint(texts[i], 2, s) ^ simhash.fingerprint(texts[j], 2, s)).count("1") <= 7 for s in seeds)

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(5, texts[5])] * 3, "doc_id long, text string")
    sizes = {}
    for seeds in ((42,), (42, 43)):
        linked = {j for i, j in pairs if near(i, j, seeds)}
        kept = {r.doc_id for r in simhash.one_of_alike(df.repartition(4), 2, 7, seeds=seeds).collect()}
        assert kept == set(range(120)) - linked
        sizes[seeds] = len(linked)
    assert sizes[42, 43] > sizes[42,]


def test_groups_of_equal_texts_are_compared_once(spark):
    texts = spark.createDataFrame([(1, 0, 0), (2, 1, 3), (3, 2**40 - 1, 7), (4, 2**41 - 1, -1)], "text_hash long, fp long, fp_1 long")
    met = {r.text_hash: r.met for r in simhash.candidate_groups(texts, 7, 2).collect()}
    # 1 and 2 meet under both seeds, with 3 under the second; 3 and 4 under the first
    assert {k: len(v) for k, v in met.items()} == {1: 2, 2: 2, 3: 2, 4: 1}
    same = spark.createDataFrame([(1, 0, 0), (2, 1, 3)], "text_hash long, fp long, fp_1 long")
    assert all(len(r.met) == 1 for r in simhash.candidate_groups(same, 7, 2).collect())
