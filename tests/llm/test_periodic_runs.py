import hashlib
import random
import zlib
from fractions import Fraction

import pytest

from portvigil.llm import periodic_runs as R
from portvigil.llm.queries import op13_periodic_runs


def brute_force(words, repeats=4, least=6):
    """Every stretch that no neighbour extends, for every period."""
    n, out = len(words), []
    for q in range(1, n // repeats + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, repeats * q):
                stretch = words[i : i + length]
                if not any(stretch[r:] == stretch[:-r] for r in range(1, q)):
                    out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def drawn(seed, most=60):
    rng = random.Random(seed)
    n = rng.choice([0, 1, 5, 7, 20, most])
    words = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(n)]
    if n > 8 and rng.random() < 0.6:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randint(3, 9)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def test_runs_equal_brute_force():
    for seed in range(0, 3000, 5):
        texts = [drawn(s) for s in range(seed, seed + 5)]
        assert R.search(texts) == [brute_force(t) for t in texts]


@pytest.mark.parametrize("repeats,least", [(2, 2), (2, 5), (3, 3)])
def test_shorter_runs(repeats, least):
    for seed in range(300):
        text = [b"ab"[random.Random(seed * 40 + i).randrange(2) :][:1] for i in range(40)]
        assert R.search([text], repeats, least) == [brute_force(text, repeats, least)]


def test_long_texts():
    assert R.search([[b"a"] * 200_000]) == [[(0, 200_000, 1)]]
    assert R.search([[b"%d" % (i % 7000) for i in range(100_000)]]) == [[(0, 100_000, 7000)]]
    one, two = [b"a"], [b"a", b"b"]
    while len(two) < 50_000:
        one, two = two, two + one
    assert R.search([two]) == [[]]  # repeats up to 3.6 times everywhere


def test_prefixes_of_unlike_texts_do_not_meet():
    texts = [[b"x", b"y"] * 2, [b"x", b"y"] * 2, [], [b"x"] * 6]
    assert R.search(texts) == [[], [], [], [(0, 6, 1)]]


def test_find_states_every_case(spark):
    rows = [(1, None), (2, ""), (3, "a a a a a"), (4, "a a a a a a"), (None, "b c b c b c b c"), (4, "a a a a a a"), (5, "x   x")]
    df = spark.createDataFrame([(*r, [1]) for r in rows], "doc_id long, text string, runs array<int>")
    found = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.strongest and tuple(r.strongest), r.collapsed) for r in R.find(df).collect()), key=str)
    six, pairs = (0, 6, 1), (0, 8, 2)
    assert found == sorted(
        [(1, [], None, ""), (2, [], None, ""), (3, [], None, "a a a a a"), (4, [six], six, "a"), (4, [six], six, "a"),
         (None, [pairs], pairs, "b c"), (5, [], None, "x   x")], key=str)
    assert R.find(df.limit(0)).count() == 0
    ties = spark.createDataFrame([(1, "b b b b b b c a a a a a a")], "doc_id long, text string")
    assert R.find(ties).first().strongest.start == 0


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(0, 90)))) for i in range(300)]
    rows += [(10**9, None), (None, "k k k k k k k"), (7, "z z z z z z z z"), (7, "z z z z z z z z")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for doc_id, text in rows:
        words = (text or "").split()
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute_force(words)
        top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
        kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)]
        want.append((doc_id, len(runs), *(top or (None,) * 3), top and 1000 * top[1] // top[2], *sha))
    assert sum(r[1] for r in want) > 10
    assert sorted(map(tuple, op13_periodic_runs(spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)
