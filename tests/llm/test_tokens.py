import base64
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from portvigil.llm import byte_bpe, token_counts, word_bpe
from portvigil.llm.worker_cache import WorkerCache

TEXTS = [
    None, "", " ", "\n", "a", "Hello, world!", "It's the dogs' day, they'll say", "a  b", "a\n\nb", "a\n\n\nb ", " \n x", "x\ty\t z", "x \ny", "tail\n",
    "\x1ca\x1db c\x1f", "a\x1c\x1d\x1eb \x1fc", "naïve Ünïcode Straße ΣΑΣ İstanbul", "中文字符 和 emoji 🙂🙂", "é café", " nb sp x", "1234567 ²³ ½",
    "<|endoftext|> in<|startoftext|>side", "a" * 5000, "ab" * 3000 + " " * 3000 + "!" * 3000, "the the the", "x " * 2100, "don't DON'T", "ͅɐ ɐɐ",
]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    letters = "ab éß\n\t .,!'1²Σ中-"
    more = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    rows = [(i, t, "clash", 7) for i, t in enumerate(TEXTS + more)]
    return spark.createDataFrame([*rows, rows[5]], "doc_id long, text string, ids string, n_tokens int")


def test_byte_ids_as_the_library_and_back(docs, spark):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = byte_bpe.encode(docs, path, P.PATTERN, decoded=True).collect()
    assert len(rows) == len(TEXTS) + 301
    for r in rows:
        assert np.frombuffer(r.ids, "<u4").tolist() == own.encode_ordinary(texts[r.doc_id]), texts[r.doc_id][:50]
        assert r.decoded == texts[r.doc_id].encode()
    again = byte_bpe.encode(docs, path, P.PATTERN).select("doc_id", byte_bpe.decode("ids", path).alias("b")).collect()
    assert all(r.b == texts[r.doc_id].encode() for r in again)
    assert byte_bpe.encode(docs.limit(0), path, P.PATTERN).count() == 0


def test_merge_of_random_bytes_is_the_library_s():
    ranks = byte_bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    for n in (1, 2, 3, 17, 64, 500):
        text = "".join(rng.choice("aeinrst ") for _ in range(n))
        if text.encode() not in ranks:
            assert byte_bpe.merge(text.encode(), ranks) == own.encode_ordinary(text)


def test_counts_as_the_library(docs):
    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for frequent in (32_768, 3):
        rows = token_counts.count_tokens(docs, path, frequent=frequent).collect()
        assert len(rows) == len(TEXTS) + 301
        for r in rows:
            n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
            assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 2048), texts[r.doc_id][:50]
    assert token_counts.count_tokens(docs.limit(0), path).count() == 0


def test_word_ids_as_the_library(docs):
    path = P.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), word_bpe.WordIds(path)
    for row in docs.collect():
        text = row.text or ""
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text[:50]


def test_ids_of_pieces_are_joined_from_bytes_made_once():
    own = word_bpe.WordIds(P.path("word_bpe_49k.json"))
    one = own.word("the")
    assert len(one) == 4 and own.word("The") is one  # nothing is packed for a word of one token
    assert own.encode("the The thé 12") == b"".join(own.word(w) for w in ("the", "the", "thé", "12"))


def test_a_word_before_a_mark_is_merged_once():
    path = P.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), word_bpe.WordIds(path)
    merged, merge = [], own.merge
    own.merge = lambda piece: merged.append(piece) or merge(piece)
    text = "quibbled quibbled, Quibbled. quibbled7 quibbled' (quibbled) <|quibbled été, ÉTÉ. naïf½ ñandú» été\u0301 ǅungla. Ωmega, " + "w" * 70 + "."
    assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    own.encode("quibbled! quibbled;")
    assert merged.count("quibbled") == 2  # in brackets it is a piece


def test_cache_is_bounded_and_right():
    cache = WorkerCache(lambda k: k * 2, 10)
    for k in [*range(100), *range(50)]:
        assert cache[k] == 2 * k
        assert len(cache) + len(cache.old) <= 20


def test_rank_files_are_base64(tmp_path):
    path = tmp_path / "ranks"
    path.write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for i, t in enumerate([b"a", b"b", b"ab"])))
    assert byte_bpe.merge(b"abab", byte_bpe.load_ranks(str(path))) == [2, 2]
