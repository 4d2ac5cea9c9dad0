import re

import duckdb
import numpy as np
import pytest

from check_oracle import compare
from portvigil.llm import filter_audit as A

DOCS = "doc_id long, text string, lang string, part string, n long"
LABELS = "doc_id long, quality int, toxic int"


def texts():
    rng = np.random.default_rng(5)
    words = ["a", "Be", "ünï", "日本", "x" * 9, "y" * 16, "z" * 17, "w" * 64, "v" * 65, "v" * 64 + "u", "#", "A&B", " ", "é" * 40]
    drawn = [" \t\n".join(rng.choice(words, int(rng.integers(0, 60)))) for _ in range(60)]
    return ["", " ", "\r\x0b\x0c", "A", "one  two one ", *drawn, "q" * 5000, " ".join(["same"] * 300), " ".join(f"n{i}" for i in range(300))]


def test_transducer_counts_equal_those_of_patterns():
    all_texts = texts()
    data = [t.encode() for t in all_texts]
    offsets = np.cumsum([0, *map(len, data)])
    found = A.counts(np.frombuffer(b"".join(data), dtype=np.uint8), offsets)
    for i, text in enumerate(all_texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        want = (len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(text), len(re.findall("[#$%&*|]", text)))
        assert tuple(int(found[m][i]) for m in A.MEASURES) == want, text


def test_words_of_equal_hash_stay_different():
    words = [b"alpha", b"beta", b"alpha", b"x" * 70, b"x" * 69 + b"y", b"x" * 70, b"longer-than-8", b"longer-than-9"]
    data = np.frombuffer(b" ".join(words), dtype=np.uint8)
    length = np.array([len(w) for w in words])
    spans = A.Spans(data, np.cumsum(length + 1) - length - 1, length)
    kept = A.first_of_equals(spans, np.zeros(len(words), np.int64), np.full(len(words), 7, np.uint64))
    assert kept.sum() == len(set(words))


def test_batches_are_cut_by_bytes(spark, monkeypatch):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["ab", "", "cdefgh", "i", "", "é"])], ["t"]).slice(1)
    cut = list(A.in_bytes(iter([batch]), 0, most=4))
    assert [b.num_rows for b, _, _ in cut] == [1, 1, 3]
    assert b"".join(d.tobytes() for _, d, _ in cut).decode() == "cdefghié"


def small_tables(spark):
    body = " ".join(f"word{i}" for i in range(250))
    rows = [(1, body, "en"), (2, body, "de"), (2, body, "de"), (3, body, None), (None, body, "en"), (1, body, "en"), (4, None, ""), (5, "", "en"),
            (6, body.upper(), "en"), (7, body + " #", "de"), (8, "few few few few #A", "de"), (9, "few few few few #A", "de")]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], DOCS)
    labels = spark.createDataFrame([(2, 1, None), (2, 0, 1), (8, None, 1), (9, 1, 1), (None, 1, 1)], LABELS)
    return docs, labels


def test_audit_agrees_with_sql_on_nulls_ties_and_repeated_rows(spark):
    docs, labels = small_tables(spark)
    con = duckdb.connect()
    documents, known = docs.toPandas().astype({"doc_id": "Int64"}), labels.toPandas().astype("Int64")
    con.register("documents", documents)
    con.register("labels", known)
    got = {(r.part, r.filter_order, r.step): r.asDict() for r in A.audit(docs, labels).collect()}
    want = con.sql(A.AUDIT_SQL)
    rows = [dict(zip(want.columns, r)) for r in want.fetchall()]
    assert len(rows) == len(got) == 3 * 120 * 5
    for row in rows:
        assert got[row["part"], row["filter_order"], row["step"]] == row
    one = got["de", "EABCD", 1]
    assert (one["removed"], one["good_lost"], one["toxic_lost"]) == (3, 3, 3)  # both rows of id 2 and id 9


def test_shares_add_up(spark):
    docs, labels = small_tables(spark)
    rows = A.audit(docs, labels).where("filter_order = 'ABCDE'").collect()
    for part in ("", "de", "en"):
        mine = [r for r in rows if r.part == part]
        assert sum(r.shapley for r in mine) == 120 * sum(r.removed for r in mine)


def test_empty_table(spark):
    docs, labels = small_tables(spark)
    assert A.audit(docs.limit(0), labels).count() == 0
    assert A.audit(docs, labels.limit(0)).agg({"good_lost": "sum"}).first()[0] == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query_agrees_with_sql(spark, sf):
    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    assert compare(spark, con, "op12_filter_audit", sf).startswith("ok")
