import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    words = ["".join(rng.choice("aeionrst") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    docs, labels = [], []

    def add(i, text, lang="xx"):
        docs.append((i, text, lang, "s", len(text or ""), "clash"))

    for i in range(600):
        text = [rng.choice(words) for _ in range(rng.randrange(30, 120))]
        bad = i % 4 == 3
        add(i, " ".join(w + " !!" if bad else w for w in text))
        labels.append((i, int(not bad), 0))
    add(1000, docs[0][1])  # a copy
    near = docs[4][1].split()
    near[10] = "other"
    add(1001, " ".join(near))  # a near copy
    add(1002, docs[8][1] + " mail some.body@host.example.com now")
    add(1003, None)
    add(1004, "")
    docs += [docs[12], (None, docs[16][1] + " " + docs[20][1], "xx", "s", 1, "clash")]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.schema.simpleString() == spark.read.parquet(f"{folder}/documents.parquet").schema.simpleString()
    ids = [r.doc_id for r in kept["quality"]]
    good = [i for i in range(600) if i % 4 != 3]
    assert len([i for i in ids if i is not None and i < 600 and i % 4 == 3]) <= 3
    assert len(set(good) & set(ids)) >= len(good) - 3 and ids.count(12) == 2
    ids = [r.doc_id for r in kept["near_duplicates"]]
    assert 1000 not in ids and 1001 not in ids and ids.count(12) == 1 and None in ids
    assert len(set(good) & set(ids)) >= len(good) - 3
    masked = {r.doc_id: r for r in kept["personal_data"]}
    assert len(masked) == len(ids)
    if 1002 in masked:
        assert "[EMAIL]" in masked[1002].text and masked[1002].n_chars == len(masked[1002].text)
    tokens = {}
    for r in kept["packing"]:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
        total = r.doc_tokens
        assert tokens[r.doc_id] <= total
    assert set(tokens) == set(masked)


def test_run_and_empty_table(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 400
    empty = str(tmp_path / "empty")
    for table in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{table}.parquet").where(F.lit(False)).write.parquet(f"{empty}/{table}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_texts_of_one_id_are_told_apart(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    few = docs.where("doc_id in (16, 19)")  # one good text, one bad
    more = docs.unionByName(few.withColumn("doc_id", F.lit(7000).cast("long"))).unionByName(few.withColumn("doc_id", F.lit(None).cast("long")))
    kept = [(r.doc_id, "!!" in r.text) for r in corpus_pipeline.quality_filter(spark, more, folder).where("doc_id = 7000 or doc_id is null").collect()]
    assert kept.count((7000, False)) == 1 and (7000, True) not in kept and (None, True) not in kept
    near = docs.where("doc_id = 16").withColumn("doc_id", F.lit(7000).cast("long"))
    copies = near.unionByName(near.withColumn("text", F.concat("text", F.lit(" more"))))
    assert corpus_pipeline.drop_near_duplicates(spark, copies, folder).count() == 1
