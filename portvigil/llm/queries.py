"""The registered queries of this subpackage: each operator over its whole table, and the digests asked for."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portvigil.llm import byte_bpe, filter_audit, jaccard_join, packing, page_text, periodic_runs, permutation_index, pii, quality, secrets, secrets_sql, segment_search, simhash, token_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.nearest(_table(spark, sf_dir, "embeddings"))


def op2_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract(_table(spark, sf_dir, "pages"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = byte_bpe.encode(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, decoded=True)
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(_table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents"))
    strong = F.col("strong")
    return found.select(
        "doc_id",
        *(secrets.count(strong, kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")),
        F.sha2(secrets.listing(strong).cast("binary"), 256).alias("base_sha256"),
        secrets.listing(F.concat(strong, "linked")).alias("spans"),
    )


def op7_segment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_search.top_products(_table(spark, sf_dir, "embeddings"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find(periodic_runs.planted(_table(spark, sf_dir, "documents")))
    top = F.col("strongest")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(top[c].alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(periodic_runs.listing(F.col("runs")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_permutation_index, op2_page_text, op3_byte_bpe, op4_token_counts, op5_pii, op6_secrets, op7_segment_search, op8_quality, op9_packing, op10_simhash, op11_jaccard_join, op12_filter_audit, op13_periodic_runs)
}

#: DuckDB SQL of the queries that SQL expresses.
ORACLES: dict[str, str] = {
    "op6_secrets": secrets_sql.scan_sql(),
    "op12_filter_audit": filter_audit.AUDIT_SQL,
    "op7_segment_search": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e
            from embeddings
            where embedding is not null and len(embedding) > 0
              and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)
        ), scored as (
            select q.vec_id as query_id, c.vec_id,
                   cast(list_dot_product(cast(q.e as double[]), cast(c.e as double[])) as bigint) as score
            from v q join v c on q.vec_id <> c.vec_id
            where q.vec_id % 50 = 0
        ), ranked as (
            select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank,
                   vec_id, score
            from scored
        )
        select * from ranked where rank <= 5
    """,
}
