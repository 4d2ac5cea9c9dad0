"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portvigil.storage import drop_path, work_path


class _Rounds:
    """The newest of a series of written tables; each one replaces the one before."""

    def __init__(self) -> None:
        self.path: str | None = None

    def keep(self, df: DataFrame) -> DataFrame:
        spark, old = df.sparkSession, self.path
        self.path = work_path(spark, "components")
        df.write.parquet(self.path)
        if old:
            drop_path(spark, old)
        return spark.read.schema(df.schema).parquet(self.path)


@contextmanager
def connected(links: DataFrame) -> Iterator[DataFrame]:
    """(node, root) for every node of ``links`` (a, b) that has a link to another; root is the smallest node connected to it.

    Every round is a written table, so lineage stays short and a lost executor costs one round at most; it replaces
    the table of the round before.  The last one goes when the block ends.
    """
    rounds = _Rounds()
    try:
        yield _contracted(links, rounds)
    finally:
        if rounds.path:
            drop_path(links.sparkSession, rounds.path)


def _contracted(links: DataFrame, rounds: _Rounds) -> DataFrame:
    e = rounds.keep(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        )
        e = rounds.keep(small.select("e.*").where("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
