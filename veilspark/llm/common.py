"""What the operators share: tables, labelled samples, prefix sums; durable intermediates and components come from the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import components, give_back, materialize, shared_dir  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(mod: int, rem: int, col: str = "doc_id"):
    return F.crc32(F.col(col).cast("string").cast("binary")) % mod == rem


def labelled(docs: DataFrame, labels: DataFrame, label: str, mod: int, rem: int, bound: int) -> DataFrame:
    """(doc_id, y, text) of at most ``bound`` documents a class outside the held-out fold, chosen by a hash of the id.

    One row an id: a document labelled twice counts with its larger label, rows that share an id with their least text
    (null if none has one). Only ids are shuffled until the sample is drawn.
    """
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(mod, rem))
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    )
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    parts = [known.where(F.col("y") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound) for v in (0, 1)]
    ids = F.broadcast(parts[0].unionByName(parts[1]))
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(ids, "doc_id").groupBy("doc_id").agg(F.min("y").alias("y"), F.min("text").alias("text"))


def running_base(df: DataFrame, group: list[str], order: str, value: str, out: str) -> DataFrame:
    """Sum of ``value`` over the rows of the group that come before, for a table with one row a group and ``order``."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long"))
