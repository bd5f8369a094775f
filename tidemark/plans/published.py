"""Derived tables published by generation: built aside, visible once whole, and never rebuilt for a generation that is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def generations(spark: SparkSession, root: str, namespace: str) -> list[int]:
    """Whole generations, ascending: those whose writer has left its success mark, which Spark's committer writes last."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/{namespace}")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    found = [s.getPath() for s in files.listStatus(path) if s.getPath().getName().startswith("generation=")]
    return sorted(int(p.getName().split("=")[1]) for p in found if files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def publish(df: DataFrame, root: str, namespace: str, generation: int) -> bool:
    """Writes the generation; False, without any work, if it is there already. A write that broke off is written anew."""
    spark = df.sparkSession
    if generation in generations(spark, root, namespace):
        return False
    df.write.mode("overwrite").parquet(f"{root}/{namespace}/generation={generation}")
    return True


def current(spark: SparkSession, root: str, namespace: str) -> tuple[int, DataFrame] | None:
    """(generation, table) of the latest whole generation."""
    found = generations(spark, root, namespace)
    return (found[-1], spark.read.parquet(f"{root}/{namespace}/generation={found[-1]}")) if found else None


def prune(spark: SparkSession, root: str, namespace: str, keep: int = 2) -> list[int]:
    """Deletes all but the latest generations; readers of the one before the last may still be at work."""
    gone = generations(spark, root, namespace)[: -max(1, keep)]
    for g in gone:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{namespace}/generation={g}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return gone


def synchronised(index: DataFrame, documents: DataFrame, key: str, mark: str) -> DataFrame:
    """key, action: what it takes to bring an index (key, mark) to the documents (key, mark): added, changed, kept or deleted."""
    old = index.select(F.col(key), F.col(mark).alias("_old"), F.lit(True).alias("_had"))
    new = documents.select(F.col(key), F.col(mark).alias("_new"), F.lit(True).alias("_has"))
    action = F.when(F.col("_had").isNull(), "added").when(F.col("_has").isNull(), "deleted").when(F.col("_old").eqNullSafe(F.col("_new")), "kept").otherwise("changed")
    return old.join(new, key, "full").select(key, action.alias("action"))
