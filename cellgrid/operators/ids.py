"""Stable integer ids of string ids, kept in a registry table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cube import exists


def _offsets(rows: DataFrame, key: str, by: str, last: int) -> DataFrame:
    """rows (already in ranges of key, with their partition in by) with ids last + 1, last + 2, ... in the order of key."""
    from pyspark.sql import Window

    counts = rows.groupBy(by).agg(F.count("*").alias("_n"))
    before = counts.select(by, (F.sum("_n").over(Window.orderBy(by)) - F.col("_n")).alias("_before"))  # a row for each partition
    rank = F.row_number().over(Window.partitionBy(by).orderBy(key))
    return rows.join(F.broadcast(before), by).withColumn("entity_id", F.lit(last) + F.col("_before") + rank)


def dense_ids(keys: DataFrame, key: str, scratch: str, last: int = -1) -> DataFrame:
    """key, entity_id of each distinct key, in the order of keys, from last + 1 on.

    Keys are dealt to ranges and written to scratch first, as the ranges that Spark draws aren't the same each time; then each range is numbered on
    its own behind the counts of those before it.
    """
    spark = keys.sparkSession
    ranged = keys.select(key).filter(F.col(key).isNotNull()).distinct().repartitionByRange(key).withColumn("_part", F.spark_partition_id())
    ranged.write.mode("overwrite").parquet(scratch)
    return _offsets(spark.read.parquet(scratch), key, "_part", last).select(key, "entity_id")


class Registry:
    """The table key -> entity_id at path. Keys keep their ids for good; new keys get ids beyond the largest."""

    def __init__(self, spark: SparkSession, path: str, key: str = "string_id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def read(self) -> DataFrame:
        if exists(self.spark, f"{self.path}/ids"):
            return self.spark.read.parquet(f"{self.path}/ids")
        return self.spark.createDataFrame([], T.StructType([T.StructField(self.key, T.StringType()), T.StructField("entity_id", T.LongType())]))

    def register(self, rows: DataFrame) -> DataFrame:
        """Adds the keys of rows that are new, and returns the table. A rerun adds nothing."""
        known = self.read()
        new = rows.select(self.key).distinct().join(known, self.key, "left_anti")
        last = known.agg(F.max("entity_id")).head()[0]
        dense_ids(new, self.key, f"{self.path}/_ranges", -1 if last is None else last).write.mode("append").parquet(f"{self.path}/ids")
        return self.read()

    def with_ids(self, rows: DataFrame, name: str = "entity_id") -> DataFrame:
        """rows with the ids of their keys; null for keys that aren't registered."""
        return rows.join(self.read().withColumnRenamed("entity_id", name), self.key, "left")
