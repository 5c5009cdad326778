"""Cubes: build, merge, write, read, verify."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bitmaps, roaring
from ..functions.transforms import transform
from ..plans.specs import CubeSpec


def _finished(cells: DataFrame, spec: CubeSpec) -> DataFrame:
    if not spec.add_cardinality:
        cells = cells.drop(bitmaps.CARDINALITY)
    if spec.add_hash:
        cells = cells.withColumn(bitmaps.HASH, bitmaps.stable_hash(bitmaps.BITMAP))
    return cells


def build(rows: DataFrame, spec: CubeSpec) -> DataFrame | None:
    """The cube of rows: its dimensions, bucket, bitmap, and by flags cardinality and bitmap_hash.

    Rows with a null id, or a null date where the cube is partitioned by it, are left out; so are rows with a null dimension, unless the cube keeps
    them. A source column that rows lack makes the cube None, or a dimension of nulls if it keeps nulls. One exchange, on dimensions and bucket,
    after partial aggregation.
    """
    missing = [d.column for d in spec.dims if d.column not in rows.columns]
    if spec.entity not in rows.columns or (missing and not spec.keep_null_dims):
        return None
    dims = [(F.lit(None).cast("string") if d.column in missing else transform(d.transform, d.column)).alias(d.name) for d in spec.dims]
    own = rows.filter(F.col(spec.entity).isNotNull()).select(*dims, F.col(spec.entity).alias("_entity"))
    if spec.date:
        own = own.filter(F.col(spec.date).isNotNull())
    if not spec.keep_null_dims:
        own = own.na.drop(subset=spec.names)
    return _finished(bitmaps.build(own, spec.names, "_entity"), spec)


def merge(cubes: list[DataFrame], spec: CubeSpec) -> DataFrame:
    """Cubes of the same dimensions as one: bitmaps of a cell are or-ed, so merging rows twice changes nothing."""
    rows = cubes[0]
    for c in cubes[1:]:
        rows = rows.unionByName(c, allowMissingColumns=True)
    return _finished(bitmaps.union(rows, spec.names), spec)


def rollup(cube: DataFrame, keys: list[str], disjoint: bool, name: str = "cnt") -> DataFrame:
    """Distinct entities by some of a cube's columns: sums of cardinalities where cells are disjoint, else unions counted."""
    if disjoint and bitmaps.CARDINALITY in cube.columns:
        return cube.groupBy(*keys).agg(F.sum(bitmaps.CARDINALITY).alias(name))
    return bitmaps.cardinality(bitmaps.union(cube, keys), keys, name)


def write(cube: DataFrame, spec: CubeSpec, path: str, mode: str = "overwrite", max_records: int = 0) -> None:
    """Parquet by year of the cube's date, rows in the order of the dimensions."""
    out = cube.withColumn("year", F.year(F.col(spec.date))) if spec.date else cube
    keys = (["year"] if spec.date else []) + spec.names
    if spec.date:
        out = out.hint("rebalance", "year")  # a year's cells go to as many tasks as their size asks for
    writer = out.sortWithinPartitions(*keys).write.mode(mode).option("compression", "zstd").option("maxRecordsPerFile", max_records)
    (writer.partitionBy("year") if spec.date else writer).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def counts(cube: DataFrame, spec: CubeSpec, path: str, rows_per_partition: int = 25_000) -> DataFrame:
    """The cells' counts without their bitmaps, stored at path and kept in memory in as many partitions as their number asks for, up to the default parallelism for each million.

    One partition is grouped without an exchange, so questions to a small cube are jobs of a single task. For cubes whose cells share no ids.
    """
    cube.groupBy(*spec.names).agg(F.sum(bitmaps.CARDINALITY).alias(bitmaps.CARDINALITY)).write.mode("overwrite").parquet(path)
    cells = read(cube.sparkSession, path)
    cores = cube.sparkSession.sparkContext.defaultParallelism
    n = cells.count()
    wanted = max(min(cores, -(-n // rows_per_partition)), -(-n // 1_000_000))
    return (cells.coalesce(1) if wanted <= 1 else cells.repartition(wanted)).persist()


def counts_by_hash(cubes: list[DataFrame]) -> DataFrame:
    """bitmap_hash, cnt of each distinct bitmap of the cubes: what a lookup by hash needs, made once."""
    each = [c.select(bitmaps.HASH, bitmaps.count(bitmaps.BITMAP).alias("cnt")) for c in cubes if bitmaps.HASH in c.columns]
    return reduce(DataFrame.unionByName, each).filter(F.col(bitmaps.HASH).isNotNull()).groupBy(bitmaps.HASH).agg(F.max("cnt").alias("cnt"))


def with_counts(cells: DataFrame, known: DataFrame, name: str = "cnt") -> DataFrame:
    """cells with the counts that known has by their hash; those it lacks are counted."""
    found = cells.join(known.withColumnRenamed("cnt", "_known"), bitmaps.HASH, "left")
    return found.withColumn(name, F.coalesce("_known", bitmaps.count(bitmaps.BITMAP))).drop("_known")


def from_blobs(rows: DataFrame, dims: list[str], blob: str = "bitmap", add_hash: bool = True) -> DataFrame:
    """The cells of rows that hold whole sets as portable roaring blobs, as other tools write them: for rollups, merges and the router."""
    cells = bitmaps.build(rows.select(*dims, F.explode(roaring.rb_to_array(blob)).alias("_entity")), dims, "_entity")
    return cells.withColumn(bitmaps.HASH, bitmaps.stable_hash(bitmaps.BITMAP)) if add_hash else cells


def to_blobs(cells: DataFrame, dims: list[str]) -> DataFrame:
    """dims, bitmap (a portable roaring blob of the whole set), cardinality, bitmap_hash (blake2b of the blob): for other tools. Ids must be under 2**32."""
    whole = bitmaps.to_array(cells, dims, "_ids").select(*dims, F.size("_ids").cast("bigint").alias(bitmaps.CARDINALITY), roaring.rb_build("_ids").alias(bitmaps.BITMAP))
    return whole.withColumn(bitmaps.HASH, roaring.rb_hash(bitmaps.BITMAP))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def has_files(spark: SparkSession, path: str) -> bool:
    """Whether a table at path has data: a cube without a cell has none, and can't be read."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return exists(spark, path) and any(not f.getPath().getName().startswith(("_", ".")) for f in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p))


def upsert(new: DataFrame, spec: CubeSpec, path: str) -> None:
    """Merges new cells into the cube at path, rewriting only the years that they touch.

    The merged years go to a staging folder beside it first, as Spark can't overwrite what it reads; a rerun after a failure gives the same cube.
    """
    spark = new.sparkSession
    if not has_files(spark, path):
        return write(new, spec, path)
    if new.isEmpty():
        return None
    staging = f"{path.rstrip('/')}_staging_{uuid.uuid4().hex[:8]}"
    old = read(spark, path)
    if spec.date:
        years = new.select(F.year(spec.date).alias("year")).distinct()
        old = old.join(F.broadcast(years), "year", "left_semi").drop("year")  # a row for each year
    write(merge([old, new], spec), spec, staging)
    staged = read(spark, staging)
    if spec.date:
        staged.sortWithinPartitions("year", *spec.names).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("year").parquet(path)
    else:
        staged.write.mode("overwrite").option("compression", "zstd").parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(staging)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    return None


def coverage(cube: DataFrame, date: str) -> DataFrame:
    """min_date, max_date, n_dates, total (of cardinalities)."""
    return cube.agg(F.min(date).alias("min_date"), F.max(date).alias("max_date"), F.countDistinct(date).alias("n_dates"), F.sum(bitmaps.count(bitmaps.BITMAP)).alias("total"))


def missing_days(cube: DataFrame, date: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """The days from start to end (the cube's first and last by default) without a cell."""
    span = cube.agg(F.min(date).alias("lo"), F.max(date).alias("hi"))
    days = span.select(F.explode(F.sequence(F.to_date(F.lit(start)) if start else F.col("lo"), F.to_date(F.lit(end)) if end else F.col("hi"), F.expr("interval 1 day"))).alias("day"))
    return days.join(cube.select(F.col(date).alias("day")).distinct(), "day", "left_anti")


def missing_months(days: DataFrame, at_least: int = 28) -> DataFrame:
    """Months of which at_least days are missing count as gone: month, n_days."""
    return days.groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(F.count("*").alias("n_days")).filter(F.col("n_days") >= at_least)


def cross_check(cube: DataFrame, rows: DataFrame) -> DataFrame:
    """n_rows, n_cube and their delta: whether a cube of disjoint cells has each row once."""
    return rows.agg(F.count("*").alias("n_rows")).crossJoin(cube.agg(F.coalesce(F.sum(bitmaps.count(bitmaps.BITMAP)), F.lit(0)).alias("n_cube"))).withColumn("delta", F.col("n_cube") - F.col("n_rows"))
