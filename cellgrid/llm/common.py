"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch as scratch

#: Bytes of text that one vectorised step works on; its arrays take some 50 times as much.
CHUNK_BYTES = 1 << 18


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written as a table in the shared folder and read again: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: a lambda's variable isn't inlined."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sampled_texts(docs: DataFrame, groups: DataFrame, by: str, n: int, n_groups: int = 256) -> DataFrame:
    """by, text: at most n documents of each value of by, those first by a hash of id and text.

    groups: doc_id and by of the rows of docs(doc_id, text) to choose from, with _cg_text, the hash of the text. Rows alike in id and text count once, so what is
    returned is bounded, however often an id occurs.
    """
    known = staged(groups.select("doc_id", "_cg_text", by).distinct(), "labelled")
    chosen = hash_sample(known, n, ("doc_id", "_cg_text"), by, n_groups)
    texts = docs.select("doc_id", "text", text_hash().alias("_cg_text")).join(F.broadcast(chosen), ["doc_id", "_cg_text"])
    return texts.groupBy("doc_id", "_cg_text", by).agg(F.first("text").alias("text")).select(by, "text")


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def small_enough(df: DataFrame, max_rows: int) -> bool:
    """Whether df has at most max_rows rows; the proof that a broadcast is bounded."""
    return df.limit(max_rows + 1).count() <= max_rows


def hash_sample(rows: DataFrame, n: int, key: str | tuple[str, ...] = "doc_id", by: str | None = None, groups: int = 256) -> DataFrame:
    """At most n rows (of each value of by, of the groups most frequent ones): those first by a hash of key, the same ones each time.

    Rows are counted first, and a bound on the hash leaves about four times n; so what a task sends on shrinks as the table grows.
    """
    key = (key,) if isinstance(key, str) else key
    place = F.shiftrightunsigned(F.xxhash64(*key), 33) / F.lit(float(1 << 31))
    if by is None:
        share = min(1.0, 4.0 * n / max(1, rows.count()))
        return rows.withColumn("_cg_place", place).filter(F.col("_cg_place") <= share).orderBy("_cg_place", *key).limit(n).drop("_cg_place")
    counts = rows.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by).limit(groups).collect()
    shares = rows.sparkSession.createDataFrame([(r[0], min(1.0, 4.0 * n / r.n)) for r in counts], T.StructType([T.StructField(by, rows.schema[by].dataType), T.StructField("_cg_share", T.DoubleType())]))
    near = rows.join(F.broadcast(shares), by).withColumn("_cg_place", place).filter(F.col("_cg_place") <= F.col("_cg_share"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy("_cg_place", *key))
    return near.withColumn("_cg_rank", rank).filter(F.col("_cg_rank") <= n).select(*rows.columns)
