"""Writing: Parquet by date or codec, catalog tables with statistics, CSV reports."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parquet(rows: DataFrame, path: str, codec: str = "zstd", rows_per_file: int = 0, row_group_bytes: int = 0, mode: str = "overwrite") -> None:
    writer = rows.write.mode(mode).option("compression", codec).option("maxRecordsPerFile", rows_per_file)
    (writer.option("parquet.block.size", row_group_bytes) if row_group_bytes else writer).parquet(path)


def by_date(rows: DataFrame, path: str, date: Column | str, depth: int = 1, codec: str = "zstd", mode: str = "overwrite") -> None:
    """Folders of year, year and month, or to the day; zero-padded."""
    date = F.col(date) if isinstance(date, str) else date
    parts = {"year": F.date_format(date, "yyyy"), "month": F.date_format(date, "MM"), "day": F.date_format(date, "dd")}
    names = list(parts)[:depth]
    rows.withColumns({n: parts[n] for n in names}).write.mode(mode).option("compression", codec).partitionBy(*names).parquet(path)


def by_value(rows: DataFrame, path: str, column: str, codec: str = "zstd", replace_all: bool = True) -> None:
    """Folders by a column's value; replace_all: of everything that is there, else of the values that rows have alone."""
    writer = rows.write.mode("overwrite").option("compression", codec).option("partitionOverwriteMode", "static" if replace_all else "dynamic")
    writer.partitionBy(column).parquet(path)


def facts_codec() -> str:
    """The codec of facts: that in PARQUET_COMPRESSION, snappy by default."""
    return os.environ.get("PARQUET_COMPRESSION", "snappy")


def facts(rows: DataFrame, path: str) -> None:
    """Facts, by their codec."""
    parquet(rows, path, facts_codec())


def catalog_table(rows: DataFrame, name: str, bucket_by: str | None = None, buckets: int = 16) -> None:
    """A table in the catalog, replaced, with statistics for the optimizer; bucketed and sorted for joins without exchange where wanted."""
    spark = rows.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    writer = rows.write.mode("overwrite").format("parquet")
    (writer.bucketBy(buckets, bucket_by).sortBy(bucket_by) if bucket_by else writer).saveAsTable(name)
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR ALL COLUMNS")


def csv_report(rows: DataFrame, path: str) -> None:
    """One CSV file with a header; for reports, which are small."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def shown(rows: DataFrame, n: int = 20) -> str:
    """The first n rows as a bordered table."""
    return rows._show_string(n, False)
