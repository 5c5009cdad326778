"""Reading: paths by year, Parquet with several layouts, CSV dimensions, downloads, introspection."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def year_range(given: list[str] | str) -> list[int]:
    """["2009-2011", "2014"] as sorted years."""
    years: set[int] = set()
    for part in [given] if isinstance(given, str) else given:
        a, _, b = str(part).partition("-")
        years.update(range(int(a), int(b or a) + 1))
    return sorted(years)


def paths_for(base: str, entity: str, years: list[int] | None = None, spark: SparkSession | None = None) -> list[str]:
    """The Parquet files of an entity, sorted; of some years where given. With spark, in any file system that it can read."""
    roots = [f"{base}/entities/{entity}/{y:04d}" for y in years] if years else [f"{base}/entities/{entity}"]
    if spark is None:
        return sorted(str(p) for f in roots for p in Path(f).rglob("*.parquet"))
    found = []
    for root in roots:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        listed = system.listFiles(path, True) if system.exists(path) else None
        while listed is not None and listed.hasNext():
            found.append(listed.next().getPath().toString())
    return sorted(p for p in found if p.endswith(".parquet"))


def scan(spark: SparkSession, *paths: str, columns: list[str] | None = None, by_name: bool = False) -> DataFrame:
    """Parquet files or folders, at any depth; by_name: files of several layouts, columns united by name. Columns are pruned in the scan."""
    rows = spark.read.option("mergeSchema", by_name).option("recursiveFileLookup", True).parquet(*paths)
    return rows.select(*columns) if columns else rows


def view(spark: SparkSession, name: str, *paths: str, by_name: bool = False, cached: bool = False) -> DataFrame:
    """The files as a view for SQL; cached: kept in memory, what doesn't fit on disk."""
    rows = scan(spark, *paths, by_name=by_name)
    if cached:
        rows = rows.persist()
    rows.createOrReplaceTempView(name)
    return rows


def first_existing(spark: SparkSession, *paths: str) -> str:
    """The first of the paths that is there: facts or their repaired copy, clean rows or the stages before."""
    from ..operators.cube import exists

    for p in paths:
        if exists(spark, p):
            return p
    raise FileNotFoundError(", ".join(paths))


# The spellings of the header of a CSV of zones.
_ZONES = {"location_id": ("LocationID", "location_id", "locationid"), "zone": ("Zone", "zone"), "borough": ("Borough", "borough"), "service_zone": ("service_zone", "ServiceZone")}


def zones(spark: SparkSession, path: str) -> DataFrame:
    """location_id, zone, borough, service_zone from a CSV with a header in any of its spellings; empty values are null."""
    raw = spark.read.option("header", True).csv(path)
    pick = {name: next((c for c in spellings if c in raw.columns), None) for name, spellings in _ZONES.items()}
    value = lambda c: F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) if c else F.lit(None).cast("string")
    return raw.select(*[(value(c).try_cast("int") if name == "location_id" else value(c)).alias(name) for name, c in pick.items()])


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def tables_in(folder: str) -> list[str]:
    """Names of the Parquet tables in a folder: stems of files, folders ending in .parquet."""
    return sorted({p.stem for p in Path(folder).rglob("*.parquet") if not any(q.suffix == ".parquet" for q in p.parents)})


def footer(path: str) -> dict:
    """Row groups, rows and codec of a Parquet file."""
    import pyarrow.parquet as pq

    meta = pq.ParquetFile(path).metadata
    codec = meta.row_group(0).column(0).compression if meta.num_row_groups and meta.num_columns else None
    return {"row_groups": meta.num_row_groups, "rows": meta.num_rows, "codec": codec}


def has_columns(rows: DataFrame, *names: str) -> bool:
    return all(n in rows.columns for n in names)


# The first months that there are files of.
_FIRST_MONTHS = {"green": (2013, 8), "fhv": (2019, 2)}


def available(kind: str, year: int, month: int) -> bool:
    """Whether files of a kind of cab exist for a month: green from August 2013, fhv from February 2019."""
    return (year, month) >= _FIRST_MONTHS.get(kind, (0, 0))


def wanted_files(kinds: list[str], years: list[int], months: list[int] | None = None, pattern: str = "{kind}_tripdata_{year}-{month:02d}.parquet") -> list[str]:
    return [pattern.format(kind=k, year=y, month=m) for k in kinds for y in years for m in (months or range(1, 13)) if available(k, y, m)]


def download(url: str, to: str, tries: int = 5, opener=urllib.request.urlopen, wait=time.sleep) -> bool:
    """Fetches a file in pieces; False where the server says 403 (it isn't there). Other failures are tried again after 1, 2, 4, ... seconds; a file that exists isn't fetched."""
    target = Path(to)
    if target.exists():
        return True
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(target.name + ".part")
    for n in range(tries):
        try:
            with opener(url) as answer, part.open("wb") as out:
                while piece := answer.read(1 << 16):
                    out.write(piece)
            part.rename(target)
            return True
        except urllib.error.HTTPError as e:
            if e.code == 403:
                return False
            if n == tries - 1:
                raise
        except OSError:
            if n == tries - 1:
                raise
        wait(2**n)
    return False


def newest_csv(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """The newest of a folder's CSV files."""
    found = sorted(Path(folder).glob(pattern), key=lambda p: p.stat().st_mtime)
    if not found:
        raise FileNotFoundError(f"{folder}/{pattern}")
    return spark.read.option("header", True).option("inferSchema", True).csv(str(found[-1]))
