"""The steps from raw files to answers, as functions over folders: `<data>/<stage>/entities/<entity>`.

Raw files lie in a folder for each year, and that year stays with their rows (`file_year`): each later stage is partitioned by it. A step works on all
years, or on those that it is given, and then replaces these years alone; cubes are merged with the rows of those years. Each step can be run again.
"""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cube, ids, ingest, validation
from ..sources import files, sinks
from . import harness, taxi
from .specs import CubeSpec, EntitySpec, QuerySpec, StandardColumn, Variant

YEAR = "file_year"


def folder(data: str, stage: str, entity: str) -> str:
    return f"{data.rstrip('/')}/{stage}/entities/{entity}"


def stored(spark: SparkSession, data: str, stage: str, spec: EntitySpec, years: list[int] | None = None) -> DataFrame:
    """What a stage has written, of some years where given: other years' folders aren't read."""
    rows = spark.read.parquet(folder(data, stage, spec.name))
    return rows.filter(F.col(YEAR).isin(years)) if years else rows


def _store(rows: DataFrame, data: str, stage: str, spec: EntitySpec, years: list[int] | None, codec: str = "zstd") -> None:
    sinks.by_value(rows, folder(data, stage, spec.name), YEAR, codec, replace_all=not years)


def _same_columns(spark: SparkSession, paths: list[str]) -> list[list[str]]:
    """Files by their sets of columns; footers are read by several threads."""
    with ThreadPoolExecutor(16) as pool:
        kinds = list(pool.map(lambda p: spark.read.parquet(p).schema.simpleString(), paths))
    groups: dict[str, list[str]] = {}
    for p, kind in zip(paths, kinds, strict=True):
        groups.setdefault(kind, []).append(p)
    return list(groups.values())


def _layouts(spark: SparkSession, paths: list[str], spec: EntitySpec) -> list[DataFrame]:
    """The raw files, those of one set of columns together, with the columns and ids that their names give, and the year of their folder."""
    out = []
    for same in _same_columns(spark, paths):
        rows = spark.read.parquet(*same).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_row"))
        rows = ingest.add_columns(rows, spec.add_columns, F.col("_file"))
        if spec.unique_id:
            rows = rows.withColumn(spec.unique_id, ingest.string_id(spec.id_template, F.col("_row")))
        out.append(rows.withColumn(YEAR, F.regexp_extract("_path", r"/(\d{4})/[^/]*$", 1).try_cast("int")).drop("_file", "_path", "_row"))
    return out


def extract_ids(spark: SparkSession, data: str, spec: EntitySpec = taxi.TRIPS, years: list[int] | None = None, columns: tuple[StandardColumn, ...] = ingest.TRIP_COLUMNS, variants: tuple[Variant, ...] = ingest.TRIP_VARIANTS) -> None:
    """raw -> extracted: columns from file names, string ids; names and types of the standard, so that layouts can be united."""
    paths = files.paths_for(f"{data}/raw", spec.name, years, spark)
    if not paths:
        raise FileNotFoundError(f"no raw files of {spec.name} in {data}/raw" + (f" for {years}" if years else ""))
    parts = [validation.with_absent(ingest.standardised(ingest.standard_names(p, variants), columns)) for p in _layouts(spark, paths, spec)]
    _store(ingest.union_of_layouts([ingest.completed(p, columns) for p in parts]), data, "extracted", spec, years)


def enrich(spark: SparkSession, data: str, spec: EntitySpec = taxi.TRIPS, years: list[int] | None = None) -> DataFrame:
    """extracted -> enriched: integer ids, from the registry; returns the report: rows by year, and the seconds that it took."""
    began = time.perf_counter()
    rows = stored(spark, data, "extracted", spec, years)
    registry = ids.Registry(spark, f"{data.rstrip('/')}/registry/{spec.name}", spec.unique_id)
    registry.register(rows)
    _store(registry.with_ids(rows, spec.entity_id), data, "enriched", spec, years)
    report = stored(spark, data, "enriched", spec, years).groupBy(YEAR).agg(F.count("*").alias("rows"))
    report = report.select(F.lit(spec.name).alias("entity"), YEAR, "rows", F.lit(round(time.perf_counter() - began, 3)).alias("seconds"))
    sinks.csv_report(report, f"{data.rstrip('/')}/reports/enrich_{spec.name}")
    return report


def clean(spark: SparkSession, data: str, spec: EntitySpec = taxi.TRIPS, years: list[int] | None = None) -> DataFrame:
    """enriched -> clean and dirty; returns the counts of reasons, and writes a report of them by year."""
    rows = stored(spark, data, "enriched", spec, years)
    good, bad = validation.split(rows)
    _store(good, data, "clean", spec, years)
    _store(bad, data, "dirty", spec, years)
    dirty = F.col(validation.REASON) != ""
    marked = rows.select(YEAR, validation.reasons(rows.columns).alias(validation.REASON))  # a rule whose column a row's file lacked doesn't hold for it
    report = marked.groupBy(YEAR).agg(F.count("*").alias("rows_in"), F.count_if(~dirty).alias("rows_clean"), F.count_if(dirty).alias("rows_dirty"))
    by_reason = validation.reason_counts(rows, by=[YEAR]).groupBy(YEAR).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "reason", "n"))), " ").alias("reasons"))
    report = report.join(by_reason, YEAR, "left").select(F.lit(spec.name).alias("entity"), YEAR, "rows_in", "rows_clean", "rows_dirty", F.round(100 * F.col("rows_dirty") / F.col("rows_in"), 2).alias("dirty_pct"), "reasons")
    sinks.csv_report(report.orderBy(YEAR), f"{data.rstrip('/')}/reports/clean_{spec.name}")
    return validation.reason_counts(rows)


#: The stages that clean rows are taken from: the first that is there.
CLEAN_STAGES = ("clean", "enriched_fix", "enriched")


def clean_rows(spark: SparkSession, data: str, spec: EntitySpec = taxi.TRIPS, years: list[int] | None = None) -> DataFrame:
    """The clean rows, or those of the stages before where they aren't there."""
    found = files.first_existing(spark, *(folder(data, s, spec.name) for s in CLEAN_STAGES))
    rows = spark.read.parquet(found)
    return rows.filter(F.col(YEAR).isin(years)) if years else rows


def validate_raw(spark: SparkSession, data: str, spec: EntitySpec = taxi.TRIPS, years: list[int] | None = None, expected: tuple[str, ...] = taxi.RAW_COLUMNS, above: float = 0.05) -> DataFrame:
    """file, rows, cols, extra, issues, ok of each raw file: missing columns, columns with more nulls than above, negative numbers. One job for each set of columns."""
    out = []
    for same in _same_columns(spark, files.paths_for(f"{data}/raw", spec.name, years, spark)):
        rows = spark.read.parquet(*same)
        names = rows.columns
        gaps = validation.layout_gaps(names, list(expected))
        nulls = [F.avg(F.col(f"`{c}`").isNull().cast("int")).alias(f"_null{i}") for i, c in enumerate(names)]
        numbers = [c for c in taxi.RAW_NUMBERS if c in names]
        below = [F.count_if(F.col(c) < 0).alias(f"_below{i}") for i, c in enumerate(numbers)]
        each = rows.withColumn("file", F.col("_metadata.file_name")).groupBy("file").agg(F.count("*").alias("rows"), *nulls, *below)
        said = [F.lit(f"missing columns: {', '.join(gaps['missing'])}")] if gaps["missing"] else []
        said += [F.when(F.col(f"_null{i}") > above, F.concat(F.lit(f"{c}: "), F.round(F.col(f"_null{i}") * 100, 1), F.lit(" % null"))) for i, c in enumerate(names)]
        said += [F.when(F.col(f"_below{i}") > 0, F.concat(F.col(f"_below{i}"), F.lit(f" rows with negative {c}"))) for i, c in enumerate(numbers)]
        issues = F.filter(F.array(*said), lambda x: x.isNotNull())
        out.append(each.select("file", "rows", F.lit(len(names)).alias("cols"), F.lit(", ".join(gaps["extra"])).alias("extra"), issues.alias("issues")).withColumn("ok", F.size("issues") == 0))
    return ingest.union_of_layouts(out) if out else spark.createDataFrame([], "file string, rows long, cols int, extra string, issues array<string>, ok boolean")


def create_facts(spark: SparkSession, data: str, spec: EntitySpec = taxi.TRIPS, years: list[int] | None = None) -> None:
    """clean -> facts."""
    rows = clean_rows(spark, data, spec, years)
    _store(ingest.facts(rows, spec.entity_id, spec.facts, keep=(YEAR,)), data, "facts", spec, years, sinks.facts_codec())


def build_facts_table(spark: SparkSession, data: str, spec: EntitySpec = taxi.TRIPS, name: str = "facts", buckets: int = 16) -> int:
    """The facts as a table of the catalog, bucketed and sorted by entity, with statistics; returns its rows."""
    sinks.catalog_table(files.scan(spark, folder(data, "facts", spec.name)).drop(YEAR), name, spec.entity_id, buckets)
    return spark.table(name).count()


def convolute(spark: SparkSession, data: str, cubes: tuple[CubeSpec, ...] = taxi.CUBES, spec: EntitySpec = taxi.TRIPS, only: list[str] | None = None, years: list[int] | None = None) -> list[str]:
    """clean -> one cube for each spec; returns the names of those that were built. With years, their rows are merged into the cubes that are there."""
    rows, built = clean_rows(spark, data, spec, years), []
    for c in cubes:
        if c.enabled and (not only or c.name in only) and (made := cube.build(rows, c)) is not None:
            path = f"{folder(data, 'cubes', spec.name)}/{c.name}"
            (cube.upsert if years else cube.write)(made, c, path)
            built.append(c.name)
    return built


def verify(spark: SparkSession, data: str, cubes: tuple[CubeSpec, ...] = taxi.CUBES, spec: EntitySpec = taxi.TRIPS, start: str | None = None, end: str | None = None) -> list[dict]:
    """For each cube: first and last date, dates, entities, missing days, and the difference from the clean rows."""
    rows, out = clean_rows(spark, data, spec), []
    for c in cubes:
        path = f"{folder(data, 'cubes', spec.name)}/{c.name}"
        if cube.has_files(spark, path):
            own = cube.read(spark, path)
            gaps = cube.missing_days(own, c.date, start, end)
            out.append({"cube": c.name, **cube.coverage(own, c.date).head().asDict(), "missing_days": gaps.count(), "missing_months": [r.month for r in cube.missing_months(gaps).collect()], "delta": cube.cross_check(own, rows).head().delta})
    return out


def views(spark: SparkSession, data: str, cubes: tuple[CubeSpec, ...] = taxi.CUBES, spec: EntitySpec = taxi.TRIPS, zones: str | None = None, cached: bool = False, hashed: bool = False) -> None:
    """Registers trips, facts, taxi_zones and the cubes for SQL; hashed: also bitmap_counts, the counts of all cubes' bitmaps by their hash."""
    clean_rows(spark, data, spec).createOrReplaceTempView(spec.name)
    files.view(spark, "facts", files.first_existing(spark, *(folder(data, s, spec.name) for s in ("facts", "facts_fix"))), cached=cached)
    if zones:
        files.zones(spark, zones).createOrReplaceTempView("taxi_zones")
    found = []
    for c in cubes:
        path = f"{folder(data, 'cubes', spec.name)}/{c.name}"
        if cube.has_files(spark, path):
            rows = cube.read(spark, path)
            found.append(rows)
            (rows.persist() if cached else rows).createOrReplaceTempView(c.name)
    if hashed and found:
        counts = cube.counts_by_hash(found)
        (counts.persist() if cached else counts).createOrReplaceTempView("bitmap_counts")


def benchmark(spark: SparkSession, data: str, queries: tuple[QuerySpec, ...] = taxi.BY_CARDINALITY, iterations: int = 5, ids_: list[str] | None = None, results: str | None = None, best: str = "median") -> list[dict]:
    """Times and checks the enabled queries (or those named) over the registered views."""
    wanted = [q for q in queries if (q.id in ids_ if ids_ else q.enabled)]
    found = harness.run_benchmark(spark, wanted, iterations, report=f"{results}.mismatches.txt" if results else None, best=best)
    if results:
        harness.write_results(found, results)
    return found


def consolidate(spark: SparkSession, results: str, queries: tuple[QuerySpec, ...], to: str, name: str, own_month: float | None = None, other_month: float | None = None) -> list[dict]:
    """The newest results whose name begins with name, in the folder results, against the published times of queries: `<name>_consolidated.csv` and `<name>_cost.csv` in to.

    Queries that are disabled, have no published time or no result are left out.
    """
    known = {q.id: q for q in queries if q.enabled and q.published_ms is not None}
    rows = [r.asDict() for r in files.newest_csv(spark, results, f"{name}*times.csv").collect() if r.query_id in known]
    rows = [r | {"benchmark_id": name, "category": known[r["query_id"]].category, "published_ms": known[r["query_id"]].published_ms} for r in rows]
    found = harness.consolidated(rows, own_month, other_month)
    harness.write_results(sorted(found, key=lambda r: (r["verdict"] == "slower", r["query_id"])), f"{to}/{name}_consolidated.csv")
    harness.write_results([harness.cost_summary(name, found, own_month, other_month)], f"{to}/{name}_cost.csv")
    return found
