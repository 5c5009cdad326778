"""Command line: python -m cellgrid.cli STEP --data-dir DIR ..."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .operators import ingest
from .plans import harness, specs, steps, taxi
from .plans.specs import EntitySpec
from .sources import files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cellgrid", description=__doc__)
    sub = p.add_subparsers(dest="step", required=True)

    def step(name: str, **kwargs) -> argparse.ArgumentParser:
        s = sub.add_parser(name, help=kwargs.pop("help"))
        s.add_argument("--data-dir", default="./data")
        s.add_argument("--years", nargs="*", default=None, help="2009-2011 2014; these years alone are worked on, others stay as they are")
        s.add_argument("--entity", default="trips")
        s.add_argument("--entities", help="YAML with entities; the taxi trips by default")
        s.add_argument("--schema", help="YAML with standard columns and source layouts; those of the taxi trips by default")
        return s

    d = step("download", help="fetch raw files")
    d.add_argument("--base-url", required=True)
    d.add_argument("--months", nargs="*", type=int)
    d.add_argument("--taxi-types", nargs="*", default=["yellow", "green"])
    step("extract-id", help="columns from file names, string ids, standard names and types")
    step("enrich", help="integer ids")
    step("clean", help="clean and dirty rows")
    step("create-facts", help="the slim fact table")
    f = step("build-facts", help="the facts as a table of the catalog, with statistics")
    f.add_argument("--table", default="facts")
    c = step("convolute", help="build the cubes; with --years, merge those years into them")
    c.add_argument("--convolutions", help="YAML with cubes; the taxi cubes by default")
    c.add_argument("--only", nargs="*")
    step("validate", help="profile of the raw files")
    v = step("verify", help="gaps and totals of the cubes")
    v.add_argument("--expect-start")
    v.add_argument("--expect-end")
    b = step("benchmark", help="time and check the queries")
    b.add_argument("--mode", choices=["cardinality", "bitmap", "hash"], default="cardinality")
    b.add_argument("--benchmark", help="YAML with queries; the taxi queries by default")
    b.add_argument("--zones", help="CSV of zones")
    b.add_argument("--iterations", type=int, default=5)
    b.add_argument("--best", choices=["median", "min"], default="median")
    b.add_argument("--queries", nargs="*")
    b.add_argument("--no-cache", action="store_true")
    b.add_argument("--results")
    b.add_argument("--usd-per-hour", type=float, nargs=2, metavar=("OWN", "OTHER"))
    k = step("consolidate", help="the newest results against published times and prices")
    k.add_argument("--benchmark", help="YAML with queries; the taxi queries by default")
    k.add_argument("--name", default="benchmark", help="results are in files NAME*times.csv")
    k.add_argument("--results", required=True, help="folder of results; the reports are written there too")
    k.add_argument("--usd-per-hour", type=float, nargs=2, metavar=("OWN", "OTHER"))
    return p


def _entity(a: argparse.Namespace) -> EntitySpec:
    if a.entities:
        return specs.entities_from(specs.load_yaml(a.entities))[a.entity]
    if a.entity != taxi.TRIPS.name:
        raise SystemExit(f"{a.entity} needs --entities")
    return taxi.TRIPS


_QUERIES = {"cardinality": taxi.BY_CARDINALITY, "bitmap": taxi.BY_BITMAP, "hash": taxi.BY_HASH}


def main(argv: list[str] | None = None, spark: SparkSession | None = None):
    """Runs a step; its time goes to `<data>/reports/timer`."""
    a = parser().parse_args(argv)
    years = files.year_range(a.years) if a.years else None
    if a.step == "download":
        if not years:
            raise SystemExit("download needs --years")
        names = files.wanted_files(a.taxi_types, years, a.months)
        return {n: files.download(f"{a.base_url.rstrip('/')}/{n}", f"{a.data_dir}/raw/entities/{a.entity}/{n.split('_')[-1][:4]}/{n}") for n in names}
    spark = spark or SparkSession.builder.appName("cellgrid").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    log = harness.TimerLog()
    with log.timed(a.step):
        out = _run(a, spark, years)
    log.append(spark, f"{a.data_dir.rstrip('/')}/reports/timer", a.entity)
    return out


def _run(a: argparse.Namespace, spark: SparkSession, years: list[int] | None):
    entity = _entity(a)
    if a.step == "extract-id":
        columns, variants = specs.schema_from(specs.load_yaml(a.schema)) if a.schema else (ingest.TRIP_COLUMNS, ingest.TRIP_VARIANTS)
        return steps.extract_ids(spark, a.data_dir, entity, years, columns, variants)
    if a.step == "enrich":
        return {r[steps.YEAR]: r.rows for r in steps.enrich(spark, a.data_dir, entity, years).collect()}
    if a.step == "clean":
        return {r.reason: r.n for r in steps.clean(spark, a.data_dir, entity, years).collect()}
    if a.step == "create-facts":
        return steps.create_facts(spark, a.data_dir, entity, years)
    if a.step == "build-facts":
        return steps.build_facts_table(spark, a.data_dir, entity, a.table)
    if a.step == "convolute":
        cubes = tuple(specs.cubes_from(specs.load_yaml(a.convolutions), a.entity)) if a.convolutions else taxi.CUBES
        return steps.convolute(spark, a.data_dir, cubes, entity, a.only, years)
    if a.step == "validate":
        return [r.asDict() for r in steps.validate_raw(spark, a.data_dir, entity, years).orderBy("file").collect()]
    if a.step == "verify":
        return steps.verify(spark, a.data_dir, spec=entity, start=a.expect_start, end=a.expect_end)
    mode = getattr(a, "mode", "cardinality")
    queries = tuple(specs.queries_from(specs.load_yaml(a.benchmark), getattr(a, "queries", None))) if a.benchmark else _QUERIES[mode]
    prices = map(harness.month_cost, a.usd_per_hour) if a.usd_per_hour else ()
    if a.step == "consolidate":
        return steps.consolidate(spark, a.results, queries, a.results, a.name, *prices)
    steps.views(spark, a.data_dir, spec=entity, zones=a.zones, cached=not a.no_cache, hashed=mode == "hash")
    found = steps.benchmark(spark, a.data_dir, queries, a.iterations, a.queries, a.results, a.best)
    return harness.consolidated(found, *prices)


if __name__ == "__main__":
    print(json.dumps(main(), indent=1, default=str))
