import urllib.error
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cellgrid.plans import harness, specs
from cellgrid.plans.compare import compare
from cellgrid.sources import files, sinks
from cellgrid.streaming import incremental


def test_compare(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "k string, v double")
    a = rows(("x", 1.001), (None, 2.0), ("y", 3.0))
    assert compare(a, rows((None, 2.0), ("x", 1.0), ("y", 3.0))).same
    assert compare(a, a.select(F.col("k").alias("other"), F.col("v").cast("decimal(9,3)"))).same
    worse = compare(a, rows(("x", 1.0), ("x", 1.0), ("y", 3.0)))
    assert not worse.same and "only raw" in worse.report()
    assert compare(a, rows(("z", 0.0), ("q", 0.0), ("y", 1.0)), "count_only").same
    assert compare(a, a.limit(0), "none").same and not compare(a, a.drop("v")).same


def test_harness(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int").createOrReplaceTempView("raw_rows")
    spark.sql("SELECT k, count(*) cnt FROM raw_rows GROUP BY k").createOrReplaceTempView("conv_k")
    good = specs.QuerySpec("q1", "SELECT k, COUNT(*) FROM raw_rows GROUP BY k", "SELECT k, cnt FROM conv_k", published_ms=1e9, expected={"a": 2})
    bad = specs.QuerySpec("q2", "SELECT 1", "SELECT 2", expected={"2": 5})
    got = harness.run_benchmark(spark, [good, bad], 2, report=str(tmp_path / "mismatch.txt"))
    assert [(r["validated"], r["expected_met"]) for r in got] == [(True, True), (False, False)]
    assert "q2" in (tmp_path / "mismatch.txt").read_text()
    harness.write_results(got, str(tmp_path / "results" / "r.csv"))
    assert files.newest_csv(spark, str(tmp_path / "results")).count() == 2
    done = harness.consolidated(got, harness.month_cost(0.5), 1000.0)
    assert done[0]["verdict"] == "faster" and done[1]["verdict"] == "n/a" and done[0]["price_gap"].endswith("cheaper")
    assert harness.tables_of("SELECT 1 FROM conv_x c LEFT JOIN conv_y ON a JOIN facts") == {"conv_x", "conv_y", "facts"}
    assert [harness.cores_of("box, 32 vCPU"), harness.cores_of("m7.big", {"m7": 16}), harness.cores_of("x"), harness.cores_of("x", explicit=4)] == ["32", "16", "?", "4"]
    log = harness.TimerLog()
    with log.timed("step"):
        pass
    log.write(str(tmp_path / "t.csv"))
    assert harness.fits_memory(1) and not harness.fits_memory(1 << 60)


def test_yaml(tmp_path):
    p = tmp_path / "c.yaml"
    p.write_text("""
convolutions:
  - {name: a, entity: trips, dimensions: [{col: t, transform: extract_date, output_col: day}, {col: k}], bitmap_col: id, add_cardinality_col: true, partitions: [{col: day}]}
  - {name: b, entity: trips, enabled: false, dimensions: [{col: k}]}
queries:
  - {id: Q0, enabled: false, sql: a, cube_sql: b}
  - {id: Q1, sql: a, cube_sql: b, validation: {compare: exact, expected: {x: 1}}}
""")
    config = specs.load_yaml(p)
    (one,) = specs.cubes_from(config, "trips")
    assert one.names == ["day", "k"] and one.date == "day" and one.add_cardinality and not one.add_hash
    assert specs.cubes_from(config, "other") == []
    assert [(q.id, q.rewritten) for q in specs.queries_from(config)] == [("Q1", "b")] and [q.id for q in specs.queries_from(config, ["Q0"])] == ["Q0"]


def test_files(spark, tmp_path):
    assert files.year_range(["2009-2011", "2014"]) == [2009, 2010, 2011, 2014]
    base = tmp_path / "entities" / "trips"
    spark.range(3).write.parquet(str(base / "2009" / "a.parquet"))
    spark.range(2).withColumn("x", F.lit(1)).write.parquet(str(base / "2010" / "b.parquet"))
    found = files.paths_for(str(tmp_path), "trips", [2009])
    assert found and all("2009" in p for p in found)
    assert files.scan(spark, str(base), by_name=True).select("id", "x").count() == 5
    assert files.tables_in(str(base)) == ["a", "b"]
    files.view(spark, "both", str(base), by_name=True, cached=True)
    assert spark.sql("SELECT COUNT(x) c FROM both").head().c == 2
    assert files.first_existing(spark, str(tmp_path / "no"), str(base)) == str(base)
    with pytest.raises(FileNotFoundError):
        files.first_existing(spark, str(tmp_path / "no"))
    assert files.footer(next(str(p) for p in base.rglob("*.parquet") if p.is_file()))["row_groups"] >= 0
    (tmp_path / "z.csv").write_text("LocationID,Borough,Zone,service_zone\n1,EWR,Newark,\n2,,Jamaica,Boro\n")
    assert [tuple(r) for r in files.zones(spark, str(tmp_path / "z.csv")).collect()] == [(1, "Newark", "EWR", None), (2, "Jamaica", None, "Boro")]
    assert files.wanted_files(["green"], [2013], [7, 8]) == ["green_tripdata_2013-08.parquet"]


def test_download(tmp_path):
    calls = []

    class Answer:
        def __init__(self, parts):
            self.parts = parts

        def __enter__(self):
            return self

        def __exit__(self, *a):
            return False

        def read(self, n):
            return self.parts.pop(0) if self.parts else b""

    def opener(url):
        calls.append(url)
        if "gone" in url:
            raise urllib.error.HTTPError(url, 403, "no", None, None)
        if len(calls) < 3:
            raise OSError("flaky")
        return Answer([b"ab", b"c"])

    waits = []
    assert files.download("u", str(tmp_path / "f"), opener=opener, wait=waits.append) and Path(tmp_path / "f").read_bytes() == b"abc" and waits == [1, 2]
    assert files.download("u", str(tmp_path / "f"), opener=None)
    assert files.download("gone", str(tmp_path / "g"), opener=opener) is False


def test_sinks(spark, tmp_path):
    rows = spark.sql("SELECT id, date_add(date'2020-01-30', CAST(id AS INT)) d FROM range(4)")
    sinks.by_date(rows, str(tmp_path / "d"), "d", depth=3)
    assert (tmp_path / "d/year=2020/month=02/day=01").is_dir() and spark.read.parquet(str(tmp_path / "d")).count() == 4
    sinks.parquet(rows, str(tmp_path / "p"), rows_per_file=1)
    assert len(list((tmp_path / "p").glob("*.parquet"))) >= 4
    sinks.facts(rows, str(tmp_path / "f"))
    sinks.catalog_table(rows, "cellgrid_facts", "id", 2)
    assert spark.table("cellgrid_facts").count() == 4
    spark.sql("DROP TABLE cellgrid_facts")
    sinks.csv_report(rows, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 4 and "id" in sinks.shown(rows)


def test_stream_keeps_a_cube(spark, tmp_path):
    import datetime as dt

    from cellgrid.operators import cube

    spec = specs.CubeSpec("c", (specs.Dim("t", "extract_date", "day"), specs.Dim("k")), "id", "day")
    schema = "t timestamp_ntz, k string, id long"
    rows = lambda a, b: spark.createDataFrame([(dt.datetime(2020, 1, 1 + i % 3), "ab"[i % 2], i) for i in range(a, b)], schema)
    for a, b in ((0, 40), (30, 60)):
        rows(a, b).write.mode("append").parquet(str(tmp_path / "in"))
        q = incremental.maintain(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), spec, str(tmp_path / "cube"), str(tmp_path / "cp"), once=True)
        q.awaitTermination()
    got = cube.read(spark, str(tmp_path / "cube")).groupBy("k").agg(F.sum("cardinality").alias("n"))
    assert {r.k: r.n for r in got.collect()} == {"a": 30, "b": 30}
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withColumn("t", F.col("t").cast("timestamp"))
    assert incremental.windowed_counts(stream, "t", ["k"]).isStreaming
