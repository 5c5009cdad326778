"""All steps over made-up trips in three layouts, then every query in its three forms."""

import datetime as dt
import random
import shutil

import pytest

from cellgrid import cli
from cellgrid.plans import steps, taxi


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    root, rng = tmp_path_factory.mktemp("taxi"), random.Random(1)
    layouts = {
        ("yellow", 2009, 1): "Trip_Pickup_DateTime string, Trip_Dropoff_DateTime string, Passenger_Count int, Trip_Distance double, Payment_Type string, Total_Amt double, Rate_Code string, vendor_name string",
        ("yellow", 2015, 3): "tpep_pickup_datetime timestamp, tpep_dropoff_datetime timestamp, passenger_count double, trip_distance double, payment_type int, total_amount double, RatecodeID int, VendorID int, PULocationID int, DOLocationID int",
        ("green", 2015, 3): "lpep_pickup_datetime timestamp, lpep_dropoff_datetime timestamp, passenger_count double, trip_distance double, payment_type int, total_amount double, RatecodeID int, VendorID int, PULocationID int, DOLocationID int",
    }
    for (kind, year, month), schema in layouts.items():
        rows = []
        for _ in range(120):
            at = dt.datetime(year, month, rng.randrange(1, 28), rng.randrange(24), rng.randrange(60))
            end = at + dt.timedelta(minutes=rng.randrange(-1, 60))
            pax, far, pay = rng.randrange(0, 7), round(rng.random() * 12, 2), round(rng.random() * 50 - 1, 2)
            if year == 2009:
                rows.append((str(at), str(end), pax, far, rng.choice(["CASH", "Credit", "No Charge"]), pay, rng.choice(["1", "JFK", None]), rng.choice(["VTS", None, " "])))
            else:
                rows.append((at, end, float(pax), far, rng.randrange(1, 7), pay, rng.randrange(1, 7), rng.randrange(1, 3), rng.randrange(1, 6), rng.randrange(1, 6)))
        path = root / "raw/entities/trips" / str(year)
        path.mkdir(parents=True, exist_ok=True)
        spark.createDataFrame(rows, schema).toPandas().to_parquet(path / f"{kind}_tripdata_{year}-{month:02d}.parquet", coerce_timestamps="us")
    (root / "zones.csv").write_text("LocationID,Borough,Zone,service_zone\n1,M,Midtown East,Y\n2,M,Midtown East,Y\n3,Q,Astoria,B\n9,X,Nowhere,N\n")
    for step in ("extract-id", "enrich", "clean", "create-facts", "convolute"):
        cli.main([step, "--data-dir", str(root)], spark)
    return root


def test_steps(spark, data):
    extracted = spark.read.parquet(steps.folder(str(data), "extracted", "trips"))
    assert extracted.count() == 360 and extracted.select("trip_id").distinct().count() == 360
    assert {r.trip_id for r in extracted.filter("trip_id like '%00000007%'").collect()} == {"2009_01_00000007_yellow", "2015_03_00000007_yellow", "2015_03_00000007_green"}
    enriched = spark.read.parquet(steps.folder(str(data), "enriched", "trips"))
    assert sorted(r.entity_id for r in enriched.select("entity_id").collect()) == list(range(360))
    clean, dirty = (spark.read.parquet(steps.folder(str(data), s, "trips")).count() for s in ("clean", "dirty"))
    assert clean + dirty == 360 and dirty > 0
    before = {r.trip_id: r.entity_id for r in enriched.collect()}
    cli.main(["enrich", "--data-dir", str(data)], spark)
    assert {r.trip_id: r.entity_id for r in spark.read.parquet(steps.folder(str(data), "enriched", "trips")).collect()} == before


def test_verified(spark, data):
    found = {v["cube"]: v for v in cli.main(["verify", "--data-dir", str(data), "--expect-start", "2014-12-01", "--expect-end", "2015-03-31"], spark)}
    assert set(found) == {c.name for c in taxi.CUBES}
    assert found["conv_cab_type"]["delta"] == 0 == found["conv_pickup_zone"]["delta"]
    assert set(found["conv_cab_type"]["missing_months"]) >= {"2014-12", "2015-01", "2015-02"}
    raw = {r["file"]: r for r in cli.main(["validate", "--data-dir", str(data)], spark)}
    assert set(raw) == {"yellow_tripdata_2009-01.parquet", "yellow_tripdata_2015-03.parquet", "green_tripdata_2015-03.parquet"}
    assert all(r["rows"] == 120 and not r["ok"] for r in raw.values())
    assert any(i.startswith("missing columns: VendorID") for i in raw["yellow_tripdata_2009-01.parquet"]["issues"]) and any("Rate_Code" in i for i in raw["yellow_tripdata_2009-01.parquet"]["issues"])
    report = spark.read.option("header", True).csv(f"{data}/reports/clean_trips").orderBy(steps.YEAR).collect()
    assert [r[steps.YEAR] for r in report] == ["2009", "2015"] and sum(int(r.rows_in) for r in report) == 360 and all(int(r.rows_clean) + int(r.rows_dirty) == int(r.rows_in) for r in report)
    assert {r.step for r in spark.read.option("header", True).csv(f"{data}/reports/timer").collect()} >= {"extract-id", "enrich", "clean", "create-facts", "convolute"}
    assert cli.main(["build-facts", "--data-dir", str(data), "--table", "cellgrid_test_facts"], spark) == spark.read.parquet(steps.folder(str(data), "clean", "trips")).count()
    spark.sql("DROP TABLE cellgrid_test_facts")


@pytest.mark.parametrize("mode", ["cardinality", "bitmap", "hash"])
def test_queries(spark, data, mode):
    names = [q.id for q in taxi.BY_CARDINALITY]
    found = cli.main(["benchmark", "--data-dir", str(data), "--mode", mode, "--zones", str(data / "zones.csv"), "--iterations", "1", "--queries", *names, "--results", str(data / f"{mode}.csv")], spark)
    assert [f["query_id"] for f in found] == names and all(f["validated"] for f in found), found
    assert all(f["rows"] > 0 for f in found) and not found[0]["expected_met"]


def test_years_one_after_another(spark, data, tmp_path):
    shutil.copytree(data / "raw", tmp_path / "raw")
    run = lambda *years: [cli.main([s, "--data-dir", str(tmp_path), "--years", *years], spark) for s in ("extract-id", "enrich", "clean", "create-facts", "convolute")]
    run("2009")
    run("2015")
    once = {}
    for again in (False, True):  # a year that is run again changes nothing
        if again:
            run("2009")
        for stage in ("extracted", "enriched", "clean", "dirty", "facts"):
            n = spark.read.parquet(steps.folder(str(tmp_path), stage, "trips")).groupBy(steps.YEAR).count().orderBy(steps.YEAR).collect()
            assert [tuple(r) for r in n] == [tuple(r) for r in spark.read.parquet(steps.folder(str(data), stage, "trips")).groupBy(steps.YEAR).count().orderBy(steps.YEAR).collect()]
        for spec in taxi.CUBES:
            path = f"{steps.folder(str(tmp_path), 'cubes', 'trips')}/{spec.name}"
            cells = lambda p, spec=spec: {(*(str(r[c]) for c in spec.names), r.bucket): r.bitmap_hash for r in spark.read.parquet(p).collect()}
            rows, whole = cells(path), cells(f"{steps.folder(str(data), 'cubes', 'trips')}/{spec.name}")
            assert len(rows) > 0 and set(rows) == set(whole)
            assert rows == once.setdefault(spec.name, rows), spec.name
    with pytest.raises(FileNotFoundError):
        cli.main(["extract-id", "--data-dir", str(tmp_path), "--years", "1999"], spark)


def test_entity_and_schema_from_yaml(spark, data, tmp_path):
    (tmp_path / "e.yaml").write_text("""
entities:
  - name: trips
    add_cols:
      - {col: cab_type, strategy: from_filename, patterns: {yellow: yellow, green: green}}
      - {col: year, strategy: from_filename_regex, regex: '(\\d{4})-\\d{2}', group: 1}
    unique_id: {col: trip_key, format: "{cab_type}-{year}-{rownum:04d}"}
    entity_id: {id_table: trip_ids}
    fact_cols: [{col: trip_distance, dtype: float64}]
""".replace("\\\\", "\\"))
    (tmp_path / "s.yaml").write_text("""
standard_columns:
  - {name: trip_distance, dtype: FLOAT64}
  - {name: payment_type, dtype: INT64, value_map: {cash: 2, credit: 1, 'no charge': 3}}
schema_mappings:
  - {name: old, detect_col: Trip_Pickup_DateTime, rename: {Trip_Distance: trip_distance, Payment_Type: payment_type}}
""")
    shutil.copytree(data / "raw", tmp_path / "raw")
    args = ["--data-dir", str(tmp_path), "--entities", str(tmp_path / "e.yaml"), "--schema", str(tmp_path / "s.yaml")]
    for step in ("extract-id", "enrich", "create-facts"):
        cli.main([step, *args], spark)
    rows = spark.read.parquet(steps.folder(str(tmp_path), "extracted", "trips"))
    assert rows.filter("trip_key = 'yellow-2009-0007'").count() == 1
    assert {r.payment_type for r in rows.filter("file_year = 2009").select("payment_type").collect()} <= {1, 2, 3}
    assert set(spark.read.parquet(steps.folder(str(tmp_path), "facts", "trips")).columns) == {"entity_id", "trip_distance", steps.YEAR}


def test_consolidated(spark, data, tmp_path):
    cli.main(["benchmark", "--data-dir", str(data), "--zones", str(data / "zones.csv"), "--iterations", "1", "--results", str(tmp_path / "taxi_times.csv")], spark)
    found = cli.main(["consolidate", "--data-dir", str(data), "--results", str(tmp_path), "--name", "taxi", "--usd-per-hour", "0.86", "1.55"], spark)
    assert {f["query_id"] for f in found} == {q.id for q in taxi.BY_CARDINALITY if q.enabled and q.published_ms}
    assert (tmp_path / "taxi_consolidated.csv").exists() and "gap_year_usd" in (tmp_path / "taxi_cost.csv").read_text()
    assert all(f["framing"] for f in found)
