import datetime as dt

import pytest
from pyspark.sql import functions as F

from cellgrid.functions import bitmaps
from cellgrid.operators import cube, ids, ingest, validation
from cellgrid.plans import router
from cellgrid.plans.specs import AddColumn, CubeSpec, Dim, Fact

T = dt.datetime


def test_columns_from_file_names(spark):
    name = F.col("f")
    rows = spark.createDataFrame([("Yellow_tripdata_2009-01.parquet",), ("other_2010-02.parquet",)], "f string")
    kinds = AddColumn("cab_type", (("yellow", "yellow"), ("green", "green")))
    got = ingest.add_columns(rows, (kinds, AddColumn("year", regex=r"(\d{4})-(\d{2})"), AddColumn("month", regex=r"(\d{4})-(\d{2})", group=2)), name).collect()
    assert [(r.cab_type, r.year, r.month) for r in got] == [("yellow", "2009", "01"), ("unknown", "2010", "02")]
    with pytest.raises(Exception, match="no year in the file name"):
        ingest.add_columns(rows, (AddColumn("year", regex=r"(\d{5})"),), name).collect()
    row = spark.createDataFrame([("2009", "01", "yellow", 7)], "year string, month string, cab_type string, n long")
    assert row.select(ingest.string_id("{year}_{month}_{rownum:08d}_{cab_type}", F.col("n"))).head()[0] == "2009_01_00000007_yellow"


def test_row_index_of_files(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "x"))
    rows = spark.read.parquet(str(tmp_path / "x")).select("id", ingest.string_id("r{rownum:03d}").alias("s"))
    assert {r.s for r in rows.collect()} == {f"r{i:03d}" for i in range(5)}


def test_layouts_maps_and_casts(spark):
    old = spark.createDataFrame([("2009-01-01 10:00:00", "CASH", "1.0", "x"), ("bad", " Cas ", "2.5", "7"), (None, "no ", None, "JFK")], "Trip_Pickup_DateTime string, Payment_Type string, Passenger_Count string, Rate_Code string")
    got = ingest.standardised(ingest.standard_names(old)).collect()
    assert [r.pickup_datetime for r in got] == [T(2009, 1, 1, 10), None, None]
    assert [(r.payment_type, r.passenger_count, r.RatecodeID) for r in got] == [(2, 1, None), (2, None, 7), (3, None, 2)]
    assert ingest.detect_variant(["VendorID", "vendor_id"], ingest.TRIP_VARIANTS).name == "schema_2010"
    assert ingest.detect_variant(["vendorid"], ingest.TRIP_VARIANTS) is None
    assert ingest.standard_names(spark.range(1)).columns == ["id"]
    slim = ingest.facts(spark.createDataFrame([(2, "1.5", "x")], "entity_id long, fare string, other string"), "entity_id", (Fact("fare", "FLOAT64"), Fact("absent", "INT64")))
    assert slim.columns == ["entity_id", "fare"] and slim.head().fare == 1.5


def test_all_trip_rules(spark):
    clean = dict(pickup_datetime=T(2020, 1, 1), dropoff_datetime=T(2020, 1, 1, 1), passenger_count=1, trip_distance=1.0, fare_amount=1.0, total_amount=1.0, tip_amount=0.0, tolls_amount=0.0, mta_tax=0.0, extra=0.0, congestion_surcharge=0.0, airport_fee=0.0, PULocationID=1, DOLocationID=2, cab_type="yellow", VendorID="1")
    dirty = [dict(pickup_datetime=None), dict(dropoff_datetime=None), dict(dropoff_datetime=T(2019, 1, 1)), dict(passenger_count=21), dict(passenger_count=-1)]
    dirty += [{c: -1.0} for c in ("trip_distance", "fare_amount", "total_amount", "tip_amount", "tolls_amount", "mta_tax", "extra", "congestion_surcharge", "airport_fee")]
    dirty += [dict(PULocationID=None), dict(DOLocationID=None), dict(cab_type=" \t"), dict(VendorID=None)]
    fine = [{}, dict(passenger_count=None), dict(passenger_count=0), dict(passenger_count=20), dict(fare_amount=None)]
    schema = ", ".join(f"{k} {'timestamp' if 'datetime' in k else 'long' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for k, v in clean.items())
    rows = spark.createDataFrame([tuple((clean | d).values()) for d in dirty + fine], schema)
    good, bad = validation.split(rows)
    assert good.count() == len(fine) and bad.count() == len(dirty)
    counts = {r.reason: r.n for r in validation.reason_counts(rows).collect()}
    assert counts == {r.label: 2 if r.label == "invalid_passenger_count" else 1 for r in validation.TRIP_RULES}
    stats = validation.split_stats(rows).head()
    assert (stats.rows_in, stats.clean, stats.dirty) == (len(dirty + fine), len(fine), len(dirty))
    two = spark.createDataFrame([(-1.0, -2.0)], "fare_amount double, total_amount double")
    assert two.select(validation.reasons(two.columns)).head()[0] == "fare_negative|total_negative|"
    assert validation.split_stats(rows.limit(0)).head().dirty_pct == 0
    assert validation.layout_gaps(["a", "b"], ["b", "c"]) == {"missing": ["c"], "extra": ["a"]}


SPEC = CubeSpec("c", (Dim("t", "extract_date", "day"), Dim("k")), "id", "day")


def _rows(spark, rows):
    return spark.createDataFrame(rows, "t timestamp_ntz, k string, id long")


def test_cube_null_policy(spark):
    rows = _rows(spark, [(T(2020, 1, 1), "a", 1), (T(2020, 1, 1), None, 2), (None, "a", 3), (T(2020, 1, 1), "a", None), (T(2021, 1, 1), "b", 4)])
    assert sorted((r.k, r.cardinality) for r in cube.build(rows, SPEC).collect()) == [("a", 1), ("b", 1)]
    kept = CubeSpec("c", SPEC.dims, "id", "day", keep_null_dims=True)
    assert sorted((str(r.k), r.cardinality) for r in cube.build(rows, kept).collect()) == [("None", 1), ("a", 1), ("b", 1)]
    assert cube.build(rows.drop("k"), SPEC) is None
    assert {r.k for r in cube.build(rows.drop("k"), kept).collect()} == {None}
    assert cube.build(rows.limit(0), SPEC).count() == 0
    bare = CubeSpec("c", SPEC.dims, "id", "day", add_cardinality=False, add_hash=False)
    assert cube.build(rows, bare).columns == ["day", "k", "bucket", "bitmap"]


def test_cube_merge_is_idempotent_and_without_order(spark, tmp_path):
    rows = _rows(spark, [(T(2020 + i % 2, 1, 1 + i % 5), "ab"[i % 2], i) for i in range(100)])
    a, b = cube.build(rows.filter("id < 70"), SPEC), cube.build(rows.filter("id > 30"), SPEC)
    want = {(r.day, r.k): (r.cardinality, r.bitmap_hash) for r in cube.build(rows, SPEC).collect()}
    for parts in ([a, b], [b, a], [a, b, a]):
        assert {(r.day, r.k): (r.cardinality, r.bitmap_hash) for r in cube.merge(parts, SPEC).collect()} == want
    path = str(tmp_path / "cube")
    for part in (a, b, b):
        cube.upsert(part, SPEC, path)
    assert {(r.day, r.k): (r.cardinality, r.bitmap_hash) for r in cube.read(spark, path).collect()} == want
    assert sorted(p.name for p in (tmp_path / "cube").iterdir() if p.is_dir()) == ["year=2020", "year=2021"]
    assert cube.cross_check(cube.read(spark, path), rows).head().delta == 0


def test_counts_of_a_small_cube_need_no_exchange(spark, tmp_path):
    rows = _rows(spark, [(T(2020, 1, 1 + i % 5), "ab"[i % 2], i) for i in range(100)])
    kept = cube.counts(cube.build(rows, SPEC), SPEC, str(tmp_path / "counts"))
    out = kept.groupBy("k").agg(F.sum("cardinality").alias("n"))
    assert {r.k: r.n for r in out.collect()} == {"a": 50, "b": 50}
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]


def test_registry_keeps_ids(spark, tmp_path):
    reg = ids.Registry(spark, str(tmp_path / "reg"), "s")
    rows = lambda *x: spark.createDataFrame([(v,) for v in x], "s string")
    first = {r.s: r.entity_id for r in reg.register(rows("b", "a", "b", None)).collect()}
    assert first == {"a": 0, "b": 1}
    second = {r.s: r.entity_id for r in reg.register(rows("0", "a", "c")).collect()}
    assert second == first | {"0": 2, "c": 3}
    assert {r.s: r.entity_id for r in reg.with_ids(rows("a", "zz")).collect()} == {"a": 0, "zz": None}


def test_router(spark):
    disjoint = SPEC
    overlap = CubeSpec("u", SPEC.dims, "user", "day", disjoint=False)
    other = CubeSpec("o", (*SPEC.dims, Dim("z")), "id", "day")
    key, day = router.Key("k"), router.Key("t", "extract_date", "month", "month")
    q = router.Question("id", (key, day))
    assert router.fits(disjoint, q) and not router.fits(overlap, q) and not router.fits(other, q)
    assert not router.fits(disjoint, router.Question("id", (key,), with_nulls=True))
    rows = spark.createDataFrame([(T(2020, 1, i % 28 + 1), "ab"[i % 2], i % 7, i) for i in range(60)], "t timestamp_ntz, k string, user long, id long")
    known = [router.Candidate(s, cube.build(rows, s), 10) for s in (disjoint, overlap)]
    users = router.Question("user", (key,))
    assert router.choose(known, users).spec is overlap
    assert {r.k: r.cnt for r in router.answer(users, known, rows).collect()} == {"a": 7, "b": 7} == {r.k: r.cnt for r in router.answer(users, [], rows).collect()}
    one = router.Question("id", (day,), {key: lambda c: c == "a"})
    assert [tuple(r) for r in router.answer(one, known, rows).collect()] == [(1, 30)]
    assert bitmaps.CARDINALITY in known[0].cube.columns
