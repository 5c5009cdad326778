import datetime as dt
import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellgrid.functions import bitmaps, roaring
from cellgrid.functions.transforms import TRANSFORMS, stripped, transform


def test_transforms(spark):
    rows = spark.createDataFrame([(2.5,), (-2.5,), (0.49999999999999994,), (1.25,), (0.35,), (2.675,), (float("inf"),), (float("nan"),), (None,)], "x double")
    got = rows.select(transform("round", "x").alias("r"), transform("round_1dp", "x").alias("d"), transform("floor", "x").alias("f"), transform("ceiling", "x").alias("c")).collect()
    assert [g.r for g in got] == [3, -2, 1, 1, 0, 3, None, None, None]
    assert [g.d for g in got][3:6] == [1.2, 0.4, 2.7]
    assert [g.f for g in got][:2] == [2, -3] and [g.c for g in got][:2] == [3, -2]
    day = spark.createDataFrame([(dt.datetime(2009, 3, 2, 17, 5),), (None,)], "t timestamp_ntz")
    got = day.select(*[transform(f"extract_{n}", "t").alias(n) for n in ("date", "hour", "dow", "year", "month")]).collect()
    assert tuple(got[0]) == (dt.date(2009, 3, 2), 17, "Monday", 2009, 3) and set(got[1]) == {None}
    assert len(TRANSFORMS) == 10
    with pytest.raises(ValueError):
        transform("other", "x")
    assert spark.range(1).select(stripped(F.lit("\t a b\n "))).head()[0] == "a b"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 200_000), st.integers(0, (1 << 32) - 1))), st.lists(st.integers(0, 200_000)))
def test_roaring_round_trip(a, b):
    assert roaring.decode(roaring.encode(a)).tolist() == sorted(set(a))
    x, y = roaring.encode(a), roaring.encode(b)
    assert roaring._count(roaring._or(x, y)) == roaring._count(x) + roaring._count(y) - roaring._count(roaring._and(x, y))


def test_roaring_containers():
    dense = list(range(70_000))
    assert roaring.decode(roaring.encode(dense)).tolist() == dense
    # a blob with a run container, by the format's description: one container, key 0, ids 10 to 14
    blob = bytes.fromhex("3b30 0000 01 0000 0400 0100 0a00 0400".replace(" ", ""))
    assert roaring.decode(blob).tolist() == [10, 11, 12, 13, 14]
    with pytest.raises(ValueError):
        roaring.encode([-1])
    with pytest.raises(ValueError):
        roaring.decode(b"\0\0\0\0")
    assert roaring.stable_hash(b"x") == int.from_bytes(hashlib.blake2b(b"x", digest_size=8).digest(), "big", signed=True)


def test_roaring_functions_in_sql(spark):
    roaring.register(spark)
    one = spark.sql("SELECT rb_build(array(1L, 5L, 70000L)) a, rb_build(array(5L, 6L)) b, CAST(NULL AS BINARY) n")
    one.createOrReplaceTempView("blobs")
    row = spark.sql("""SELECT rb_to_array(rb_and(a, b)) x, rb_to_array(rb_or(a, b)) y, rb_count(n) z, rb_to_array(n) e, rb_contains(a, 5L) c, rb_contains(n, 5L) d, rb_and(a, n) f,
        rb_chunk(a, -3L, 2L) g, rb_chunk(a, 1L, 0L) h, rb_chunk(a, 9L, 2L) i, rb_to_array(rb_union_list(array(a, n, b))) u, rb_count_precomputed(a, 0L, 3L) p, rb_count_precomputed(a, 0L, CAST(NULL AS BIGINT)) q,
        rb_count_hash(a, 1L) r, rb_count_hash(n, CAST(NULL AS BIGINT)) s, rb_to_array(rb_and_precomputed(a, 1L, b, 2L)) v, rb_to_array(rb_or_precomputed(a, 1L, b, 2L)) w, rb_hash(a) k FROM blobs""").head()
    assert (list(row.x), list(row.y), row.z, list(row.e), row.c, row.d, row.f) == ([5], [1, 5, 6, 70000], 0, [], True, False, None)
    assert (list(row.g), list(row.h), list(row.i), list(row.u)) == ([1, 5], [5], [], [1, 5, 6, 70000])
    assert (row.p, row.q, row.r, row.s, list(row.v), list(row.w)) == (3, 0, 3, 0, [5], [1, 5, 6, 70000])
    assert row.k == roaring.stable_hash(roaring.encode([1, 5, 70000]))


def test_bitmap_cells(spark):
    ids = [0, 1, 32768, 32769, 1 << 33, (1 << 33) + 5]
    rows = spark.createDataFrame([("a", i) for i in ids] + [("a", 1), ("b", 1), ("b", 32769), ("c", 7)], "k string, id long")
    cells = bitmaps.build(rows, ["k"], "id")
    assert {r.k: list(r.ids) for r in bitmaps.to_array(cells, ["k"]).collect()} == {"a": ids, "b": [1, 32769], "c": [7]}
    assert {r.k: r.cnt for r in bitmaps.cardinality(cells, ["k"]).collect()} == {"a": 6, "b": 2, "c": 1}
    assert bitmaps.cardinality(bitmaps.union(cells, []), []).head().cnt == 7
    both = bitmaps.intersect(cells.filter("k <> 'c'"), [], "k", 2)
    assert [list(r.ids) for r in bitmaps.to_array(both, []).collect()] == [[1, 32769]]
    for i, where in ((1, ["a", "b"]), (32768, ["a"]), (1 << 33, ["a"]), (7, ["c"]), (8, []), (2, [])):
        assert sorted(r.k for r in bitmaps.containing(cells, i).collect()) == where
    with pytest.raises(Exception, match="can't hold"):
        bitmaps.build(spark.createDataFrame([("a", -1)], "k string, id long"), ["k"], "id").collect()
    page = spark.createDataFrame([([1, 2, 3],), (None,)], "ids array<bigint>").select(bitmaps.chunk("ids", -1, 0).alias("a"), bitmaps.chunk("ids", 1, 5).alias("b")).collect()
    assert [(list(p.a), list(p.b)) for p in page] == [([1], [2, 3]), ([], [])]
    assert np.isclose(spark.createDataFrame([(None,)], f"b {bitmaps.TYPE}").select(bitmaps.count("b")).head()[0], 0)


def test_bitmaps_of_both_forms(spark):
    sets = {"few": [5, 63, 64, 32767], "edge": list(range(1, 2048)), "many": list(range(0, 32768, 3)), "all": list(range(1, 32769)), "far": [(1 << 40) + 1, (1 << 40) + 2]}
    rows = spark.createDataFrame([(k, i) for k, ids in sets.items() for i in ids * 2], "k string, id long").repartition(3)
    cells = bitmaps.build(rows, ["k"], "id")
    sizes = {r.k: (r.few, r.many, r.c) for r in cells.filter("bucket > 0").select("k", F.size("bitmap.positions").alias("few"), F.octet_length("bitmap.bits").alias("many"), F.col("cardinality").alias("c")).collect()}
    assert sizes == {"few": (4, None, 4), "edge": (2047, None, 2047), "many": (None, 4096, 10922), "all": (None, 4096, 32768), "far": (2, None, 2)}
    assert {r.k: list(r.ids) for r in bitmaps.to_array(cells, ["k"]).collect()} == sets
    assert {r.k: r.n for r in cells.groupBy("k").agg(F.sum(F.expr(bitmaps.COUNT_SQL)).alias("n")).collect()} == {k: len(v) for k, v in sets.items()}
    together = bitmaps.union(cells, [])
    assert [list(r.ids) for r in bitmaps.to_array(together, []).collect()] == [sorted(set().union(*sets.values()))]
    for a, b in (("few", "all"), ("edge", "many"), ("many", "all"), ("few", "far")):
        both = bitmaps.to_array(bitmaps.intersect(cells.filter(F.col("k").isin(a, b)), [], "k", 2), []).collect()
        assert [list(r.ids) for r in both] == [sorted(set(sets[a]) & set(sets[b]))]
    # equal sets have equal bitmaps and hashes, however they came about
    again = bitmaps.union(bitmaps.build(rows.withColumn("part", F.col("id") % 5), ["k", "part"], "id"), ["k"])
    hashes = lambda c: {(r.k, r.bucket): r.h for r in c.select("k", "bucket", bitmaps.stable_hash("bitmap").alias("h")).collect()}
    assert hashes(cells) == hashes(again)
    native = rows.groupBy("k", F.bitmap_bucket_number("id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("b"))
    native = native.select("k", "bucket", F.struct(F.lit(None).cast("array<smallint>").alias("positions"), F.col("b").alias("bits")).alias("bitmap"))  # Spark's form alone
    assert {r.k: r.cnt for r in bitmaps.cardinality(native, ["k"]).collect()} == {k: len(v) for k, v in sets.items()} and hashes(bitmaps.union(native, ["k"])) == hashes(cells)
    assert sorted(r.k for r in bitmaps.containing(cells, 32767).collect()) == ["all", "few"] and sorted(r.k for r in bitmaps.containing(cells, 9).collect()) == ["all", "edge", "many"]
