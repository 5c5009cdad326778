"""What plans must look like at scale: pruned scans, pushed filters, partial aggregation, no Python where none is needed."""

import re

from pyspark.sql import functions as F

from cellgrid.operators import cube
from cellgrid.plans import catalogue as c


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_is_pruned_and_filters_are_pushed(spark, sf_dir):
    rows = c.read(spark, sf_dir, "events").filter("event_type = 'click'")
    text = plan(cube.build(rows, c.EVENTS).groupBy("event_type").agg(F.sum("cardinality")))
    assert re.search(r"ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,event_type:string>", text)
    assert "EqualTo(event_type,click)" in text


def test_cube_aggregates_before_its_exchange(spark, sf_dir):
    text = plan(cube.build(c.read(spark, sf_dir, "events"), c.EVENTS))
    # words of 64 ids are or-ed before the first exchange; the second brings the words of a cell together
    assert "partial_bit_or" in text and len(re.findall(r"Exchange hashpartitioning", text)) == 2
    assert "Python" not in text and "Arrow" not in text
    counts = plan(cube.build(c.read(spark, sf_dir, "events"), c.EVENTS).groupBy("event_type").agg(F.sum("cardinality")))
    assert "collect_list" not in counts and "unhex" not in counts  # counts alone need no bitmaps


def test_years_are_pruned(spark, tmp_path, sf_dir):
    path = str(tmp_path / "cube")
    cube.write(cube.build(c.read(spark, sf_dir, "orders"), c.ORDERS), c.ORDERS, path)
    text = plan(cube.read(spark, path).filter("year = 1995").groupBy("o_orderstatus").agg(F.sum("cardinality")))
    assert re.search(r"PartitionFilters: \[.*year.*1995", text) and re.search(r"ReadSchema: struct<o_orderstatus:string,cardinality:bigint>", text)


def test_small_dimension_is_broadcast_and_in_is_a_semi_join(spark, sf_dir):
    rows, nation = c.read(spark, sf_dir, "customer"), c.read(spark, sf_dir, "nation")
    rows.createOrReplaceTempView("_c")
    nation.createOrReplaceTempView("_n")
    text = plan(spark.sql("SELECT COUNT(*) FROM _c WHERE c_nationkey IN (SELECT n_nationkey FROM _n WHERE n_name = 'NATION_3')"))
    assert re.search(r"BroadcastHashJoin.*LeftSemi", text)
