"""Headline queries on local[$BENCH_CPUS] over the tables in $BENCH_SF_DIR; prints one line of JSON.

Cubes are built once (timed as build_*), stored as Parquet and kept in memory, as the query side of a cube engine is meant to be used. Each query is
then run RUNS times with a full fetch, after WARM runs that warm up; the median counts. Each has a raw twin, and the ratio raw / cube shows what the cube saves.
At this scale both are mostly a job's floor; the queries named x100 ask the same of a hundred times the rows. They aren't in the total.
"""

from __future__ import annotations

import json
import os
import shutil
import statistics
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

RUNS = int(os.environ.get("BENCH_RUNS", "9"))
WARM = 5


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    scratch = tempfile.mkdtemp(prefix="cellgrid-bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"{scratch}/shared")
        .config("spark.sql.warehouse.dir", f"{scratch}/warehouse")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from cellgrid.functions import bitmaps
    from cellgrid.operators import cube
    from cellgrid.plans import catalogue as c

    took: dict[str, float] = {}

    def timed(name: str, run, runs: int = RUNS) -> None:
        times = []
        for _ in range(runs):
            began = time.perf_counter()
            run()
            times.append(time.perf_counter() - began)
        took[name] = round(statistics.median(times), 4)

    read = lambda name: c.read(spark, sf_dir, name)
    raw = {name: read(name).cache() for name in ("events", "orders", "customer", "nation")}
    for r in raw.values():
        r.count()
    priced = raw["orders"].withColumn("thousands", F.col("o_totalprice") / 1000)
    cubes = {}
    for spec, rows in ((c.EVENTS, raw["events"]), (c.ORDERS, raw["orders"]), (c.ORDERS_3D, priced), (c.CUSTOMERS, raw["customer"]), (c.EVENT_USERS, raw["events"])):
        timed(f"build_{spec.name}", lambda spec=spec, rows=rows: cube.write(cube.build(rows, spec), spec, f"{scratch}/{spec.name}"), 1)
        # queries by cardinality never touch the bitmaps, so these are left out of what is kept
        stored = cube.read(spark, f"{scratch}/{spec.name}")
        cubes[spec.name] = cube.counts(stored, spec, f"{scratch}/{spec.name}_counts") if spec.disjoint else stored.coalesce(1).cache()
        cubes[spec.name].count()
    year = F.year("day").alias("year")
    zones = raw["nation"].filter("n_regionkey in (0, 1, 2)").select("n_nationkey", "n_name")
    three = F.sum(bitmaps.CARDINALITY).alias("cnt")
    n = F.count("*").alias("cnt")
    picked = raw["nation"].filter("n_name = 'NATION_3'").select("n_nationkey")
    queries = {
        "b1q1_count_by_type": (cubes[c.EVENTS.name].groupBy("event_type").agg(three), raw["events"].groupBy("event_type").agg(n)),
        "b1q2_avg_by_type": (raw["events"].groupBy("event_type").agg(F.avg("value")), None),
        "b1q3_count_2d_year": (cubes[c.ORDERS.name].groupBy("o_orderstatus", year).agg(three), raw["orders"].groupBy("o_orderstatus", F.year("o_orderdate")).agg(n)),
        "b1q4_count_3d_round": (cubes[c.ORDERS_3D.name].groupBy("o_orderpriority", year, "price").agg(three), priced.groupBy("o_orderpriority", F.year("o_orderdate"), F.round("thousands")).agg(n)),
        "b2q4_count_left_join": (
            cubes[c.CUSTOMERS.name].join(F.broadcast(zones), F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name").agg(three),
            raw["customer"].join(F.broadcast(zones), F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name").agg(n),
        ),
        "b2q5_count_in_subquery": (
            cubes[c.CUSTOMERS.name].join(picked, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").agg(three),
            raw["customer"].join(picked, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").agg(n),
        ),
        "distinct_union": (
            bitmaps.cardinality(bitmaps.union(cubes[c.EVENT_USERS.name], ["event_type"]), ["event_type"]),
            raw["events"].groupBy("event_type").agg(F.countDistinct("user_id")),
        ),
    }
    # the same questions to a hundred times the rows: the cube's cells don't grow with them
    many = raw["events"].crossJoin(spark.range(100).withColumnRenamed("id", "copy")).select((F.col("event_id") + F.col("copy") * 1_000_000).alias("event_id"), "ts", "event_type", "value")  # made-up rows, for the bench alone
    many = many.repartition(int(cpus)).cache()
    many.count()
    timed("build_events_by_type_x100", lambda: cube.write(cube.build(many, c.EVENTS), c.EVENTS, f"{scratch}/x100"), 1)
    small = cube.counts(cube.read(spark, f"{scratch}/x100"), c.EVENTS, f"{scratch}/x100_counts")
    small.count()
    between = F.col("day").between("2024-01-05", "2024-01-14")
    larger = {
        "count_by_type_x100": (small.groupBy("event_type").agg(three), many.groupBy("event_type").agg(n)),
        "count_by_type_of_days_x100": (small.filter(between).groupBy("event_type").agg(three), many.withColumn("day", F.to_date("ts")).filter(between).groupBy("event_type").agg(n)),
        "count_distinct_x100": (small.groupBy("event_type").agg(three), many.groupBy("event_type").agg(F.countDistinct("event_id"))),
    }
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # tables in memory: nothing to adapt to
    for name, (fast, slow) in (queries | larger).items():
        # a query and its raw twin take turns, so that neither runs in a warmer engine than the other
        pair = {name: fast} | ({f"{name}_raw": slow} if slow is not None else {})
        times: dict[str, list[float]] = {q: [] for q in pair}
        for turn in range(WARM + RUNS):
            for q, df in pair.items():
                began = time.perf_counter()
                df.collect()
                if turn >= WARM:
                    times[q].append(time.perf_counter() - began)
        took.update({q: round(statistics.median(t), 4) for q, t in times.items()})
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    many.unpersist()
    try:
        from cellgrid.llm import queries as llm
    except ImportError:
        llm = None
    if llm:
        for name, query in llm.QUERIES.items():
            timed(name, lambda query=query: query(spark, sf_dir).write.format("noop").mode("overwrite").save(), 1)
    total = round(sum(took[q] for q in queries), 4)
    spark.stop()
    shutil.rmtree(scratch, ignore_errors=True)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": took, "sf": Path(sf_dir).name}))


if __name__ == "__main__":
    main()
