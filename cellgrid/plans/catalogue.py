"""The queries of the engine over a folder of tables, each with SQL that a plain database answers alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bitmaps, roaring
from ..functions.transforms import transform
from ..operators import cube, ids, ingest, validation
from ..session import scratch
from ..sources import files, sinks
from . import router
from .specs import AddColumn, CubeSpec, Dim, Fact, StandardColumn, Variant

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

EVENTS = CubeSpec("events_by_type", (Dim("ts", "extract_date", "day"), Dim("event_type")), "event_id", "day")
EVENT_USERS = CubeSpec("users_by_type", (Dim("ts", "extract_date", "day"), Dim("event_type")), "user_id", "day", disjoint=False)
EVENT_HOURS = CubeSpec("events_by_hour", (Dim("ts", "extract_date", "day"), Dim("ts", "extract_hour", "hour")), "event_id", "day")
ORDERS = CubeSpec("orders_by_status", (Dim("o_orderdate", "extract_date", "day"), Dim("o_orderstatus")), "o_orderkey", "day")
ORDERS_3D = CubeSpec("orders_by_priority_price", (Dim("o_orderdate", "extract_date", "day"), Dim("o_orderpriority"), Dim("thousands", "round", "price")), "o_orderkey", "day")
CUSTOMERS = CubeSpec("customers_by_nation", (Dim("c_nationkey"),), "c_custkey", keep_null_dims=True)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return keep


def events_cube(spark, d, spec=EVENTS) -> DataFrame:
    return cube.build(read(spark, d, "events"), spec)


def priced_orders(spark, d) -> DataFrame:
    return read(spark, d, "orders").withColumn("thousands", F.col("o_totalprice") / 1000)


def long(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


# counts from cubes


@query("SELECT event_type, COUNT(*) AS cnt FROM events GROUP BY event_type")
def cube_count_by_dim(spark, d):
    return cube.rollup(events_cube(spark, d), ["event_type"], EVENTS.disjoint)


@query("SELECT event_type, COUNT(*) AS cnt FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-14' GROUP BY event_type")
def cube_count_date_between(spark, d):
    own = events_cube(spark, d).filter(F.col("day").cast("string").between("2024-01-05", "2024-01-14"))
    return own.groupBy("event_type").agg(F.sum("cardinality").alias("cnt"))


@query("SELECT event_type, COUNT(*) AS cnt FROM events GROUP BY event_type")
def cube_count_by_dim_bitmap(spark, d):
    return events_cube(spark, d).groupBy("event_type").agg(F.sum(bitmaps.count("bitmap")).alias("cnt"))


@query("SELECT COUNT(*) AS cnt FROM events WHERE event_type = 'click'")
def cube_count_global(spark, d):
    return events_cube(spark, d).filter(F.col("event_type") == "click").agg(F.coalesce(F.sum("cardinality"), F.lit(0)).alias("cnt"))


@query("SELECT o_orderstatus, CAST(YEAR(o_orderdate) AS BIGINT) AS year, COUNT(*) AS cnt FROM orders GROUP BY ALL")
def cube_count_2d_year(spark, d):
    own = cube.build(read(spark, d, "orders"), ORDERS)
    return own.groupBy("o_orderstatus", long(F.left(F.col("day").cast("string"), F.lit(4))).alias("year")).agg(F.sum("cardinality").alias("cnt"))


@query("SELECT o_orderpriority, CAST(YEAR(o_orderdate) AS BIGINT) AS year, CAST(ROUND(o_totalprice / 1000) AS BIGINT) AS price, COUNT(*) AS cnt FROM orders GROUP BY ALL")
def cube_count_3d_round(spark, d):
    own = cube.build(priced_orders(spark, d), ORDERS_3D)
    return own.groupBy("o_orderpriority", long(F.year("day")).alias("year"), "price").agg(F.sum("cardinality").alias("cnt"))


@query("SELECT o_orderpriority, CAST(YEAR(o_orderdate) AS BIGINT) AS year, CAST(ROUND(o_totalprice / 1000) AS BIGINT) AS price, COUNT(*) AS cnt FROM orders GROUP BY ALL")
def cube_count_3d_round_bitmap(spark, d):
    own = cube.build(priced_orders(spark, d), ORDERS_3D)
    return own.groupBy("o_orderpriority", long(F.year("day")).alias("year"), "price").agg(F.sum(bitmaps.count("bitmap")).alias("cnt"))


@query("SELECT CAST(EXTRACT(hour FROM ts) AS BIGINT) AS hour, COUNT(*) AS cnt FROM events GROUP BY ALL")
def cube_count_by_hour(spark, d):
    return events_cube(spark, d, EVENT_HOURS).groupBy(long("hour").alias("hour")).agg(F.sum("cardinality").alias("cnt"))


# joins


_SOME = "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (0, 1, 2)"


@query(f"SELECT n_name, COUNT(*) AS cnt FROM customer LEFT JOIN ({_SOME}) n ON c_nationkey = n_nationkey GROUP BY n_name")
def cube_left_join_dim(spark, d):
    own = cube.build(read(spark, d, "customer"), CUSTOMERS).groupBy("c_nationkey").agg(F.sum("cardinality").alias("cnt"))
    some = read(spark, d, "nation").filter("n_regionkey in (0, 1, 2)").select("n_nationkey", "n_name")
    return own.join(some, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name").agg(F.sum("cnt").alias("cnt"))


@query(f"SELECT n_name, COUNT(*) AS cnt FROM customer LEFT JOIN ({_SOME}) n ON c_nationkey = n_nationkey GROUP BY n_name")
def facts_left_join_dim(spark, d):
    some = read(spark, d, "nation").filter("n_regionkey in (0, 1, 2)").select("n_nationkey", "n_name")
    return read(spark, d, "customer").join(some, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name").agg(F.count("*").alias("cnt"))


@query("SELECT COUNT(*) AS cnt FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_name = 'NATION_3')")
def cube_in_subquery(spark, d):
    own, nations = cube.build(read(spark, d, "customer"), CUSTOMERS), read(spark, d, "nation")
    text = "SELECT coalesce(SUM(cardinality), 0) AS cnt FROM {cube} WHERE c_nationkey IN (SELECT n_nationkey FROM {nations} WHERE n_name = 'NATION_3')"
    return spark.sql(text, cube=own, nations=nations)  # no views, so queries over two folders don't meet


# sets


@query("SELECT event_type, COUNT(DISTINCT user_id) AS cnt FROM events GROUP BY event_type")
def cube_distinct_union(spark, d):
    return cube.rollup(events_cube(spark, d, EVENT_USERS), ["event_type"], EVENT_USERS.disjoint)


@query("SELECT l_returnflag, COUNT(DISTINCT l_orderkey) AS cnt FROM lineitem GROUP BY l_returnflag")
def cube_distinct_union_lineitem(spark, d):
    spec = CubeSpec("orders_by_flag", (Dim("l_shipdate", "extract_year", "year"), Dim("l_returnflag")), "l_orderkey", disjoint=False)
    return cube.rollup(cube.build(read(spark, d, "lineitem"), spec), ["l_returnflag"], spec.disjoint)


_VIEWED, _BOUGHT = "SELECT DISTINCT user_id FROM events WHERE event_type = 'view'", "SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase'"


@query(f"SELECT COUNT(*) AS cnt FROM ({_VIEWED} INTERSECT {_BOUGHT})")
def bitmap_intersect_count(spark, d):
    own = events_cube(spark, d, EVENT_USERS).filter(F.col("event_type").isin("view", "purchase"))
    return bitmaps.intersect(own, [], "event_type", 2).agg(F.coalesce(F.sum(bitmaps.count("bitmap")), F.lit(0)).alias("cnt"))


@query("SELECT COUNT(DISTINCT user_id) AS cnt FROM events WHERE event_type IN ('view', 'purchase')")
def bitmap_union_count(spark, d):
    own = events_cube(spark, d, EVENT_USERS).filter(F.col("event_type").isin("view", "purchase"))
    return bitmaps.union(own, []).agg(F.coalesce(F.sum(bitmaps.count("bitmap")), F.lit(0)).alias("cnt"))


def _joined(c: str | F.Column) -> F.Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def _user_ids(spark, d) -> DataFrame:
    return bitmaps.to_array(bitmaps.union(events_cube(spark, d, EVENT_USERS), ["event_type"]), ["event_type"])


@query("SELECT event_type, string_agg(u, ',' ORDER BY u) AS ids FROM (SELECT DISTINCT event_type, user_id AS u FROM events) GROUP BY event_type")
def bitmap_to_array(spark, d):
    return _user_ids(spark, d).select("event_type", _joined("ids").alias("ids"))


@query("SELECT event_type, array_to_string(list_sort(list(DISTINCT user_id))[11:15], ',') AS ids FROM events GROUP BY event_type")
def bitmap_chunk(spark, d):
    return _user_ids(spark, d).select("event_type", _joined(bitmaps.chunk("ids", 10, 5)).alias("ids"))


@query("SELECT CAST(ts AS DATE) AS day, event_type, BOOL_OR(user_id = 7) AS has FROM events GROUP BY ALL HAVING BOOL_OR(user_id = 7)")
def bitmap_contains(spark, d):
    return bitmaps.containing(events_cube(spark, d, EVENT_USERS), 7).select("day", "event_type", F.lit(True).alias("has"))


@query("SELECT event_type, COUNT(DISTINCT user_id) AS cnt FROM events GROUP BY event_type")
def roaring_union_list(spark, d):
    cells = read(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(roaring.rb_build(F.array_sort(F.collect_set("user_id"))).alias("blob"))
    return cells.groupBy("event_type").agg(F.collect_list("blob").alias("blobs")).select("event_type", roaring.rb_count(roaring.rb_union_list("blobs")).alias("cnt"))


@query("""WITH a AS (SELECT event_type, list(DISTINCT user_id) AS u FROM events GROUP BY event_type)
    SELECT x.event_type AS a, y.event_type AS b, CAST(len(list_intersect(x.u, y.u)) AS BIGINT) AS n_and, CAST(len(list_distinct(list_concat(x.u, y.u))) AS BIGINT) AS n_or FROM a x JOIN a y ON x.event_type < y.event_type""")
def roaring_and_or(spark, d):
    blobs = read(spark, d, "events").groupBy("event_type").agg(roaring.rb_build(F.collect_set("user_id")).alias("blob"))
    pairs = blobs.select(F.col("event_type").alias("a"), F.col("blob").alias("x")).join(blobs.select(F.col("event_type").alias("b"), F.col("blob").alias("y")), F.col("a") < F.col("b"))  # a row for each event type
    return pairs.select("a", "b", roaring.rb_count(roaring.rb_and("x", "y")).alias("n_and"), roaring.rb_count(roaring.rb_or("x", "y")).alias("n_or"))


def _blobs(spark, d, entity="user_id") -> DataFrame:
    return read(spark, d, "events").groupBy("event_type").agg(roaring.rb_build(F.collect_set(entity)).alias("blob"))


@query("SELECT event_type, string_agg(u, ',' ORDER BY u) AS ids FROM (SELECT DISTINCT event_type, user_id AS u FROM events) GROUP BY event_type")
def roaring_to_array(spark, d):
    return _blobs(spark, d).select("event_type", _joined(roaring.rb_to_array("blob")).alias("ids"))


@query("SELECT event_type, array_to_string(list_sort(list(DISTINCT user_id))[11:15], ',') AS ids, array_to_string(list_sort(list(DISTINCT user_id))[1:1], ',') AS first FROM events GROUP BY event_type")
def roaring_chunk(spark, d):
    page = lambda start, size: _joined(roaring.rb_chunk("blob", F.lit(start), F.lit(size)))
    return _blobs(spark, d).select("event_type", page(10, 5).alias("ids"), page(-3, 0).alias("first"))


@query("SELECT event_type, BOOL_OR(user_id = 7) AS has, FALSE AS has_none FROM events GROUP BY event_type")
def roaring_contains(spark, d):
    return _blobs(spark, d).select("event_type", roaring.rb_contains("blob", F.lit(7)).alias("has"), roaring.rb_contains("blob", F.lit(10**9)).alias("has_none"))


@query("SELECT event_type, COUNT(DISTINCT user_id) AS n_stored, COUNT(DISTINCT user_id) AS n_hash, COUNT(DISTINCT user_id) AS n_no_hash, 0::BIGINT AS n_null FROM events GROUP BY event_type")
def roaring_count_precomputed(spark, d):
    rows = _blobs(spark, d).withColumn("h", roaring.rb_hash("blob")).withColumn("n", roaring.rb_count("blob"))
    none = F.lit(None).cast("bigint")
    counts = roaring.rb_count_precomputed("blob", "h", "n").alias("n_stored"), roaring.rb_count_hash("blob", "h").alias("n_hash"), roaring.rb_count_hash("blob", none).alias("n_no_hash")
    return rows.select("event_type", *counts, roaring.rb_count_precomputed("blob", "h", none).alias("n_null"))


@query("""WITH a AS (SELECT event_type, list(DISTINCT user_id) AS u FROM events GROUP BY event_type)
    SELECT x.event_type AS a, CAST(len(list_intersect(x.u, y.u)) AS BIGINT) AS n_and, CAST(len(list_distinct(list_concat(x.u, y.u))) AS BIGINT) AS n_or FROM a x, a y WHERE y.event_type = 'click'""")
def roaring_and_or_precomputed(spark, d):
    rows = _blobs(spark, d).withColumn("h", roaring.rb_hash("blob"))
    one = rows.filter("event_type = 'click'").select(F.col("blob").alias("y"), F.col("h").alias("hy"))
    pairs = rows.crossJoin(F.broadcast(one))  # one row
    return pairs.select(F.col("event_type").alias("a"), roaring.rb_count(roaring.rb_and_precomputed("blob", "h", "y", "hy")).alias("n_and"), roaring.rb_count(roaring.rb_or_precomputed("blob", "h", "y", "hy")).alias("n_or"))


@query("SELECT event_type, COUNT(*) AS cnt FROM events GROUP BY event_type")
def cube_count_by_hash(spark, d):
    """Counts looked up by the hash of the bitmap, in a table of the counts that are known."""
    own = events_cube(spark, d)
    known = cube.counts_by_hash([own.filter("event_type <> 'click'")])  # the others are counted
    return cube.with_counts(own.select("event_type", "bitmap", "bitmap_hash"), known).groupBy("event_type").agg(F.sum("cnt").alias("cnt"))


@query("SELECT event_type, COUNT(DISTINCT user_id) AS cnt FROM events GROUP BY event_type")
def cube_from_blobs(spark, d):
    """Cells by day as portable blobs, read back and rolled up."""
    blobs = cube.to_blobs(events_cube(spark, d, EVENT_USERS), ["day", "event_type"])
    return cube.rollup(cube.from_blobs(blobs, ["day", "event_type"]), ["event_type"], disjoint=False)


@query()
def bitmap_hash(spark, d):
    blobs = read(spark, d, "events").groupBy("event_type").agg(roaring.rb_build(F.collect_set("event_id")).alias("blob"))
    return blobs.select("event_type", roaring.rb_hash("blob").alias("bitmap_hash"))


# nulls


_NULLED = CubeSpec("nulled", (Dim("ts", "extract_date", "day"), Dim("kind")), "event_id", "day")


def _nulled(spark, d) -> DataFrame:
    return read(spark, d, "events").withColumn("kind", F.nullif("event_type", F.lit("click")))


@query("SELECT nullif(event_type, 'click') AS kind, COUNT(*) AS cnt FROM events WHERE event_type <> 'click' GROUP BY 1")
def cube_null_dropped(spark, d):
    return cube.build(_nulled(spark, d), _NULLED).groupBy("kind").agg(F.sum("cardinality").alias("cnt"))


@query("SELECT nullif(event_type, 'click') AS kind, COUNT(*) AS cnt FROM events GROUP BY 1")
def cube_null_kept(spark, d):
    spec = CubeSpec("nulled", _NULLED.dims, "event_id", "day", keep_null_dims=True)
    return cube.build(_nulled(spark, d), spec).groupBy("kind").agg(F.sum("cardinality").alias("cnt"))


@query("SELECT CAST(NULL AS VARCHAR) AS absent, COUNT(*) AS cnt FROM events")
def cube_missing_dim_kept(spark, d):
    spec = CubeSpec("absent", (Dim("absent"),), "event_id", keep_null_dims=True)
    return cube.build(read(spark, d, "events"), spec).groupBy("absent").agg(F.sum("cardinality").alias("cnt"))


@query("SELECT COUNT(*) AS cnt, COUNT(DISTINCT event_type) AS n_types FROM events WHERE event_id % 7 <> 0")
def cube_null_ids_dropped(spark, d):
    rows = read(spark, d, "events").withColumn("event_id", F.when(F.col("event_id") % 7 != 0, F.col("event_id")))
    return cube.build(rows, EVENTS).agg(F.sum("cardinality").alias("cnt"), F.countDistinct("event_type").alias("n_types"))


@query("SELECT COUNT(*) AS cnt FROM events WHERE event_id % 5 <> 0")
def cube_null_date_dropped(spark, d):
    spec = CubeSpec("dated", EVENTS.dims, "event_id", "day", keep_null_dims=True)
    rows = read(spark, d, "events").withColumn("ts", F.when(F.col("event_id") % 5 != 0, F.col("ts")))
    return cube.build(rows, spec).agg(F.sum("cardinality").alias("cnt"))


# facts


@query("SELECT event_type, ROUND(AVG(value), 4) AS avg_value FROM events GROUP BY event_type")
def facts_avg_by_dim(spark, d):
    own = ingest.facts(read(spark, d, "events").withColumnRenamed("event_id", "entity_id"), "entity_id", (Fact("event_type", "STRING"), Fact("value", "FLOAT64")))
    return own.groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("avg_value"))


@query("SELECT l_quantity, ROUND(AVG(l_extendedprice), 2) AS avg_price FROM lineitem GROUP BY l_quantity")
def facts_avg_by_number(spark, d):
    return read(spark, d, "lineitem").groupBy("l_quantity").agg(F.round(F.avg("l_extendedprice"), 2).alias("avg_price"))


@query("SELECT CAST(YEAR(o_orderdate) AS BIGINT) AS year, o_orderstatus, COUNT(*) AS cnt FROM orders GROUP BY ALL ORDER BY year, cnt DESC")
def facts_ordered_counts(spark, d):
    return read(spark, d, "orders").groupBy(long(F.year("o_orderdate")).alias("year"), "o_orderstatus").agg(F.count("*").alias("cnt")).orderBy(F.asc_nulls_last("year"), F.desc_nulls_last("cnt"))


@query("SELECT n_name, COUNT(*) AS cnt FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY cnt DESC, n_name LIMIT 5")
def cube_top_dims(spark, d):
    own = cube.build(read(spark, d, "customer"), CUSTOMERS).join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return own.groupBy("n_name").agg(F.sum("cardinality").alias("cnt")).orderBy(F.desc("cnt"), "n_name").limit(5)


@query("SELECT COUNT(*) AS n, CAST(SUM(entity_id) AS BIGINT) AS ids, 0::BIGINT AS out_of_order FROM (SELECT event_id AS entity_id FROM events)")
def facts_sorted_by_id(spark, d):
    """The facts as they are stored: sorted by id in each file."""
    path = scratch(spark, "queries")
    sinks.facts(ingest.facts(read(spark, d, "events").withColumnRenamed("event_id", "entity_id"), "entity_id", (Fact("value", "FLOAT64"),)), path)
    rows = spark.read.parquet(path).select("entity_id", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    before = F.lag("entity_id").over(Window.partitionBy("file").orderBy("row"))
    ordered = rows.withColumn("late", before > F.col("entity_id"))
    return ordered.agg(F.count("*").alias("n"), F.sum("entity_id").alias("ids"), F.count_if("late").alias("out_of_order"))


@query("SELECT COUNT(*) AS n, COUNT(value) AS n_value, COUNT(user_id) AS n_user FROM (SELECT CASE WHEN event_id % 2 = 0 THEN value END AS value, CASE WHEN event_id % 2 = 1 THEN user_id END AS user_id FROM events)")
def scan_by_name(spark, d):
    """Files of two layouts, scanned as one table by the names of their columns."""
    path, rows = scratch(spark, "queries"), read(spark, d, "events")
    rows.filter("event_id % 2 = 0").select("event_id", "value").write.parquet(f"{path}/a")
    rows.filter("event_id % 2 = 1").select("user_id", "event_id").write.parquet(f"{path}/b")
    both = files.scan(spark, f"{path}/a", f"{path}/b", by_name=True)
    return both.agg(F.count("*").alias("n"), F.count("value").alias("n_value"), F.count("user_id").alias("n_user"))


# transforms


def _transform_query(name: str, column: str, table: str, sql: str, kind: str | None = "bigint") -> None:
    def run(spark, d):
        value = transform(name, column)
        return read(spark, d, table).groupBy((value.cast(kind) if kind else value).alias("v")).agg(F.count("*").alias("cnt"))

    query(f"SELECT {sql} AS v, COUNT(*) AS cnt FROM {table} GROUP BY 1", f"transform_{name}")(run)


for _args in (
    ("none", "event_type", "events", "event_type", None),
    ("round", "o_totalprice", "orders", "CAST(trunc(o_totalprice + 0.5) AS BIGINT)"),
    ("round_1dp", "value", "events", "round_even(value * 10, 0) / 10", None),
    ("floor", "value", "events", "CAST(floor(value) AS BIGINT)"),
    ("ceiling", "value", "events", "CAST(ceil(value) AS BIGINT)"),
    ("extract_date", "ts", "events", "CAST(ts AS DATE)", None),
    ("extract_hour", "ts", "events", "CAST(hour(ts) AS BIGINT)"),
    ("extract_dow", "ts", "events", "dayname(ts)", None),
    ("extract_year", "o_orderdate", "orders", "CAST(year(o_orderdate) AS BIGINT)"),
    ("extract_month", "o_orderdate", "orders", "CAST(month(o_orderdate) AS BIGINT)"),
):
    _transform_query(*_args)


# ingest and validation


_RULES = (
    validation.Rule("null_status", ("l_linestatus",), lambda c: c.isNull()),
    validation.Rule("invalid_quantity", ("l_quantity",), lambda c: ~c.between(0, 45)),
    validation.Rule("margin_negative", ("margin",), lambda c: c < 0),
    validation.Rule("flag_blank", ("flag",), validation._blank),
    validation.Rule("absent_negative", ("absent",), lambda c: c < 0),
)
_LINES = "SELECT *, l_extendedprice * (1 - l_discount) - 20000 AS margin, CASE WHEN l_returnflag = 'A' THEN '  ' ELSE l_returnflag END AS flag FROM lineitem"
_REASON = "(CASE WHEN l_linestatus IS NULL THEN 'null_status|' ELSE '' END || CASE WHEN NOT (l_quantity BETWEEN 0 AND 45) THEN 'invalid_quantity|' ELSE '' END || CASE WHEN margin < 0 THEN 'margin_negative|' ELSE '' END || CASE WHEN trim(flag) = '' THEN 'flag_blank|' ELSE '' END)"


def _lines(spark, d) -> DataFrame:
    flag = F.when(F.col("l_returnflag") == "A", "  ").otherwise(F.col("l_returnflag"))
    return read(spark, d, "lineitem").withColumn("margin", F.col("l_extendedprice") * (1 - F.col("l_discount")) - 20000).withColumn("flag", flag)


@query(f"WITH l AS ({_LINES}) SELECT {_REASON} AS dirty_reason, COUNT(*) AS cnt FROM l GROUP BY 1")
def dirty_reasons(spark, d):
    rows = _lines(spark, d)
    return rows.groupBy(validation.reasons(rows.columns, _RULES).alias("dirty_reason")).agg(F.count("*").alias("cnt"))


@query(f"WITH l AS ({_LINES}) SELECT r AS reason, COUNT(*) AS n FROM (SELECT unnest(string_split({_REASON}, '|')) AS r FROM l) WHERE r <> '' GROUP BY r")
def dirty_reason_counts(spark, d):
    return validation.reason_counts(_lines(spark, d), _RULES)


@query(f"WITH l AS ({_LINES}), m AS (SELECT {_REASON} AS r FROM l) SELECT COUNT(*) AS rows_in, COUNT(*) FILTER (r = '') AS clean, COUNT(*) FILTER (r <> '') AS dirty, ROUND(100.0 * COUNT(*) FILTER (r <> '') / COUNT(*), 2) AS dirty_pct FROM m")
def clean_split_stats(spark, d):
    return validation.split_stats(_lines(spark, d), _RULES)


@query(f"WITH l AS ({_LINES}) SELECT l_returnflag, COUNT(*) AS cnt, CAST(SUM(l_quantity) AS BIGINT) AS quantity FROM l WHERE {_REASON} = '' GROUP BY ALL")
def clean_split(spark, d):
    clean, _ = validation.split(_lines(spark, d), _RULES)
    return clean.groupBy("l_returnflag").agg(F.count("*").alias("cnt"), long(F.sum("l_quantity")).alias("quantity"))


# a row that breaks a rule of a taxi trip in each of 17 ways, by its number
_TRIPS = """SELECT CASE WHEN event_id % 17 <> 0 THEN ts END AS pickup_datetime, CASE WHEN event_id % 19 <> 0 THEN ts + INTERVAL 600 SECOND * (CASE WHEN event_id % 23 = 0 THEN -1 ELSE 1 END) END AS dropoff_datetime,
    CAST(CASE WHEN event_id % 29 = 0 THEN -1 WHEN event_id % 31 = 0 THEN 21 WHEN event_id % 37 = 0 THEN NULL ELSE event_id % 21 END AS BIGINT) AS passenger_count,
    CASE WHEN event_id % 41 = 0 THEN -value ELSE value END AS trip_distance, value - 3 AS fare_amount, value - 2 AS total_amount, CASE WHEN event_id % 43 = 0 THEN -0.5 ELSE value END AS tip_amount,
    CASE WHEN event_id % 47 = 0 THEN -0.5 END AS tolls_amount, CASE WHEN event_id % 53 = 0 THEN -0.5 ELSE 0.5 END AS mta_tax, CASE WHEN event_id % 59 = 0 THEN -1.0 ELSE 0.0 END AS extra,
    CASE WHEN event_id % 61 = 0 THEN -1.0 ELSE 2.5 END AS congestion_surcharge, CASE WHEN event_id % 67 = 0 THEN -1.25 ELSE 0.0 END AS airport_fee, CASE WHEN event_id % 71 <> 0 THEN user_id END AS "PULocationID",
    CASE WHEN event_id % 73 <> 0 THEN user_id END AS "DOLocationID", CASE WHEN event_id % 79 = 0 THEN '  ' WHEN event_id % 83 <> 0 THEN event_type END AS cab_type, CASE WHEN event_id % 89 = 0 THEN '' ELSE 'V' END AS "VendorID" FROM events"""
_BROKEN = (
    ("null_pickup_datetime", "pickup_datetime IS NULL"), ("null_dropoff_datetime", "dropoff_datetime IS NULL"), ("dropoff_before_pickup", "pickup_datetime > dropoff_datetime"),
    ("invalid_passenger_count", "passenger_count < 0 OR passenger_count > 20"), ("distance_negative", "trip_distance < 0"), ("fare_negative", "fare_amount < 0"), ("total_negative", "total_amount < 0"),
    ("tip_negative", "tip_amount < 0"), ("tolls_negative", "tolls_amount < 0"), ("mta_tax_negative", "mta_tax < 0"), ("extra_negative", "extra < 0"), ("congestion_surcharge_negative", "congestion_surcharge < 0"),
    ("airport_fee_negative", "airport_fee < 0"), ("null_PULocationID", '"PULocationID" IS NULL'), ("null_DOLocationID", '"DOLocationID" IS NULL'), ("null_cab_type", "cab_type IS NULL OR trim(cab_type) = ''"),
    ("null_VendorID", "\"VendorID\" IS NULL OR trim(\"VendorID\") = ''"),
)
_TRIP_REASON = " || ".join(f"CASE WHEN {broken} THEN '{label}|' ELSE '' END" for label, broken in _BROKEN)


def _made_up_trips(spark, d) -> DataFrame:
    return spark.sql(_TRIPS.replace('"', "`").replace("FROM events", "FROM {events}"), events=read(spark, d, "events"))


@query(f"WITH t AS ({_TRIPS}) SELECT r AS reason, COUNT(*) AS n FROM (SELECT unnest(string_split({_TRIP_REASON}, '|')) AS r FROM t) WHERE r <> '' GROUP BY r")
def trip_reason_counts(spark, d):
    """All 17 rules of a taxi trip."""
    return validation.reason_counts(_made_up_trips(spark, d))


@query(f"WITH t AS ({_TRIPS}) SELECT {_TRIP_REASON} AS dirty_reason, COUNT(*) AS cnt FROM t GROUP BY 1")
def trip_reasons(spark, d):
    rows = _made_up_trips(spark, d)
    return rows.groupBy(validation.reasons(rows.columns).alias("dirty_reason")).agg(F.count("*").alias("cnt"))


def _map_query(name: str, column: str, words: dict[str, int | None]) -> None:
    """A value map over words in any case and with white space at the ends; those it lacks stay, as numbers where they are."""
    cases = " ".join(f"WHEN {i} THEN {'NULL' if code is None else code}" for i, code in enumerate(words.values()))

    def run(spark, d):
        word = F.element_at(F.array(*map(F.lit, words)), (F.col("event_id") % len(words) + 1).cast("int"))
        rows = read(spark, d, "events").select(F.concat(F.lit(" "), F.when(F.col("event_id") % 2 == 0, F.upper(word)).otherwise(word), F.lit("\t")).alias(column))
        made = ingest.standardised(rows, tuple(c for c in ingest.TRIP_COLUMNS if c.name == column))
        return made.groupBy(F.col(column).alias("code")).agg(F.count("*").alias("cnt"))

    query(f"SELECT CAST(CASE event_id % {len(words)} {cases} END AS BIGINT) AS code, COUNT(*) AS cnt FROM events GROUP BY 1", name)(run)


# what the words stand for, stated on its own
_map_query("rate_code_map", "RatecodeID", {"Standard rate": 1, "JFK": 2, "newark": 3, "Nassau or Westchester": 4, "negotiated fare": 5, "Group ride": 6, "1": 1, "6": 6, "99": 99, "2.0": 2, "other": None})
_map_query("payment_type_map", "payment_type", {
    "Credit card": 1, "cre": 1, "CRD": 1, "cash": 2, "Cas": 2, "no charge": 3, "No": 3, "noc": 3, "Dispute": 4, "dis": 4, "Unknown": 5, "unk": 5, "voided trip": 6, "Voided": 6, "3": 3, "5": 5, "0": 0, "what": None,
})


@query("SELECT '2015' AS year, '03' AS month, 'green' AS kind, COUNT(*) AS cnt FROM part")
def columns_by_regex(spark, d):
    name = F.lit("green_tripdata_2015-03.parquet")
    added = (AddColumn("year", regex=r"(\d{4})-\d{2}"), AddColumn("month", regex=r"\d{4}-(\d{2})"), AddColumn("kind", (("yellow", "yellow"), ("green", "green"))))
    return ingest.add_columns(read(spark, d, "part"), added, name).groupBy("year", "month", "kind").agg(F.count("*").alias("cnt"))


_PRIORITIES = (("1-urgent", 1), ("2-high", 2), ("3-medium", 3), ("4-not specified", 4))


@query("""SELECT CASE lower(trim(o_orderpriority)) WHEN '1-urgent' THEN 1 WHEN '2-high' THEN 2 WHEN '3-medium' THEN 3 WHEN '4-not specified' THEN 4 ELSE TRY_CAST(TRY_CAST(o_orderpriority AS DOUBLE) AS BIGINT) END::BIGINT AS code,
    COUNT(*) AS cnt FROM orders GROUP BY 1""")
def value_map(spark, d):
    rows = read(spark, d, "orders").withColumn("o_orderpriority", F.concat(F.lit(" \t"), F.upper("o_orderpriority"), F.lit(" ")))
    rows = ingest.standardised(rows, (StandardColumn("o_orderpriority", "INT64", _PRIORITIES),))
    return rows.groupBy(F.col("o_orderpriority").alias("code")).agg(F.count("*").alias("cnt"))


@query("""SELECT CAST(TRY_CAST(s AS DOUBLE) AS BIGINT) AS v, COUNT(*) AS cnt FROM (SELECT CASE WHEN event_id % 3 = 0 THEN CAST(user_id AS VARCHAR) || '.0' WHEN event_id % 3 = 1 THEN CAST(user_id AS VARCHAR) ELSE event_type END AS s FROM events) GROUP BY 1""")
def coerce_cast(spark, d):
    text = F.col("user_id").cast("string")
    s = F.when(F.col("event_id") % 3 == 0, F.concat(text, F.lit(".0"))).when(F.col("event_id") % 3 == 1, text).otherwise(F.col("event_type"))
    return read(spark, d, "events").groupBy(ingest.coerced(s, "INT64").alias("v")).agg(F.count("*").alias("cnt"))


@query("SELECT layout, COUNT(*) AS cnt, COUNT(fare_amount) AS n_fare FROM (SELECT CASE WHEN event_id % 2 = 0 THEN 'old' ELSE 'new' END AS layout, CASE WHEN event_id % 2 = 0 THEN value END AS fare_amount FROM events) GROUP BY layout")
def schema_variant_union(spark, d):
    rows = read(spark, d, "events")
    old = ingest.standard_names(rows.filter("event_id % 2 = 0").select(F.col("ts").alias("Trip_Pickup_DateTime"), F.col("value").alias("Fare_Amt"), F.lit("old").alias("layout")))
    new = ingest.standard_names(rows.filter("event_id % 2 = 1").select(F.col("ts").alias("tpep_pickup_datetime"), F.lit("new").alias("layout")))
    return ingest.union_of_layouts([old, new]).groupBy("layout").agg(F.count("pickup_datetime").alias("cnt"), F.count("fare_amount").alias("n_fare"))


@query("SELECT 'part' AS kind, COUNT(*) AS cnt FROM part")
def column_from_file_name(spark, d):
    rows = ingest.add_columns(read(spark, d, "part"), (AddColumn("kind", (("line", "lineitem"), ("part", "part"))),))
    return rows.groupBy("kind").agg(F.count("*").alias("cnt"))


@query("SELECT 'part_' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS id FROM part")
def templated_string_id(spark, d):
    rows = read(spark, d, "part").withColumn("kind", F.lit("part"))
    return rows.select(ingest.string_id("{kind}_{rownum:08d}", rownum=F.col("p_partkey")).alias("id"))


@query("SELECT COUNT(DISTINCT c) AS n_columns, 0.0::DOUBLE AS max_null_rate FROM (SELECT unnest(['l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', 'l_quantity', 'l_extendedprice', 'l_discount', 'l_tax', 'l_returnflag', 'l_linestatus', 'l_shipdate']) AS c)")
def profile_columns(spark, d):
    return validation.null_rates(read(spark, d, "lineitem")).agg(F.count("column").alias("n_columns"), F.max("null_rate").alias("max_null_rate"))


@query("SELECT 'kind' AS \"column\", ROUND(AVG(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END), 6) AS null_rate FROM events")
def profile_null_rates(spark, d):
    return validation.null_rates(_nulled(spark, d), ["kind"], above=0.05).select("column", F.round("null_rate", 6).alias("null_rate"))


@query("SELECT COUNT(*) FILTER (c_acctbal < 0) AS c_acctbal_negative FROM customer")
def profile_negative_counts(spark, d):
    return validation.negative_counts(read(spark, d, "customer"), ["c_acctbal", "absent"])


# ids


@query("SELECT c_name AS string_id, row_number() OVER (ORDER BY c_name) - 1 AS entity_id FROM (SELECT DISTINCT c_name FROM customer)")
def surrogate_id(spark, d):
    return ids.dense_ids(read(spark, d, "customer").select(F.col("c_name").alias("string_id")), "string_id", scratch(spark, "queries"))


@query("SELECT COUNT(*) AS n, COUNT(DISTINCT p_name) AS n_ids, 0::BIGINT AS changed FROM part")
def registry_rerun(spark, d):
    """The ids that a first part of the keys got stay when all are registered, twice."""
    reg = ids.Registry(spark, scratch(spark, "queries"), "p_name")
    rows = read(spark, d, "part").select("p_name", "p_partkey")
    first = reg.register(rows.filter("p_partkey % 3 = 0")).withColumnRenamed("entity_id", "first_id")
    reg.register(rows)
    last = reg.register(rows)
    moved = F.count_if(F.col("first_id").isNotNull() & (F.col("first_id") != F.col("entity_id")))
    joined = reg.with_ids(rows).join(first, "p_name", "left")
    return joined.agg(F.count("*").alias("n"), F.countDistinct("entity_id").alias("n_ids"), moved.alias("changed")) if last is not None else joined


# merge, checks, routing


@query("SELECT event_type, COUNT(*) AS cnt FROM events GROUP BY event_type")
def merge_idempotent(spark, d):
    rows = read(spark, d, "events")
    parts = [cube.build(rows.filter(f), EVENTS) for f in ("event_id % 3 < 2", "event_id % 3 > 0", "event_id % 2 = 0")]
    return cube.merge(parts, EVENTS).groupBy("event_type").agg(F.sum("cardinality").alias("cnt"))


@query("SELECT event_type, COUNT(*) AS cnt FROM events GROUP BY event_type")
def cube_upsert(spark, d):
    path, rows = scratch(spark, "queries"), read(spark, d, "events")
    cube.upsert(cube.build(rows.filter("event_id % 2 = 0"), EVENTS), EVENTS, path)
    cube.upsert(cube.build(rows.filter("event_id % 3 > 0"), EVENTS), EVENTS, path)
    cube.upsert(cube.build(rows.filter("event_id % 6 = 3"), EVENTS), EVENTS, path)
    return cube.read(spark, path).groupBy("event_type").agg(F.sum("cardinality").alias("cnt"))


@query("SELECT MIN(CAST(ts AS DATE)) AS min_date, MAX(CAST(ts AS DATE)) AS max_date, COUNT(DISTINCT CAST(ts AS DATE)) AS n_dates, COUNT(*) AS total FROM events")
def verify_coverage(spark, d):
    return cube.coverage(events_cube(spark, d), "day")


@query("SELECT CAST(g AS DATE) AS day FROM generate_series(DATE '2023-12-30', DATE '2024-02-02', INTERVAL 1 DAY) t(g) WHERE CAST(g AS DATE) NOT IN (SELECT CAST(ts AS DATE) FROM events WHERE event_type = 'click' AND day(ts) % 7 <> 0)")
def missing_days(spark, d):
    own = cube.build(read(spark, d, "events").filter("event_type = 'click' and day(ts) % 7 <> 0"), EVENTS)
    return cube.missing_days(own, "day", "2023-12-30", "2024-02-02")


@query("SELECT '2023-11' AS month, 30::BIGINT AS n_days UNION ALL SELECT '2023-12', 31")
def missing_months(spark, d):
    return cube.missing_months(cube.missing_days(events_cube(spark, d), "day", "2023-11-01", "2024-01-10"))


@query("SELECT COUNT(*) AS n_rows, COUNT(*) FILTER (event_type <> 'click') AS n_cube, -COUNT(*) FILTER (event_type = 'click') AS delta FROM events")
def cross_check(spark, d):
    return cube.cross_check(cube.build(_nulled(spark, d), _NULLED), read(spark, d, "events"))


def _candidates(spark, d) -> list[router.Candidate]:
    rows = read(spark, d, "events")
    return [router.Candidate(s, cube.build(rows, s), n) for n, s in ((150, EVENTS), (151, EVENT_USERS), (720, EVENT_HOURS))]


@query("SELECT CAST(month(ts) AS BIGINT) AS month, event_type, COUNT(*) AS cnt FROM events GROUP BY ALL")
def routed_month_by_type(spark, d):
    q = router.Question("event_id", (router.Key("ts", "extract_date", "month", "month"), router.Key("event_type")))
    return router.answer(q, _candidates(spark, d), read(spark, d, "events")).withColumn("month", long("month"))


@query("SELECT event_type, COUNT(DISTINCT user_id) AS cnt FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-15' GROUP BY event_type")
def routed_distinct_users(spark, d):
    q = router.Question("user_id", (router.Key("event_type"),), {router.Key("ts", "extract_date"): lambda c: c >= F.lit("2024-01-15").cast("date")})
    return router.answer(q, _candidates(spark, d), read(spark, d, "events"))


@query("SELECT CAST(floor(value) AS BIGINT) AS v, COUNT(DISTINCT user_id) AS cnt FROM events GROUP BY 1")
def routed_raw_fallback(spark, d):
    q = router.Question("user_id", (router.Key("value", "floor", name="v"),), with_nulls=True)
    return router.answer(q, _candidates(spark, d), read(spark, d, "events"))
