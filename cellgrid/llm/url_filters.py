"""URL rules by a sort-merge range join. DataFrame functions only.

A canonical key is the reversed host with a dot after each label, then the path (`com.example./en/7`). A rule is the interval of keys that begin
with its own key; such intervals nest or are disjoint. A rule also fits all subdomains of its host, so a url has a key for its host and for each
parent domain, up to as many labels as any rule's host has. All keys and rules are sorted together, in ranges, and swept: each rule opens with the
stack of rules that it is nested in, and a key takes the stack of the last rule before it. Of that stack the rules whose interval has ended fall
off; the innermost of the rest is the longest that fits this key. (A rule that is a key's prefix is one of any rule between the two.) The longest
over a url's keys wins.

Distinct hosts and paths alone are sorted, so a hot url is one row. A range's sweep begins with the last rule of the ranges before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged

_RULES = "rule string, host string, path string, verdict string"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty for null or without ://."""
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(after, F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def rules_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """rules: (verdict, host and path as `example.com/en/`). Hosts have no port and are in lower case."""
    rows = [(r, r.partition("/")[0], "/" + r.partition("/")[2], v) for v, r in rules]
    return spark.createDataFrame(rows, _RULES)


def stacks(rules: DataFrame) -> DataFrame:
    """key, stack of each distinct rule key: the rule and those that it is nested in, innermost first, as (key, rule, verdict).

    A rule that encloses another has the same host and one of the shorter lengths of that host's paths, so it is looked up by that prefix. Of rules
    of one key the first by its text, then by its verdict stands.
    """
    own = rules.withColumn("host", canonical_key(F.col("host"))).filter(F.col("rule").isNotNull()).groupBy("host", "path").agg(F.min(F.struct("rule", "verdict")).alias("best"))
    own = own.select("host", F.concat("host", "path").alias("key"), F.length(F.concat("host", "path")).alias("n"), "best.*")
    lengths = own.select("host", F.col("n").alias("m")).distinct()
    prefixes = own.select("host", "key", "n").join(lengths, "host").filter(F.col("m") <= F.col("n")).select("key", F.left("key", F.col("m")).alias("outer"))
    outer = own.select(F.col("key").alias("outer"), F.struct((-F.col("n")).alias("rank"), "key", "rule", "verdict").alias("one"))
    found = prefixes.join(outer, "outer").groupBy("key").agg(F.sort_array(F.collect_list("one")).alias("stack"))
    return found.select("key", F.transform("stack", lambda x: F.struct(x["key"], x["rule"], x["verdict"])).alias("stack"))


def judge(urls: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """urls with four more columns: _cg_host, _cg_path, _cg_rule (null if none fits), _cg_verdict.

    A rule fits its host and all subdomains, if the url's path starts with the rule's; the longest (host and path, in characters) wins, of equally long
    ones the first by its text. Null urls and urls without :// have empty host and path, and no rule. A rule's path begins with `/`. Rules with a null
    fit nothing; of rules of the same host and path the first by its verdict stands. Repeated urls each get their row; empty tables are fine.
    """
    rows = urls.withColumn("_cg_host", host_of(F.col(url))).withColumn("_cg_path", path_of(F.col(url)))
    stacked = staged(stacks(rules), "rule-stacks")
    kind = stacked.schema["stack"].dataType
    most = rules.agg(F.max(F.size(F.split("host", r"\.", -1)))).head()[0] or 0  # labels of the rules' longest host
    if not most:
        return rows.withColumns({"_cg_rule": F.lit(None).cast("string"), "_cg_verdict": F.lit(default)})
    distinct = rows.filter("_cg_host <> '' and _cg_path <> ''").select("_cg_host", "_cg_path").distinct()
    labels = F.reverse(F.split("_cg_host", r"\.", -1))
    parents = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most))), lambda i: F.concat(F.array_join(F.slice(labels, F.lit(1), i), "."), F.lit("."), F.col("_cg_path")))
    keys = distinct.select("_cg_host", "_cg_path", F.explode(parents).alias("key"))
    both = keys.withColumn("kind", F.lit(1)).unionByName(stacked.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    # rules and keys in one order; the host parts keys that are alike
    ranges = staged(both.repartitionByRange("key", "kind", "_cg_host").withColumn("range", F.spark_partition_id()), "url-ranges")
    in_order = Window.partitionBy("range").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    last = ranges.filter("kind = 0").groupBy("range").agg(F.max_by("stack", "key").alias("stack"))
    ends = ranges.select("range").distinct().join(last, "range", "left")
    before = ends.select("range", F.last("stack", ignorenulls=True).over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))  # a row for each range
    swept = ranges.withColumn("stack", F.last("stack", ignorenulls=True).over(in_order)).filter("kind = 1").join(F.broadcast(before), "range")
    active = F.coalesce("stack", "before", F.array().cast(kind))
    fits = F.get(F.filter(active, lambda r: F.startswith(F.col("key"), r["key"])), F.lit(0))
    found = swept.select("_cg_host", "_cg_path", fits.alias("best")).filter("best is not null")
    best = found.groupBy("_cg_host", "_cg_path").agg(F.min(F.struct((-F.length("best.rule")).alias("rank"), "best.rule", "best.verdict")).alias("_cg_best"))
    joined = rows.join(best, ["_cg_host", "_cg_path"], "left")
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], F.col("_cg_best.rule").alias("_cg_rule"), F.coalesce("_cg_best.verdict", F.lit(default)).alias("_cg_verdict"))
