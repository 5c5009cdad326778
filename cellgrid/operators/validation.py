"""Row rules, the split into clean and dirty rows, reason counts, profiles."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.transforms import stripped

REASON = "dirty_reason"
#: Columns that a row's own file lacked, where rows of several layouts were united.
ABSENT = "absent_columns"


@dataclass(frozen=True)
class Rule:
    """A row is dirty where broken is true; the rule holds for rows that have all its columns."""

    label: str
    columns: tuple[str, ...]
    broken: Callable[..., Column]


def _null(c: Column) -> Column:
    return c.isNull()


def _blank(c: Column) -> Column:
    return c.isNull() | (stripped(c.cast("string")) == "")


def _negative(c: Column) -> Column:
    return c < 0


# The rules of a taxi trip, in the order of their labels in a reason.
TRIP_RULES = (
    Rule("null_pickup_datetime", ("pickup_datetime",), _null),
    Rule("null_dropoff_datetime", ("dropoff_datetime",), _null),
    Rule("dropoff_before_pickup", ("pickup_datetime", "dropoff_datetime"), lambda a, b: a > b),
    Rule("invalid_passenger_count", ("passenger_count",), lambda c: ~c.between(0, 20)),
    Rule("distance_negative", ("trip_distance",), _negative),
    Rule("fare_negative", ("fare_amount",), _negative),
    Rule("total_negative", ("total_amount",), _negative),
    Rule("tip_negative", ("tip_amount",), _negative),
    Rule("tolls_negative", ("tolls_amount",), _negative),
    Rule("mta_tax_negative", ("mta_tax",), _negative),
    Rule("extra_negative", ("extra",), _negative),
    Rule("congestion_surcharge_negative", ("congestion_surcharge",), _negative),
    Rule("airport_fee_negative", ("airport_fee",), _negative),
    Rule("null_PULocationID", ("PULocationID",), _null),
    Rule("null_DOLocationID", ("DOLocationID",), _null),
    Rule("null_cab_type", ("cab_type",), _blank),
    Rule("null_VendorID", ("VendorID",), _blank),
)


def reasons(columns: list[str], rules: tuple[Rule, ...] = TRIP_RULES) -> Column:
    """The labels of the broken rules, each with a bar after it; empty for a clean row. A rule holds for rows that have its columns, by absent_columns too."""

    def broken(r: Rule) -> Column:
        found = r.broken(*map(F.col, r.columns))
        return found & ~F.coalesce(F.arrays_overlap(F.col(ABSENT), F.array(*map(F.lit, r.columns))), F.lit(False)) if ABSENT in columns else found

    own = [r for r in rules if all(c in columns for c in r.columns)]
    return F.concat(F.lit(""), *[F.when(broken(r), F.lit(r.label + "|")).otherwise("") for r in own])


def with_absent(rows: DataFrame, rules: tuple[Rule, ...] = TRIP_RULES) -> DataFrame:
    """rows of one layout with absent_columns: those of the rules' columns that they lack."""
    lacking = sorted({c for r in rules for c in r.columns if c not in rows.columns})
    return rows.withColumn(ABSENT, F.array(*map(F.lit, lacking)).cast("array<string>"))


def split(rows: DataFrame, rules: tuple[Rule, ...] = TRIP_RULES) -> tuple[DataFrame, DataFrame]:
    """Clean rows, and dirty rows with their reasons."""
    marked = rows.withColumn(REASON, reasons(rows.columns, rules))
    return marked.filter(F.col(REASON) == "").drop(REASON, ABSENT), marked.filter(F.col(REASON) != "").drop(ABSENT)


def split_stats(rows: DataFrame, rules: tuple[Rule, ...] = TRIP_RULES) -> DataFrame:
    """rows_in, clean, dirty, dirty_pct (2 places)."""
    dirty = F.count_if(reasons(rows.columns, rules) != "")
    n = F.count("*")
    return rows.agg(n.alias("rows_in"), (n - dirty).alias("clean"), dirty.alias("dirty"), F.round(F.when(n > 0, 100.0 * dirty / n).otherwise(0.0), 2).alias("dirty_pct"))


def reason_counts(rows: DataFrame, rules: tuple[Rule, ...] = TRIP_RULES, by: list[str] | None = None) -> DataFrame:
    """reason, n: rows by broken rule (and by the columns by); a row that breaks two counts for each."""
    each = rows.select(*(by or []), F.explode(F.split(reasons(rows.columns, rules), r"\|")).alias("reason"))
    return each.filter("reason <> ''").groupBy(*(by or []), "reason").agg(F.count("*").alias("n"))


def null_rates(rows: DataFrame, columns: list[str] | None = None, above: float | None = None) -> DataFrame:
    """column, null_rate; with above, only those over it (0.05 is usual)."""
    names = columns or rows.columns
    one = rows.agg(*[F.avg(F.col(f"`{c}`").isNull().cast("int")).alias(c) for c in names])
    out = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("null_rate")) for c in names])).alias("x")).select("x.*")
    return out if above is None else out.filter(F.col("null_rate") > above)


def layout_gaps(columns: list[str], expected: list[str]) -> dict[str, list[str]]:
    """Columns that are missing, and that are there without being expected."""
    return {"missing": [c for c in expected if c not in columns], "extra": [c for c in columns if c not in expected]}


def negative_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """For each of the columns that rows have, how many values are under 0."""
    return rows.agg(*[F.count_if(F.col(c) < 0).alias(f"{c}_negative") for c in columns if c in rows.columns])
