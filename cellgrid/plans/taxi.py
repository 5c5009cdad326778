"""The taxi trips: the entity, its seven cubes, and the queries, each raw, by cardinality and by counting bitmaps."""

from __future__ import annotations

import re
from dataclasses import replace

from ..functions import bitmaps
from .specs import AddColumn, CubeSpec, Dim, EntitySpec, Fact, QuerySpec

# Names, patterns and types of the trips, and the cubes' dimensions.
TRIPS = EntitySpec(
    "trips",
    add_columns=(AddColumn("cab_type", (("yellow", "yellow"), ("green", "green"), ("fhv", "fhv|hvfhv"))), AddColumn("year", regex=r"(\d{4})-\d{2}"), AddColumn("month", regex=r"\d{4}-(\d{2})")),
    unique_id="trip_id",
    id_template="{year}_{month}_{rownum:08d}_{cab_type}",
    timestamp="pickup_datetime",
    facts=(Fact("pickup_datetime", "TIMESTAMP"), Fact("fare_amount", "FLOAT64"), Fact("total_amount", "FLOAT64"), Fact("tip_amount", "FLOAT64"), Fact("tolls_amount", "FLOAT64"), Fact("trip_distance", "FLOAT64"), Fact("passenger_count", "INT64")),
)
RAW_COLUMNS = (
    "VendorID", "tpep_pickup_datetime", "tpep_dropoff_datetime", "passenger_count", "trip_distance", "RatecodeID", "PULocationID", "DOLocationID", "payment_type",
    "fare_amount", "extra", "mta_tax", "tip_amount", "tolls_amount", "improvement_surcharge", "total_amount", "congestion_surcharge",
)
RAW_NUMBERS = ("passenger_count", "trip_distance", "fare_amount")
_DAY, _HOUR = Dim("pickup_datetime", "extract_date", "pickup_date"), Dim("pickup_datetime", "extract_hour", "pickup_hour")
CUBES = (
    CubeSpec("conv_cab_type", (_DAY, Dim("cab_type")), date="pickup_date"),
    CubeSpec("conv_pax_distance_date", (_DAY, Dim("passenger_count"), Dim("trip_distance", "round")), date="pickup_date"),
    CubeSpec("conv_hour_pickup", (_DAY, _HOUR), date="pickup_date"),
    CubeSpec("conv_pickup_zone", (_DAY, Dim("PULocationID")), date="pickup_date", keep_null_dims=True),
    CubeSpec("conv_dropoff_zone", (_DAY, _HOUR, Dim("DOLocationID")), date="pickup_date"),
    CubeSpec("conv_payment_type", (_DAY, Dim("payment_type")), date="pickup_date"),
    CubeSpec("conv_rate_code", (_DAY, Dim("RatecodeID")), date="pickup_date"),
)

_YEAR = "CAST(LEFT(CAST(pickup_date AS STRING), 4) AS INT)"
_RAW_YEAR = "YEAR(pickup_datetime)"


def _queries(n: str) -> tuple[QuerySpec, ...]:
    """The queries over cubes, with n the count of a cell."""
    by_passengers = ("SELECT passenger_count, AVG(total_amount) AS avg_amount FROM trips GROUP BY passenger_count", "SELECT passenger_count, AVG(total_amount) AS avg_amount FROM facts GROUP BY passenger_count")
    by_year = (f"SELECT passenger_count, {_RAW_YEAR} AS year, COUNT(*) AS cnt FROM trips GROUP BY 1, 2", f"SELECT passenger_count, {_YEAR} AS year, SUM({n}) AS cnt FROM conv_pax_distance_date GROUP BY 1, 2")
    by_distance = (
        f"SELECT passenger_count, {_RAW_YEAR} AS year, CAST(ROUND(trip_distance) AS BIGINT) AS distance, COUNT(*) AS cnt FROM trips GROUP BY 1, 2, 3 ORDER BY year, cnt DESC",
        f"SELECT passenger_count, {_YEAR} AS year, trip_distance AS distance, SUM({n}) AS cnt FROM conv_pax_distance_date GROUP BY 1, 2, 3 ORDER BY year, cnt DESC",
    )
    between, midtown = "BETWEEN DATE '2009-01-01' AND DATE '2015-12-31'", "(SELECT location_id FROM taxi_zones WHERE zone = 'Midtown East')"
    return (
        QuerySpec("B1-Q0", f"SELECT cab_type, COUNT(*) AS cnt FROM trips WHERE CAST(pickup_datetime AS DATE) {between} GROUP BY cab_type", f"SELECT cab_type, SUM({n}) AS cnt FROM conv_cab_type WHERE pickup_date {between} GROUP BY cab_type", enabled=False, expected={"yellow": 1_086_709_191, "green": 26_943_827}),
        QuerySpec("B1-Q1", "SELECT cab_type, COUNT(*) AS cnt FROM trips GROUP BY cab_type", f"SELECT cab_type, SUM({n}) AS cnt FROM conv_cab_type GROUP BY cab_type", published_ms=498),
        QuerySpec("B1-Q2", *by_passengers, published_ms=234),
        QuerySpec("B1-Q3", *by_year, published_ms=734),
        QuerySpec("B1-Q4", *by_distance, published_ms=1334),
        QuerySpec("B2-Q1", *by_passengers, published_ms=620),
        QuerySpec("B2-Q2", *by_year, published_ms=1110),
        QuerySpec("B2-Q3", *by_distance, published_ms=1780),
        QuerySpec("B2-Q4", "SELECT zone, COUNT(*) AS cnt FROM trips LEFT JOIN taxi_zones ON PULocationID = location_id GROUP BY zone ORDER BY cnt DESC", f"SELECT zone, SUM({n}) AS cnt FROM conv_pickup_zone LEFT JOIN taxi_zones ON PULocationID = location_id GROUP BY zone ORDER BY cnt DESC", published_ms=940),
        QuerySpec("B2-Q5", f"SELECT COUNT(*) AS cnt FROM trips WHERE PULocationID IN {midtown}", f"SELECT COALESCE(SUM({n}), 0) AS cnt FROM conv_pickup_zone WHERE PULocationID IN {midtown}", published_ms=330),
    )


BY_CARDINALITY = _queries("cardinality")
BY_BITMAP = _queries(bitmaps.COUNT_SQL)
#: Counts looked up by the hash of the bitmap.
BY_HASH = tuple(replace(q, rewritten=re.sub(r"SUM\(HASHED\)", "SUM(bitmap_counts.cnt)", re.sub(r"FROM (conv_\w+)", r"FROM \1 JOIN bitmap_counts USING (bitmap_hash)", q.rewritten))) for q in _queries("HASHED"))
