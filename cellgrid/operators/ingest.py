"""From raw files to standard rows: columns from file names, row ids, layout detection, value maps, casts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.transforms import stripped
from ..plans.specs import AddColumn, Fact, StandardColumn, Variant

FILE = "_metadata.file_name"

# The standard columns of a taxi trip, the codes that words stand for (words are looked up without white space at their ends), and the source layouts.
RATE_CODES = (("1", 1), ("2", 2), ("3", 3), ("4", 4), ("5", 5), ("6", 6), ("standard rate", 1), ("jfk", 2), ("newark", 3), ("nassau or westchester", 4), ("negotiated fare", 5), ("group ride", 6))
PAYMENT_TYPES = (
    ("1", 1), ("2", 2), ("3", 3), ("4", 4), ("5", 5), ("6", 6), ("credit card", 1), ("cre", 1), ("crd", 1), ("cash", 2), ("cas", 2), ("no charge", 3), ("no", 3), ("noc", 3),
    ("dispute", 4), ("dis", 4), ("unknown", 5), ("unk", 5), ("voided trip", 6), ("voided", 6),
)
TRIP_COLUMNS = (
    StandardColumn("pickup_datetime", "TIMESTAMP"), StandardColumn("dropoff_datetime", "TIMESTAMP"), StandardColumn("VendorID", "STRING"), StandardColumn("passenger_count", "INT64"),
    StandardColumn("trip_distance", "FLOAT64"), StandardColumn("RatecodeID", "INT64", RATE_CODES), StandardColumn("store_and_fwd_flag", "STRING"), StandardColumn("PULocationID", "INT64"),
    StandardColumn("DOLocationID", "INT64"), StandardColumn("payment_type", "INT64", PAYMENT_TYPES), StandardColumn("fare_amount", "FLOAT64"), StandardColumn("extra", "FLOAT64"),
    StandardColumn("mta_tax", "FLOAT64"), StandardColumn("tip_amount", "FLOAT64"), StandardColumn("tolls_amount", "FLOAT64"), StandardColumn("improvement_surcharge", "FLOAT64"),
    StandardColumn("total_amount", "FLOAT64"), StandardColumn("congestion_surcharge", "FLOAT64"), StandardColumn("airport_fee", "FLOAT64"),
)
TRIP_VARIANTS = (
    Variant("schema_2009", "Trip_Pickup_DateTime", (
        ("Trip_Pickup_DateTime", "pickup_datetime"), ("Trip_Dropoff_DateTime", "dropoff_datetime"), ("Passenger_Count", "passenger_count"), ("Trip_Distance", "trip_distance"),
        ("Payment_Type", "payment_type"), ("Fare_Amt", "fare_amount"), ("Tip_Amt", "tip_amount"), ("Tolls_Amt", "tolls_amount"), ("Total_Amt", "total_amount"), ("Rate_Code", "RatecodeID"),
        ("vendor_name", "VendorID"), ("surcharge", "extra"))),
    Variant("schema_2010", "vendor_id", (("vendor_id", "VendorID"), ("rate_code", "RatecodeID"))),
    Variant("yellow_tpep", "tpep_pickup_datetime", (("tpep_pickup_datetime", "pickup_datetime"), ("tpep_dropoff_datetime", "dropoff_datetime"))),
    Variant("green_lpep", "lpep_pickup_datetime", (("lpep_pickup_datetime", "pickup_datetime"), ("lpep_dropoff_datetime", "dropoff_datetime"))),
    Variant("2011_plus", "VendorID"),
)


def from_file_name(spec: AddColumn, name: Column | None = None) -> Column:
    """The column that a file's name gives: the label of the first pattern found in the lower-cased name, else unknown; or a regex's group, an error where it isn't found."""
    name = F.col(FILE) if name is None else name
    if spec.regex:
        found = F.regexp_extract(name, spec.regex, spec.group)
        return F.when(F.rlike(name, F.lit(spec.regex)), found).otherwise(F.raise_error(F.concat(F.lit(f"no {spec.column} in the file name "), name)))
    value = F.lit("unknown")
    for label, pattern in reversed(spec.patterns):
        value = F.when(F.rlike(F.lower(name), F.lit(pattern)), F.lit(label)).otherwise(value)
    return value


def add_columns(rows: DataFrame, specs: tuple[AddColumn, ...], name: Column | None = None) -> DataFrame:
    return rows.withColumns({s.column: from_file_name(s, name) for s in specs})


def string_id(template: str, rownum: Column | None = None) -> Column:
    """A row's id by a template like `{year}_{month}_{rownum:08d}_{cab_type}`; rownum is the row's place in its file, from 0."""
    import string

    rownum = F.col("_metadata.row_index") if rownum is None else rownum
    pattern, columns = "", []
    for text, field, spec, _ in string.Formatter().parse(template):
        pattern += text.replace("%", "%%")
        if field:
            number = bool(spec) and spec[-1] == "d"
            pattern += f"%{spec[:-1] if number else ''}{'d' if number else 's'}"
            columns.append((rownum if field == "rownum" else F.col(field)).cast("long" if number else "string"))
    return F.format_string(pattern, *columns)


def detect_variant(columns: list[str], variants: tuple[Variant, ...]) -> Variant | None:
    """The first layout whose column is there; case counts."""
    return next((v for v in variants if v.detect in columns), None)


def standard_names(rows: DataFrame, variants: tuple[Variant, ...] = TRIP_VARIANTS) -> DataFrame:
    """rows with the names of the standard; rows of an unknown layout as they are."""
    found = detect_variant(rows.columns, variants)
    rename = dict(found.rename) if found else {}
    return rows.toDF(*[rename.get(c, c) for c in rows.columns])


def mapped(column: Column, values: tuple[tuple[str, int], ...]) -> Column:
    """The code of a word, by its lower-case form without white space at the ends; other values stay, as text."""
    text = column.cast("string")
    codes = F.create_map(*[x for k, v in values for x in (F.lit(k.strip().lower()), F.lit(str(v)))])
    return F.coalesce(codes[F.lower(stripped(text))], text)


_CASTS = {
    "TIMESTAMP": lambda c: c.try_cast("timestamp_ntz"),
    "FLOAT64": lambda c: c.try_cast("double"),
    "FLOAT32": lambda c: c.try_cast("float"),
    # by way of double, as 1.0 is no text of an integer; a fraction is no integer
    "INT64": lambda c: F.when(c.try_cast("double") == F.floor(c.try_cast("double")), c.try_cast("double").try_cast("bigint")),
    "INT8": lambda c: F.when(c.try_cast("double") == F.floor(c.try_cast("double")), c.try_cast("double").try_cast("tinyint")),
    "STRING": lambda c: c.cast("string"),
}


def coerced(column: Column, dtype: str) -> Column:
    """The column as dtype, null where a value can't be; columns of an unknown dtype as they are."""
    return _CASTS.get(dtype.upper(), lambda c: c)(column)


def standardised(rows: DataFrame, columns: tuple[StandardColumn, ...] = TRIP_COLUMNS) -> DataFrame:
    """rows with words mapped to codes and the standard columns cast; those that rows lack are passed over, others kept."""
    new = {s.name: coerced(mapped(F.col(f"`{s.name}`"), s.value_map) if s.value_map else F.col(f"`{s.name}`"), s.dtype) for s in columns if s.name in rows.columns}
    return rows.withColumns(new) if new else rows


def completed(rows: DataFrame, columns: tuple[StandardColumn, ...] = TRIP_COLUMNS) -> DataFrame:
    """rows with all standard columns, null where they lack them: so that what is stored has the same columns and types whichever layouts it came from."""
    new = {s.name: coerced(F.lit(None).cast("string"), s.dtype) for s in columns if s.name not in rows.columns}
    return rows.withColumns(new) if new else rows


def union_of_layouts(parts: list[DataFrame]) -> DataFrame:
    """Rows of several layouts by name; columns that some lack are null there."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def facts(rows: DataFrame, entity: str, columns: tuple[Fact, ...], keep: tuple[str, ...] = ()) -> DataFrame:
    """The slim table for other aggregates: the entity's id and the declared columns that rows have, cast, sorted by id in each partition; keep: columns that stay as they are."""
    own = [coerced(F.col(f.column), f.dtype).alias(f.column) for f in columns if f.column in rows.columns]
    return rows.select(entity, *own, *[c for c in keep if c in rows.columns]).sortWithinPartitions(entity)
