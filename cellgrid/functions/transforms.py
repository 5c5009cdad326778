"""Dimension transforms by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TRANSFORMS: dict[str, Callable[[Column], Column]] = {
    "none": lambda c: c,
    # half up and cut towards zero, so it equals ROUND for values from 0 on only; infinities and NaN give null
    "round": lambda c: (c.cast("double") + 0.5).try_cast("bigint"),
    # half to even after scaling
    "round_1dp": lambda c: F.rint(c.cast("double") * 10) / 10,
    "floor": lambda c: F.floor(c.cast("double")).try_cast("bigint"),
    "ceiling": lambda c: F.ceil(c.cast("double")).try_cast("bigint"),
    "extract_date": F.to_date,
    "extract_hour": F.hour,
    "extract_dow": lambda c: F.date_format(c, "EEEE"),
    "extract_year": F.year,
    "extract_month": F.month,
}


def transform(name: str, column: Column | str) -> Column:
    """The transform name of a column."""
    if name not in TRANSFORMS:
        raise ValueError(f"unknown transform {name!r}; known: {', '.join(TRANSFORMS)}")
    return TRANSFORMS[name](F.col(column) if isinstance(column, str) else column)


def stripped(column: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(column, r"^\s+|\s+$", "")
