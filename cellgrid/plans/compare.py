"""Whether two results are the same: the check of a rewritten query against the raw one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Outcome:
    same: bool
    rows: tuple[int, int]
    only_left: list
    only_right: list

    def report(self, left: str = "raw", right: str = "rewritten") -> str:
        lines = [f"{left}: {self.rows[0]} rows, {right}: {self.rows[1]} rows, {'same' if self.same else 'different'}"]
        return "\n".join([*lines, *(f"only {left}: {r}" for r in self.only_left), *(f"only {right}: {r}" for r in self.only_right)])


def normalised(rows: DataFrame, places: int = 2) -> DataFrame:
    """Columns by position; floats rounded, and as integers where they are whole; dates and numbers as text, so that types don't matter. Nulls stay nulls."""
    out = []
    for i, (c, kind) in enumerate(rows.dtypes):
        v = F.col(f"`{c}`")
        if kind in ("double", "float") or kind.startswith("decimal"):
            r = F.round(v.cast("double"), places)
            v = F.when(r == F.floor(r), r.cast("bigint").cast("string")).otherwise(r.cast("string"))
        else:
            v = v.cast("string")
        out.append(v.alias(f"c{i}"))
    return rows.select(*out)


def compare(left: DataFrame, right: DataFrame, mode: str = "exact", places: int = 2, shown: int = 20) -> Outcome:
    """mode: exact (rows with their repetitions; nulls equal nulls), count_only, or none. Set operations do it, distributed; only samples of differences are fetched."""
    if mode == "none":
        return Outcome(True, (-1, -1), [], [])
    n = (left.count(), right.count())
    if mode == "count_only":
        return Outcome(n[0] == n[1], n, [], [])
    if len(left.columns) != len(right.columns):
        return Outcome(False, n, [], [])
    a, b = normalised(left, places), normalised(right, places)
    only_a, only_b = a.exceptAll(b).limit(shown).collect(), b.exceptAll(a).limit(shown).collect()
    return Outcome(not only_a and not only_b, n, only_a, only_b)
