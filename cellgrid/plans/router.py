"""Which cube answers a distinct count, if any."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bitmaps
from ..functions.transforms import transform
from .specs import CubeSpec

#: What each grain of a date can be rolled up to.
_GRAINS: dict[str, Callable[[Column], Column]] = {"year": F.year, "month": F.month, "day": lambda c: c}


@dataclass(frozen=True)
class Key:
    """A wanted group: a transform of a source column, and by grain a part of the date that it gives."""

    column: str
    transform: str = "none"
    grain: str = "day"
    name: str = ""

    @property
    def label(self) -> str:
        return self.name or self.column


@dataclass
class Question:
    """How many distinct entities are there for each of the keys, among rows where conditions on (other) keys hold.

    with_nulls: whether rows with a null in a key are wanted as groups, as SQL's GROUP BY gives them.
    """

    entity: str
    keys: tuple[Key, ...]
    where: dict[Key, Callable[[Column], Column]] = field(default_factory=dict)
    with_nulls: bool = False


@dataclass
class Candidate:
    spec: CubeSpec
    cube: DataFrame
    rows: int


def _dims(spec: CubeSpec) -> dict[tuple[str, str], str]:
    return {(d.column, d.transform): d.name for d in spec.dims}


def fits(spec: CubeSpec, question: Question) -> bool:
    """A cube fits if it has all the question's keys, its entity, and treats nulls as the question wants.

    A cube without null dimensions lacks the rows that have a null in any of its dimensions, asked for or not: it is exact only for questions that leave
    them out and name all its dimensions but the date, which cubes never have null.
    """
    dims = _dims(spec)
    wanted = {(k.column, k.transform) for k in (*question.keys, *question.where)}
    if spec.entity != question.entity or not wanted <= set(dims):
        return False
    if spec.keep_null_dims:
        return True
    others = {name for key, name in dims.items() if key not in wanted} - {spec.date}
    return not question.with_nulls and not others


def choose(candidates: list[Candidate], question: Question) -> Candidate | None:
    """The fitting cube with the fewest rows."""
    return min((c for c in candidates if fits(c.spec, question)), key=lambda c: c.rows, default=None)


def answer(question: Question, candidates: list[Candidate], raw: DataFrame, name: str = "cnt") -> DataFrame:
    """The counts, from the cube chosen, or from the raw rows where none fits."""
    chosen = choose(candidates, question)
    if chosen is None:
        made = {k: transform(k.transform, k.column) for k in (*question.keys, *question.where)}
        rows = raw.filter(F.col(question.entity).isNotNull())
    else:
        dims = _dims(chosen.spec)
        made = {k: F.col(dims[k.column, k.transform]) for k in (*question.keys, *question.where)}
        rows = chosen.cube
    for k, condition in question.where.items():
        rows = rows.filter(condition(_GRAINS[k.grain](made[k])))
    rows = rows.withColumns({f"_key{i}": _GRAINS[k.grain](made[k]) for i, k in enumerate(question.keys)})
    names = [f"_key{i}" for i in range(len(question.keys))]
    if not question.with_nulls and names:
        rows = rows.na.drop(subset=names)
    if chosen is None:
        out = rows.groupBy(*names).agg(F.countDistinct(question.entity).alias(name))
    elif chosen.spec.disjoint and bitmaps.CARDINALITY in rows.columns:
        out = rows.groupBy(*names).agg(F.sum(bitmaps.CARDINALITY).alias(name))
    else:
        out = bitmaps.cardinality(bitmaps.union(rows, names), names, name)
    return out.select(*[F.col(n).alias(k.label) for n, k in zip(names, question.keys, strict=True)], F.coalesce(name, F.lit(0)).cast("bigint").alias(name))
