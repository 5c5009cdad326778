"""Declarations: entities, schema variants, cubes, queries; from Python or YAML."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class Dim:
    """A cube's dimension: a source column, a transform, and the name of the result (the column's own by default)."""

    column: str
    transform: str = "none"
    output: str = ""

    @property
    def name(self) -> str:
        return self.output or self.column


@dataclass(frozen=True)
class CubeSpec:
    """A cube: for each combination of its dimensions the set of entities. date: the dimension that its files are partitioned by (year)."""

    name: str
    dims: tuple[Dim, ...]
    entity: str = "entity_id"
    date: str = ""
    keep_null_dims: bool = False
    add_cardinality: bool = True
    add_hash: bool = True
    enabled: bool = True
    #: Whether an entity is in one cell only, so that sums of cardinalities are distinct counts.
    disjoint: bool = True

    @property
    def names(self) -> list[str]:
        return [d.name for d in self.dims]


@dataclass(frozen=True)
class Fact:
    column: str
    dtype: str


@dataclass(frozen=True)
class AddColumn:
    """A column made from the file's name: patterns (label -> regex on the lower-cased name, first match wins, else unknown) or one regex's group."""

    column: str
    patterns: tuple[tuple[str, str], ...] = ()
    regex: str = ""
    group: int = 1


@dataclass(frozen=True)
class EntitySpec:
    name: str
    add_columns: tuple[AddColumn, ...] = ()
    unique_id: str = ""
    id_template: str = ""
    entity_id: str = "entity_id"
    timestamp: str = ""
    facts: tuple[Fact, ...] = ()


@dataclass(frozen=True)
class StandardColumn:
    name: str
    dtype: str
    value_map: tuple[tuple[str, int], ...] = ()


@dataclass(frozen=True)
class Variant:
    """A source layout: recognised by a column (case counts), with columns to rename."""

    name: str
    detect: str
    rename: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class QuerySpec:
    """A query by its raw SQL and its SQL over cubes, how their results are compared, and published times."""

    id: str
    raw: str
    rewritten: str
    compare: str = "exact"
    category: str = ""
    enabled: bool = True
    published_ms: float | None = None
    expected: dict = field(default_factory=dict)


def load_yaml(path: str | Path) -> dict:
    import yaml

    return yaml.safe_load(Path(path).read_text()) or {}


def entities_from(config: dict) -> dict[str, EntitySpec]:
    """Entities of a config by name: add_cols (patterns or regex on the file's name), unique_id, entity_id, primary_timestamp, fact_cols."""
    found = {}
    for e in config.get("entities", []):
        added = tuple(AddColumn(c["col"], tuple((c.get("patterns") or {}).items()), c.get("regex", ""), c.get("group", 1)) for c in e.get("add_cols", []))
        unique, time = e.get("unique_id") or {}, e.get("primary_timestamp") or {}
        facts = tuple(Fact(f["col"], f["dtype"]) for f in e.get("fact_cols", []))
        found[e["name"]] = EntitySpec(e["name"], added, unique.get("col", ""), unique.get("format", ""), (e.get("entity_id") or {}).get("col", "entity_id"), time.get("col", ""), facts)
    return found


def schema_from(config: dict) -> tuple[tuple[StandardColumn, ...], tuple[Variant, ...]]:
    """The standard columns of a config, with their value maps, and the source layouts in their order."""
    columns = tuple(StandardColumn(c["name"], c["dtype"], tuple((str(k), v) for k, v in (c.get("value_map") or {}).items())) for c in config.get("standard_columns", []))
    return columns, tuple(Variant(v["name"], v["detect_col"], tuple((v.get("rename") or {}).items())) for v in config.get("schema_mappings", []))


def cubes_from(config: dict, entity: str | None = None, only: list[str] | None = None) -> list[CubeSpec]:
    """The enabled cubes of a config with the keys name, entity, dimensions (column, transform, output_col), partitions and flags."""
    found = []
    for c in config.get("convolutions", config.get("cubes", [])):
        if not c.get("enabled", True) or (entity and c.get("entity", entity) != entity) or (only and c["name"] not in only):
            continue
        dims = tuple(Dim(d["col"], d.get("transform", "none"), d.get("output_col", "")) for d in c["dimensions"])
        parts = c.get("partitions") or []
        flags = {"keep_null_dims": c.get("keep_null_dims", False), "add_cardinality": c.get("add_cardinality_col", False), "add_hash": c.get("add_hash_col", False)}
        found.append(CubeSpec(c["name"], dims, c.get("bitmap_col", "entity_id"), parts[0]["col"] if parts else "", **flags))
    return found


def queries_from(config: dict, ids: list[str] | None = None) -> list[QuerySpec]:
    """The enabled queries of a benchmark config, or those named: sql is the raw form, the key that ends in _sql the one over cubes."""
    found = []
    for q in config.get("queries", []):
        if (q["id"] in ids) if ids else q.get("enabled", True):
            check = q.get("validation") or {}
            rewritten = next((v for k, v in q.items() if k.endswith("_sql")), q["sql"])
            found.append(QuerySpec(q["id"], q["sql"], rewritten, check.get("compare", "none"), q.get("category", ""), True, q.get("published_ms"), check.get("expected", {})))
    return found
