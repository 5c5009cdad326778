"""Timing of queries, their check, reports of speed and cost."""

from __future__ import annotations

import contextlib
import csv
import os
import re
import statistics
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .compare import Outcome, compare
from .specs import QuerySpec

HOURS_A_MONTH = 730


@dataclass
class TimerLog:
    """Named durations, kept in order, written as CSV."""

    rows: list[tuple[str, float]] = field(default_factory=list)

    @contextlib.contextmanager
    def timed(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.rows.append((name, time.perf_counter() - began))

    def append(self, spark: SparkSession, path: str, scope: str = "") -> None:
        """Adds the durations to a folder of CSV files, in any file system: timestamp, step, scope, seconds."""
        now = datetime.now(timezone.utc).isoformat()
        rows = [(now, name, scope, round(seconds, 3)) for name, seconds in self.rows]
        spark.createDataFrame(rows, "timestamp string, step string, scope string, seconds double").coalesce(1).write.mode("append").option("header", True).csv(path)

    def write(self, path: str) -> None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        with open(path, "w", newline="") as f:
            csv.writer(f).writerows([("step", "seconds"), *((n, f"{s:.3f}") for n, s in self.rows)])


def run_query(make: Callable[[], DataFrame], iterations: int = 5, best: str = "median") -> tuple[float, list]:
    """Milliseconds (upper median, or minimum) of full fetches, and the rows. For results of report size."""
    times, rows = [], []
    for _ in range(max(1, iterations)):
        began = time.perf_counter()
        rows = make().collect()
        times.append((time.perf_counter() - began) * 1000)
    return (min(times) if best == "min" else statistics.median_high(times)), rows


def tables_of(sql: str, prefix: str = "conv_") -> set[str]:
    """The cubes and the facts that a query reads."""
    return set(re.findall(rf"(?i)\b(?:from|join)\s+({re.escape(prefix)}\w+|facts)\b", sql))


def meets(expected: dict, rows: list) -> bool:
    """Whether each key's count is at least the expected one."""
    have = {str(r[0]): r[-1] for r in rows}
    return all(have.get(str(k), 0) >= v for k, v in expected.items())


def run_benchmark(spark: SparkSession, specs: list[QuerySpec], iterations: int = 5, check: bool = True, report: str | None = None, best: str = "median") -> list[dict]:
    """Times each spec's rewritten query over the views that are registered, and compares it with the raw one. Mismatches are written to report."""
    found = []
    for q in specs:
        ms, rows = run_query(lambda q=q: spark.sql(q.rewritten), iterations, best)
        outcome = compare(spark.sql(q.raw), spark.sql(q.rewritten), q.compare) if check else Outcome(True, (-1, -1), [], [])
        if not outcome.same and report:
            Path(report).parent.mkdir(parents=True, exist_ok=True)
            with open(report, "a") as f:
                f.write(f"{q.id}\n{outcome.report()}\n")
        found.append({"query_id": q.id, "category": q.category, "ms": round(ms, 3), "rows": len(rows), "validated": outcome.same, "expected_met": meets(q.expected, rows), "published_ms": q.published_ms})
    return found


def write_results(rows: list[dict], path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", newline="") as f:
        w = csv.DictWriter(f, fieldnames=list(rows[0]) if rows else ["query_id"])
        w.writeheader()
        w.writerows(rows)


def consolidated(results: list[dict], month_cost: float | None = None, other_month_cost: float | None = None) -> list[dict]:
    """Each result with speedup and delta_ms against its published time, a verdict, and what the two machines' prices say."""
    out = []
    for r in results:
        p, ms = r.get("published_ms"), r["ms"]
        speedup = round(p / ms, 1) if p and ms else None
        verdict = "n/a" if speedup is None else "faster" if speedup > 1 else "slower" if speedup < 1 else "equal"
        gap = "" if not month_cost or not other_month_cost else f"{abs(1 - month_cost / other_month_cost):.0%} {'cheaper' if month_cost < other_month_cost else 'dearer'}"
        years = 12 * (other_month_cost - month_cost) if month_cost and other_month_cost else None
        said = framing(verdict == "faster", speedup, ms - p, years) if speedup is not None else ""
        out.append(r | {"speedup": speedup, "delta_ms": round(ms - p, 3) if p else None, "verdict": verdict, "price_gap": gap, "framing": said})
    return out


def cost_summary(name: str, found: list[dict], own_month: float | None = None, other_month: float | None = None) -> dict:
    """One row: the machines' prices by month and year, the gap of a year, and how many queries are faster and slower."""
    year = lambda month: None if month is None else round(month * 12, 2)
    gap = round(12 * (other_month - own_month), 2) if own_month is not None and other_month is not None else None
    count = lambda verdict: sum(r["verdict"] == verdict for r in found)
    prices = {"own_month_usd": own_month, "own_year_usd": year(own_month), "other_month_usd": other_month, "other_year_usd": year(other_month), "gap_year_usd": gap}
    return {"benchmark_id": name, **prices, "faster": count("faster"), "slower": count("slower")}


def framing(faster: bool, speedup: float, delta_ms: float, gap_year: float | None) -> str:
    """What a result says about speed and price; gap_year: what the other machine costs more in a year."""
    speed = f"{speedup:.1f}x faster" if faster else f"{delta_ms:,.0f} ms slower"
    if gap_year is None:
        return speed
    if gap_year >= 0:
        return f"{speed}; {'saves' if faster else 'matching it costs'} ${gap_year:,.0f} a year"
    return f"{speed}; the machine costs ${-gap_year:,.0f} a year more"


def month_cost(usd_per_hour: float) -> float:
    return round(usd_per_hour * HOURS_A_MONTH, 2)


def cores_of(machine: str, known: dict[str, int] | None = None, explicit: int | None = None) -> str:
    """A machine's cores: as given, from its text (`32 vCPU`, `16 threads`), from a table of types, else `?`."""
    if explicit:
        return str(explicit)
    if m := re.search(r"(\d+)\s*[- ]?(?:v?cpus?|cores?|threads?)", machine, re.I):
        return m[1]
    return next((str(n) for name, n in (known or {}).items() if name in machine), "?")


def fits_memory(bytes_needed: int, already: int = 0, share: float = 0.8) -> bool:
    """Whether a table may be cached: what is cached stays under a share of the free memory."""
    free = os.sysconf("SC_AVPHYS_PAGES") * os.sysconf("SC_PAGE_SIZE")
    return already + bytes_needed < share * free
