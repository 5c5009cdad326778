"""Secret scans: known formats by pattern, and strings of high entropy. DataFrame functions only, a projection without exchange.

Base kinds are matched leftmost and without overlap, each kind alone. The method's own kind, `entropy`, takes candidate strings (runs of
the characters of keys, at least WINDOW long, with letters and digits), slides a window of WINDOW characters over each, and flags those whose
window of highest Shannon entropy reaches the bound of its character class. The window's character counts are carried from step to step, and with
them the sum of c * log2(c): only the counts of the entering and the leaving character change. So the time is in proportion to a candidate's length.
An allow-list suppresses what is known to be harmless.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import once

# The patterns of the base kinds and the least length of what must be long (group 2 for assign, else the whole match).
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
}
#: What is scanned for, where that finds the same and takes less time: runs too short for a match are passed over.
_SCANNED = {"access": r"AKIA[A-Z0-9]{12,}", "hex": r"[0-9a-f]{32,}"}

WINDOW = 20
#: Bits per character that a window of a class must reach. A class is the set of a candidate's characters.
BOUNDS = {"hex": 3.0, "alnum": 3.6, "base64": 3.8}
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
# Shapes that are no secrets: UUIDs, dates and times, digits alone, words joined by - or _ or /, placeholders.
WORDS = r"^[A-Za-z]+[0-9]{0,4}([-_/][A-Za-z]*[0-9]{0,4})*$"
ALLOWED = [r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", r"^[0-9_/=+-]+$", WORDS, r"(?i)example|placeholder|changeme|xxxx|0000000|1234567"]


def _span(kind: str, start: Column, end: Column) -> Column:
    order = [*BASE, "entropy"].index(kind)
    return F.struct(start.alias("start"), F.lit(order).alias("order"), end.alias("end"))


_SPANS = "array<struct<start:int,order:int,end:int>>"
#: Matches whose places are summed up at once.
_BLOCK = 256


def _spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """start (code points) and end of each match that is long enough. The pieces between matches give the places; they are made only for texts with a match."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    wanted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["piece"])
        end = start + F.length(x["match"])
        return F.struct(end.alias("at"), F.when(F.length(x["wanted"]) >= least, F.concat(acc["out"], F.array(_span(kind, start, end)))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))

    def moved(acc: Column, block: Column) -> Column:
        out = F.transform(block["out"], lambda x: F.struct((x["start"] + acc["at"]).alias("start"), x["order"], (x["end"] + acc["at"]).alias("end")))
        return F.struct((acc["at"] + block["at"]).alias("at"), F.concat(acc["out"], F.array(out)).alias("out"))

    # places are summed up within blocks of matches, then over the blocks, as each step copies what it has put out so far
    parts = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches)).alias("piece"), matches.alias("match"), wanted.alias("wanted"))
    blocks = once(parts, lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / _BLOCK).cast("int")), lambda i: F.aggregate(F.slice(p, i * _BLOCK + 1, _BLOCK), start, step)))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPANS}>").alias("out"))
    return F.when(F.size(matches) == 0, F.array().cast(_SPANS)).otherwise(F.flatten(F.aggregate(blocks, begin, moved, lambda acc: acc["out"])))


def entropy(value: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits a character, of a window of value (of a candidate's characters); of all of it where that is shorter."""
    slots, first = ord("z") - ord("+") + 1, ord("+")
    codes = F.slice(F.transform(F.split(value, ""), lambda c: F.pmod(F.ascii(c) - first, F.lit(slots))), F.lit(1), F.length(value))
    # terms of counts from 0 to window
    term = lambda n: F.get(F.lit([0.0] + [c * log2(c) for c in range(1, window + 2)]), n)

    def step(acc: Column, e: Column) -> Column:
        n = F.get(acc["counts"], e["slot"])
        counts = F.concat(F.slice(acc["counts"], F.lit(1), e["slot"]), F.array(n + e["d"]), F.slice(acc["counts"], e["slot"] + 2, slots))
        total = acc["sum"] + term(n + e["d"]) - term(n)
        return F.struct(counts.alias("counts"), total.alias("sum"), F.when(e["whole"], F.least(acc["least"], total)).otherwise(acc["least"]).alias("least"))

    def least(c: Column) -> Column:
        gone = F.slice(F.concat(F.array_repeat(F.lit(None).cast("int"), window), c), F.lit(1), F.size(c))
        steps = F.zip_with(gone, c, lambda out, come: F.struct(out.alias("gone"), come.alias("come")))
        width = F.least(F.size(c), F.lit(window))
        events = F.flatten(F.transform(steps, lambda x, i: F.array(F.struct(x["gone"].alias("slot"), F.lit(-1).alias("d"), F.lit(False).alias("whole")), F.struct(x["come"].alias("slot"), F.lit(1).alias("d"), (i + 1 >= width).alias("whole")))))
        state = F.struct(F.array_repeat(F.lit(0), slots).alias("counts"), F.lit(0.0).alias("sum"), F.lit(float("inf")).alias("least"))
        return F.aggregate(F.filter(events, lambda e: e["slot"].isNotNull()), state, step, lambda acc: F.log2(width) - acc["least"] / width)

    return F.when(F.length(value) > 0, once(codes, least)).otherwise(0.0)


def suspicious(value: Column) -> Column:
    """Whether a candidate string looks like a secret: letters and digits, not allowed, and of its class's entropy."""
    bound = F.when(F.rlike(value, F.lit("^([0-9a-f]+|[0-9A-F]+)$")), BOUNDS["hex"]).when(F.rlike(value, F.lit("^[A-Za-z0-9]+$")), BOUNDS["alnum"]).otherwise(BOUNDS["base64"])
    mixed = F.rlike(value, F.lit("[0-9]")) & F.rlike(value, F.lit("[A-Za-z]"))
    # the words of the allow-list, said without a repeated group, as the engine would recurse once for each word
    words = F.rlike(value, F.lit("^[A-Za-z][A-Za-z0-9_/-]*$")) & ~F.rlike(value, F.lit("[0-9][A-Za-z]|[0-9]{5}"))
    others = F.rlike(value, F.lit("|".join(f"(?:{p})" for p in ALLOWED if p != WORDS)))
    return mixed & ~words & ~others & (entropy(value) >= bound)


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in [*BASE, "entropy"]])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["order"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns _cg_assign, _cg_access, _cg_hex, _cg_entropy: arrays of (start, order, end), in code points, end exclusive.

    Null text is empty. A string of high entropy that overlaps a base span is not given again.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    base = {kind: _spans(value, kind, _SCANNED.get(kind, pattern), group, least) for kind, (pattern, group, least) in BASE.items()}
    found = docs.withColumns({f"_cg_{k}": v for k, v in base.items()})
    candidates = _spans(value, "entropy", CANDIDATE, 0, WINDOW)
    taken = F.concat(*[F.col(f"_cg_{k}") for k in BASE])
    free = F.filter(candidates, lambda s: suspicious(value.substr(s["start"] + 1, s["end"] - s["start"])) & ~F.exists(taken, lambda t: (t["start"] < s["end"]) & (s["start"] < t["end"])))
    return found.withColumn("_cg_entropy", free)


def digest(docs: DataFrame) -> DataFrame:
    """The query's rows: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy. Rows with null or repeated ids are kept each."""
    found = scanned(docs.select("doc_id", "text"))
    base = F.concat(*[F.col(f"_cg_{k}") for k in BASE])
    counts = [F.size(f"_cg_{k}").cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.concat(base, "_cg_entropy")).alias("spans"), F.size("_cg_entropy").cast("long").alias("n_entropy"))
