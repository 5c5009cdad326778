"""Line dedup with levelled sorted runs of line hashes. DataFrame functions only.

A store of runs counts, for each line key, the documents it was found in. A run is a table bucketed by the hashes and sorted in each bucket, so runs
are merged and joined bucket by bucket, without an exchange. Each batch of documents is merge-anti-joined with the runs: keys that a run already
has as often as it takes need no more counting. The others are added as one sorted run at level 0. When a level has FANOUT runs they are merged
into one run of the next level (compaction), so a corpus of n batches keeps O(log n) runs and each key is rewritten O(log n) times. Lines are
dropped by a merge anti-join of their hashes with the runs' frequent keys; before it those few keys that many lines have are dropped by a broadcast.

A line's key is the line without white space at both ends and with A-Z in lower case; it is held as 128 bits of hash. Empty keys are never
dropped. Null text is one empty line.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, staged

FANOUT = 2
#: Of the keys that are dropped, those with one of so many of all counts are broadcast; there are so many at most.
HOT = 10_000
_ROW = ["_cg_k1", "_cg_k2"]
_WHITE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(_WHITE))
    # lower() is quick but also changes other letters; a line of ASCII has none
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """The columns keys, and lines: (h1, h2) of each line in order, null for empty keys."""
    hashed = lambda k: F.when(k != "", F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(7), k).alias("h2")))
    return docs.select(*keys, F.transform(F.transform(_lines(F.col(text)), line_key), hashed).alias("lines"))


class LineRuns:
    """Sorted runs (h1, h2, n_docs) in levels, kept as bucketed tables in one folder; drop() forgets them.

    enough: documents from which on a key needs no more counting (None: all are counted).
    """

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = FANOUT, enough: int | None = None):
        self.spark, self.path, self.fanout, self.enough = spark, path or scratch(spark, "line-runs"), fanout, enough
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.written = 0

    def _write(self, counts: DataFrame, level: int) -> None:
        name = f"cellgrid_run_{uuid.uuid4().hex}"
        writer = counts.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("compression", "zstd")
        writer.option("path", f"{self.path}/level{level}-run{self.written}").saveAsTable(name)
        self.written += 1
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def add(self, lines: DataFrame) -> None:
        """Adds a batch: the column lines of line_hashes(). A key counts once for each row (document)."""
        keys = lines.select(F.explode(F.array_distinct("lines")).alias("h")).filter("h is not null")
        counts = keys.groupBy("h.h1", "h.h2").agg(F.count("*").alias("n_docs"))
        if self.enough is not None:
            for run in self._runs():
                counts = counts.join(run.filter(F.col("n_docs") >= self.enough).hint("merge"), ["h1", "h2"], "left_anti")
        self._write(counts, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            merged = self.levels[level]
            self._write(self._sum([self.spark.table(name) for name in merged]), level + 1)
            self.levels[level] = []
            self._forget(merged)
            level += 1

    @staticmethod
    def _sum(runs: list[DataFrame]) -> DataFrame:
        """Runs merged, two at a time by a join in the order of their keys: two runs need no exchange."""
        rows = runs[0]
        for r in runs[1:]:
            both = rows.join(r.withColumnRenamed("n_docs", "more").hint("merge"), ["h1", "h2"], "full")
            rows = both.select("h1", "h2", (F.coalesce("n_docs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n_docs"))
        return rows

    def frequent(self, min_docs: int) -> DataFrame:
        """h1, h2, n_docs of the keys found in at least min_docs documents of all batches (n_docs: as many as were counted)."""
        runs = self._runs()
        if not runs:
            return self.spark.createDataFrame([], "h1 long, h2 long, n_docs long")
        return self._sum(runs).filter(F.col("n_docs") >= min_docs)

    def counted(self) -> int:
        """All counts of all keys."""
        runs = self._runs()
        return (self._sum(runs).agg(F.sum("n_docs")).head()[0] or 0) if runs else 0

    def _forget(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def drop(self) -> None:
        """Takes the runs from the catalog; their files go with the scratch folder."""
        self._forget([name for level in self.levels for name in level])
        self.levels = []


def _marked(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """docs with _cg_k1, _cg_k2, which tell rows apart: 128 bits of hash over id and text."""
    return docs.withColumns({k: F.xxhash64(F.lit(i), F.col(doc_id), F.col(text)) for i, k in enumerate(_ROW)})


def _without(marked: DataFrame, lines: DataFrame, keys: DataFrame, counted: int, columns: list[str], text: str) -> DataFrame:
    """The rows without the lines whose hashes are in keys: an anti-join of hashes, then one join with the texts.

    Keys with one of HOT of all counts, HOT of them at most, are dropped by a broadcast first, so that no key brings many lines into one task of
    the merge anti-join.
    """
    hot = F.col("n_docs") * HOT >= counted
    found = lines.select(*_ROW, F.posexplode("lines").alias("at", "h"))
    keyed = found.filter("h is not null").select(*_ROW, "at", "h.h1", "h.h2")
    keyed = keyed.join(F.broadcast(keys.filter(hot).select("h1", "h2")), ["h1", "h2"], "left_anti")
    keyed = keyed.join(keys.filter(~hot).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti").select(*_ROW, "at")
    kept = keyed.unionByName(found.filter("h is null").select(*_ROW, "at")).groupBy(*_ROW).agg(F.sort_array(F.collect_set("at")).alias("_cg_kept"))
    split = marked.withColumn("_cg_all", _lines(F.col(text))).drop(text)
    # after the exchange the lines are a column of their own, so that each is found by its position at once
    joined = split.join(kept.hint("merge"), _ROW, "left").withColumn("_cg_kept", F.coalesce("_cg_kept", F.array().cast("array<int>")))
    new = F.array_join(F.transform("_cg_kept", lambda i: F.get(F.col("_cg_all"), i)), "\n")
    out = joined.select("*", new.alias(text), F.size("_cg_all").cast("long").alias("_cg_lines"), (F.size("_cg_all") - F.size("_cg_kept")).cast("long").alias("_cg_dropped"))
    return out.select(*[F.col(f"`{c}`") for c in columns], "_cg_lines", "_cg_dropped")


def without_frequent_lines(docs: DataFrame, min_docs: int = 10, batches: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with text rewritten, and two more columns _cg_lines, _cg_dropped: lines before and lines dropped.

    Keys found in at least min_docs documents (rows) lose all their lines in every document. A text of which nothing is left is empty. Rows are told
    apart by 128 bits of hash over id and text, so null ids and ids that several texts share don't matter; rows alike in both are each counted and get
    the same result. Batches are dealt by that hash. Each is merge-anti-joined with the runs and adds its own; as a line goes from all documents,
    those of earlier batches included, all lines are anti-joined with the runs once more in the end. Hashes and positions alone are exchanged for
    that; each text is exchanged once. An empty table gives no rows.
    """
    spark = docs.sparkSession
    marked = _marked(docs, doc_id, text)
    lines = line_hashes(marked, _ROW, text).withColumn("batch", F.pmod(_ROW[0], F.lit(batches)).cast("int"))
    path = scratch(spark, "line-hashes")
    lines.write.partitionBy("batch").option("compression", "zstd").parquet(path)
    stored = spark.read.schema(lines.schema).parquet(path)
    runs = LineRuns(spark, enough=min_docs)
    for b in range(batches):
        runs.add(stored.filter(F.col("batch") == b))  # reads the batch's folder alone
    keys, counted = staged(runs.frequent(min_docs), "frequent"), runs.counted()
    runs.drop()
    return _without(marked, stored, keys, counted, docs.columns, text)


def next_batch(docs: DataFrame, runs: LineRuns, min_docs: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For a corpus that comes in batches: docs without the lines that min_docs documents of earlier batches have; then docs' own lines are added to runs.

    Columns, nulls, repeated rows and empty tables as in without_frequent_lines.
    """
    marked = _marked(docs, doc_id, text)
    lines = staged(line_hashes(marked, _ROW, text), "line-hashes")
    seen, counted = staged(runs.frequent(min_docs), "seen"), runs.counted()
    runs.add(lines)
    return _without(marked, lines, seen, counted, docs.columns, text)
