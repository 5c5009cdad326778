"""Bitmap cells: a set of ids as one or more rows (cell key, bucket, bitmap), a bitmap for each bucket of 32,768 ids.

A bitmap is a struct of two forms, one of which is null. A set of fewer than SPARSE ids has its positions in the bucket, ascending, two bytes each; a
larger one has Spark's own bitmap of 4,096 bytes in bits. So a cell of one id takes two bytes, and the form follows from the set alone. Sets are
built and combined as words of 64 positions, (key, bucket, word, bits), by plain aggregates of numbers that run in compiled code with partial
aggregation; bitmaps of Spark's own form are or-ed as they are first. Ids beyond 32 bits are fine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET_BITS = 32768
BUCKET, BITMAP, CARDINALITY, HASH = "bucket", "bitmap", "cardinality", "bitmap_hash"
#: The ids from which on a set has Spark's own form, and positions of a word.
SPARSE, WORD = BUCKET_BITS // 16, 64
_WORD, _BITS = "_word", "_bits"
TYPE = "struct<positions:array<smallint>,bits:binary>"
#: A bitmap's ids, for SQL.
COUNT_SQL = "IF(bitmap.bits IS NULL, CAST(size(bitmap.positions) AS BIGINT), bitmap_count(bitmap.bits))"


def bucket_of(entity: Column) -> Column:
    """The bucket of an id; ids under 0 are an error, as they would share bucket 0 with id 0."""
    return F.when(entity < 0, F.raise_error(F.concat(F.lit("a bitmap can't hold the id "), entity.cast("string")))).otherwise(F.bitmap_bucket_number(entity))


def _word(position: Column) -> Column:
    return F.floor(position / WORD).cast("int")


def _bits(position: Column) -> Column:
    """The bit of a position in its word; a word's bytes from the highest on are those of Spark's bitmap."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), (56 - 8 * F.floor(F.pmod(position, F.lit(WORD)) / 8) + F.pmod(position, F.lit(8))).cast("int"))


def _positions_of(bits: Column) -> Column:
    """The positions in a word, ascending."""
    return F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda p: F.getbit(bits, (56 - 8 * F.floor(p / 8) + F.pmod(p, F.lit(8))).cast("int")) == 1)


def _number(hexed: Column) -> Column:
    return F.conv(hexed, 16, -10).cast("bigint")


def _of(bitmap: Column | str) -> tuple[Column, Column]:
    m = F.col(bitmap) if isinstance(bitmap, str) else bitmap
    return m["positions"], m["bits"]


def _dense_words(bits: Column) -> Column:
    """word, bits of Spark's own bitmap."""
    return F.transform(F.sequence(F.lit(0), F.lit(BUCKET_BITS // WORD - 1)), lambda i: F.struct(i.alias("word"), _number(F.hex(F.substring(bits, i * 8 + 1, F.lit(8)))).alias("bits")))


def words(cells: DataFrame, keys: list) -> DataFrame:
    """keys, bucket, _word, _bits of cells; a word may come in several rows."""
    positions, bits = _of(BITMAP)
    few = cells.filter(positions.isNotNull()).select(*keys, BUCKET, F.explode(positions.cast("array<int>")).alias("_at"))
    many = cells.filter(bits.isNotNull()).groupBy(*keys, BUCKET).agg(F.bitmap_or_agg(bits).alias("_all")).select(*keys, BUCKET, F.explode(_dense_words(F.col("_all"))).alias("_w"))
    few = few.select(*keys, BUCKET, _word(F.col("_at")).alias(_WORD), _bits(F.col("_at")).alias(_BITS))
    return few.unionByName(many.select(*keys, BUCKET, F.col("_w.word").alias(_WORD), F.col("_w.bits").alias(_BITS)).filter(F.col(_BITS) != 0))


def _cells(distinct_words: DataFrame, keys: list) -> DataFrame:
    """keys, bucket, bitmap, cardinality, from words that come once each."""
    n = F.sum(F.bit_count(_BITS)).alias(CARDINALITY)
    rows = distinct_words.groupBy(*keys, BUCKET).agg(F.array_sort(F.collect_list(F.struct(_WORD, _BITS))).alias("_words"), n)
    few = F.flatten(F.transform("_words", lambda w: F.transform(_positions_of(w[_BITS]), lambda p: (w[_WORD] * WORD + p).cast("smallint"))))
    by_word = F.map_from_entries("_words")
    hexed = F.transform(F.sequence(F.lit(0), F.lit(BUCKET_BITS // WORD - 1)), lambda i: F.lpad(F.hex(F.coalesce(F.try_element_at(by_word, i), F.lit(0).cast("bigint"))), 16, "0"))
    sparse = F.col(CARDINALITY) < SPARSE
    bitmap = F.struct(F.when(sparse, few).alias("positions"), F.when(~sparse, F.unhex(F.array_join(hexed, ""))).alias("bits"))
    return rows.select(*keys, BUCKET, bitmap.alias(BITMAP), CARDINALITY)


def build(rows: DataFrame, keys: list[str], entity: str) -> DataFrame:
    """The cells of rows by keys: keys, bucket, bitmap, cardinality."""
    id_ = F.col(entity).cast("bigint")
    at = F.bitmap_bit_position(id_)
    found = rows.groupBy(*keys, bucket_of(id_).alias(BUCKET), _word(at).alias(_WORD)).agg(F.bit_or(_bits(at)).alias(_BITS))
    return _cells(found, keys)


def count(bitmap: Column | str) -> Column:
    """Ids in a bitmap; 0 for null."""
    positions, bits = _of(bitmap)
    return F.when(bits.isNotNull(), F.bitmap_count(bits)).when(positions.isNotNull(), F.size(positions).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def stable_hash(bitmap: Column | str) -> Column:
    """A hash that is the same in every run, and for equal sets of a bucket."""
    return F.xxhash64(bitmap)


def _united(cells: DataFrame, keys: list) -> DataFrame:
    return words(cells, keys).groupBy(*keys, BUCKET, _WORD).agg(F.bit_or(_BITS).alias(_BITS))


def union(cells: DataFrame, keys: list) -> DataFrame:
    """Cells rolled up to keys: an id in several cells counts once."""
    return _cells(_united(cells, keys), keys)


def intersect(cells: DataFrame, keys: list, of: Column | str, n: int) -> DataFrame:
    """For each key the ids in all n values of the column of; a bucket that they share no id in is left out."""
    each = _united(cells, [*keys, of])
    both = each.groupBy(*keys, BUCKET, _WORD).agg(F.bit_and(_BITS).alias(_BITS), F.count("*").alias("_sides"))
    return _cells(both.filter((F.col("_sides") == n) & (F.col(_BITS) != 0)).drop("_sides"), keys)


def cardinality(cells: DataFrame, keys: list, name: str = "cnt") -> DataFrame:
    """Ids of each key's set, from cells that don't overlap in a bucket."""
    own = F.col(CARDINALITY) if CARDINALITY in cells.columns else count(BITMAP)
    return cells.groupBy(*keys).agg(F.sum(own).alias(name))


def bucket_ids(bucket: Column | str, bitmap: Column | str) -> Column:
    """The ids of one bucket's bitmap, ascending; none for null."""
    b = F.col(bucket) if isinstance(bucket, str) else bucket
    positions, bits = _of(bitmap)
    dense = F.flatten(F.transform(_dense_words(bits), lambda w: F.transform(_positions_of(w["bits"]), lambda p: w["word"] * WORD + p)))
    at = F.coalesce(F.when(bits.isNotNull(), dense).otherwise(positions.cast("array<int>")), F.array().cast("array<int>"))
    # buckets begin with 1, but for bucket 0, which has id 0 alone
    return F.transform(at, lambda p: p + F.when(b == 0, F.lit(0).cast("bigint")).otherwise((b - 1) * BUCKET_BITS + 1))


def to_array(cells: DataFrame, keys: list, name: str = "ids") -> DataFrame:
    """Each key's ids, ascending."""
    rows = cells.select(*keys, BUCKET, bucket_ids(BUCKET, BITMAP).alias("_ids"))
    return rows.groupBy(*keys).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(BUCKET, "_ids"))), lambda s: s["_ids"])).alias(name))


def chunk(ids: Column | str, start: int, size: int) -> Column:
    """A page of an id array: a negative start is 0, a size under 1 is 1, null is empty."""
    return F.slice(F.coalesce(F.col(ids) if isinstance(ids, str) else ids, F.array().cast("array<bigint>")), max(start, 0) + 1, max(size, 1))


def containing(cells: DataFrame, entity: int) -> DataFrame:
    """The cells that hold an id: their bucket is looked at alone, and its bit or its position tested in place."""
    id_ = F.lit(entity).cast("bigint")
    at = F.bitmap_bit_position(id_)
    positions, bits = _of(BITMAP)
    byte = F.conv(F.hex(F.substring(bits, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.when(bits.isNotNull(), F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1).otherwise(F.array_contains(positions, at.cast("smallint")))
    return cells.filter(F.col(BUCKET) == F.bitmap_bucket_number(id_)).filter(held)
