"""Document fingerprints: a Merkle tree over sections, paragraphs and blocks of a text. DataFrame functions only.

Sections end at an empty line, paragraphs at a line end; a paragraph's leaves are its blocks of LEAF code points, counted from its start (of
FINE in the first LEAF, for short ones), so an edit changes the leaves from there to the end of its paragraph and no others. A node's hash is the md5 of its children's, with a letter for
its level. A fingerprint is `root|tags`: the root tests equality; the tags (first digits of the leaves' hashes, `;` after a paragraph, `/`
after a section) tell which branches differ. Tags have 32 bits: of n leaves of an unlike text n / 2**32 are alike by chance, 0.00001 of them in
texts of a million code points; a changed leaf is overlooked with a probability of 2**-32.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import once

LEAF, FINE, TAG = 32, 8, 8


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text; null counts as empty."""
    blocks = lambda p, n: F.regexp_extract_all(p, F.lit(f"(?s).{{1,{n}}}"), F.lit(0))
    leaves = lambda p: F.transform(F.concat(blocks(F.left(p, F.lit(LEAF)), FINE), blocks(F.substring(p, LEAF + 1, 1 << 30), LEAF)), F.md5)
    tree = F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n", -1), lambda s: F.transform(F.split(s, "\n", -1), leaves))
    paragraph = lambda p: F.md5(F.concat(F.lit("p"), F.array_join(p, "")))
    section = lambda s: F.md5(F.concat(F.lit("s"), F.array_join(F.transform(s, paragraph), "")))
    tags = lambda s: F.array_join(F.transform(s, lambda p: F.array_join(F.transform(p, lambda leaf: F.substring(leaf, 1, TAG)), "")), ";")
    return once(tree, lambda t: F.concat(F.md5(F.concat(F.lit("r"), F.array_join(F.transform(t, section), ""))), F.lit("|"), F.array_join(F.transform(t, tags), "/")))


def _leaves(fp: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.substring_index(fp, "|", -1), F.lit(f"[0-9a-f]{{{TAG}}}"), F.lit(0)))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints, else the share of distinct leaves that both have (Dice), 0 where neither has any."""
    dice = lambda p: F.when(F.size(p["a"]) + F.size(p["b"]) == 0, 0.0).otherwise(2.0 * F.size(F.array_intersect(p["a"], p["b"])) / (F.size(p["a"]) + F.size(p["b"])))
    return F.when(a == b, 1.0).otherwise(once(F.struct(_leaves(a).alias("a"), _leaves(b).alias("b")), dice))


def differing_branches(a: Column, b: Column) -> Column:
    """Where two fingerprints differ: (section, paragraph), from 0, of each paragraph whose leaves aren't the same."""
    sections = lambda fp: F.split(F.substring_index(fp, "|", -1), "/", -1)
    pairs = F.zip_with(sections(a), sections(b), lambda x, y: F.zip_with(F.split(F.coalesce(x, F.lit("")), ";", -1), F.split(F.coalesce(y, F.lit("")), ";", -1), lambda p, q: p.eqNullSafe(q)))
    found = F.flatten(F.transform(pairs, lambda s, i: F.transform(s, lambda same, j: F.struct(i.alias("section"), j.alias("paragraph"), same.alias("same")))))
    return F.transform(F.filter(found, lambda x: ~x["same"]), lambda x: F.struct(x["section"], x["paragraph"]))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, fingerprint, given, next_fingerprint: with what the next document by descending doc_id gives (its first code points, as many as are taken, and its
    fingerprint); the last one's next is the first.

    Ids alone are sorted (by ranges, then in each range; a row for each range joins the ends), so no task sees all rows. Texts are exchanged
    once by doc_id, and the parts of them that the next rows need once more. Rows with a null doc_id come after all others: the first
    document is their next, and they are nobody's. Rows that share a doc_id have the same next, and the least of their texts is what the row
    before them sees.
    """
    from pyspark.sql import Window

    from .common import staged

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("copies"), F.max(F.length("text")).alias("n"))
    ids = staged(ids.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()), "ids")
    ends = ids.groupBy("part").agg(F.max("doc_id").alias("top"))
    last = ids.agg(F.max("doc_id").alias("top"))
    before = ends.select("part", F.lag("top").over(Window.orderBy("part")).alias("below"))  # a row for each output partition
    in_part = Window.partitionBy("part").orderBy("doc_id")
    chain = ids.withColumn("prev", F.lag("doc_id").over(in_part)).join(F.broadcast(before), "part").crossJoin(F.broadcast(last))
    chain = chain.select("doc_id", "copies", "n", F.coalesce("prev", "below", "top").alias("next_id"))
    # what a document must give: the most that the one before it takes
    takes = chain.select(F.col("next_id").alias("doc_id"), F.floor(F.col("n") / 3).cast("int").alias("takes"), F.col("doc_id").alias("for_id"))
    repeated = ids.filter("copies > 1").limit(1).count() > 0
    known = docs.filter("doc_id is not null")
    first_of = known.groupBy("doc_id").agg(F.min("text").alias("text")) if repeated else known
    # fingerprints are made behind the exchange that serves both sides, twice each, as they are a quarter of the texts' size
    given = first_of.join(takes, "doc_id").select(F.col("for_id").alias("doc_id"), F.col("text").substr(F.lit(1), F.col("takes")).alias("given"), fingerprint(F.col("text")).alias("next_fingerprint"))
    rows = known.join(given, "doc_id").select("doc_id", "text", fingerprint(F.col("text")).alias("fingerprint"), "given", "next_fingerprint")
    unknown = docs.filter("doc_id is null")
    if unknown.limit(1).count():
        top = docs.join(F.broadcast(last), F.col("doc_id") == F.col("top")).agg(F.min("text").alias("top_text"))
        text = F.coalesce("top_text", "text")
        rows = rows.unionByName(unknown.crossJoin(F.broadcast(top)).select("doc_id", "text", fingerprint(F.col("text")).alias("fingerprint"), text.alias("given"), fingerprint(text).alias("next_fingerprint")))
    return rows


def fingerprinted(docs: DataFrame) -> DataFrame:
    """The query's rows: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n_chars / 3) code points replaced by as many first ones of the next document's text (or
    all of it). An empty table gives no rows.
    """
    rows = with_next(docs)
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - cut), F.col("given").substr(F.lit(1), cut))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), once(edited, lambda e: F.struct(F.sha2(e, 256).alias("sha"), fingerprint(e).alias("fp"))).alias("edited"), "fingerprint", "next_fingerprint")
    return rows.select(
        "doc_id", "n_chars", F.col("edited.sha").alias("edited_sha256"), "fingerprint", F.col("edited.fp").alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited.fp")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
