"""Near-duplicate documents by MinHash and an LSH forest, links confirmed on full shingle sets.

1. Each text gives its set of word shingles, a 128-bit hash of the set, and its MinHash signature. Documents of equal sets are one class; from
   here on the class stands for them, under its smallest doc_id.
2. The forest has TREES trees; a class's key in a tree is DEPTH labels of its signature. A tree is its classes in the order of their keys, so
   those with the longest common prefixes are neighbours: where few are alike a short prefix (MIN_DEPTH) will do, in crowded regions neighbours
   share a longer one. Each class is compared with the WIDTH before it in every tree: no group is ever expanded into its pairs.
3. Neighbours whose sizes and signature bits allow the similarity are candidates; those are confirmed on the full sets of their texts.
4. A first round over FIRST_TREES trees links most copies; components are built, and the second round over all trees leaves out pairs that are
   connected already, so large groups of copies cost no more than a few links for each member.
5. In a crowded region (classes that share MIN_DEPTH labels, more of them than a class is compared with) a text may be alike to one that stands
   further off, and in one that the edge between two partitions cuts, to one beyond it. So the classes of such regions are joined exactly, by
   prefixes: sets that are alike share one of the rarest shingles of each. Those that share one, are of two components and can be alike by their
   sizes, the shingle's places in them and bitmaps of them are candidates. So each pair that shares MIN_DEPTH labels in any tree is compared.

A pair at the threshold shares MIN_DEPTH labels of a tree with probability 0.8**3, and so is missed in all 20 trees with probability 6e-7 (and
by its bits with 5e-8), if it isn't reached by way of other copies anyway; tests hold the result against brute force.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import textvec
from .common import small_enough, staged

TREES, DEPTH, MIN_DEPTH, WIDTH = 20, 6, 3, 4
FIRST_TREES = 3
#: Of the TREES * DEPTH signature bits, so many may differ in a candidate (32 of 120): 0.1 do at the similarity 0.8, and more than that with a probability of 5e-8.
BITS_APART = 0.267
#: Ids, and crowded regions or long lists, up to which their table is broadcast; beyond it, it is joined by exchange.
BROADCAST_IDS, BROADCAST_LISTS = 500_000, 200_000
#: Counters (a power of two) by which shingles are ordered, bits of a set's bitmap, and the rows of a shingle's list that a task takes as one block.
COUNTERS, BITMAP, LIST_ROWS = 1 << 21, 256, 512

_PERMUTATIONS = TREES * DEPTH
_FACTORS = textvec.stream(_PERMUTATIONS, 3) | np.uint64(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least of each permuted hash of a set."""
    least = np.full(_PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 2048):
        np.minimum(least, (shingles[i : i + 2048, None] * _FACTORS).min(axis=0), out=least)
    return textvec.mixed(least)


def _signed(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, one, two, keys, bits = [], [], [], [], []
            for i in range(0, len(b), 200):
                buf, offsets = textvec.text_bytes(b.column(1).slice(i, 200))
                for s in textvec.shingles(buf, offsets, n):
                    sizes.append(len(s))
                    one.append(textvec.mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64))
                    two.append(textvec.mixed(s + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64).astype(np.int64))
                    sig = signature(s)
                    keys.append((sig & np.uint64(0xFFFF)).astype(">u2").tobytes())
                    bits.append(np.packbits((sig >> np.uint64(40)).astype(np.uint8) & 1).tobytes())
            columns = [b.column(0), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(keys, pa.binary()), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "s1", "s2", "keys", "bits"])

    return run


def _neighbours(percent: int, width: int):
    """Candidates (a, b) among rows in the order of (tree, key): each row with the width before it.

    A region that a partition's edge may cut is told by rows (a, null, region, side): its rows at the start (side 0) and at the end (1) of the partition.
    """
    popcount = np.array([bin(i).count("1") for i in range(256)], np.uint8)
    apart = int(BITS_APART * _PERMUTATIONS)

    def told(a, b, region=None, side=None) -> pa.RecordBatch:
        columns = [pa.array(a, pa.int64()), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b, pa.int64())]
        columns += [pa.nulls(len(a), pa.int64()) if v is None else pa.array(np.full(len(a), v)) for v in (region, side)]
        return pa.RecordBatch.from_arrays(columns, names=["a", "b", "region", "side"])

    def edge(rows, at: int, side: int) -> pa.RecordBatch:
        tree, key, node = rows[:3]
        same = (tree == tree[at]) & (key == key[at]).all(axis=1)
        return told(node[same], None, xxhash.xxh3_64_intdigest(bytes([tree[at]]) + key[at].tobytes()) >> 1, side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = head = None
        for b in batches:
            if not len(b):
                continue
            fixed = lambda name, w: textvec.text_bytes(b.column(b.schema.get_field_index(name)))[0].reshape(-1, w)  # noqa: B023, E731
            plain = lambda name: b.column(b.schema.get_field_index(name)).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            rows = [plain("tree"), fixed("key", 2 * DEPTH)[:, : 2 * MIN_DEPTH], plain("node"), plain("n_shingles"), fixed("bits", _PERMUTATIONS // 8), plain("comp")]
            held = 0
            if head is None or len(head[0]) < width:
                head = [r[:width] for r in rows] if head is None else [np.concatenate([c, r])[:width] for c, r in zip(head, rows, strict=True)]
            if carry is not None:
                held = len(carry[0])
                rows = [np.concatenate([c, r]) for c, r in zip(carry, rows, strict=True)]
            tree, key, node, size, bits, comp = rows
            a, c = [], []
            for j in range(1, min(width, len(tree) - 1) + 1):
                i = np.arange(max(j, held), len(tree))
                i = i[(tree[i] == tree[i - j]) & (comp[i] != comp[i - j]) & (100 * np.minimum(size[i], size[i - j]) >= percent * np.maximum(size[i], size[i - j]))]
                i = i[(key[i] == key[i - j]).all(axis=1)]
                i = i[popcount[bits[i] ^ bits[i - j]].sum(axis=1) <= apart]
                a.append(np.minimum(node[i], node[i - j]))
                c.append(np.maximum(node[i], node[i - j]))
            if a and sum(map(len, a)):
                pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(c)]), axis=1)
                yield told(pairs[0], pairs[1])
            carry = [r[-width:] for r in rows]
        if carry is not None:
            yield edge(head, 0, 0)
            yield edge(carry, -1, 1)

    return run


def _candidates(nodes: DataFrame, trees: int, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The forest's pairs (a, b), and the nodes of regions that are cut by an edge between two partitions."""
    rows = nodes.select(F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), "keys", "node", "n_shingles", "bits", "comp")
    rows = rows.select("tree", F.substring("keys", F.col("tree") * 2 * DEPTH + 1, F.lit(2 * DEPTH)).alias("key"), "node", "n_shingles", "bits", "comp")
    # the node ends the sort key, so that a prefix that many share still spreads over partitions
    in_order = rows.repartitionByRange("tree", "key", "node").sortWithinPartitions("tree", "key", "node")
    found = staged(in_order.mapInArrow(_neighbours(percent, width), "a long, b long, region long, side long"), "neighbours")
    edges = found.filter("b is null").select(F.col("a").alias("node"), "region", "side")
    cut = edges.groupBy("region").agg(F.min("side").alias("low"), F.max("side").alias("high")).filter("low < high").select("region")
    return found.filter("b is not null").select("a", "b").distinct(), edges.join(F.broadcast(cut), "region").select("node").distinct()  # two regions a partition


def _crowded(nodes: DataFrame) -> DataFrame:
    """node, comp of the classes in a region (of any tree) that has more classes than one is compared with, and of two components at least."""
    own = nodes.select("node", "comp", "keys", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    own = own.select("node", "comp", "tree", F.substring("keys", F.col("tree") * 2 * DEPTH + 1, F.lit(2 * MIN_DEPTH)).alias("region"))
    full = own.groupBy("tree", "region").agg(F.count("*").alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    full = staged(full.filter((F.col("n") > WIDTH + 1) & (F.col("low") < F.col("high"))).select("tree", "region"), "regions")
    return own.join(F.broadcast(full) if small_enough(full, BROADCAST_LISTS) else full, ["tree", "region"]).select("node", "comp").distinct()


_COUNTER_SHIFT = np.uint64(64 - COUNTERS.bit_length() + 1)


def _shingle_counts(n: int):
    """In how many texts shingles are, by counters that a shingle's first bits pick."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for b in batches:
            for i in range(0, len(b), 200):
                for s in textvec.shingles(*textvec.text_bytes(b.column(0).slice(i, 200)), n):
                    np.add.at(total, (s >> _COUNTER_SHIFT).astype(np.int64), 1)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 100_000]), pa.array(total[at[i : i + 100_000]])], names=["counter", "n"])

    return run


def _prefixes(shared, n: int, percent: int):
    """The rarest shingles of each text, so many that a text alike to it shares one of them, each with its place in the order of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for b in batches:
            for i in range(0, len(b), 200):
                part = b.slice(i, 200)
                at, shingle, place, size, bitmap = [], [], [], [], []
                for k, s in enumerate(textvec.shingles(*textvec.text_bytes(part.column(2)), n)):
                    if not len(s):
                        continue
                    often = counts[(s >> _COUNTER_SHIFT).astype(np.int64)]
                    take = np.lexsort((s, often))[: len(s) + (-percent * len(s)) // 100 + 1]
                    odd = np.bincount((textvec.mixed(s) % np.uint64(BITMAP)).astype(np.int64), minlength=BITMAP) & 1
                    q = np.flatnonzero(often[take] > 1)  # what one text has alone no other shares
                    at.append(np.full(len(q), k))
                    shingle.append(s[take[q]].view(np.int64))
                    place.append(q)
                    size.append(np.full(len(q), len(s)))
                    bitmap += [np.packbits(odd.astype(np.uint8)).tobytes()] * len(q)
                if bitmap:
                    at = np.concatenate(at)
                    columns = [pa.array(np.concatenate(shingle)), part.column(0).take(pa.array(at)), part.column(1).take(pa.array(at)), pa.array(np.concatenate(size)), pa.array(np.concatenate(place)), pa.array(bitmap, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["shingle", "node", "comp", "n_shingles", "place", "bitmap"])

    return run


def _sharing(percent: int):
    """Candidates among rows in the order of (shingle, block): all pairs of a block that can be alike. A block has two sides, or one that meets itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for b in batches:
            plain = lambda name: b.column(b.schema.get_field_index(name)).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            bits = textvec.text_bytes(b.column(b.schema.get_field_index("bitmap")))[0].reshape(-1, BITMAP // 8)
            rows = [plain(name) for name in ("shingle", "block", "side", "node", "comp", "n_shingles", "place")] + [bits]
            held = 0
            if carry is not None:
                held = len(carry[0])
                rows = [np.concatenate([c, r]) for c, r in zip(carry, rows, strict=True)]
            shingle, block, side, node, comp, size, place, bits = rows
            words = np.ascontiguousarray(bits).view(np.uint64)
            i, j, a, c = np.arange(held, len(node)), 0, [], []
            while True:
                j += 1
                i = i[i >= j]
                i = i[(shingle[i] == shingle[i - j]) & (block[i] == block[i - j])]
                if not len(i):
                    break
                both = size[i] + size[i - j]
                common = np.minimum(size[i] - place[i], size[i - j] - place[i - j])
                ok = (comp[i] != comp[i - j]) & ((side[i] < 0) | (side[i] != side[i - j])) & ((100 + percent) * common >= percent * both)
                k, both = i[ok], both[ok]
                apart = np.bitwise_count(words[k] ^ words[k - j]).sum(axis=1, dtype=np.int64)  # shingles that one of the two has alone, at least
                k = k[(100 + percent) * (both - apart) >= 2 * percent * both]
                a.append(np.minimum(node[k], node[k - j]))
                c.append(np.maximum(node[k], node[k - j]))
            if sum(map(len, a)):
                pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(c)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])
            last = (shingle == shingle[-1:]) & (block == block[-1:])
            carry = [r[last] for r in rows]

    return run


def _exact_candidates(nodes: DataFrame, cut: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame | None:
    """All pairs of classes of crowded and cut regions, of two components, that can be alike; none is left out. None if there is no such region.

    Of a long list of texts that share a shingle those that can be alike to none of it, by their sizes and the shingle's places in them, are passed
    over. The rest are dealt to blocks, and each two blocks meet in a task of their own.
    """
    share = docs.sparkSession.sparkContext.broadcast
    crowded = _crowded(nodes).unionByName(nodes.join(checked_broadcast(cut), "node").select("node", "comp")).distinct()
    crowded = staged(crowded.withColumnRenamed("node", "doc_id"), "crowded")
    if crowded.isEmpty():
        return None
    texts = staged(docs.join(checked_broadcast(crowded), "doc_id").select("doc_id", "comp", "text"), "crowded-texts")
    # at most a row of eight bytes for each counter comes back; those that one text alone has stay 0
    seen = texts.select("text").mapInArrow(_shingle_counts(n), "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).filter("n > 1")
    seen = seen.select(F.col("counter").cast("int"), F.least("n", F.lit((1 << 31) - 1)).cast("int").alias("n")).toArrow()
    counts = np.zeros(COUNTERS, np.int32)
    counts[seen.column("counter").to_numpy()] = seen.column("n").to_numpy()
    rows = texts.mapInArrow(_prefixes(share(counts), n, percent), "shingle long, node long, comp long, n_shingles long, place long, bitmap binary")
    rows = staged(rows, "prefixes")
    # of each long list the sizes of its sets, and the most shingles that are left from the list's own on in a set of that size
    sizes = rows.groupBy("shingle", "n_shingles").agg(F.count("*").alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.max(F.col("n_shingles") - F.col("place")).alias("left"))
    lists = sizes.groupBy("shingle").agg(F.collect_list(F.struct("n_shingles", "left")).alias("sizes"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    long = staged(lists.filter(F.col("n") > LIST_ROWS), "long-lists")
    few = small_enough(long, BROADCAST_LISTS)
    lists = F.broadcast(long) if few else long
    most = F.exists("sizes", lambda x: (100 + percent) * F.least(F.col("n_shingles") - F.col("place"), x["left"]) >= percent * (F.col("n_shingles") + x["n_shingles"]))
    in_long = staged(rows.join(lists.filter("low < high").select("shingle", "sizes"), "shingle").filter(most).drop("sizes"), "long-list-rows")
    blocks = in_long.groupBy("shingle").agg(F.ceil(F.count("*") / LIST_ROWS).alias("blocks"))
    short = rows.join(lists.select("shingle"), "shingle", "left_anti").withColumn("blocks", F.lit(1).cast("long"))
    dealt = in_long.join(F.broadcast(blocks) if few else blocks, "shingle").unionByName(short)
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    block = F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")
    dealt = dealt.select("shingle", block.alias("block"), F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own")).alias("side"), "node", "comp", "n_shingles", "place", "bitmap")
    return dealt.repartition("shingle", "block").sortWithinPartitions("shingle", "block").mapInArrow(_sharing(percent), "a long, b long").distinct()


def _confirmed(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 200):
                part = b.slice(i, 200)
                same = []
                for s, t in zip(*(textvec.shingles(*textvec.text_bytes(part.column(k)), n) for k in (2, 3)), strict=True):
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    same.append(both > 0 and 100 * both >= percent * (len(s) + len(t) - both))
                yield part.select([0, 1]).filter(pa.array(same, pa.bool_()))

    return run


def checked_broadcast(ids: DataFrame) -> DataFrame:
    """ids, to be broadcast if there are few enough of them."""
    return F.broadcast(ids) if small_enough(ids, BROADCAST_IDS) else ids


def _links(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of the candidate pairs that are similar enough, by the full texts. Only texts in a pair are read on."""
    pairs = staged(pairs, "pairs")
    need = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    texts = staged(docs.join(checked_broadcast(need), "doc_id", "left_semi"), "texts")
    one = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    two = one.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return staged(two.select("a", "b", "text_a", "text_b").mapInArrow(_confirmed(n, percent), "a long, b long"), "links")


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of one partition, as stars around the least node of each of its components: shortens chains."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := up.setdefault(x, x)) != x:
            up[x] = up[p]
            x = up[x]
        return x

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
    stars = [(x, root(x)) for x in list(up)]
    stars = [(x, r) for x, r in stars if x != r]
    for i in range(0, len(stars), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array([s[k] for s in stars[i : i + 100_000]], pa.int64()) for k in (0, 1)], names=["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """node, comp (the least node reachable) of all nodes in links(a, b).

    Rounds of contraction: each node hooks to its least neighbour if that is less, pointers are doubled up to the roots, links are redrawn between
    roots; nodes that aren't the least of their surroundings go, until no link is left.
    """
    edges = staged(links.mapInArrow(_local_stars, "u long, v long").distinct(), "edges")
    found = None
    while not edges.isEmpty():
        hooks = edges.groupBy("u").agg(F.min("v").alias("p"))
        while True:
            one = hooks.join(hooks.select(F.col("u").alias("p"), F.col("p").alias("q")), "p", "left").select("u", "p", F.coalesce("q", "p").alias("r"))
            hooks = staged(one, "hooks")
            done = hooks.filter("p <> r").isEmpty()
            hooks = hooks.select("u", F.col("r").alias("p"))
            if done:
                break
        if found is None:
            found = hooks.select(F.col("u").alias("node"), F.col("p").alias("comp"))
        else:
            moved = found.join(hooks.select(F.col("u").alias("comp"), "p"), "comp", "left").select("node", F.coalesce("p", "comp").alias("comp"))
            found = moved.unionByName(hooks.join(found, F.col("u") == F.col("node"), "left_anti").select(F.col("u").alias("node"), F.col("p").alias("comp")))
        redrawn = edges.join(hooks, "u").select("v", F.col("p").alias("x")).join(hooks.select(F.col("u").alias("v"), F.col("p").alias("q")), "v", "left").select("x", F.coalesce("q", "v").alias("y"))
        edges = staged(redrawn.filter("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "edges")
    spark = links.sparkSession
    return staged(found, "components") if found is not None else spark.createDataFrame([], "node long, comp long")


def _with_components(classes: DataFrame, found: DataFrame) -> DataFrame:
    return classes.join(found, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs(doc_id, text).

    component_id: the smallest doc_id reachable by links; kept: whether that is the row's own. Null and empty texts have no shingles and no link. Rows with a
    null doc_id link with nothing: their component_id is null, and they are kept. Rows that share a doc_id (and have words) count as one
    document that has all their links. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = staged(docs.mapInArrow(_signed(words), "doc_id long, n_shingles long, s1 long, s2 long, keys binary, bits binary"), "signatures")
    full = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("s1", "s2").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"), F.first("bits").alias("bits"))
    classes = staged(classes, "classes")
    pairs, _ = _candidates(classes.withColumn("comp", F.col("node")), FIRST_TREES, 1, percent)
    first = _links(pairs, docs, words, percent)
    known = staged(_with_components(classes, components(first)), "nodes")
    pairs, cut = _candidates(known, TREES, WIDTH, percent)
    second = _links(pairs, docs, words, percent)
    links = first.unionByName(second)
    known = staged(_with_components(classes, components(links)), "nodes")
    crowded = _exact_candidates(known, cut, docs, words, percent)
    if crowded is not None:
        links = links.unionByName(_links(crowded, docs, words, percent))
    # classes that share a doc_id are one document
    comps = components(links)
    owner = classes.select("s1", "s2", "node").join(comps, "node", "left").select("s1", "s2", F.coalesce("comp", "node").alias("component_id"))
    linked = full.join(owner, ["s1", "s2"]).select("doc_id", "n_shingles", "component_id")
    # rows that link with nothing stay out of the join, where they would all have one key
    alone = signed.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all their columns, one for each group of near-duplicates: that with the smallest doc_id; of rows that share it, one."""
    found = staged(near_duplicates(docs, words, percent), "near-duplicates")
    gone = found.filter("not kept").select("doc_id").distinct()
    left = docs.join(checked_broadcast(gone), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    twice = staged(found.filter("kept and doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    if twice.isEmpty():
        return left
    some = checked_broadcast(twice)
    return left.join(some, "doc_id", "left_anti").unionByName(left.join(some, "doc_id", "left_semi").dropDuplicates(["doc_id"])).select(*[F.col(f"`{c}`") for c in docs.columns])
