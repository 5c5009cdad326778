"""Benchmark decontamination: rare n-gram seeds and Smith-Waterman alignment.

Words are runs of letters and digits in lower case. An item's n-grams are the pairs of its words that are neighbours or have one word between them;
a document's likewise. An alignment's score is its Smith-Waterman score over that of the item with itself, so edited and paraphrased copies keep a
high score, and words common to all texts a low one.

Seeds are chosen so that no copy is missed. Between two matches of an alignment that follow one another there is at most one edit, and so a pair
that both sides have, or there are two edits and more. So an alignment of the score s (a match counts 2, an edit -1) has s / 2 - 1 pairs at least:
the item's `must`. An item's commonest pairs by the number of documents that have them, half of `must`, are left out; a copy then has the other half
of `must` among the rest, the rare seeds, and all of them on diagonals that are no further apart than its edits allow. Where a document has
that, the words around are aligned with the item's.

Documents aren't exchanged. The items go to every task: MAX_ITEM_WORDS bounds them; beyond it they are worked off in blocks of that size, each
against all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import textvec

#: Words that an item must have to be searched for: fewer can't be told from chance.
ITEM_WORDS = 3
#: Scores of the alignment; the share of an item's own score from which it counts as leaked, and the words in a row that its score must be worth
#: (all of them, in a shorter item).
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD, LEAST_WORDS = 0.4, 8
#: Words of items that a task holds at once.
MAX_ITEM_WORDS = 2_000_000
#: Words of windows that are aligned at once (one window at least).
BLOCK = 1 << 19


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return textvec.words(*textvec.text_bytes(pc.utf8_lower(column.fill_null("") if column.null_count else column)), white=False)


class Index:
    """Hashes of the items' n-grams, sorted, with a bit table that rejects most others at once."""

    BITS = 22

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.table = np.zeros(1 << self.BITS, bool)
        self.table[(self.hashes >> np.uint64(64 - self.BITS)).astype(np.int64)] = True

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in grams that are in the index, and their places in it."""
        at = np.flatnonzero(self.table[(grams >> np.uint64(64 - self.BITS)).astype(np.int64)])
        if not len(at) or not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(self.hashes, grams[at]), len(self.hashes) - 1)
        ok = self.hashes[place] == grams[at]
        return at[ok], place[ok]


def _pairs(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash of each pair of words of a row that are neighbours or have one word between them; the row, and the place in it of the first of the two."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    found = []
    for gap in (1, 2):
        at = np.flatnonzero(row[gap:] == row[:-gap])
        found.append((textvec.mixed(textvec.mixed(hashes[at]) + hashes[at + gap]), row[at], at - first[row[at]]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


@dataclass
class Seeds:
    """A block of items and its seeds: what is shared with the tasks."""

    ids: list[int | None]
    items: list[np.ndarray]
    index: Index
    #: Of the seed number k of the index: its items and its places in them, from start[k] to start[k + 1].
    start: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    #: Of each item: the score that counts, the seeds that an alignment of that score has, and the edits that it can have.
    score: np.ndarray
    need: np.ndarray
    edits: np.ndarray

    @staticmethod
    def of(ids: list[int | None], items: list[np.ndarray], threshold: float, counts: dict[int, int] | None = None) -> Seeds:
        """counts: in how many documents the pairs are; None: all pairs are seeds."""
        sizes = np.array([len(w) for w in items])
        score = np.maximum(np.ceil(threshold * MATCH * sizes - 1e-6), MATCH * np.minimum(LEAST_WORDS, sizes)).astype(np.int64)
        must = np.maximum(-(-score // 2) - 1, 1)
        hashes, owner, place = _pairs(np.concatenate(items), np.concatenate([[0], np.cumsum(sizes)]))
        left_out = must // 2
        if counts is not None:
            often = np.array([counts.get(h, 0) for h in hashes.view(np.int64).tolist()])
            order = np.lexsort((place, hashes, -often, owner))
            rank = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
            keep = np.sort(order[rank >= left_out[owner[order]]])
            hashes, owner, place = hashes[keep], owner[keep], place[keep]
        else:
            left_out = np.zeros_like(must)
        index = Index(hashes)
        number = np.searchsorted(index.hashes, hashes)
        order = np.argsort(number, kind="stable")
        start = np.searchsorted(number[order], np.arange(len(index.hashes) + 1))
        return Seeds(ids, items, index, start, owner[order], place[order], score, must - left_out, MATCH * sizes - score)

    def windows(self, hashes: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int]]:
        """row, item, and from which word to which, of the places where a row has as many seeds of an item as a copy must have."""
        pairs, row, at = _pairs(hashes, first)
        found, number = self.index.hits(pairs)
        many = self.start[number + 1] - self.start[number]
        hit = np.repeat(found, many)
        seed = np.arange(len(hit)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.start[number], many)
        row, item, diagonal = row[hit], self.owner[seed], at[hit] - self.place[seed]
        order = np.lexsort((diagonal, item, row))
        row, item, diagonal = row[order], item[order], diagonal[order]
        i = np.arange(len(order))
        i = i[i + self.need[item] - 1 < len(order)]
        j = i + self.need[item[i]] - 1
        i = i[(row[i] == row[j]) & (item[i] == item[j]) & (diagonal[j] - diagonal[i] <= self.edits[item[i]])]
        out, last, at = [], None, 0
        for r, k, d in zip(row[i].tolist(), item[i].tolist(), diagonal[i].tolist(), strict=True):
            n = len(self.items[k])
            pad = max(6, n // 3)
            if (r, k) != last or d - at > pad:  # starts near one another are one place
                out.append((r, k, d - int(self.edits[k]), d + pad + n + int(self.edits[k])))
                last, at = (r, k), d
        return out

    def leaked(self, column: pa.Array) -> dict[tuple[int, int], tuple[float, int]]:
        """Of each (row, item) of which the row has a copy: the best score, and the word where the copy ends."""
        hashes, first = _words(column)
        found: dict[tuple[int, int], tuple[float, int]] = {}
        tasks = sorted(self.windows(hashes, first), key=lambda t: t[3] - t[2])
        while tasks:
            many = max(1, BLOCK // max(1, tasks[0][3] - tasks[0][2]))
            while many > 1 and (tasks[:many][-1][3] - tasks[:many][-1][2]) * len(tasks[:many]) > BLOCK:
                many = (many + 1) // 2
            some, tasks = tasks[:many], tasks[many:]
            wide, long = max(t[3] - t[2] for t in some), max(len(self.items[t[1]]) for t in some)
            w, m = np.zeros((len(some), wide), np.uint64), np.zeros((len(some), long), np.uint64)
            for k, (r, item, lo, hi) in enumerate(some):
                text = hashes[first[r] + max(lo, 0) : min(first[r] + hi, first[r + 1])]
                w[k, : len(text)] = text
                m[k, : len(self.items[item])] = self.items[item]
            which = np.array([t[1] for t in some])
            lengths = np.array([len(self.items[k]) for k in which])
            ok = np.flatnonzero(_possible(w, m, self.score[which] / MATCH))
            best, end = align(w[ok], m[ok], lengths[ok])
            for k, s, e in zip(ok.tolist(), best.tolist(), end.tolist(), strict=True):
                r, item, lo, _ = some[k]
                share = s / (MATCH * len(self.items[item]))
                if s >= self.score[item] and share > found.get((r, item), (0,))[0]:
                    found[r, item] = (share, max(lo, 0) + e)
        return found


def _possible(windows: np.ndarray, items: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Whether each window has as many words of its item (0: no word) as the alignment must match at least; cheaper than the alignment."""
    same = np.zeros(windows.shape, bool)
    for k in range(items.shape[1]):
        same |= windows == items[:, k : k + 1]
    return (same & (windows != 0)).sum(axis=1) >= need


def align(windows: np.ndarray, items: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score, and where in the window it ends, of each row of windows (0: no word) with its row of items.

    A row of the table at a time, for all pairs at once: gaps along the row are a running maximum.
    """
    n, width = windows.shape
    slope = np.arange(width + 1, dtype=np.int32) * -GAP
    above = np.zeros((n, width + 1), np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    for k in range(items.shape[1]):
        word = items[:, k : k + 1]
        step = np.where((windows == word) & (word != 0), MATCH, MISMATCH).astype(np.int32)
        here = np.zeros_like(above)
        here[:, 1:] = np.maximum(np.maximum(above[:, :-1] + step, above[:, 1:] + GAP), 0)
        here = np.maximum.accumulate(here + slope, axis=1) - slope
        here[k >= lengths] = 0
        top = here.max(axis=1)
        better = top > best
        end[better] = here[better].argmax(axis=1)
        best = np.maximum(best, top)
        above = here
    return best, end


def _counted(shared):
    """In how many documents each pair of the index is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        total = np.zeros(len(index.hashes), np.int64)
        for b in batches:
            for i in range(0, len(b), 300):
                pairs, row, _ = _pairs(*_words(b.column(0).slice(i, 300)))
                at, number = index.hits(pairs)
                total += np.bincount(np.unique(np.stack([row[at], number]), axis=1)[1], minlength=len(total))
        at = np.flatnonzero(total)
        for i in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(index.hashes[at[i : i + 100_000]].view(np.int64)), pa.array(total[at[i : i + 100_000]])], names=["pair", "n"])

    return run


def _blocks(docs: DataFrame, benchmark: DataFrame, threshold: float) -> Iterator[Broadcast]:
    """The items' seeds, block by block; each is bounded by MAX_ITEM_WORDS."""
    share = docs.sparkSession.sparkContext.broadcast
    ids, texts, held = [], [], 0

    def close() -> Iterator[Broadcast]:
        hashes, first = _words(pa.array(texts, pa.string()))
        some = [(i, hashes[a:b]) for i, a, b in zip(ids, first[:-1], first[1:], strict=True) if b - a >= ITEM_WORDS]
        if some:
            known, items = map(list, zip(*some, strict=True))
            index = Seeds.of(known, items, threshold).index
            counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_counted(share(index)), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
            yield share(Seeds.of(known, items, threshold, {r.pair: r.n for r in counts.toLocalIterator()}))  # a row for each pair of the items, at most

    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null").orderBy("item_id", "text").toLocalIterator():
        ids.append(r.item_id)
        texts.append(r.text)
        held += len(r.text) // 4
        if held >= MAX_ITEM_WORDS:
            yield from close()
            ids, texts, held = [], [], 0
    if texts:
        yield from close()


def _found(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = shared.value
        for b in batches:
            for i in range(0, len(b), 300):
                part = b.slice(i, 300)
                found = seeds.leaked(part.column(1))
                if found:
                    rows, picked = [part.column(0)[r].as_py() for r, _ in found], [seeds.ids[k] for _, k in found]
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(picked, pa.int64()), pa.array([v[0] for v in found.values()], pa.float64()), pa.array([v[1] for v in found.values()], pa.int64())], names=["doc_id", "item_id", "score", "end_word"])

    return run


def _clean(shared, at: int):
    """The rows whose text, column number at, has no copy of an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = shared.value
        for b in batches:
            for i in range(0, len(b), 300):
                part = b.slice(i, 300)
                keep = np.ones(len(part), bool)
                keep[[r for r, _ in seeds.leaked(part.column(at))]] = False
                yield part.filter(pa.array(keep))

    return run


_LEAKS = "doc_id long, item_id long, score double, end_word long"


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score, end_word (of the passage, counted in words): each document (row) and test item that it has a copy of.

    Every row with an alignment whose score counts is found. score is between threshold and 1; of several passages alike to one item the best counts.
    Items of fewer than ITEM_WORDS words match nothing, as do null and empty texts. Rows with null or repeated doc_ids are searched as any other.
    Empty tables give no rows. The driver reads the items, block by block.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = [docs.mapInArrow(_found(seeds), _LEAKS) for seeds in _blocks(docs, benchmark, threshold)]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], _LEAKS)


def decontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all their columns, without those that have a copy of a test item. Each row is judged by its own text, whatever its doc_id."""
    ship(docs.sparkSession)
    left = docs
    for seeds in _blocks(docs, benchmark, threshold):
        left = left.mapInArrow(_clean(seeds, docs.columns.index("text")), ", ".join(f"`{c}` {t}" for c, t in docs.dtypes))
    return left
