"""Packing of documents into training windows by Karmarkar-Karp multiway differencing.

Each scan partition packs its own documents, a group of about GROUP_TOKENS at a time, so nothing is shuffled. Windows that a long document
fills alone are cut off first. The rest are the items of the group. A partial partition is a list of windows; the two with the largest spread
are merged, the fullest windows of one with the emptiest of the other, until one partition of k near-equal windows is left. k begins with as many
windows as the items' tokens fill; whenever a window is over the capacity, k rises by what the surplus fills (a 32nd
of k at least, so that few rounds are needed), and the items are dealt anew.

Near-equal windows all have some room, which would be padding. So the emptiest of them are dealt out to fill the others; that alone cuts items.
What is left over of a group, under one window, goes into sequences whose lengths are powers of two: these need no padding.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import tokens

GROUP_TOKENS = 1 << 20
CAPACITY = 2048

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: items by index in k windows of nearly equal sums.

    A partial partition holds its non-empty windows only, fullest first, and is ranked by its spread (fullest less emptiest of k).
    """
    heap = []
    for i, n in enumerate(sizes):
        heap.append((-n, i, [(n, [i])]))
    heapq.heapify(heap)
    order = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        over = len(a) + len(b) - k
        if over <= 0:
            merged = a + b
        else:  # the fullest of one side meet the emptiest of the other; the first of a have a free window each
            merged = a[: k - len(b)] + [(x[0] + y[0], x[1] + y[1] if len(x[1]) >= len(y[1]) else y[1] + x[1]) for x, y in zip(a[k - len(b) :], reversed(b[-over:]), strict=True)] + b[: len(b) - over]
        merged.sort(key=lambda w: -w[0])
        heapq.heappush(heap, (-(merged[0][0] - (merged[-1][0] if len(merged) >= k else 0)), order, merged))
        order += 1
    windows = [w[1] for w in heap[0][2]] if heap else []
    return windows + [[] for _ in range(k - len(windows))]


def balanced(sizes: list[int], capacity: int) -> list[list[int]]:
    """Items by index in near-equal windows, none over capacity: from as few windows as the items fill, their number rises while one is too full."""
    k = -(-sum(sizes) // capacity)
    while True:
        windows = differencing(sizes, k)
        over = sum(max(0, sum(sizes[i] for i in w) - capacity) for w in windows)
        if not over:
            return windows
        k += max(-(-over // capacity), k // 32)


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """Windows of (document, start, length): every id of every document once, no window over capacity.

    Full windows have exactly capacity ids; the at most log2(capacity) others have lengths that are powers of two.
    """
    windows: list[list[tuple[int, int, int]]] = []
    items: list[tuple[int, int, int]] = []
    for d, n in enumerate(lengths):
        whole = n // capacity * capacity
        windows += [[(d, s, capacity)] for s in range(0, whole, capacity)]
        if n > whole:
            items.append((d, whole, n - whole))
    if not items:
        return windows
    chosen = [[items[i] for i in w] for w in balanced([x[2] for x in items], capacity)]
    chosen.sort(key=lambda w: -sum(x[2] for x in w))
    full, left = divmod(sum(x[2] for x in items), capacity)
    pool = sorted((x for w in chosen[full:] for x in w), key=lambda x: x[2])

    def taken(room: int) -> list[tuple[int, int, int]]:
        """Pieces of the pool worth room ids, the largest first; the last one is cut."""
        out = []
        while room:
            d, s, n = pool.pop()
            take = min(n, room)
            out.append((d, s, take))
            if n > take:
                pool.append((d, s + take, n - take))
            room -= take
        return out

    windows += [w + taken(capacity - sum(x[2] for x in w)) for w in chosen[:full]]
    return windows + [taken(1 << b) for b in range(capacity.bit_length(), -1, -1) if left >> b & 1]


def _packed(tokenizer: str, end_id: int, capacity: int, group: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(tokenizer)
        end = np.array([end_id], dtype=enc.dtype)
        sequence = TaskContext.get().partitionId() << 40
        docs: list[int | None] = []
        ids: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal sequence, docs, ids, held
            out: dict[str, list] = {n: [] for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")}
            for window in pack([len(x) for x in ids], capacity):
                offset = 0
                for d, s, n in window:
                    piece = ids[d][s : s + n]
                    for name, v in zip(out, (docs[d], s, n, zlib.crc32(piece.astype("<u4").tobytes()), len(ids[d]), sequence, offset, piece.astype("i8") if with_ids else None), strict=True):
                        out[name].append(v)
                    offset += n
                sequence += 1
            docs, ids, held = [], [], 0
            if not with_ids:
                del out["ids"]
            return pa.RecordBatch.from_arrays([pa.array(v, pa.list_(pa.int64()) if n == "ids" else pa.int64()) for n, v in out.items()], names=list(out))

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for i, j in tokens.slices(texts):
                found, at = enc.encode(texts.slice(i, j - i))
                for k, doc in enumerate(doc_ids[i:j]):
                    docs.append(doc)
                    ids.append(np.concatenate([found[at[k] : at[k + 1]], end]))
                    held += len(ids[-1])
                    if held >= group:
                        yield close()
        if docs:
            yield close()

    return run


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS, with_ids: bool = False) -> DataFrame:
    """Packs docs(doc_id, text) into windows of at most capacity ids; a row for each piece, with its ids if wanted.

    A document is its ids and end_id; null and empty texts are the end id alone. Null and repeated doc_ids are kept, a document for each row.
    An empty table gives no rows. Other columns are ignored. A task holds the ids of one group and one Arrow batch of texts.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_packed(tokenizer or tokens.default_path(), end_id, capacity, group_tokens, with_ids), _PIECE + (", ids array<long>" if with_ids else ""))
