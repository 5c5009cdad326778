"""Roaring bitmaps in the public portable format, as whole-set blobs, and SQL functions over them.

Cubes use Spark's own bitmaps (functions/bitmaps.py). These functions read and write blobs that other tools made or want. They run on
Arrow batches; a NULL argument gives NULL where a blob is returned, 0, false or an empty array elsewhere.
"""

from __future__ import annotations

import hashlib
import struct
from collections import OrderedDict

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the public format: cookies, and the most entries that an array container holds.
_COOKIE_RUNS, _COOKIE, _ARRAY_MOST = 12347, 12346, 4096
_OFFSETS_FROM = 4  # with runs, offsets are stored from so many containers on


def encode(ids) -> bytes:
    """The portable bytes of a set of integers from 0 to 2**32 - 1."""
    values = np.unique(np.asarray(ids, dtype=np.int64))
    if len(values) and (values[0] < 0 or values[-1] >= 1 << 32):
        raise ValueError("a roaring bitmap holds ids from 0 to 2**32 - 1")
    keys, starts = np.unique(values >> 16, return_index=True)
    parts = [(values[a:b] & 0xFFFF).astype("<u2") for a, b in zip(starts, np.append(starts, len(values))[1:], strict=True)]
    bodies = []
    for p in parts:
        if len(p) <= _ARRAY_MOST:
            bodies.append(p.tobytes())
        else:
            bits = np.zeros(1 << 16, np.uint8)
            bits[p] = 1
            bodies.append(np.packbits(bits, bitorder="little").tobytes())
    head = struct.pack("<II", _COOKIE, len(keys)) + b"".join(struct.pack("<HH", k, len(p) - 1) for k, p in zip(keys.tolist(), parts, strict=True))
    at = len(head) + 4 * len(keys)
    offsets = []
    for b in bodies:
        offsets.append(struct.pack("<I", at))
        at += len(b)
    return head + b"".join(offsets) + b"".join(bodies)


def decode(blob: bytes) -> np.ndarray:
    """The ids of portable bytes, ascending."""
    blob = bytes(blob)
    (cookie,) = struct.unpack_from("<I", blob)
    at = 4
    if cookie & 0xFFFF == _COOKIE_RUNS:
        n = (cookie >> 16) + 1
        is_run = np.unpackbits(np.frombuffer(blob, np.uint8, (n + 7) // 8, at), bitorder="little")[:n].astype(bool)
        at += (n + 7) // 8
        offsets = n >= _OFFSETS_FROM
    elif cookie == _COOKIE:
        (n,) = struct.unpack_from("<I", blob, at)
        at += 4
        is_run, offsets = np.zeros(n, bool), True
    else:
        raise ValueError("not a portable roaring bitmap")
    head = np.frombuffer(blob, "<u2", 2 * n, at).reshape(n, 2).astype(np.int64)
    at += 4 * n + (4 * n if offsets else 0)
    found = []
    for (key, less), run in zip(head.tolist(), is_run.tolist(), strict=True):
        count = less + 1
        if run:
            (runs,) = struct.unpack_from("<H", blob, at)
            pairs = np.frombuffer(blob, "<u2", 2 * runs, at + 2).reshape(runs, 2).astype(np.int64)
            low = np.concatenate([np.arange(s, s + m + 1) for s, m in pairs.tolist()])
            at += 2 + 4 * runs
        elif count <= _ARRAY_MOST:
            low = np.frombuffer(blob, "<u2", count, at).astype(np.int64)
            at += 2 * count
        else:
            low = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, 8192, at), bitorder="little"))
            at += 8192
        found.append((key << 16) + low)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def stable_hash(blob: bytes | None) -> int | None:
    """blake2b of 8 bytes, big-endian, as a signed 64-bit integer."""
    return None if blob is None else int.from_bytes(hashlib.blake2b(bytes(blob), digest_size=8).digest(), "big", signed=True)


def _each(f, *columns: pd.Series) -> pd.Series:
    return pd.Series([f(*row) for row in zip(*columns, strict=True)], dtype=object)


def _none(x) -> bool:
    return x is None or (isinstance(x, float) and x != x)


def _count(b) -> int:
    return 0 if _none(b) else len(decode(b))


def _union(blobs) -> bytes:
    sets = [] if _none(blobs) else [decode(b) for b in blobs if b is not None]
    return encode(np.concatenate(sets)) if sets else encode([])


def _both(f):
    return lambda a, b: None if _none(a) or _none(b) else encode(f(decode(a), decode(b)))


#: Sets that a worker holds by their hash, oldest first, and the ids that they may have together.
_held: OrderedDict[int, np.ndarray] = OrderedDict()
_HELD_IDS = 1 << 22


def _known(b, h):
    """The ids of a blob whose hash is known: decoded once in a worker. The blob must be there; the hash alone is no set."""
    if _none(b) or _none(h):
        return None if _none(b) else decode(b)
    h = int(h)
    if h not in _held:
        _held[h] = decode(b)
        while len(_held) > 1 and sum(map(len, _held.values())) > _HELD_IDS:
            _held.popitem(last=False)
    return _held[h]


def _count_known(b, h) -> int:
    ids = _known(b, h)
    return 0 if ids is None else len(ids)


def _both_known(f):
    return lambda a, ha, b, hb: None if _none(a) or _none(b) else encode(f(_known(a, ha), _known(b, hb)))


_and, _or = _both(np.intersect1d), _both(np.union1d)


def _chunk(b, start, size) -> list[int]:
    """size ids from place start on; a negative start is 0, and a size under 1 is 1."""
    if _none(b):
        return []
    start = 0 if _none(start) else max(int(start), 0)
    return decode(b)[start : start + max(1, 0 if _none(size) else int(size))].tolist()


rb_build = F.pandas_udf(lambda ids: _each(lambda x: None if x is None else encode(x), ids), T.BinaryType())
rb_hash = F.pandas_udf(lambda b: _each(stable_hash, b), T.LongType())
rb_and = F.pandas_udf(lambda a, b: _each(_and, a, b), T.BinaryType())
rb_or = F.pandas_udf(lambda a, b: _each(_or, a, b), T.BinaryType())
rb_count = F.pandas_udf(lambda b: _each(_count, b), T.LongType())
rb_to_array = F.pandas_udf(lambda b: _each(lambda x: [] if _none(x) else decode(x).tolist(), b), T.ArrayType(T.LongType()))
rb_chunk = F.pandas_udf(lambda b, s, n: _each(_chunk, b, s, n), T.ArrayType(T.LongType()))
rb_contains = F.pandas_udf(lambda b, i: _each(lambda x, y: not _none(x) and not _none(y) and bool(np.isin(y, decode(x))), b, i), T.BooleanType())
rb_union_list = F.pandas_udf(lambda bs: _each(_union, bs), T.BinaryType())
rb_count_precomputed = F.pandas_udf(lambda b, h, n: _each(lambda _b, _h, m: 0 if _none(m) else int(m), b, h, n), T.LongType())
rb_count_hash = F.pandas_udf(lambda b, h: _each(_count_known, b, h), T.LongType())
rb_and_precomputed = F.pandas_udf(lambda a, ha, b, hb: _each(_both_known(np.intersect1d), a, ha, b, hb), T.BinaryType())
rb_or_precomputed = F.pandas_udf(lambda a, ha, b, hb: _each(_both_known(np.union1d), a, ha, b, hb), T.BinaryType())

FUNCTIONS = {
    "rb_build": rb_build, "rb_hash": rb_hash, "rb_and": rb_and, "rb_or": rb_or, "rb_count": rb_count, "rb_to_array": rb_to_array, "rb_chunk": rb_chunk,
    "rb_contains": rb_contains, "rb_union_list": rb_union_list, "rb_count_precomputed": rb_count_precomputed, "rb_count_hash": rb_count_hash,
    "rb_and_precomputed": rb_and_precomputed, "rb_or_precomputed": rb_or_precomputed,
}


def register(spark: SparkSession) -> None:
    """Makes the functions known to SQL."""
    for name, f in FUNCTIONS.items():
        spark.udf.register(name, f)
