"""Vectorised work on the UTF-8 bytes of a batch of texts: hashed n-gram counts, word hashes, shingles. All of it covers whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from .common import CHUNK_BYTES

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def stream(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    return mixed((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * _GOLD)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, end to end, and each row's offset; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    buffers = column.buffers()
    if len(column) == 0 or buffers[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(buffers[1], dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


_IDENTITY = np.arange(256, dtype=np.uint8)
_LOWER = _IDENTITY.copy()
_LOWER[65:91] += 32


def ngram_counts(buf: np.ndarray, offsets: np.ndarray, dims: int, lower: bool) -> np.ndarray:
    """Per row: 256 counts of bytes, then dims (a power of two) of hashed byte pairs and triples. Blocks of bytes bound what is held."""
    rows = len(offsets) - 1
    counts = np.zeros((rows, 256 + dims), np.float32)
    fold, shift = _LOWER if lower else _IDENTITY, np.uint32(32 - dims.bit_length() + 1)
    total = int(offsets[-1])
    for a in range(0, total, CHUNK_BYTES):
        b = min(a + CHUNK_BYTES, total)
        x = fold[buf[a : min(b + 2, total)]].astype(np.uint32)
        row = np.searchsorted(offsets, np.arange(a, a + len(x)), side="right") - 1 if rows > 1 else np.zeros(len(x), np.int64)
        n, lo = b - a, int(row[0])
        hi = int(row[n - 1]) + 1
        own = row[:n] - lo
        counts[lo:hi, :256] += np.bincount(own * 256 + x[:n].astype(np.int64), minlength=(hi - lo) * 256).reshape(hi - lo, 256)
        code = x
        for g in (1, 2):
            m = min(n, len(x) - g)
            if m <= 0:
                break
            code = (code[: len(x) - g] << np.uint32(8)) | x[g:]
            h = ((code[:m] * np.uint32(0x9E3779B1)) >> shift).astype(np.int64)
            inside = row[:m] == row[g : g + m]
            counts[lo:hi, 256:] += np.bincount((own[:m] * dims + h)[inside], minlength=(hi - lo) * dims).reshape(hi - lo, dims)
    return counts


_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True
#: Words for alignment: runs of ASCII letters and digits and of all other bytes beyond ASCII.
_BREAK = np.ones(256, bool)
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

_STEP = np.uint64(0xD1342543DE82EF95)
#: Ranges of more bytes than this are hashed one by one, by the library; the others eight bytes at a time, all ranges at once.
LONG = 64
_KEEP = (np.uint64(1) << (np.arange(8, dtype=np.uint64) * np.uint64(8))) - np.uint64(1)


def _eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of buf on, as a number; its last seven places have none."""
    return np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))


def range_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each range: each eight bytes are mixed into what came before, which no arithmetic on the bytes undoes."""
    length = end - start
    out = mixed(length.astype(np.uint64) * _GOLD)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eights = _eights(padded)
    at = np.flatnonzero(length <= LONG)
    for k in range(0, LONG, 8):
        at = at[length[at] > k]
        if not len(at):
            break
        left = length[at] - k
        block = eights[start[at] + k]
        short = left < 8
        block[short] &= _KEEP[left[short]]
        out[at] = mixed((out[at] ^ block) * _STEP + _GOLD)
    whole = padded.data
    for i in np.flatnonzero(length > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(whole[start[i] : end[i]], seed=1)
    return out


def same_bytes(a: np.ndarray, start: np.ndarray, b: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the ranges a[start : start + length] and b[begin : begin + length] are alike, byte by byte; b has 8 bytes to spare at its end."""
    x, y = _eights(np.concatenate([a, np.zeros(8, np.uint8)])), _eights(b)
    same = np.ones(len(start), bool)
    at, k = np.flatnonzero(length > 0), 0
    while len(at):
        left = length[at] - k
        apart = x[start[at] + k] ^ y[begin[at] + k]
        short = left < 8
        apart[short] &= _KEEP[left[short]]
        same[at] &= apart == 0
        k += 8
        at = at[(left > 8) & same[at]]
    return same


def words(buf: np.ndarray, offsets: np.ndarray, white: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (A-Z as a-z), in order, and for each row the number of the first of its words; rows + 1 numbers.

    white: words are what stands between ASCII white space; else, between ASCII signs and white space. Blocks of bytes bound what is held; they end
    between words.
    """
    total, table = int(offsets[-1]), _WHITE if white else _BREAK
    found, starts = [], []
    row_start = np.zeros(total + 1, bool)
    row_start[offsets] = True
    a = 0
    while a < total:
        b = min(a + CHUNK_BYTES, total)
        while b < total and not (row_start[b] or table[buf[b]]):
            ahead = min(b + 4096, total)
            gap = np.flatnonzero(row_start[b:ahead] | table[buf[b:ahead]])
            b = b + int(gap[0]) if len(gap) else ahead
        part = _LOWER[buf[a:b]]
        inside = ~table[part]
        first = row_start[a:b]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | first[1:]
        end = inside.copy()
        end[:-1] &= ~inside[1:] | first[1:]
        s, e = np.flatnonzero(begin), np.flatnonzero(end)
        if len(s):
            found.append(range_hashes(part, s, e + 1))
            starts.append(s + a)
        a = b
    hashes = np.concatenate(found) if found else np.zeros(0, np.uint64)
    at = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return hashes, np.searchsorted(at, offsets)


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n words in a row (of any row; the caller keeps to those inside one)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    m = len(hashes) - n + 1
    out = mixed(hashes[:m] + np.uint64(n * int(_GOLD) & 0xFFFFFFFFFFFFFFFF))
    for k in range(1, n):
        out = mixed(out * _STEP + hashes[k : k + m])
    return out


def shingles(buf: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Each row's set of n-word shingles as sorted hashes; with fewer words, all of them as one; none without words."""
    hashes, first = words(buf, offsets)
    all_runs = runs(hashes, n)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= n:
            yield np.unique(all_runs[a : b - n + 1])
        elif b > a:
            yield runs(hashes[a:b], int(b - a))
        else:
            yield np.zeros(0, np.uint64)
