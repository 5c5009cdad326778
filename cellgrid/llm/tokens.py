"""Token ids by the tokenizers library, with a cache of the pieces that it splits texts into.

Byte-level BPE splits a text into pieces (words with the space before them, numbers, signs, white space) and encodes each alone. Here the pieces
of a whole batch are found at once on its bytes, looked up in a table by a 64-bit hash and compared with the bytes held there, and the library
encodes those that are new. Rows with a character whose class isn't plain (or an apostrophe, which has rules of its own), with the string of an
added token, or with a piece whose bytes aren't those of its hash go to the library as they are. Both ways give the library's ids, as its plain
call encode(text, add_special_tokens=False) gives them: the string of an added token, such as an end mark, is that token.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from . import textvec

#: Slots of a worker's table, and ids or bytes that it holds before it starts anew.
SLOT_BITS, HELD_IDS, HELD_BYTES = 21, 1 << 23, 1 << 26

# Classes of bytes: 0 space, 1 letters (Latin beyond ASCII included), 2 digits, 3 signs, 4 other white space, 9 not plain.
_CLASS = np.full(256, 9, np.uint8)
_CLASS[33:127] = 3
_CLASS[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = 1
_CLASS[48:58] = 2
_CLASS[32], _CLASS[[9, 10, 13]], _CLASS[39] = 0, 4, 9

_encoders: dict[str, Encoder] = {}


def _pieces(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each piece starts, and which rows aren't plain."""
    n = len(buf)
    kind = _CLASS[buf]
    odd = np.flatnonzero(kind == 9)
    signs = np.flatnonzero((buf[:-1] == 0xC3) & ((buf[1:] == 0x97) | (buf[1:] == 0xB7)))  # the times and divided-by signs, among the letters
    rows = np.unique(np.searchsorted(offsets, np.concatenate([odd, signs]), side="right") - 1)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    white = (kind == 0) | (kind == 4)
    before = np.empty(n, np.uint8)
    before[0], before[1:] = 255, kind[:-1]
    before[first[:n]] = 255
    cut = first[:n].copy()
    cut |= ~white & (before != kind) & (before != 0)  # a run of one class, without a space that it takes along
    cut[1:] |= white[1:] & ~white[:-1]
    cut[:-1] |= white[:-1] & ~white[1:] & ~first[1:n]  # the last white space before a word stands alone, or goes with the word
    return np.flatnonzero(cut), rows


class Encoder:
    """One file's encoder, with the table of pieces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self._empty()

    def _empty(self) -> None:
        self.keys = np.zeros(1 << SLOT_BITS, np.uint64)
        self.slots = np.zeros(1 << SLOT_BITS, np.int32)
        self.flat = np.zeros(1 << 16, self.dtype)
        self.begin, self.length = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)
        self.text = np.zeros(1 << 18, np.uint8)
        self.text_begin, self.text_length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.n_ids = self.n_pieces = self.n_bytes = 0

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shift = np.uint64(64 - SLOT_BITS)
        return (hashes >> shift).astype(np.int64), ((hashes * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)

    def _add(self, hashes: np.ndarray, texts: list[bytes]) -> np.ndarray:
        found = [e.ids for e in self.library.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int32, len(found))
        ids = np.fromiter((i for f in found for i in f), self.dtype, int(lengths.sum()))
        while self.n_ids + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        whole = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        while self.n_bytes + len(whole) + 8 > len(self.text):
            self.text = np.concatenate([self.text, np.zeros_like(self.text)])
        while self.n_pieces + len(found) > len(self.begin):
            self.begin, self.length, self.text_begin, self.text_length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.length, self.text_begin, self.text_length))
        own = np.arange(self.n_pieces, self.n_pieces + len(found), dtype=np.int32)
        self.flat[self.n_ids : self.n_ids + len(ids)] = ids
        self.begin[own] = self.n_ids + np.concatenate([[0], np.cumsum(lengths)[:-1]])
        self.length[own] = lengths
        self.text[self.n_bytes : self.n_bytes + len(whole)] = whole
        self.text_begin[own] = self.n_bytes + np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.text_length[own] = sizes
        self.n_ids += len(ids)
        self.n_bytes += len(whole)
        self.n_pieces += len(found)
        one, two = self._places(hashes)
        place = np.where(self.keys[one] == 0, one, two)
        self.keys[place], self.slots[place] = hashes, own
        return own

    def _looked_up(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        hashes = textvec.range_hashes(buf, start, end) | np.uint64(1)  # 0 marks a free slot
        one, two = self._places(hashes)
        own = self.slots[one]
        other = np.flatnonzero(self.keys[one] != hashes)
        own[other] = self.slots[two[other]]
        new = other[self.keys[two[other]] != hashes[other]]
        if len(new):
            unique, at, inverse = np.unique(hashes[new], return_index=True, return_inverse=True)
            whole = buf.tobytes()
            own[new] = self._add(unique, [whole[start[i] : end[i]] for i in new[at].tolist()])[inverse]
        return own

    def _with_added(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows that have the string of an added token."""
        whole, found = buf.tobytes(), []
        for token in self.added:
            at = whole.find(token)
            while at >= 0:
                found.append(at)
                at = whole.find(token, at + 1)
        return np.unique(np.searchsorted(offsets, np.array(found, np.int64), side="right") - 1)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a string column's rows, end to end, and where each row's start; rows + 1 numbers. Null rows have none."""
        if self.n_ids > HELD_IDS or self.n_bytes > HELD_BYTES:
            self._empty()
        buf, offsets = textvec.text_bytes(column)
        rows = len(offsets) - 1
        if not len(buf):
            return np.zeros(0, self.dtype), np.zeros(rows + 1, np.int64)
        start, odd = _pieces(buf, offsets)
        end = np.append(start[1:], len(buf))
        row = np.searchsorted(offsets, start, side="right") - 1
        odd = np.union1d(odd, self._with_added(buf, offsets))
        if len(odd):
            plain = ~np.isin(row, odd)
            start, end, row = start[plain], end[plain], row[plain]
        own = self._looked_up(buf, start, end)
        same = self.text_length[own] == end - start
        same[same] = textvec.same_bytes(buf, start[same], self.text, self.text_begin[own[same]], (end - start)[same])
        if not same.all():
            odd = np.union1d(odd, row[~same])
            plain = ~np.isin(row, odd)
            row, own = row[plain], own[plain]
        count = self.length[own].astype(np.int64)
        after = np.cumsum(count)
        ids = self.flat[np.repeat(self.begin[own] - (after - count), count) + np.arange(int(after[-1]) if len(after) else 0)]
        sizes = np.bincount(row, weights=count, minlength=rows).astype(np.int64)
        if not len(odd):
            return ids, np.concatenate([[0], np.cumsum(sizes)])
        parts, at = [], np.concatenate([[0], np.cumsum(sizes)])
        done = 0
        whole = self.library.encode_batch_fast([buf[offsets[r] : offsets[r + 1]].tobytes().decode() for r in odd.tolist()], add_special_tokens=False)
        for r, e in zip(odd.tolist(), whole, strict=True):
            parts += [ids[at[done] : at[r]], np.array(e.ids, self.dtype)]
            sizes[r], done = len(e.ids), r
        return np.concatenate([*parts, ids[at[done] :]]), np.concatenate([[0], np.cumsum(sizes)])


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_path() -> str:
    """The byte-level BPE file of the public tokenizers that are installed."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def slices(column: pa.Array, limit: int = 1 << 20):
    """Ranges of rows of a string column with at most limit bytes, one row at least."""
    _, offsets = textvec.text_bytes(column)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j
        i = j
