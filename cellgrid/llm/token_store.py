"""Token ids in a binary store: one zstandard frame a document, a shared dictionary, an offset index.

Layout, all in one folder that Spark reads and writes (so any file system of the cluster will do):

dictionary  one row: dict_hash (sha256), the dictionary's bytes, token width, end id, and why_none: null, or why no dictionary could be trained (too few
            documents or ids); its bytes are empty then, and frames are compressed without one.
segments    rows of about 8 MB in ascending doc_id order: payload (frames, end to end), and the index of the segment: doc_ids, offsets of
            the frames in the payload, n_tokens; dict_hash; first_doc, last_doc for pruning; start: ids of its part before it.
parts       ids before each part (an output partition), so that a document's global start is known without reading payloads.

Rows with a null doc_id come first. Rows that share a doc_id are kept each, in the order of the first 32 code points of their texts (of all of a text within a
part); such rows may be many, so parts are ranges of id, these code points and a row's place. A null text is empty and has the end
id alone. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import tokens
from .common import hash_sample

#: A segment is closed at this many payload bytes or documents.
SEGMENT_BYTES, SEGMENT_DOCS = 8 << 20, 8192
#: The dictionary is trained on at most so many documents, those first by a hash of their ids; of longer ones on so many code points. Its least and most bytes.
SAMPLE_DOCS, SAMPLE_TEXT, LEAST_BYTES, DICT_BYTES = 512, 1 << 14, 1024, 1 << 16
LEVEL = 3

_SEGMENT = "part int, seq int, first_doc long, last_doc long, start long, total long, dict_hash string, doc_ids array<long>, offsets array<long>, n_tokens array<long>, payload binary"
_DECODED = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _serial(ids: np.ndarray, at: np.ndarray, end_id: int | None) -> Iterator[bytes]:
    """Each document's ids and the end id as bytes."""
    last = b"" if end_id is None else np.array([end_id], dtype=ids.dtype).tobytes()
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield ids[a:b].tobytes() + last


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int | None = 2) -> tuple[bytes, str | None]:
    """A zstandard dictionary from the id arrays of a bounded sample of docs; or empty bytes, and why there is none."""
    import zstandard

    picked = hash_sample(docs.select("doc_id"), SAMPLE_DOCS).distinct()
    some = docs.join(F.broadcast(picked), "doc_id", "left_semi").filter("text <> ''")
    texts = sorted(r.text for r in some.select(F.left("text", F.lit(SAMPLE_TEXT)).alias("text")).limit(2 * SAMPLE_DOCS).collect())
    samples = list(_serial(*tokens.encoder(tokenizer).encode(pa.array(texts, pa.string())), end_id))
    room = min(DICT_BYTES, sum(map(len, samples)) // 10)
    if len(samples) < 8 or room < LEAST_BYTES:
        return b"", f"{len(samples)} documents of {sum(map(len, samples))} bytes of ids are too little to learn from"
    try:
        return zstandard.train_dictionary(room, samples, level=LEVEL).as_bytes(), None
    except zstandard.ZstdError as e:  # the samples have too little in common
        return b"", str(e)


def _dict_data(raw: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(raw) if raw else None


def _segments(tokenizer: str, end_id: int | None, raw: bytes, dict_hash: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        enc, squeeze = tokens.encoder(tokenizer), zstandard.ZstdCompressor(level=LEVEL, dict_data=_dict_data(raw), write_checksum=False, write_content_size=True)
        part, seq, start = TaskContext.get().partitionId(), 0, 0
        ids: list[int | None] = []
        frames: list[bytes] = []
        counts: list[int] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal seq, start, ids, frames, counts, held
            known = [i for i in ids if i is not None]
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])])[:-1]
            row = [part, seq, known[0] if known else None, known[-1] if known else None, start, sum(counts), dict_hash, ids, offsets.tolist(), counts, b"".join(frames)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            names = ["part", "seq", "first_doc", "last_doc", "start", "total", "dict_hash", "doc_ids", "offsets", "n_tokens", "payload"]
            out = pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)
            seq, start, held = seq + 1, start + sum(counts), 0
            ids, frames, counts = [], [], []
            return out

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for i, j in tokens.slices(texts):
                for doc, serial in zip(doc_ids[i:j], _serial(*enc.encode(texts.slice(i, j - i)), end_id), strict=True):
                    frame = squeeze.compress(serial)
                    ids.append(doc)
                    frames.append(frame)
                    counts.append(len(serial) // enc.dtype.itemsize)
                    held += len(frame)
                    if held >= SEGMENT_BYTES or len(ids) >= SEGMENT_DOCS:
                        yield close()
        if ids:
            yield close()

    return run


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int | None = 2) -> None:
    """Encodes docs(doc_id, text) and writes the store to path.

    One exchange (by ranges of doc_id and what parts rows that share it) carries the texts; tokens are made after it, so that sampling for the ranges doesn't encode.
    """
    spark = docs.sparkSession
    ship(spark)
    tokenizer = tokenizer or tokens.default_path()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    raw, why_none = train_dictionary(docs, tokenizer, end_id)
    dict_hash = hashlib.sha256(raw).hexdigest()
    width = tokens.encoder(tokenizer).dtype.itemsize
    spark.createDataFrame([(dict_hash, bytearray(raw), width, end_id, why_none)], "dict_hash string, dictionary binary, width int, end_id int, why_none string").coalesce(1).write.parquet(f"{path}/dictionary")
    key = F.col("doc_id").asc_nulls_first()
    ranges = docs.repartitionByRange(key, F.left(F.coalesce("text", F.lit("")), F.lit(32)), F.xxhash64(F.monotonically_increasing_id()))
    ordered = ranges.sortWithinPartitions(key, F.coalesce("text", F.lit("")))
    ordered.mapInArrow(_segments(tokenizer, end_id, raw, dict_hash), _SEGMENT).write.parquet(f"{path}/segments")
    totals = sorted(spark.read.parquet(f"{path}/segments").groupBy("part").agg(F.sum("total").alias("total")).collect())  # a row for each output partition
    before = np.concatenate([[0], np.cumsum([r.total for r in totals])]).tolist() if totals else []
    spark.createDataFrame([(r.part, b) for r, b in zip(totals, before, strict=False)], "part int, before long").coalesce(1).write.parquet(f"{path}/parts")


def _dictionary(spark: SparkSession, path: str):
    row = spark.read.parquet(f"{path}/dictionary").head()
    raw = bytes(row.dictionary)
    if hashlib.sha256(raw).hexdigest() != row.dict_hash:
        raise ValueError(f"the dictionary in {path} doesn't have the hash that it states")
    return raw, row.dict_hash, np.dtype(f"<u{row.width}")


def _unpacked(raw: bytes, dict_hash: str, dtype: np.dtype, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor(dict_data=_dict_data(raw))
        for batch in batches:
            for row in batch.to_pylist():
                if row["dict_hash"] != dict_hash:
                    raise ValueError("a segment was written with another dictionary")
                payload, at = row["payload"], [*row["offsets"], len(row["payload"])]
                starts = row["before"] + row["start"] + np.concatenate([[0], np.cumsum(row["n_tokens"])])[:-1]
                found = [np.frombuffer(expand.decompress(payload[a:b]), dtype=dtype).astype("<u4") for a, b in zip(at[:-1], at[1:], strict=True)]
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array([len(x) for x in found], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in found], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array([x.astype("i8") for x in found], pa.list_(pa.int64()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def read(spark: SparkSession, path: str, with_ids: bool = False, segments: DataFrame | None = None) -> DataFrame:
    """Every document of a store: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and ids if wanted."""
    raw, dict_hash, dtype = _dictionary(spark, path)
    ship(spark)
    parts = F.broadcast(spark.read.parquet(f"{path}/parts"))  # a row for each output partition
    rows = (segments if segments is not None else spark.read.parquet(f"{path}/segments")).join(parts, "part")
    rows = rows.select("dict_hash", "doc_ids", "offsets", "n_tokens", "payload", "start", "before")
    return rows.mapInArrow(_unpacked(raw, dict_hash, dtype, with_ids), _DECODED + (", ids array<long>" if with_ids else ""))


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[int] | None:
    """The ids of one document: footers prune to its segment, and one frame is expanded there. None if it isn't in the store."""
    import zstandard

    raw, dict_hash, dtype = _dictionary(spark, path)
    found = spark.read.parquet(f"{path}/segments").filter((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id))
    at = F.expr(f"array_position(doc_ids, {int(doc_id)}L)").cast("int")
    found = found.withColumn("_cg_at", at).filter("_cg_at > 0")
    end = F.coalesce(F.get("offsets", F.col("_cg_at")), F.octet_length("payload"))
    begin = F.get("offsets", F.col("_cg_at") - 1)
    row = found.select("dict_hash", F.expr("payload").substr((begin + 1).cast("int"), (end - begin).cast("int")).alias("frame")).head()
    if row is None:
        return None
    if row.dict_hash != dict_hash:
        raise ValueError("a segment was written with another dictionary")
    return np.frombuffer(zstandard.ZstdDecompressor(dict_data=_dict_data(raw)).decompress(bytes(row.frame)), dtype=dtype).tolist()
