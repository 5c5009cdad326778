"""Quality classifier: nearest-neighbour voting among labelled documents in a latent-semantic space.

A text becomes counts of bytes and hashed byte n-grams, plus the shares of its repeated words; these are weighted by inverse document frequency and
projected on the main singular vectors of the labelled sample. The labelled vectors (a bounded sample) go to every task, which takes the
cosines of each of its documents with all of them, block by block, and lets the NEIGHBOURS nearest vote, each with its similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import textvec
from .common import crc_mod, sampled_texts, text_hash

DIMS, LATENT, NEIGHBOURS = 1024, 48, 15
#: Labelled documents of each class that are learned from at most: those first by a hash of their ids.
SAMPLE = 1500
THRESHOLD = 0.3
#: Votes, by similarity, that PRIOR counts as; it decides where nothing is near.
PRIOR_VOTES, PRIOR = 0.1, 0.5


def features(column: pa.Array) -> np.ndarray:
    """A row for each text: square roots of counts, each of the two blocks of unit length, and how its words repeat."""
    buf, offsets = textvec.text_bytes(column)
    counts = np.sqrt(textvec.ngram_counts(buf, offsets, DIMS, lower=False))
    for part in (counts[:, :256], counts[:, 256:]):
        part /= np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9)
    hashes, first = textvec.words(buf, offsets)
    style = np.zeros((len(counts), 3), np.float32)
    same = np.zeros(len(hashes) + 1, np.int64)
    np.cumsum(hashes[1:] == hashes[:-1], out=same[1 : len(hashes)]) if len(hashes) > 1 else None
    for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
        n = int(b - a)
        if n > 1:
            _, times = np.unique(hashes[a:b], return_counts=True)
            style[i] = same[b - 1] - same[a], np.sqrt((times.astype(float) ** 2).sum() - n), n / max(1, int(offsets[i + 1] - offsets[i])) * n
            style[i] /= n
    return np.hstack([counts, style])


@dataclass
class Model:
    weights: np.ndarray
    mean: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    #: What a vote of either class counts, so that a class with few labelled documents isn't outvoted by its number alone.
    balance: tuple[float, float] = (1.0, 1.0)

    def latent(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) * self.weights) @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def scores(self, x: np.ndarray, block: int = 256) -> np.ndarray:
        """Between 0 and 1, higher where label 1 is likelier. All that tie for the last place among the nearest vote."""
        if not len(self.labels):
            return np.full(len(x), PRIOR)
        out, k = np.empty(len(x)), min(NEIGHBOURS, len(self.labels))
        z = self.latent(x)
        for i in range(0, len(z), block):
            near = z[i : i + block] @ self.vectors.T
            least = -np.partition(-near, k - 1, axis=1)[:, k - 1 : k]
            votes = np.where(near >= least, np.clip(near, 0, None) ** 2, 0) * np.where(self.labels > 0, self.balance[1], self.balance[0])
            out[i : i + block] = (votes @ self.labels + PRIOR_VOTES * PRIOR) / (votes.sum(axis=1) + PRIOR_VOTES)
        return np.clip(out, 0, 1)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, len(b), 100):
            part = b.slice(i, 100)
            rows = features(part.column(1)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], names=["label", "x"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, learn=None) -> Model:
    """Learns from labels(doc_id, quality) of docs; learn: which label rows may be learned from.

    Of label rows that share a doc_id the mean decides. Rows with a null or another quality than 0 and 1 are left out, and labels without a document.
    Documents that share a doc_id share its label; rows alike in id and text count once. At most sample documents of each class are learned from.
    """
    ship(docs.sparkSession)
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality")).filter("quality in (0, 1) and doc_id is not null")
    if learn is not None:
        rows = rows.filter(learn)
    rows = rows.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labelled = docs.select("doc_id", text_hash().alias("_cg_text")).join(rows, "doc_id")  # ids and hashes alone
    got = sampled_texts(docs, labelled, "label", sample).mapInArrow(_features, "label int, x binary").collect()  # at most 2 * sample rows
    got.sort(key=lambda r: (r.label, bytes(r.x)))
    width = 256 + DIMS + 3
    x = np.array([np.frombuffer(r.x, np.float32) for r in got], np.float32).reshape(len(got), width)
    y = np.array([r.label for r in got], np.float32)
    del got
    if not len(y):
        return Model(np.ones(width, np.float32), np.zeros(width, np.float32), np.zeros((width, 1), np.float32), np.zeros((0, 1), np.float32), y)
    weights = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1).astype(np.float32)
    weights[-3:] = 1 / np.maximum(x[:, -3:].std(axis=0) * 4, 1e-3)
    mean = x.mean(axis=0)
    centred = (x - mean) * weights
    _, axes = np.linalg.eigh(centred.T @ centred)
    model = Model(weights, mean, np.ascontiguousarray(axes[:, ::-1][:, :LATENT], np.float32), np.zeros((0, 1), np.float32), y)
    model.vectors = model.latent(x).astype(np.float32)
    share = min(max(float(y.mean()), 0.05), 0.95)
    model.balance = (0.5 / (1 - share), 0.5 / share)
    return model


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            s = np.concatenate([model.scores(features(b.column(1).slice(i, 200))) for i in range(0, len(b), 200)]) if len(b) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(c for n, c in zip(b.schema.names, b.columns, strict=True) if n != "_cg_text"), pa.array(s, pa.float64())], names=[*(n for n in b.schema.names if n != "_cg_text"), "score"])

    return run


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of docs(doc_id, text); null and empty texts get a score as any other."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("_cg_text"))
    return rows.mapInArrow(_scored(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, score double")  # bounded by the sample


def kept(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all their columns, whose score reaches threshold."""
    ship(docs.sparkSession)
    names = docs.columns
    schema = [f"`{c}` {t}" for c, t in docs.dtypes]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, model = names.index("text"), shared.value
        for b in batches:
            for i in range(0, len(b), 200):
                part = b.slice(i, 200)
                yield part.filter(pa.array(model.scores(features(part.column(at))) >= threshold))

    return docs.mapInArrow(run, ", ".join(schema))


def held_out(doc_id) -> F.Column:
    """Rows whose labels are kept for measuring; a null id isn't one."""
    return F.coalesce(crc_mod(doc_id, 5) == 0, F.lit(False))
