"""Language identification by error-correcting output codes.

Every language has a codeword. For each bit of the codewords a binary classifier over byte n-grams predicts that bit. A text gets the
language whose codeword loses least against the predicted margins; bits count by how reliable they were in cross-checks on the learning sample. A
text whose two best languages lose about the same is flagged ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import textvec
from .common import crc_mod, sampled_texts, staged, text_hash

DIMS = 4096
#: Documents of each language that are learned from at most, those first by a hash of their ids; and languages from which on they share the room of so many
#: (one document each at least): every language is learned.
SAMPLE, LANGUAGES = 500, 64
#: Documents up to which they are held at once; beyond it, their sums are.
HELD = 256 + DIMS
RIDGE, SHARPNESS = 0.3, 3.0
#: The best score under which a prediction is flagged ambiguous.
AMBIGUOUS = 0.6
UNDEFINED = "und"


def features(column: pa.Array) -> np.ndarray:
    """Square roots of the counts of bytes and hashed n-grams (A-Z as a-z), of unit length."""
    buf, offsets = textvec.text_bytes(column)
    x = np.sqrt(textvec.ngram_counts(buf, offsets, DIMS, lower=True))
    x[:, : 128] *= 0.5  # single ASCII bytes say little
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1: all ways to split up to 7 languages, else random codes of 12 * log2(n) bits, the best of 64 by least distance."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        cols = [[1 if i == 0 or not c >> (i - 1) & 1 else -1 for i in range(n)] for c in range(1, 1 << (n - 1))]
        return np.array(cols, float).T
    bits, best, far = int(np.ceil(12 * np.log2(n))), None, -1
    for seed in range(64):
        m = np.where(np.random.default_rng(seed).random((n, bits)) < 0.5, -1.0, 1.0)
        gap = (bits - np.abs(m @ m.T - bits * np.eye(n))).min()
        if gap > far and (np.abs(m.sum(axis=0)) < n).all():
            best, far = m, gap
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    mean: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNDEFINED] * len(x), np.zeros(len(x))
        margin = x @ self.weights + self.bias
        loss = np.stack([(np.logaddexp(0, -SHARPNESS * margin * word) * self.trust).sum(axis=1) for word in self.code], axis=1)
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return [self.languages[i] for i in best], p.max(axis=1)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, len(b), 100):
            part = b.slice(i, 100)
            rows = features(part.column(1)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], names=["lang", "x"])


def _fit_by_sums(rows: DataFrame) -> Model:
    """The same model from sums over rows(lang, x), read block by block: what is held doesn't grow with their number."""
    count = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages, n, width = sorted(count), sum(count.values()), 256 + DIMS
    if len(languages) < 2:
        return Model(languages, codewords(len(languages)), np.zeros(width), np.zeros((width, 1)), np.ones(1), np.ones(1))
    code = codewords(len(languages))
    of = np.array([count[v] for v in languages])

    def blocks() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        held = []
        for r in chain(rows.toLocalIterator(), [None]):
            if r is not None:
                held.append((r.lang, r.x))
            if held and (r is None or len(held) == 500):
                own = np.searchsorted(languages, [v for v, _ in held])
                yield np.array([np.frombuffer(x, np.float32) for _, x in held], np.float64), code[own], n / (len(languages) * of[own])[:, None]
                held = []

    plain, total, gram, goal, weight = np.zeros(width), np.zeros(width), np.zeros((width, width)), np.zeros((width, code.shape[1])), 0.0
    sum_goal = np.zeros(code.shape[1])
    for x, target, share in blocks():
        plain += x.sum(axis=0)
        total += (x * share).sum(axis=0)
        gram += (x * share).T @ x
        goal += (x * share).T @ target
        sum_goal += (target * share).sum(axis=0)
        weight += share.sum()
    mean = plain / n
    gram += weight * np.outer(mean, mean) - np.outer(mean, total) - np.outer(total, mean)
    inverse = np.linalg.inv(gram + RIDGE * np.eye(width))
    del gram
    weights = inverse @ (goal - np.outer(mean, sum_goal))
    wrong = np.zeros(code.shape[1])
    for x, target, share in blocks():
        x = x - mean
        lever = share * ((x @ inverse) * x).sum(axis=1, keepdims=True)
        left_out = target - (target - x @ weights) / (1 - lever)
        wrong += (left_out * target <= 0).sum(axis=0)
    trust = np.clip(1 - 2 * wrong / n, 0.05, 1)
    return Model(languages, code, mean, weights.astype(np.float32), (-mean @ weights).astype(np.float32), trust / trust.mean())


def fit(docs: DataFrame, learn=None) -> Model:
    """Learns from docs(doc_id, text, lang); learn: which rows may be learned from.

    Rows with null text, lang or id are left out; rows alike in id, text and lang count once. Of languages that lose equally little, the first by name wins.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter("lang is not null and doc_id is not null and text is not null")
    if learn is not None:
        rows = rows.filter(learn)
    # ids and languages alone are looked at for the sample
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    each = max(1, SAMPLE * LANGUAGES // max(LANGUAGES, len(sizes)))
    texts = sampled_texts(rows, rows.select("doc_id", text_hash().alias("_cg_text"), "lang"), "lang", each, max(1, len(sizes)))
    found = texts.mapInArrow(_features, "lang string, x binary")
    if sum(min(each, n) for n in sizes.values()) > HELD:
        return _fit_by_sums(staged(found, "language-sample"))
    got = found.collect()
    got.sort(key=lambda r: (r.lang, bytes(r.x)))
    languages = sorted({r.lang for r in got})
    width = 256 + DIMS
    if not languages:
        return Model([], codewords(0), *(np.zeros(0),) * 4)
    x = np.array([np.frombuffer(r.x, np.float32) for r in got], np.float64)
    own = np.searchsorted(languages, [r.lang for r in got])
    code = codewords(len(languages))
    if len(languages) == 1:
        return Model(languages, code, np.zeros(width), np.zeros((width, 1)), np.ones(1), np.ones(1))
    target = code[own]
    mean = x.mean(axis=0)
    x = x - mean
    # languages count alike, however many documents of each there are
    share = np.sqrt(len(x) / (len(languages) * np.bincount(own)[own]))[:, None]
    gram = (x * share) @ (x * share).T
    inverse = np.linalg.inv(gram + RIDGE * np.eye(len(x)))
    dual = inverse @ (target * share)
    weights = (x * share).T @ dual
    left_out = target - dual / np.diag(inverse)[:, None] / share  # what each row's margins are when it isn't learned from
    trust = np.clip(1 - 2 * (left_out * target <= 0).mean(axis=0), 0.05, 1)
    return Model(languages, code, mean, weights.astype(np.float32), (-mean @ weights).astype(np.float32), trust / trust.mean())


def _predicted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            for i in range(0, len(b), 200):
                part = b.slice(i, 200)
                langs, score = model.predict(features(part.column(1)))
                letters = part.column(2).to_pylist()
                langs = [v if has else UNDEFINED for v, has in zip(langs, letters, strict=True)]
                score = np.where(np.array(letters, bool), score, 0.0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(score < AMBIGUOUS)], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return run


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous of every row of docs(doc_id, text); `und` with score 0 for null text or text without a letter."""
    ship(docs.sparkSession)
    letter = F.coalesce(F.rlike("text", F.lit(r"\p{L}")), F.lit(False)).alias("_cg_letter")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), letter)
    return rows.mapInArrow(_predicted(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, lang_pred string, score double, ambiguous boolean")


def held_out(doc_id) -> F.Column:
    """Rows that are kept for measuring; a null id isn't one."""
    return F.coalesce(crc_mod(doc_id, 4) == 2, F.lit(False))
