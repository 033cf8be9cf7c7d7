"""Toxicity by a factorization machine over hashed terms.

Terms are a text's distinct lower-case words and the first four and five letters of longer ones, hashed into buckets.
Buckets that tell the classes apart in the training rows become the features, each present or absent, so the length of
a text does not dilute them. The machine adds to the linear weights an inner product of two latent vectors for each pair
of features, which learns that an insult with a group mention is worse than either (Rendle, "Factorization machines").

Learning uses a sample bounded by MAX_TRAIN labelled rows, drawn by a hash of the id; the model has at most
MAX_FEATURES * (1 + FACTORS) weights, whatever the corpus. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldledger.llm.common import cache, held_out, small_batches, take_turn
from fieldledger.session import broadcast_if_small, table

BUCKET_BITS = 22
#: Most labelled rows of each class that are learnt from.
MAX_TRAIN = {1: 4_000, 0: 8_000}
MAX_FEATURES = 1024
FACTORS = 4
LEAST_Z = 4.0
LEAST_DOCS = 4
STEPS = 150
WORD = re.compile(r"[^\W\d_]+")
MEMO = 400_000


class Hashed(dict):
    """Words to the buckets of their terms."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > MEMO:
            self.clear()
        terms = {word, *(f"{word[:k]}*" for k in (4, 5) if len(word) > k)}
        got = tuple(zlib.crc32(t.encode()) >> (32 - BUCKET_BITS) for t in terms)
        if len(word) < 64:
            self[word] = got
        return got


_hashed = cache("toxicity", Hashed())


def buckets(text: str | None) -> set[int]:
    """The distinct buckets of a text's terms; none for a null or empty text."""
    found: set[int] = set()
    for word in set(WORD.findall((text or "").lower())):
        found.update(_hashed[word])
    return found


@dataclass
class Model:
    """Bias, linear weights and latent vectors of the selected buckets."""

    bias: float
    ids: np.ndarray
    linear: np.ndarray
    latent: np.ndarray

    def margin(self, rows: np.ndarray) -> float:
        v = self.latent[rows]
        return float(self.bias + self.linear[rows].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum()))


def select_features(terms: np.ndarray, owners: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Buckets whose document frequencies in the classes differ by LEAST_Z standard errors, strongest first, then smallest.

    terms[i] is in row owners[i]; only the buckets present take memory.
    """
    n = [int((labels == c).sum()) for c in (0, 1)]
    if not all(n) or not len(terms):
        return np.zeros(0, np.int64)
    present, place = np.unique(terms, return_inverse=True)
    toxic = labels[owners] == 1
    counts = [np.bincount(place[~toxic], minlength=len(present)), np.bincount(place[toxic], minlength=len(present))]
    total = counts[0] + counts[1]
    p = total / sum(n)
    z = np.abs(counts[1] / n[1] - counts[0] / n[0]) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n[0] + 1 / n[1]))
    found = np.flatnonzero((z >= LEAST_Z) & (total >= LEAST_DOCS))
    return present[found[np.argsort(-z[found], kind="stable")][:MAX_FEATURES]].astype(np.int64)


def fit(rows: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Model:
    """Full-batch Adam on the logistic loss; without both classes, a constant. rows: distinct buckets of each row."""
    sizes = np.array([len(r) for r in rows], np.int64)
    owners = np.repeat(np.arange(len(rows)), sizes)
    return _fit(np.concatenate(rows) if len(rows) else np.zeros(0, np.int64), owners, labels, seed)


def _fit(terms: np.ndarray, owners: np.ndarray, labels: np.ndarray, seed: int) -> Model:
    ids = np.sort(select_features(terms, owners, labels))
    share = float(labels.mean()) if len(labels) else 0.0
    if not len(ids):
        share = min(max(share, 0.01), 0.99)
        return Model(float(np.log(share / (1 - share))), ids, np.zeros(0), np.zeros((0, FACTORS)))
    place = np.minimum(np.searchsorted(ids, terms), len(ids) - 1)
    known = ids[place] == terms
    x = np.zeros((len(labels), len(ids)), np.float32)
    x[owners[known], place[known]] = 1
    rng = np.random.default_rng(seed)
    params = [np.zeros(1), np.zeros(len(ids)), rng.normal(0, 0.05, (len(ids), FACTORS))]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    y = labels.astype(np.float32)
    for step in range(1, STEPS + 1):
        grads = _gradient(x, y, *params)
        for p, d, (m1, m2) in zip(params, grads, moments, strict=True):
            m1 += 0.1 * (d - m1)
            m2 += 0.001 * (d * d - m2)
            p -= 0.05 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return Model(float(params[0][0]), ids, params[1], params[2])


def _gradient(x: np.ndarray, y: np.ndarray, bias: np.ndarray, w: np.ndarray, v: np.ndarray) -> list[np.ndarray]:
    """Of the mean logistic loss and the weights' penalties. All that is as long as x stays in single precision."""
    narrow = v.astype(np.float32)
    s = x @ narrow
    margin = np.float32(bias[0]) + x @ w.astype(np.float32) + np.float32(0.5) * ((s**2).sum(1) - x @ (narrow**2).sum(1))
    g = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) / np.float32(len(y))
    xg = g @ x
    return [np.array([g.sum()], np.float64), xg + 1e-5 * w, ((g[:, None] * s).T @ x).T - v * xg[:, None] + 1e-4 * v]


def _bucket_rows(batches):
    take_turn("toxicity")
    for batch in small_batches(batches):
        found = [sorted(buckets(t)) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, pa.list_(pa.int32()))], ["label", "terms"])


def train(docs: DataFrame, labels: DataFrame, seed: int = 7) -> Model:
    """Learns from labelled rows outside the held-out fold; rows without a label of 0 or 1, or with a null id, are not used.

    Rows that repeat an id are drawn together; labels that repeat one count each.
    """
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out()).select("doc_id", F.col("toxic").cast("int").alias("label"))
    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    share = F.lit(0.0)
    for label, count in n.items():
        share = F.when(F.col("label") == label, F.lit(min(1.0, MAX_TRAIN[label] / count))).otherwise(share)
    sample = rows.filter(draw < share)  # MAX_TRAIN rows, about; all that repeat a drawn id
    sample = broadcast_if_small(sample, sample.count())
    texts = docs.select("doc_id", "text").join(sample, "doc_id").select("text", "label")
    got = texts.mapInArrow(_bucket_rows, "label int, terms array<int>").toArrow()
    y = got.column("label").to_numpy().astype(np.int64)
    flat = got.column("terms").combine_chunks()
    flat = flat if isinstance(flat, pa.ListArray) else pa.concat_arrays(flat.chunks) if flat.num_chunks else pa.array([], pa.list_(pa.int32()))
    owners = np.repeat(np.arange(len(y)), np.diff(flat.offsets.to_numpy()))
    return _fit(flat.flatten().to_numpy(), owners, y, seed)


def _scores(model: Model, texts: list) -> np.ndarray:
    where = {int(b): i for i, b in enumerate(model.ids)}
    known = where.keys()
    margins = [model.margin(np.array([where[b] for b in buckets(t) & known], np.int64)) for t in texts]
    return 1 / (1 + np.exp(-np.clip(np.array(margins, np.float64), -30, 30)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text; further columns are not looked at).

    A null or empty text, and one without a known term, has no features: its score is that of the bias alone. A score of
    one half is predicted toxic. Rows that repeat an id are scored one by one, null ids too; an empty table gives no rows.
    """

    def run(batches):
        take_turn("toxicity")
        for batch in small_batches(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_scores(model, batch.column("text").to_pylist()))], ["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that score under one half, columns as they came, of whatever names; each row is judged by its own text."""
    model = train(docs, labels)

    def run(batches):
        take_turn("toxicity")
        for batch in small_batches(batches):
            yield batch.filter(pa.array(_scores(model, batch.column("text").to_pylist()) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
