"""Quality classifier: nearest-neighbour votes of labelled latent-semantic vectors, by exact blocked cosines."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import bound_batches, materialise, release

#: Hashed byte trigrams, then shares in [0, 1] that tell how a text is built, weighted as SHARE_WEIGHT.
TERMS, SHARES, SHARE_WEIGHT = 2048, 6, 1.5


def trigrams(text: bytes) -> np.ndarray:
    """Counts of hashed byte trigrams of a whole text."""
    x = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(x) < 3:
        return np.zeros(TERMS, np.float32)
    h = x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2545F491)
    return np.bincount(h >> np.uint32(21), minlength=TERMS).astype(np.float32)


def shares(text: bytes) -> np.ndarray:
    """Of words that repeat the word before; of repeated words, past what length explains; of upper case, digits, marks; of the commonest word."""
    words = text.split()
    if not words:
        return np.zeros(SHARES, np.float32)
    n, count = len(words), {}
    for w in words:
        count[w] = count.get(w, 0) + 1
    again = sum(map(bytes.__eq__, words, words[1:])) / n
    x = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, digits = x[65:91].sum(), x[48:58].sum()
    marks = x[33:48].sum() + x[58:65].sum() + x[91:97].sum() + x[123:127].sum()
    of = np.array([again, max(0.0, 1 - len(count) / n - 0.5) * 2, upper / len(text), digits / len(text), min(1.0, 3 * marks / len(text)), max(count.values()) / n], np.float32)
    return of * np.float32(n / (n + 10))  # a few words tell little


def features(texts: list[bytes]) -> np.ndarray:
    return np.array([np.concatenate([trigrams(t), shares(t)]) for t in texts], np.float32).reshape(-1, TERMS + SHARES)


@dataclass
class Model:
    """Labelled vectors in the latent space, the weight of each one's vote, and what maps a text there."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    votes: np.ndarray
    labels: np.ndarray

    @staticmethod
    def terms(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
        """Weighted terms of features (float32), in their place."""
        t = x[:, :TERMS]
        np.log1p(t, out=t)
        t *= idf
        t /= np.maximum(np.linalg.norm(t, axis=1, keepdims=True), 1e-12)
        x[:, TERMS:] *= SHARE_WEIGHT
        return x

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray, prior: dict[int, int], rank: int) -> Model:
        """prior: labelled rows of each class, of which x holds a sample; x is overwritten."""
        n = len(x)
        idf = (np.log((n + 1) / ((x[:, :TERMS] > 0).sum(axis=0) + 1)) + 1).astype(np.float32)
        t = cls.terms(x, idf)
        _, axes = np.linalg.eigh((t.T @ t).astype(np.float64)) if n else (None, np.eye(TERMS + SHARES))
        axes = axes[:, ::-1][:, :rank].copy()
        share = {c: prior[c] / max(1, int((labels == c).sum())) for c in (0, 1)}
        return cls(idf, axes, cls.unit(t @ axes), np.array([share[int(c)] for c in labels]), labels)

    @staticmethod
    def unit(z: np.ndarray) -> np.ndarray:
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def scores(self, texts: list[bytes], k: int, power: int, block: int = 256) -> np.ndarray:
        """Share of the label 1 in the votes of the k nearest labelled vectors. With no similar one: its share in all votes."""
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        base = float((self.votes * self.labels).sum() / self.votes.sum())
        out = []
        for s in range(0, len(texts), block):
            z = self.unit(self.terms(features(texts[s : s + block]), self.idf) @ self.axes)
            near = z @ self.vectors.T
            top = nearest(near, k)
            vote = np.maximum(np.take_along_axis(near, top, axis=1), 0) ** power * self.votes[top]
            total = vote.sum(axis=1)
            out.append(np.where(total > 1e-12, (vote * self.labels[top]).sum(axis=1) / np.maximum(total, 1e-12), base))
        return np.clip(np.concatenate(out), 0, 1) if out else np.empty(0)


def nearest(near: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest values of each row, at a tie for the last ones the first places; all, if they are fewer."""
    n = near.shape[1]
    if n <= k:
        return np.tile(np.arange(n), (len(near), 1))
    top = np.argpartition(near, n - k, axis=1)[:, n - k :]
    taken = np.take_along_axis(near, top, axis=1)
    least = taken.min(axis=1, keepdims=True)
    for r in np.nonzero((near == least).sum(axis=1) > (taken == least).sum(axis=1))[0]:
        top[r] = np.argsort(-near[r], kind="stable")[:k]
    return top


def held_out(id_col: str = "doc_id", folds: int = 5, fold: int = 0) -> Column:
    """crc32 of the id as text, modulo folds, is fold. A null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 2000, rank: int = 64, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """A model from at most `sample` labelled documents of each class outside the held-out fold, those with the least hashed ids.

    The bound is what makes the broadcast bounded: 2 x sample x rank numbers. One task fits the model from the sampled
    rows (33 MB of features at the bound), so only the model itself comes to the driver. The share of each class in
    all labelled rows weights its votes. Labels other than 0 and 1 and null ids are left out; an id labelled twice
    counts with its greatest label.
    """
    bound_batches(docs)
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    known = materialise(known.where(~held_out("id")).groupBy("id").agg(F.max("y").alias("y")), "labels")
    prior = {0: 0, 1: 0} | {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = known.where("y = 0").orderBy(F.xxhash64("id"), "id").limit(sample).union(known.where("y = 1").orderBy(F.xxhash64("id"), "id").limit(sample))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id").select("id", "y", "text")

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f.tobytes() for f in features(texts)], pa.binary())], ["id", "y", "x"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y = [np.empty((0, TERMS + SHARES), np.float32)], [np.empty(0, np.int64)]
        for batch in batches:
            x.append(np.array([np.frombuffer(b.as_py(), np.float32) for b in batch.column(2)], np.float32).reshape(-1, TERMS + SHARES))
            y.append(batch.column(1).to_numpy().astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Model.fit(np.concatenate(x), np.concatenate(y), prior, rank))], pa.binary())], ["model"])
        release()

    sampled = rows.mapInArrow(described, "id long, y int, x binary").orderBy("id", "x").limit(2 * sample)
    made = sampled.repartition(1).sortWithinPartitions("id", "x").mapInArrow(fitted, "model binary").collect()
    return pickle.loads(made[0].model) if made else Model.fit(np.empty((0, TERMS + SHARES), np.float32), np.empty(0, np.int64), prior, rank)


def score(docs: DataFrame, model: Model, k: int = 15, power: int = 4, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds held_out, score and predicted to doc_id and text of each row; see classify."""
    bound_batches(docs)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]
            got = held.value.scores(texts, k, power)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.float64()), pa.array((got >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])
        release()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, **of_fit: int) -> DataFrame:
    """Quality of every whole text: doc_id, held_out, score (0 to 1), predicted (1 from a score of 0.3 on), a row for each row.

    Of labelled vectors that are equally near, those with the least ids vote, up to the rounding of the products.
    Null and empty texts: no vector, so the share of label 1 among labelled rows; null ids keep their row. Repeated
    rows give repeated results. No labels at all: 0.5. Empty documents: no rows. Other columns are not read, and a
    score comes from the text alone.
    """
    return score(docs, fit(docs, labels, **of_fit))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, k: int = 15, power: int = 4, text_col: str = "text", **of_fit: int) -> DataFrame:
    """Rows of docs whose score is at least the threshold, with all their columns; see classify for nulls and repeats."""
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, text_col=text_col, **of_fit))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()]
            yield batch.filter(pa.array(held.value.scores(texts, k, power) >= threshold))
        release()

    return docs.mapInArrow(run, docs.schema)
