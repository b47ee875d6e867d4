"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text becomes weighted counts of its byte trigrams, hashed, and projected to a few latent dimensions.
The labelled vectors are broadcast; each document's cosines with all of them are computed in blocks, and
its nearest ones vote in proportion to their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes

#: Most labelled documents that are learned from, whatever the corpus; latent dimensions; voters.
SAMPLE, LATENT, VOTERS = 4096, 48, 15
#: A document is accepted at this score.
ACCEPT = 0.3
#: Buckets of trigrams, as a power of two; documents that meet the voters at once; steps of a unit of latent length.
BITS, BLOCK, STEPS = 12, 512, 2048
#: Bytes of text that are read at once, or one text.
BYTES = 16 << 20


def trigrams(text: str | None) -> np.ndarray:
    """Counts of the whole text's byte trigrams by bucket, on a log scale and of unit length; zero if it has fewer than 3 bytes."""
    codes, counts = np.frombuffer((text or "").encode(), np.uint8), np.zeros(1 << BITS, np.float32)
    for k in range(0, len(codes) - 2, 1 << 20):
        c = codes[k : k + (1 << 20) + 2].astype(np.uint32)
        each = (c[:-2] << np.uint32(16)) | (c[1:-1] << np.uint32(8)) | c[2:]
        counts += np.bincount((each * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS), minlength=1 << BITS)
    total = counts.sum()
    return unit(np.log1p(counts * (1000 / total))[None])[0] if total else counts


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass(frozen=True)
class Voters:
    rarity: np.ndarray  # weight of each bucket
    mean: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def latent(self, x: np.ndarray) -> np.ndarray:
        """Unit vectors in whole steps. A row's do not depend on the rows beside it, and products of two are exact in single precision."""
        return self.steps(unit(x * self.rarity) - self.mean)

    def steps(self, centred: np.ndarray) -> np.ndarray:
        return np.rint(unit(np.stack([row @ self.basis for row in centred])) * STEPS).astype(np.float32)

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        if not len(self.labels) or not texts:
            return out
        x = np.stack([trigrams(t) for t in texts])
        near = self.latent(x) @ self.vectors.T
        k = min(VOTERS, near.shape[1])
        # Of voters just as near the first count.
        rank = near.astype(np.int64) * near.shape[1] - np.arange(near.shape[1])
        top = np.sort(np.argpartition(-rank, k - 1, axis=1)[:, :k], axis=1)
        weight = np.maximum(np.take_along_axis(near, top, axis=1).astype(np.float64) / STEPS**2, 0.0) + 1e-6
        votes = (weight * self.labels[top]).sum(axis=1) / weight.sum(axis=1)
        return np.where(x.any(axis=1), np.clip(votes, 0.0, 1.0), out)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Voters:
    """Learns from at most SAMPLE labelled documents, those of docs with the least hash of doc_id.

    Only labels with a quality and with a crc32 of doc_id not divisible by 5 count; a doc_id labelled
    more than once has its mean; of the texts that share a doc_id the one with the least hash counts. Without any the prior is 1/2 and all scores equal it.
    """
    marked = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").filter(~held_out(F.col("doc_id")))
    marked = marked.groupBy("doc_id").agg(F.avg("quality").alias("mark")).join(docs.select("doc_id"), "doc_id", "left_semi")
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)  # at most SAMPLE rows, so it may be broadcast
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "mark", "text", F.xxhash64("text").alias("h"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = pa.array([trigrams(t.as_py()).astype(np.float16).tobytes() for t in b.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), rows], ["doc_id", "mark", "h", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    each = found.mapInArrow(vectors, f"doc_id {kind}, mark double, h long, x binary")
    got = each.groupBy("doc_id", "mark").agg(F.min(F.struct("h", "x"))["x"].alias("x")).orderBy("doc_id").limit(SAMPLE).toArrow()
    y = np.array(got["mark"].to_pylist(), np.float64)
    prior = float(y.mean()) if len(y) else 0.5
    if not len(y):
        none = np.zeros(0)
        return Voters(none, none, np.zeros((0, 0)), np.zeros((0, 0)), y, prior)
    # The sample is held once, and changed in place.
    z = np.empty((len(y), 1 << BITS), np.float32)
    for row, b in zip(z, got["x"], strict=True):
        row[:] = np.frombuffer(b.as_buffer(), np.float16)
    del got
    rarity = (1 + np.log((1 + len(z)) / (1 + np.count_nonzero(z, axis=0)))).astype(np.float32)
    z *= rarity
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    mean = z.mean(axis=0)
    z -= mean
    # Randomized truncated SVD, with a fixed seed.
    rng = np.random.default_rng(7)
    q = z.T @ rng.standard_normal((len(z), min(LATENT + 16, *z.shape))).astype(np.float32)
    for _ in range(4):
        q = z.T @ (z @ np.linalg.qr(q)[0])
    q = np.linalg.qr(q)[0]
    _, _, vt = np.linalg.svd(z @ q, full_matrices=False)
    found = Voters(rarity, mean, (q @ vt.T)[:, :LATENT].astype(np.float32), np.zeros((0, 0)), y, prior)
    return replace(found, vectors=found.steps(z))


def scored(docs: DataFrame, labels: DataFrame, columns: list[str], keep=None) -> DataFrame:
    """columns of docs and score double; keep: of rows with such scores only, without the score."""
    voters = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    at, asked = columns.index("text"), docs.select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in by_bytes(whole, at, BYTES)):
            for k in range(0, len(b), BLOCK):
                part = b.slice(k, BLOCK)
                score = voters.value.score(part.column(at).to_pylist())
                if keep is not None:
                    yield part.filter(pa.array(keep(score)))
                else:
                    yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(part.columns) if i != at), pa.array(score)], [*(c for c in columns if c != "text"), "score"])

    left = asked.schema if keep is not None else asked.drop("text").schema.add("score", "double")
    return asked.mapInArrow(run, left)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, held_out, score, predicted.

    score is between 0 and 1, higher the likelier label 1; only the text bears on it. Null and empty
    texts, and those of fewer than 3 bytes, have the mean label as score. predicted is 1 from
    ACCEPT on. A null doc_id counts as not held out. Rows that share a doc_id are scored each by
    its text. An empty table gives an empty result; other columns are ignored.
    """
    out = scored(docs, labels, ["doc_id", "text"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that quality() accepts, with all their columns; labels without a quality count for nothing. Documents are not shuffled."""
    return scored(docs, labels, docs.columns, keep=lambda score: score >= ACCEPT)
