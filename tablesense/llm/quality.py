"""Quality classifier: learned vectors of hashed words and character n-grams, averaged per document, softmax on top.

Training is plain numpy stochastic gradient descent on a bounded sample of labelled rows (``rows`` per
class, ``max_bytes`` of text together). Scoring is one pass over the documents without a shuffle: the
softmax of an average is linear in the vectors, so each bucket's vector times the output weights is a
table, and a text's score is the mean of its entries.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesense.llm.common import SPACE, joined, labelled_sample, map_batches, pieces, prefix_hash, runs, sliced, span_hashes

BUCKETS = 1 << 17
GRAMS = (3, 4, 5)
REPEAT = 0
"""Bucket of a word that repeats the one before it."""
DIM = 8
ROWS = 2000
MAX_BYTES = 10_000_000
EPOCHS = 6


def features(group: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and of all character n-grams of the texts, and the text each belongs to.

    n-grams are byte n-grams within a word and the white space at its ends. The words' case counts. A word
    that repeats the one before it adds one more feature, the same for all words.
    """
    data, starts = joined(group)
    data, starts = np.concatenate((np.array([32], np.uint8), data)), starts + 1
    space = SPACE[data]
    data = np.where(space, np.uint8(32), data)
    word_start, word_end = runs(~space)
    words = span_hashes(prefix_hash(data), word_start, word_end) & np.uint64(BUCKETS - 1)
    doc = np.searchsorted(starts, word_start, side="right")
    again = np.flatnonzero((words[1:] == words[:-1]) & (doc[1:] == doc[:-1])) + 1
    found, where = [words.astype(np.int32), np.full(len(again), REPEAT, np.int32)], [word_start, word_start[again]]
    inner = np.concatenate(([0], np.cumsum(space, dtype=np.int32)))
    wide = data.astype(np.uint32)
    for n in GRAMS:
        count = len(data) - n + 1
        if count <= 0:
            continue
        at = np.flatnonzero(inner[n - 1 : n - 1 + count] == inner[1 : 1 + count])
        h = np.full(count, n, np.uint32)
        for k in range(n):
            h *= np.uint32(0x01000193)
            h ^= wide[k : k + count]
        h = h[at]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
        found.append((h & np.uint32(BUCKETS - 1)).astype(np.int32))
        where.append(at)
    # an n-gram may begin with the space before its word, which belongs to the text before
    return np.concatenate(found), np.searchsorted(starts, np.concatenate(where) + 1, side="right") - 1


@dataclass(frozen=True)
class Model:
    table: np.ndarray
    """Logit of label 1 against label 0 that each bucket adds to the mean."""
    bias: float

    def logits(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        for first, group in pieces(texts):
            bucket, doc = features(group)
            count = np.bincount(doc, minlength=len(group))
            total = np.bincount(doc, self.table[bucket], minlength=len(group))
            out[first : first + len(group)] += total / np.maximum(count, 1)
        return out


def train(sample: list[tuple[str, int, str | None]], dim: int = DIM, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Fit on (text, label, lang). With fewer than two classes the constant answer is the only one there is."""
    labels = np.array([y for _, y, _ in sample], np.int64)
    if len(np.unique(labels)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 0.0 if not len(labels) else (4.0 if labels[0] else -4.0))
    docs = []
    for text, _, _ in sample:
        bucket, _ = features([text.encode("utf-8", "replace")])
        ids, counts = np.unique(bucket, return_counts=True)
        docs.append((ids, (counts / max(1, counts.sum())).astype(np.float32)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    output, bias = rng.normal(0, 0.1, (dim, 2)).astype(np.float32), np.zeros(2, np.float32)
    weight = len(labels) / (2 * np.bincount(labels, minlength=2))
    held = rng.permutation(len(docs)) % 5 == 0
    learn = np.flatnonzero(~held)
    vector_sq, output_sq, bias_sq = np.full(BUCKETS, 1e-6, np.float32), np.full((dim, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    step = 0.3
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(learn), max(1, len(learn) // 16)):
            rows = [docs[i] for i in batch if len(docs[i][0])]
            if not rows:
                continue
            y = labels[[i for i in batch if len(docs[i][0])]]
            ids, share = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
            at = np.cumsum([0] + [len(r[0]) for r in rows[:-1]])
            mean = np.add.reduceat(vectors[ids] * share[:, None], at, axis=0)
            logit = mean @ output + bias
            p = np.exp(logit - logit.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p *= weight[y][:, None].astype(np.float32)
            d_mean, d_output, d_bias = p @ output.T, mean.T @ p / len(y), p.mean(axis=0)
            doc = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
            near, back = np.unique(ids, return_inverse=True)
            d_vector = np.stack([np.bincount(back, share * d_mean[doc, k], len(near)) for k in range(dim)], axis=1)
            vector_sq[near] += (d_vector**2).mean(axis=1)
            output_sq += d_output**2
            bias_sq += d_bias**2
            vectors[near] -= (step * d_vector / np.sqrt(vector_sq[near])[:, None]).astype(np.float32)
            output -= step * d_output / np.sqrt(output_sq)
            bias -= step * d_bias / np.sqrt(bias_sq)
    table = vectors @ (output[:, 1] - output[:, 0])
    raw = Model(table.astype(np.float32), float(bias[1] - bias[0]))
    check = np.flatnonzero(held)
    logits = raw.logits([sample[i][0] for i in check])
    return Model(raw.table, raw.bias - cut(logits, labels[check]))


def cut(logits: np.ndarray, labels: np.ndarray, weight: float = 2.0) -> float:
    """The logit to cut at, from rows kept out of training: middle of the range with the best rates.

    The share of label 1 that is kept counts ``weight`` times as much as the share of label 0 that goes.
    """
    order = np.argsort(logits, kind="stable")
    return cut_between(logits[order], labels[order] == 0, labels[order] == 1, weight)


def cut_between(x: np.ndarray, zeros: np.ndarray, ones: np.ndarray, weight: float = 2.0) -> float:
    """``cut`` of rising logits ``x``, each with its number of rows of label 0 and 1."""
    if not zeros.any() or not ones.any():
        return 0.0
    # cutting before i: rows from i on count as 1
    gone = np.concatenate(([0], np.cumsum(zeros))) / zeros.sum()
    kept = np.concatenate((np.cumsum(ones[::-1])[::-1], [0])) / ones.sum()
    right = gone + weight * kept
    best = np.flatnonzero(right >= right.max() - 1e-9)
    edges = np.concatenate(([x[0] - 1], (x[1:] + x[:-1]) / 2, [x[-1] + 1]))
    return float(edges[best[len(best) // 2]])


def score(documents: DataFrame, model: Model, *keep: str | Column) -> DataFrame:
    """The columns ``keep`` of every document with ``score`` (probability of label 1). Null and empty texts get the bias.

    The text itself need not be kept; extra columns of ``documents`` do not matter.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select(*keep, F.col("text").alias("_scored_text"))
    kept = rows.drop("_scored_text").schema.fieldNames()

    def run(batches):
        for batch in sliced(batches):
            logits = shared.value.logits(batch.column("_scored_text").to_pylist())
            scores = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(scores, pa.float64())], names=[*kept, "score"])

    return map_batches(rows, run, rows.drop("_scored_text").schema.add("score", "double"))


def fit(documents: DataFrame, labels: DataFrame, learn: Column, target: str = "quality", rows: int = ROWS, max_bytes: int = MAX_BYTES) -> Model:
    """Train on a bounded sample of the labelled rows that ``learn`` (a condition on ``doc_id``) admits."""
    return train(labelled_sample(documents, labels, target, learn, rows, max_bytes))


def accepted(documents: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``documents`` (text, anything else) whose score is at least ``least``, columns as they are."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    place = documents.columns.index("text")
    limit = float(np.log(least / (1 - least)))

    def run(batches):
        for batch in sliced(batches):
            yield batch.filter(pa.array(shared.value.logits(batch.column(place).to_pylist()) >= limit))

    return map_batches(documents, run, documents.schema)
