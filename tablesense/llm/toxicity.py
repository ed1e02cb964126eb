"""Toxicity: a convolutional text classifier in numpy with thresholds by language.

A word's embedding is the sum of hashed vectors for the word and for its beginnings, so that unseen endings
of a known stem are near it; filters of several widths slide over them; each filter keeps its maximum
over the text; a logistic layer reads the maxima. Training starts on the driver with a bounded sample of labelled
rows (``rows`` per class, ``max_bytes`` of text together) and goes on with passes of Spark tasks over all labelled rows,
whose nets are averaged. One row in ``HELD`` is kept out of training; all of these pick the pass and the thresholds.
Buckets that few learning texts hold stay at zero, and each step shrinks the vectors it touches, so that a long
text of rare words has no chance maxima. A document that ``labels`` puts in both classes is learned from twice.
Scoring is one pass over whole texts without a shuffle. The language never enters a score; it only picks
the threshold behind ``flagged``.
"""

from __future__ import annotations

import copy
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesense.llm.common import (
    LETTER, LOWER, class_weights, groups, joined, kept_out, labelled_sample, labelled_texts, map_batches, mean_of_tasks, pieces, prefix_hash, runs, sliced,
    span_hashes, stored,
)
from tablesense.llm.quality import cut, cut_between

BUCKETS = 1 << 18
STEMS = (4, 5, 6)
"""Lengths in bytes of the beginnings of words that have vectors of their own."""
DIM = 12
WIDTHS = (1, 2, 3)
FILTERS = 16
PAD = max(WIDTHS) - 1
ROWS = 2000
MAX_BYTES = 24_000_000
EPOCHS = 16
AVERAGE = 4
"""The net is the mean of so many epochs in a row."""
PATIENCE = 6
"""Epochs without a lower held loss after which training ends."""
LEAST_DOCS, LEAST_SHARE = 3, 0.004
"""A bucket that fewer learning texts hold, in number or share, keeps the zero vector: under max pooling, untrained vectors would win."""
SCALE = 0.05
"""Spread of the first vectors; small, so that a trained word stands out of a long text."""
SHRINK = 1e-2
"""Pull of each step on the vectors it touches."""
CLEAN_WEIGHT = 4.0
"""A share of the clean rows lost counts as so many equal shares of the toxic rows found, when a threshold is set."""
CHUNK = 1 << 16
BATCH = 32
HELD = 4
"""One labelled row in so many is kept out of training."""
PASSES = 3
"""Passes of distributed training over all labelled rows."""
BINS = 1024
"""Steps of a logit at which thresholds over all rows kept out may lie."""


def tokens(group: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words of the texts one after the other, each text followed by padding, and where each text starts.

    A row holds the buckets of a word and of its beginnings. Words are runs of letters and digits, A-Z lowered; every byte beyond ASCII counts as a letter. Bucket 0 is padding.
    """
    data, starts = joined(group)
    data = LOWER[data]
    word_start, word_end = runs(LETTER[data])
    doc = np.searchsorted(starts, word_start, side="right") - 1
    out = np.zeros((len(word_start) + len(group) * PAD, 1 + len(STEMS)), np.int32)
    at, prefix = np.arange(len(word_start)) + doc * PAD, prefix_hash(data)
    for n, most in enumerate((None, *STEMS)):
        end = word_end if most is None else np.minimum(word_end, word_start + most)
        out[at, n] = (span_hashes(prefix, word_start, end) % np.uint64(BUCKETS - 1)).astype(np.int32) + 1
    first = np.searchsorted(doc, np.arange(len(group))) + np.arange(len(group)) * PAD
    return out, first


@dataclass
class Net:
    """Parameters; ``filters[w]`` has the shape (w, DIM, FILTERS), w from 1 up without gaps."""

    vectors: np.ndarray
    filters: dict[int, np.ndarray]
    offsets: dict[int, np.ndarray]
    output: np.ndarray
    bias: float
    thresholds: dict[str, float] = field(default_factory=dict)
    """Logit by language; languages without enough calibration rows use 0, the common threshold."""

    def maxima(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Largest value of each filter in each text, before the offset. Long inputs go in chunks of places."""
        top = np.full((len(first), FILTERS * len(WIDTHS)), -np.inf, np.float32)
        ends = np.append(first[1:], len(ids))
        padded = np.concatenate((ids, np.zeros((PAD, ids.shape[1]), np.int32)))
        for a in range(0, len(ids), CHUNK):
            b = min(a + CHUNK, len(ids))
            here = np.flatnonzero((first < b) & (ends > a))
            at = np.maximum(first[here], a) - a
            words, empty = self.embed(padded[a : b + PAD]), padded[a:b, 0] == 0
            for n, w in enumerate(WIDTHS):
                value = words[: b - a] @ self.filters[w][0]
                for k in range(1, w):
                    value += words[k : b - a + k] @ self.filters[w][k]
                value[empty] = -np.inf  # a place without a word starts nothing; a text without words leaves every filter off
                part = slice(n * FILTERS, (n + 1) * FILTERS)
                top[here, part] = np.maximum(top[here, part], np.maximum.reduceat(value, at, axis=0))
        return top

    def embed(self, ids: np.ndarray) -> np.ndarray:
        words = self.vectors[ids[:, 0]]
        for n in range(1, ids.shape[1]):
            words += self.vectors[ids[:, n]]
        return words

    def logits(self, texts: list[str | None]) -> np.ndarray:
        offset = np.concatenate([self.offsets[w] for w in WIDTHS])
        out = np.zeros(len(texts))
        for start, group in pieces(texts):
            ids, first = tokens(group)
            out[start : start + len(group)] = np.maximum(self.maxima(ids, first) + offset, 0) @ self.output + self.bias
        return out


def blank(rng: np.random.Generator) -> tuple[Net, dict]:
    """A net before training and the sums of squared gradients that set its steps."""
    net = Net(
        rng.normal(0, SCALE, (BUCKETS, DIM)).astype(np.float32),
        {w: rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS},
        {w: np.zeros(FILTERS, np.float32) for w in WIDTHS},
        rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32),
        0.0,
    )
    net.vectors[0] = 0
    squares = {"v": np.full(BUCKETS, 1e-4), "o": np.full(len(net.output), 1e-4), "b": 1e-4}
    squares |= {("f", w): np.full(net.filters[w].shape, 1e-4) for w in WIDTHS} | {("c", w): np.full(FILTERS, 1e-4) for w in WIDTHS}
    return net, squares


def places(net: Net, ids: np.ndarray, first: np.ndarray) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    """Where each filter has its maximum in each text, and that value with the offset, by width. Long inputs go in chunks of places."""
    ends = np.append(first[1:], len(ids) - PAD)
    at = {w: np.repeat(first[:, None], FILTERS, axis=1) for w in WIDTHS}
    top = {w: np.full((len(first), FILTERS), -np.inf, np.float32) for w in WIDTHS}
    stacked = np.concatenate([net.filters[w][k] for w in WIDTHS for k in range(w)], axis=1)
    for a in range(0, len(ids) - PAD, CHUNK):
        b = min(a + CHUNK, len(ids) - PAD)
        every, empty = net.embed(ids[a : b + PAD]) @ stacked, ids[a:b, 0] == 0
        here = np.flatnonzero((first < b) & (ends > a))
        for w in WIDTHS:
            left = FILTERS * w * (w - 1) // 2
            value = every[: b - a, left : left + FILTERS] + net.offsets[w]
            for k in range(1, w):
                value += every[k : b - a + k, left + k * FILTERS : left + (k + 1) * FILTERS]
            value[empty] = -np.inf
            for i in here:
                start = max(first[i], a)
                found = start + value[start - a : min(ends[i], b) - a].argmax(axis=0)
                most = value[found - a, np.arange(FILTERS)]
                at[w][i] = np.where(most > top[w][i], found, at[w][i])
                top[w][i] = np.maximum(top[w][i], most)
    return at, top


def step(net: Net, squares: dict, fixed: np.ndarray, ids: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray, size: float = 0.1) -> None:
    """One step of Adagrad on the texts ``ids`` (from ``first`` on, one more padding at the end) of labels ``y``.

    Gradients reach the embeddings through the place of each maximum; the vectors of ``fixed`` buckets stay.
    """
    at, top = places(net, ids, first)
    h = np.concatenate([np.maximum(top[w], 0) for w in WIDTHS], axis=1)
    p = 1 / (1 + np.exp(-np.clip(h @ net.output + net.bias, -30, 30)))
    d = (p - y) * weight[y.astype(int)]
    d_hidden = np.outer(d, net.output) * (h > 0)
    d_output, d_bias = h.T @ d / len(y), d.mean()
    touched, changes = [], []
    for n, w in enumerate(WIDTHS):
        dh = d_hidden[:, n * FILTERS : (n + 1) * FILTERS]
        d_filter = np.zeros_like(net.filters[w])
        for k in range(w):
            here = ids[(at[w] + k).ravel()]
            touched.append(here)
            changes.append((dh[:, :, None] * net.filters[w][k].T[None]).reshape(-1, DIM))
            d_filter[k] = np.einsum("bf,bfd->df", dh, net.embed(here).reshape(len(y), FILTERS, DIM)) / len(y)
        squares["f", w] += d_filter**2
        net.filters[w] -= (size * d_filter / np.sqrt(squares["f", w])).astype(np.float32)
        d_offset = dh.mean(axis=0)
        squares["c", w] += d_offset**2
        net.offsets[w] -= (size * d_offset / np.sqrt(squares["c", w])).astype(np.float32)
    rows, change = np.concatenate(touched), np.concatenate(changes)
    used, back = np.unique(rows, return_inverse=True)
    d_vector = np.zeros((len(used), DIM))
    np.add.at(d_vector, back.ravel(), np.repeat(change, rows.shape[1], axis=0))
    d_vector = d_vector / len(y) + SHRINK * net.vectors[used]
    squares["v"][used] += (d_vector**2).mean(axis=1)
    moved = ~fixed[used]
    net.vectors[used[moved]] -= (size * d_vector / np.sqrt(squares["v"][used])[:, None])[moved].astype(np.float32)
    squares["o"] += d_output**2
    net.output -= (size * d_output / np.sqrt(squares["o"])).astype(np.float32)
    squares["b"] += d_bias**2
    net.bias -= float(size * d_bias / np.sqrt(squares["b"]))


def train(sample: list[tuple[str, int, str | None]], epochs: int = EPOCHS, seed: int = 11) -> Net:
    """Fit on (text, label, lang) in memory. The mean of a few epochs with the least held loss counts."""
    return trained(sample, epochs, seed)[0]


def trained(sample: list[tuple[str, int, str | None]], epochs: int = EPOCHS, seed: int = 11) -> tuple[Net, dict]:
    """``train``, and the sums of squares after its last epoch, by which training can go on."""
    rng = np.random.default_rng(seed)
    labels = np.array([y for _, y, _ in sample], np.float64)
    net, squares = blank(rng)
    if len(np.unique(labels)) < 2:
        net.output[:] = 0
        net.bias = 0.0 if not len(labels) else (4.0 if labels[0] else -4.0)
        return net, squares
    docs = [tokens([text.encode("utf-8", "replace")])[0] for text, _, _ in sample]
    held = rng.permutation(len(docs)) % HELD == 0
    learn = np.flatnonzero(~held)
    spread = np.zeros(BUCKETS, np.int64)
    for i in learn:
        spread[np.unique(docs[i])] += 1
    fixed = spread < max(LEAST_DOCS, LEAST_SHARE * len(learn))
    fixed[0] = True
    net.vectors[fixed] = 0
    recent: list[Net] = []
    best, idle, check = (np.inf, None), 0, [sample[i] for i in np.flatnonzero(held)]
    weight = len(labels) / (2 * np.bincount(labels.astype(int), minlength=2))
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(learn), max(1, len(learn) // BATCH)):
            ids = np.concatenate([docs[i] for i in batch] + [np.zeros((PAD, 1 + len(STEMS)), np.int32)])
            step(net, squares, fixed, ids, np.cumsum([0] + [len(docs[i]) for i in batch[:-1]]), labels[batch], weight)
        recent = [*recent, copy.deepcopy(net)][-AVERAGE:]
        mean = averaged(recent)
        loss, idle = held_loss(mean, check), idle + 1
        if loss < best[0]:
            best, idle = (loss, mean), 0
        if idle >= PATIENCE:
            break
    net = best[1] or net
    calibrate(net, check)
    return net, squares


def averaged(nets: list[Net]) -> Net:
    """The mean of the parameters of nets from one run of training: steadier than any of them."""
    return Net(
        np.mean([n.vectors for n in nets], axis=0, dtype=np.float32),
        {w: np.mean([n.filters[w] for n in nets], axis=0, dtype=np.float32) for w in WIDTHS},
        {w: np.mean([n.offsets[w] for n in nets], axis=0, dtype=np.float32) for w in WIDTHS},
        np.mean([n.output for n in nets], axis=0),
        float(np.mean([n.bias for n in nets])),
    )


def held_loss(net: Net, rows: list[tuple[str, int, str | None]]) -> float:
    """Mean log loss, both classes weighing the same; epochs are compared by it."""
    logits, labels = net.logits([r[0] for r in rows]), np.array([r[1] for r in rows])
    losses = np.logaddexp(0, np.where(labels == 1, -logits, logits))
    return float(np.mean([losses[labels == y].mean() for y in np.unique(labels)])) if rows else 0.0


def calibrate(net: Net, rows: list[tuple[str, int, str | None]], least: int = 40) -> None:
    """Move the common threshold to logit 0 and set one for each language with ``least`` rows of both classes together."""
    logits, labels = net.logits([r[0] for r in rows]), np.array([r[1] for r in rows])
    common = -cut(-logits, 1 - labels, CLEAN_WEIGHT)
    net.bias -= common
    langs = np.array([r[2] or "" for r in rows])
    for lang in np.unique(langs):
        own = langs == lang
        if own.sum() >= least and len(np.unique(labels[own])) == 2:
            net.thresholds[str(lang)] = -cut(-(logits[own] - common), 1 - labels[own], CLEAN_WEIGHT)


def score(documents: DataFrame, net: Net, *keep: str | Column) -> DataFrame:
    """The columns ``keep`` of every document with ``score`` (0 to 1) and ``flagged`` (over its language's threshold).

    Null and empty texts are scored as padding alone; a null or unknown language uses the common threshold.
    """
    shared = documents.sparkSession.sparkContext.broadcast(net)
    rows = documents.select(*keep, F.col("lang").cast("string").alias("_scored_lang"), F.col("text").alias("_scored_text"))
    schema = rows.drop("_scored_text", "_scored_lang").schema
    kept = schema.fieldNames()

    def run(batches):
        limits = shared.value.thresholds
        for batch in sliced(batches):
            logits = shared.value.logits(batch.column("_scored_text").to_pylist())
            flagged = [bool(x >= limits.get(lang or "", 0.0)) for x, lang in zip(logits, batch.column("_scored_lang").to_pylist(), strict=True)]
            scores = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
            arrays = [*(batch.column(c) for c in kept), pa.array(scores, pa.float64()), pa.array(flagged, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, "score", "flagged"])

    return map_batches(rows, run, schema.add("score", "double").add("flagged", "boolean"))


def spread(rows: DataFrame) -> tuple[np.ndarray, int]:
    """How many of the texts of ``rows`` (text) hold each bucket, and how many texts there are."""

    def run(batches):
        counts, total = np.zeros(BUCKETS, np.int64), 0
        for batch in sliced(batches):
            total += batch.num_rows
            for _, group in pieces(batch.column("text").to_pylist()):
                ids, first = tokens(group)
                doc = np.repeat(np.arange(len(group)), np.diff(np.append(first, len(ids))))
                counts += np.bincount(np.unique(doc[:, None] * BUCKETS + ids) % BUCKETS, minlength=BUCKETS)
        counts[0] = total
        found = np.flatnonzero(counts)
        for a in range(0, len(found), 10_000):
            part = found[a : a + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[part])], names=["bucket", "n"])

    told = map_batches(rows.select("text"), run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[told.column("bucket").to_numpy()] = told.column("n").to_numpy()
    return out, int(out[0])


def flat(net: Net, squares: dict, active: np.ndarray) -> np.ndarray:
    """All parameters and sums of squares in one array; of the vectors, those of the ``active`` buckets."""
    parts = [net.vectors[active], squares["v"][active], net.output, squares["o"], np.array([net.bias, squares["b"]])]
    for w in WIDTHS:
        parts += [net.filters[w], squares["f", w], net.offsets[w], squares["c", w]]
    return np.concatenate([np.asarray(p, np.float64).ravel() for p in parts])


def from_flat(state: np.ndarray, active: np.ndarray) -> tuple[Net, dict]:
    """The net and the sums of squares that ``flat`` made one array of; other vectors are zero."""
    at = 0

    def take(*shape: int) -> np.ndarray:
        nonlocal at
        at += int(np.prod(shape))
        return state[at - int(np.prod(shape)) : at].reshape(shape).copy()

    vectors, squares = np.zeros((BUCKETS, DIM), np.float32), {"v": np.full(BUCKETS, 1e-4)}
    vectors[active] = take(len(active), DIM)
    squares["v"][active] = take(len(active))
    output, squares["o"] = take(FILTERS * len(WIDTHS)).astype(np.float32), take(FILTERS * len(WIDTHS))
    bias, squares["b"] = take(2).tolist()
    filters, offsets = {}, {}
    for w in WIDTHS:
        filters[w], squares["f", w] = take(w, DIM, FILTERS).astype(np.float32), take(w, DIM, FILTERS)
        offsets[w], squares["c", w] = take(FILTERS).astype(np.float32), take(FILTERS)
    return Net(vectors, filters, offsets, output, bias), squares


def one_pass(rows: DataFrame, net: Net, squares: dict, active: np.ndarray, weight: np.ndarray, seed: int) -> tuple[Net, dict]:
    """One pass over all ``rows`` (text, y): each task trains on its rows from the same start, the mean of the tasks' nets counts."""

    def learn(state, examples):
        own, sums = from_flat(state, active)
        fixed = np.ones(BUCKETS, bool)
        fixed[active] = False
        rng = np.random.default_rng(seed)
        for texts, y in examples:
            for group, of in groups(texts, y, BATCH, rng):
                ids, first = tokens(group)
                ids = np.concatenate((ids, np.zeros((PAD, ids.shape[1]), np.int32)))
                step(own, sums, fixed, ids, first, of.astype(np.float64), weight)
        return flat(own, sums, active)

    return from_flat(mean_of_tasks(rows, flat(net, squares, active), learn), active)


def held_logits(rows: DataFrame, nets: list[Net]) -> DataFrame:
    """(lang, y, x0, x1, ...): the logit of every row of ``rows`` (text, lang, y) by each net."""
    shared = rows.sparkSession.sparkContext.broadcast(nets)
    names = [f"x{n}" for n in range(len(nets))]

    def run(batches):
        for batch in sliced(batches):
            texts = batch.column("text").to_pylist()
            arrays = [batch.column("lang"), batch.column("y"), *(pa.array(net.logits(texts), pa.float64()) for net in shared.value)]
            yield pa.RecordBatch.from_arrays(arrays, names=["lang", "y", *names])

    return map_batches(rows.select("text", "lang", "y"), run, "lang string, y int, " + ", ".join(f"{x} double" for x in names))


def calibrate_all(net: Net, logits: DataFrame, least: int = 40) -> None:
    """``calibrate`` on all rows (lang, y, x), however many: the rows are counted by logit in steps of 1 / ``BINS``.

    Every row counts; only the place of a threshold is rounded to a step.
    """
    near = F.floor(F.greatest(F.least("x", F.lit(32.0)), F.lit(-32.0)) * BINS).alias("bin")
    counts = [F.sum(F.when(F.col("y") == y, 1).otherwise(0)).alias(f"n{y}") for y in (0, 1)]
    bins = stored(logits.select(F.coalesce("lang", F.lit("")).alias("lang"), near, "y").groupBy("lang", "bin").agg(*counts), "held-bins")

    def threshold(rows) -> float:
        rows = rows.sort_values("bin", ascending=False)
        return -cut_between(-(rows["bin"].to_numpy() + 0.5) / BINS, rows["n1"].to_numpy(), rows["n0"].to_numpy(), CLEAN_WEIGHT)

    common = threshold(bins.groupBy("bin").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas())
    net.bias -= common
    rich = bins.groupBy("lang").agg(F.sum("n0").alias("a"), F.sum("n1").alias("b")).where(f"a > 0 and b > 0 and a + b >= {least}").select("lang")

    def by_lang(key, rows):
        return pd.DataFrame({"lang": [key[0]], "x": [threshold(rows)]})

    found = bins.join(rich, "lang").groupBy("lang").applyInPandas(by_lang, "lang string, x double").collect()
    net.thresholds = {r["lang"]: r["x"] - common for r in found}


def fit(
    documents: DataFrame, labels: DataFrame, learn: Column, target: str = "toxic", rows: int = ROWS, max_bytes: int = MAX_BYTES, passes: int = PASSES
) -> Net:
    """Train on all labelled rows that ``learn`` (a condition on ``doc_id``) admits.

    Training starts on the driver with a bounded sample (``rows`` per class, ``max_bytes`` of text together). Which buckets
    have vectors follows from all rows; then every row is learned from in each of ``passes``, but for the rows kept
    out, all of which pick the pass and the thresholds.
    """
    net, squares = trained(labelled_sample(documents, labels, target, learn & ~kept_out(target, HELD), rows, max_bytes))
    texts = labelled_texts(documents, labels, target, learn, HELD)
    learned, check = texts.where("not held"), texts.where("held")
    weight = class_weights(learned)
    if weight is None:
        return net
    counts, total = spread(learned)
    active = np.flatnonzero(counts >= max(LEAST_DOCS, LEAST_SHARE * total))
    active = active[active > 0]
    first, _ = blank(np.random.default_rng(12))
    new = active[~net.vectors[active].any(axis=1)]
    net.vectors[new] = first.vectors[new]
    nets = []
    for n in range(passes):
        net, squares = one_pass(learned, net, squares, active, weight, n)
        nets.append(net)
    logits = stored(held_logits(check, nets), "held-logits")
    signs = F.when(F.col("y") == 1, -1.0).otherwise(1.0)
    losses = [F.avg(F.greatest(signs * F.col(x), F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))).alias(x) for x in logits.columns[2:]]
    by_class = logits.groupBy("y").agg(*losses).collect()
    best = min(range(passes), key=lambda n: sum(r[f"x{n}"] for r in by_class))
    net = nets[best]
    calibrate_all(net, logits.select("lang", "y", F.col(f"x{best}").alias("x")))
    return net
