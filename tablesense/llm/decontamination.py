"""Benchmark decontamination: passages of documents within a small edit distance of a benchmark item.

Texts are sequences of words (runs of letters and digits, A-Z lowered). An item of n words is found where some
passage has an edit distance of at most ``rate * n`` words to it.

1. Windows of an item's size are placed where one of its d + 1 rarest words stands, d being the edits allowed:
   of d + 1 places at least one survives d edits. Rarity is counted over all documents.
2. Each window goes through the CGK random walk: at every step the current word is put out, and a random bit of
   (step, word) decides whether to move on. Edit distance becomes Hamming distance of the walks.
3. Bit sampling, repeated: a window is likely if in one repetition all sampled steps show the item's words. The
   walks drift apart with many edits and with a shifted start, the more the longer the item, so a window that they
   don't show is not dropped for that.
4. Such a window is dropped only if it can't hold the item: within d edits, at least n - d of the places from d words
   before it to d words after it have words of the item. So no passage within the distance is lost.
5. The words around a remaining window are compared with the item exactly (bit-parallel approximate matching).

Benchmark items are broadcast in groups of bounded size, one scan of the documents per group; documents are not shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesense.llm.common import LETTER, LOWER, joined, map_batches, mix, pieces, prefix_hash, runs, span_hashes

RATE = 0.15
RECALL = 0.99
HAMMING = 0.5
"""Assumed share of walk steps that differ, for the number of repetitions. It decides about time only: see step 4."""
SAMPLED = 2
WALKS = 4
STRETCH = 1.5
"""Steps of a walk per word of an item; a walk moves on at every second step on average."""
GROUP_BYTES = 8_000_000
CHUNK = 4096
BOUND_CHUNK = 512
END = np.uint64(0x5851F42D4C957F2D)


def words_of(group: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the texts one after the other, and where each text's words start (one more at the end)."""
    data, starts = joined(group)
    data = LOWER[data]
    word_start, word_end = runs(LETTER[data])
    h = span_hashes(prefix_hash(data), word_start, word_end)
    return h, np.append(np.searchsorted(word_start, starts), len(h))


def repetitions(recall: float = RECALL, hamming: float = HAMMING, sampled: int = SAMPLED) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - (1 - hamming) ** sampled))


def walk(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, steps: int, seed: int) -> np.ndarray:
    """The CGK embeddings of words[start:end], a column each; after its end a walk puts out a mark."""
    out = np.empty((steps, len(starts)), np.uint64)
    padded, at, last = np.append(words, END), starts.copy(), len(words)
    bits = mix(np.arange(steps, dtype=np.uint64) + np.uint64(seed * 1_000_003 + 1))
    for step in range(steps):
        symbol = np.where(at < ends, padded[np.minimum(at, last)], END)
        out[step] = symbol
        at = at + (mix(symbol ^ bits[step]) & np.uint64(1)).astype(np.int64)
    return out


def distance_within(item: list[int], text: list[int]) -> int:
    """The smallest edit distance between ``item`` and any stretch of ``text`` (Myers' bit vectors)."""
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    where: dict[int, int] = {}
    for i, w in enumerate(item):
        where[w] = where.get(w, 0) | 1 << i
    up, down, score = full, 0, m
    best = m
    for w in text:
        eq = where.get(w, 0)
        x = eq | down
        d0 = ((((eq & up) + up) & full) ^ up) | x
        hp = (down | ~(d0 | up)) & full
        hn = up & d0
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp, hn = (hp << 1) & full, (hn << 1) & full
        up = (hn | ~(d0 | hp)) & full
        down = hp & d0
        best = min(best, score)
    return best


def _of_item(item: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mix(words ^ mix(item.astype(np.uint64) + np.uint64(1)))


@dataclass
class Items:
    """A group of benchmark items and where their rarest words lead."""

    ids: list[int | None]
    words: list[np.ndarray]
    edits: np.ndarray
    anchors: np.ndarray
    """Sorted word hashes; entry i stands for the (item, place) pairs first[i] to first[i + 1]."""
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    sampled: list[np.ndarray]
    """For each walk: steps to look at, (items, repetitions, SAMPLED)."""
    seen: list[np.ndarray]
    """What the items show there."""
    own: np.ndarray
    """Sorted hashes of (item, word) of the words of each item."""

    @staticmethod
    def build(ids: list, texts: list[str], counts: dict[int, int], rate: float, recall: float) -> Items:
        words = [words_of([t.encode("utf-8", "replace")])[0] for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        edits = np.floor(sizes * rate).astype(np.int64)
        found = []
        for i, w in enumerate(words):
            rarest = sorted(range(len(w)), key=lambda p: (counts.get(int(w[p]), 0), p))[: edits[i] + 1]
            found.extend((int(w[p]), i, p) for p in rarest)
        found.sort()
        h = np.array([f[0] for f in found], np.uint64)
        anchors, first = np.unique(h, return_index=True)
        each = math.ceil(repetitions(recall) / WALKS)
        rng = np.random.default_rng(5)
        sampled, seen = [], []
        for seed in range(WALKS):
            u = rng.random((each, SAMPLED))
            steps = np.floor(u[None] * np.maximum(sizes * STRETCH, 1)[:, None, None]).astype(np.int64)
            looks = np.zeros_like(steps, np.uint64)
            for i, w in enumerate(words):
                if len(w):
                    column = walk(w, np.zeros(1, np.int64), np.array([len(w)]), int(steps[i].max()) + 1, seed)[:, 0]
                    looks[i] = column[steps[i]]
            sampled.append(steps)
            seen.append(looks)
        own = np.unique(np.concatenate([np.zeros(0, np.uint64), *(_of_item(np.full(len(w), i), w) for i, w in enumerate(words))]))
        return Items(
            ids, words, edits, anchors, np.append(first, len(h)), np.array([f[1] for f in found], np.int64),
            np.array([f[2] for f in found], np.int64), sampled, seen, own,
        )

    def may_hold(self, h: np.ndarray, low: np.ndarray, high: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Whether enough of the places low to high of ``h`` have words of the item to hold it within its edits."""
        out = np.zeros(len(item), bool)
        for a in range(0, len(item), BOUND_CHUNK):
            part = slice(a, a + BOUND_CHUNK)
            n = high[part] - low[part]
            ends = np.cumsum(n)
            place = np.arange(n.sum()) + np.repeat(low[part] - (ends - n), n)
            asked = _of_item(np.repeat(item[part], n), h[place])
            at = np.minimum(np.searchsorted(self.own, asked), len(self.own) - 1)
            met = np.append(0, np.cumsum(self.own[at] == asked))
            sizes = np.array([len(self.words[i]) for i in item[part]], np.int64)
            out[part] = met[ends] - met[ends - n] >= sizes - self.edits[item[part]]
        return out

    def search(self, texts: list[str | None]):
        """(text index, item index, distance, first word of the window) of every item found in every text."""
        if not len(self.anchors):
            return
        sizes = np.array([len(w) for w in self.words], np.int64)
        for start, group in pieces(texts):
            h, first = words_of(group)
            at = np.minimum(np.searchsorted(self.anchors, h), len(self.anchors) - 1)
            hit = np.flatnonzero(self.anchors[at] == h)
            which = at[hit]
            n = self.first[which + 1] - self.first[which]
            pair = np.repeat(self.first[which] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
            item, begin = self.item[pair], np.repeat(hit, n) - self.place[pair]
            doc = np.repeat(np.searchsorted(first, hit, side="right") - 1, n)
            windows = np.unique(np.stack((doc, item, begin)), axis=1) if len(item) else np.zeros((3, 0), np.int64)
            best: dict[tuple[int, int], tuple[int, int]] = {}
            for a in range(0, windows.shape[1], CHUNK):
                doc, item, begin = windows[:, a : a + CHUNK]
                low, high = np.maximum(begin, first[doc]), np.minimum(begin + sizes[item], first[doc + 1])
                likely = np.zeros(len(doc), bool)
                for seed in range(WALKS):
                    steps = self.sampled[seed][item]
                    shown = walk(h, low, high, int(steps.max()) + 1, seed)
                    same = shown[steps, np.arange(len(doc))[:, None, None]] == self.seen[seed][item]
                    likely |= same.all(axis=2).any(axis=1)
                rest = np.flatnonzero(~likely)
                more = self.edits[item[rest]]
                from_, to = np.maximum(begin[rest] - more, first[doc[rest]]), np.minimum(begin[rest] + sizes[item[rest]] + more, first[doc[rest] + 1])
                likely[rest] = self.may_hold(h, from_, to, item[rest])
                for k in np.flatnonzero(likely):
                    d, i = int(doc[k]), int(item[k])
                    more = int(self.edits[i])
                    around = h[max(first[d], begin[k] - more) : min(first[d + 1], begin[k] + sizes[i] + more)]
                    found = distance_within(self.words[i].tolist(), around.tolist())
                    if found <= more and (d, i) not in best or found < best.get((d, i), (0, 0))[0]:
                        best[d, i] = (found, int(low[k] - first[d]))
            for (d, i), (found, place) in sorted(best.items()):
                yield start + d, i, found, place


def word_counts(documents: DataFrame, vocabulary: np.ndarray) -> dict[int, int]:
    """How often each word hash of the sorted ``vocabulary`` occurs in all texts; its size bounds the result."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        counts = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for _, group in pieces(batch.column("text").to_pylist()):
                h, _ = words_of(group)
                at = np.minimum(np.searchsorted(shared.value, h), len(shared.value) - 1)
                counts += np.bincount(at[shared.value[at] == h], minlength=len(counts))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used], pa.int64())], names=["word", "n"])

    if not len(vocabulary):
        return {}
    found = map_batches(documents.select("text"), run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {int(vocabulary[r["word"]]): r["n"] for r in found}


HITS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("item_id", "distance", "item_words", "first_word")]))


def search(documents: DataFrame, benchmark: DataFrame, rate: float = RATE, recall: float = RECALL) -> DataFrame:
    """All columns of ``documents`` (text, anything else) and ``_benchmark_hits``: an array of (item_id, distance, item_words, first_word).

    ``distance`` is the smallest edit distance in words that was found for the item, at most ``rate`` of its words.
    Items without words and null or empty texts match nothing; repeated items are reported each. An empty
    benchmark leaves them all empty.
    """
    spark = documents.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    order = Window.orderBy("item_id", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    group = F.floor(F.sum(F.octet_length("text")).over(order) / GROUP_BYTES)
    items = items.withColumn("part", group)
    parts = [r[0] for r in items.select("part").distinct().orderBy("part").collect()]
    schema = T.StructType([*documents.schema.fields, T.StructField("_benchmark_hits", HITS)])
    found, columns = documents, documents.columns
    for part in parts:
        rows = items.where(F.col("part") == part).orderBy("item_id", "text").collect()
        vocabulary = np.unique(np.concatenate([words_of([r["text"].encode("utf-8", "replace")])[0] for r in rows]))
        own = Items.build([r["item_id"] for r in rows], [r["text"] for r in rows], word_counts(documents, vocabulary), rate, recall)
        found = _one_group(found, spark.sparkContext.broadcast(own), columns, schema)
    return found if parts else documents.withColumn("_benchmark_hits", F.array().cast(HITS))


def _one_group(found: DataFrame, shared, columns: list[str], schema: T.StructType) -> DataFrame:
    earlier = len(found.columns) > len(columns)
    place = columns.index("text")

    def run(batches):
        own = shared.value
        for batch in batches:
            hits = batch.column(len(columns)).to_pylist() if earlier else [[] for _ in range(batch.num_rows)]
            for doc, i, distance, first in own.search(batch.column(place).to_pylist()):
                hits[doc].append({"item_id": own.ids[i], "distance": distance, "item_words": len(own.words[i]), "first_word": first})
            kind = pa.list_(pa.struct([(c, pa.int64()) for c in HITS.elementType.names]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(hits, kind)], names=[*columns, "_benchmark_hits"])

    return map_batches(found, run, schema)


def contaminated(documents: DataFrame, benchmark: DataFrame, rate: float = RATE, recall: float = RECALL) -> DataFrame:
    """(doc_id, item_id, distance, item_words, first_word): one row for each item found in each document."""
    rows = search(documents.select("doc_id", "text"), benchmark, rate, recall)
    return rows.select("doc_id", F.inline("_benchmark_hits"))


def without_benchmark(documents: DataFrame, benchmark: DataFrame, rate: float = RATE, recall: float = RECALL) -> DataFrame:
    """The rows of ``documents`` in which no item is found, columns as they are."""
    return search(documents, benchmark, rate, recall).where(F.size("_benchmark_hits") == 0).drop("_benchmark_hits")
