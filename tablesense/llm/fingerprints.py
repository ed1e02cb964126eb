"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash of the last seven bytes ends a chunk wherever it is divisible by the block size; every chunk
adds one character, the hash of its content, to the signature. The block size is the smallest of 3, 6, 12, ...
for which at most 64 characters come out, so whole texts of any length are covered. A fingerprint is
``block:signature:signature at twice the block``. Two fingerprints are alike as far as their signatures at a
common block size are: one minus the edit distance (a change of a character counts as taking it out and putting
one in) over both lengths; unequal signatures without four characters in a row in common are not alike at all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesense.llm.common import map_batches, prefix_hash, span_hashes

LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
WINDOW = 7
SMALLEST = 3
LONGEST = 64
COMMON = 4
PARTITION_ROWS = 20_000
FIRST_ID = -(1 << 63)


def _rolling(data: np.ndarray) -> np.ndarray:
    """A mixed 32-bit hash of the seven bytes that end at each place; before the start come zeros."""
    padded = np.concatenate((np.zeros(WINDOW - 1, np.uint32), data.astype(np.uint32)))
    h = np.zeros(len(data), np.uint32)
    for k in range(WINDOW):
        h *= np.uint32(0x01000193)
        h += padded[k : k + len(data)]
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x7FEB352D)
    h ^= h >> np.uint32(15)
    return h


def _signature(prefix: np.ndarray, ends: np.ndarray, size: int) -> str:
    """One character per chunk; what follows the last trigger is a chunk too."""
    ends = ends if len(ends) and ends[-1] == size else np.append(ends, size)
    starts = np.append(0, ends[:-1])
    return LETTERS[(span_hashes(prefix, starts, ends) & np.uint64(63)).astype(np.int64)].tobytes().decode()


def fingerprint(text: str | None) -> str:
    """The fingerprint of a whole text; null counts as empty, whose signatures are empty."""
    raw = (text or "").encode("utf-8", "replace")
    if not raw:
        return f"{SMALLEST}::"
    data = np.frombuffer(raw, np.uint8)
    h, prefix = _rolling(data), prefix_hash(data)
    block, at = SMALLEST, np.flatnonzero(h % np.uint32(SMALLEST) == 0)
    # triggers at twice a block size are among those at the block size
    while len(at) >= LONGEST:
        block *= 2
        at = at[h[at] % np.uint32(block) == 0]
    twice = at[h[at] % np.uint32(2 * block) == 0]
    return f"{block}:{_signature(prefix, at + 1, len(data))}:{_signature(prefix, twice + 1, len(data))}"


def _alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    grams = {a[i : i + COMMON] for i in range(len(a) - COMMON + 1)}
    if not any(b[i : i + COMMON] in grams for i in range(len(b) - COMMON + 1)):
        return 0.0
    # longest common subsequence, a bit per character of a
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    common = len(a) - row.bit_count()
    return 2 * common / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """0 to 1. Equal fingerprints are 1; block sizes more than a factor of two apart do not compare: 0."""
    if a == b:
        return 1.0
    size_a, one_a, two_a = a.split(":")
    size_b, one_b, two_b = b.split(":")
    size_a, size_b = int(size_a), int(size_b)
    pairs = []
    if size_a == size_b:
        pairs = [(one_a, one_b), (two_a, two_b)]
    elif size_a == 2 * size_b:
        pairs = [(one_a, two_b)]
    elif size_b == 2 * size_a:
        pairs = [(two_a, one_b)]
    return max((_alike(x, y) for x, y in pairs if x and y), default=0.0)


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of each row of (doc_id, text, anything else)."""

    def run(batches):
        for batch in batches:
            out = pa.array([fingerprint(t) for t in batch.column("text").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), out], names=["doc_id", "fingerprint"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return map_batches(documents.select("doc_id", "text"), run, f"doc_id {kind}, fingerprint string")


@dataclass
class _Row:
    doc_id: int
    text: str
    mark: str


def edited(text: str, following: str) -> str:
    """The last half of the code points, rounded down, replaced by as many (or all) of the first of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(documents: DataFrame) -> DataFrame:
    """Each document beside its edited text and the next document in ascending order of (doc_id, text).

    The last one is followed by the first, also if there is one only. A null text is empty, a null doc_id comes
    first. Documents are dealt out by ranges of doc_id found from the ids alone; the rows a range begins with are
    sent to the range before it as well, so texts are shuffled once and no task sees more than its range.
    """
    rows = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_ID)).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.count()
    ranges = max(1, -(-total // PARTITION_ROWS), int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = [i / ranges for i in range(1, ranges)]
    found = rows.agg(F.min("key").alias("first"), F.percentile_approx("key", cuts, 100 * ranges).alias("cuts") if cuts else F.array().alias("cuts")).head()
    if found["first"] is None:
        bounds = [FIRST_ID]
    else:
        bounds = [found["first"], *sorted({int(c) for c in found["cuts"] if c > found["first"]})]
    # a bound taken from the keys is the key its range begins with
    spark = documents.sparkSession
    limits = spark.sparkContext.broadcast(np.array(bounds, np.int64))
    n = len(bounds)

    def deal(batches):
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            at = np.maximum(np.searchsorted(limits.value, keys, side="right") - 1, 0)
            starts = np.flatnonzero(limits.value[at] == keys)
            take = pa.array(np.concatenate((np.arange(len(keys)), starts)))
            part = np.concatenate((at, (at[starts] - 1) % n)).astype(np.int32)
            tail = np.concatenate((np.zeros(len(keys), bool), np.ones(len(starts), bool)))
            sent = pa.RecordBatch.from_arrays([batch.column("key"), batch.column("text")], names=["key", "text"]).take(take)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(tail), *sent.columns], names=["part", "tail", "key", "text"])

    dealt = map_batches(rows, deal, "part int, tail boolean, key long, text string")
    dealt = dealt.repartitionByRange(n, "part").sortWithinPartitions("part", "tail", "key", "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def compare(row: _Row, after: _Row) -> tuple:
        text = edited(row.text, after.text)
        mark = fingerprint(text)
        digest = hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()
        return (
            None if row.doc_id == FIRST_ID else row.doc_id, len(row.text), digest, row.mark, mark, likeness(row.mark, mark), likeness(row.mark, after.mark),
        )

    def run(batches: Iterator[pa.RecordBatch]):
        held, part, done = None, None, False
        for batch in batches:
            out = []
            for p, tail, key, text in zip(*(batch.column(c).to_pylist() for c in ("part", "tail", "key", "text")), strict=True):
                if p != part:
                    held, part, done = None, p, False
                if done:
                    continue
                row = _Row(key, text, fingerprint(text))
                if held is not None:
                    out.append(compare(held, row))
                held, done = row, tail
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], schema=arrow)

    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    arrow = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])
    return map_batches(dealt, run, schema)
