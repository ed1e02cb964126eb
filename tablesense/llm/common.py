"""Helpers shared by the training-data operators: tables, stored intermediate results, byte-level tokens."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesense.session import shared_dir

PIECE_BYTES = 1 << 18
"""Texts are worked on in groups of about so many bytes, so that arrays stay small; one text is never cut."""

_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_R_INV = np.uint64(pow(int(_R), -1, 1 << 64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` once below the shared folder and read it back: short lineage that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(modulus: int, id_column: str = "doc_id") -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % modulus


def labelled_sample(
    documents: DataFrame, labels: DataFrame, target: str, learn: Column, rows: int, max_bytes: int
) -> list[tuple[str, int, str | None]]:
    """A bounded sample of labelled texts: (text, label, lang), at most ``rows`` per class and ``max_bytes`` together.

    Rows come in the order of a hash of their id, so the sample is the same on each run. ``learn`` is a
    condition on ``doc_id`` that keeps the rows one may learn from. Labels other than 0 and 1 do not count.
    """
    marked = labels.select(F.col("doc_id"), F.col(target).cast("int").alias("y")).where(learn & F.col("doc_id").isNotNull())
    order = [F.xxhash64(F.col("doc_id"), F.lit(target)), F.col("doc_id")]
    chosen = None
    for y in (0, 1):
        part = marked.where(F.col("y") == y).distinct().orderBy(*order).limit(rows)
        chosen = part if chosen is None else chosen.unionAll(part)
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang")
    sizes = texts.select("doc_id", F.octet_length("text").alias("size")).join(F.broadcast(chosen), "doc_id")
    sizes = sizes.groupBy("doc_id", "y").agg(F.min("size").alias("size")).orderBy(*order).collect()
    ids, total = [], 0
    for r in sizes:
        if total + r["size"] <= max_bytes:
            ids.append((r["doc_id"], r["y"]))
            total += r["size"]
    if not ids:
        return []
    wanted = documents.sparkSession.createDataFrame(ids, "doc_id long, y int")
    found = texts.join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "y").agg(
        F.min_by(F.struct("text", "lang"), F.xxhash64("text")).alias("row")
    )
    found = sorted(found.collect(), key=lambda r: (r["doc_id"], r["y"]))
    return [(r["row"]["text"], r["y"], r["row"]["lang"]) for r in found]


def kept_out(target: str, held: int) -> Column:
    """Whether a ``doc_id`` is among the one in ``held``, by a hash, that is kept out of training."""
    return F.pmod(F.xxhash64("doc_id", F.lit(target)), F.lit(held)) == 0


def labelled_texts(documents: DataFrame, labels: DataFrame, target: str, learn: Column, held: int) -> DataFrame:
    """(text, lang, y, held) of every document with a label 0 or 1 that ``learn`` (a condition on ``doc_id``) admits, stored.

    ``held`` marks the rows that ``kept_out`` keeps out of training. A document with both labels comes twice.
    """
    marked = labels.select("doc_id", F.col(target).cast("int").alias("y")).where(learn & F.col("doc_id").isNotNull()).where("y in (0, 1)")
    texts = documents.where(learn).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"))
    # the shuffle by id deals the rows over the tasks, whatever the order of the files
    rows = texts.join(marked.distinct().hint("merge"), "doc_id")
    return stored(rows.select("text", "lang", "y", kept_out(target, held).alias("held")), "labelled-texts")


def class_weights(rows: DataFrame) -> np.ndarray | None:
    """Weights of the rows of label 0 and 1 that make both classes equal in sum; None where a class is missing."""
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    return np.array([sum(counts.values()) / (2 * counts[y]) for y in (0, 1)]) if len(counts) == 2 else None


PART = 16


def mean_of_tasks(rows: DataFrame, state: np.ndarray, learn) -> np.ndarray:
    """The mean, weighted by rows, of what each task over ``rows`` (text, y) makes of the flat parameters ``state``.

    ``learn(state, examples)`` gives new parameters from an iterator of (texts, labels). Spark adds the tasks' results
    up in parts of ``PART`` numbers, so the driver gets one state, however many tasks there are.
    """
    shared = rows.sparkSession.sparkContext.broadcast(state)
    size = -(-len(state) // PART)

    def run(batches):
        count = 0

        def examples():
            nonlocal count
            for batch in sliced(batches):
                count += batch.num_rows
                yield batch.column("text").to_pylist(), batch.column("y").to_numpy()

        found = learn(shared.value, examples())
        for a in range(0, size if count else 0, 4096):
            flat = found[a * PART : (a + 4096) * PART] * float(count)
            flat = np.concatenate((flat, np.zeros(-len(flat) % PART))).reshape(-1, PART)
            part = np.arange(a, a + len(flat))
            columns = [pa.array(part), pa.array(np.full(len(flat), count)), *(pa.array(flat[:, k]) for k in range(PART))]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "n", *(f"x{k}" for k in range(PART))])

    names = [f"x{k}" for k in range(PART)]
    told = map_batches(rows.select("text", "y"), run, "part long, n long, " + ", ".join(f"{x} double" for x in names))
    found = told.groupBy("part").agg(*[(F.sum(x) / F.sum("n")).alias(x) for x in names]).toArrow().sort_by("part")
    shared.unpersist()
    return np.column_stack([found.column(x).to_numpy() for x in names]).ravel()[: len(state)] if found.num_rows else state


def groups(texts: list[str], labels: np.ndarray, rows: int, rng: np.random.Generator) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """The texts in random order in groups of at most ``rows``, of fewer where texts are long."""
    order = rng.permutation(len(texts))
    for start, group in pieces([texts[i] for i in order]):
        for a in range(0, len(group), rows):
            yield group[a : a + rows], labels[order[start + a : start + min(a + rows, len(group))]]


def pieces(texts: list[str | None], most: int = PIECE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, UTF-8 texts): groups of whole texts of about ``most`` bytes; null counts as empty."""
    start, group, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "replace")
        if group and size + len(raw) > most:
            yield start, group
            start, group, size = i, [], 0
        group.append(raw)
        size += len(raw) + 1
    if group:
        yield start, group


BATCH_ROWS = 1000


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` with batches of at most ``BATCH_ROWS`` rows, for rows may hold long texts.

    The session's limit is lowered where it is higher; Spark reads it when the plan runs.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def sliced(batches, rows: int = 1000):
    """Record batches of at most ``rows`` rows; memory that Arrow holds back is returned at the end."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)
    pa.default_memory_pool().release_unused()


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash: every bit depends on every other."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        size = max(n, PIECE_BYTES + 4096)
        found = np.full(size, base, np.uint64)
        found[0] = 1
        powers = np.cumprod(found, dtype=np.uint64)
        if size > 8 * PIECE_BYTES:  # not kept: one very long text
            return powers[:n]
        _powers[key] = powers
    return _powers[key][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[i] = sum of (data[j] + 1) * R^j over j < i, modulo 2^64; one longer than ``data``."""
    out = np.zeros(len(data) + 1, np.uint64)
    if len(data):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_R, len(data)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], equal for equal content wherever it stands."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    return mix((prefix[ends] - prefix[starts]) * _power(_R_INV, int(starts.max()) + 1)[starts] + (ends - starts).astype(np.uint64))


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def joined(group: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One byte array, each text followed by a space, and where each text starts."""
    data = np.frombuffer(b" ".join(group) + b" ", np.uint8)
    starts = np.zeros(len(group), np.int64)
    np.cumsum([len(g) + 1 for g in group[:-1]], out=starts[1:])
    return data, starts


SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

LETTER = np.zeros(256, bool)
LETTER[0x30:0x3A] = LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = LETTER[0x80:] = True
