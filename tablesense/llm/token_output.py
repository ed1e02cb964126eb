"""Token ids in compact files: a static range asymmetric numeral system over interleaved lanes.

Texts are encoded once and their ids stored; counting them gives one frequency table for all files, so blocks
are independent of each other. Documents are dealt out by ranges of doc_id and each task writes blocks of
whole documents. In a block, token t belongs to lane ``t % LANES``; all lanes take a step together in numpy.
A block carries the lanes' states at every ``CHECKPOINT`` steps with the place in its words, so that parts of
it can be decoded alone, and checksums of its words and of its ids.

Files are Parquet: one row per block, compressed payload in a binary column. Blocks in order of (part, block)
hold the documents in ascending doc_id order.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablesense.llm.common import map_batches, stored
from tablesense.session import shared_dir

LANES = 2048
CHECKPOINT = 128
BLOCK_TOKENS = 1 << 19
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
NO_ID = (1 << 63) - 1
CACHED_WORDS = 1_500_000
JOINED = 2000

_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", "!-&(-/:-@\\[-`{-~"
WORDS = re.compile(rf" ?[{_LETTERS}]+(?=[\s{_MARKS}0-9]|\Z)| ?[{_MARKS}]+(?=[\s{_LETTERS}0-9]|\Z)| ?\S+|\s+(?!\S)|\s+")
"""Coarser than the byte-level pattern of the vocabulary: it cuts only where this one cuts. Plain letters and plain
marks but apostrophes are apart, so that a word is the same before any mark; all else stays whole up to white space."""
ODD_SPACE = re.compile("[\x1c-\x1f]")


class Encoder:
    """Token ids of texts as little-endian bytes of ``dtype``.

    A byte-level vocabulary encodes each word alone, so words are looked up in a bounded cache (one per Python
    worker, emptied when full) and only new ones go to the library. Other vocabularies, texts that spell a special token and texts with control
    characters that are white space in Python only are encoded whole.
    """

    def __init__(self, path: str, end_id: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.size = max(self.library.get_vocab_size(with_added_tokens=True), end_id + 1)
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.end = np.array([end_id], self.dtype).tobytes()
        about = json.loads(self.library.to_str())
        before = about.get("pre_tokenizer") or {}
        self.by_word = (
            before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
            and about.get("normalizer") is None and about["model"]["type"] == "BPE"
        )
        line_feed = self.library.encode("\n", add_special_tokens=False).ids
        self.line_feed = line_feed[0] if len(line_feed) == 1 else None
        self.by_word = self.by_word and self.line_feed is not None
        self.special = [t["content"] for t in about.get("added_tokens", [])]
        self.words: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Look up new words. Words proper go to the library by the thousand, one on a line; a line feed is an id of its own there."""
        plain = [w for w in words if not w.isspace()]
        other = [w for w in words if w.isspace()]
        self.words.update(zip(other, self._ids(other), strict=True))
        width = self.dtype.itemsize
        parts = [plain[a : a + JOINED] for a in range(0, len(plain), JOINED)]
        for part, raw in zip(parts, self._ids(["\n".join(p) for p in parts]), strict=True):
            ends = np.flatnonzero(np.frombuffer(raw, self.dtype) == self.line_feed).tolist()
            if len(ends) != len(part) - 1:
                raise ValueError("the vocabulary does not keep line feeds apart")
            begin = 0
            for w, end in zip(part, [*ends, len(raw) // width], strict=True):
                self.words[w] = raw[begin * width : end * width]
                begin = end + 1

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text and the end id; null counts as empty."""
        split: list[list[str] | None] = []
        for text in texts:
            whole = not self.by_word or ODD_SPACE.search(text or "") or any(s in (text or "") for s in self.special)
            split.append(None if whole else WORDS.findall(text or ""))
        known = self.words
        distinct = set().union(*(words for words in split if words))
        own = dict(zip(distinct, map(known.get, distinct), strict=True))
        new = [w for w, ids in own.items() if ids is None]
        if len(known) + len(new) > CACHED_WORDS:
            known.clear()
            new = list(distinct)
        self._learn(new)
        own.update((w, known[w]) for w in new)
        rest = iter(self._ids([t or "" for t, words in zip(texts, split, strict=True) if words is None]))
        return [(next(rest) if words is None else b"".join(map(own.__getitem__, words))) + self.end for words in split]


@lru_cache(maxsize=2)
def encoder(path: str, end_id: int) -> Encoder:
    """One per Python worker. ``path`` is a file or the name of an installed public vocabulary."""
    return Encoder(path if os.path.exists(path) else public_tokenizers.path(path), end_id)


class Table:
    """Frequencies scaled to a power of two; ids that do not occur have none."""

    def __init__(self, counts: np.ndarray):
        used = np.flatnonzero(counts)
        self.bits = max(20, int(np.ceil(np.log2(max(len(used), 1)))) + 2)
        total, room = max(int(counts.sum()), 1), 1 << self.bits
        scaled = np.maximum(1, (counts[used].astype(np.float64) * (room / total)).astype(np.int64))
        order = np.argsort(-scaled, kind="stable")
        spare = room - int(scaled.sum())
        if len(used) and spare > 0:
            scaled[order[0]] += spare
        for i in order:
            if spare >= 0:
                break
            take = min(-spare, int(scaled[i]) - 1)
            scaled[i] -= take
            spare += take
        self.frequency = np.zeros(len(counts), np.uint64)
        self.frequency[used] = scaled
        self.start = np.concatenate(([0], np.cumsum(self.frequency)[:-1])).astype(np.uint64)

    def symbols(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.frequency), dtype=np.uint32), self.frequency.astype(np.int64))


def encode_block(ids: np.ndarray, table: Table, lanes: int = LANES, every: int = CHECKPOINT) -> tuple[bytes, bytes, list[int]]:
    """(words, states at the checkpoints, places of the checkpoints in words) of one block's ids."""
    bits = np.uint64(table.bits)
    limit = ((LOW >> bits) << WORD) * table.frequency
    steps = -(-len(ids) // lanes)
    state = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = [np.zeros(0, np.uint32)] * steps
    states: list[bytes] = []
    for t in range(steps - 1, -1, -1):
        s = ids[t * lanes : (t + 1) * lanes]
        x, f = state[: len(s)], table.frequency[s]
        over = x >= limit[s]
        words[t] = x[over].astype(np.uint32)
        x = np.where(over, x >> WORD, x)
        q = x // f
        state[: len(s)] = (q << bits) + (x - q * f) + table.start[s]
        if t % every == 0:
            states.append(state.tobytes())
    places = np.concatenate(([0], np.cumsum([len(w) for w in words]))) if steps else np.zeros(1, int)
    return (
        np.concatenate([*words, np.zeros(0, np.uint32)]).tobytes(), b"".join(reversed(states)),
        [int(places[t]) for t in range(0, steps, every)],
    )


def decode_block(
    n: int, words: bytes, states: bytes, places: list[int], table: Table, symbols: np.ndarray,
    lanes: int = LANES, every: int = CHECKPOINT, parts: range | None = None,
) -> np.ndarray:
    """The ids of a block, or of some of the parts between its checkpoints; parts do not depend on each other."""
    bits, mask = np.uint64(table.bits), np.uint64((1 << table.bits) - 1)
    stream, saved = np.frombuffer(words, np.uint32), np.frombuffer(states, np.uint64).reshape(-1, lanes)
    out = []
    for part in range(len(places)) if parts is None else parts:
        state, at = saved[part].copy(), places[part]
        for t in range(part * every, min((part + 1) * every, -(-n // lanes))):
            x = state[: min(lanes, n - t * lanes)]
            slot = x & mask
            s = symbols[slot]
            x = table.frequency[s] * (x >> bits) + slot - table.start[s]
            low = np.flatnonzero(x < LOW)
            x[low] = (x[low] << WORD) | stream[at : at + len(low)]
            at += len(low)
            state[: len(x)] = x
            out.append(s)
    return np.concatenate([*out, np.zeros(0, np.uint32)])


BLOCK_SCHEMA = (
    "part int, block int, local_start long, n_tokens long, doc_ids array<long>, lengths array<long>, "
    "words binary, states binary, places array<long>, words_crc32 long, ids_crc32 long"
)


def encoded(documents: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """(doc_id, ids) of each row of (doc_id, text); a null doc_id counts as the largest id."""
    rows = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")

    def run(batches):
        own = encoder(vocabulary, end_id)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                ids = pa.array(own.encode(part.column("text").to_pylist()), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], names=["doc_id", "ids"])

    return map_batches(rows, run, "doc_id long, ids binary")


def frequencies(ids: DataFrame, vocabulary: str, end_id: int) -> np.ndarray:
    """How often each id of the vocabulary occurs; one row per id and task is shuffled, the vocabulary bounds the result."""
    own = encoder(vocabulary, end_id)
    size, dtype = own.size, own.dtype

    def run(batches):
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for raw in batch.column("ids"):
                counts += np.bincount(np.frombuffer(raw.as_buffer(), dtype), minlength=size)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used], pa.int64())], names=["id", "n"])

    found = map_batches(ids.select("ids"), run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(size, np.int64)
    for r in found:
        counts[r["id"]] = r["n"]
    return counts


def blocks(ids: DataFrame, table: Table, dtype: np.dtype, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The block rows of (doc_id, ids), in parts of ascending doc_id; a document is never split."""
    shared = ids.sparkSession.sparkContext.broadcast(table)

    def pack(part: int, number: int, start: int, docs: list[int], lengths: list[int], raw: list[bytes]) -> dict:
        tokens = np.frombuffer(b"".join(raw), dtype)
        words, states, places = encode_block(tokens, shared.value)
        return {
            "part": part, "block": number, "local_start": start, "n_tokens": len(tokens), "doc_ids": docs, "lengths": lengths, "words": words,
            "states": states, "places": places, "words_crc32": zlib.crc32(words), "ids_crc32": zlib.crc32(tokens.astype("<u4").tobytes()),
        }

    def run(batches: Iterator[pa.RecordBatch]):
        part, number, start, size = TaskContext.get().partitionId(), 0, 0, 0
        docs, lengths, raw = [], [], []
        for batch in batches:
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                data = data.as_py()
                docs.append(doc_id)
                lengths.append(len(data) // dtype.itemsize)
                raw.append(data)
                size += lengths[-1]
                if size >= block_tokens:
                    yield pa.RecordBatch.from_pylist([pack(part, number, start, docs, lengths, raw)], schema=arrow)
                    number, start, size = number + 1, start + size, 0
                    docs, lengths, raw = [], [], []
        if docs:
            yield pa.RecordBatch.from_pylist([pack(part, number, start, docs, lengths, raw)], schema=arrow)

    whole, many = pa.int64(), pa.list_(pa.int64())
    kinds = {"part": pa.int32(), "block": pa.int32(), "doc_ids": many, "lengths": many, "words": pa.binary(), "states": pa.binary(), "places": many}
    names = [c.split()[0] for c in BLOCK_SCHEMA.split(", ")]
    arrow = pa.schema([(c, kinds.get(c, whole)) for c in names])
    ordered = ids.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    return map_batches(ordered, run, BLOCK_SCHEMA)


def write_tokens(documents: DataFrame, path: str, vocabulary: str, end_id: int = 0) -> None:
    """Encode every text, append ``end_id`` to each, and write the files: ``path``/table and ``path``/blocks."""
    ids = stored(encoded(documents, vocabulary, end_id), "token-ids")
    counts = frequencies(ids, vocabulary, end_id)
    own = documents.sparkSession.createDataFrame([(counts.astype("<i8").tobytes(),)], "counts binary")
    own.coalesce(1).write.parquet(f"{path}/table")
    out = blocks(ids, Table(counts), encoder(vocabulary, end_id).dtype)
    out.write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the files, decoded block by block.

    ``start`` counts the tokens of all documents before it. A checksum that does not fit is an error. ``ids``
    are little-endian unsigned 32-bit integers.
    """
    found = spark.read.parquet(f"{path}/table").head()
    counts = np.frombuffer(found["counts"], "<i8")
    shared = spark.sparkContext.broadcast(counts)
    rows = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    before = F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("part_start"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        table = Table(shared.value)
        symbols = table.symbols()
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if zlib.crc32(r["words"]) != r["words_crc32"]:
                    raise ValueError(f"damaged words in part {r['part']}, block {r['block']}")
                tokens = decode_block(r["n_tokens"], r["words"], r["states"], r["places"], table, symbols).astype("<u4")
                if zlib.crc32(tokens.tobytes()) != r["ids_crc32"]:
                    raise ValueError(f"damaged ids in part {r['part']}, block {r['block']}")
                lengths = np.array(r["lengths"], np.int64)
                ends = np.cumsum(lengths)
                own = [tokens[a:b].tobytes() for a, b in zip(ends - lengths, ends, strict=True)]
                columns = [
                    pa.array([None if d == NO_ID else d for d in r["doc_ids"]], pa.int64()), pa.array(r["part_start"] + r["local_start"] + ends - lengths),
                    pa.array(lengths), pa.array([zlib.crc32(x) for x in own], pa.int64()), *([pa.array(own, pa.binary())] * keep_ids),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_batches(rows.join(parts, "part"), run, schema)


def token_path(spark: SparkSession) -> str:
    """A new folder for token files below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
