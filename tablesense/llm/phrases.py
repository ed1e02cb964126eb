"""Collocations: phrases of few words that occur together more often than their parts suggest, after Toivonen.

A sample of the documents, counted with a lowered threshold, proposes phrases. A pass over all documents then counts
the proposals and their negative border, that is every phrase whose shorter parts are all proposed, and all words.
Where a phrase of the border turns out frequent although the sample missed it, longer phrases could be missing: such
failures join the proposals, and a further pass counts just the phrases that this opens, until none fails. Counts are
exact whatever the sample holds; a poor sample costs passes.

Which phrases are proposed is known to all tasks by a bitmap of hashes of bounded size. A phrase that shares its bit
with a proposed one is counted too, which costs a row and changes no result. Phrases are counted in numpy by groups of
texts, with word numbers from an exact dictionary, then by Spark with partial sums before the shuffle.

Defined results: null and empty texts have no words, a null language is ``und``; documents count as often as they
occur, ids play no part; other columns are not read. Without phrases that are frequent enough there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesense.llm.common import LOWER, map_batches, mix, prefix_hash, runs, span_hashes, stored

NO_LANGUAGE = "und"
GROUP_BYTES = 1 << 20
"""Texts are counted by groups of about so many bytes; one text is never cut."""
FILTER_BITS = 1 << 27
"""At most so many bits (16 MB) say which phrases are proposed. More proposals than that make for more counted rows."""
PARTS = 64
"""Parts of a language that are ranked on their own first."""

BREAK = np.zeros(256, bool)
BREAK[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
GAP = BREAK.copy()
GAP[[0x20, 0x09]] = True

ARROW = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("n", pa.int64())])


class Words:
    """The words of some texts: one after another with single spaces, and whether the next one follows in the same piece."""

    def __init__(self, texts: list[bytes]):
        data = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        starts, ends = runs(~GAP[data])
        broken = np.concatenate(([0], np.cumsum(BREAK[data])))
        self.n = len(starts)
        self.follows = broken[starts[1:]] == broken[ends[:-1]]
        sizes = ends - starts
        self.starts = np.cumsum(sizes + 1) - sizes - 1
        self.ends = self.starts + sizes
        self.data = np.full(int((sizes + 1).sum()), 0x20, np.uint8)
        keep = np.ones(len(self.data), bool)
        keep[self.ends] = False
        self.data[keep] = data[~GAP[data]]

    def strings(self, at: np.ndarray, k: int) -> pa.Array:
        """The phrases of ``k`` words that start at the words ``at``."""
        a, b = self.starts[at], self.ends[at + k - 1]
        sizes = b - a
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        raw = self.data[np.repeat(a - offsets[:-1], sizes) + np.arange(offsets[-1])]
        kind = pa.binary() if offsets[-1] < 1 << 31 else pa.large_binary()
        offsets = offsets.astype(np.int32 if kind == pa.binary() else np.int64)
        return pa.Array.from_buffers(kind, len(at), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


def _language(name: str) -> np.uint64:
    return span_hashes(prefix_hash(np.frombuffer(name.encode() + b"\n", np.uint8)), np.array([0]), np.array([len(name.encode()) + 1]))[0]


def _place(at: np.ndarray, k: int, lang: np.uint64, hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bit that stands for each phrase of ``k`` words and its language."""
    h = np.full(len(at), lang)
    for i in range(k):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + hashes[at + i])
    return (h & np.uint64(bits - 1)).astype(np.int64)


def _hashes(words: Words) -> np.ndarray:
    return span_hashes(prefix_hash(words.data), words.starts, words.ends)


def _in(bitmap: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (bitmap[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1


def _distinct(numbers: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the dense numbers at the places ``at``: a place of each that occurs, and how often it does."""
    own = numbers[at]
    place = np.zeros(int(own.max()) + 1, np.int64)
    place[own] = at
    n = np.bincount(own)
    used = np.flatnonzero(n)
    return place[used], n[used]


def _counted(texts: list[bytes], lang: str, sizes: range, old: np.ndarray | None, new: np.ndarray | None) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """The distinct phrases of some texts with their counts, by size; the phrase '' stands for all words.

    A phrase is counted where all its shorter parts are in ``new`` (None: all are), and not all in ``old``. Phrases have exact dense numbers: a word by a dictionary, a longer one by the numbers of its two parts.
    """
    words = Words(texts)
    if not words.n:
        return
    if 1 in sizes:
        yield pa.array([b""], pa.binary()), np.array([words.n])
    numbers = words.strings(np.arange(words.n), 1).dictionary_encode().indices.to_numpy().astype(np.int64)
    hashes, language, before = (None if new is None else _hashes(words)), _language(lang), None
    for k in range(1, sizes.stop):
        fresh = numbers >= 0
        if k > 1:
            fresh = fresh[:-1] & fresh[1:]
            if k == 2:
                fresh &= words.follows
            at = np.flatnonzero(fresh)
            longer = np.full(len(fresh), -1, np.int64)
            longer[at] = pd.factorize(numbers[at] * (int(numbers.max(initial=0)) + 1) + numbers[at + 1])[0]
            numbers = longer
            if before is not None:
                before = before[:-1] & before[1:]
                fresh &= ~before
        at = np.flatnonzero(fresh)
        if k in sizes and len(at):
            first, n = _distinct(numbers, at)
            yield words.strings(first, k), n
        if new is not None and k + 1 < sizes.stop:
            at = np.flatnonzero(numbers >= 0)
            place = _place(at, k, language, hashes, 64 * len(new))
            if old is not None:
                inside = np.zeros(len(numbers), bool)
                inside[at] = _in(old, place)
                before = inside if before is None else before & inside
            numbers[at[~_in(new, place)]] = -1


def _by_language(batch: pa.RecordBatch, most: int) -> Iterator[tuple[str, np.ndarray, list[bytes]]]:
    """Language, rows and second column of the rows, null as empty, in groups of about ``most`` bytes."""
    code, names = pd.factorize(np.array(batch.column(0).to_pylist(), object))
    values = batch.column(1)
    for c, name in enumerate(names):
        group, rows, size = [], [], 0
        for i in np.flatnonzero(code == c).tolist():
            raw = values[i].as_py() or b""
            if group and size + len(raw) > most:
                yield name, np.array(rows), group
                group, rows, size = [], [], 0
            group.append(raw)
            rows.append(i)
            size += len(raw)
        yield name, np.array(rows), group


def _count(texts: DataFrame, sizes: range, least: int, old: np.ndarray | None = None, new: np.ndarray | None = None) -> DataFrame:
    """Counts of phrases (lang, phrase, n) that are at least ``least``, and of all words under the phrase ''."""
    context = texts.sparkSession.sparkContext
    shared = context.broadcast((old, new))

    def run(batches):
        before, now = shared.value
        for batch in batches:
            for name, _, group in _by_language(batch, GROUP_BYTES):
                for phrases, n in _counted(group, name, sizes, before, now):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(n), pa.string()), phrases, pa.array(n, pa.int64())], schema=ARROW)

    counted = map_batches(texts, run, "lang string, phrase binary, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    found = counted.where((F.col("n") >= least) | (F.octet_length("phrase") == 0))
    kept = stored(found.select("lang", F.col("phrase").cast("string").alias("phrase"), "n"), "phrase-counts")
    shared.destroy()
    return kept


def _places(phrases: DataFrame, bits: int, known: np.ndarray | None) -> DataFrame:
    """The bit of each phrase that is not ``known`` yet."""
    context = phrases.sparkSession.sparkContext
    shared = context.broadcast(known)

    def run(batches):
        for batch in batches:
            for name, _, group in _by_language(batch, GROUP_BYTES):
                words = Words(group)  # each phrase is a piece of its own
                first = np.flatnonzero(np.concatenate(([True], ~words.follows))[: words.n])
                sizes, hashes, language = np.diff(np.concatenate((first, [words.n]))), _hashes(words), _language(name)
                for k in np.unique(sizes).tolist():
                    place = _place(first[sizes == k], k, language, hashes, bits)
                    if shared.value is not None:
                        place = place[~_in(shared.value, place)]
                    yield pa.RecordBatch.from_arrays([pa.array(place)], names=["place"])

    return map_batches(phrases.select("lang", F.col("phrase").cast("binary").alias("phrase")), run, "place long")


def _bitmap(phrases: DataFrame, bits: int, known: np.ndarray | None = None) -> np.ndarray | None:
    """Bits of the phrases as 64-bit words, joined with ``known``; None where all phrases are known. At most ``bits`` / 64 rows are collected."""
    place = _places(phrases, bits, known)
    bit = F.expr("shiftleft(1L, cast(place % 64 as int))")
    rows = place.groupBy((F.col("place").bitwiseAND(F.lit(bits - 64)) / 64).cast("long").alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    if not rows.num_rows:
        return None
    out = np.zeros(bits // 64, np.uint64) if known is None else known.copy()
    out[rows.column("word").to_numpy()] |= rows.column("bits").to_numpy().view(np.uint64)
    return out


def _size() -> Column:
    return F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ", -1)))


def frequent_phrases(documents: DataFrame, most_words: int = 3, least: int = 10, share: float = 0.25, filter_bits: int = FILTER_BITS) -> DataFrame:
    """All phrases of up to ``most_words`` words with ``least`` occurrences or more: (lang, phrase, n), exactly.

    ``share`` is the part of the documents that is sampled; a phrase is proposed by half the occurrences expected there,
    twice at least. The phrase '' has the number of all words of the language.
    """
    texts = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.col("text").cast("binary").alias("text"))
    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(1000)) < round(1000 * share))
    proposed = _count(sample, range(1, max(most_words, 2)), max(2, round(least * share / 2))).where("phrase <> ''")
    bits = 1 << 16
    while bits < min(filter_bits, 16 * proposed.count()):
        bits *= 2
    known = _bitmap(proposed, bits)
    if known is None:
        known = np.zeros(bits // 64, np.uint64)
    passes = [_count(texts, range(1, most_words + 1), least, None, known)]
    while True:
        failed = passes[-1].where(_size().between(1, most_words - 1))
        wider = _bitmap(failed, bits, known)
        if wider is None:
            return reduce(DataFrame.unionByName, passes)
        passes.append(_count(texts, range(2, most_words + 1), least, known, wider).where("phrase <> ''"))
        known = wider


def collocations(documents: DataFrame, most_words: int = 3, least: int = 10, within: int = 50, top: int = 2000, **mining) -> DataFrame:
    """The first ``top`` phrases of each language by how much more often they occur than their parts suggest.

    ``score`` is floor(1000000 * a * a / (l * r)) of the lowest-scoring cut, the first of equal ones. A phrase that
    makes up ``within`` percent or less of a longer one's occurrences beyond it is left out, that is where
    100 * n of a longer phrase that contains it is at least ``within`` * a. Columns: lang, rank, phrase, a, l, r, n, score.
    """
    counts = frequent_phrases(documents, most_words, least, **mining).withColumn("size", _size())
    words = F.split("phrase", " ", -1)
    candidates = counts.where("size > 1").withColumnRenamed("n", "a")
    cuts = candidates.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"), words.alias("w"))
    cuts = cuts.select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("head"),
        F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("tail"),
    )
    parts = counts.where(F.col("size").between(1, most_words - 1))
    for side, number in (("head", "l"), ("tail", "r")):
        cuts = cuts.join(parts.select("lang", F.col("phrase").alias(side), F.col("n").alias(number)), ["lang", side])
    wide = {c: F.col(c).cast("decimal(19,0)").alias(c) for c in ("a", "l", "r")}
    score = F.expr("cast(1000000 as decimal(7,0)) * (wide.a * wide.a) div (wide.l * wide.r)")
    cuts = cuts.withColumn("wide", F.struct(*wide.values())).withColumn("score", score)
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    longer = candidates.where("size > 2").select("lang", "a", words.alias("w"), F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("k"))
    longer = longer.select("lang", "a", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("k") + 1), lambda i: F.array_join(F.slice("w", i, F.col("k")), " "))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    scored = scored.join(longer, ["lang", "phrase"], "left").where(
        F.coalesce(F.lit(100) * F.col("longer") < F.lit(within) * F.col("a"), F.lit(True))
    )
    totals = counts.where("size = 0").select("lang", "n")
    flat = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of each part of a language first, so that none is sorted whole in one task
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS)).alias("part")
    first = flat.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, doc_id, generate_subscripts(p, 1) AS piece, unnest(p) AS words FROM (
        SELECT lang, row_number() OVER () AS doc_id, text,
            list_transform(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[.,;:!?\x0A-\x0D]'), lambda x: regexp_extract_all(x, '[^\x20\x09]+')) AS p
        FROM documents)
), w AS (
    SELECT lang, doc_id, piece, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM pieces
), grams AS (
    SELECT lang, word AS w1, lead(word) OVER each AS w2, lead(word, 2) OVER each AS w3 FROM w WINDOW each AS (PARTITION BY doc_id, piece ORDER BY place)
), counts AS (
    SELECT lang, 1 AS size, w1 AS phrase, count(*) AS f FROM grams GROUP BY ALL
    UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM grams WHERE w2 IS NOT NULL GROUP BY ALL
    UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM grams WHERE w3 IS NOT NULL GROUP BY ALL
), candidates AS (
    SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM counts WHERE size > 1 AND f >= 10
), cuts AS (
    SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS head, array_to_string(ws[k + 1:], ' ') AS tail
    FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates)
), scored AS (
    SELECT c.lang, c.phrase, c.a, c.k, h.f AS l, t.f AS r, CAST((1000000::HUGEINT * c.a * c.a) // (h.f::HUGEINT * t.f) AS BIGINT) AS score
    FROM cuts c JOIN counts h ON h.lang = c.lang AND h.phrase = c.head JOIN counts t ON t.lang = c.lang AND t.phrase = c.tail
), best AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
    SELECT lang, part, max(a) AS longer FROM (
        SELECT lang, a, unnest([ws[1] || ' ' || ws[2], ws[2] || ' ' || ws[3]]) AS part FROM candidates WHERE size = 3) GROUP BY ALL
), kept AS (
    SELECT b.* FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.part = b.phrase WHERE i.longer IS NULL OR 100 * i.longer < 50 * b.a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
) JOIN (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE size = 1 GROUP BY lang) USING (lang) WHERE rank <= 2000
"""
