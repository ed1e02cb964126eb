"""Mixing against its targets, token files against the library and against damage."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tablesense.llm import mixing, token_output

VOCABULARY = "byte_bpe_50k.json"


def targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    stopped, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in stopped)
        open_ = [s for s in order if s not in stopped]
        share = {s: w[s] * rest / sum(w[x] for x in open_) for s in open_}
        new = {s for s in open_ if share[s] > most * sizes[s]}
        if not new:
            return {s: float(most * sizes[s]) if s in stopped else share[s] for s in order}
        stopped |= new


def test_mix_meets_its_targets(make):
    rows = [(i, "w " * (i % 17), s, 0, i) for i in range(200) for s in ("a", "b", None)[: 1 + i % 3]]
    rows += [(900, "x " * 3000, "long", 0, 1), (901, None, "empty", 0, 1), (902, "y", "tiny", 0, 1), (None, "z z z", "tiny", 0, 1), (902, "y", "tiny", 0, 1)]
    documents = make(rows, "doc_id long, text string, source string, n_chars long, words long")
    found = mixing.taken(documents).collect()
    sizes = {}
    for _, text, source, _, _ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = targets(sizes)
    assert len(found) == len(rows)
    assert all(r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]] for r in found)
    assert all(abs(r["target"] - want[r["source"]]) < 1e-6 for r in found)
    taken = {s: sum(r["taken"] for r in found if r["source"] == s) for s in sizes}
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    mixed = mixing.mixed(documents)
    assert mixed.columns == documents.columns
    got = {r["source"]: r["n"] for r in mixed.groupBy("source").agg(F.sum(mixing.n_words()).alias("n")).collect()}
    assert got == {s: n for s, n in taken.items() if n}
    assert sorted(mixing.taken(documents).collect(), key=str) == sorted(found, key=str)
    assert mixing.taken(documents.limit(0)).count() == 0 and mixing.mixed(documents.limit(0)).count() == 0


@pytest.mark.parametrize("sizes", [
    {"a": 5000, "b": 2000, "c": 1000}, {"a": 1000, "b": 500, "c": 400, "d": 1000}, {"a": 7, "b": 7, "c": 7}, {"a": 10, "b": 4, "c": 2, "d": 10, None: 900},
    {"a": 1, "b": 1, "c": 100_000}, {"a": 0, "b": 0, "c": 5}, {"a": 0}, {"a": 50, "b": 20, "c": 10, "d": 50, "e": 20, "f": 10, "g": 5000},
])
def test_targets_of_equal_ratios(make, sizes):
    found = mixing.source_targets(make(list(sizes.items()), "source string, source_size long")).collect()
    want = targets(sizes)
    assert {r["source"]: round(r["target"], 6) for r in found} == {s: round(t, 6) for s, t in want.items()}
    assert abs(sum(r["target"] for r in found) - min(sum(sizes.values()), 3 * sum(sizes.values()))) < 1e-6


def test_equal_sources_are_mixed_whole(make):
    rows = [(i, "w " * 10, s, "x", "y") for s in "abc" for i in range(30)]
    documents = make(rows, "doc_id long, text string, source string, _h string, nth string")
    found = mixing.taken(documents).collect()
    total = sum(r["taken"] for r in found)
    assert abs(total - 900) <= 1.5 and min(r["taken"] for r in found if r["source"] == "a") > 0
    mixed = mixing.mixed(documents)
    assert mixed.columns == documents.columns and mixed.agg(F.sum(mixing.n_words())).head()[0] == total


def test_every_stretch_of_the_schedule_is_balanced(spark, make):
    quotas = make([("a", 600), ("b", 300), ("c", 100), ("d", 0)], "source string, blocks long")
    rows = mixing.schedule(spark, quotas, 1000).orderBy("slot").collect()
    assert len(rows) == 1000 and len({(r["source"], r["block"]) for r in rows}) == 1000
    for a in range(0, 900, 100):
        assert abs(sum(r["source"] == "a" for r in rows[a : a + 100]) - 60) <= 5


def test_first_slots_mix_the_sources(make):
    rows = [(i, "w " * 10, s) for i in range(100) for s in ("a", "b")]
    documents = make(rows, "doc_id long, text string, source string").unionAll(make([(900, "", "a")], "doc_id long, text string, source string"))
    found = mixing.taken(documents, weights=(2, 1), block_words=10).orderBy("first_slot").collect()
    taken = [r for r in found if r["taken"]]
    assert len(taken) == 167 and all(r["first_slot"] is None for r in found if not r["taken"])
    for a in range(0, 120, 30):
        assert abs(sum(r["source"] == "a" for r in taken[a : a + 30]) - 20) <= 3


TEXTS = [
    "", None, "plain words  with   gaps", "  lead", "trail \n\n x", "don't we'll I'm", "tab\tand\nline \r\n end ", "αβγ 漢字  nbsp em", "a<|endoftext|>b", "\x1c\x1d odd",
    "x" * 5000, "12345 6-7", " \n \n a", "\n \nb", "é" * 300 + " ", "a \u0085b", "😀 emoji 😀😀",
]


def test_word_cache_equals_whole_text():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    own = token_output.Encoder(public_tokenizers.path(VOCABULARY), 0)
    for _ in range(2):
        got = [np.frombuffer(x, own.dtype).tolist() for x in own.encode(TEXTS)]
        assert got == [library.encode(t or "", add_special_tokens=False).ids + [0] for t in TEXTS]


def test_word_cache_equals_whole_text_on_random_marks():
    rng = random.Random(1)
    letters = list("abzéÿ×÷ĀǍ  \n\t'’.,!-_&%$#@0129²½Ⅷ漢字ßsStTdmlvre  \u0085|`~́ªµº")
    own = token_output.Encoder(public_tokenizers.path(VOCABULARY), 0)
    texts = ["".join(rng.choices(letters, k=rng.randrange(40))) for _ in range(5000)]
    want = [np.array(x.ids + [0], own.dtype).tobytes() for x in own.library.encode_batch(texts, add_special_tokens=False)]
    assert own.encode(texts) == want


def test_files_give_back_what_went_in(spark, make, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    rows = [(i * 3 % 101, t, "x") for i, t in enumerate(TEXTS * 4)] + [(None, "last", "x"), (5, "again", "x"), (5, "again", "x")]
    documents = make(rows, "doc_id long, text string, ids string").repartition(5)
    token_output.write_tokens(documents, str(tmp_path / "t"), VOCABULARY)
    found = token_output.read_tokens(spark, str(tmp_path / "t"), keep_ids=True).orderBy("start").collect()
    assert [r["doc_id"] for r in found] == sorted((r[0] for r in rows if r[0] is not None)) + [None]
    start = 0
    for r in found:
        ids = np.frombuffer(r["ids"], "<u4")
        assert r["start"] == start and r["n_tokens"] == len(ids) and ids[-1] == 0 and r["ids_crc32"] == zlib.crc32(r["ids"])
        start += len(ids)
    texts = sorted((r[0] if r[0] is not None else 1000, library.encode(r[1] or "", add_special_tokens=False).ids + [0]) for r in rows)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else 1000, np.frombuffer(r["ids"], "<u4").tolist()) for r in found) == texts
    token_output.write_tokens(documents.limit(0), str(tmp_path / "none"), VOCABULARY)
    assert token_output.read_tokens(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 7, 8, 1000, 5003])
def test_blocks_and_their_parts(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 3000).astype(np.uint32)
    counts = np.bincount(ids, minlength=3000)
    table = token_output.Table(counts)
    words, states, places = token_output.encode_block(ids, table, lanes=8, every=16)
    symbols = table.symbols()
    assert (token_output.decode_block(n, words, states, places, table, symbols, 8, 16) == ids).all()
    for part in range(len(places)):
        own = token_output.decode_block(n, words, states, places, table, symbols, 8, 16, range(part, part + 1))
        assert (own == ids[part * 128 : (part + 1) * 128]).all()
    if n > 1000:
        assert len(words) < 2 * n


def test_damage_is_an_error(spark, make, tmp_path):
    token_output.write_tokens(make([(1, "some text")], "doc_id long, text string"), str(tmp_path / "t"), VOCABULARY)
    blocks = spark.read.parquet(str(tmp_path / "t" / "blocks")).withColumn("words_crc32", F.lit(1).cast("long"))
    blocks.write.parquet(str(tmp_path / "u" / "blocks"))
    spark.read.parquet(str(tmp_path / "t" / "table")).write.parquet(str(tmp_path / "u" / "table"))
    with pytest.raises(Exception, match="damaged"):
        token_output.read_tokens(spark, str(tmp_path / "u")).collect()
