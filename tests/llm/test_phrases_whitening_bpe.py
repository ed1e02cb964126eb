"""Phrases, whitening and byte pairs against plain computations and the tokenizers library."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tablesense.llm import bpe, phrases, whitening
from tablesense.llm.queries import op12_whitening, op13_bpe

VOCABULARY = "byte_bpe_50k.json"
SF = "/root/testdata/sf0.001"


def library_ids(texts):
    library = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    return [e.ids for e in library.encode_batch(list(texts), add_special_tokens=False)]


def ids_of(raw):
    return np.frombuffer(raw, "<u4").tolist()


# byte pairs


def odd_texts():
    rnd = random.Random(3)
    signs = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    letters = "etaoinshrdlucmfwypvbgkqjxzABC"
    return [
        "", " ", "\n", "it's we'll I'D", "a  b\t\tc \n\n d", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "<|endoftext", "\x1c\x1d a\x1eb", "\x85\xa0x",
        "a" * 20_001, "ab" * 9_000, "the" * 5_000, " " * 3_000, "=-" * 4_000, "".join(rnd.choice(letters) for _ in range(60_000)),
        *("".join(rnd.choice("abcdet hs'") for _ in range(400)) for _ in range(60)),
        *("".join(rnd.choice(signs) for _ in range(150)) for _ in range(60)),
        *("".join(rnd.choice(signs[:0x600]) for _ in range(300)) for _ in range(60)),
        *(f"a{c}1 {c} {c}{c}.{c}" for c in signs[0x250:0x3000:3] + signs[0xA7C0:0xA800] + signs[0x10D40:0x10D60]),
    ]


def test_ids_and_texts_are_the_librarys():
    texts = odd_texts()
    own = bpe.codec(VOCABULARY)
    found = own.encode(texts)
    library = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    for text, raw, ids in zip(texts, found, library_ids(texts), strict=True):
        assert ids_of(raw) == ids, text[:60]
    assert own.decode(found) == [library.decode(ids_of(raw), skip_special_tokens=False) for raw in found] == texts


def test_ids_that_spell_no_text():
    own, library = bpe.codec(VOCABULARY), Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    rnd = random.Random(5)
    rows = [[rnd.randrange(50_257) for _ in range(40)] for _ in range(200)] + [[], [50_256], [70_000, 5]]
    assert own.decode([np.array(r, "<u4").tobytes() for r in rows]) == [library.decode(r, skip_special_tokens=False) for r in rows]


def test_merges_that_are_not_in_order():
    """A token that two merges make: one place of a word at a time."""
    # symbols a b c; merges ab+c, a+b, bc, a+bc (makes abc as well)
    merges = bpe.Merges(np.array([(3, 2), (0, 1), (1, 2), (0, 5)]), np.array([4, 3, 5, 4]), 6)
    assert not merges.ordered
    rnd = random.Random(2)
    words = [[rnd.randrange(3) for _ in range(rnd.randrange(1, 30))] for _ in range(300)]
    rank, made = {(3, 2): 0, (0, 1): 1, (1, 2): 2, (0, 5): 3}, [4, 3, 5, 4]
    got, sizes = merges.merge(np.concatenate(words), np.array([len(w) for w in words]))
    for word, mine in zip(words, np.split(got, np.cumsum(sizes)[:-1]), strict=True):
        while options := [(rank[p], i) for i, p in enumerate(zip(word, word[1:])) if p in rank]:
            r, i = min(options)
            word = [*word[:i], made[r], *word[i + 2 :]]
        assert mine.tolist() == word


def test_registered_byte_pairs(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = {r["doc_id"]: r for r in op13_bpe(spark, SF).collect()}
    assert len(rows) == len(documents)
    for d, ids in zip(documents, library_ids(d["text"] or "" for d in documents), strict=True):
        r = rows[d["doc_id"]]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((d["text"] or "").encode()).hexdigest()


def test_byte_pairs_of_nulls_repeats_and_extra_columns(spark):
    rows = [(1, None, "k"), (1, None, "k"), (None, "", "l"), (2, "a b" * 2000, None)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    tokens = bpe.encode(documents, VOCABULARY, "doc_id")
    found = bpe.decode(tokens, VOCABULARY, "doc_id").collect()
    assert sorted(r["decoded"] for r in found) == ["", "", "", "a b" * 2000]
    assert bpe.encode(documents.limit(0), VOCABULARY, "doc_id").collect() == []
    broken = spark.sql("select 1 as doc_id, cast(x'ff41' as string) as text")
    assert bpe.decode(bpe.encode(broken, VOCABULARY, "doc_id"), VOCABULARY).head()["decoded"] == "�A"


# phrases


def plain_phrases(rows, most_words=3, least=10, within=50, top=2000):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for k in range(1, most_words + 1):
                counts.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    candidates = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    inside = Counter()
    for (lang, words), a in candidates.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                inside[lang, words[i : i + k]] = max(inside[lang, words[i : i + k]], a)
    out = []
    for (lang, words), a in candidates.items():
        if 100 * inside[lang, words] >= within * a:
            continue
        cuts = [(1_000_000 * a * a // (counts[lang, words[:k]] * counts[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(words).encode(), counts[lang, words[:k]], counts[lang, words[k:]]))
    ranked, place = [], Counter()
    for lang, score, a, phrase, left, right in sorted(out):
        place[lang] += 1
        if place[lang] <= top:
            ranked.append((lang, place[lang], phrase.decode(), -a, left, right, totals[lang], -score))
    return ranked


def some_texts(seed=1, many=300):
    rnd = random.Random(seed)
    words = ["Ab", "c", "é", "z'z", "x\x0by", "aa", "a", "ß", " "] + [f"w{i}" for i in range(30)]
    weights = [1 / (i + 1) for i in range(len(words))]
    gaps = [" "] * 12 + ["  ", "\t", ". ", ",", "\n", " \r "]
    rows = []
    for _ in range(many):
        text = "".join(rnd.choices(words, weights)[0] + rnd.choice(gaps) for _ in range(rnd.randrange(40)))
        rows.append((rnd.choice(["en", "en", "en", "de", None, "und"]), text))
    return [*rows, ("en", None), ("en", ""), ("fr", " .,; "), *[("de", "one of these days " * 4)] * 12, ("xx", "a a a a a a a a a a a a")]


@pytest.mark.parametrize("options", [{}, {"share": 0.0}, {"share": 1.0}, {"filter_bits": 64, "share": 0.1}, {"most_words": 4}, {"most_words": 2}, {"top": 5}])
def test_phrases_are_those_of_plain_counting(spark, options):
    rows = some_texts()
    documents = spark.createDataFrame([(i, *r, "extra") for i, r in enumerate(rows)], "doc_id long, lang string, text string, n string").repartition(5)
    found = phrases.collocations(documents, **options).orderBy("lang", "rank").collect()
    plain = {k: v for k, v in options.items() if k in ("most_words", "top")}
    assert [tuple(r) for r in found] == plain_phrases(rows, **plain)


def test_expansion_passes_find_what_the_sample_missed(spark):
    """A sample without any document proposes nothing: words fail, then pairs, then triples are counted."""
    rows = [("en", "alpha beta gamma delta")] * 15 + [("en", "beta gamma")] * 3
    documents = spark.createDataFrame(rows, "lang string, text string")
    counts = {r["phrase"]: r["n"] for r in phrases.frequent_phrases(documents, most_words=4, share=0.0).collect()}
    assert counts["alpha beta gamma delta"] == 15 and counts["beta gamma"] == 18 and counts[""] == 66


def test_no_phrases(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(empty).collect() == []
    rare = spark.createDataFrame([("en", "a b c")] * 9, "lang string, text string")
    assert phrases.collocations(rare).collect() == []


def test_scores_beyond_64_bits(spark):
    """Products of counts are decimals: ten billion occurrences each."""
    n = 10**10
    row = spark.sql(f"select cast(1000000 as decimal(7,0)) * (cast({n} as decimal(19,0)) * cast({n} as decimal(19,0))) div (cast({n} as decimal(19,0)) * cast({n} as decimal(19,0))) as s").head()
    assert row["s"] == 1_000_000


# whitening


def plain_whitening(x, k=16):
    distinct = np.unique(x, axis=0).astype(float)
    centred = distinct - distinct.mean(0)
    values, vectors = np.linalg.eigh(centred.T @ centred / len(distinct))
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return (x - distinct.mean(0)) @ vectors / np.sqrt(values), values / np.trace(centred.T @ centred / len(distinct)), distinct


def test_registered_whitening(spark):
    rows = op12_whitening(spark, SF).orderBy("vec_id", "component").toPandas()
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").toPandas()
    x = np.floor(64 * np.array(vectors["embedding"].tolist(), np.float64)) + 1_000_000
    want, explained, distinct = plain_whitening(x)
    got = rows["whitened"].to_numpy().reshape(-1, 16)
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-7)
    assert np.allclose(rows["explained"][:16], explained, rtol=1e-10)
    assert rows["identity_error"].nunique() == 1 and rows["identity_error"][0] < 1e-9
    deviation = ((len(distinct) * x - distinct.sum(0)) ** 2).sum(1)
    assert (rows["deviation"][::16].to_numpy() == deviation).all() and set(rows["n"]) == {len(distinct)}


def test_characteristic_polynomial_is_exact(spark):
    rnd = np.random.default_rng(4)
    for d, rank in ((1, 1), (4, 2), (6, 6)):
        b = rnd.integers(-1000, 1000, (rank, d)).astype(object)
        a = b.T @ b
        polynomial = whitening.characteristic(spark, a)
        power, total = np.eye(d, dtype=object), np.zeros((d, d), object)
        for c in polynomial:  # Cayley and Hamilton
            total, power = total + c * power, power @ a
        assert not total.any() and polynomial[-1] == 1 and polynomial[-2] == -np.trace(a)


def test_roots_and_null_spaces_of_repeated_eigenvalues():
    a = np.diag([9, 5, 5, 5, 2, 0, 0]).astype(object)
    polynomial = [1]
    for e in (9, 5, 5, 5, 2, 0, 0):
        polynomial = [(polynomial[i - 1] if i else 0) - e * (polynomial[i] if i < len(polynomial) else 0) for i in range(len(polynomial) + 1)]
    roots = whitening.largest_roots(polynomial, 7, 26)
    assert [(v / 2**b, t) for v, b, t in roots] == [(9.0, 1), (5.0, 3), (2.0, 1)]
    five = np.array(whitening.null_space(a, roots[1]))
    assert np.allclose(five @ five.T, np.eye(3)) and np.allclose(five[:, [0, 4, 5, 6]], 0)


def test_whitening_of_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    good = [[0.5, 1.0], [0.25, -1.0], [0.75, 3.5], [0.5, 1.0]]
    bad = [None, [], [1.0, None], [nan, 1.0], [inf, 0.0], [1.0, 2.0, 3.0]]
    rows = [(i if i else None, v, "y") for i, v in enumerate(good + bad)]
    found = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string")).collect()
    assert len(found) == 8 and {r["n"] for r in found} == {3} and sorted({r["vec_id"] or 0 for r in found}) == [0, 1, 2, 3]
    same = {round(r["whitened"], 12) for r in found if r["vec_id"] in (None, 3) and r["component"] == 1}
    assert len(same) == 1
    for none in (rows[4:9], rows[:1] * 3, []):
        assert whitening.whitened(spark.createDataFrame(none, "vec_id long, embedding array<double>, x string")).collect() == []


def test_whitening_of_large_entries_stays_exact(spark):
    values = [[3e12, 1.0], [-2.5e12, 7.0], [1e12, -2.0], [9e11, 5.0]]
    found = whitening.whitened(spark.createDataFrame(list(enumerate(values)), "vec_id long, embedding array<double>")).collect()
    x = [[int(64 * c) + 1_000_000 for c in v] for v in values]
    sums = [sum(c) for c in zip(*x)]
    want = {i: sum((4 * c - s) ** 2 for c, s in zip(v, sums)) for i, v in enumerate(x)}
    assert {r["vec_id"]: int(r["deviation_digits"]) for r in found} == want
    assert all(r["deviation"] is None or r["deviation"] == want[r["vec_id"]] for r in found) and found[0]["identity_error"] < 1e-6
