"""Toxicity and quality: held-out accuracy, odd rows, and what an empty or one-sided sample gives."""

import os
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablesense.llm import quality, toxicity
from tablesense.llm.common import fold, groups, labelled_sample, labelled_texts, mean_of_tasks, pieces, prefix_hash, span_hashes

DATA = "/root/testdata/sf0.1"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are not here")


def auc(scores, labels):
    rank = pd.Series(scores).rank().to_numpy()
    ones = labels == 1
    return (rank[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / ones.sum() / (~ones).sum()


@needs_data
@pytest.mark.parametrize(("module", "target", "modulus", "rest", "least"), [(quality, "quality", 3, 1, 0.97), (toxicity, "toxic", 5, 0, 0.85)])
def test_held_out_accuracy(module, target, modulus, rest, least):
    rows = pd.read_parquet(f"{DATA}/documents.parquet").merge(pd.read_parquet(f"{DATA}/labels.parquet"), on="doc_id")
    part = rows.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % modulus)
    learn, held = rows[part != rest], rows[part == rest]
    model = module.train(list(zip(learn.text, learn[target], learn.lang, strict=True)))
    logits = model.logits(held.text.tolist())
    assert auc(logits, held[target].to_numpy()) > least
    assert ((logits >= 0) == held[target].to_numpy()).mean() > 0.9


@needs_data
def test_toxic_rows_are_caught():
    """Held-out rates, overall and for rows with a word that only toxic rows of the learning part have, 50 times or more."""
    rows = pd.read_parquet(f"{DATA}/documents.parquet").merge(pd.read_parquet(f"{DATA}/labels.parquet"), on="doc_id")
    part = rows.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5)
    learn, held = rows[part != 0], rows[part == 0]
    words = {i: set(re.findall(r"[a-z]+", text.lower())) for i, text in zip(rows.doc_id, rows.text, strict=True)}
    toxic, clean = Counter(), Counter()
    for i, y in zip(learn.doc_id, learn.toxic, strict=True):
        (toxic if y else clean).update(words[i])
    plain = {w for w, n in toxic.items() if n >= 50 and not clean[w]}
    assert plain
    found = toxicity.train(list(zip(learn.text, learn.toxic, learn.lang, strict=True))).logits(held.text.tolist()) >= 0
    real = held.toxic.to_numpy() == 1
    assert found[real].mean() >= 0.8 and (~found[~real]).mean() >= 0.995
    with_plain = np.array([bool(words[i] & plain) for i in held.doc_id])
    assert found[with_plain].mean() >= 0.98


def test_rare_words_do_not_make_a_text_toxic():
    """Words never seen change nothing (up to a shared bucket), so a text of many scores as a text of one."""
    net = toxicity.train([(f"plain text {'vile' if i % 2 else 'kind'} end", i % 2, "en") for i in range(400)])
    unseen = net.logits([" ".join(f"q{n}z" for n in range(200)), "zzzz"])
    assert abs(unseen[0] - unseen[1]) < 1e-4
    vile, kind = net.logits(["some vile words", "some kind words"])
    assert vile > 0 > kind


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_texts_and_samples(module):
    for sample in ([], [("a b", 1, "en")], [("x", 0, None), ("", 1, None)]):
        model = module.train(sample)
        logits = model.logits([None, "", "word " * 50_000, "\x00", "word"])
        assert np.isfinite(logits).all() and logits[0] == logits[1]


def test_scoring_does_not_depend_on_neighbours():
    texts = ["good text here", "bad bad bad", "", "some more words " * 300]
    model = quality.train([(t, i % 2, "en") for i, t in enumerate(texts * 5)])
    net = toxicity.train([(t, i % 2, "en") for i, t in enumerate(texts * 5)])
    for m in (model, net):
        assert np.allclose(m.logits(texts), [m.logits([t])[0] for t in texts], atol=1e-5)


def test_scored_rows(spark, make):
    documents = make([(1, "a b", "en", 9.0), (1, "a b", "en", 9.0), (None, None, None, None)], "doc_id long, text string, lang string, score double")
    model = quality.train([("a", 0, "en"), ("b", 1, "en")] * 10)
    rows = quality.score(documents, model, "doc_id").collect()
    assert len(rows) == 3 and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(documents.limit(0), toxicity.train([]), "doc_id").count() == 0
    assert quality.accepted(documents, model).columns == documents.columns


def test_sample_is_bounded_and_obeys_the_fold(spark, make):
    documents = make([(i, f"text {i}" if i % 3 else None, "en") for i in range(40)] + [(None, "x", None)], "doc_id long, text string, lang string")
    labels = make([(i % 40, i % 2) for i in range(80)] + [(None, 1), (7, None)], "doc_id long, quality int")
    assert len(labelled_sample(documents, labels, "quality", fold(3) != 1, 5, 10_000)) == 10
    everything = labelled_sample(documents, labels, "quality", fold(3) != 1, 100, 10_000)
    assert len(everything) == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(40))
    assert sum(len(t) for t, _, _ in labelled_sample(documents, labels, "quality", F.lit(True), 100, 50)) <= 50
    assert labelled_sample(documents, labels.limit(0), "quality", F.lit(True), 5, 100) == []


def test_span_hashes_depend_on_content_only():
    data = np.frombuffer(b"abc xyz abc abcd", np.uint8)
    h = span_hashes(prefix_hash(data), np.array([0, 4, 8, 12]), np.array([3, 7, 11, 16]))
    assert h[0] == h[2] and len(set(h.tolist())) == 3
    assert [len(g) for _, g in pieces(["a" * 10, None, "b" * 10], most=12)] == [2, 1]


def test_toxicity_learns_from_rows_beyond_the_sample(make):
    """Eight insults, a sample that has room for four toxic rows: all insults count, and all rows count in the vocabulary."""
    insults = [f"insult{c}" for c in "abcdefgh"]
    rows = [(i, f"plain words {insults[i % 8] if i % 16 < 8 else 'kind'} and the end", "en") for i in range(1600)]
    documents = make(rows, "doc_id long, text string, lang string")
    labels = make([(i, int(i % 16 < 8)) for i in range(1600)], "doc_id long, toxic int")
    net = toxicity.fit(documents, labels, F.lit(True), rows=4, passes=8)
    assert (net.logits([f"plain words {w} and the end" for w in insults]) >= 0).all()
    assert net.logits(["plain words kind and the end"])[0] < 0
    counts, total = toxicity.spread(documents)
    assert total == 1600
    ids = toxicity.tokens([b"insulta", b"kind", b"plain"])[0][:, 0]
    assert [counts[i] for i in ids[ids > 0]] == [100, 800, 1600]


def test_thresholds_over_all_rows_equal_those_in_memory(make):
    rng = np.random.default_rng(3)
    rows = [(lang, int(y), float(x + 2 * y)) for lang in ("en", "fr", None) for y, x in zip(rng.random(300) < 0.2, rng.normal(0, 1, 300), strict=True)]
    rows += [("tiny", 1, 0.5)] * 5

    class Fixed(toxicity.Net):
        def logits(self, texts):
            return np.array([float(t) for t in texts]) + self.bias

    nets = [Fixed(None, {}, {}, None, 0.0) for _ in range(2)]
    toxicity.calibrate(nets[0], [(str(x), y, lang) for lang, y, x in rows])
    toxicity.calibrate_all(nets[1], make(rows, "lang string, y int, x double"))
    assert abs(nets[0].bias - nets[1].bias) < 0.05 and set(nets[0].thresholds) == set(nets[1].thresholds) == {"en", "fr", ""}
    assert all(abs(nets[0].thresholds[lang] - nets[1].thresholds[lang]) < 0.05 for lang in nets[0].thresholds)


def test_labelled_texts_are_all_there(make):
    documents = make([(1, "a", "en"), (1, "b", "en"), (2, None, None), (3, "c", "fr"), (None, "d", "en"), (4, "e", "en")], "doc_id long, text string, lang string")
    labels = make([(1, 1), (1, 1), (2, 0), (2, 1), (3, None), (4, 2), (None, 1)], "doc_id long, toxic int")
    found = sorted((r["text"], r["y"]) for r in labelled_texts(documents, labels, "toxic", F.lit(True), 4).collect())
    assert found == [("", 0), ("", 1), ("a", 1), ("b", 1)]


def test_mean_of_tasks_weighs_by_rows(spark):
    rows = spark.range(0, 40, 1, 4).where("id < 25").selectExpr("string(id) as text", "int(id % 2) as y")  # tasks of 10, 10, 5 and no rows
    state = np.arange(37, dtype=float)
    found = mean_of_tasks(rows, state, lambda start, examples: start + sum(len(y) for _, y in examples))
    assert np.allclose(found, state + (10 * 10 + 10 * 10 + 5 * 5) / 25)
    assert np.array_equal(mean_of_tasks(rows.limit(0), state, lambda start, examples: start + sum(len(y) for _, y in examples)), state)
    parts = list(groups(["a", "b" * 300_000, "c", "d"], np.array([0, 1, 2, 3]), 2, np.random.default_rng(0)))
    assert sorted((t[:1], y) for g, of in parts for t, y in zip(g, of.tolist(), strict=True)) == [(b"a", 0), (b"b", 1), (b"c", 2), (b"d", 3)]
    assert max(len(g) for g, _ in parts) <= 2
