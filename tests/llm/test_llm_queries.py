"""The registered queries over the smallest given tables against brute force."""

import hashlib
import html
import os
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest

import corpus_pipeline
from tablesense.llm import fingerprints
from tablesense.llm.queries import LLM_QUERIES
from test_mixing_tokens import targets
from test_near_dedup import brute

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the given tables are not here")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents():
    return pd.read_parquet(f"{SMALL}/documents.parquet").sort_values("doc_id")


def result(spark, name, key="doc_id"):
    return LLM_QUERIES[name](spark, SMALL).toPandas().sort_values(key)


@pytest.mark.parametrize(("name", "modulus", "rest"), [("op1_toxicity", 5, 0), ("op2_quality", 3, 1)])
def test_classifier_queries(spark, documents, name, modulus, rest):
    found = result(spark, name)
    assert found.doc_id.tolist() == documents.doc_id.tolist()
    assert found.held_out.tolist() == [zlib.crc32(str(i).encode()) % modulus == rest for i in documents.doc_id]
    assert found.score.between(0, 1).all() and (found.predicted == (found.score >= 0.5)).all()


def test_near_duplicates(spark, documents):
    found = result(spark, "op4_minhash_near_dedup")
    want = brute(list(zip(documents.doc_id, documents.text, strict=True)), 4, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.itertuples()} == want
    assert (found.kept == (found.doc_id == found.component_id)).all()


def test_mixing(spark, documents):
    found = result(spark, "op5_mixing")
    assert found["size"].tolist() == [len(WORD.findall(t or "")) for t in documents.text]
    want = targets(found.groupby("source")["size"].sum().to_dict())
    for source, rows in found.groupby("source"):
        assert abs(rows.target.iloc[0] - want[source]) < 1e-6 and abs(rows.taken.sum() - want[source]) <= 1
    assert (found.taken <= 3 * found["size"]).all()


def test_fingerprints(spark, documents):
    found = result(spark, "op6_fingerprints")
    texts = documents.text.fillna("").tolist()
    changed = [fingerprints.edited(a, b) for a, b in zip(texts, texts[1:] + texts[:1], strict=True)]
    assert found.edited_sha256.tolist() == [hashlib.sha256(t.encode()).hexdigest() for t in changed]
    assert found.fingerprint.tolist() == [fingerprints.fingerprint(t) for t in texts]


def test_decontamination(spark, documents):
    found = result(spark, "op8_decontamination")
    items = pd.read_parquet(f"{SMALL}/benchmark.parquet")
    exact = {(d, i) for d, t in zip(documents.doc_id, documents.text, strict=True) for i, x in zip(items.item_id, items.text, strict=True) if x in (t or "")}
    assert exact <= set(zip(found.doc_id, found.item_id, strict=True))


def test_tokens(spark, documents):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for t in documents.text]
    found = result(spark, "op9_token_output")
    sizes = np.array([len(x) for x in ids])
    assert found.n_tokens.tolist() == sizes.tolist() and found.start.tolist() == (np.cumsum(sizes) - sizes).tolist()
    assert found.ids_crc32.tolist() == [zlib.crc32(x.tobytes()) for x in ids]


def test_pages(spark):
    pages = pd.read_parquet(f"{SMALL}/pages.parquet").sort_values("page_id")
    found = result(spark, "op10_html_extraction", "page_id")

    def article(source):
        inside = re.search(r"<article>(.*?)</article>", source, re.DOTALL)[1].replace("<br>", " ")
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inside))
        return "\n".join(t for t in (" ".join(html.unescape(b).split()) for b in blocks) if t)

    assert found.text.tolist() == [article(s) for s in pages.html]
    assert found.n_chars.tolist() == [len(t) for t in found.text]


def test_pipeline_stages(spark, documents):
    stages = dict(corpus_pipeline.STAGES)
    assert [name for name, _ in corpus_pipeline.STAGES][-1] == "token output" and len(stages) == 5
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SMALL).toPandas(), docs.schema)
        kept[name] = docs.toPandas()
        assert list(kept[name].columns) == list(documents.columns)
    quality = kept["quality classifier"]
    labels = pd.read_parquet(f"{SMALL}/labels.parquet").set_index("doc_id").quality
    known = quality.doc_id[quality.doc_id.isin(labels.index)]
    assert len(known) >= 0.9 * labels.sum() and set(quality.doc_id) <= set(documents.doc_id)
    near = kept["near-duplicate removal"]
    want = brute(list(zip(quality.doc_id, quality.text, strict=True)), 5, 80)
    assert set(near.doc_id) == {d for d, (_, c) in want.items() if d == c}
    clean = kept["benchmark decontamination"]
    items = pd.read_parquet(f"{SMALL}/benchmark.parquet").text
    assert not any(x in t for t in clean.text for x in items) and len(clean) >= 0.8 * len(near)
    found = stages["token output"](spark, docs, SMALL).toPandas()
    assert sorted(found.doc_id) == sorted(kept["source mixing"].doc_id)
