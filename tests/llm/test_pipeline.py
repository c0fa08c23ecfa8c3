"""The registered queries over the smallest tables, and the pipeline against its stages in plain Python."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from __spark_entry__ import queries
from callytics.llm import language, queries as llm
from callytics.llm.common import table
from callytics.llm.tokens import default_tokenizer, encoder
from test_near_duplicates import brute_classes
from test_spellings import counted

FOLDER = "/root/testdata/sf0.001"


def test_registered():
    found = queries()
    assert [n for n in found if n.startswith("op")] == list(llm.QUERIES)
    assert found["pipeline"] is corpus_pipeline.run
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "packing"]


TABLES = {"page_id": "pages", "doc_id": "documents", "vec_id": "embeddings"}


@pytest.mark.parametrize("name", sorted(set(llm.QUERIES) - {"op11_spellings"}))
def test_query_covers_its_table(spark, name):
    out = queries()[name](spark, FOLDER)
    key = next(k for k in TABLES if k in out.columns)
    rows = table(spark, FOLDER, TABLES[key])
    ids = {r[0] for r in out.select(key).distinct().collect()}
    every = {r[0] for r in rows.select(key).collect()}
    assert ids == every if "decontamination" not in name else ids < every


def test_words_of_all_documents(spark):
    docs = [tuple(r) for r in table(spark, FOLDER, "documents").select("doc_id", "text").collect()]
    want = {w: n for w, n in counted(docs).items() if len(w) >= 5 and n >= 3}
    assert {r["word"]: r["n"] for r in queries()["op11_spellings"](spark, FOLDER).collect()} == want


def test_pipeline(spark):
    docs = [tuple(r) for r in table(spark, FOLDER, "documents").select("doc_id", "text").collect()]
    names, scores = language.scorer(language.train(table(spark, FOLDER, "documents")))([t for _, t in docs])
    kept = [d for d, n, s in zip(docs, names, scores) if n != "und" and s >= 0.4]
    assert len(kept) >= 0.97 * len(docs)
    classes = brute_classes(kept)
    first = {least for _, least in classes}
    kept = [d for d in kept if d[0] in first]
    items = [r["text"] for r in table(spark, FOLDER, "benchmark").collect()]
    clean = {d for d, t in kept if not any(i in t for i in items)}
    out = corpus_pipeline.run(spark, FOLDER).collect()
    got = {r["doc_id"] for r in out}
    assert got <= clean and len(got) >= 0.99 * len(clean)
    texts, encode = dict(kept), encoder(default_tokenizer())
    for r in out:
        ids = np.frombuffer(encode.ids(texts[r["doc_id"]]) + b"\0" * 4, "<u4")[r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(ids.tobytes()) == r["ids_crc32"]
