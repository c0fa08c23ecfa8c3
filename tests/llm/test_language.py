import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from callytics.llm import language

STEMS = {"aa": ["the", "ing", "tion", "wh"], "bb": ["eau", "oui", "que", "é"], "cc": ["sch", "ung", "ü", "keit"]}


def text(lang, rng, words):
    return " ".join("".join(rng.choices(STEMS[lang], k=rng.randrange(1, 4))) for _ in range(words))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    return [(i, text(lang, rng, rng.choice([2, 10, 80, 600])), lang) for i in range(400) for lang in [rng.choice(list(STEMS))]]


def test_held_out_accuracy(spark, docs, corpus):
    rows = corpus + [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 34 !!", "bb"), (None, corpus[0][1], "aa"), (1003, corpus[0][1], None)]
    rows.append((1000, corpus[1][1], "aa"))
    table = docs(rows).withColumn("score", F.lit("clash")).withColumn("held_out", F.lit(5))
    model = language.train(table)
    assert model.languages == ["aa", "bb", "cc"]
    out = language.predict(table, model).collect()
    assert len(out) == len(rows)
    truth = {i: lang for i, _, lang in corpus}
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert 40 < len(held) < 120
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out)
    plain = {r["doc_id"]: r for r in out if r["doc_id"] != 1000}
    assert [plain[i]["lang_pred"] for i in (1001, 1002)] == ["und", "und"]
    assert not plain[None]["held_out"]
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out if r["doc_id"] is not None)


def test_labels_of_held_out_documents_are_not_read(docs, corpus):
    swapped = [(i, t, "zz" if __import__("zlib").crc32(str(i).encode()) % 5 == 0 else lang) for i, t, lang in corpus]
    model = language.train(docs(swapped))
    assert "zz" not in model.languages
    again = language.train(docs(corpus))
    assert all((model.filters[w] == again.filters[w]).all() for w in language.WIDTHS)


def test_tables_give_the_responses_of_the_filters():
    rng = np.random.default_rng(2)
    w = {n: rng.normal(size=(n, 256, language.FILTERS)).astype(np.float32) for n in language.WIDTHS}
    features = language.FILTERS * len(w)
    model = language.Model(["x", "y"], w, rng.normal(size=features).astype(np.float32), rng.normal(size=(features, 2)).astype(np.float32), np.zeros(2, np.float32))
    data = rng.integers(0, 256, (3, language.WINDOW)).astype(np.uint8)
    reach = language.WINDOW - 3
    parts = [sum(f[k][data[:, k : k + reach]] for k in range(n)).max(axis=1) for n, f in w.items()]
    logits = np.maximum(np.concatenate(parts, axis=1) + model.offset, 0) @ model.weights
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    assert np.allclose(model.probabilities(data, model.tables()), e / e.sum(axis=1, keepdims=True), atol=1e-4)


def test_whole_texts_count(docs, corpus):
    """The later part of a text decides when it is longer."""
    rng = random.Random(3)
    model = language.train(docs(corpus))
    names, scores = language.scorer(model)([text("aa", rng, 200) + " " + text("bb", rng, 2_000), text("cc", rng, 5_000)])
    assert names == ["bb", "cc"] and scores[1] > 0.9


def test_keep_languages(docs, corpus):
    rows = corpus[:50] + [(1000, None), (1001, "  "), (1002, "7 7"), (1000, corpus[0][1], "aa")]
    table = docs(rows).withColumn("lang_pred", F.lit("clash"))
    kept = language.keep_languages(table, language.train(docs(corpus)))
    assert kept.columns == table.columns
    assert sorted(r["text"] for r in kept.collect()) == sorted(r[1] for r in corpus[:50] + [corpus[0]])


def test_numbers_and_signs_are_no_letters(docs, corpus):
    model = language.train(docs(corpus))
    table = docs([(1, "½ ² Ⅷ"), (2, "① ½"), (3, "ª"), (4, "日本")])
    assert [r["lang_pred"] == "und" for r in language.predict(table, model).orderBy("doc_id").collect()] == [True, True, False, False]
    assert [r["doc_id"] for r in language.keep_languages(table, None).orderBy("doc_id").collect()] == [3, 4]


def test_the_sample_is_bounded_for_repeated_rows(docs, corpus, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_DOCUMENTS", 10)
    rows = corpus[:100] + [corpus[0]] * 500 + [(corpus[0][0], f"{corpus[0][1]} {i}", corpus[0][2]) for i in range(500)]
    got = language.sample(docs(rows), F.lit(True), "doc_id", "text", "lang").groupBy("lang").count().collect()
    assert len(got) == 3 and all(r["count"] <= 10 * language.SAMPLE_WINDOWS for r in got)


def forward(model, text):
    """Plain probabilities of a whole text: every window, filter and place by itself."""
    data = text.lower().encode()
    total = np.zeros(len(model.languages))
    starts = range(0, len(data), language.WINDOW)
    for start in starts:
        window = data[start : start + language.WINDOW].ljust(language.WINDOW, b"\0")
        hidden = []
        for w in language.WIDTHS:
            for f in range(language.FILTERS):
                hidden.append(max(sum(float(model.filters[w][i, window[p + i], f]) for i in range(w)) for p in range(language.WINDOW - 3)))
        hidden = np.maximum(np.array(hidden) + model.offset, 0)
        logits = hidden @ model.weights + model.bias
        e = np.exp(logits - logits.max())
        total += e / e.sum()
    return total / len(starts)


def test_whole_documents_against_a_plain_forward_pass(docs, corpus):
    model = language.train(docs(corpus))
    texts = [t for _, t, _ in corpus[:5]] + ["x", "é " * 300]
    names, scores = language.scorer(model)(texts)
    for text_, name, score in zip(texts, names, scores):
        p = forward(model, text_)
        assert name == model.languages[p.argmax()] and abs(score - p.max()) < 1e-3


def test_without_labels_or_rows(docs):
    rows = docs([(1, "some words", None), (2, None, None)])
    model = language.train(rows)
    assert model is None
    assert [(r["lang_pred"], r["score"]) for r in language.predict(rows, model).collect()] == [("und", 0.0)] * 2
    assert [r["doc_id"] for r in language.keep_languages(rows, model).collect()] == [1]
    assert language.predict(docs([]), None).count() == 0
