import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from callytics.llm import gam, quality

LABELS = "doc_id long, quality int, toxic int"


def text(good, rng):
    words = ["".join(rng.choices("aeioustnrl", k=rng.randrange(2, 9))) for _ in range(rng.randrange(5, 300))]
    if good:
        return ". ".join(" ".join(words[i : i + 9]).capitalize() for i in range(0, len(words), 9)) + "."
    return rng.choice([lambda: " ".join(words[:3] * 60), lambda: " ".join(w.upper() + "!!" for w in words), lambda: " | ".join(words)])()


def corpus(seed, n):
    rng = random.Random(seed)
    truth = {i: int(rng.random() < 0.8) for i in range(n)}
    return truth, [(i, text(t, rng)) for i, t in truth.items()]


def test_held_out_accuracy_and_edge_cases(spark, docs):
    truth, rows = corpus(1, 900)
    rows += [(5000, None), (5001, ""), (None, "some words here."), (3, rows[3][1]), (5002, "word " * 300_000)]
    table = docs(rows).withColumns({"score": F.lit("x"), "label": F.lit(7), "key": F.lit(8), "place": F.lit(9), "quality": F.lit(4)})
    labels = spark.createDataFrame([(i, t, 0) for i, t in truth.items()] + [(None, 0, 0), (5, None, 0), (6, 9, 0)], LABELS)
    model = quality.train(table, labels.withColumn("text", F.lit("clash")))
    out = quality.score(table, model).collect()
    assert len(out) == len(rows) and out[0].asDict().keys() == {"doc_id", "held_out", "score", "predicted"}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    held = [r for r in out if r["held_out"]]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) == r["held_out"] for r in out if r["doc_id"] is not None)
    known = [r for r in held if r["doc_id"] in truth]
    assert len(known) > 200 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in known]) > 0.98
    by = {r["doc_id"]: r for r in out}
    assert by[5000]["score"] == by[5001]["score"] and by[5002]["predicted"] == 0 and not by[None]["held_out"]


def test_held_out_labels_and_other_columns_are_not_read(spark, docs):
    truth, rows = corpus(2, 300)
    labels = spark.createDataFrame([(i, t, 0) for i, t in truth.items()], LABELS)
    turned = spark.createDataFrame([(i, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t, 1) for i, t in truth.items()], LABELS)
    one = quality.train(docs(rows), labels)
    other = quality.train(docs(rows).withColumns({"lang": F.lit("zz"), "source": F.col("doc_id").cast("string")}), turned)
    assert one.offset == other.offset and one.pairs == other.pairs
    assert all((a == b).all() for a, b in zip(one.tables + one.pair_tables, other.tables + other.pair_tables))


def test_the_sample_is_bounded_for_repeated_ids(spark, docs, monkeypatch):
    seen = []
    fit = gam.fit
    monkeypatch.setattr(gam, "fit", lambda x, y, w: seen.append((len(y), float(w[y == 1].sum() / w.sum()))) or fit(x, y, w))
    rows = [(0, f"text number {i}") for i in range(500)] + [(3 * i, "different words") for i in range(1, 60)]
    labels = spark.createDataFrame([(0, 1, 0)] * 50 + [(3 * i, 0, 0) for i in range(1, 60)], LABELS)
    quality.train(docs(rows), labels, sample=20)
    n, share = seen[0]
    kept = sum(zlib.crc32(str(3 * i).encode()) % 3 != 1 for i in range(1, 60))
    assert n == 40 and abs(share - 1 / (kept + 1)) < 1e-9  # labels count by their share among different labelled ids


def test_without_labels_or_rows(spark, docs):
    none = spark.createDataFrame([], LABELS)
    model = quality.train(docs([(1, "words")]), none)
    assert [r["score"] for r in quality.score(docs([(1, "words"), (2, None)]), model).collect()] == [0.5, 0.5]
    assert quality.score(docs([]), model).count() == 0
    assert quality.train(docs([]), spark.createDataFrame([(1, 1, 0)], LABELS)).offset == 0
    single = quality.train(docs([(i, f"words {i}") for i in range(30)]), spark.createDataFrame([(i, 1, 0) for i in range(30)], LABELS))
    assert all(r["predicted"] == 1 for r in quality.score(docs([(1, "words")]), single).collect())


def model_of(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(np.int64)  # nothing on one feature alone
    return x, y, gam.fit(x, y, np.ones(len(x)))


def test_scores_are_sums_of_table_entries():
    x, _, model = model_of(1)
    def plain(row):
        total = model.offset
        for v, cuts, table in zip(row, model.cuts, model.tables):
            total += table[sum(v >= c for c in cuts)]
        for (j, k), table in zip(model.pairs, model.pair_tables):
            total += table[sum(row[j] >= c for c in model.pair_cuts[j]), sum(row[k] >= c for c in model.pair_cuts[k])]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(model.scores(x[:50]), [plain(r) for r in x[:50]], atol=1e-12)


def test_pairs_find_what_single_features_cannot():
    x, y, model = model_of(2)
    assert (1, 0) in model.pairs and np.mean((model.scores(x) >= 0.5) == y) > 0.95
    alone = gam.Model(model.offset, model.cuts, model.tables, [], model.pair_cuts, [])
    assert np.mean((alone.scores(x) >= 0.5) == y) < 0.8


def test_best_cut_by_trying_all():
    rng = np.random.default_rng(4)
    g, h = rng.normal(size=12), rng.uniform(0.5, 2, 12)
    part = lambda s: g[s].sum() ** 2 / (h[s].sum() + gam.DAMP)
    found = [(part(slice(0, i)) + part(slice(i, None)) - part(slice(None)), i) for i in range(1, 12)]
    better, at = gam.best_cut(g, h)
    assert at == max(found)[1] and abs(better - max(found)[0]) < 1e-12
    values = gam.tree(g, h)
    assert len(set(values.tolist())) <= 4


def test_features_of_known_texts():
    names = {n: v for n, v in zip(quality.FEATURES, quality.features("Aa aa aa. BB!!\n\nAa | 12"))}
    assert names["words"] == np.log1p(7) and names["repeated"] == 0 and names["no_letters"] == 1 / 7
    assert names["capital_words"] == 1 / 7 and names["lines"] == 2 / 23 and names["different_lines"] == 1
    assert quality.features(None) == quality.features("") and len(quality.features("x")) == len(quality.FEATURES)
    assert dict(zip(quality.FEATURES, quality.features("a a b b b")))["repeated"] == 3 / 5
