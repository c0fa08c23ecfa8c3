import hashlib
import random
import re

from pyspark.sql import functions as F

from callytics.llm import fingerprints as fp


def paragraphs(text):
    found = re.findall(fp.PARAGRAPH, text or "")
    assert "".join(found) == (text or "")
    return set(found)


def likeness(a, b):
    a, b = paragraphs(a), paragraphs(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def corpus():
    rng = random.Random(1)
    line = lambda: " ".join("".join(rng.choices("abcdef", k=4)) for _ in range(rng.randrange(1, 12)))
    rows = [(i * 3, "".join(line() + rng.choice([". ", "\n", "!? ", " "]) for _ in range(rng.choice([1, 2, 8, 40])))) for i in range(60)]
    rows += [(1000, "x" * 5_000), (1001, ""), (1002, None), (1003, "é😀" * 301), (1004, rows[4][1]), (1005, "\n".join(line() for _ in range(1_500)))]
    rows += [(7, "one more"), (7, "and its like"), (-5, "negative id."), (None, "null id. Two."), (None, "null id again and longer")]
    return rows


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    return order


def test_edited_texts_and_likeness(spark, docs):
    rows = corpus()
    table = docs(rows).withColumn("next_text", F.lit("clash")).withColumn("part", F.lit(1))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    pairs = fp.with_next(table).collect()
    assert len(pairs) == len(rows)
    texts = sorted((t or "") for _, t in rows)
    assert sorted(r["text"] for r in pairs) == texts and sorted(r["next_text"] for r in pairs) == texts
    order = expected(rows)
    after = {}
    for i, (doc, _) in enumerate(order):
        after.setdefault(doc, set()).add(order[(i + 1) % len(order)][0])
    by_text = {}
    for doc, t in rows:
        by_text.setdefault(t or "", set()).add(doc)
    for r in pairs:
        assert by_text[r["next_text"]] & after[r["doc_id"]]
    out = fp.edited_fingerprints(table).collect()
    follows = {(r["doc_id"], len(r["text"])): r for r in pairs}
    prints = {}
    for r in out:
        p = follows[r["doc_id"], r["n_chars"]]
        half = len(p["text"]) // 2
        edited = p["text"][: len(p["text"]) - half] + p["next_text"][:half]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r["near_edited"] - likeness(p["text"], edited)) < 1e-12
        assert abs(r["near_next"] - likeness(p["text"], p["next_text"])) < 1e-12
        for text, found in ((p["text"], r["fingerprint"]), (edited, r["edited_fingerprint"])):
            assert prints.setdefault(text, found) == found
    assert len(set(prints.values())) > 0.9 * len(prints)


def differences(spark, a, b):
    texts = fp.fingerprint(spark.createDataFrame([(a, b)], "text string, b string"))
    rows = fp.compare(fp.fingerprint(texts, "b", "other"), "own", "other")
    r = rows.withColumns({f"h_{n}": F.expr(fp.keys_of(n)) for n in ("text", "b")}).first()
    return {(d["k"], d["s"]) for d in r["other_diff"]}, set(r["h_text"]), set(r["h_b"])


def test_peeling_recovers_the_differing_digests(spark):
    rng = random.Random(2)
    lines = [f"line {rng.random()}\n" for _ in range(700)]
    for changed in (0, 1, 3, 12, 60, 400, 700):
        other = lines[:]
        for i in rng.sample(range(700), changed):
            other[i] = f"other {rng.random()}\n"
        found, a, b = differences(spark, "".join(lines), "".join(other))
        assert found == {(k, 1) for k in a - b} | {(k, -1) for k in b - a}


def test_small_sketch_fails_and_is_known_to_fail(spark):
    keys = "transform(sequence(1, {n}), i -> xxhash64(i))"
    for n, done in ((4, True), (60, False)):
        row = spark.range(1).withColumn("keys", F.expr(keys.format(n=n))).withColumn("none", F.expr("slice(keys, 1, 0)"))
        z = row.select(F.expr(fp.peel(fp.subtract(fp.sketch("keys"), fp.sketch("none")))).alias("z")).first()["z"]
        assert z["done"] is done
        if done:
            assert len(z["found"]) == n


def test_one_and_no_document(docs):
    out = fp.edited_fingerprints(docs([(1, "Only one. Here")])).collect()
    assert len(out) == 1 and out[0]["near_next"] == 1.0
    assert fp.edited_fingerprints(docs([])).count() == 0
