import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from callytics.llm import near_duplicates as nd
from callytics.llm.words import WORD


def shingles(text, width=nd.SHINGLE):
    words = WORD.findall((text or "").lower())
    if not words:
        return Counter()
    return Counter(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute_classes(rows):
    """Least id of each row's class, by comparing all pairs."""
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    bags = [shingles(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if not bags[i] or not bags[j]:
                continue
            both = sum((bags[i] & bags[j]).values())
            if rows[i][1] == rows[j][1] or both >= 0.8 * sum((bags[i] | bags[j]).values()):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return Counter((doc, least.get(find(i)) if shingles(t) else doc) for i, (doc, t) in enumerate(rows))


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("xyz") + str(rng.randrange(400))
    passage = [word() for _ in range(60)]
    texts = []
    for k in range(25):
        base = [word() for _ in range(rng.choice([3, 8, 40, 150]))]
        if k % 5 == 0:  # a passage that many documents share
            base = base + passage
        for _ in range(rng.choice([1, 2, 3, 14])):
            copy = base[:]
            for _ in range(rng.choice([0, 0, 1, 2, len(copy) // 20])):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts += texts[:10] + ["Same words, HERE! and there", "same words here and there", "", None, "...", None, "", "one", "one"]
    texts += ["again and again " * 40, "again and again " * 44, "again and again " * 90]
    return [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "null id text"), (None, "null id text"), (None, texts[0])]


def test_classes_are_those_of_all_pairs(spark, docs):
    for seed in (1, 2):
        rows = corpus(seed)
        table = docs(rows).withColumn("k", F.lit(1)).withColumn("label", F.lit("x"))
        got = Counter((r["doc_id"], r["class_id"]) for r in nd.near_duplicates(table).collect())
        assert got == brute_classes(rows)


def test_large_buckets_keep_their_links(spark, docs):
    """Families that share most of a text, with near pairs inside, in buckets much larger than the neighbourhood."""
    rng = random.Random(5)
    shared = [f"s{i}" for i in range(60)]
    rows = []
    for k in range(80):
        own = [f"o{k}_{i}" for i in range(22)]
        rows.append((2 * k, " ".join(shared + own)))
        own[rng.randrange(22)] = "changed"
        rows.append((2 * k + 1, " ".join(shared + own)))
    got = {r["doc_id"]: r["class_id"] for r in nd.near_duplicates(docs(rows)).collect()}
    want = {doc: least for doc, least in brute_classes(rows)}
    assert got == want


def test_crowd_just_below_the_threshold(spark, docs):
    """Two thousand texts at 0.78 of each other, and pairs among them at 0.82 that no order of neighbours tells apart."""
    shared = [f"s{i}" for i in range(300)]
    rows = []
    for k in range(1_000):
        both = [f"b{k}x{i}" for i in range(10)]
        for side in (0, 1):
            rows.append((2 * k + side, " ".join(shared + both + [f"o{k}x{side}x{i}" for i in range(32)])))
    texts = dict(rows)
    assert 0.77 < similarity(texts[0], texts[2]) < 0.79 and 0.81 < similarity(texts[0], texts[1]) < 0.84
    got = {r["doc_id"]: r["class_id"] for r in nd.near_duplicates(docs(rows)).collect()}
    assert got == {d: d - d % 2 for d in texts}


def test_no_wrong_link_in_a_crowd(docs):
    """Two thousand texts of 200 words that share 178: none reaches 0.8 but for a collision of codes."""
    shared = [f"s{i}" for i in range(178)]
    rows = [(k, " ".join(shared + [f"o{k}x{i}" for i in range(22)])) for k in range(2_000)]
    assert 0.79 < similarity(rows[0][1], rows[1][1]) < 0.8
    assert all(r["class_id"] == r["doc_id"] for r in nd.near_duplicates(docs(rows)).collect())


def test_signatures_are_unbiased():
    rng = random.Random(3)
    base = [f"w{i}" for i in range(300)]
    texts = ["a b c d e " * 50, "a b c d e " * 60, "a b c d e " * 100, " ".join(base)]
    for n in (5, 15, 30, 60):
        words = base[:]
        for _ in range(n):
            words[rng.randrange(300)] = f"z{rng.random()}"
        texts.append(" ".join(words))
    size = 4_000
    signature = nd.signatures(*nd.bags(texts), len(texts), size)
    for i in range(len(texts)):
        for j in range(i):
            s = similarity(texts[i], texts[j])
            assert abs(np.mean(signature[i] == signature[j]) - s) < 5 * (s * (1 - s) / size) ** 0.5 + 1e-3


def test_one_of_each_class_stays(docs):
    rows = corpus(4)
    table = docs(rows).withColumn("class_id", F.lit("clash"))
    kept = nd.keep_one(table)
    assert kept.columns == table.columns
    classes = Counter()
    for (doc, least), n in brute_classes(rows).items():
        classes[(doc, least)] += n
    got = Counter(r["doc_id"] for r in kept.collect())
    with_words = [(d, t) for d, t in rows if shingles(t)]
    wordless = Counter(d for d, t in rows if not shingles(t))
    least_ids = {c for (_, c) in brute_classes(with_words) if c is not None}
    # Null ids whose class has no other id stay once for each class.
    assert got - wordless == Counter(least_ids) + Counter({None: 1})


def test_nothing(docs):
    assert nd.near_duplicates(docs([])).count() == 0
    assert nd.near_duplicates(docs([(1, None), (2, "")])).count() == 2
    assert nd.keep_one(docs([])).count() == 0
