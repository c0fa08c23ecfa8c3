import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from callytics.llm import spellings


def counted(rows):
    total = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
            if h % 97 == 0:
                place = h % len(word)
                word = word[:place] + word[place + 1 :]
            total[word] += 1
    return total


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(rows, least_length=5, least_count=3):
    """All pairs of words compared."""
    n = {w: k for w, k in counted(rows).items() if len(w) >= least_length and k >= least_count}
    near = {w: [v for v in n if one_edit(v, w)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def found(df):
    return [(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()]


def corpus(seed, count, letters="abcé"):
    rng = random.Random(seed)
    stems = ["".join(rng.choices(letters, k=rng.randrange(4, 9))) for _ in range(60)]

    def word():
        w = list(rng.choice(stems))
        if rng.random() < 0.15:
            w[rng.randrange(len(w))] = rng.choice(letters)
        if rng.random() < 0.1:
            w.insert(rng.randrange(len(w) + 1), rng.choice(letters))
        return "".join(w).title() if rng.random() < 0.1 else "".join(w)

    return [(i, rng.choice([" ", ", ", "-", "\n", "1", "’", "ā", "×"]).join(word() for _ in range(rng.randrange(1, 80)))) for i in range(count)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_all_pairs(spark, docs, seed):
    rows = corpus(seed, 300)
    out = found(spellings.variants(docs(rows)))
    assert len(out) > 150 and any(r[1] for r in out)
    assert len(set(out)) == len(out) and set(out) == brute(rows)


def test_tiles_and_chunks_find_the_same_pairs(spark, monkeypatch):
    rng = random.Random(5)
    words = sorted({"".join(rng.choices("ab", k=rng.randrange(5, 12))) for _ in range(1500)})
    n = {w: rng.randrange(3, 50) for w in words}
    table = spark.createDataFrame(list(n.items()), "word string, n long")
    want = {}
    for w in words:
        near = [v for v in words if one_edit(v, w)]
        if near:
            best = min(near, key=lambda v: (-n[v], v))
            want[w] = (len(near), best, n[best])
    for tile in (spellings.TILE, 7):
        rows = spellings.near_words(table, tile=tile).collect()
        assert len(rows) == len(want) and {r["word"]: tuple(r[1:]) for r in rows} == want


def test_every_place_of_an_edit(spark):
    words = ["straßenbahn"]
    base = words[0]
    for i in range(len(base) + 1):
        words += [base[:i] + "z" + base[i:], base[: i - 1] + base[i:] if i else "q" + base[1:], base[: i - 1] + "y" + base[i:] if i else base + "w"]
    words = list(dict.fromkeys(words))
    table = spark.createDataFrame([(w, 9 if w == base else 3) for w in words], "word string, n long")
    out = {r["word"]: r["n_near"] for r in spellings.near_words(table).collect()}
    assert out == {w: sum(one_edit(w, v) for v in words) for w in words}


def test_long_words(spark):
    long = "ab" * 3_000
    words = [long, long + "c", long[:2_000] + "x" + long[2_001:], long[1:], long[:4_000] + "yy" + long[4_002:], "short", "shore"]
    table = spark.createDataFrame([(w, 3 + i) for i, w in enumerate(words)], "word string, n long")
    out = {r["word"]: (r["n_near"], r["form"]) for r in spellings.near_words(table).collect()}
    assert out == {long: (3, long[1:]), long + "c": (1, long), words[2]: (1, long), long[1:]: (1, long), "short": (1, "shore"), "shore": (1, "short")}


def test_nulls_ties_repeats_and_clashing_names(spark, docs):
    rows = [(1, "Colour COLOUR colour"), (1, "Colour COLOUR colour"), (None, "color color colxr colxr colxr color"), (2, None), (3, ""), (4, "12 ā ’")]
    rows += [(5, "colour " * 10 + "cölour " * 4 + "colourÀ " * 4)]
    table = docs(rows).withColumns({"word": F.lit("x"), "n": F.lit("y"), "form": F.lit(1)})
    assert set(found(spellings.variants(table))) == brute(rows)
    assert found(spellings.variants(docs([]))) == []
    assert found(spellings.variants(docs([(1, None)]))) == []


def test_a_chain_of_forms_ends_at_its_root(spark):
    chain = ["aaaaa" + "b" * k for k in range(20)]
    forms = spark.createDataFrame([(w, chain[k + 1] if k < 19 else None) for k, w in enumerate(chain)], "word string, form string")
    assert {r["root"] for r in spellings.roots(forms).collect()} == {chain[-1]}


def test_undamaged_words(docs):
    counts = spellings.word_counts(docs([(i, "Same Words") for i in range(300)]), damaged=None).collect()
    assert {(r["word"], r["n"]) for r in counts} == {("same", 300), ("words", 300)}
