import random

from pyspark.sql import functions as F

from callytics.llm import decontamination as dc

ITEM = "A train leaves Berlin at 9 and covers 240 km before Anna boards it for the last part of the long way home."
OTHER = "Which of the following words is closest in meaning to the old word for a small boat on a lake?"
SHORT = "Name the seven hills of the old town now."


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("doc_id", F.lit(1))


def found(docs, spark, rows, benchmark=((1, ITEM), (2, OTHER), (3, SHORT))):
    table = docs(rows).withColumn("item_id", F.lit("clash"))
    return {(r["doc_id"], r["item_id"]): r for r in dc.contaminated(table, items(spark, list(benchmark))).collect()}


def noise(n, seed=0):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, 8))) for _ in range(n))


def test_copies_and_reparameterised_items(spark, docs):
    changed = ITEM.replace("Berlin", "Oslo").replace("Anna", "Peter").replace("240", "310").replace(" 9 ", " 7 ")
    torn = "Berlin likes Berlin and the way that Berlin has to be and to stay the same for all of us each day."
    rows = [
        (1, ITEM),
        (2, noise(50) + "\n" + ITEM + " " + noise(50, 1)),
        (3, noise(80) + ". " + changed),
        (4, ITEM.upper()),
        (5, noise(200, 3)),
        (6, "A train leaves Berlin at 9 and covers much."),
        (7, OTHER + "\n" + SHORT),
        (8, None),
        (9, ""),
        (10, noise(30, 4) + " " + OTHER[: OTHER.index("small")]),
        (11, SHORT.replace("seven", "many")),
        (11, "same id, other text"),
        (None, ITEM),
        (12, "Berlin likes Oslo and the way that Rome has to be and to stay the same for all of us each day."),
    ]
    got = found(docs, spark, rows, [(1, ITEM), (2, OTHER), (3, SHORT), (4, torn), (None, None), (6, "")])
    # Row 12 turns one name into two, but keeps 14 words in a row.
    assert set(got) == {(1, 1), (2, 1), (3, 1), (4, 1), (7, 2), (7, 3), (10, 2), (12, 4), (None, 1)}
    assert got[1, 1]["changed_slots"] == 0 and got[3, 1]["changed_slots"] == 4
    assert got[1, 1]["run_tokens"] <= got[1, 1]["item_tokens"]


def test_items_dense_with_slots_and_short_items(spark, docs):
    dense = "Compute 12 + 34 - 56 * 78"
    longer = "The bus calls at the stops 3 5 7 11 13 and then at none of the others on its way " + noise(40, 9)
    rows = [
        (1, noise(20) + ". " + dense + ". " + noise(20, 1)),
        (2, noise(20) + ". " + dense.replace("56", "57") + ". " + noise(20, 1)),
        (3, noise(20, 2) + " " + longer[: longer.index(" none")] + " " + noise(20, 3)),
        (4, noise(20, 4) + ". Define entropy briefly. " + noise(20, 5)),
        (5, noise(20, 4) + ". Define entropy twice. " + noise(20, 5)),
        (6, "Define entropy briefly"),
    ]
    got = found(docs, spark, rows, [(1, dense), (2, longer), (3, "Define entropy briefly.")])
    assert set(got) == {(1, 1), (3, 2), (4, 3), (6, 3)}
    assert got[4, 3]["item_tokens"] == got[4, 3]["run_tokens"] == 3 and got[1, 1]["item_tokens"] == 5


def test_one_torn_slot_leaves_the_rest(spark, docs):
    words = noise(60, 11).split()
    item = " ".join(words[:12] + ["10"] + words[12:45] + ["10"] + words[45:])
    short = "Mia has 5 apples and 5 pears to share."
    words = noise(60, 14).split()
    far = " ".join(words[:14] + ["3"] + words[14:30] + ["8"] + words[30:]) + " " + noise(150, 12) + " 3 " + noise(30, 13) + " 8"
    rows = [
        (1, noise(30) + " " + item[: item.rindex("10")] + "12" + item[item.rindex("10") + 2 :]),
        # The last value differs, far from the copied run.
        (3, noise(30) + " " + far[: far.rindex("8")] + "9"),
        (4, noise(30) + " " + short.replace("5", "7")),
    ]
    got = found(docs, spark, rows, [(1, item), (2, short), (3, far)])
    assert set(got) == {(1, 1), (3, 3), (4, 2)}


def test_equal_numbers_may_part_and_equal_names_may_not(spark, docs):
    fruit = "Mia has 5 apples and 5 pears and puts them into one small basket for the others to share at school."
    names = "So Berlin sends Paris a letter and so Berlin waits."
    rows = [
        (1, fruit.replace("5 pears", "9 pears").replace("5 apples", "7 apples")),
        (2, noise(20) + " so Berlin sends Paris"),
        (3, names.replace("so Berlin waits", "so Oslo waits")),
        (4, names.replace("Berlin", "Oslo")),
    ]
    got = found(docs, spark, rows, [(1, fruit), (2, names)])
    assert set(got) == {(1, 1), (4, 2)}


def test_against_plain_windows(spark, docs):
    """Without slots: a document is found if and only if it shares 13 words in a row, or most of an item."""
    rng = random.Random(7)
    word = lambda: "w" + "".join(rng.choices("abcdef", k=3))
    benchmark = [(i, " ".join(word() for _ in range(rng.choice([6, 12, 30])))) for i in range(20)]
    rows = []
    for d in range(150):
        words = [word() for _ in range(rng.randrange(60))]
        if rng.random() < 0.6:
            item = benchmark[rng.randrange(20)][1].split()
            n = rng.randrange(1, len(item) + 1)
            at = rng.randrange(len(item) - n + 1)
            words[10:10] = item[at : at + n]
        rows.append((d, " ".join(words)))
    want = set()
    for d, text in rows:
        words = text.split()
        for i, item in benchmark:
            item = item.split()
            for shift in range(-len(item), len(words)):
                same = [0 <= shift + j < len(words) and words[shift + j] == w for j, w in enumerate(item)]
                windows = [all(same[j : j + 5]) for j in range(len(item) - 4)]
                run = best = 0
                for w in windows:
                    run = run + 1 if w else 0
                    best = max(best, run)
                if best >= 9 or sum(windows) >= 0.8 * len(windows):
                    want.add((d, i))
    assert set(found(docs, spark, rows, benchmark)) == want


def test_clean_keeps_all_others_whole(spark, docs):
    rows = [(1, ITEM), (2, noise(40)), (2, noise(40)), (3, None), (None, noise(9)), (4, "")]
    table = docs(rows).withColumn("bad", F.lit(0))
    kept = dc.clean(table, items(spark, [(1, ITEM)]))
    assert kept.columns == table.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == sorted((d or 0, t or "") for d, t in rows[1:])


def test_rows_of_one_id_are_judged_by_their_texts(spark, docs):
    words = ITEM.split()
    halves = [" ".join(words[:11]), noise(7, 21) + " " + noise(4, 22) + " " + " ".join(words[11:])]
    rows = [(None, ITEM), (None, noise(20)), (None, noise(20, 1)), (7, OTHER), (7, noise(20, 2)), (7, None), (8, halves[0]), (8, halves[1])]
    kept = dc.clean(docs(rows), items(spark, [(1, ITEM), (2, OTHER)]))
    want = [r for r in rows if r[1] not in (ITEM, OTHER)]
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == sorted((d or 0, t or "") for d, t in want)


def test_nothing(spark, docs):
    assert dc.contaminated(docs([]), items(spark, [(1, ITEM)])).count() == 0
    assert dc.contaminated(docs([(1, ITEM)]), items(spark, [])).count() == 0
    assert dc.clean(docs([(1, ITEM)]), items(spark, [])).count() == 1


def test_canonical_tokens():
    h, plain, value, slot, counts = dc.canonical(["Tom met Anna. He ran 12km! Then 5 % more", "", None, "ALL CAPS Hello"])
    assert counts.tolist() == [11, 0, 0, 3]
    # Tom met Anna He ran 12 km Then 5 % more
    assert (slot > 0).tolist()[:11] == [False, False, True, False, False, True, True, False, True, True, False]
