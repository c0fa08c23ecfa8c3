import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from callytics.llm import packing, token_counts, token_files
from callytics.llm.common import new_folder, stored
from callytics.llm.tokens import SAFE_CUT, SEGMENT, default_tokenizer, encoder

ODD = [
    "",
    None,
    " ",
    "\n\n",
    "a",
    "don't stop, it's 3.5km!  two  blanks\n\n\ttab\r\n end ",
    "no\xa0break \x1c odd\x85 spaces  here　 x",
    "<|endoftext|> is text <|endoftext|>",
    "x" * 5_000,
    "été 日本語 テスト 😀😀 ñandú " * 50,
    " ".join(f"word{i}" for i in range(3_000)),
]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_tokenizer())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def as_ids(data):
    return np.frombuffer(data, "<u4").tolist()


def test_segments_give_the_ids_of_whole_texts(plain):
    encode = encoder(default_tokenizer())
    rng = random.Random(1)
    alphabet = ["a", "B", "é", "7", ".", "!", "'s", "'", ",", "_", "²", " ", "\n", "\t", "\xa0", "\x1c", " ", "😀"]
    alphabet += ["word", "Wort", "ß", "×", "ŋ", "日本", "|", "<|endoftext|>", "<|endof", "text|>", "\r\n", " ", " "]
    texts = ODD + ["".join(rng.choices(alphabet, k=rng.randrange(40))) for _ in range(3_000)]
    for text in texts:
        assert as_ids(encode.ids(text)) == plain(text)
        assert "".join(SEGMENT.findall(text or "")) == (text or "")
        for cut in SAFE_CUT.finditer((text or "")[:300]):
            assert plain(text[: cut.start()]) + plain(text[cut.start() :]) == plain(text)


@pytest.mark.parametrize("begin", ["one ", " ", "\n"])
def test_words_with_marks_and_of_new_lines_are_learned_in_few_calls(plain, begin):
    from callytics.llm.tokens import Encoder

    class Counted:
        calls = 0

        def __init__(self, tokenizer):
            self.tokenizer = tokenizer

        def encode(self, *args, **options):
            Counted.calls += 1
            return self.tokenizer.encode(*args, **options)

    encode = Encoder(default_tokenizer())
    encode.tokenizer = Counted(encode.tokenizer)
    words = ["".join(random.Random(n).choices("abcdeé", k=9)) for n in range(60)]
    text = begin + " ".join(f"{w}&&& {w.title()}{w}, {w}.\n{w.title()}é!!" for w in words)
    assert as_ids(encode.ids(text)) == plain(text)
    assert Counted.calls <= 8


def test_batches_give_the_ids_of_whole_texts(plain, monkeypatch):
    from callytics.llm import tokens

    encode = tokens.Encoder(default_tokenizer())
    rng = random.Random(4)
    parts = ["a", "B", "é", "ÿ", "ɏ", "ɐ", "×", "²", "7", "42", ".", "!", "?!", "'s", "'", ",", "_", "-", "(", "|", " ", " ", " ", "  "]
    parts += ["\n", "\n\n", "\r\n", "\t", "\xa0", "\x85", "\x1c", "\x0b", "\x7f", "\u2003", "\u2028", "\u3000", "\u1680", "\u205f", "\u200b"]
    parts += ["word", "Wort", "ß", "日本", "т", "р", "😀", "’", "ＡＢ", "e\u0301", "<|endoftext|>", "<|endof", "text|>", "x" * 70, "٣"]
    texts = ODD + ["".join(rng.choices(parts, k=rng.randrange(40))) for _ in range(4_000)] + ["<|endof", "text|>"]
    want = [plain(t) for t in texts]
    column = tokens.pa.array(texts)
    for _ in range(2):  # unknown and known
        assert [as_ids(ids) for ids in encode.batch(column)] == want
    assert [as_ids(ids) for ids in encode.batch(column.slice(5, 40))] == want[5:45]
    assert encode.batch(column.slice(0, 0)) == [] and encode.batch(tokens.pa.array([None, None], "string")) == [b"", b""]
    # Texts longer than a chunk, memories that overflow.
    monkeypatch.setattr(tokens, "CHUNK", 97)
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    assert [as_ids(ids) for ids in encode.batch(column)] == want


def test_a_batch_needs_no_call_for_each_text_or_word(plain):
    from callytics.llm import tokens

    class Counted:
        calls = 0

        def __init__(self, tokenizer):
            self.tokenizer = tokenizer

        def encode(self, *args, **options):
            Counted.calls += 1
            return self.tokenizer.encode(*args, **options)

    encode = tokens.Encoder(default_tokenizer())
    encode.tokenizer = Counted(encode.tokenizer)
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdeé", k=9))
    texts = [f"{word()} {word()}, {word()}.\n{word().title()} ({word()}) 12-{word()}!" for _ in range(500)]
    assert [as_ids(ids) for ids in encode.batch(tokens.pa.array(texts))] == list(map(plain, texts))
    assert Counted.calls <= 8


@pytest.mark.parametrize("lower", [False, True])
def test_batches_with_other_tokenizers(tmp_path, lower):
    from tokenizers import Tokenizer, normalizers

    from callytics.llm import tokens

    other = Tokenizer.from_file(default_tokenizer())
    other.add_tokens(["STOP"])
    if lower:
        other.normalizer = normalizers.Lowercase()
    other.save(path := str(tmp_path / "other.json"))
    texts = ["Some STOP words", "STOP", "no STOPPED", "Ends ST", "OP begins", "", None, "Some words", "STO", "P"] * 2
    encode = tokens.Encoder(path)
    for column in (texts, texts[3:4] + texts, texts[:3]):
        want = [other.encode(t or "", add_special_tokens=False).ids for t in column]
        assert [as_ids(ids) for ids in encode.batch(tokens.pa.array(column))] == want


def test_larger_batches_keep_all_rows(monkeypatch):
    from callytics.llm import tokens

    monkeypatch.setattr(tokens, "CHUNK", 100)
    batches = [tokens.pa.RecordBatch.from_pydict({"n": list(range(k, k + 5))}) for k in range(0, 50, 5)]
    out = list(tokens.larger(iter(batches)))
    assert [n for b in out for n in b.column(0).to_pylist()] == list(range(50)) and len(out) < 10
    assert list(tokens.larger(iter([]))) == []


def test_packing(spark, docs, plain):
    rng = random.Random(2)
    rows = list(enumerate(ODD + [" ".join(rng.choices(["the", "of", "xylo", "été"], k=rng.randrange(1, 120))) for _ in range(300)]))
    rows += [rows[3], (None, "null id"), (None, None)]
    size = 256
    out = packing.pack_documents(docs(rows).withColumn("rank", F.lit("x")).withColumn("length", F.lit(1)), size).collect()
    wanted = defaultdict(list)
    for doc, text in rows:
        wanted[doc].append(plain(text) + [0])
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == set(wanted)
    for doc, texts in wanted.items():
        got = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces[doc])
        want = []
        for ids in texts:
            at = 0
            first = len(ids) % size or size
            for k in range(-(-len(ids) // size)):
                n = first if k == 0 else size
                want.append((k, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())))
                at += n
        assert got == sorted(want)
    for rows_ in sequences.values():
        at = 0
        for r in sorted(rows_, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
    total = sum(r["length"] for r in out)
    assert len(sequences) <= 1.02 * total / size + 2


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_each_piece_once(seed):
    rng = random.Random(seed)
    size = 128
    histogram = defaultdict(int)
    for _ in range(2_000):
        histogram[rng.choice([rng.randrange(1, size + 1), rng.randrange(30, 60), 65])] += 1
    plan = packing.make_plan(histogram, size, groups=16)
    fill, ranks = defaultdict(list), defaultdict(list)
    for p in plan.itertuples():
        for i in range(p.count):
            ranks[p.length].append(p.rank + i)
            fill[p.sequence + i].append((p.offset, p.length))
    assert {s: len(r) for s, r in ranks.items()} == dict(histogram)
    assert all(sorted(r) == list(range(len(r))) for r in ranks.values())
    for places in fill.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    least = sum(s * n for s, n in histogram.items()) / size
    over_half = sum(n for s, n in histogram.items() if 2 * s > size)
    assert len(fill) <= 1.06 * max(least, over_half) + 1


def test_configurations_reach_the_optimum():
    # 44 pieces of 44 and 26 pieces of 30 in sequences of 104: (1, 2) fills best.
    found = packing.configurations([44, 30], [44, 88], 104)
    assert sum(n for _, n in found) == pytest.approx(44)


def test_packing_of_nothing(docs):
    assert packing.pack_documents(docs([])).count() == 0


def test_token_files(spark, docs, plain):
    rows = [(i * 7 % 97, t) for i, t in enumerate(ODD * 4)] + [(5, "same id"), (5, "same id"), (None, "null id")]
    folder = new_folder(spark, "tokens")
    token_files.write_tokens(docs(rows).withColumn("start", F.lit(1)).withColumn("n_tokens", F.lit("x")), folder)
    back = token_files.read_tokens(spark, folder)
    got = sorted(back.collect(), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) // 4
        at += r["n_tokens"]
    want = sorted((-1 if d is None else d, plain(t) + [2]) for d, t in rows)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], as_ids(r["ids"])) for r in got) == want
    some = token_files.read_tokens(spark, folder, ids=[5, 14]).collect()
    assert sorted((r["doc_id"], r["start"]) for r in some) == sorted((r["doc_id"], r["start"]) for r in got if r["doc_id"] in (5, 14))
    sums = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in token_files.checksums(back).collect()}
    assert sums == {(r["doc_id"], r["start"]): zlib.crc32(r["ids"]) for r in got}


def test_token_files_of_nothing(spark, docs):
    folder = new_folder(spark, "tokens")
    token_files.write_tokens(docs([]), folder)
    assert token_files.read_tokens(spark, folder).count() == 0


def test_trees_follow_edits(plain):
    encode = encoder(default_tokenizer())
    rng = random.Random(3)
    words = ["the ", "of", " ", "\n", "xylo", "été", "!", "\xa0", "don't "]
    for text in ["", " ", "x" * 300, "".join(rng.choices(words, k=600))]:
        tree = token_counts.Tree.build([(len(p), encode.count(p)) for p in token_counts.leaves_of(text, 20)])
        for _ in range(60):
            start, remove = rng.randrange(len(text) + 3), rng.choice([0, 0, 1, 5, 100])
            insert = "".join(rng.choices(words, k=rng.choice([0, 1, 3, 40])))
            new, tree, encoded = token_counts.edit(text, tree, start, remove, insert, encode, 20)
            assert new == text[:start] + insert + text[start + remove :]
            assert (tree.chars[1], tree.tokens[1]) == (len(new), len(plain(new)))
            text = new


def test_an_edit_encodes_its_surroundings_only():
    encode = encoder(default_tokenizer())
    text = "some words of a text " * 5_000
    tree = token_counts.Tree.build([(len(p), encode.count(p)) for p in token_counts.leaves_of(text)])
    new, tree, encoded = token_counts.edit(text, tree, 50_000, 10, "other words", encode)
    assert encoded < 2_000 and tree.tokens[1] == encode.count(new)


def test_token_counts(spark, docs, plain):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "null id")]
    table = docs(rows).withColumn("chars", F.lit("clash")).withColumn("edits", F.lit(0))
    edits = spark.createDataFrame(
        [(5, 1, 3, 4, "new words"), (5, 0, 0, 0, "first "), (9, 0, 10, 200, None), (10, 0, 99_999, 1, " end"), (77, 0, 0, 0, "x"), (4, 0, None, None, "b")],
        "doc_id long, seq long, start long, remove long, insert string",
    )
    trees = token_counts.build_trees(table)
    out = {r["doc_id"]: r for r in token_counts.apply_edits(token_counts.with_edits(trees, edits)).collect()}
    assert set(out) == {*range(len(ODD)), None}
    text = ODD[5]
    text = "first " + text
    text = text[:3] + "new words" + text[7:]
    assert out[5]["text"] == text
    assert out[9]["text"] == ODD[9][:10] + ODD[9][210:]
    assert out[10]["text"] == ODD[10] + " end"
    assert out[4]["text"] == "ba"
    for doc, before in rows:
        r = out[doc]
        assert r["n_tokens"] == len(plain(before)) and r["edited_tokens"] == len(plain(r["text"]))
        assert r["edited_chars"] == len(r["text"])
    assert out[0]["encoded_chars"] == 0
    assert token_counts.build_trees(docs([])).count() == 0


@pytest.mark.parametrize("chunk, few", [(8 << 20, 8 << 10), (8 << 20, 0), (97, 0), (97, 50)])
def test_counts_are_those_of_whole_texts(plain, monkeypatch, chunk, few):
    from callytics.llm import tokens

    monkeypatch.setattr(tokens, "CHUNK", chunk)
    monkeypatch.setattr(tokens, "FEW", few)
    encode = tokens.Encoder(default_tokenizer())
    rng = random.Random(6)
    parts = ["a", "é", "7", ".", "!", "'s", "'", ",", "_", " ", " ", "\n", "\r\n", "\t", "\xa0", "\x1c", " ", "日本", "😀", "word"]
    parts += ["<|endoftext|>", "<|endof", "text|>", "x" * 70]
    texts = [t or "" for t in ODD] + ["".join(rng.choices(parts, k=rng.randrange(40))) for _ in range(1_000)]
    want = [len(plain(t)) for t in texts]
    for _ in range(2):  # unknown and known
        assert list(encode.counts(texts)) == want
    assert [n for t in texts for n in encode.counts([t])] == want
    assert list(encode.counts([])) == []


def test_trees_and_edits_need_no_call_for_each_document(spark, docs, plain, monkeypatch):
    from callytics.llm import common, tokens

    class Counted:
        calls = 0

        def __init__(self, tokenizer):
            self.tokenizer = tokenizer

        def encode(self, *args, **options):
            Counted.calls += 1
            return self.tokenizer.encode(*args, **options)

    class Counting(tokens.Encoder):
        def __init__(self, path):
            super().__init__(path)
            self.tokenizer = Counted(self.tokenizer)

    # The functions that Spark's workers run, here in this process.
    runs = []
    rows = docs([(1, "")])
    monkeypatch.setattr(type(rows), "mapInArrow", lambda df, run, schema, *args, **options: runs.append(run) or df)
    monkeypatch.setattr(tokens, "Encoder", Counting)
    monkeypatch.setattr(common, "_memory", {})
    token_counts.build_trees(rows.select("doc_id", "text"))
    trees = rows.withColumns({"chars": F.array(F.lit(1)), "tokens": F.array(F.lit(1)), "edits": F.expr(f"cast(null as {token_counts.EDITS})")})
    token_counts.apply_edits(trees)
    build, apply = runs
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdeé", k=9))
    texts = [" ".join(word() for _ in range(70)) for _ in range(200)] + ["", None]
    batch = tokens.pa.RecordBatch.from_pydict({"doc_id": range(len(texts)), "text": texts})
    edits = [[{"seq": k, "start": 20 * k, "remove": 5, "insert": f"{word()} {word()}"} for k in range(i % 4)] for i in range(len(texts))]
    (built,) = build(iter([batch]))
    columns = [built.column(c) for c in ("doc_id", "text", "chars", "tokens")]
    (out,) = apply(iter([tokens.pa.RecordBatch.from_arrays([*columns, tokens.pa.array(edits)], ["doc_id", "text", "chars", "tokens", "edits"])]))
    out = out.to_pylist()
    assert [r["doc_id"] for r in out] == list(range(len(texts)))
    for text, some, r in zip(texts, edits, out):
        new = text or ""
        for e in some:
            new = new[: e["start"]] + e["insert"] + new[e["start"] + 5 :]
        assert (r["text"], r["n_tokens"], r["edited_chars"], r["edited_tokens"]) == (new, len(plain(text)), len(new), len(plain(new)))
    assert Counted.calls <= 8


def test_regions_grow_and_shrink_alike_alone_and_together(plain):
    encode = encoder(default_tokenizer())
    rng = random.Random(8)
    words = ["the ", "of", " ", "\n", "xylo", "été", "!", "don't "]
    texts = ["", " ", "x" * 300] + ["".join(rng.choices(words, k=n)) for n in (3, 100, 600)]
    edits = [
        [(rng.randrange(1_500), rng.choice([0, 5, 300]), "".join(rng.choices(words, k=rng.choice([0, 3, 90])))) for _ in range(n)]
        for n in (3, 0, 40, 20, 7, 40)
    ]
    together = token_counts.edit_all(texts, token_counts.trees_of(texts, encode, 20), edits, encode, 20)
    for text, some, (new, tree, encoded) in zip(texts, edits, together):
        alone, n = token_counts.trees_of([text], encode, 20)[0], 0
        for e in some:
            text, alone, m = token_counts.edit(text, alone, *e, encode, 20)
            n += m
        assert (new, encoded, tree.chars, tree.tokens) == (text, n, alone.chars, alone.tokens)
        assert (tree.chars[1], tree.tokens[1]) == (len(new), len(plain(new)))
