"""Spelling variants: words of a corpus that differ by one inserted, deleted or replaced code point, and their roots.

Words are counted over whole texts, each task on its own first. Near words are found by blocked Gram matrices. A block
holds words of m and of m + 1 code points: the two lengths that one edit joins. Blocks of a length are cut further
without losing a pair: m places are divided into four segments, and the first place where two near words differ lies
in one of them, so they agree in all code points left of that segment and right of it. A word thus stands in four
blocks of its own length and four of the next shorter one, and every pair meets in exactly one of the blocks, the one
of its segment. In a block the product of the matrix of letter counts with itself gives all squared distances: one edit
moves the counts by one (inserted, deleted) or two (replaced). Pairs at two or less are verified on the code points.

Blocks of more than TILE words are cut into tiles that meet two by two, so no task holds more than two tiles.

Nulls and edge cases: a null text has no words, a null id counts as the empty text. Equal ids and repeated rows all
count. Texts and words may be of any length. Empty tables give empty results.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from callytics.llm.common import partitions_of, short_batches, stored

#: One of so many pairs (document, word) loses a code point.
DAMAGED = 97
LEAST_LENGTH = 5
LEAST_COUNT = 3
#: Different words that a task counts before it hands on what it has.
HELD = 300_000
#: Words of a tile at most, and its code points.
TILE = 1_000
TILE_CELLS = 1 << 20
#: Small blocks share a matrix of at most so many words, and code points.
CHUNK = 256
SEGMENTS = 4

#: Of the Latin-1 characters, letters in lower case (A to Z alone change), all others blank.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def runs(text: str) -> list[bytes]:
    """The runs of letters of a text, in lower case, as UTF-8. Characters beyond Latin-1 aren't letters here."""
    return text.encode("latin-1", "replace").translate(LETTERS).decode("latin-1").encode().split()


def damage(word: bytes, hashed: int) -> bytes:
    """The word without its code point at hashed modulo its length."""
    letters = word.decode()
    place = hashed % len(letters)
    return (letters[:place] + letters[place + 1 :]).encode()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damaged: int | None = DAMAGED) -> DataFrame:
    """word, n: the occurrences of each word in all texts, words of one out of `damaged` documents and words damaged first
    (see `damage`; the crc32 of "id:word" decides). With None all words stay as they are."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            found = {w: n for w, n in total.items() if w and n}
            total.clear()
            words = pa.array(found.keys(), pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(found.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = runs(text)
                total.update(words)
                if damaged is None:
                    continue
                seed = zlib.crc32(f"{key}:".encode())
                hit = {word: hashed for word in set(words) if (hashed := zlib.crc32(word, seed)) % damaged == 0}
                for word, n in Counter(filter(hit.__contains__, words)).items() if hit else ():
                    total[word] -= n
                    total[damage(word, hit[word])] += n
                if len(total) > HELD:
                    yield out()
        yield out()

    texts = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col).cast("string").alias("text"))
    return texts.filter("text is not null").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def placed(words: DataFrame) -> DataFrame:
    """Each word in its blocks: key, m (places), low and high (ends of the segment that may differ), word, n."""
    own = F.char_length("word")
    one = words.select("word", "n", F.explode(F.array(own, own - 1)).alias("m"), own.alias("length")).filter("m > 0")
    half = F.floor(F.col("m") / 2).cast("int")
    ends = [F.lit(0), F.floor(half / 2).cast("int"), half, half + F.floor((F.col("m") - half) / 2).cast("int"), F.col("m")]
    segment = lambda i: F.struct(ends[i].alias("low"), ends[i + 1].alias("high"))
    rows = one.select("word", "n", "m", "length", F.explode(F.array(*(segment(i) for i in range(SEGMENTS)))).alias("s"))
    rows = rows.select("word", "n", "m", "length", "s.low", "s.high").filter("low < high")
    left = F.substring("word", F.lit(1), F.col("low"))
    right = F.substring("word", F.col("length") - F.col("m") + F.col("high") + 1, F.col("length"))
    return rows.select(F.xxhash64("m", "low", left, right).alias("key"), "m", "low", "high", "word", "n")


def near_in(words: list[str], n: np.ndarray, m: np.ndarray, low: np.ndarray, high: np.ndarray, block: np.ndarray, tile: np.ndarray, apart: np.ndarray):
    """Pairs (i, j) of near words, i < j, whose first difference lies in their segment.

    Words of one `block` are compared, those of `apart` blocks only with words of another `tile`.
    """
    count = len(words)
    lengths = np.fromiter(map(len, words), np.int64, count)
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    at_word = np.repeat(np.arange(count), lengths)
    begin = np.cumsum(lengths) - lengths
    at_place = np.arange(len(codes)) - begin[at_word]
    letters, letter = np.unique(codes, return_inverse=True)
    counts = np.bincount(at_word * len(letters) + letter, minlength=count * len(letters)).reshape(count, -1).astype(np.float32)
    # The Gram matrix, and squared distances from it; counts are small, so float32 is exact.
    norm = np.einsum("ij,ij->i", counts, counts)
    close = norm[:, None] + norm[None, :] - 2 * (counts @ counts.T) <= 2
    close &= block[:, None] == block[None, :]
    i, j = np.nonzero(np.triu(close, 1))
    # Of the two lengths m and m + 1 at least one word has m.
    fits = (m[i] == m[j]) & (low[i] == low[j]) & (np.minimum(lengths[i], lengths[j]) == m[i]) & (~apart[i] | (tile[i] != tile[j]))
    i, j = i[fits], j[fits]
    if not len(i):
        return i, j
    width = int(lengths.max())
    front = np.zeros((count, width + 1), np.uint32)
    back = np.zeros((count, width + 1), np.uint32)
    front[at_word, at_place] = codes
    back[at_word, lengths[at_word] - 1 - at_place] = codes
    # Code points that agree from the front and from the back; a column of ones ends the search.
    ahead, behind = np.empty(len(i), np.int64), np.empty(len(i), np.int64)
    step = max(1, TILE_CELLS // (width + 1))
    for at in range(0, len(i), step):
        some = slice(at, at + step)
        for table, out in ((front, ahead), (back, behind)):
            differ = table[i[some]] != table[j[some]]
            differ[:, width] = True
            out[some] = differ.argmax(axis=1)
    least = m[i]
    equal = lengths[i] == lengths[j]
    one = np.where(equal, ahead + behind == least - 1, ahead + behind >= least)
    place = np.minimum(ahead, least - 1)
    one &= (low[i] <= place) & (place < high[i])
    return i[one], j[one]


def best_of(words: list[str], n: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """word, n_near, form, form_n: of each word with near ones their number and the best of them."""
    a, b = np.concatenate([i, j]), np.concatenate([j, i])
    rank = np.empty(len(words), np.int64)
    rank[np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)] = np.arange(len(words))
    order = np.lexsort((rank[b], -n[b], a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.empty(0, np.int64)
    near = np.diff(np.concatenate([first, [len(a)]]))
    columns = [
        pa.array([words[x] for x in a[first]], pa.string()),
        pa.array(near, pa.int64()),
        pa.array([words[x] for x in b[first]], pa.string()),
        pa.array(n[b[first]], pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["word", "n_near", "form", "form_n"])


def near_words(words: DataFrame, tile: int = TILE) -> DataFrame:
    """Of each of the `words` (word, n; each word once) that has near words: word, n_near, form (the near word of largest
    n, the least in code-point order of several), form_n."""
    spark = words.sparkSession
    rows = placed(words).withColumns({"i": F.lit(0), "j": F.lit(0), "tile": F.lit(0)})
    tiles = F.ceil(F.col("words") / F.greatest(F.lit(1), F.least(F.lit(tile), F.floor(TILE_CELLS / F.col("m"))))).cast("int")
    full = rows.groupBy("key").agg(F.count("*").alias("words"), F.max("m").alias("m")).select("key", tiles.alias("tiles"))
    full = stored(full.filter("tiles > 1"), "full_blocks")
    if not full.isEmpty():
        own = F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int")
        rows = rows.join(full, "key", "left").withColumn("tile", F.coalesce(own, F.lit(0)))
        others = F.explode(F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1))
        rows = rows.withColumn("other", others).withColumns({"i": F.least("tile", "other"), "j": F.greatest("tile", "other")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compared(table: pa.Table) -> Iterator[pa.RecordBatch]:
            """Whole blocks, in chunks; a large block is a chunk of its own."""
            key, *numbers = (table.column(c).to_numpy() for c in ("key", "i", "j", "m", "low", "high", "n", "tile"))
            word = table.column("word").to_pylist()
            i, j, m, low, high, n, at = numbers
            ends = _ends(key, i, j)
            size = np.cumsum(np.fromiter(map(len, word), np.int64, len(word)))
            blocks = np.searchsorted(ends, np.arange(len(word)), "right")
            begin = 0
            for k, end in enumerate(ends):
                upto = ends[k + 1] if k + 1 < len(ends) else None
                if upto and upto - begin <= CHUNK and size[upto - 1] - size[begin] <= TILE_CELLS:
                    continue
                s = slice(begin, end)
                begin = end
                if end - s.start > 1:
                    a, b = near_in(word[s], n[s], m[s], low[s], high[s], blocks[s], at[s], i[s] != j[s])
                    if len(a):
                        yield best_of(word[s], n[s], a, b)

        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]) if held is not None else table
            ends = _ends(*(held.column(c).to_numpy() for c in ("key", "i", "j")))
            if len(ends) > 1:  # the last block may go on in the next batch
                yield from compared(held.slice(0, ends[-2]))
                held = held.slice(ends[-2])
        if held is not None and held.num_rows:
            yield from compared(held)

    def _ends(key: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        change = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        return np.concatenate([np.flatnonzero(change) + 1, [len(key)]]) if len(key) else np.empty(0, np.int64)

    dealt = rows.select("key", "i", "j", "m", "low", "high", "word", F.col("n").cast("long").alias("n"), "tile")
    dealt = dealt.repartition(partitions_of(spark), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = dealt.mapInArrow(run, "word string, n_near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return found.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of `forms` (word, form; each word once): the end of the way from form to form.

    A form has at least twice its word's n, so ways are short; each round doubles the steps of all words.
    """
    at = stored(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        # Words whose root goes on are the only ones that move others.
        at = at.select("word", "root")
        on = at.filter("root <> word").select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = stored(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"), "roots")
        if at.filter("next is not null").isEmpty():
            return at.select("word", "root")


def variants(
    docs: DataFrame,
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    times: Column | int = 2,
    damaged: int | None = DAMAGED,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of `docs` with enough code points and occurrences.

    The form is the near word of largest n if that is at least `times` the word's own n, else null.
    """
    counts = word_counts(docs, id_col, text_col, damaged)
    words = stored(counts.filter((F.char_length("word") >= least_length) & (F.col("n") >= least_count)), "words")
    near = near_words(words)
    enough = F.col("form_n") >= times * F.col("n")
    found = words.join(near, "word", "left").select(
        "word",
        F.when(enough, F.col("form")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(enough, F.col("form_n")).alias("form_n"),
    )
    found = stored(found, "variants")
    return found.join(roots(found), "word").select("word", "form", "root", "n", "n_near", "form_n")
