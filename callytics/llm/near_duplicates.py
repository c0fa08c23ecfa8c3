"""Near duplicates by weighted Jaccard similarity of word shingles: BagMinHash, bands, exact check, classes.

A document is the multiset of its windows of five words; similarity is the sum of the smaller counts over the sum
of the larger ones. Documents whose similarity is THRESHOLD or more are linked, and linked documents form a class.

Signature. Weights are discretised at whole numbers, and a window of count w owns the levels 0..w. Every dyadic
block of levels, [0,1), [1,2), [2,4), [4,8) ..., has a Poisson process whose rate is its width; the hash of window and
block seeds it. A point of a block has a place in it, found by the leading bits of a hash, and counts if that lies
below w; so large counts cost a block for each doubling. Each point goes to one of SIZE components, and a component
keeps its first point. Two documents agree in a component with probability equal to their similarity. Points are
drawn up to a time by which nearly all components are met, and further only for documents that need it.

Equal texts are one text from the start, so groups of copies cost nothing. Bands of ROWS components put texts into
buckets. Every text is compared with the least of the least texts of its buckets. Then, in rounds, texts of buckets that
still hold several classes are compared with the least text of each of their buckets and, in the order of the next
components, with texts of other classes before them: buckets of up to NEAR + 1 texts are compared whole, in larger ones
each text meets the nearest such text only, as those that agree furthest stand side by side and one link joins whole
classes. Larger buckets that still hold several classes after the rounds are finished exactly: a pair that reaches the
threshold shares one of the rarest windows of both, so texts of different classes are joined by these (prefix filter).
Each pair is checked on the whole multisets, whose windows are told apart by 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from callytics.llm.common import short_batches, stored
from callytics.llm.words import HAS_WORD, mix, window_hashes, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 32
ROWS = 5
SIZE = BANDS * ROWS
NEAR = 8
#: Rounds of comparisons with neighbours; a round without a new link is the last.
NEAR_ROUNDS = 2
#: Texts of a bucket that are ordered by one task; larger buckets are split by their next component.
BUCKET = 5_000
#: Rows of one window that meet in one task on each side of the exact join.
BLOCK = 1_000
#: Bits of the table of window counts that orders windows by rarity. Any order gives the same links.
COUNT_BITS = 20

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def bags(texts: list[str | None], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multisets of windows: (text number, window hash, count), ordered by text and hash."""
    text, _, h = window_hashes(*word_hashes(texts), width)
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    if not len(h):
        return text, h, np.empty(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (h[1:] != h[:-1])]))
    return text[first], h[first], np.diff(np.concatenate([first, [len(h)]]))


def signatures(text: np.ndarray, h: np.ndarray, count: np.ndarray, n_texts: int, size: int = SIZE) -> np.ndarray:
    """BagMinHash signatures, uint32 of shape (n_texts, size); the rows of texts without windows mean nothing."""
    # Processes: a row per window and dyadic block of levels that begins below its count.
    blocks = 1 + np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64)
    element = np.repeat(np.arange(len(h)), blocks)
    block = np.arange(len(element)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    low = np.where(block == 0, 0, 1 << np.maximum(block - 1, 0))
    width = np.maximum(low, 1)
    owner, weight = text[element], count[element]
    seed = mix(h[element] + GOLDEN * (block + 1).astype(np.uint64))
    total = np.bincount(text, weights=count, minlength=n_texts)
    limit = size * (np.log(size) + 2) / np.maximum(total, 1)
    found = np.full(n_texts * size, np.iinfo(np.uint64).max, np.uint64)
    time = np.zeros(len(seed))
    number = np.zeros(len(seed), np.uint64)
    waiting = _next(seed, number, width, time)  # time of the next point of each process
    live = np.arange(len(seed))
    while len(live):
        now = live[waiting[live] <= limit[owner[live]]]
        while len(now):
            t = waiting[now]
            bits = mix(seed[now] ^ mix(number[now] * GOLDEN + np.uint64(1)))
            component = ((bits >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)
            place = low[now] + ((mix(bits) >> np.uint64(11)) * 2.0**-53 * width[now]).astype(np.int64)
            ours = place < weight[now]
            packed = (t.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (mix(bits + GOLDEN) >> np.uint64(32))
            np.minimum.at(found, owner[now][ours] * size + component[ours].astype(np.int64), packed[ours])
            number[now] += np.uint64(1)
            waiting[now] = _next(seed[now], number[now], width[now], t)
            now = now[waiting[now] <= limit[owner[now]]]
        missing = (found.reshape(n_texts, size) == np.iinfo(np.uint64).max).any(axis=1) & (total > 0)
        limit = np.where(missing, limit * 1.7, 0)
        live = live[missing[owner[live]]]
    return (found & np.uint64(0xFFFFFFFF)).astype(np.uint32).reshape(n_texts, size)


def _next(seed: np.ndarray, number: np.ndarray, width: np.ndarray, after: np.ndarray) -> np.ndarray:
    u = ((mix(seed + number * GOLDEN) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
    return after - np.log(u) / width


def bands_of(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each band, and the 4 x 16 leading bits of the next components, for the order within a bucket."""
    n = len(signature)
    s = signature.astype(np.uint64)
    parts = s.reshape(n, bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * GOLDEN
    for r in range(rows):
        key = mix(key ^ parts[:, :, r])
    after = np.zeros((n, bands), np.uint64)
    for j in range(4):
        after = (after << np.uint64(16)) | (np.roll(parts, -1, axis=1)[:, :, j % rows] >> np.uint64(16))
    return key.view(np.int64), after.view(np.int64)


def text_key(text_col: str = "text") -> Column:
    """Key of a text: its MD5; null for a text without words, which is like no other."""
    text = F.col(text_col).cast("string")
    return F.when(text.rlike(HAS_WORD), F.unhex(F.md5(text)))


def _lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width), pa.int32()), pa.array(values.ravel()))


def signed(docs: DataFrame, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """A row for each different text: k, doc_id (the least), n (windows), keys, after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                texts = part.column(2).to_pylist()
                bag = bags(texts)
                keys, after = bands_of(signatures(*bag, len(texts), bands * rows), bands, rows)
                n = np.bincount(bag[0], weights=bag[2], minlength=len(texts)).astype(np.int64)
                columns = [part.column(0), part.column(1), pa.array(n), _lists(keys), _lists(after)]
                yield pa.RecordBatch.from_arrays(columns, ["k", "doc_id", "n", "keys", "after"])

    texts = docs.select(text_key(text_col).alias("k"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string"))
    rows_ = texts.filter("k is not null").mapInArrow(run, "k binary, doc_id long, n long, keys array<long>, after array<long>")
    return rows_.groupBy("k").agg(F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ("n", "keys", "after")))


def coded_bags(docs: DataFrame, some: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Multisets of the texts in `some` (k, doc_id), as sets of codes of (window, which occurrence): k, codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                text, h, count = bags(part.column(1).to_pylist())
                element = np.repeat(np.arange(len(h)), count)
                which = np.arange(len(element)) - np.repeat(np.cumsum(count) - count, count)
                codes = mix(h[element] + GOLDEN * which.astype(np.uint64)).view(np.int64)
                ends = np.concatenate([[0], np.cumsum(np.bincount(text, weights=count, minlength=part.num_rows))])
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(codes))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["k", "codes"])

    texts = docs.select(
        text_key(text_col).alias("k"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    )
    # One row of each text: the one with the least id. So a group of copies isn't brought together here.
    same = (texts["k"] == some["k"]) & texts["doc_id"].eqNullSafe(some["doc_id"])
    found = texts.join(some, same, "left_semi").select("k", "text").mapInArrow(run, "k binary, codes array<long>")
    return found.dropDuplicates(["k"])


def linked(pairs: DataFrame, bag: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (a, b) those whose multisets are as similar as the threshold."""
    both = pairs.join(bag.select(F.col("k").alias("a"), F.col("codes").alias("x")), "a").join(
        bag.select(F.col("k").alias("b"), F.col("codes").alias("y")), "b"
    )
    common = F.size(F.array_intersect("x", "y"))
    return both.filter(common >= threshold * (F.size("x") + F.size("y") - common) - 1e-9).select("a", "b")


def prefixes(bag: DataFrame, threshold: float) -> DataFrame:
    """The rarest codes of each text of `bag` (k, label, codes): k, label, n (different codes), code, p (rank by rarity).

    Two sets of m and n codes as similar as the threshold share at least o = t / (1 + t) (m + n) codes, hence one among
    the first m - o + 1 of one and n - o + 1 of the other, in any order common to both. With the smallest partner that
    is n - t n + 1 codes.
    """
    low = F.explode("codes").alias("code")
    slots = bag.select(low).groupBy(F.col("code").bitwiseAND((1 << COUNT_BITS) - 1).alias("slot")).count().toPandas()
    counts = np.zeros(1 << COUNT_BITS, np.int64)
    counts[slots["slot"].to_numpy(np.int64)] = slots["count"].to_numpy(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                row, n, code, rank = [], [], [], []
                for i, codes in enumerate(part.column(2)):
                    own = np.unique(codes.values.to_numpy())
                    own = own[np.lexsort((own, counts[own & ((1 << COUNT_BITS) - 1)]))]
                    size = len(own) - int(np.ceil(threshold * len(own) - 1e-6)) + 1
                    row.append(np.full(size, i))
                    n.append(np.full(size, len(own), np.int32))
                    code.append(own[:size])
                    rank.append(np.arange(size, dtype=np.int32))
                if not row:
                    continue
                at_row = pa.array(np.concatenate(row))
                numbers = [pa.array(np.concatenate(x)) for x in (n, code, rank)]
                columns = [part.column(0).take(at_row), part.column(1).take(at_row), *numbers]
                yield pa.RecordBatch.from_arrays(columns, ["k", "label", "n", "code", "p"])

    return bag.mapInArrow(run, "k binary, label binary, n int, code long, p int")


def prefix_pairs(bag: DataFrame, threshold: float) -> DataFrame:
    """All pairs (a, b) of texts of `bag` (k, label, codes) with different labels that could reach the threshold."""
    need = threshold / (1 + threshold)
    rows = stored(prefixes(bag, threshold), "prefixes")
    # The smaller text of a pair has its meeting code further in front.
    front = F.col("p") <= F.col("n") - F.ceil(2 * need * F.col("n") - 1e-6)
    count = rows.groupBy("code").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("texts"), F.sum(front.cast("int")).alias("fronts")
    )
    count = count.filter((F.col("low") != F.col("high")) & (F.col("fronts") > 0)).select(
        "code", F.ceil(F.col("fronts") / BLOCK).alias("across"), F.ceil(F.col("texts") / BLOCK).alias("down")
    )
    met = stored(rows.join(count, "code"), "met")
    # Frequent codes are cut into blocks: each row of one side meets each block of the other.
    own = lambda n: F.pmod(F.xxhash64("k"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    small = met.filter(front).select("code", "k", "label", "n", "p", own("across").alias("i"), every("down").alias("j")).alias("s")
    large = met.select("code", "k", "label", "n", "p", own("down").alias("j"), every("across").alias("i")).alias("l")
    least = F.ceil(need * (F.col("s.n") + F.col("l.n")) - 1e-6)
    could = (
        (F.col("s.code") == F.col("l.code")) & (F.col("s.i") == F.col("l.i")) & (F.col("s.j") == F.col("l.j"))
        & (F.col("s.label") != F.col("l.label"))
        & ((F.col("s.n") < F.col("l.n")) | ((F.col("s.n") == F.col("l.n")) & (F.col("s.k") < F.col("l.k"))))
        & (F.col("s.n") >= threshold * F.col("l.n") - 1e-6)
        & (F.col("s.p") <= F.col("s.n") - least) & (F.col("l.p") <= F.col("l.n") - least)
    )
    return small.join(large, could).select(F.least("s.k", "l.k").alias("a"), F.greatest("s.k", "l.k").alias("b")).distinct()


def classes(links: DataFrame) -> DataFrame:
    """Connected components: (k, label) for every k in a link; the label is the least k of its component.

    Each round takes the least label among the neighbours and then the label's label; rounds are stored.
    """
    edges = stored(links.union(links.select("b", "a")).distinct(), "edges")
    labels = stored(edges.groupBy(F.col("a").alias("k")).agg(F.least(F.col("k"), F.min("b")).alias("label")), "labels")
    while True:
        near = edges.join(labels, edges["b"] == labels["k"]).groupBy("a").agg(F.min("label").alias("best"))
        better = labels.join(near, labels["k"] == near["a"]).select("k", "label", F.least("label", "best").alias("low"))
        up = labels.select(F.col("k").alias("low"), F.col("label").alias("top"))
        labels = stored(better.join(up, "low").select("k", F.least("low", "top").alias("label"), F.col("label").alias("was")), "labels")
        if labels.filter("label <> was").isEmpty():
            return labels.select("k", "label")
        labels = labels.select("k", "label")


def alike(m: str | Column, n: str | Column, threshold: float) -> Column:
    """Whether sizes allow the similarity, which is at most the smaller number of windows over the larger."""
    return F.least(m, n) >= threshold * F.greatest(m, n) - 1e-9


def neighbour_pairs(members: DataFrame, label: DataFrame, near: int, threshold: float, whole: bool) -> DataFrame:
    """Pairs (a, b) of texts of different classes in one bucket.

    In buckets of more than `near` + 1 texts each text meets the nearest one before it. If `whole`, those of other buckets
    meet all, and each text meets the least one of its bucket. `members` has a row per text and bucket, `label` the classes so far.
    """
    known = members.join(label, "k", "left").withColumn("label", F.coalesce("label", "k"))
    several = known.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key")
    if not whole:
        known = known.filter(F.col("texts") > near + 1)
    known = known.join(several, "key")
    theirs = label.select(F.col("k").alias("least_k"), F.col("label").alias("least_label"))
    others = known.filter((F.col("k") != F.col("least.k")) & alike("n", "least.n", threshold))
    others = others.select("k", "label", F.col("least.k").alias("least_k")).distinct()
    others = others.join(theirs, "least_k", "left").filter(F.col("label") != F.coalesce("least_label", "least_k"))
    placed = known.select(
        "k", "n", "key", "after", "label", "texts",
        F.when(F.col("texts") > BUCKET, F.pmod(F.shiftright("after", 48), F.ceil(F.col("texts") / BUCKET))).otherwise(0).alias("split"),
    )
    order = Window.partitionBy("key", "split").orderBy("after", "k")
    before = F.array_compact(F.array(*(F.lag(F.struct("k", "n", "label"), i).over(order) for i in range(1, near + 1))))
    fit = F.filter("before", lambda o: (o["label"] != F.col("label")) & alike(F.col("n"), o["n"], threshold))
    some = F.when(F.col("texts") > near + 1, F.slice("fit", 1, 1)).otherwise(F.col("fit"))
    pairs = placed.withColumn("before", before).withColumn("fit", fit).select("k", F.explode(some).alias("other"))
    pairs = pairs.select("k", F.col("other.k").alias("o"))
    if whole:
        pairs = pairs.union(others.select("k", F.col("least_k").alias("o")))
    return pairs.select(F.least("k", "o").alias("a"), F.greatest("k", "o").alias("b")).distinct()


def duplicate_classes(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    rows: int = ROWS,
    near: int = NEAR,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """A row for each different text with words: k (see `text_key`), doc_id (its least id), class_id (the least id in
    its class) and label (the least k in its class). Ids may be null or repeated; a null id is never the least
    unless all are null."""
    short_batches(docs.sparkSession)
    texts = stored(signed(docs, bands, rows, id_col, text_col), "signed")
    one = texts.select("k", "doc_id", "n", F.explode(F.arrays_zip("keys", "after")).alias("z")).select(
        "k", "doc_id", "n", F.col("z.keys").alias("key"), F.col("z.after").alias("after")
    )
    buckets = stored(
        one.groupBy("key").agg(F.count("*").alias("texts"), F.min(F.struct("k", "n")).alias("least")).filter("texts > 1"), "buckets"
    )
    members = stored(one.join(buckets, "key"), "members")
    bag = stored(coded_bags(docs, members.select("k", "doc_id").distinct(), id_col, text_col), "bags")

    to_least = members.filter((F.col("k") != F.col("least.k")) & alike("n", "least.n", threshold))
    one_each = to_least.groupBy(F.col("k").alias("b")).agg(F.min("least.k").alias("a")).select("a", "b")
    first = stored(linked(one_each, bag, threshold), "links")
    label = classes(first)

    for number in range(NEAR_ROUNDS):
        pairs = neighbour_pairs(members, label, near, threshold, number == 0)
        found = stored(linked(pairs, bag, threshold), "links")
        if found.isEmpty():
            break
        first = first.union(found)
        label = classes(first)

    # Larger buckets that still hold several classes: the rest of their pairs.
    crowd = members.filter(F.col("texts") > near + 1).select("key", "k").join(label, "k", "left")
    crowd = crowd.select("key", "k", F.coalesce("label", "k").alias("label"))
    mixed = crowd.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key")
    unsettled = stored(crowd.join(mixed, "key").select("k", "label").distinct(), "unsettled")
    if not unsettled.isEmpty():
        third = stored(linked(prefix_pairs(unsettled.join(bag, "k").select("k", "label", "codes"), threshold), bag, threshold), "links")
        if not third.isEmpty():
            label = classes(first.union(third))

    named = texts.select("k", "doc_id").join(label, "k", "left")
    least = named.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("least_id"))
    ids = F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("least_id")).alias("class_id")
    return stored(named.join(least, "label", "left").select("k", "doc_id", ids, F.coalesce("label", "k").alias("label")), "classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """One row per row of `docs`: doc_id, class_id (the least id of the class). Texts without words, null ones too, are
    classes of their own; equal texts are always one class."""
    found = duplicate_classes(docs, id_col=id_col, text_col=text_col, **settings).select("k", "class_id")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("k"))
    return rows.join(found, "k", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """Rows of `docs`, all columns, without near duplicates: of each class one row with the least id stays.

    Texts without words all stay.
    """
    found = duplicate_classes(docs, id_col=id_col, text_col=text_col, **settings)
    # A class's least id may stand at several texts; the least key decides.
    first = found.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("label").agg(
        F.min("k").alias("k"), F.first("class_id").alias("class_id")
    )
    keyed = docs.withColumn(key := "_text_key_", text_key(text_col))
    same = (keyed[key] == first["k"]) & keyed[id_col].cast("long").eqNullSafe(first["class_id"])
    kept = keyed.join(first, same, "left_semi").dropDuplicates([id_col, key]).drop(key)
    return kept.unionByName(docs.filter(text_key(text_col).isNull()))
