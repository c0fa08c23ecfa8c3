"""Benchmark decontamination: documents that hold a benchmark item, also with other numbers, names or units.

Template canonicalisation. A text becomes a row of tokens: words in lower case, and typed placeholders for numbers,
units after a number, and names. A name is a capitalised word (capital, then small letters) that doesn't begin a
sentence; what a placeholder stands for is the value of its slot. Windows of WIDTH tokens of documents and items are
joined by hash. Windows of which more than half are slots say too little as templates and stand with their values, so
only verbatim copies match them. A window with a name stands a second time with the name as a word, so that a copy in
other letter case is found too. An item of fewer than WIDTH tokens is one window, and documents have windows of that
length besides.

Runs. Matches of a document and an item with the same distance between their places lie on one diagonal. A diagonal
counts if its longest run of matched windows spans RUN tokens, or if SHARE of the item's windows are matched on it, all
of them or those that aren't mostly slots.
Slot consistency. In a run, or for a share on the whole diagonal, each name of the item must always have become the same
value of the document; where one has become two it is no re-parameterised copy. Equal numbers and units may stand for
different things, so they may part. None of that matters to what is unchanged: SHARE of the item's windows unchanged, or
RUN unchanged tokens in a row, with or without slots, count anyway.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from callytics.llm.common import short_batches, stored, worker_memory
from callytics.llm.words import REMEMBERED, mix

WIDTH = 5
RUN = 13
SHARE = 0.8
#: Bits of the table that says which windows can be in the benchmark. Its size is fixed; the join decides.
FILTER_BITS = 22

# Units after a number.
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb oz ml l s min h ms hz khz mhz ghz w kw v a k c f % eur usd gbp "
    "meters metres kilometers kilometres miles feet inches grams kilograms pounds liters litres "
    "seconds minutes hours days weeks months years degrees percent dollars euros cents"
).split()

NUMBER, UNIT, NAME, WORD, NOTHING = 1, 2, 3, 0, 4
ENDS = 8  # a flag: the next token begins a sentence
_SPLIT_NUMBER = re.compile(r"(\d)(?=[^\W\d_]|%)")
_CORE = re.compile(r"%|[^\W_](?:.*[^\W_])?", re.S)
_DIGITS = re.compile(r"\d[\d.,:/]*")
_CAPITALISED = re.compile(r"[^\W\d_]+")
_PLACEHOLDER = np.array([0, 0x51ED270B9F1C43A7, 0x2F0B4C1D8A6E9357, 0x7C3A5D92E1B8460F], np.uint64)


class Tokens(dict):
    """Raw token -> (hash of its word, hash of its value, kind and flag) of a token between blanks."""

    def __missing__(self, raw: str) -> tuple[int, int]:
        import xxhash

        found = _CORE.search(raw)
        core = found.group() if found else ""
        ends = ENDS if raw == "\n" or raw.rstrip("\"')]»”’*#&%$").endswith((".", "!", "?", ":", "|")) else 0
        if not core:
            kind = NOTHING
        elif _DIGITS.fullmatch(core):
            kind = NUMBER
        elif core.lower() in UNITS:
            kind = UNIT
        elif core[0].isupper() and core[1:].islower() and _CAPITALISED.fullmatch(core):
            kind = NAME
        else:
            kind = WORD
        # The upper 60 bits are the hash of the word; two texts of one word differ in case only.
        value = (xxhash.xxh64_intdigest(core.lower()) & ~0xF) | kind | ends
        if len(self) >= REMEMBERED:
            self.clear()
        self[raw] = value
        return value


def _tokens() -> Tokens:
    return worker_memory("raw tokens", Tokens)


def canonical(texts: list[str | None]) -> tuple[np.ndarray, ...]:
    """Tokens of all texts: canonical hash, the same with names as words, value hash, kind of slot or 0; and the number of
    tokens of each text. `mix` of the value hash is the hash of the token as a word."""
    known = _tokens().__getitem__
    parts = []
    for t in texts:
        raw = _SPLIT_NUMBER.sub(r"\1 ", t).replace("\n", " \n ").split(" ") if t else []
        parts.append(np.fromiter(map(known, raw), np.uint64))
    counts = np.array([len(p) for p in parts], np.int64)
    packed = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    text = np.repeat(np.arange(len(parts)), counts)
    kind, ends = packed & np.uint64(7), (packed & np.uint64(ENDS)) > 0
    # A token begins a sentence if one has ended since the last token with letters or digits, or none came before.
    ended = np.cumsum(ends) - ends
    real = np.flatnonzero(kind != NOTHING)
    starts = np.ones(len(real), bool)
    starts[1:] = (ended[real[1:]] > ended[real[:-1]]) | (text[real[1:]] != text[real[:-1]])
    packed, text, kind = packed[real], text[real], kind[real]
    name = (kind == NAME) & ~starts
    number = kind == NUMBER
    follows = np.concatenate([[False], number[:-1] & (text[1:] == text[:-1])])[: len(packed)]
    unit = (kind == UNIT) & follows
    slot_kind = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, 0)))
    value = packed >> np.uint64(4)
    word = mix(value)
    h = np.where(slot_kind > 0, _PLACEHOLDER[slot_kind], word)
    plain = np.where(slot_kind == NAME, word, h)
    return h, plain, value, slot_kind, np.bincount(text, minlength=len(parts)).astype(np.int64)


def template_windows(texts: list[str | None], width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """Windows of texts: text number, place, hash, per window the slot values (n, width), with the kind in two bits, 0 where there is no slot; is it
    mostly slots, and its number of tokens.

    A text of fewer tokens has one window of all its tokens. Windows mostly of slots have their tokens as words.
    """
    h, plain, value, kind, counts = canonical(texts)
    slot = kind > 0
    if not len(h):
        none = np.empty(0, np.int64)
        return none, none, np.empty(0, np.uint64), np.empty((0, width), np.uint64), np.empty(0, bool), none
    text = np.repeat(np.arange(len(counts)), counts)
    begin = np.concatenate([[0], np.cumsum(counts)[:-1]])
    place = np.arange(len(h)) - begin[text]
    left = counts[text] - place
    pad = lambda x: np.concatenate([x, np.zeros(width, x.dtype)])
    ph, pv = pad(h), pad(np.where(slot, (value << np.uint64(2)) | kind.astype(np.uint64), np.uint64(0)))
    total, slots, used = np.zeros(len(h), np.uint64), np.zeros(len(h), np.int64), np.minimum(left, width)
    values = np.zeros((len(h), width), np.uint64)
    for j in range(width):
        factor = np.uint64((0x9E3779B97F4A7C15 * (2 * j + 3)) & (2**64 - 1))
        inside = left > j
        total += np.where(inside, mix(ph[j : j + len(h)] + np.uint64(j + 1)) * factor, np.uint64(0))
        values[:, j] = np.where(inside, pv[j : j + len(h)], np.uint64(0))
        slots += values[:, j] > 0
    whole = (left >= width) | (place == 0)
    dense = 2 * slots > used
    keep = np.flatnonzero(whole & ~dense)
    named = pad(plain != h)
    again = whole & np.logical_or.reduce([named[j : j + len(h)] & (left > j) for j in range(width)])
    at = np.flatnonzero(again)
    pp, still = pad(plain), pad(slot & (plain == h))
    second, values2 = np.zeros(len(at), np.uint64), np.zeros((len(at), width), np.uint64)
    for j in range(width):
        factor = np.uint64((0x9E3779B97F4A7C15 * (2 * j + 3)) & (2**64 - 1))
        inside = left[at] > j
        second += np.where(inside, mix(pp[at + j] + np.uint64(j + 1)) * factor, np.uint64(0))
        values2[:, j] = np.where(inside & still[at + j], pv[at + j], np.uint64(0))
    fit = 2 * (values2 > 0).sum(axis=1) <= used[at]
    at, second, values2 = at[fit], second[fit], values2[fit]
    full = np.flatnonzero(whole & dense)
    pw, verbatim = pad(mix(value)), np.zeros(len(full), np.uint64)
    for j in range(width):
        factor = np.uint64((0x9E3779B97F4A7C15 * (2 * j + 3)) & (2**64 - 1))
        verbatim += np.where(left[full] > j, mix(pw[full + j] + np.uint64(j + 1)) * factor, np.uint64(0))
    rows = np.concatenate([keep, at, full])
    hashes = mix(np.concatenate([total[keep], second, verbatim]) + np.uint64(1))
    slot_values = np.concatenate([values[keep], values2, np.zeros((len(full), width), np.uint64)])
    return text[rows], place[rows], hashes, slot_values, dense[rows], used[rows]


def _text_key(text_col: str) -> Column:
    """Key of a text beside its id; ids may be null or repeated."""
    return F.unhex(F.md5(F.col(text_col).cast("string")))


def _windows(rows: DataFrame, width: int, bits: np.ndarray | None = None, shorter: tuple[int, ...] = ()) -> DataFrame:
    """id, k, place, h, slots, dense, length of the windows of rows (id, text, k), of `width` tokens and of the numbers of tokens
    in `shorter`; with `bits`, those that the table lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = part.column(1).to_pylist()
                for n in (width, *shorter):
                    yield windows(part, template_windows(texts, n), n)

    def windows(part: pa.RecordBatch, found: tuple[np.ndarray, ...], n: int) -> pa.RecordBatch:
        if bits is not None:
            low = found[2] & np.uint64((1 << FILTER_BITS) - 1)
            keep = (bits[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8)) & 1 > 0
            found = tuple(x[keep] for x in found)
        text, place, h, values, dense, length = found
        ends = np.arange(0, values.size + 1, n, dtype=np.int32)
        return pa.RecordBatch.from_arrays(
            [
                part.column(0).take(pa.array(text)),
                part.column(2).take(pa.array(text)),
                pa.array(place.astype(np.int64)),
                pa.array(h.view(np.int64)),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel().view(np.int64))),
                pa.array(dense),
                pa.array(length.astype(np.int32)),
            ],
            ["id", "k", "place", "h", "slots", "dense", "length"],
        )

    return rows.mapInArrow(run, "id long, k binary, place long, h long, slots array<long>, dense boolean, length int")


def _held(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = WIDTH,
    run: int = RUN,
    share: float = SHARE,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Texts that hold items: doc_id, k (the key of the text), item_id, run_tokens, item_tokens, changed_slots."""
    short_batches(docs.sparkSession)
    items = stored(
        _windows(
            benchmark.select(F.col(item_id_col).cast("long"), F.col(item_text_col).cast("string"), F.lit(None).cast("binary").alias("k")), width
        ).distinct(),
        "items",
    )
    # A table of fixed size tells most windows of documents apart before the shuffle; the join below decides.
    low = items.select(F.col("h").bitwiseAND((1 << FILTER_BITS) - 1).alias("b")).distinct()
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    places = low.toPandas()["b"].to_numpy(np.int64)
    np.bitwise_or.at(bits, places >> 3, (1 << (places & 7)).astype(np.uint8))
    shorter = tuple(r["length"] for r in items.filter(F.col("length") < width).select("length").distinct().collect())
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), _text_key(text_col).alias("k"))
    windows = _windows(rows, width, bits, shorter)

    # A short item's list of slots is cut to its tokens, like that of the windows of its length.
    theirs = items.select(
        F.col("id").alias("item_id"), F.col("place").alias("item_place"), "h", F.slice("slots", 1, F.col("length")).alias("item_slots"),
        "length", "dense",
    )
    windows = windows.select("id", "k", "place", "h", F.slice("slots", 1, F.col("length")).alias("slots"), "length")
    matches = stored(
        windows.join(theirs, ["h", "length"]).select(
            F.col("id").alias("doc_id"), "k", "item_id", "item_place", (F.col("place") - F.col("item_place")).alias("diagonal"),
            "slots", "item_slots", "dense",
        ),
        "matches",
    )
    line = ["doc_id", "k", "item_id", "diagonal"]
    # Runs: places less their rank are equal within a run.
    order = Window.partitionBy(*line).orderBy("item_place")
    # Unchanged: by one of the windows of the place, all slots have kept their values.
    kept = F.col("slots") == F.col("item_slots")
    # A place counts as dense by the item's first window of it; a window with names as words stands beside that.
    steps = matches.groupBy(*line, "item_place").agg(
        (~F.bool_or("dense")).cast("int").alias("typed"),
        F.bool_or(kept).alias("kept"),
    )
    steps = stored(steps.withColumn("run", F.col("item_place") - F.row_number().over(order)), "steps")
    same = steps.filter("kept").withColumn("run", F.col("item_place") - F.row_number().over(order))
    unchanged = same.groupBy(*line, "run").agg(F.count("*").alias("n")).groupBy(*line).agg(
        F.sum("n").alias("kept"), F.max("n").alias("kept_run")
    )
    by_run = steps.groupBy(*line, "run").agg(F.count("*").alias("n"), F.sum("typed").alias("typed"))
    sizes = items.groupBy(F.col("id").alias("item_id")).agg(
        F.count_distinct("place").alias("windows"),
        F.count_distinct(F.when(~F.col("dense"), F.col("place"))).alias("windows_typed"),
        F.max("length").alias("length"),
    )
    # What each value of the item has become, in each run and on the diagonal.
    slots = matches.select(*line, "item_place", F.explode(F.arrays_zip("slots", "item_slots")).alias("z")).filter("z.item_slots <> 0")
    at = [F.col(f"m.{c}").eqNullSafe(F.col(f"p.{c}")) for c in [*line, "item_place"]]
    # What grows with the documents is never broadcast.
    became = slots.alias("m").join(steps.hint("merge").alias("p"), at).groupBy(*(f"m.{c}" for c in line), "p.run", F.col("m.z.item_slots").alias("value")).agg(
        F.min("m.z.slots").alias("low"), F.max("m.z.slots").alias("high")
    )
    became = stored(became, "became")
    name = F.col("value").bitwiseAND(3) == NAME
    torn = F.max(((F.col("low") != F.col("high")) & name).cast("int")).alias("torn")
    torn_runs = became.groupBy(*line, "run").agg(torn).filter("torn = 1")
    whole = became.groupBy(*line, "value").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    slot_rows = whole.groupBy(*line).agg(
        torn, F.sum(((F.col("low") != F.col("high")) | (F.col("low") != F.col("value"))).cast("int")).alias("changed")
    )

    def on(a: str, b: str, *more: str) -> list:
        return [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in (*line, *more)]

    runs = by_run.alias("r").join(torn_runs.hint("merge").alias("t"), on("r", "t", "run"), "left").groupBy(*(f"r.{c}" for c in line)).agg(
        F.max("n").alias("longest"), F.max(F.when(F.col("torn").isNull(), F.col("n"))).alias("fair_run"),
        F.sum("n").alias("matched"), F.sum("typed").alias("matched_typed"),
    )
    same_item = F.col("s.item_id").eqNullSafe(F.col("z.item_id"))
    judged = runs.alias("s").join(sizes.alias("z"), same_item).join(unchanged.hint("merge").alias("u"), on("s", "u"), "left")
    judged = judged.join(slot_rows.hint("merge").alias("t"), on("s", "t"), "left").select(
        "s.*", "z.windows", "z.windows_typed", "z.length", "u.kept", "u.kept_run", "t.changed", F.coalesce("t.torn", F.lit(0)).alias("torn")
    )
    shared = (F.col("matched") >= share * F.col("windows")) | (
        (F.col("windows_typed") > 0) & (F.col("matched_typed") >= share * F.col("windows_typed"))
    )
    long_run = run - width + 1
    enough = [F.col("fair_run") >= long_run, (F.col("torn") == 0) & shared]
    enough += [F.col("kept") >= share * F.col("windows"), F.col("kept_run") >= long_run]
    fair = judged.filter(F.greatest(*(F.coalesce(x, F.lit(False)).cast("int") for x in enough)) == 1).alias("g")
    return fair.groupBy("g.doc_id", "g.k", "g.item_id").agg(
        F.max(F.col("g.longest") + F.col("g.length") - 1).alias("run_tokens"),
        F.first(F.col("g.windows") + F.col("g.length") - 1).alias("item_tokens"),
        F.min(F.coalesce("g.changed", F.lit(0))).alias("changed_slots"),
    )


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = WIDTH,
    run: int = RUN,
    share: float = SHARE,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Documents that hold items: doc_id, item_id, run_tokens (longest run), item_tokens, changed_slots.

    One row per document and item. Null and empty texts hold nothing. Rows that repeat an id of `docs`, null ids too, are
    judged each by its own text; the report names them by their id, so they share a row for each item.
    """
    held = _held(docs, benchmark, width, run, share, id_col, text_col, item_id_col, item_text_col)
    return held.groupBy("doc_id", "item_id").agg(
        F.max("run_tokens").alias("run_tokens"), F.first("item_tokens").alias("item_tokens"), F.min("changed_slots").alias("changed_slots")
    )


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """Rows of `docs`, all columns, whose texts hold no item of the benchmark. Rows of one id are judged each by its text."""
    found = _held(docs, benchmark, id_col=id_col, text_col=text_col, **settings)
    bad = stored(found.select(F.col("doc_id").alias("_bad_"), F.col("k").alias("_bad_text_")).distinct(), "contaminated")
    same = docs[id_col].cast("long").eqNullSafe(bad["_bad_"]) & (F.unhex(F.md5(docs[text_col].cast("string"))) == bad["_bad_text_"])
    return docs.join(bad, same, "left_anti")
