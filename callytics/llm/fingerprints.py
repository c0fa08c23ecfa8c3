"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in DataFrame functions only.

A paragraph ends with its line, with the first sentence that ends after SHORT characters, or after LONG characters;
together the paragraphs are the whole text. Their 64-bit digests, each once, are a document's keys. A sketch has three segments of 2**bits cells. A
key goes to one cell of each segment, given by its bits, and a cell holds the number of its keys, their exclusive-or
and that of a check value of each.

Two sketches of one size subtract cell by cell, and what both texts share cancels. Peeling then recovers the differing
digests: a cell with one key left, told by its check, gives that key, which is taken from its other cells, and so on.
If cells remain, a larger sketch is made: keys are dealt over partial sketches, as many as the two documents have keys for,
and a part that fails is made anew with four times the cells, and again; the last resort for keys that meet in all
cells is the difference of the sets. Work grows as the number of keys times a root of it.

Everything is an expression over the columns of one row, so no key or document is brought together with others.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from callytics.llm.common import partitions_of

SHORT, LONG = 100, 300
PARAGRAPH = rf"[^\n]{{{SHORT},{LONG}}}?[.!?]+|[^\n]{{0,{LONG}}}\n+|[^\n]{{1,{LONG}}}"
BASE_BITS = 3  # the fingerprint: 3 * 2**3 cells
#: Partial sketches have 3 * 2**3 cells, and 4 and 16 times as many on failure.
RETRY_BITS = (3, 5, 7)
#: Keys of both documents for each partial sketch.
KEYS_A_PART = 12
ROUNDS = 12

def keys_of(text: str) -> str:
    """SQL for the keys of a text column: digests of its paragraphs, each once."""
    pattern = PARAGRAPH.replace("\\", "\\\\")
    return f"array_distinct(transform(regexp_extract_all({text}, '{pattern}', 0), p -> xxhash64(p)))"


def _check(key: str) -> str:
    return f"shiftrightunsigned(xxhash64({key}, 1), 32)"


def _placed(key: str, check: str, bits: int, more: str = "") -> str:
    """SQL for a key with its check and its cell in each segment."""
    cell = lambda i: f"cast(shiftrightunsigned({key}, {bits * i}) & {(1 << bits) - 1} as int)"
    return f"named_struct('k', {key}, 'h', {check}, 'p0', {cell(0)}, 'p1', {cell(1)}, 'p2', {cell(2)}{more})"


def sketch(keys: str, bits: int = BASE_BITS) -> str:
    """SQL for the cells of an array of keys: array of struct n, x (keys), c (checks), one segment after the other."""
    none = "named_struct('n', 0, 'x', 0L, 'c', 0L)"
    segments = ", ".join(
        f"transform(sequence(0, {(1 << bits) - 1}), j -> aggregate(filter(ks, p -> p.p{i} = j), {none}, "
        f"(a, p) -> named_struct('n', a.n + 1, 'x', a.x ^ p.k, 'c', a.c ^ p.h)))"
        for i in range(3)
    )
    return f"transform(array(transform({keys}, k -> {_placed('k', _check('k'), bits)})), ks -> concat({segments}))[0]"


def subtract(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (p, q) -> named_struct('n', p.n - q.n, 'x', p.x ^ q.x, 'c', p.c ^ q.c))"


def peel(cells: str, bits: int = BASE_BITS) -> str:
    """SQL for struct(found: array of struct(k, s), done): differing keys, s = 1 for the first document's, -1 else."""
    found = _placed("e.x", "e.c", bits, ", 's', e.n")
    pure = f"array_distinct(transform(filter(t.d, e -> abs(e.n) = 1 and e.c = {_check('e.x')}), e -> {found}))"
    taken = ", ".join(
        f"transform(slice(t.d, {(i << bits) + 1}, {1 << bits}), (e, j) -> aggregate(filter(u, p -> p.p{i} = j), e, "
        f"(a, p) -> named_struct('n', a.n - p.s, 'x', a.x ^ p.k, 'c', a.c ^ p.h)))"
        for i in range(3)
    )
    none = "cast(array() as array<struct<k: bigint, s: int>>)"
    return (
        f"aggregate(sequence(1, {ROUNDS}), named_struct('d', {cells}, 'found', {none}, 'go', true), "
        f"(t, r) -> if(t.go, transform(array({pure}), u -> if(size(u) = 0, "
        f"named_struct('d', t.d, 'found', t.found, 'go', false), "
        f"named_struct('d', concat({taken}), 'found', concat(t.found, transform(u, p -> named_struct('k', p.k, 's', p.s))), "
        f"'go', true)))[0], t), "
        f"t -> named_struct('found', t.found, 'done', forall(t.d, e -> e.n = 0 and e.x = 0)))"
    )


def _first_done(a: str, b: str, sizes: tuple[int, ...]) -> str:
    """Keys that differ, of the first size of sketch that peels; of the sets themselves if none does."""
    if not sizes:
        one = lambda x, y, s: f"transform(array_except({x}, {y}), k -> named_struct('k', k, 's', {s}))"
        return f"concat({one(a, b, 1)}, {one(b, a, -1)})"
    tried = peel(subtract(sketch(a, sizes[0]), sketch(b, sizes[0])), sizes[0])
    return f"transform(array({tried}), z -> if(z.done, z.found, {_first_done(a, b, sizes[1:])}))[0]"


def differences(a_keys: str, b_keys: str, a_cells: str, b_cells: str) -> str:
    """SQL for the differing keys, array of struct(k, s), of two documents by their sketches; larger ones on failure."""
    part = "cast(shiftrightunsigned({k}, 32) as bigint)"
    inner = _first_done("w.a", "w.b", RETRY_BITS)
    # Keys are dealt in two steps of `m` each, so that dealing costs keys times the root of the parts.
    fine = (
        "transform(sequence(0, m - 1), h -> transform(array(named_struct("
        f"'a', filter(v.a, k -> {part.format(k='k')} div m % m = h), 'b', filter(v.b, k -> {part.format(k='k')} div m % m = h))), "
        f"w -> if(size(w.a) + size(w.b) = 0, cast(array() as array<struct<k: bigint, s: int>>), {inner}))[0])"
    )
    coarse = (
        "flatten(transform(sequence(0, m - 1), g -> transform(array(named_struct("
        f"'a', filter({a_keys}, k -> {part.format(k='k')} % m = g), 'b', filter({b_keys}, k -> {part.format(k='k')} % m = g))), "
        f"v -> flatten({fine}))[0]))"
    )
    side = f"cast(ceil(sqrt((size({a_keys}) + size({b_keys})) / {KEYS_A_PART}.0)) as bigint)"
    larger = f"transform(array(greatest(1L, {side})), m -> {coarse})[0]"
    return f"transform(array({peel(subtract(a_cells, b_cells))}), y -> if(y.done, y.found, {larger}))[0]"


def likeness(a_keys: str, b_keys: str, differing: str) -> str:
    """Jaccard similarity of two sets of keys by the number of keys that differ; two empty texts are alike."""
    both = f"(size({a_keys}) + size({b_keys}))"
    return f"if({both} = 0, 1.0D, ({both} - {differing}) / cast({both} + {differing} as double))"


def printed(cells: str) -> str:
    """SQL for a sketch as text: count, keys and checks of each cell in hexadecimal digits."""
    return (
        f"array_join(transform({cells}, e -> concat(lpad(hex(e.n), 6, '0'), lpad(hex(e.x), 16, '0'), "
        f"lpad(hex(e.c), 8, '0'))), '')"
    )


def _bucket(bounds: list[int], column: str) -> Column:
    """Number of bounds up to the value: a few comparisons in each of two steps. Null counts as the least value."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    rows = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    heads = ", ".join(f"{r[0]}L" for r in rows)
    table = ", ".join("array(" + ", ".join(f"{v}L" for v in r) + ")" for r in rows)
    coarse = f"size(filter(array({heads}), b -> b <= {column}))"
    fine = f"size(filter(element_at(array({table}), {coarse}), b -> b <= {column}))"
    return F.expr(f"if({coarse} = 0, 0, ({coarse} - 1) * {step} + {fine})")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, next_text: each document beside the next in descending order of ids, after the last the first;
    with own_keys, own_cells, next_keys and next_cells.

    Null ids come last, and rows with one id are ordered by their texts; a null text is empty. Rows are dealt by quantiles
    of the id. The first row of each part also stands as a guest at the end of the part before, so that each
    part is ordered alone.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    parts = 4 * partitions_of(spark)
    found = rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10 * parts).alias("b")).first()["b"]
    rows = rows.withColumn("part", _bucket(sorted(set(found or [])), "doc_id")).withColumn("tie", F.xxhash64("text"))

    # At most a row for each part, of fixed width: where it begins.
    key = F.struct(F.col("doc_id").isNull(), F.bitwise_not("doc_id"), "tie", "doc_id")
    begins = sorted((r["part"], r["first"]) for r in rows.groupBy("part").agg(F.min(key).alias("first")).collect())
    targets = [(f[3], f[2], begins[(i + 1) % len(begins)][0]) for i, (_, f) in enumerate(begins)]
    guests = spark.createDataFrame(targets, "g_id long, g_tie long, target int")
    same = F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("tie") == F.col("g_tie"))
    guests = rows.join(F.broadcast(guests), same).dropDuplicates(["target"])
    guests = guests.select("doc_id", "text", F.col("target").alias("part"), "tie", F.lit(True).alias("guest"))
    order = Window.partitionBy("part").orderBy("guest", F.desc_nulls_last("doc_id"), "tie", "text")
    every = fingerprint(rows.withColumn("guest", F.lit(False)).unionByName(guests).repartition("part"))
    after = {f"next_{c}": F.lead(c if c == "text" else f"own_{c}").over(order) for c in ("text", "keys", "cells")}
    return every.withColumns(after).filter("not guest").select("doc_id", "text", "own_keys", "own_cells", *after)


def compare(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Add <b>_diff: keys that differ between two texts, of which <a>_keys, <a>_cells, <b>_keys and <b>_cells are there."""
    return pairs.withColumn(f"{b}_diff", F.expr(differences(f"{a}_keys", f"{b}_keys", f"{a}_cells", f"{b}_cells")))


def fingerprint(docs: DataFrame, text: str = "text", into: str = "own") -> DataFrame:
    """Add <into>_keys and <into>_cells of a text column."""
    return docs.withColumn(f"{into}_keys", F.expr(keys_of(text))).withColumn(f"{into}_cells", F.expr(sketch(f"{into}_keys")))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text: the later half replaced by the beginning of the next document.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. An empty table gives no rows.
    """
    half = "(char_length(text) div 2)"
    rows = with_next(docs, id_col, text_col).withColumn(
        "edited", F.expr(f"concat(left(text, cast(char_length(text) - {half} as int)), left(next_text, cast({half} as int)))")
    )
    rows = compare(compare(fingerprint(rows, "edited", "edited"), "own", "edited"), "own", "next")
    return rows.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        F.expr(printed("own_cells")).alias("fingerprint"),
        F.expr(printed("edited_cells")).alias("edited_fingerprint"),
        F.expr(likeness("own_keys", "edited_keys", "size(edited_diff)")).alias("near_edited"),
        F.expr(likeness("own_keys", "next_keys", "size(next_diff)")).alias("near_next"),
    )
