"""Best-fit packing: documents into as few fixed-length token sequences as possible.

Linear grouping: large pieces, in order of length, are cut into groups of equal cardinality and rounded up to the
longest of their group. For these few sizes, configurations of a sequence are optimised (linear programme,
configurations generated by a knapsack over its duals). Real pieces then take the places of their group, longest
first, and all others go, longest first, where they leave the least room.

Only the histogram of piece lengths, at most `capacity` rows, reaches the driver. The plan made of it gives runs
of equal work: "pieces of length L, ranks a to b, go to sequences s, s+1, ... at offset o". Its size depends on
the capacity alone. Pieces find their place by length and rank, wherever they are.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from callytics.llm.common import partitions_of, short_batches, stored
from callytics.llm.tokens import batch_encoder, default_tokenizer, larger

CAPACITY = 2048
END_ID = 0
#: Number of groups that large pieces are rounded to, and how many smallest large pieces fill a sequence.
GROUPS = 256
LARGE = 3
#: Largest share of a sequence that a configuration may leave free.
SLACK = 0.0005

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def lengths_of(total: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a document: all full but the first."""
    first = total % capacity
    return [first] * bool(first) + [capacity] * (total // capacity)


def pieces(
    docs: DataFrame,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    tokenizer: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece of each document: doc_id, piece, start, length, ids_crc32.

    Every row of `docs` is a document, repeated ids and null ids too. A null text is empty, and an empty text is
    the end id alone.
    """
    path = tokenizer or default_tokenizer()
    short_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = batch_encoder(path).batch
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in larger(batches):
            rows: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1))):
                ids, start = ids + end, 0
                for k, n in enumerate(lengths_of(len(ids) // 4, capacity)):
                    rows.append((doc, k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])))
                    start += n
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = zip(*rows) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(cut, PIECE_SCHEMA)


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, float]]:
    """A minimum of sequences for few sizes, fractions allowed: (pieces of each size, number of sequences).

    Simplex over configurations; the next one is the knapsack that is worth most at the current duals.
    """
    k = len(sizes)
    basis = np.diag([capacity // s for s in sizes]).astype(float)
    amount = np.array(demand, dtype=float)
    x = amount / np.diag(basis)
    most = capacity // min(sizes)
    for _ in range(60 * k):
        duals = np.linalg.solve(basis.T, np.ones(k))
        worth = np.zeros(capacity + 1)
        layers = []
        for _layer in range(most):  # one more piece in each layer
            best, choice = worth, np.full(capacity + 1, -1)
            for i, s in enumerate(sizes):
                if duals[i] > 1e-12:
                    with_i = np.full(capacity + 1, -1.0)
                    with_i[s:] = worth[: capacity + 1 - s] + duals[i]
                    better = with_i > best + 1e-12
                    best, choice = np.where(better, with_i, best), np.where(better, i, choice)
            layers.append(choice)
            if (choice < 0).all():
                break
            worth = best
        if worth[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(k), capacity
        for choice in reversed(layers):
            if choice[room] >= 0:
                i = choice[room]
                column[i] += 1
                room -= sizes[i]
        step = np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
        x = np.maximum(np.linalg.solve(basis, amount), 0)
    return [(basis[:, i].astype(int), float(x[i])) for i in range(k)]


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large: int = LARGE) -> pd.DataFrame:
    """Runs (length, rank, count, sequence, offset) that place every piece of the histogram."""
    left = {s: n for s, n in histogram.items() if n > 0}
    taken: dict[int, int] = defaultdict(int)
    plan: list[tuple[int, int, int, int, int]] = []
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free room -> runs of sequences (first, count)
    order: list[int] = []  # the rooms there are, sorted
    opened = 0

    def put(room: int, first: int, count: int) -> None:
        if room and count:
            if not rooms[room]:
                insort(order, room)
            rooms[room].append((first, count))

    def place(size: int, count: int, first: int, offset: int) -> None:
        plan.append((size, taken[size], count, first, offset))
        taken[size] += count
        left[size] -= count

    # Linear grouping of the large pieces, longest first.
    big = [s for s in sorted(left, reverse=True) if large * s > capacity and s < capacity]
    each = max(1, -(-sum(left[s] for s in big) // groups))
    grouped: list[deque[list[int]]] = []
    fill = each
    for s in big:
        n = left[s]
        while n:
            if fill == each:
                grouped.append(deque())
                fill = 0
            take = min(n, each - fill)
            grouped[-1].append([s, take])
            fill, n = fill + take, n - take
    if grouped:
        sizes = [g[0][0] for g in grouped]
        found = configurations(sizes, [sum(n for _, n in g) for g in grouped], capacity)
        # Configurations that leave much room would keep it; their pieces are left to the best fit.
        found = [(c, n) for c, n in found if capacity - (c * sizes).sum() <= SLACK * capacity]
        for config, number in sorted(found, key=lambda f: -int((f[0] * sizes).sum())):
            runs = [(opened, int(number + 1e-6), 0)]  # (first sequence, how many, filled)
            opened += int(number + 1e-6)
            for g in np.flatnonzero(config):
                for _ in range(config[g]):
                    after = []
                    for first, count, used in runs:  # real pieces take the places of their group
                        while count and grouped[g]:
                            size, n = grouped[g][0]
                            n = min(n, count)
                            place(size, n, first, used)
                            after.append((first, n, used + size))
                            first, count = first + n, count - n
                            grouped[g][0][1] -= n
                            if not grouped[g][0][1]:
                                grouped[g].popleft()
                        if count:
                            after.append((first, count, used))
                    runs = after
            for first, count, used in runs:
                put(capacity - used, first, count)
    # All others go, longest first, where they leave the least room.
    for s in sorted(left, reverse=True):
        while left[s]:
            at = bisect_left(order, s)
            if at == len(order):
                new = -(-left[s] // (capacity // s))
                put(capacity, opened, new)
                opened += new
                continue
            room = order[at]
            first, count = rooms[room].pop()
            if not rooms[room]:
                order.pop(at)
            n = min(count, left[s])
            place(s, n, first, capacity - room)
            put(room - s, first, n)
            put(room, first + n, count - n)
    out = pd.DataFrame(plan, columns=["length", "rank", "count", "sequence", "offset"])
    return out.sort_values(["length", "rank"], ignore_index=True)


def ranked(items: DataFrame) -> DataFrame:
    """Number the pieces of each length from 0 without bringing a length into one task.

    Pieces are numbered within (length, bucket); sums over the buckets of a length, which are as many as the
    shuffle is wide, give where each bucket begins.
    """
    wide = max(16, partitions_of(items.sparkSession))
    items = items.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(wide)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = (
        items.groupBy("length", "bucket")
        .agg(F.count("*").alias("n"))
        .select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    )
    place = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    numbered = items.withColumn("rank", F.row_number().over(place) - 1)
    return numbered.join(begins, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("begin"))


def pack(items: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Give every piece a sequence and its offset there. `items` as made by `pieces`, stored."""
    histogram = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = make_plan(histogram, capacity, groups)
    # One key for (length, rank): ranks of 2**44 pieces and lengths below 2**19 fit a long.
    keys = (plan["length"].to_numpy(np.int64) << 44) + plan["rank"].to_numpy(np.int64)
    first, offset = plan["sequence"].to_numpy(np.int64), plan["offset"].to_numpy(np.int64)
    shared = items.sparkSession.sparkContext.broadcast((keys, plan["rank"].to_numpy(np.int64), first, offset))

    def seat(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, rank, first, offset = shared.value
        for frame in frames:
            at = (frame["length"].to_numpy(np.int64) << 44) + frame["rank"].to_numpy(np.int64)
            i = np.searchsorted(keys, at, side="right") - 1
            frame["sequence_id"] = first[i] + frame["rank"].to_numpy(np.int64) - rank[i]
            frame["offset"] = offset[i]
            yield frame.drop(columns="rank")

    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "rank"]
    return ranked(items).select(*columns).mapInPandas(seat, PIECE_SCHEMA + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, groups: int = GROUPS, **names) -> DataFrame:
    """Cut documents into pieces and pack them. One row per piece; an empty table gives no rows."""
    return pack(stored(pieces(docs, capacity, end_id, **names), "pieces"), capacity, groups)
