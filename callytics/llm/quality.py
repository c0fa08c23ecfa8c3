"""Quality of whole texts, told by an additive model with pairs (see `gam`) over statistics of characters, words and lines.

The features are statistics of the whole text alone. The model is learned from a bounded sample of the labelled rows,
SAMPLE of each label at most, chosen by a hash of the id; the labels count by their share among all labelled rows.

Nulls and edge cases: a null text is empty, and an empty text has a score. Labels other than 0 and 1 (null too) and
labels or documents with a null id teach nothing. Ids may repeat: each different label of an id counts, for each row of
that id. Without labels the score is 1/2. Empty tables give empty results.
"""

from __future__ import annotations

import operator
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from callytics.llm import gam
from callytics.llm.common import short_batches

#: Bound of the sample: rows of each label.
SAMPLE = 6_000

#: Classes of bytes of a text in UTF-8.
CLASSES = {
    "upper": [*range(65, 91)],
    "lower": [*range(97, 123)],
    "beyond": [*range(128, 256)],
    "digits": [*range(48, 58)],
    "stops": [ord(c) for c in ".,;:?'\"-()"],
    "shouts": [ord("!")],
    "marks": [ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"],
    "lines": [10],
}
BY_CLASS = np.zeros((256, len(CLASSES)))
for _i, _members in enumerate(CLASSES.values()):
    BY_CLASS[_members, _i] = 1
SENTENCE = re.compile(r"[.!?]+(?=\s|$)")
FEATURES = (
    *CLASSES,
    "characters", "entropy", "words", "word_length", "different", "most_frequent", "repeated", "no_letters", "ends_in_mark",
    "capital_words", "short_words", "sentence_words", "line_length", "different_lines", "longest_word",
)
#: Words of a text taken together, for the statistics of texts of any length.
WIDE = 200


def features(text: str | None) -> list[float]:
    """Statistics of a text, in the order of FEATURES."""
    text = text or ""
    data = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    size = max(1, int(data.sum()))
    share = data[data > 0] / size
    words = text.split()
    n = max(1, len(words))
    counts = Counter(words)
    # Different words of a stretch of WIDE words, on average: unlike the share of a whole text, it doesn't fall with length.
    stretches = [len(set(words[i : i + WIDE])) / min(WIDE, len(words) - i) for i in range(0, len(words), WIDE)]
    lines = [line for line in text.split("\n") if line.strip()]
    return [
        *(data @ BY_CLASS / size),
        np.log1p(len(text)),
        float(-(share * np.log(share)).sum()),
        np.log1p(len(words)),
        sum(map(len, words)) / n,
        sum(stretches) / max(1, len(stretches)),
        max(counts.values(), default=0) / n,
        sum(map(operator.eq, words, words[1:])) / n,
        sum(k for w, k in counts.items() if w.isascii() and not any(map(str.isalnum, w))) / n,
        sum(k for w, k in counts.items() if not w[-1].isalnum() and w[-1] not in ".,;:?") / n,
        sum(k for w, k in counts.items() if w.isupper() and len(w) > 1) / n,
        sum(k for w, k in counts.items() if len(w) <= 3) / n,
        len(words) / max(1, len(SENTENCE.findall(text))),
        np.log1p(size / max(1, len(lines))),
        len(set(lines)) / max(1, len(lines)),
        np.log1p(max(map(len, counts), default=0)),
    ]


def matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t) for t in texts], np.float64).reshape(len(texts), len(FEATURES))


def held_out(id_col: str = "doc_id") -> Column:
    """True for ids whose labels are never learned from; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample: int = SAMPLE,
) -> gam.Model:
    """A model from the labelled documents that are not held out."""
    short_batches(docs.sparkSession)
    key, label = F.col(id_col).cast("long").alias("key"), F.col(label_col).cast("int").alias("label")
    known = labels.filter(F.col(id_col).isNotNull() & ~held_out(id_col)).select(key, label).filter("label in (0, 1)").distinct()
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}  # two rows at most
    order = F.xxhash64("key", F.lit("quality"))
    # At most `sample` rows of each label, so this can be broadcast whatever the size of the tables.
    chosen = [known.filter(F.col("label") == v).orderBy(order, "key").limit(sample) for v in (0, 1)]
    texts = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen[0].union(chosen[1])), "key").select("label", F.xxhash64("key", "text").alias("place"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(2).to_pylist())
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), values], ["label", "place", "x"])

    described = rows.mapInArrow(run, "label int, place long, x array<double>")
    # An id may have any number of rows: the bound holds for them too.
    found = [r for v in (0, 1) for r in described.filter(F.col("label") == v).orderBy("place", "x").limit(sample).collect()]
    x = np.array([r["x"] for r in found], np.float64).reshape(len(found), len(FEATURES))
    y = np.array([r["label"] for r in found], np.int64)
    taken = np.maximum(np.bincount(y, minlength=2), 1)
    total = max(1, sum(counts.values()))
    weight = np.array([len(found) * counts.get(v, 0) / total / taken[v] for v in (0, 1)])
    return gam.fit(x, y, weight[y])


def score(docs: DataFrame, model: gam.Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score (0 to 1), predicted (1 if the score is 0.5 or more)."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.scores(matrix(batch.column(2).to_pylist()))
            columns = [batch.column(0), batch.column(1), pa.array(found), pa.array((found >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long"), held_out(id_col), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
