"""Language identification by a convolutional network over bytes, trained and applied with numpy.

A text, in lower case and UTF-8, is read in windows of WINDOW bytes, all of them; the last is padded with zero bytes.
Filters of several widths slide over a window, the largest response of each counts, and a softmax layer gives
the languages. A document's probabilities are the means over its windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window, functions as F

from callytics.llm.common import short_batches

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8  # of each width
#: Bound of the training sample: documents of each language (chosen by a hash of id and text), and windows of each.
SAMPLE_DOCUMENTS = 1_500
SAMPLE_WINDOWS = 3
EPOCHS = 6
RATE = 0.01
BATCH = 128
SEED = 7
UNDETERMINED = "und"
#: Windows worked on at once.
CHUNK = 512

LETTER = regex.compile(r"\p{L}")


def windows(text: str) -> bytes:
    data = text.lower().encode()
    return data + b"\0" * (-len(data) % WINDOW)


@dataclass
class Model:
    """`filters[w]` has shape (w, 256, FILTERS): what each byte at each place adds to each filter of width w."""

    languages: list[str]
    filters: dict[int, np.ndarray]
    offset: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Responses by pairs of bytes: what the pair at a place adds, and the pair two places on."""
        f = self.filters
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1)
        none = np.zeros((256, FILTERS), np.float32)
        here = np.concatenate([pair(f[w][0], f[w][1]) for w in WIDTHS], axis=1)
        ahead = np.concatenate([pair(f[3][2], none), pair(f[4][2], f[4][3])], axis=1)
        return here + self.offset, ahead

    def probabilities(self, data: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """A row for each window of `data` (n, WINDOW)."""
        here, ahead = tables
        out = np.empty((len(data), len(self.languages)), np.float32)
        for at in range(0, len(data), CHUNK):
            some = data[at : at + CHUNK].astype(np.int32)
            pairs = some[:, :-1] * 256 + some[:, 1:]
            response = here[pairs[:, :-2]]
            response[:, :, FILTERS:] += ahead[pairs[:, 2:]]
            most = np.maximum(response.max(axis=1), 0)
            logits = most @ self.weights + self.bias
            e = np.exp(logits - logits.max(axis=1, keepdims=True))
            out[at : at + CHUNK] = e / e.sum(axis=1, keepdims=True)
        return out


def fit(data: np.ndarray, labels: np.ndarray, languages: list[str]) -> Model:
    """Train on windows (n, WINDOW) with labels 0..k-1, by Adam. Each language counts as much as another."""
    rng = np.random.default_rng(SEED)
    n, k, features = len(data), len(languages), FILTERS * len(WIDTHS)
    p = {w: rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
    p |= {"offset": np.zeros(features, np.float32), "bias": np.zeros(k, np.float32)}
    p["weights"] = rng.normal(0, 0.3, (features, k)).astype(np.float32)
    first = {name: np.zeros_like(v) for name, v in p.items()}
    second = {name: np.zeros_like(v) for name, v in p.items()}
    balance = (n / k / np.maximum(np.bincount(labels, minlength=k), 1)).astype(np.float32)
    reach, step = WINDOW - max(WIDTHS) + 1, 0
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            x, y = data[order[at : at + BATCH]].astype(np.int64), labels[order[at : at + BATCH]]
            rows = np.arange(len(x))
            maxima, places = [], []
            for j, w in enumerate(WIDTHS):
                r = sum(p[w][i][x[:, i : i + reach]] for i in range(w))
                places.append(r.argmax(axis=1))
                maxima.append(np.take_along_axis(r, places[-1][:, None, :], 1)[:, 0])
            raw = np.concatenate(maxima, axis=1) + p["offset"]
            hidden = np.maximum(raw, 0)
            logits = hidden @ p["weights"] + p["bias"]
            e = np.exp(logits - logits.max(axis=1, keepdims=True))
            error = e / e.sum(axis=1, keepdims=True)
            error[rows, y] -= 1
            error *= (balance[y] / len(x))[:, None]
            back = (error @ p["weights"].T) * (raw > 0)
            grads = {"weights": hidden.T @ error, "bias": error.sum(0), "offset": back.sum(0)}
            for j, w in enumerate(WIDTHS):
                grads[w] = np.zeros_like(p[w])
                part = back[:, j * FILTERS : (j + 1) * FILTERS]
                for i in range(w):
                    byte = x[rows[:, None], places[j] + i]
                    np.add.at(grads[w][i], (byte, np.arange(FILTERS)[None, :]), part)
            step += 1
            for name, g in grads.items():
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                p[name] -= RATE * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
    return Model(languages, {w: p[w] for w in WIDTHS}, p["offset"], p["weights"], p["bias"])


def sample(docs: DataFrame, chosen: Column, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """Training windows (lang, window): of each language about SAMPLE_DOCUMENTS documents that are `chosen`.

    A hash of id and text decides, against a share for each language, so no language is brought together. Rows that repeat
    share a hash; at most SAMPLE_DOCUMENTS * SAMPLE_WINDOWS windows of a language are taken, those of the least hashes.
    """
    lang, text = F.col(lang_col).cast("string"), F.col(text_col).cast("string")
    labelled = docs.filter(chosen & lang.isNotNull())
    counts = labelled.groupBy(lang.alias("lang")).agg(F.count("*").alias("n")).collect()  # a row for each language
    shares = [F.lit(x) for r in counts for x in (r["lang"], min(1.0, SAMPLE_DOCUMENTS / r["n"]))] or [F.lit(""), F.lit(0.0)]
    place = F.pmod(F.xxhash64(F.col(id_col), text, F.lit("language")), F.lit(1 << 40)) / float(1 << 40)
    picked = labelled.filter(place < F.element_at(F.create_map(*shares), lang))
    texts = picked.select(lang.alias("lang"), place.alias("place"), text.alias("text")).filter(F.col("text").rlike(r"\p{L}"))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, places, found = [], [], []
            for lang, place, text in zip(*(c.to_pylist() for c in batch.columns)):
                data = windows(text)
                n = len(data) // WINDOW
                for i in sorted({round(j * (n - 1) / max(1, SAMPLE_WINDOWS - 1)) for j in range(SAMPLE_WINDOWS)}):
                    langs.append(lang)
                    places.append(place)
                    found.append(data[i * WINDOW : (i + 1) * WINDOW])
            columns = [pa.array(langs, pa.string()), pa.array(places, pa.float64()), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "place", "window"])

    # Spark keeps no more of a language per task before the shuffle either.
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", "window"))
    taken = texts.mapInArrow(some, "lang string, place double, window binary").withColumn("rank", rank)
    return taken.filter(F.col("rank") <= SAMPLE_DOCUMENTS * SAMPLE_WINDOWS).select("lang", "window")


def held_out(id_col: str = "doc_id") -> Column:
    """True for ids that are never trained on; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model from the labelled documents that are not held out; None where there is none."""
    short_batches(docs.sparkSession)
    chosen = F.col(id_col).isNotNull() & ~held_out(id_col)
    rows = sample(docs, chosen, id_col, text_col, lang_col).orderBy("lang", "window").toPandas()
    if rows.empty:
        return None
    languages = sorted(rows["lang"].unique())
    data = np.frombuffer(b"".join(rows["window"]), np.uint8).reshape(-1, WINDOW)
    labels = np.searchsorted(languages, rows["lang"].to_numpy(dtype=object))
    return fit(data, labels.astype(np.int64), languages)


def scorer(model: Model | None):
    """A function from texts to (languages, scores). Null texts and texts without letters are `und`, score 0."""
    tables = model.tables() if model else None

    def score(texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        if model is None:
            return names, scores
        at = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
        k = 0
        while k < len(at):  # texts are gathered up to some megabytes
            parts, some, size = [], [], 0
            while k < len(at) and (size < 1 << 22):
                parts.append(windows(texts[at[k]]))
                some.append(at[k])
                size += len(parts[-1])
                k += 1
            data = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, WINDOW)
            counts = np.array([len(p) // WINDOW for p in parts])
            begins = np.concatenate([[0], np.cumsum(counts)[:-1]])
            mean = np.add.reduceat(model.probabilities(data, tables), begins, axis=0) / counts[:, None]
            best = mean.argmax(axis=1)
            for i, b, m in zip(some, best, mean):
                names[i], scores[i] = model.languages[b], min(1.0, float(m[b]))
        return names, scores

    return score


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, lang_pred, score. Whole texts are read."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(model)
        for batch in batches:
            names, scores = score(batch.column(2).to_pylist())
            columns = [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long"), held_out(id_col), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_languages(docs: DataFrame, model: Model | None, least: float = 0.4, text_col: str = "text") -> DataFrame:
    """Rows of `docs`, all columns, whose language is told with at least this score; texts without letters go.

    Without a model only texts without letters go.
    """
    short_batches(docs.sparkSession)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(model)
        for batch in batches:
            texts = batch.column(place).to_pylist()
            if model is None:
                kept = [bool(t and LETTER.search(t)) for t in texts]
            else:
                names, scores = score(texts)
                kept = [n != UNDETERMINED and s >= least for n, s in zip(names, scores)]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
