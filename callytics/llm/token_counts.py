"""Edit-aware token counts: a segment tree per document, of which an edit renews only what it touches.

A text is cut at safe places (see `tokens`) into leaves of LEAF characters or a little more. The tree over the leaves holds
the characters and tokens below each node, as two heap-ordered arrays: node i has children 2i and 2i+1, node 1 is the whole
document. An edit finds its leaves by character sums, takes in the leaf beside it where it meets a leaf's first or last
character (so that the cuts around stay safe), encodes the new text of these leaves only and adds the differences on the
paths to the root. Counts stay exactly those of encoding the whole new text. Leaves of many documents are encoded together.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from callytics.llm.common import short_batches
from callytics.llm.tokens import Encoder, batch_encoder, default_tokenizer, safe_parts

LEAF = 512
#: A leaf that has grown to so many times its size is cut anew, and the tree is built again from the sums of its leaves.
GROWN = 8

EDITS = "array<struct<seq: long, start: long, remove: long, insert: string>>"
TREE = "chars array<long>, tokens array<long>"


def leaves_of(text: str, leaf: int = LEAF) -> list[str]:
    return safe_parts(text, leaf)


class Tree:
    """Sums of characters and tokens over leaves."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.size = len(chars) // 2
        self.chars, self.tokens = chars, tokens

    @classmethod
    def build(cls, leaves: list[tuple[int, int]]) -> Tree:
        size = 1
        while size < len(leaves):
            size *= 2
        tree = cls([0] * (2 * size), [0] * (2 * size))
        for i, (c, t) in enumerate(leaves):
            tree.chars[size + i], tree.tokens[size + i] = c, t
        for i in range(size - 1, 0, -1):
            tree.chars[i] = tree.chars[2 * i] + tree.chars[2 * i + 1]
            tree.tokens[i] = tree.tokens[2 * i] + tree.tokens[2 * i + 1]
        return tree

    def find(self, place: int) -> tuple[int, int]:
        """Leaf of the character at `place`, and the characters before the leaf."""
        i, before = 1, 0
        while i < self.size:
            i *= 2
            if place - before >= self.chars[i]:
                before += self.chars[i]
                i += 1
        return i - self.size, before

    def add(self, leaf: int, chars: int, tokens: int) -> None:
        i = self.size + leaf
        while i:
            self.chars[i] += chars
            self.tokens[i] += tokens
            i //= 2

    def leaves(self) -> list[tuple[int, int]]:
        return list(zip(self.chars[self.size :], self.tokens[self.size :]))

    def renew(self, first: int, last: int, new: list[tuple[int, int]], leaf: int = LEAF) -> Tree:
        """The tree with new leaves for those from `first` to `last`; the same one if the first leaf takes the new text."""
        if sum(chars for chars, _ in new) > GROWN * leaf:
            old = self.leaves()
            return Tree.build([x for x in old[:first] + new + old[last + 1 :] if x[0]] or [(0, 0)])
        # The others become empty.
        ((chars, tokens),) = new
        for i in range(first + 1, last + 1):
            self.add(i, -self.chars[self.size + i], -self.tokens[self.size + i])
        at = self.size + first
        self.add(first, chars - self.chars[at], tokens - self.tokens[at])
        return self


def touched(text: str, tree: Tree, start: int, remove: int, insert: str, leaf: int = LEAF) -> tuple[str, int, int, list[str]]:
    """The text after an edit, the first and last leaf it touches, and the new text of these leaves: whole, or cut into
    leaves if it has grown too long. Places beyond the text count as its end."""
    n = len(text)
    start = min(max(start, 0), n)
    end = min(start + max(remove, 0), n)
    first, low = tree.find(max(start - 1, 0)) if n else (0, 0)
    last, before_last = tree.find(min(end, n - 1)) if n else (0, 0)
    high = before_last + tree.chars[tree.size + last]
    region = text[low:start] + insert + text[end:high]
    return text[:low] + region + text[high:], first, last, [region] if len(region) <= GROWN * leaf else leaves_of(region, leaf)


def edit(text: str, tree: Tree, start: int, remove: int, insert: str, encode: Encoder, leaf: int = LEAF) -> tuple[str, Tree, int]:
    """The text and tree after an edit, and how many characters were encoded. Places beyond the text count as its end."""
    ((text, tree, encoded),) = edit_all([text], [tree], [[(start, remove, insert)]], encode, leaf)
    return text, tree, encoded


def edit_all(
    texts: list[str], trees: list[Tree], edits: list[list[tuple[int, int, str]]], encode: Encoder, leaf: int = LEAF
) -> list[tuple[str, Tree, int]]:
    """The same for the edits of many texts. The first edits of all texts are encoded together, then the second ones."""
    texts, trees, encoded = list(texts), list(trees), [0] * len(texts)
    going, k = range(len(texts)), 0
    while going := [i for i in going if len(edits[i]) > k]:
        leaves = []
        for i in going:
            texts[i], *renewed = touched(texts[i], trees[i], *edits[i][k], leaf)
            leaves.append(renewed)
        tokens = encode.counts(p for *_, parts in leaves for p in parts)
        for i, (first, last, parts) in zip(going, leaves):
            trees[i] = trees[i].renew(first, last, [(len(p), next(tokens)) for p in parts], leaf)
            encoded[i] += sum(map(len, parts))
        k += 1
    return list(zip(texts, trees, encoded))


def trees_of(texts: list[str], encode: Encoder, leaf: int = LEAF) -> list[Tree]:
    """The trees of many texts, whose leaves are encoded together."""
    leaves = [leaves_of(t, leaf) for t in texts]
    tokens = encode.counts(p for parts in leaves for p in parts)
    return [Tree.build([(len(p), next(tokens)) for p in parts]) for parts in leaves]


def build_trees(docs: DataFrame, tokenizer: str | None = None, leaf: int = LEAF, text_col: str = "text") -> DataFrame:
    """All columns of `docs` with `chars` and `tokens`, the tree of the text; a null text is empty.

    Columns of `docs` with these names are replaced.
    """
    path = tokenizer or default_tokenizer()
    short_batches(docs.sparkSession)
    rows = docs.drop("chars", "tokens")
    place = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = batch_encoder(path)
        kind = pa.list_(pa.int64())
        for batch in batches:
            trees = trees_of([t or "" for t in batch.column(place).to_pylist()], encode, leaf)
            added = [pa.array([t.chars for t in trees], kind), pa.array([t.tokens for t in trees], kind)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "chars", "tokens"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, {TREE}")


def with_edits(trees: DataFrame, edits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Add to each document its edits (rows doc_id, seq, start, remove, insert), in order of `seq`.

    The edits of a document are one after another by nature and stay together. Ids of documents must be unique; edits
    without a document fall away.
    """
    each = edits.groupBy(F.col(id_col).alias("_edited_")).agg(
        F.sort_array(F.collect_list(F.struct("seq", "start", "remove", "insert"))).cast(EDITS).alias("edits")
    )
    return trees.drop("edits").join(each, trees[id_col] == each["_edited_"], "left").drop("_edited_")


def apply_edits(
    trees: DataFrame, tokenizer: str | None = None, leaf: int = LEAF, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Renew documents with a tree by their column `edits`, in order; a null list changes nothing, nulls within count as 0.

    doc_id, text (new), chars, tokens (new tree), n_tokens (before), edited_chars, edited_tokens, encoded_chars (how many
    characters were encoded for all edits together).
    """
    path = tokenizer or default_tokenizer()
    short_batches(trees.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = batch_encoder(path)
        kinds = [pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.int64()] * 4]
        names = ["doc_id", "text", "chars", "tokens", "n_tokens", "edited_chars", "edited_tokens", "encoded_chars"]
        for batch in batches:
            ids, texts, chars, tokens, edits = (c.to_pylist() for c in batch.columns)
            before = [t[1] for t in tokens]
            lists = [[(e["start"] or 0, e["remove"] or 0, e["insert"] or "") for e in some or ()] for some in edits]
            edited = edit_all([t or "" for t in texts], list(map(Tree, chars, tokens)), lists, encode, leaf)
            rows = [
                (doc, text, tree.chars, tree.tokens, n, tree.chars[1], tree.tokens[1], encoded)
                for doc, n, (text, tree, encoded) in zip(ids, before, edited)
            ]
            columns = zip(*rows) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    rows = trees.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), "chars", "tokens", F.col("edits").cast(EDITS))
    out = f"doc_id long, text string, {TREE}, n_tokens long, edited_chars long, edited_tokens long, encoded_chars long"
    return rows.mapInArrow(run, out)

