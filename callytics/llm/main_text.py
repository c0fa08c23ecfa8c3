"""Main text of web pages by wrapper induction.

Pages of one host and layout (the class names of their containers) are aligned with a typical page of these by simple
tree matching of their block trees. Blocks of the reference that have the same text on nearly all pages are template; all
others are slots, whose text varies from page to page and is content. There is a template only where some slot varies on
most of the pages: an article that is published many times with a change here or there has no such slot, so it isn't taken
for template. What tags and class names tell to be no article is left out before.

Only skeletons of pages (labels, and hashes of texts) are shuffled, each different page of a host once. The blocks
to leave out are joined back to the pages; pages are parsed a second time, so no texts are stored on the way.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from callytics.llm.common import short_batches, stored
from callytics.llm.html_tree import content, leaves, match, parse, skeleton

#: A block is template if this share of the voting pages has it, and if that are this many pages at least.
SHARE = 0.9
PAGES = 5
#: A slot that varies on this share of the pages shows that they are different pages.
VARIES = 0.5
#: Containers down to this depth tell the layout.
DEPTH = 4


def host_of(url_col: str = "url") -> Column:
    """Host in lower case; empty without one."""
    return F.coalesce(F.regexp_extract(F.lower(F.col(url_col).cast("string")), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def extract(html: str | None, template: frozenset[int] = frozenset()) -> str:
    """Main text of a page without the blocks of these numbers."""
    texts = leaves(*content(parse(html)))
    return "\n".join(t for i, t in enumerate(texts) if i not in template)


def layout(tree: list) -> str:
    """Labels with class names of the containers near the top of a skeleton, each once."""
    found, level = set(), [tree]
    for _ in range(DEPTH):
        level = [x for x in level if len(x) == 2]
        found.update(x[0] for x in level if "." in x[0])
        level = [c for x in level for c in x[1]]
    return " ".join(sorted(found))


def skeletons(pages: DataFrame, html_col: str, url_col: str) -> DataFrame:
    """host (host and layout), k (key of the html), nodes, tree of each different page of each host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, nodes, trees = [], [], []
            for host, html in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                tree, n = skeleton(*content(parse(html)))
                hosts.append(f"{host} {layout(tree)}")
                nodes.append(n)
                trees.append(json.dumps(tree, separators=(",", ":"), ensure_ascii=False))
            columns = [pa.array(hosts, pa.string()), batch.column(1), pa.array(nodes, pa.int32()), pa.array(trees, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["host", "k", "nodes", "tree"])

    html = F.col(html_col).cast("string")
    rows = pages.select(host_of(url_col).alias("host"), F.unhex(F.md5(html)).alias("k"), html.alias("html")).filter(
        "host <> '' and k is not null"
    )
    return rows.mapInArrow(run, "host string, k binary, nodes int, tree string").dropDuplicates(["host", "k"])


def references_of(trees: DataFrame) -> DataFrame:
    """host, ref, reference: of each host and layout a page with about the usual number of nodes."""
    usual = trees.groupBy("host").agg(F.percentile_approx("nodes", 0.5).alias("usual"))
    nearest = F.min(F.struct(F.abs(F.col("nodes") - F.col("usual")).alias("off"), "k", "tree")).alias("r")
    return trees.join(usual, "host").groupBy("host").agg(nearest).select("host", F.col("r.k").alias("ref"), F.col("r.tree").alias("reference"))


def aligned(trees: DataFrame, references: DataFrame) -> DataFrame:
    """host, k, votes, slots: the blocks of each page (own) in the slots of the reference (ref), with hashes of their texts
    (h). Copies, whose texts are all the reference's, don't vote."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            votes, slots = [], []
            for k, ref, tree, reference in zip(frame["k"], frame["ref"], frame["tree"], frame["reference"]):
                a, b = json.loads(tree), json.loads(reference)
                pairs, texts = match(a, b), _leaves(a)
                same = sum(equal for _, _, equal in pairs)
                votes.append(k == ref or same < max(len(texts), len(_leaves(b))))
                slots.append([{"own": x, "ref": y, "h": texts[x]} for x, y, _ in pairs])
            yield frame[["host", "k"]].assign(votes=votes, slots=slots)

    both = trees.join(references, "host").select("host", "k", "ref", "tree", "reference")
    return both.mapInPandas(run, "host string, k binary, votes boolean, slots array<struct<own: int, ref: int, h: long>>")


def _leaves(tree: list) -> dict[int, int]:
    """Hashes of the texts of a skeleton by the numbers of the blocks."""
    found, todo = {}, [tree]
    while todo:
        x = todo.pop()
        if len(x) == 3:
            found[x[1]] = x[2]
        else:
            todo.extend(x[1])
    return found


def template_blocks(pages: DataFrame, html_col: str = "html", url_col: str = "url", share: float = SHARE, least: int = PAGES) -> DataFrame:
    """k, template: numbers of the blocks of each page that belong to the template of its host and layout, with `site`, the
    host. Pages without any have no row."""
    trees = stored(skeletons(pages, html_col, url_col), "skeletons")
    pages_ = stored(aligned(trees, stored(references_of(trees), "references")), "aligned")
    voters = pages_.filter("votes").groupBy("host").agg(F.count("*").alias("pages")).filter(F.col("pages") >= least)
    slots = pages_.join(voters, "host").select("host", "k", "votes", "pages", F.explode("slots").alias("s")).select("host", "k", "votes", "pages", "s.*")
    # The most frequent text of each slot, and the number of pages that have it.
    texts = slots.filter("votes").groupBy("host", "pages", "ref", "h").agg(F.count("*").alias("n"))
    usual = stored(texts.groupBy("host", "pages", "ref").agg(F.max(F.struct("n", "h")).alias("u")).select("host", "pages", "ref", "u.*"), "usual")
    varied = usual.groupBy("host").agg(F.min(F.col("n") / F.col("pages")).alias("low")).filter(F.col("low") <= 1 - VARIES)
    constant = usual.filter((F.col("n") >= share * F.col("pages")) & (F.col("n") >= least)).join(varied, "host", "left_semi")
    found = slots.join(constant.select("host", "ref", "h"), ["host", "ref", "h"], "left_semi")
    site = F.substring_index("host", " ", 1).alias("site")
    return found.groupBy("host", "k").agg(F.collect_set("own").alias("template")).select(site, "k", "template")


def main_texts(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", share: float = SHARE, least: int = PAGES
) -> DataFrame:
    """One row per row of `pages`: page_id, url, text, n_chars. Null and empty pages have an empty text; pages without a
    host are read by tags alone."""
    short_batches(pages.sparkSession)
    template = stored(template_blocks(pages, html_col, url_col, share, least), "blocks")
    html = F.col(html_col).cast("string")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"),
        host_of(url_col).alias("host"), F.unhex(F.md5(html)).alias("k"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column(3).to_pylist()
            texts = [extract(h, frozenset(b or ())) for h, b in zip(batch.column(2).to_pylist(), blocks)]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    joined = rows.join(template.withColumnRenamed("site", "host"), ["host", "k"], "left").select("page_id", "url", "html", "template")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
