"""The operators as queries over the given tables, and SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from callytics.llm import (
    decontamination,
    fingerprints,
    language,
    licenses,
    main_text,
    near_duplicates,
    packing,
    quality,
    spellings,
    token_counts,
    token_files,
    warc,
    whitening,
)
from callytics.llm.common import new_folder, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document before and after three edits, of which only the touched regions are encoded.

    The edits: up to 40 characters after the first third give way to the first 30 characters in reverse; the source is put
    in front; the language is put at the end.
    """
    edit = lambda seq, start, remove, insert: (
        f"named_struct('seq', {seq}L, 'start', cast({start} as bigint), 'remove', {remove}L, 'insert', {insert})"
    )
    n = "coalesce(char_length(text), 0)"
    edits = ", ".join(
        (
            edit(0, f"{n} div 3", 40, "reverse(left(text, 30))"),
            edit(1, 0, 0, "concat(source, ' ')"),
            edit(2, 1 << 40, 0, "concat('\\n', lang)"),
        )
    )
    docs = table(spark, folder, "documents").select("doc_id", "text", F.expr(f"array({edits})").alias("edits"))
    edited = token_counts.apply_edits(token_counts.build_trees(docs))
    return edited.select("doc_id", "n_tokens", "edited_chars", "edited_tokens", "encoded_chars")


def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of at most 2,048 tokens, id 0 after each document."""
    return packing.pack_documents(table(spark, folder, "documents"))


def op3_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """All documents written as binary token files and read back from them."""
    out = new_folder(spark, "tokens")
    token_files.write_tokens(table(spark, folder, "documents"), out)
    return token_files.checksums(token_files.read_tokens(spark, out))


def op4_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licences of all documents, taken as files source/lang/<hundreds of doc_id>/<doc_id>; those of at most 200 characters
    stand for licence files of their directory."""
    docs = table(spark, folder, "documents")
    name = F.when(F.char_length("text") <= 200, F.concat(F.lit("LICENSE-"), F.col("doc_id"))).otherwise(F.col("doc_id").cast("string"))
    path = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 100), name)
    files = docs.select("doc_id", "text", path.alias("path"))
    return licenses.scan(files).select("doc_id", "path", "own_license", "own_score", "license", "inherited_from")


def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    """All pages written as WARC archives, equal payloads once, and read back from them."""
    out = new_folder(spark, "warc")
    warc.write_pages(table(spark, folder, "pages"), out)
    return warc.page_records(warc.read_records(spark, out))


def op6_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of all pages."""
    return main_text.main_texts(table(spark, folder, "pages"))


def op7_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Class of near duplicates of each document."""
    return near_duplicates.near_duplicates(table(spark, folder, "documents"))


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold benchmark items."""
    return decontamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op9_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints.edited_fingerprints(table(spark, folder, "documents"))


def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from the documents that are not held out."""
    docs = table(spark, folder, "documents")
    return language.predict(docs, language.train(docs))


def op11_spellings(spark: SparkSession, folder: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return spellings.variants(table(spark, folder, "documents"))


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """All embeddings projected on the leading components of their covariance."""
    vectors = table(spark, folder, "embeddings")
    return whitening.components(vectors, whitening.fit(vectors))


def op13_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document, learned from the labelled documents that are not held out."""
    docs = table(spark, folder, "documents")
    return quality.score(docs, quality.train(docs, table(spark, folder, "labels")))


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        op1_token_counts,
        op2_best_fit_packing,
        op3_token_files,
        op4_license_scan,
        op5_warc,
        op6_main_text,
        op7_near_duplicates,
        op8_decontamination,
        op9_fingerprints,
        op10_language,
        op11_spellings,
        op12_whitening,
        op13_quality,
    )
}
ORACLES: dict[str, str] = {
    "op5_warc": """
  select page_id, strlen(h) payload_bytes, sha256(h) payload_digest,
         case when strlen(h) >= 100 and page_id <> least_id then 'revisit' else 'response' end record_type,
         case when strlen(h) >= 100 and page_id <> least_id then least_id end refers_to
  from (select page_id, coalesce(html, '') h, min(page_id) over (partition by coalesce(html, '')) least_id from pages)"""
}
