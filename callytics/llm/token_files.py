"""Token ids as binary files: one zstandard frame per document, with a dictionary that all files share.

A shard is a pair of files. `<name>.ids` holds a 16-byte head (magic, first 8 bytes of the SHA-256 of the
dictionary) and then the frames of its documents. `<name>.index` is an Arrow IPC file with a row per document:
doc_id, offset and size of its frame, and start and number of its ids within the shard; batches are short, so a
reader never holds a whole index. `dictionary.zstd` holds the dictionary. The manifest, a Parquet table with a row
per shard, names the shards that count; what a lost or repeated task left behind is not in it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from callytics.llm.common import partitions_of, short_batches
from callytics.llm.tokens import batch_encoder, default_tokenizer, larger

MAGIC = b"TOKIDS01"
END_ID = 2
#: Documents the dictionary is trained on, characters taken of each, and its size. It changes sizes of files only.
SAMPLE_DOCUMENTS = 1_000
SAMPLE_CHARS = 8_192
DICTIONARY_BYTES = 32 << 10
LEVEL = 1
INDEX_ROWS = 4_096

INDEX = pa.schema(
    [("doc_id", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())]
)
MANIFEST = "shard int, name string, n_docs long, n_tokens long, low long, high long, bytes long"
READ = "doc_id long, start long, n_tokens long, ids binary"


def _open(folder: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(folder)


def train_dictionary(docs: DataFrame, tokenizer: str, id_col: str, text_col: str) -> bytes:
    """A dictionary of serialized id arrays of about SAMPLE_DOCUMENTS documents, chosen by a hash; empty if they are too few."""
    import zstandard

    share = min(1.0, SAMPLE_DOCUMENTS / max(1, docs.count()))
    text = F.substring(F.col(text_col).cast("string"), 1, SAMPLE_CHARS)
    place = F.pmod(F.xxhash64(F.col(id_col), F.lit("dictionary")), F.lit(1 << 40))
    chosen = docs.filter(place < int(share * (1 << 40))).select(text.alias("text")).orderBy("text").limit(2 * SAMPLE_DOCUMENTS)
    texts = pa.array([r["text"] for r in chosen.collect()], pa.string())
    samples = [ids for ids in batch_encoder(tokenizer).batch(texts) if ids]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def digest(dictionary: bytes) -> bytes:
    return hashlib.sha256(dictionary).digest()[:8]


def write_tokens(
    docs: DataFrame,
    folder: str,
    tokenizer: str | None = None,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Encode whole texts into shards in ascending order of their ids. Returns the manifest.

    Each row is a document, repeated and null ids too; a null id comes first. A null text is empty, and an empty
    text is the end id alone. An empty table gives an empty manifest.
    """
    import zstandard

    spark, path = docs.sparkSession, tokenizer or default_tokenizer()
    short_batches(spark)
    dictionary = train_dictionary(docs, path, id_col, text_col)
    files, root = _open(folder)
    files.create_dir(root)
    with files.open_output_stream(f"{root}/dictionary.zstd") as out:
        out.write(dictionary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, name = TaskContext.get().partitionId(), f"shard-{uuid4().hex}"
        files, root = _open(folder)
        end = np.array([end_id], dtype="<u4").tobytes()
        shared = zstandard.ZstdCompressionDict(dictionary)
        if dictionary:
            shared.precompute_compress(level=LEVEL)
        compress = zstandard.ZstdCompressor(level=LEVEL, **({"dict_data": shared} if dictionary else {})).compress
        out = index = None
        rows: list[tuple] = []
        place, start, n_docs, low, high = 16, 0, 0, None, None

        def flush() -> None:
            if rows:
                index.write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=INDEX))
                rows.clear()

        encode = batch_encoder(path).batch
        for batch in larger(batches):
            for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1))):
                if out is None:
                    out = files.open_output_stream(f"{root}/{name}.ids")
                    sink = files.open_output_stream(f"{root}/{name}.index")
                    index = pa.ipc.new_file(sink, INDEX)
                    out.write(MAGIC + digest(dictionary))
                    low = doc
                ids += end
                frame = compress(ids)
                out.write(frame)
                rows.append((doc, place, len(frame), start, len(ids) // 4))
                place, start, n_docs, high = place + len(frame), start + len(ids) // 4, n_docs + 1, doc
                if len(rows) == INDEX_ROWS:
                    flush()
        if out is not None:
            flush()
            index.close()
            sink.close()
            out.close()
            kinds = [pa.int32(), pa.string(), *[pa.int64()] * 5]
            row = (shard, name, n_docs, start, low, high, place)
            names = ["shard", "name", "n_docs", "n_tokens", "low", "high", "bytes"]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names)

    tie = F.xxhash64(F.col(text_col).cast("string"))
    ordered = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), tie.alias("tie"))
        .repartitionByRange(partitions_of(spark), "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
    )
    ordered.mapInArrow(write, MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_tokens(spark: SparkSession, folder: str, ids: list[int] | None = None) -> DataFrame:
    """Documents of a written folder: doc_id, start (ids of all documents before it), n_tokens, ids.

    With `ids`, only frames of these documents are read, from shards whose range holds one of them.
    """
    import zstandard

    shards, start = [], 0
    for r in spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").orderBy("shard").collect():  # a row per shard
        within = ids is None or any(r["low"] is not None and r["low"] <= i <= r["high"] for i in ids)
        within = within or (r["low"] is None and r["high"] is not None and any(i <= r["high"] for i in ids))
        if within:
            shards.append((r["name"], start))
        start += r["n_tokens"]
    wanted = None if ids is None else set(ids)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(folder)
        with files.open_input_stream(f"{root}/dictionary.zstd") as f:
            dictionary = f.read()
        known = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        expand = zstandard.ZstdDecompressor(**known).decompress
        for batch in batches:
            for name, begin in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with files.open_input_file(f"{root}/{name}.ids") as data, files.open_input_file(f"{root}/{name}.index") as f:
                    if data.read(16) != MAGIC + digest(dictionary):
                        raise ValueError(f"{name}: not a shard of this dictionary")
                    index = pa.ipc.open_file(f)
                    for k in range(index.num_record_batches):
                        part = index.get_batch(k)
                        rows = part.to_pylist()
                        if wanted is not None:
                            rows = [r for r in rows if r["doc_id"] in wanted]
                        for at in range(0, len(rows), 256):
                            some = rows[at : at + 256]
                            found = [expand(data.read_at(r["size"], r["offset"])) for r in some]
                            yield pa.RecordBatch.from_arrays(
                                [
                                    pa.array([r["doc_id"] for r in some], pa.int64()),
                                    pa.array([begin + r["start"] for r in some], pa.int64()),
                                    pa.array([r["n_tokens"] for r in some], pa.int64()),
                                    pa.array(found, pa.binary()),
                                ],
                                ["doc_id", "start", "n_tokens", "ids"],
                            )

    rows = spark.sparkContext.parallelize(shards, max(1, len(shards)))  # a task per shard
    return spark.createDataFrame(rows, "name string, begin long").mapInArrow(read, READ)


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and CRC-32 of the ids."""
    return tokens.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


__all__ = ["write_tokens", "read_tokens", "checksums", "train_dictionary"]
