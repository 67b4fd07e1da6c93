"""Token counts by separator scan over flat, unindexed token files.

A file is nothing but token ids, documents closed by an end-of-document id. Blocks of a file are read by byte range, the
separators of a block are found by one vectorised comparison, and documents that cross blocks are stitched by a prefix
scan over the blocks: how many separators came before, and where the last one was.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, shared_folder
from .encode import Encoder
from .packing import default_tokenizer
from .registry import query, table

END_OF_DOCUMENT = 49407  # <|endoftext|>
BLOCK_BYTES = 4 << 20
FILE_TOKENS = 64 << 20


def open_store(path: str):
    """(file system, path in it) of a URI or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def token_width(tokenizer: str) -> int:
    """Bytes of a token in a file: 2 where every id of the vocabulary fits, else 4."""
    from tokenizers import Tokenizer

    return 2 if max(Tokenizer.from_file(tokenizer).get_vocab().values()) < 1 << 16 else 4


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end: int = END_OF_DOCUMENT, file_tokens: int = FILE_TOKENS,
    key: str = "doc_id", text: str = "text", width: int | None = None,
) -> DataFrame:
    """Write unsigned token files of ``width`` bytes a token (``token_width`` of the tokenizer) to a shared ``folder``.

    Returns (file, ordinal, key), already computed. Special-token strings inside a text are ordinary text, so ``end`` closes
    documents only; null text is empty, a null key and repeated rows are documents like any other, an empty table gives no
    file, other columns are not read. A repeated task writes files of its own, and only those of the attempt that counts are
    in the result.
    """
    width = width or token_width(tokenizer)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    key_type = rows.schema["key"].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, context = Encoder.of(tokenizer, specials=False), TaskContext.get()
        store, place = open_store(folder)
        store.create_dir(place, recursive=True)
        out, name, ordinal, size, made = None, "", 0, 0, 0
        for batch in batches:
            files: list[str] = []
            ordinals: list[int] = []
            for _, at, ids in encoder.encode(batch.column(1), end):
                if out is None or size >= file_tokens:
                    if out is not None:
                        out.close()
                    name = f"tokens-{context.partitionId():06d}-{made:04d}-{uuid.uuid4().hex}.bin"
                    out, ordinal, size, made = store.open_output_stream(f"{place}/{name}"), 0, 0, made + 1
                out.write(ids.astype(f"<u{width}").tobytes())
                n = len(at) - 1
                files += [name] * n
                ordinals += range(ordinal, ordinal + n)
                ordinal += n
                size += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(ordinals, pa.int64()), batch.column(0)], ["file", "ordinal", "key"])
        if out is not None:
            out.close()

    return cut_lineage(rows.mapInArrow(write, f"file string, ordinal long, key {key_type}")).withColumnRenamed("key", key)


def scan_token_files(spark: SparkSession, folder: str, end: int = END_OF_DOCUMENT, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, ordinal, start, n_tokens, terminated) of every document of the .bin files of a folder.

    ``n_tokens`` leaves the separator out and is 0 between two separators. Tokens after a file's last separator form one
    more document with ``terminated`` false. A file whose size is no multiple of ``width`` is an error; an
    empty file has no documents. Files may be of any size: a task holds one block.
    """
    block_bytes -= block_bytes % width
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select("path", "length")
    blocks = listed.where("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(block_bytes).cast("long"))).alias("start"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if length % width:
                    raise ValueError(f"{path}: {length} bytes are no whole number of {width}-byte tokens")
                store, place = open_store(path)
                with store.open_input_file(place) as source:
                    data = source.read_at(min(block_bytes, length - start), start)
                at = np.flatnonzero(np.frombuffer(data, f"<u{width}") == end) + start // width
                tokens = len(data) // width
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path.rsplit("/", 1)[-1]]),
                        pa.array([start // width]),
                        pa.array([tokens]),
                        pa.array([len(at)]),
                        pa.array([int(at[-1]) if len(at) else None], pa.int64()),
                        pa.array([np.concatenate(([-1], at[:-1] + 1))[: len(at)]], pa.list_(pa.int64())),
                        pa.array([at], pa.list_(pa.int64())),
                    ],
                    ["file", "block", "tokens", "n", "last", "begins", "ends"],
                )

    schema = "file string, block long, tokens long, n long, last long, begins array<bigint>, ends array<bigint>"
    found = cut_lineage(blocks.repartition(parts, "path", "start").mapInArrow(scan, schema))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = found.select(
        "file",
        "block",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"),
        F.coalesce(F.max("last").over(before), F.lit(-1)).alias("previous"),
    )
    closed = (
        found.where("n > 0")
        .join(carried, ["file", "block"])
        .select("file", "first", "previous", F.posexplode(F.arrays_zip("begins", "ends")).alias("i", "x"))
        .select(
            "file",
            (F.col("first") + F.col("i")).alias("ordinal"),
            F.when(F.col("i") == 0, F.col("previous") + 1).otherwise(F.col("x.begins")).alias("start"),
            F.col("x.ends").alias("end"),
        )
        .select("file", "ordinal", "start", (F.col("end") - F.col("start")).alias("n_tokens"), F.lit(True).alias("terminated"))
    )
    rest = (
        found.groupBy("file")
        .agg(F.sum("n").alias("ordinal"), (F.coalesce(F.max("last"), F.lit(-1)) + 1).alias("start"), F.max(F.col("block") + F.col("tokens")).alias("end"))
        .where("end > start")
        .select("file", "ordinal", "start", (F.col("end") - F.col("start")).alias("n_tokens"), F.lit(False).alias("terminated"))
    )
    return closed.unionByName(rest)


@query("op4_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and n_tokens of every document, counted in flat token files written from the table."""
    folder = shared_folder(spark, "token-files")
    written = write_token_files(table(spark, sf_dir, "documents"), folder, default_tokenizer())
    counted = scan_token_files(spark, folder, width=token_width(default_tokenizer()))
    return written.join(counted, ["file", "ordinal"]).select("doc_id", "n_tokens")
