"""Token counts per document of flat token files, found by scanning for the separator.

A token file is nothing but token ids, little-endian, two bytes each; a
separator id ends every document. There is no index. Files are cut into blocks
of fixed size that tasks read independently:

1. each block is searched for separators with one vectorised comparison, which
   gives the lengths of the documents inside it and what sticks out on either side;
2. a prefix scan over the block summaries of a file tells each block how many
   documents ended before it and how many tokens of an open one lie before it;
3. that is added to the block's first document.

Only summaries are shuffled. A file of any size is spread over all tasks; the prefix scan of one
file sees one row of a few numbers per block, and the lengths inside blocks are joined to its results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chartmill.llm.common import col, small_batches, text_of, work_dir, written
from chartmill.llm.tokens import END_OF_DOCUMENT, default_vocabulary, token_ids

TOKEN_BYTES = 2
BLOCK_TOKENS = 1 << 20

MAX_ID = 256**TOKEN_BYTES - 1

_SUMMARY = "file string, block long, first_token long, size long, n_sep long, head long, tail long, inner array<long>"
_LIGHT = ("file", "block", "first_token", "size", "n_sep", "head", "tail")


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared path; ``file:/x`` is Hadoop's way to write ``file:///x``."""
    uri = re.sub(r"^file:/(?!/)", "file:///", uri)
    return fs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


def write_token_files(
    docs: DataFrame, target: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None
) -> DataFrame:
    """Tokenise documents into flat files under ``target``, one per partition.

    Returns (file, ordinal, id): which document each stretch of a file is. NULL
    text is written as an empty document; strings of special tokens inside a text
    are ordinary text, so a separator never occurs within a document. An id that two bytes cannot hold
    stops the job; vocabularies of more than 65,536 ids need wider files. A task
    that is run again writes the same file under a temporary name and moves it
    over the first.
    """
    small_batches(docs.sparkSession)
    vocabulary = vocabulary or default_vocabulary()
    source = docs.select(col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}.bin"
        system, folder = _open(target)
        system.create_dir(folder, recursive=True)
        draft = f"{folder}/.{name}.{context.taskAttemptId()}"
        ordinal = 0
        with system.open_output_stream(draft) as out:
            for batch in batches:
                for text in batch.column("text").to_pylist():
                    ids = token_ids(text, vocabulary, specials_as_text=True)
                    if len(ids) and ids.max() > MAX_ID:
                        raise ValueError(f"token id {ids.max()} does not fit {TOKEN_BYTES} bytes")
                    out.write(np.append(ids, END_OF_DOCUMENT).astype("<u2").tobytes())
                count = len(batch)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * count), pa.array(range(ordinal, ordinal + count), pa.int64()), batch.column(0)],
                    names=["file", "ordinal", "doc_id"],
                )
                ordinal += count
        system.move(draft, f"{folder}/{name}")

    return source.mapInArrow(work, "file string, ordinal long, doc_id long")


def token_blocks(spark: SparkSession, folder: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per block of every ``*.bin`` file: path, block, and the file's number of tokens.

    Only names and sizes are read here. A trailing odd byte is no token.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select("path", "length")
    tokens = F.floor(F.col("length") / TOKEN_BYTES).cast("long")
    last = F.floor((F.col("tokens") - 1) / block_tokens).cast("long")
    return (
        files.withColumn("tokens", tokens)
        .filter("tokens > 0")
        .select("path", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
        .repartition("path", "block")
    )


def scan_blocks(blocks: DataFrame, separator: int = END_OF_DOCUMENT, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Search every block: number of separators, tokens before the first and after the last, lengths between."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, path = _open(row["path"])
                start = row["block"] * block_tokens
                count = min(block_tokens, row["tokens"] - start)
                with system.open_input_file(path) as file:
                    file.seek(start * TOKEN_BYTES)
                    ids = np.frombuffer(file.read(count * TOKEN_BYTES), "<u2")
                at = np.flatnonzero(ids == separator)
                head = int(at[0]) if len(at) else count
                tail = count - int(at[-1]) - 1 if len(at) else count
                yield pa.RecordBatch.from_pylist(
                    [
                        {
                            "file": path.rpartition("/")[2],
                            "block": row["block"],
                            "first_token": start,
                            "size": count,
                            "n_sep": len(at),
                            "head": head,
                            "tail": tail,
                            "inner": (np.diff(at) - 1).tolist(),
                        }
                    ],
                    schema=pa.schema(
                        [("file", pa.string())]
                        + [(name, pa.int64()) for name in _LIGHT[1:]]
                        + [("inner", pa.list_(pa.int64()))]
                    ),
                )

    return blocks.mapInArrow(work, _SUMMARY)


def stitch(summaries: DataFrame) -> DataFrame:
    """Join what blocks saw into whole documents: (file, ordinal, n_tokens, terminated).

    A document without a separator at the end of a file is returned with
    ``terminated`` false, if it has a token. ``summaries`` is read twice, so it should be a written table.
    """
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    following = Window.partitionBy("file").orderBy("block")
    open_since = F.coalesce(
        F.max(F.when(F.col("n_sep") > 0, F.col("first_token") + F.col("size") - F.col("tail"))).over(before), F.lit(0)
    )
    light = summaries.select(*_LIGHT)
    carried = (
        light.withColumn("ended", F.coalesce(F.sum("n_sep").over(before), F.lit(0)))
        .withColumn("carry", F.col("first_token") - open_since)
        .withColumn("is_last", F.lead("block").over(following).isNull())
    )
    lengths = summaries.select("file", "block", "inner")
    placed = carried.join(lengths.hint("merge"), ["file", "block"])
    whole = F.when(F.col("n_sep") > 0, F.concat(F.array(F.col("carry") + F.col("head")), F.col("inner"))).otherwise(
        F.array().cast("array<long>")
    )
    rest = F.when(F.col("n_sep") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("head"))
    unended = F.when(F.col("is_last") & (rest > 0), F.array(rest)).otherwise(F.array().cast("array<long>"))
    return placed.select("file", "ended", "n_sep", F.posexplode(F.concat(whole, unended)).alias("place", "n_tokens")).select(
        "file",
        (F.col("ended") + F.col("place")).alias("ordinal"),
        "n_tokens",
        (F.col("place") < F.col("n_sep")).alias("terminated"),
    )


def count_tokens(
    spark: SparkSession, folder: str, separator: int = END_OF_DOCUMENT, block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """Token counts of all documents in the flat token files of a folder.

    Rows (file, ordinal, n_tokens, terminated); ordinal counts the documents of a
    file from 0. Two separators in a row enclose an empty document (0 tokens).
    Empty files have no documents.
    """
    blocks = scan_blocks(token_blocks(spark, folder, block_tokens), separator, block_tokens)
    return stitch(written(blocks, "token_summaries"))


def document_token_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None
) -> DataFrame:
    """Write ``docs`` as token files in the shared folder, scan those, and name the documents.

    Rows (doc_id, n_tokens), one per row of ``docs``: NULL and empty texts count 0,
    repeated rows are counted each, a NULL id is kept, other columns are not read.
    """
    spark = docs.sparkSession
    folder = work_dir(spark, "tokens")
    names = work_dir(spark, "token_names")
    write_token_files(docs, folder, id_col, text_col, vocabulary).write.parquet(names)
    order = spark.read.schema("file string, ordinal long, doc_id long").parquet(names)
    if order.isEmpty():
        return spark.createDataFrame([], "doc_id long, n_tokens long")
    counts = count_tokens(spark, folder)
    return order.join(counts.hint("merge"), ["file", "ordinal"]).select("doc_id", "n_tokens")
