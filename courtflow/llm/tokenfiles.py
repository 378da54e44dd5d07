"""Token-id files: Parquet list columns in document order that can be read selectively.

Rows lie in ascending doc_id over files and within them. The list column is
dictionary-encoded (a vocabulary's ids fit a dictionary page; where they do not, the
version-2 writer falls back to delta encoding), row groups and pages are small enough
to fetch a few documents, and the column indexes that the writer leaves let a reader
find a doc_id range without touching other pages. Counts can be read without ids.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from courtflow.llm.pieces import SLICE_BYTES, encoder
from courtflow.llm.shared import shared_folder, slices, stash

ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 32 << 20, 256 << 10, 2000
#: Texts that are encoded together, and rows handed on together, at most.
TEXTS, ROWS = 10_000, 128
SCHEMA = "doc_id long, n_tokens long, part int, start_in_part long, tokens array<int>"

def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Writes docs(doc_id, text, ...) as files of (doc_id, n_tokens, part, start_in_part, tokens).

    tokens are the ids of the whole text with ``end_id`` appended (null text: only
    that). Rows of one doc_id are ordered by a hash of their text; null ids come first.
    ``part`` numbers the stretches of that order that tasks wrote, in as many files as
    the session's settings make of each, and start_in_part counts the ids before the
    document in its stretch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, start, own = encoder(tokenizer), 0, TaskContext.get().partitionId()
        for batch in batches:
            for at, stop in slices(batch.column("text"), TEXTS, SLICE_BYTES):
                part = batch.slice(at, stop - at)
                ids, ends = encode(part.column("text"))
                flat, ends = np.insert(ids, ends[1:], end_id), ends + np.arange(len(ends))
                columns = [part.column("doc_id"), pa.array(np.diff(ends)), pa.array(np.full(len(part), own, dtype=np.int32)), pa.array(start + ends[:-1])]
                tokens = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
                start += int(ends[-1])
                rows = pa.RecordBatch.from_arrays([*columns, tokens], ["doc_id", "n_tokens", "part", "start_in_part", "tokens"])
                yield from (rows.slice(i, ROWS) for i in range(0, len(rows), ROWS))

    keyed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("tie", F.xxhash64("text"))
    (
        keyed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
        .mapInArrow(run, SCHEMA)
        .write.option("compression", "zstd").option("parquet.writer.version", "v2").option("parquet.enable.dictionary", "true")
        .option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.size", PAGE_BYTES).option("parquet.page.row.count.limit", PAGE_ROWS)
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, tokens) of a folder that ``write_tokens`` wrote.

    start is the number of ids before the document in the whole folder. It comes from
    one total a part; the window that sums them and the broadcast sums have a row for
    each writing task, at most ``spark.sql.shuffle.partitions``.
    """
    rows = spark.read.schema(SCHEMA).parquet(path)
    totals = rows.groupBy("part").agg(F.max(F.col("start_in_part") + F.col("n_tokens")).alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = stash(totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")), "token-parts")
    return rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "tokens")


def with_crc32(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column("tokens")
            flat, offsets = tokens.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), tokens.offsets.to_numpy()
            crcs = [zlib.crc32(flat[a:b].data) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            columns = [batch.column(c) for c in ("doc_id", "start", "n_tokens")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.array(crcs, dtype=np.int64))], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digest(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Writes the files of all docs to the shared folder and digests what is read back from them.

    Nulls and empty texts have only the end id; repeated rows each have their own
    place; an empty table gives empty files and no rows.
    """
    path = f"{shared_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer, end_id)
    return with_crc32(read_tokens(docs.sparkSession, path))
