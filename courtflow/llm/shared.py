"""What the operators of this subpackage share: reading tables, written intermediate tables, the held-out split."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters between words, as a Java and RE2 pattern, and the words themselves.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_own_folder: dict[str, str] = {}
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a local session (one machine, as in tests) gets a folder of its
    own; on a cluster that is an error, as executors wouldn't find the driver's folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_folder:
            _own_folder[app] = tempfile.mkdtemp(prefix="courtflow-")
        folder = _own_folder[app]
    return f"{folder.rstrip('/')}/courtflow-{spark.sparkContext.applicationId}"


def stash(df: DataFrame, label: str) -> DataFrame:
    """The same rows, written once as Parquet in the shared folder and read back.

    This cuts the lineage without a second computation, and the rows outlive any
    executor. The files stay until they are no longer needed (``unstash``) or the whole
    folder is cleared (``clear_stash``).
    """
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def unstash(*tables: DataFrame) -> None:
    """Deletes the files of tables that ``stash`` returned; all that was made of them must have been written."""
    for df in tables:
        if path := _paths.pop(df, None):
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Bounds the rows of an Arrow batch for what is written meanwhile; for rows that are large each."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def slices(texts: pa.Array, rows: int, most: int) -> Iterator[tuple[int, int]]:
    """(start, stop) of stretches of a string column with at most ``rows`` rows and ``most`` bytes, but one row at least."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        before = int(upto[at - 1]) if at else 0
        stop = min(at + rows, max(at + 1, int(np.searchsorted(upto, before + most, side="right"))))
        yield at, stop
        at = stop


def clear_stash(spark: SparkSession) -> None:
    """Deletes what ``stash`` wrote; results that still read it must have been written before."""
    _delete(spark, shared_folder(spark))


#: A key is hot from this share of its table's rows on, so there are at most this many hot keys, whatever the input.
HOT = 1000


def lookup(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of rows with table(keys..., n, ...), one row for each key, n being its number of rows.

    A hot key's rows would all meet in one task. The table's rows for hot keys, at most
    ``HOT`` of them by proof, are broadcast instead; the others are joined by a shuffle.
    Null keys match nothing. Both tables are read twice and should be stashed.
    """
    total = table.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT >= total
    few, many = F.broadcast(table.where(hot)), table.where(~hot)
    cold = rows.join(few.select(*keys), keys, "left_anti").join(many, keys)
    return rows.join(few, keys).unionByName(cold).drop("n")


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id's decimal text is divisible by 5; a null id is held out too."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def n_words(text: str = "text") -> Column:
    """Words of the whole text; null and empty texts have none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
