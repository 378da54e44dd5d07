"""What the registered queries share: derived tables, rounding alike in both engines."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courtflow.sources.surrogate import table

Query = Callable[[SparkSession, str], DataFrame]


def query(*names: str, **more) -> Callable[[Callable[..., DataFrame]], Query]:
    """Turns a function of derived tables into a registered query."""

    def wrap(f: Callable[..., DataFrame]) -> Query:
        return lambda spark, sf_dir: f(*[table(spark, sf_dir, n) for n in names], **more)

    return wrap


def r6(c: str | Column, name: str | None = None) -> Column:
    """Rounded to six places, halves up."""
    col = F.col(c) if isinstance(c, str) else c
    return (F.floor(col * 1000000 + 0.5) / 1000000).alias(name or c)


def s6(expr: str) -> str:
    """The same in SQL."""
    return f"floor(({expr}) * 1000000 + 0.5) / 1000000"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session without one gets a folder of its own, a cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (folder or tempfile.mkdtemp(prefix="courtflow-")).rstrip("/")


def kept(rows: DataFrame, label: str) -> DataFrame:
    """The same rows, written once in the shared folder and read back, where several steps need what is dear to derive."""
    path = f"{shared_folder(rows.sparkSession)}/{label}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
