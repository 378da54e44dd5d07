"""Token counts: one exact histogram of encoded lengths answers every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtflow.llm.pieces import SLICE_BYTES, encoder
from courtflow.llm.shared import slices, stash

#: Lengths in a block of the two-level sums.
BLOCK = 1024
#: Texts that are encoded together, at most.
TEXTS = 10_000


def encoded_lengths(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(n_tokens) for every row of docs(text, ...): ids of the whole text under a byte-level tokenizer file; null is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            texts = batch.column(0)
            for at, stop in slices(texts, TEXTS, SLICE_BYTES):
                _, ends = encode(texts.slice(at, stop - at))
                yield pa.RecordBatch.from_arrays([pa.array(np.diff(ends))], ["n_tokens"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """Suffix sums over the distinct lengths of lengths(n_tokens).

    One row for each length L: n_docs of that length, docs_longer and tokens_longer
    (documents longer than L and their ids), total_tokens of all documents,
    truncated_tokens (all documents cut to L ids) and share_within (documents of at
    most L ids). Sums go by blocks of lengths, then within a block, so no task holds
    all lengths. Empty and null texts count with length 0; no rows give no rows.
    """
    hist = stash(lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs")), "length-hist")
    hist = hist.withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    ids = F.col("n_tokens") * F.col("n_docs")
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(ids).alias("t")).select(
        "block",
        *[F.coalesce(F.sum(c).over(after), F.lit(0)).alias(f"{c}_after") for c in "dt"],
        *[F.sum(c).over(every).alias(f"{c}_all") for c in "dt"],
    )
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    return (
        hist.join(blocks, "block")
        .withColumn("docs_longer", F.col("d_after") + F.coalesce(F.sum("n_docs").over(within), F.lit(0)))
        .withColumn("tokens_longer", F.col("t_after") + F.coalesce(F.sum(ids).over(within), F.lit(0)))
        .select(
            "n_tokens", "n_docs", "docs_longer", "tokens_longer", F.col("t_all").alias("total_tokens"),
            (F.col("t_all") - F.col("tokens_longer") + F.col("n_tokens") * F.col("docs_longer")).alias("truncated_tokens"),
            ((F.col("d_all") - F.col("docs_longer")) / F.col("d_all")).alias("share_within"),
        )
    )


def truncated_totals(hist: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, tokens, docs_cut) for any limits, from the rows of ``length_histogram``."""
    picks = [F.struct(F.lit(n).cast("long").alias("context_limit"), F.sum(F.least("n_tokens", F.lit(n)) * F.col("n_docs")).alias("tokens"), F.sum(F.when(F.col("n_tokens") > n, F.col("n_docs")).otherwise(0)).alias("docs_cut")) for n in limits]
    return hist.agg(F.array(*picks).alias("a")).select(F.inline("a"))


def length_quantiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length within which at least that share of documents lies."""
    picks = [F.struct(F.lit(float(q)).alias("share"), F.min(F.when(F.col("share_within") >= q, F.col("n_tokens"))).alias("n_tokens")) for q in shares]
    return hist.agg(F.array(*picks).alias("a")).select(F.inline("a"))
