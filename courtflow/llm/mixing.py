"""Mixing sources to target weights with nested hash-threshold histograms.

All of it is DataFrame expressions. Sizes are summed by source and hash bucket; the
bucket in which a source's budget runs out is split into finer buckets, and again,
until the threshold is known to the last hash bit. Documents are then taken by
comparing their hash with their source's threshold: no sort of documents, and only
rows of boundary buckets are read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtflow.llm.shared import n_words, stash

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
#: Levels of buckets and bits of the hash that each level tells apart: 48 bits in all.
LEVELS, BITS = 4, 12


def mix_hash(doc_id: str = "doc_id", text: str = "text") -> Column:
    """48 bits of the MD5 of id and text, as a long; rows alike in both are taken alike."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.col(doc_id).cast("string"), F.col(text)).cast("binary")), 1, 12), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Adds ``target`` to sizes(source, source_size), one row for each source.

    Sources in code-point order (null last) get the weights in turn and share
    ``share`` times all sizes; no target exceeds ``cap`` times its source's size, and
    the excess goes to the others by weight. That is a common level by weight: the
    level follows from running sums over the sources in order of the level at which
    each reaches its cap. The two windows hold one row for each source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    ranked = sizes.withColumn("weight", F.get(F.array(*map(F.lit, weights)), turn).cast("double"))
    ranked = ranked.withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("full_at", F.col("most") / F.col("weight"))
    by_level = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    every = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn(
        "level",
        (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
    )
    level = F.min(F.when(F.col("level") < F.col("full_at"), F.struct("full_at", "source", "level"))).over(every)
    return ranked.withColumn("target", F.coalesce(F.least("most", level["level"] * F.col("weight")), F.col("most"))).select("source", "source_size", "target")


def _boundary(buckets: DataFrame) -> DataFrame:
    """Per source the bucket in which its budget runs out: buckets(source, budget, low, bucket, words)."""
    run = Window.partitionBy("source").orderBy("bucket")
    return (
        buckets.withColumn("upto", F.sum("words").over(run))
        .where("upto > budget and upto - words <= budget")
        .select("source", (F.col("low") * (1 << BITS) + F.col("bucket")).alias("low"), (F.col("budget") - (F.col("upto") - F.col("words"))).alias("budget"), "words")
    )


def thresholds(sized: DataFrame, **how) -> DataFrame:
    """(source, source_size, target, copies, below) for sized(source, size, h).

    A document is taken ``copies`` times, and once more if its hash is under ``below``.
    """
    hist = stash(
        sized.groupBy("source", F.shiftright("h", BITS * (LEVELS - 1)).alias("bucket")).agg(F.sum("size").alias("words")), "mix-hist"
    )
    totals = hist.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(totals, **how).withColumn("copies", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long"))
    targets = stash(targets.withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size")), "mix-targets")
    first = targets.select(F.col("source").alias("s"), "budget", F.lit(0).cast("long").alias("low"))
    edge = stash(_boundary(hist.join(first, F.col("source").eqNullSafe(F.col("s"))).drop("s")), "mix-edge")
    rows = sized
    for depth in range(1, LEVELS):
        shift = BITS * (LEVELS - 1 - depth)
        at = edge.select(F.col("source").alias("s"), "low", "budget")
        rows = stash(
            rows.join(at, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", shift + BITS) == F.col("low"))).select("source", "size", "h", "low", "budget"),
            "mix-rows",
        )
        buckets = rows.groupBy("source", "low", "budget", F.shiftright("h", shift).bitwiseAND(F.lit((1 << BITS) - 1)).alias("bucket")).agg(F.sum("size").alias("words"))
        edge = stash(_boundary(buckets), "mix-edge")
        rows = rows.drop("low", "budget")
    # the last bucket is one hash value: it is taken if that comes nearer to the target
    last = edge.select(F.col("source").alias("s"), (F.col("low") + F.when(F.col("words") - F.col("budget") < F.col("budget"), 1).otherwise(0)).alias("below"))
    return (
        targets.join(last, F.col("source").eqNullSafe(F.col("s")), "left")
        .select("source", "source_size", "target", "copies", F.coalesce("below", F.lit(0)).alias("below"))
    )


def mix_plan(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of docs(doc_id, text, source, ...).

    size is the number of words (null text: 0), taken the words that the mix takes,
    repeats counted. Nulls in source are a source of their own, last in order. Rows
    with the same id and text are taken alike. Other columns are ignored; an empty
    table gives none. The hash depends on id and text only, so reruns agree.
    """
    sized = stash(docs.select("doc_id", "source", n_words().alias("size"), mix_hash().alias("h")), "mix-sized")
    plan = stash(thresholds(sized, **how).withColumnRenamed("source", "s"), "mix-plan")
    times = F.col("copies") + F.when(F.col("h") < F.col("below"), 1).otherwise(0)
    return sized.join(plan, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows that the mix takes, repeated as often as it takes them; all columns of docs are kept."""
    sized = stash(docs.select("source", n_words().alias("size"), mix_hash().alias("h")), "mix-sized")
    plan = stash(thresholds(sized, **how), "mix-plan").select(*[F.col(c).alias(f"__mix_{c}") for c in ("source", "copies", "below")])
    times = F.col("__mix_copies") + F.when(mix_hash() < F.col("__mix_below"), 1).otherwise(0)
    taken = docs.join(plan, F.col("source").eqNullSafe(F.col("__mix_source")))
    return taken.withColumn("__mix_times", times).withColumn("__mix_copy", F.explode(F.expr("array_repeat(1, cast(__mix_times as int))"))).select(*docs.columns)


#: The same plan by one running sum over hash values.
ORACLE = r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         ('0x' || substr(md5(concat_ws(':', doc_id::varchar, text)), 1, 12))::bigint as h
  from documents),
totals as (select source, sum(size)::bigint as source_size from sized group by 1),
ranked as (select *, [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1]::double as weight, source_size * 2.0::double as most from totals),
leveled as (
  select *, most / weight as full_at,
         (1.5::double * sum(source_size) over () - coalesce(sum(most) over (order by most / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
         / (sum(weight) over () - coalesce(sum(weight) over (order by most / weight, source nulls last rows between unbounded preceding and 1 preceding), 0)) as level
  from ranked),
common as (select arg_min(level, full_at) as level from leveled where level < full_at),
targets as (
  select source, source_size, coalesce(least(most, common.level * weight), most) as target from leveled left join common on true),
budgets as (
  select *, coalesce(floor(target / nullif(source_size, 0)), 0)::bigint as copies,
         target - coalesce(floor(target / nullif(source_size, 0)), 0) * source_size as budget from targets),
by_hash as (select source, h, sum(size) as words from sized group by 1, 2),
run as (select *, sum(words) over (partition by source order by h) as upto from by_hash),
edge as (
  select run.source, h + case when words - (budget - (upto - words)) < budget - (upto - words) then 1 else 0 end as below
  from run join budgets on run.source is not distinct from budgets.source
  where upto > budget and upto - words <= budget)
select s.doc_id, s.size, b.source_size, b.target,
       (s.size * (b.copies + case when s.h < coalesce(e.below, 0) then 1 else 0 end))::bigint as taken
from sized s join budgets b on s.source is not distinct from b.source
left join edge e on s.source is not distinct from e.source
"""
