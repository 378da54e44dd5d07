"""Sharp sounds in a soundtrack: envelopes, onsets, and whether they look like a match."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtflow.operators.timeseries import running_median, spaced_peaks

HOP_S, RATIO, MERGE_S = 0.01, 3.0, 0.15


def envelope(samples: DataFrame, sample_rate: int) -> DataFrame:
    """(match_id, hop, env): root mean square of second differences over hops of 10 ms.

    samples(match_id, i, v). The last hop needs two samples beyond it; a shorter one is left out.
    """
    hop = max(1, int(sample_rate * HOP_S + 0.5))
    w = Window.partitionBy("match_id").orderBy("i")
    d = F.lead("v", 2).over(w) - 2 * F.lead("v", 1).over(w) + F.col("v")
    sums = samples.withColumn("d", d).groupBy("match_id", F.floor(F.col("i") / hop).alias("hop")).agg(F.count("d").alias("n"), F.sum(F.col("d") * F.col("d")).alias("s"))
    return sums.where(F.col("n") == hop).select("match_id", "hop", F.sqrt(F.col("s") / hop).alias("env"))


def onset_ratio(env: DataFrame) -> DataFrame:
    """Adds the ratio of the envelope to its running median over 51 hops."""
    return running_median(env, ["match_id"], ["hop"], "env", 25).withColumn("ratio", F.col("env") / (F.col("median") + 1e-6))


def pops(env: DataFrame) -> DataFrame:
    """(match_id, t, ratio): peaks of the ratio of at least 3, the highest of those within 0.15 s; first and last hop never."""
    w = Window.partitionBy("match_id").orderBy("hop")
    around = onset_ratio(env).withColumns({"a": F.lag("ratio").over(w), "c": F.lead("ratio").over(w)})
    peaks = around.where((F.col("ratio") >= RATIO) & (F.col("ratio") >= F.col("a")) & (F.col("ratio") >= F.col("c")))
    return spaced_peaks(peaks.select("match_id", (F.col("hop") * HOP_S).alias("t"), "ratio"), ["match_id"], "t", "ratio", MERGE_S)


def usable(found: DataFrame, lengths: DataFrame) -> DataFrame:
    """(match_id, n, rate, usable) for lengths(match_id, seconds): enough pops, a likely rate, and no metronome's regularity."""
    gap = F.col("t") - F.lag("t").over(Window.partitionBy("match_id").orderBy("t"))
    stats = found.withColumn("gap", gap).groupBy("match_id").agg(F.count("*").alias("n"), F.avg("gap").alias("mean"), F.stddev_pop("gap").alias("sd"))
    rows = lengths.join(stats, "match_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rate = F.col("n") / F.greatest(F.col("seconds"), F.lit(1.0))
    likely = (F.col("n") >= 4) & (rate >= 0.15) & (rate <= 3)
    return rows.select("match_id", "n", rate.alias("rate"), (likely & F.coalesce(F.col("sd") / F.col("mean") >= 0.15, F.lit(False))).alias("usable"))


def mono(samples: DataFrame) -> DataFrame:
    """(match_id, i, v): the mean of the channels of samples(match_id, ch, i, v)."""
    return samples.groupBy("match_id", "i").agg(F.avg("v").alias("v"))


def mono_chunks(chunks: DataFrame) -> DataFrame:
    """Sound as arrays: chunks(match_id, start, channels array<array<double>>) with ``v``, the mean of the channels.

    ``start`` is the number of a chunk's first sample; channels are equally long.
    """
    n = F.size("channels")
    total = F.aggregate(F.slice("channels", 2, F.greatest(n - 1, F.lit(0))), F.get("channels", F.lit(0)), lambda t, c: F.zip_with(t, c, lambda a, b: a + b))
    return chunks.withColumn("v", F.transform(total, lambda x: x / n)).drop("channels")


def chunk_envelope(chunks: DataFrame, sample_rate: int) -> DataFrame:
    """``envelope`` of chunks(match_id, start, v array<double>): samples stay in their arrays.

    A chunk borrows the two samples that follow it, each chunk sums its own part of a hop,
    and only these sums are grouped, so hops may cross chunks of any lengths. After a gap
    between chunks nothing is borrowed, and hops that reach into it are left out.
    """
    hop = max(1, int(sample_rate * HOP_S + 0.5))
    w = Window.partitionBy("match_id").orderBy("start")
    end = F.col("start") + F.size("v")
    first = lambda k: F.lead(F.slice("v", 1, 2), k).over(w)
    follows = F.lead("start", 1).over(w) == end
    follows2 = follows & (F.lead("start", 2).over(w) == F.lead(end, 1).over(w))
    none = F.array().cast("array<double>")
    rows = chunks.where(F.size("v") > 0).withColumn("next", F.slice(F.concat(F.when(follows, first(1)).otherwise(none), F.coalesce(F.when(follows2, first(2)), none)), 1, 2))
    whole = F.concat("v", "next")
    squares = F.transform(F.sequence(F.lit(0), F.size("v") - 1), lambda i: F.pow(F.get("long", i + 2) - 2 * F.get("long", i + 1) + F.get("long", i), F.lit(2)))
    hops = F.sequence(F.floor(F.col("start") / hop), F.floor((F.col("start") + F.size("v") - 1) / hop))
    low = lambda h: F.greatest(h * hop - F.col("start"), F.lit(0).cast("long"))
    high = lambda h: F.least((h + 1) * hop - F.col("start"), F.size("d").cast("long"))
    known = lambda h: F.filter(F.slice("d", (low(h) + 1).cast("int"), (high(h) - low(h)).cast("int")), lambda x: x.isNotNull())
    part = lambda h: F.aggregate(known(h), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("s")), lambda t, x: F.struct((t["n"] + 1).alias("n"), (t["s"] + x).alias("s")))
    sums = rows.withColumn("long", whole).withColumn("d", squares).select("match_id", F.explode(F.transform(hops, lambda h: F.struct(h.alias("hop"), part(h).alias("p")))).alias("x"))
    out = sums.groupBy("match_id", F.col("x.hop").alias("hop")).agg(F.sum("x.p.n").alias("n"), F.sum("x.p.s").alias("s"))
    return out.where(F.col("n") == hop).select("match_id", "hop", F.sqrt(F.col("s") / hop).alias("env"))


#: Bytes of a sound file beyond which it isn't looked at.
MOST_BYTES = 600_000_000


def heard(chunks: DataFrame, files: DataFrame, sample_rate: int, most_bytes: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """The pops (match_id, t, ratio) of each match and whether they are usable, within its range.

    chunks(match_id, start, channels), files(match_id, bytes, seconds, from_t, to_t); the
    range is the whole sound where from_t or to_t is null. Files of more than
    ``most_bytes``, and matches without sound, have no pops and aren't usable.
    """
    small = files.where(F.col("bytes").isNull() | (F.col("bytes") <= most_bytes)).select("match_id", "from_t", "to_t")
    found = pops(chunk_envelope(mono_chunks(chunks.join(small.select("match_id"), "match_id", "left_semi")), sample_rate))
    ranged = F.col("from_t").isNotNull() & F.col("to_t").isNotNull()
    inside = found.join(small, "match_id").where(~ranged | F.col("t").between(F.col("from_t"), F.col("to_t"))).drop("from_t", "to_t")
    lengths = files.select("match_id", F.when(ranged, F.col("to_t") - F.col("from_t")).otherwise(F.col("seconds")).alias("seconds"))
    return inside, usable(inside, lengths)
