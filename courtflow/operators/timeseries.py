"""Operators over rows that are ordered in time within a key.

Every window is partitioned by the caller's key (a match, or a player of a match),
which bounds its size; nothing here orders rows across keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ordered(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def smooth(df: DataFrame, keys: list[str], order: list[str], columns: list[str], rows: int = 2) -> DataFrame:
    """Centred moving averages over ``rows`` rows to either side, shorter at the ends."""
    w = _ordered(keys, order).rowsBetween(-rows, rows)
    return df.withColumns({c: F.avg(c).over(w) for c in columns})


def segments(df: DataFrame, keys: list[str], order: list[str], t: str, x: str, y: str) -> DataFrame:
    """Adds dt, dist and speed from the row before; null at a key's first row."""
    w = _ordered(keys, order)
    dt, dist = F.col(t) - F.lag(t).over(w), F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w))
    return df.withColumn("dt", dt).withColumn("dist", dist).withColumn("speed", F.when(F.col("dt") > 0, F.col("dist") / F.col("dt")))


def local_peaks(df: DataFrame, keys: list[str], order: list[str], value: str, least: float) -> DataFrame:
    """Rows of at least ``least`` that no neighbour exceeds; ends have one neighbour."""
    w = _ordered(keys, order)
    beside = lambda f: F.coalesce(F.col(value) >= f(value).over(w), F.lit(True))
    return df.withColumn("__peak", beside(F.lag) & beside(F.lead)).where(F.col("__peak") & (F.col(value) >= least)).drop("__peak")


def _chained(df: DataFrame, keys: list[str], t: str, apart: float) -> DataFrame:
    """Adds ``__chain``: a number that grows by one where a row comes at least ``apart`` after the one before.

    Such a row is as far from whatever was kept before, so folds that compare with the
    last row kept may start anew there and never grow with a match.
    """
    w = _ordered(keys, [t])
    new = F.when(F.col(t) - F.lag(t).over(w) >= apart, 1).otherwise(0)
    return df.withColumn("__new", new).withColumn("__chain", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def spaced_peaks(df: DataFrame, keys: list[str], t: str, value: str, apart: float) -> DataFrame:
    """Of rows closer than ``apart`` to the one kept before keeps the higher; a higher one becomes the new anchor.

    One ordered fold per chain of near peaks. Other columns are dropped.
    """
    rows = _chained(df, keys, t, apart).groupBy(*keys, "__chain").agg(F.array_sort(F.collect_list(F.struct(F.col(t).cast("double").alias("t"), F.col(value).cast("double").alias("v")))).alias("a"))
    last = lambda acc: F.element_at(acc, -1)
    head = lambda acc: F.slice(acc, 1, F.size(acc) - 1)
    empty = F.array().cast("array<struct<t:double,v:double>>")

    def step(acc: Column, row: Column) -> Column:
        near = (F.size(acc) > 0) & (row["t"] - F.get(acc, F.size(acc) - 1)["t"] < apart)
        higher = row["v"] > F.get(acc, F.size(acc) - 1)["v"]
        return F.when(near & higher, F.concat(head(acc), F.array(row))).when(near, acc).otherwise(F.concat(acc, F.array(row)))

    kept = rows.select(*keys, F.explode(F.aggregate("a", empty, step)).alias("p"))
    return kept.select(*keys, F.col("p.t").alias(t), F.col("p.v").alias(value))


def debounced(df: DataFrame, keys: list[str], t: str, apart: float) -> DataFrame:
    """Keeps a row if it comes at least ``apart`` after the last one kept (a fixed anchor). Keeps (keys, t)."""
    rows = _chained(df, keys, t, apart).groupBy(*keys, "__chain").agg(F.sort_array(F.collect_list(F.col(t).cast("double"))).alias("a"))
    fold = F.aggregate(
        "a", F.array().cast("array<double>"),
        lambda acc, x: F.when((F.size(acc) == 0) | (x - F.get(acc, F.size(acc) - 1) >= apart), F.concat(acc, F.array(x))).otherwise(acc),
    )
    return rows.select(*keys, F.explode(fold).alias(t))


def islands(df: DataFrame, keys: list[str], order: list[str], t: str, gap: float) -> DataFrame:
    """Adds ``island``: a number that grows by one after every pause longer than ``gap``."""
    w = _ordered(keys, order)
    new = F.when(F.col(t) - F.lag(t).over(w) > gap, 1).otherwise(0)
    return df.withColumn("__new", new).withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def running_median(df: DataFrame, keys: list[str], order: list[str], value: str, rows: int = 25) -> DataFrame:
    """Adds ``median``: the upper middle of the values within ``rows`` rows to either side."""
    near = F.sort_array(F.collect_list(value).over(_ordered(keys, order).rowsBetween(-rows, rows)))
    return df.withColumn("__near", near).withColumn("median", F.get("__near", F.floor(F.size("__near") / 2).cast("int"))).drop("__near")


def asof_nearest(left: DataFrame, right: DataFrame, keys: list[str], t: str, columns: list[str]) -> DataFrame:
    """Each left row with the right row nearest in time (of two equally near ones the later), else nulls.

    Both sides go through one window per key (one shuffle, no pairs): the last right row
    at or before and the next one at or after, then the nearer of the two.
    """
    side = F.struct(F.col(t).cast("double").alias("at"), *columns)
    lefts = left.select(*keys, F.col(t).cast("double").alias(t), F.struct(*left.columns).alias("__row"), F.lit(None).alias("__side"))
    rights = right.select(*keys, F.col(t).cast("double").alias(t), F.lit(None).alias("__row"), side.alias("__side"))
    both = lefts.unionByName(rights)
    back = Window.partitionBy(*keys).orderBy(F.col(t), F.col("__row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(F.col(t).desc(), F.col("__row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("__b", F.last("__side", ignorenulls=True).over(back)).withColumn("__a", F.last("__side", ignorenulls=True).over(ahead)).where("__row is not null")
    take_before = F.col("__a").isNull() | (F.col(t) - F.col("__b.at") < F.col("__a.at") - F.col(t))
    pick = F.when(F.col("__b").isNotNull() & take_before, F.col("__b")).otherwise(F.col("__a"))
    return met.withColumn("__pick", pick).select("__row.*", F.col("__pick.at").alias("near_t"), *[F.col(f"__pick.{c}").alias(f"near_{c}") for c in columns])


def asof_within(left: DataFrame, right: DataFrame, keys: list[str], t: str, columns: list[str], tolerance: float) -> DataFrame:
    """As ``asof_nearest``, with nulls where the nearest right row is not nearer than the tolerance."""
    met = asof_nearest(left, right, keys, t, columns)
    near = F.abs(F.col("near_t") - F.col(t)) < tolerance
    return met.withColumns({c: F.when(near, F.col(c)) for c in ("near_t", *[f"near_{c}" for c in columns])})


def latest_within(left: DataFrame, right: DataFrame, keys: list[str], t: str, columns: list[str], back: float) -> DataFrame:
    """Each left row with the last right row in [t - back, t] (``last_`` columns), else nulls; one window per key."""
    side = F.struct(F.col(t).cast("double").alias("at"), *columns)
    lefts = left.select(*keys, F.col(t).cast("double").alias(t), F.struct(*left.columns).alias("__row"), F.lit(None).alias("__side"))
    rights = right.select(*keys, F.col(t).cast("double").alias(t), F.lit(None).alias("__row"), side.alias("__side"))
    order = Window.partitionBy(*keys).orderBy(F.col(t), F.col("__row").isNotNull(), "__side").rowsBetween(Window.unboundedPreceding, 0)
    met = lefts.unionByName(rights).withColumn("__last", F.last("__side", ignorenulls=True).over(order)).where("__row is not null")
    near = F.col("__last.at") >= F.col(t) - back
    return met.select("__row.*", *[F.when(near, F.col(f"__last.{c}")).alias(f"last_{c}") for c in ("at", *columns)])


def rising(df: DataFrame, keys: list[str], order: list[str], t: str) -> DataFrame:
    """Adds ``tick``: the time in whole milliseconds, raised where needed so that each row's is above the one before.

    A tick is the row's number plus the greatest of (milliseconds - number) so far: one running maximum.
    """
    w = _ordered(keys, order)
    own = F.floor(F.col(t) * 1000 + 0.5) - F.row_number().over(w)
    ahead = df.withColumns({"__own": own, "__at": F.row_number().over(w)})
    return ahead.withColumn("tick", F.col("__at") + F.max("__own").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__own", "__at")


def segment(df: DataFrame, spans: DataFrame, keys: list[str], t: str, least: float = 0.5) -> DataFrame:
    """Rows within their key's chosen segment: spans(keys, start, end, duration), one row for each key.

    Start and end are cut to the duration (null: all of it); a segment is ``least`` long at least.
    """
    start = F.greatest(F.lit(0.0), F.least(F.coalesce("start", F.lit(0.0)), F.col("duration")))
    end = F.greatest(F.col("__from") + least, F.least(F.coalesce("end", F.col("duration")), F.col("duration")))
    cut = spans.withColumn("__from", start).select(*keys, "__from", end.alias("__to"))
    return df.join(cut, keys).where(F.col(t).between(F.col("__from"), F.col("__to"))).drop("__from", "__to")


def steps(spans: DataFrame, keys: list[str], step: float) -> DataFrame:
    """(keys, t): the exact times start, start + step, ... up to end for spans(keys, start, end)."""
    n = F.floor((F.col("end") - F.col("start")) / step + 1e-9)
    return spans.where(F.col("end") >= F.col("start")).select(*keys, "start", F.explode(F.sequence(F.lit(0), n.cast("int"))).alias("i")).select(*keys, (F.col("start") + F.col("i") * step).alias("t"))


def greedily_apart(df: DataFrame, keys: list[str], order: list[str], near) -> DataFrame:
    """Rows of each key in order, without those that ``near(kept, row)`` says of a row kept before.

    A key is small (one frame's detections); one fold for each.
    """
    row = F.struct(*order, F.struct(*df.columns).alias("row"))
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("a"))
    keep = F.aggregate("a", F.slice("a", 1, 0), lambda acc, x: F.when(F.exists(acc, lambda k: near(k["row"], x["row"])), acc).otherwise(F.concat(acc, F.array(x))))
    return rows.select(F.explode(keep).alias("x")).select("x.row.*")


def marks_by_count_or_time(df: DataFrame, keys: list[str], t: str, most: int, few: int, seconds: float) -> DataFrame:
    """(keys, t): rows at which unfinished work is saved: ``most`` rows after the last mark, or ``few`` once ``seconds`` have passed.

    A mark closes at least ``few`` rows, so the list that the fold keeps is short.
    """
    rows = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.col(t).cast("double"))).alias("a"))
    state = F.struct(F.lit(0).alias("n"), F.get("a", F.lit(0)).alias("at"), F.array().cast("array<double>").alias("marks"))

    def step(s: Column, x: Column) -> Column:
        n = s["n"] + 1
        due = (n >= most) | ((n >= few) & (x - s["at"] > seconds))
        return F.when(due, F.struct(F.lit(0).alias("n"), x.alias("at"), F.concat(s["marks"], F.array(x)).alias("marks"))).otherwise(F.struct(n.alias("n"), s["at"].alias("at"), s["marks"].alias("marks")))

    return rows.select(*keys, F.explode(F.aggregate("a", state, step)["marks"]).alias(t))


def within_intervals(points: DataFrame, intervals: DataFrame, keys: list[str], t: str, start: str, end: str, width: float) -> DataFrame:
    """Points joined with the intervals [start, end] that hold them, by time bins of ``width``.

    The bins turn the range condition into an equi-join; an interval is repeated for
    each bin it touches, so ``width`` should be about an interval's length.
    """
    binned = intervals.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    return points.withColumn("__bin", F.floor(F.col(t) / width)).join(binned, [*keys, "__bin"]).where(F.col(t).between(F.col(start), F.col(end))).drop("__bin")


def fill_gaps(frames: DataFrame, poses: DataFrame, longest: float = 1.0) -> DataFrame:
    """Poses with the frames between two sightings of a player, at most ``longest`` apart, filled on a line.

    frames(match_id, frame_no, t), poses(match_id, frame_no, t, player_id, court_x, court_y).
    Each pair of neighbouring sightings yields the frame numbers between them, which
    then pick up their times from frames: no grid of all frames and players is built.
    Adds ``interpolated``.
    """
    w = Window.partitionBy("match_id", "player_id").orderBy("t", "frame_no")
    nxt = {f"n_{c}": F.lead(c).over(w) for c in ("frame_no", "t", "court_x", "court_y")}
    numbered = frames.select("match_id", "t", F.row_number().over(Window.partitionBy("match_id").orderBy("t", "frame_no")).alias("__i"), "frame_no")
    seen = poses.join(numbered.select("match_id", "frame_no", "__i"), ["match_id", "frame_no"])
    gaps = seen.withColumns({**nxt, "__j": F.lead("__i").over(w)}).where((F.col("__j") - F.col("__i") > 1) & (F.col("n_t") - F.col("t") <= longest))
    gaps = gaps.select("match_id", "player_id", F.col("t").alias("t0"), F.col("n_t").alias("t1"), "court_x", "court_y", "n_court_x", "n_court_y", F.explode(F.sequence(F.col("__i") + 1, F.col("__j") - 1)).alias("__i"))
    u = (F.col("t") - F.col("t0")) / (F.col("t1") - F.col("t0"))
    along = lambda c: (F.col(c) + (F.col(f"n_{c}") - F.col(c)) * u).alias(c)
    filled = gaps.join(numbered, ["match_id", "__i"]).select("match_id", "frame_no", "t", "player_id", along("court_x"), along("court_y"), F.lit(True).alias("interpolated"))
    return poses.select("match_id", "frame_no", "t", "player_id", "court_x", "court_y", F.lit(False).alias("interpolated")).unionByName(filled)


def sampled(df: DataFrame, keys: list[str], t: str, step: float) -> DataFrame:
    """Greedy sampling: a row is taken at or after (within 1 ms) the time due, which then moves to its time plus ``step``.

    The fold goes by stretches of 256 rows, each with a list of its own, so that its cost
    doesn't grow with the square of a key's rows.
    """
    rows = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.col(t).cast("double"))).alias("a"))
    stretches = F.transform(F.sequence(F.lit(1), F.size("a"), F.lit(256)), lambda i: F.slice(F.col("a"), i, 256))
    none = F.array().cast("array<double>")
    state = F.struct(F.lit(float("-inf")).alias("due"), F.array().cast("array<array<double>>").alias("kept"))

    def stretch(s: Column, part: Column) -> Column:
        start = F.struct(s["due"].alias("due"), none.alias("own"))
        done = F.aggregate(
            part, start,
            lambda one, x: F.when(x >= one["due"] - 1e-3, F.struct((x + step).alias("due"), F.concat(one["own"], F.array(x)).alias("own"))).otherwise(one),
        )
        # one list of one result, so that the inner fold is written once
        return F.get(F.transform(F.array(done), lambda d: F.struct(d["due"].alias("due"), F.concat(s["kept"], F.array(d["own"])).alias("kept"))), F.lit(0))

    return rows.select(*keys, F.explode(F.flatten(F.aggregate(stretches, state, stretch)["kept"])).alias(t))
