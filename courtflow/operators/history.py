"""Questions over many matches: usual values, trends, goals, people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtflow.functions.geometry import team
from courtflow.functions.text import name_key

#: Per metric: whether more is better, and the least difference that counts.
COMPARED = {"net": (True, 2.0), "together": (True, 2.0), "split": (False, 2.0), "pace": (True, 2.0), "won": (True, 2.0), "unforced": (False, 0.3)}
#: Per goal metric: whether the target is a most (else a least), its default, whether it needs tags.
GOALS = {
    "split": (True, 15.0, False), "netTogether": (False, 30.0, False), "netTime": (False, 30.0, False), "unforced": (True, 5.0, True),
    "winners": (False, 3.0, True), "breakPoints": (False, 40.0, True), "distance": (False, 40.0, False),
}


def match_metrics(matches: DataFrame, stats: DataFrame, tactics: DataFrame, scores: DataFrame, endings: DataFrame) -> DataFrame:
    """One row for each match with ``me``: what its player and pair did; null where it can't be measured.

    matches(match_id, created_at, me, seconds, demo); the others as the operators give them.
    """
    mine = stats.select("match_id", F.col("player_id").alias("me"), "share_net", "distance")
    pair = tactics.select("match_id", F.col("team").alias("my_team"), F.col("share_net").alias("pair_net"), F.col("share_split").alias("pair_split"))
    errors = endings.select("match_id", F.col("player_id").alias("me"), "n_winner", "n_unforced")
    rows = (
        matches.where("me is not null").withColumn("my_team", team(F.col("me")))
        .join(mine, ["match_id", "me"], "left").join(pair, ["match_id", "my_team"], "left")
        .join(scores, "match_id", "left").join(errors, ["match_id", "me"], "left")
    )
    points = F.when(F.col("my_team") == "A", F.col("points_a")).otherwise(F.col("points_b"))
    tagged = F.coalesce("tagged", F.lit(0))
    return rows.select(
        "match_id", "created_at", "demo", "me", "my_team", tagged.alias("tagged"),
        (F.col("share_net") * 100).alias("net"), (F.col("pair_net") * 100).alias("together"), (F.col("pair_split") * 100).alias("split"),
        (F.col("distance") / (F.greatest(F.col("seconds"), F.lit(1e-3)) / 60)).alias("pace"),
        F.when(tagged > 0, points / F.col("tagged") * 100).alias("won"),
        F.when(tagged >= 5, F.coalesce("n_unforced", F.lit(0)) / F.col("tagged") * 10).alias("unforced"),
        F.when(tagged > 0, F.coalesce("n_winner", F.lit(0))).alias("winners"),
        F.when(tagged > 0, F.coalesce("n_unforced", F.lit(0))).alias("unforced_count"),
    )


def melted(metrics: DataFrame, names: list[str]) -> DataFrame:
    """(match_id, created_at, demo, owner, metric, value) with a row for each metric, nulls kept."""
    pairs = ", ".join(f"'{n}', cast(`{n}` as double)" for n in names)
    return metrics.selectExpr("match_id", "created_at", "demo", "owner", f"stack({len(names)}, {pairs}) as (metric, value)")


def usual_and_now(metrics: DataFrame, window: int = 5) -> DataFrame:
    """Each match's metrics against the means of the owner's ``window`` matches before it (demos don't count).

    metrics has an ``owner`` column; matches of one time are ordered by id. Nulls are
    dropped after the matches are chosen; a metric that is null now or in all of them
    has no row. ``better`` is null where the difference is negligible.
    """
    rows = melted(metrics, list(COMPARED))
    w = Window.partitionBy("owner", "metric").orderBy("created_at", "match_id").rowsBetween(-window, -1)
    real = rows.where(~F.col("demo"))
    compared = real.withColumns({"usual": F.avg("value").over(w), "basis": F.count("value").over(w)}).where("value is not null and usual is not null")
    delta = F.col("value") - F.col("usual")
    higher = F.col("metric").isin([m for m, (up, _) in COMPARED.items() if up])
    least = F.when(F.col("metric") == "unforced", 0.3).otherwise(2.0)
    better = F.when(F.abs(delta) < least, None).otherwise(F.when(higher, delta > 0).otherwise(delta < 0))
    return compared.select("match_id", "owner", "metric", F.col("value").alias("current"), "usual", delta.alias("delta"), better.alias("better"), "basis")


def trends(metrics: DataFrame, names: list[str]) -> DataFrame:
    """Per owner and metric the values over time, oldest first: their number, range, first and last (two at least)."""
    rows = melted(metrics, names).where("value is not null and not demo")
    at = F.struct("created_at", "match_id")
    ends = rows.groupBy("owner", "metric").agg(
        F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.min_by("value", at).alias("first"), F.max_by("value", at).alias("last")
    )
    return ends.where("n >= 2").withColumn("change", F.col("last") - F.col("first"))


def trend_axes(trends: DataFrame) -> DataFrame:
    """Adds axis_low, axis_high and rising to trends: one unit to each side where all values are alike; no change counts as rising."""
    flat = F.col("high") - F.col("low") < 1e-9
    axis = {"axis_low": F.when(flat, F.col("low") - 1).otherwise(F.col("low")), "axis_high": F.when(flat, F.col("high") + 1).otherwise(F.col("high"))}
    return trends.withColumns(axis).withColumn("rising", F.col("last") >= F.col("first"))


def latest(metrics: DataFrame, most: int = 8) -> DataFrame:
    """Each owner's newest ``most`` matches; of matches of one time those with the greater id come first."""
    place = F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("created_at"), F.desc("match_id")))
    return metrics.withColumn("__place", place).where(F.col("__place") <= most).drop("__place")


def goal_results(metrics: DataFrame, goals: DataFrame, keys: tuple[str, ...] = ("match_id",)) -> DataFrame:
    """(match_id, metric, target, value, met) for every match and goal; met is null if it can't be measured.

    goals(metric, target); Spark broadcasts it where its size is known to be small. Other
    columns of metrics are kept if ``keys`` names them.
    """
    pairs = ", ".join(f"'{n}', cast(`{c}` as double)" for n, c in {"split": "split", "netTogether": "together", "netTime": "net", "unforced": "unforced_count", "winners": "winners", "breakPoints": "break_points", "distance": "pace"}.items())
    values = metrics.selectExpr(*keys, f"stack({len(GOALS)}, {pairs}) as (metric, value)")
    most = F.col("metric").isin([m for m, (up_to, *_) in GOALS.items() if up_to])
    met = F.when(F.col("value").isNotNull(), F.when(most, F.col("value") <= F.col("target")).otherwise(F.col("value") >= F.col("target")))
    return values.join(goals, "metric").select(*keys, "metric", "target", "value", met.alias("met"))


def goals_met(results: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(metric, met, checked): matches that met a goal, of those where it could be measured; by ``keys`` too where given."""
    return results.groupBy(*keys, "metric").agg(F.sum(F.when(F.col("met"), 1).otherwise(0)).cast("bigint").alias("met"), F.count("met").alias("checked"))


def _record(won: Column, decided: Column) -> list[Column]:
    return [F.count("*").alias("matches"), F.sum(F.when(won, 1).otherwise(0)).cast("bigint").alias("won"), F.sum(F.when(decided & ~won, 1).otherwise(0)).cast("bigint").alias("lost")]


def people(matches: DataFrame, names: DataFrame, winners: DataFrame) -> DataFrame:
    """(role, name, matches, won, lost, win_rate) of partners and rivals, by trimmed lower-case name.

    Counts are of my matches that aren't demos. The first spelling (by time, match, slot) is shown.
    """
    mine = matches.where("me is not null and not demo").join(winners, "match_id", "left").withColumn("my_team", team(F.col("me")))
    met = names.join(mine, "match_id").where("slot != me").where("trim(name) != ''")
    won, decided = F.col("winner").eqNullSafe(F.col("my_team")), F.col("winner").isNotNull()
    role = F.when(team(F.col("slot")) == F.col("my_team"), "partner").otherwise("rival")
    first = F.min_by(F.trim("name"), F.struct("created_at", "match_id", "slot")).alias("name")
    rows = met.groupBy(role.alias("role"), name_key(F.col("name")).alias("key")).agg(*_record(won, decided), first)
    return rows.withColumn("win_rate", F.when(F.col("won") + F.col("lost") > 0, F.col("won") / (F.col("won") + F.col("lost")))).drop("key")


def my_record(matches: DataFrame, winners: DataFrame) -> DataFrame:
    """(matches, won, lost) over my matches that aren't demos."""
    mine = matches.where("me is not null and not demo").join(winners, "match_id", "left")
    return mine.agg(*_record(F.col("winner").eqNullSafe(team(F.col("me"))), F.col("winner").isNotNull()))
