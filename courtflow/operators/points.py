"""Rallies, tagged points and edits of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtflow.functions.geometry import team, zone
from courtflow.operators.timeseries import islands, within_intervals

RALLY_GAP = 4.0
RALLY = ["match_id", "rally_idx"]


def rallies(shots: DataFrame, gap: float = RALLY_GAP) -> DataFrame:
    """(match_id, rally_idx, start_t, end_t, n_shots): runs of at least two shots without a pause over ``gap``."""
    runs = islands(shots.select("match_id", "t", "seq"), ["match_id"], ["t", "seq"], "t", gap)
    found = runs.groupBy("match_id", "island").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count("*").alias("n_shots")).where("n_shots >= 2")
    order = F.row_number().over(Window.partitionBy("match_id").orderBy("island")) - 1
    return found.select("match_id", order.cast("bigint").alias("rally_idx"), F.greatest(F.lit(0.0), F.col("first_t") - 0.5).alias("start_t"), (F.col("last_t") + 1).alias("end_t"), "n_shots")


def shots_in_rallies(shots: DataFrame, of: DataFrame) -> DataFrame:
    """Each shot with the rallies whose span holds it (spans of neighbours may overlap)."""
    return within_intervals(shots, of.select(*RALLY, "start_t", "end_t"), ["match_id"], "t", "start_t", "end_t", 10.0)


def _one(inside: DataFrame, latest: bool) -> DataFrame:
    order = [F.desc("t"), F.desc("seq")] if latest else ["t", "seq"]
    return inside.withColumn("__place", F.row_number().over(Window.partitionBy(*RALLY).orderBy(*order))).where("__place = 1").drop("__place")


def last_hitters(shots: DataFrame, of: DataFrame) -> DataFrame:
    """Every rally with the player of its last shot (null if it has none)."""
    last = _one(shots_in_rallies(shots, of), True).select(*RALLY, F.col("player_id").alias("last_player"))
    return of.select(*RALLY).join(last, RALLY, "left")


def marked_serves(shots: DataFrame, of: DataFrame) -> DataFrame:
    """Shots with the first of each rally as a serve, if hit from the baseline and not overhead."""
    first = _one(shots_in_rallies(shots, of), False).select("match_id", "seq", F.lit(True).alias("__first")).distinct()
    serve = F.col("__first") & (zone(F.col("court_y")) == "baseline") & (F.col("shot_type") != "overhead")
    return shots.join(first, ["match_id", "seq"], "left").withColumn("shot_type", F.when(serve, "serve").otherwise(F.col("shot_type"))).drop("__first")


def rally_servers(serves: DataFrame, of: DataFrame) -> DataFrame:
    """Every rally with the team of its first serve, or null."""
    first = _one(shots_in_rallies(serves.where("shot_type = 'serve'"), of), False).select(*RALLY, team(F.col("player_id")).alias("server"))
    return of.select(*RALLY).join(first, RALLY, "left")


def default_player(winner: Column, ending: Column, last: Column) -> Column:
    """The last hitter if on the side that decides the point: winners by the winner's team, errors by the other."""
    side = F.when(ending == "winner", winner).otherwise(F.when(winner == "A", "B").otherwise("A"))
    return F.when(last.isNotNull() & (team(last) == side), last)


def tag_upsert(tags: DataFrame, edits: DataFrame) -> DataFrame:
    """Tags with edits applied: an edit replaces its rally's tag, one with a null winner deletes it."""
    kept = tags.join(edits.select(*RALLY), RALLY, "left_anti")
    return kept.unionByName(edits.where("winner is not null"))


def first_untagged(of: DataFrame, tags: DataFrame) -> DataFrame:
    """(match_id, rally_idx): each match's first rally without a tag."""
    return of.select(*RALLY).join(tags.select(*RALLY), RALLY, "left_anti").groupBy("match_id").agg(F.min("rally_idx").alias("rally_idx"))


def shot_edits(shots: DataFrame, edits: DataFrame) -> DataFrame:
    """Shots with corrections by (match_id, t, player_id, shot_type): deleted ones go, others take a new type and are marked."""
    key = ["match_id", "t", "player_id", "shot_type"]
    joined = shots.join(edits.select(*key, "new_type", "deleted"), key, "left").where(~F.coalesce(F.col("deleted"), F.lit(False)))
    return joined.withColumn("edited", F.col("new_type").isNotNull()).withColumn("shot_type", F.coalesce("new_type", "shot_type")).drop("new_type", "deleted")


def point_stats(of: DataFrame, tags: DataFrame, patterns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scores per match, win rates per match, team and own pattern, endings per player); tags without a rally don't count."""
    valid = tags.join(of.select(*RALLY), RALLY)
    won = lambda t: F.sum(F.when(F.col("winner") == t, 1).otherwise(0)).cast("bigint")
    scores = valid.groupBy("match_id").agg(F.count("*").alias("tagged"), won("A").alias("points_a"), won("B").alias("points_b"))
    rates = (
        valid.join(patterns, RALLY).groupBy("match_id", "team", "pattern")
        .agg(F.sum(F.when(F.col("winner") == F.col("team"), 1).otherwise(0)).cast("bigint").alias("won"), F.count("*").alias("played"))
        .withColumn("rank_rate", (F.col("won") + 1) / (F.col("played") + 2))
    )
    count = lambda e: F.sum(F.when(F.col("ending") == e, 1).otherwise(0)).cast("bigint").alias(f"n_{e}")
    endings = valid.where("player is not null").groupBy("match_id", F.col("player").alias("player_id")).agg(count("winner"), count("forced"), count("unforced"))
    return scores, rates, endings
