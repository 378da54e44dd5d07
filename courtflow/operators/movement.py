"""Player movement: times, distances, zones, heatmaps and the player statistics made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtflow.functions.geometry import LENGTH, WIDTH, cell, net_distance, slot_tag, team, zone
from courtflow.functions.text import SHOT_TYPES
from courtflow.operators.timeseries import segments, smooth

FASTEST = 8.0
PLAYER = ["match_id", "player_id"]


def frame_times(frames: DataFrame) -> DataFrame:
    """frames with dt: the time to the match's next frame, within 0..1; 0 for the last."""
    gap = F.lead("t").over(Window.partitionBy("match_id").orderBy("t", "frame_no")) - F.col("t")
    return frames.withColumn("dt", F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), gap)), F.lit(0.0)))


def detected_seconds(frames: DataFrame, poses: DataFrame) -> DataFrame:
    """(match_id, player_id, detected_seconds): frame times with a sighting; filled-in positions don't count."""
    seen = poses.where("player_id >= 0").select("match_id", "frame_no", "player_id", *(["interpolated"] if "interpolated" in poses.columns else [F.lit(False).alias("interpolated")]))
    timed = frame_times(frames).select("match_id", "frame_no", "dt")
    return seen.join(timed, ["match_id", "frame_no"]).groupBy(*PLAYER).agg(F.sum(F.when(F.col("interpolated"), 0.0).otherwise(F.col("dt"))).alias("detected_seconds"))


def smoothed_track(poses: DataFrame) -> DataFrame:
    """Positions of each player as centred five-row means, with the segment from the row before."""
    track = smooth(poses.where("player_id >= 0"), PLAYER, ["t", "frame_no"], ["court_x", "court_y"])
    return segments(track, PLAYER, ["t", "frame_no"], "t", "court_x", "court_y")


def movement(track: DataFrame) -> DataFrame:
    """Per player distance, speeds, tracked time, zone shares and net distance of a smoothed track.

    A segment counts if 0 < dt <= 1; a too fast one counts as tracked only.
    """
    counted = (F.col("dt") > 0) & (F.col("dt") <= 1)
    real = counted & (F.col("speed") <= FASTEST)
    share = lambda name: F.avg(F.when(zone(F.col("court_y")) == name, 1.0).otherwise(0.0)).alias(f"share_{name}")
    out = track.groupBy(*PLAYER).agg(
        F.coalesce(F.sum(F.when(real, F.col("dist"))), F.lit(0.0)).alias("distance"),
        F.coalesce(F.sum(F.when(real, F.col("dt"))), F.lit(0.0)).alias("moving"),
        F.coalesce(F.max(F.when(real, F.col("speed"))), F.lit(0.0)).alias("max_speed"),
        F.coalesce(F.sum(F.when(counted, F.col("dt"))), F.lit(0.0)).alias("tracked_seconds"),
        share("net"), share("transition"), share("baseline"),
        F.avg(net_distance(F.col("court_y"))).alias("avg_net_distance"),
    )
    return out.withColumn("avg_speed", F.when(F.col("moving") > 0, F.col("distance") / F.col("moving")).otherwise(0.0)).drop("moving")


def shot_counts(shots: DataFrame) -> DataFrame:
    """Per player shots of each type, all shots and the mean swing speed."""
    kinds = [F.sum(F.when(F.col("shot_type") == k, 1).otherwise(0)).cast("bigint").alias(f"n_{k.replace('-', '_')}") for k in SHOT_TYPES]
    return shots.groupBy(*PLAYER).agg(*kinds, F.count("*").alias("total_shots"), F.avg("swing_speed").alias("avg_swing_speed"))


def player_stats(frames: DataFrame, poses: DataFrame, shots: DataFrame) -> DataFrame:
    """One row for each player with a pose: movement, detected time and shots (zeros where there are none)."""
    counts = shot_counts(shots)
    zeros = {c: F.coalesce(c, F.lit(0)) for c in counts.columns if c not in PLAYER}
    stats = movement(smoothed_track(poses)).join(detected_seconds(frames, poses), PLAYER, "left").join(counts, PLAYER, "left")
    return stats.withColumns(zeros).withColumn("team", team(F.col("player_id"))).withColumn("label", slot_tag(F.col("player_id")))


def heatmap(track: DataFrame) -> DataFrame:
    """(match_id, player_id, row, col, share): occupied unit cells of the court, clamped at its edge."""
    cells = track.groupBy(*PLAYER, cell(F.col("court_y"), LENGTH).alias("row"), cell(F.col("court_x"), WIDTH).alias("col")).agg(F.count("*").alias("n"))
    return cells.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*PLAYER))).drop("n")


def combined_heatmap(heat: DataFrame) -> DataFrame:
    """Per match cell the sum of shares, the player with the largest (ties: the least id) and the match's maximum."""
    top = F.min_by("player_id", F.struct(-F.col("share"), "player_id")).alias("top_player")
    cells = heat.where("share > 0").groupBy("match_id", "row", "col").agg(F.sum("share").alias("total"), top)
    return cells.withColumn("most", F.max("total").over(Window.partitionBy("match_id")))


def dominant_hand(peaks: DataFrame) -> DataFrame:
    """(match_id, player_id, hand) from swing peaks with wrist 0 (left) or 1 (right): right unless most are left."""
    right, every = F.sum(F.when(F.col("wrist") == 1, 1).otherwise(0)), F.count("*")
    return peaks.groupBy(*PLAYER).agg(F.when(right >= every - right, "right").otherwise("left").alias("hand"))


def canonical_ids(poses: DataFrame) -> DataFrame:
    """(match_id, raw_id, player_id): the two best-seen tracks of each side, left to right; others take free ids.

    Near side is mean y > 10 and has ids 0 and 1. A track alone on its side takes the id
    of its half. Tracks beyond four get no row.
    """
    support = poses.where("player_id >= 0").groupBy("match_id", F.col("player_id").alias("raw_id")).agg(F.count("*").alias("n"), F.avg("court_x").alias("mx"), F.avg("court_y").alias("my"))
    support = support.withColumn("base", F.when(F.col("my") > 10, 0).otherwise(2))
    side = Window.partitionBy("match_id", "base")
    ranked = support.withColumn("place", F.row_number().over(side.orderBy(F.desc("n"), "raw_id")))
    best = ranked.where("place <= 2").withColumns({"size": F.count("*").over(side), "across": F.row_number().over(side.orderBy("mx", "raw_id")) - 1})
    alone = F.when(F.col("mx") < 5, 0).otherwise(1)
    best = best.select("match_id", "raw_id", (F.col("base") + F.when(F.col("size") == 1, alone).otherwise(F.col("across"))).alias("player_id"))
    used = best.groupBy("match_id").agg(F.collect_set("player_id").alias("used"))
    free = used.select("match_id", F.posexplode(F.array_sort(F.array_except(F.array(*map(F.lit, range(4))), "used"))).alias("at", "player_id"))
    left = ranked.where("place > 2").withColumn("at", F.row_number().over(Window.partitionBy("match_id").orderBy(F.desc("n"), "base", "raw_id")) - 1)
    return best.unionByName(left.join(free, ["match_id", "at"]).select("match_id", "raw_id", "player_id"))


def swapped(poses: DataFrame, a: int, b: int, from_t: float) -> DataFrame:
    """Poses with two identities exchanged from a time on; statistics are recomputed from the result."""
    late, p = F.col("t") >= from_t, F.col("player_id")
    return poses.withColumn("player_id", F.when(late & (p == a), F.lit(b)).when(late & (p == b), F.lit(a)).otherwise(p))
