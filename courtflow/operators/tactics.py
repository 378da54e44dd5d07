"""How pairs stand: time shares of patterns, gaps between partners, net takings, patterns of rallies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtflow.functions.geometry import net_distance, pair_pattern
from courtflow.functions.text import PATTERNS
from courtflow.operators.movement import frame_times
from courtflow.operators.timeseries import within_intervals


def paired_frames(frames: DataFrame, poses: DataFrame) -> DataFrame:
    """One row for each frame and team with both partners in it: positions, pattern, dt (a last frame counts 0.1 s).

    One aggregation by frame and team instead of a join of the poses with themselves.
    """
    at = lambda odd, c: F.max(F.when(F.col("player_id") % 2 == odd, F.col(c)))
    pairs = (
        poses.where("player_id between 0 and 3")
        .groupBy("match_id", "frame_no", F.when(F.col("player_id") < 2, "A").otherwise("B").alias("team"))
        .agg(*[at(odd, c).alias(f"{c[-1]}{odd}") for odd in (0, 1) for c in ("court_x", "court_y")])
        .where("x0 is not null and x1 is not null")
    )
    timed = frame_times(frames).withColumn("dt", F.when(F.col("dt") == 0, 0.1).otherwise(F.col("dt")))
    return pairs.join(timed, ["match_id", "frame_no"]).withColumn("pattern", pair_pattern(F.col("y0"), F.col("y1")))


def team_tactics(pairs: DataFrame) -> DataFrame:
    """Per match and team the paired time, shares of the patterns, mean gaps (all by time), and net takings.

    A net taking is a paired frame with both at the net after one (of the paired ones) without.
    """
    both = F.col("pattern") == "net"
    before = F.lag(both, 1, False).over(Window.partitionBy("match_id", "team").orderBy("t", "frame_no"))
    mean = lambda x: F.sum(x * F.col("dt")) / F.sum("dt")
    depth = F.abs(net_distance(F.col("y0")) - net_distance(F.col("y1")))
    return (
        pairs.withColumn("taken", both & ~before)
        .groupBy("match_id", "team")
        .agg(
            F.sum("dt").alias("paired_seconds"),
            *[mean(F.when(F.col("pattern") == p, 1.0).otherwise(0.0)).alias(f"share_{p}") for p in PATTERNS],
            mean(F.hypot(F.col("x0") - F.col("x1"), F.col("y0") - F.col("y1"))).alias("avg_spacing"),
            mean(depth).alias("avg_depth_gap"),
            mean(F.abs(F.col("x0") - F.col("x1"))).alias("avg_lateral_gap"),
            F.sum(F.when(F.col("taken"), 1).otherwise(0)).cast("bigint").alias("net_takings"),
        )
    )


def rally_patterns(pairs: DataFrame, rallies: DataFrame) -> DataFrame:
    """(match_id, rally_idx, team, pattern): the pattern of most frames in each rally; of ties the one seen first."""
    inside = within_intervals(pairs, rallies.select("match_id", "rally_idx", "start_t", "end_t"), ["match_id"], "t", "start_t", "end_t", 10.0)
    counted = inside.groupBy("match_id", "rally_idx", "team", "pattern").agg(F.count("*").alias("n"), F.min(F.struct("t", "frame_no")).alias("first"))
    best = F.row_number().over(Window.partitionBy("match_id", "rally_idx", "team").orderBy(F.desc("n"), "first"))
    return counted.withColumn("place", best).where("place = 1").select("match_id", "rally_idx", "team", "pattern")
