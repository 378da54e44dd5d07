"""The whole way of a match: from detected bodies to who is who, shots, rallies, movement and positioning."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtflow.operators import movement, points, shots, tactics, timeseries, tracking


@dataclass
class Analysis:
    """poses (gaps filled), shots (serves marked), rallies, stats by player, tactics by team, patterns by rally and team.

    Shots, and what is made of them, are found when they are first asked for.
    """

    frames: DataFrame
    seen: DataFrame
    found: Callable[[], DataFrame]

    @cached_property
    def poses(self) -> DataFrame:
        return timeseries.fill_gaps(self.frames, self.seen)

    @cached_property
    def _numbered(self) -> DataFrame:
        return self.found()

    @cached_property
    def rallies(self) -> DataFrame:
        return points.rallies(self._numbered)

    @cached_property
    def shots(self) -> DataFrame:
        return points.marked_serves(self._numbered, self.rallies)

    @cached_property
    def stats(self) -> DataFrame:
        return movement.player_stats(self.frames, self.poses, self.shots)

    @cached_property
    def _paired(self) -> DataFrame:
        return tactics.paired_frames(self.frames, self.poses)

    @cached_property
    def tactics(self) -> DataFrame:
        return tactics.team_tactics(self._paired)

    @cached_property
    def patterns(self) -> DataFrame:
        return tactics.rally_patterns(self._paired, self.rallies)


def analysed(
    frames: DataFrame, detections: DataFrame, aspect: float, keep: Callable[[DataFrame, str], DataFrame], threshold: float = shots.SENSITIVITY["normal"], cooldown: float = shots.COOLDOWN
) -> Analysis:
    """Analyses frames(match_id, frame_no, t) and detections(match_id, frame_no, t, seq, x, y, landmarks).

    ``seq`` numbers the detections of a frame; those that the tracker gives to nobody
    take no part. All steps are keyed by match. ``keep(rows, name)`` writes a table and
    reads it back: the named poses and the shots, which all other results are made of, so
    that the tracker and the swings' folds run once. Shots are numbered by time and, of
    one time, by player.
    """
    at = ["match_id", "t", "seq"]
    who = tracking.identified(detections).where("player_id >= 0").select(*at, "player_id")
    seen = keep(detections.join(who, at).withColumnsRenamed({"x": "court_x", "y": "court_y"}), "poses")

    def found() -> DataFrame:
        swung = shots.detected_shots(seen, aspect, threshold, cooldown)
        return keep(swung.withColumn("seq", F.row_number().over(Window.partitionBy("match_id").orderBy("t", "player_id"))), "shots")

    return Analysis(frames, seen, found)
