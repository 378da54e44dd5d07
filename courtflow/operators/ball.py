"""Ball tracks: cleaning, turns and events, confirmed shots and lobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtflow.operators.timeseries import _chained, asof_nearest, within_intervals

TURN_COS, SLOWEST, NEXT_WITHIN, APART = 0.5, 0.05, 0.25, 0.12
TOUCH = 0.06


def _beside(step: int):
    w = Window.partitionBy("match_id").orderBy("t", "seq")
    f = F.lag if step < 0 else F.lead
    return {c: f(c).over(w) for c in ("t", "x", "y")}


def clean_track(obs: DataFrame) -> DataFrame:
    """Observations with a neighbour in the track that is near in time and place."""

    def near(o: dict[str, Column]) -> Column:
        dt = F.abs(o["t"] - F.col("t"))
        close = (dt > 0) & (dt < 0.25) & (F.hypot(o["x"] - F.col("x"), o["y"] - F.col("y")) < 0.05 + 1.5 * dt)
        return F.coalesce(close, F.lit(False))

    return obs.withColumn("__near", near(_beside(-1)) | near(_beside(1))).where("__near").drop("__near")


def turns(track: DataFrame) -> DataFrame:
    """Observations at which the ball turns by 60 degrees or more: adds the velocities before and after."""
    a, c = _beside(-1), _beside(1)
    v = {
        "vx0": (F.col("x") - a["x"]) / (F.col("t") - a["t"]), "vy0": (F.col("y") - a["y"]) / (F.col("t") - a["t"]),
        "vx1": (c["x"] - F.col("x")) / (c["t"] - F.col("t")), "vy1": (c["y"] - F.col("y")) / (c["t"] - F.col("t")),
        "__gap": F.greatest(F.col("t") - a["t"], c["t"] - F.col("t")), "__ends": a["t"].isNull() | c["t"].isNull(),
    }
    moved = track.withColumns(v).where(~F.col("__ends") & (F.col("__gap") <= NEXT_WITHIN))
    s0, s1 = F.hypot("vx0", "vy0"), F.hypot("vx1", "vy1")
    cos = (F.col("vx0") * F.col("vx1") + F.col("vy0") * F.col("vy1")) / (s0 * s1)
    return moved.where((s0 >= SLOWEST) & (s1 >= SLOWEST)).where(cos <= TURN_COS).drop("__gap", "__ends")


def events(turned: DataFrame) -> DataFrame:
    """(match_id, seq, t, x, y, kind, player_id): one event a turn, the first of those within 0.12 s of the one kept.

    turned may have ``wrist_player`` and ``wrist_distance`` (the nearest visible wrist).
    Near a wrist the ball was hit; falling then rising it bounced; else it met a wall.
    """
    has = "wrist_distance" in turned.columns
    hit = F.coalesce(F.col("wrist_distance") < TOUCH, F.lit(False)) if has else F.lit(False)
    kind = F.when(hit, "hit").when((F.col("vy0") > 0) & (F.col("vy1") < 0), "bounce").otherwise("wall")
    player = F.when(hit, F.col("wrist_player")) if has else F.lit(None).cast("int")
    row = F.struct("t", "seq", "x", "y", kind.alias("kind"), player.alias("player_id"))
    kept = _chained(turned, ["match_id"], "t", APART).groupBy("match_id", "__chain").agg(F.array_sort(F.collect_list(row)).alias("a")).select(
        "match_id",
        F.aggregate(
            "a", F.slice("a", 1, 0),
            lambda acc, e: F.when((F.size(acc) > 0) & (e["t"] - F.get(acc, F.size(acc) - 1)["t"] < APART), acc).otherwise(F.concat(acc, F.array(e))),
        ).alias("k"),
    )
    return kept.select("match_id", F.inline("k")).select("match_id", "seq", "t", "x", "y", "kind", "player_id")


def nearest_wrists(turned: DataFrame, wrists: DataFrame, visible: float = 0.3) -> DataFrame:
    """Adds ``wrist_player`` and ``wrist_distance``: the wrist nearest to the ball in the frame nearest in time, else nulls.

    wrists(match_id, t, player_id, x, y, visibility) has a row for each wrist of a frame;
    of equally near ones the least player's counts.
    """
    at = asof_nearest(turned, wrists.select("match_id", "t").distinct(), ["match_id"], "t", [])
    seen = wrists.where(F.col("visibility") > visible).select("match_id", F.col("t").alias("near_t"), "player_id", F.col("x").alias("wx"), F.col("y").alias("wy"))
    reach = F.hypot(F.col("x") - F.col("wx"), F.col("y") - F.col("wy"))
    best = at.join(seen, ["match_id", "near_t"]).groupBy("match_id", "seq").agg(F.min(F.struct(reach.alias("d"), "player_id")).alias("w"))
    return turned.join(best, ["match_id", "seq"], "left").withColumns({"wrist_player": F.col("w.player_id"), "wrist_distance": F.col("w.d")}).drop("w")


def annotated_shots(shots: DataFrame, found: DataFrame, track: DataFrame, far_y: float, far_depth: float) -> DataFrame:
    """Shots with ``confirmed`` and ``lob`` from ball events.

    A shot is confirmed by the first hit of its player within 0.4 s. It is a lob if at
    least three observations follow until the next event (2.5 s at most), the highest
    above the lob line, and the shot isn't overhead. ``found`` comes from ``events``,
    whose rows are at least 0.12 s apart, so a hit's next event is the next row. Flights
    and hits near a shot meet by time bins.
    """
    ahead = F.lead("t").over(Window.partitionBy("match_id").orderBy("t", "seq"))
    until = F.least(F.coalesce("next_t", F.lit(float("inf"))), F.col("t") + 2.5)
    hits = found.withColumn("next_t", ahead).where("kind = 'hit'").select("match_id", "player_id", F.col("t").alias("hit_t"), F.col("seq").alias("hit_seq"), until.alias("until"))
    flown = within_intervals(track.select("match_id", "t", "y"), hits.drop("player_id"), ["match_id"], "t", "hit_t", "until", 2.5).where("t > hit_t")
    flights = flown.groupBy("match_id", "hit_seq").agg(F.count("*").alias("n"), F.min("y").alias("apex"))
    hits = hits.join(flights, ["match_id", "hit_seq"], "left").withColumns({"from_t": F.col("hit_t") - 0.4, "to_t": F.col("hit_t") + 0.4})
    own_key = ["match_id", "player_id"]
    near = within_intervals(shots.select("match_id", "seq", "t", "player_id"), hits, own_key, "t", "from_t", "to_t", 0.8).where("abs(hit_t - t) < 0.4")
    first = near.withColumn("__place", F.row_number().over(Window.partitionBy("match_id", "seq").orderBy("hit_t", "hit_seq"))).where("__place = 1")
    flown = F.coalesce((F.col("n") >= 3) & (F.col("apex") < far_y - 0.5 * far_depth), F.lit(False))
    marks = first.select("match_id", "seq", F.lit(True).alias("__hit"), flown.alias("__flown"))
    hit, lob = F.coalesce("__hit", F.lit(False)), F.coalesce("__flown", F.lit(False)) & (F.col("shot_type") != "overhead")
    own = shots.drop("confirmed", "lob") if {"confirmed", "lob"} & set(shots.columns) else shots
    return own.join(marks, ["match_id", "seq"], "left").withColumns({"confirmed": hit, "lob": lob}).drop("__hit", "__flown")


def coverage(track: DataFrame) -> DataFrame:
    """(match_id, covered): seconds between neighbouring observations less than 0.2 s apart."""
    dt = F.col("t") - F.lag("t").over(Window.partitionBy("match_id").orderBy("t", "seq"))
    gaps = track.withColumn("dt", dt)
    return gaps.groupBy("match_id").agg(F.coalesce(F.sum(F.when((F.col("dt") > 0) & (F.col("dt") < 0.2), F.col("dt"))), F.lit(0.0)).alias("covered"))


# Bounds of a ball's colour, as shares of the pixel's brightness.
LEAST_SUM, MOST_BLUE, LEAST_GREEN, LEAST_RED, MOST_APART = 250, 0.24, 0.36, 0.24, 0.12


def ball_color(r: Column, g: Column, b: Column) -> Column:
    """Fluorescent yellow-green: red and green alike and strong, blue weak, not dark."""
    total = F.greatest(r + g + b, F.lit(1))
    return (r + g + b >= LEAST_SUM) & (b / total < MOST_BLUE) & (g / total > LEAST_GREEN) & (r / total > LEAST_RED) & (F.abs(r - g) / total < MOST_APART)


def trail(obs: DataFrame, now: float, seconds: float = 0.5) -> DataFrame:
    """Observations of the last ``seconds`` before a time, with an opacity that fades with age."""
    return obs.where(F.col("t").between(now - seconds, now)).withColumn("alpha", 1 - (F.lit(now) - F.col("t")) / seconds)
