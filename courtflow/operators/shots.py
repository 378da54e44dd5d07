"""Shots from body landmarks: wrist speeds, swing peaks, classes; and shots from heard hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtflow.functions.geometry import team, zone
from courtflow.operators.movement import PLAYER, dominant_hand
from courtflow.operators.timeseries import local_peaks, spaced_peaks

# Places of landmarks in a pose of 33.
NOSE, SHOULDERS, WRISTS, HIPS, ANKLES = 0, (11, 12), (15, 16), (23, 24), (27, 28)
#: Torso lengths a second that make a swing, by sensitivity; seconds between swings.
SENSITIVITY = {"low": 12.0, "normal": 9.0, "high": 6.5}
SAMPLING_FPS = {"quick": 5, "standard": 10, "best": 15}
COOLDOWN, VISIBLE = 0.8, 0.4
#: What the middles of landmarks are off by in their last bits is far below this.
NOISE = 1e-12
HIT_WINDOW, MIN_RETURN, IN_RALLY = 0.35, 0.45, 3.0


def body_frames(poses: DataFrame, aspect: float) -> DataFrame:
    """poses(match_id, t, player_id, court_x, court_y, landmarks) with torso, hip and shoulder middles, nose and visible wrists.

    Landmarks are in image units, x widened by the aspect. Poses of players without an
    id, without 33 landmarks or without a torso are dropped.
    """
    point = lambda i: F.struct((F.get("landmarks", F.lit(i))["x"] * aspect).alias("x"), F.get("landmarks", F.lit(i))["y"].alias("y"))
    middle = lambda a, b: F.struct(((point(a)["x"] + point(b)["x"]) / 2).alias("x"), ((point(a)["y"] + point(b)["y"]) / 2).alias("y"))
    wrist = lambda i: F.when(F.get("landmarks", F.lit(i))["visibility"] >= VISIBLE, point(i))
    body = poses.where((F.col("player_id") >= 0) & (F.size("landmarks") >= 33)).withColumns(
        {
            "hip": middle(*HIPS), "shoulder": middle(*SHOULDERS), "nose": point(NOSE), "left_shoulder": point(SHOULDERS[0]), "right_shoulder": point(SHOULDERS[1]),
            "wrist0": wrist(WRISTS[0]), "wrist1": wrist(WRISTS[1]),
        }
    )
    torso = F.hypot(F.col("shoulder.x") - F.col("hip.x"), F.col("shoulder.y") - F.col("hip.y"))
    return body.withColumn("torso", torso).where("torso >= 0.001").drop("landmarks")


def wrist_speeds(body: DataFrame) -> DataFrame:
    """Body frames with the faster wrist's speed against the hips since the player's frame before, in torso lengths a second.

    Frames more than half a second after the one before, and those without a wrist seen
    in both, are dropped; of equal speeds the left wrist's counts (``wrist`` 0).
    """
    w = Window.partitionBy(*PLAYER).orderBy("t")
    dt, torso = F.col("t") - F.lag("t").over(w), (F.col("torso") + F.lag("torso").over(w)) / 2
    before_hip = F.lag("hip").over(w)

    def speed(i: int) -> Column:
        now, then = F.col(f"wrist{i}"), F.lag(f"wrist{i}").over(w)
        moved = [(now[c] - F.col("hip")[c]) - (then[c] - before_hip[c]) for c in "xy"]
        return F.hypot(*moved) / torso / dt

    timed = body.withColumns({"dt": dt, "v0": speed(0), "v1": speed(1)}).where("dt > 0 and dt <= 0.5 and (v0 is not null or v1 is not null)")
    right = F.col("v0").isNull() | (F.col("v1") > F.col("v0"))
    return timed.withColumn("wrist", F.when(F.coalesce(right, F.lit(False)), 1).otherwise(0)).withColumn("speed", F.when(F.col("wrist") == 1, F.col("v1")).otherwise(F.col("v0"))).drop("v0", "v1", "dt")


def swing(hand: Column) -> Column:
    """forehand, backhand or overhead of a body frame at the peak of a swing with that hand; a wrist in the middle of the shoulders is a forehand's."""
    own, other = F.when(hand == "left", F.col("wrist0")).otherwise(F.col("wrist1")), F.when(hand == "left", F.col("wrist1")).otherwise(F.col("wrist0"))
    wrist = F.coalesce(own, other)
    side = F.when(hand == "right", 1.0).otherwise(-1.0)
    across = [side * (F.col("right_shoulder")[c] - F.col("left_shoulder")[c]) for c in "xy"]
    reach = [wrist[c] - F.col("shoulder")[c] for c in "xy"]
    ahead = reach[0] * across[0] + reach[1] * across[1] >= -NOISE
    return F.when(wrist.isNull(), "forehand").when(F.col("nose.y") - wrist["y"] > F.col("torso") * 0.15, "overhead").when(ahead, "forehand").otherwise("backhand")


def shot_type(base: Column, court_y: Column) -> Column:
    """A swing class as a shot type: volleys at the net, overheads anywhere."""
    return F.when((base != "overhead") & (zone(court_y) == "net"), F.concat(base, F.lit("-volley"))).otherwise(base)


def swing_peaks(samples: DataFrame, threshold: float = SENSITIVITY["normal"], cooldown: float = COOLDOWN) -> DataFrame:
    """Samples (match_id, player_id, t, speed, ...) that are local maxima of at least the threshold, thinned by the cooldown.

    Within a cooldown the faster peak stays and becomes the anchor: a fold over each
    player's peak times, joined back to the samples.
    """
    peaks = local_peaks(samples, PLAYER, ["t"], "speed", threshold)
    kept = spaced_peaks(peaks, PLAYER, "t", "speed", cooldown).select(*PLAYER, "t")
    return samples.join(kept, [*PLAYER, "t"], "left_semi")


def _as_shots(rows: DataFrame, hand: Column, t: Column, heard: bool) -> DataFrame:
    kind = shot_type(swing(hand), F.col("court_y"))
    return rows.select("match_id", t.alias("t"), "player_id", kind.alias("shot_type"), F.col("speed").alias("swing_speed"), "court_x", "court_y", zone(F.col("court_y")).alias("zone"), F.lit(heard).alias("heard"))


def detected_shots(poses: DataFrame, aspect: float, threshold: float = SENSITIVITY["normal"], cooldown: float = COOLDOWN) -> DataFrame:
    """Shots from swings alone: peaks of wrist speed, classed with each player's dominant hand."""
    peaks = swing_peaks(wrist_speeds(body_frames(poses, aspect)), threshold, cooldown)
    hands = dominant_hand(peaks)
    return _as_shots(peaks.join(hands, PLAYER), F.col("hand"), F.col("t"), False)


def heard_shots(hits: DataFrame, poses: DataFrame, aspect: float, threshold: float = SENSITIVITY["normal"]) -> DataFrame:
    """Shots at heard hits(match_id, t): who swung fastest within 0.35 s, sides taking turns within a rally.

    Each hit meets the samples around it by time bins and keeps each player's fastest;
    one fold per match then picks hitters in time order.
    """
    samples = wrist_speeds(body_frames(poses, aspect))
    hands = dominant_hand(swing_peaks(samples, threshold))
    bins = F.explode(F.sequence(F.floor((F.col("hit_t") - HIT_WINDOW) / 0.7), F.floor((F.col("hit_t") + HIT_WINDOW) / 0.7)))
    near = hits.select("match_id", F.col("t").alias("hit_t")).withColumn("bin", bins).join(samples.withColumn("bin", F.floor(F.col("t") / 0.7)), ["match_id", "bin"]).where(F.abs(F.col("t") - F.col("hit_t")) <= HIT_WINDOW)
    best = F.row_number().over(Window.partitionBy("match_id", "hit_t", "player_id").orderBy(F.desc("speed"), "t"))
    near = near.withColumn("place", best).where("place = 1")
    lists = near.groupBy("match_id", "hit_t").agg(F.sort_array(F.collect_list(F.struct("speed", (-F.col("player_id")).alias("minus_player"))), False).alias("near"))
    ordered = lists.groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct("hit_t", "near"))).alias("hits"))
    least = threshold * 0.35
    state = F.struct(F.lit(None).cast("string").alias("team"), F.lit(float("-inf")).alias("t"), F.array().cast("array<struct<hit_t:double,player_id:int>>").alias("picked"))

    def step(s: Column, h: Column) -> Column:
        who = lambda x: (-x["minus_player"]).cast("int")
        other = F.filter(h["near"], lambda x: (team(who(x)) != s["team"]) & (x["speed"] >= least * 0.5))
        anyone = F.filter(h["near"], lambda x: x["speed"] >= least)
        pick = F.get(F.when((h["hit_t"] - s["t"] < IN_RALLY) & s["team"].isNotNull(), other).otherwise(anyone), F.lit(0))
        taken = F.struct(team(who(pick)).alias("team"), h["hit_t"].alias("t"), F.concat(s["picked"], F.array(F.struct(h["hit_t"].alias("hit_t"), who(pick).alias("player_id")))).alias("picked"))
        return F.when((h["hit_t"] - s["t"] < MIN_RETURN) | pick.isNull(), s).otherwise(taken)

    picked = ordered.select("match_id", F.inline(F.aggregate("hits", state, step)["picked"]))
    rows = near.join(picked, ["match_id", "hit_t", "player_id"]).join(hands, PLAYER, "left")
    return _as_shots(rows, F.coalesce("hand", F.lit("right")), F.col("hit_t"), True)


def best_snapshot(poses: DataFrame) -> DataFrame:
    """(match_id, player_id, t, score): each player's clearest full pose: tall, visible, alone. First of equals.

    poses(match_id, frame_no, t, player_id, interpolated, landmarks).
    """
    seen = F.filter("landmarks", lambda p: p["visibility"] >= 0.5)
    full = poses.where(F.size("landmarks") >= 33).withColumn("seen", seen)
    rest = full.groupBy("match_id", "frame_no").agg(F.collect_list(F.struct("player_id", F.get("landmarks", F.lit(NOSE))["x"].alias("x"), F.get("landmarks", F.lit(NOSE))["y"].alias("y"))).alias("others"))
    box = {f"{c}{e}": f(F.col(f"seen.{c}")) for c in "xy" for e, f in (("0", F.array_min), ("1", F.array_max))}
    own = full.where(~F.coalesce(F.col("interpolated"), F.lit(False)) & (F.size("seen") >= 20)).withColumns(box).withColumn("h", F.col("y1") - F.col("y0")).where("h > 0")
    high = F.col("h") * 1.35
    wide = F.greatest(F.col("x1") - F.col("x0") + F.col("h") * 0.2, high * 0.75)
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    crowded = F.exists("others", lambda o: (o["player_id"] != F.col("player_id")) & (F.abs(o["x"] - cx) < wide * 0.6) & (F.abs(o["y"] - cy) < high * 0.6))
    score = F.col("h") * F.size("seen") / 33 * F.when(crowded, 0.3).otherwise(1.0)
    ranked = own.join(rest, ["match_id", "frame_no"]).withColumn("score", score)
    place = F.row_number().over(Window.partitionBy(*PLAYER).orderBy(F.desc("score"), "t"))
    return ranked.withColumn("place", place).where("place = 1").select(*PLAYER, "t", "score")


def pose_quality(landmarks: Column) -> Column:
    """Mean visibility of shoulders, wrists, hips and ankles, halved if a foot lies outside the picture."""
    key = [*SHOULDERS, *WRISTS, *HIPS, *ANKLES]
    mean = sum((F.get(landmarks, F.lit(i))["visibility"] for i in key[1:]), F.get(landmarks, F.lit(key[0]))["visibility"]) / len(key)
    inside = F.lit(True)
    for i in ANKLES:
        inside = inside & F.get(landmarks, F.lit(i))["y"].between(-0.02, 1.02)
    return F.when(inside, mean).otherwise(mean * 0.5)


def pose_box(landmarks: Column) -> Column:
    """x0, y0, x1, y1 around the visible landmarks, or around all if fewer than four are visible."""
    seen = F.filter(landmarks, lambda p: p["visibility"] > 0.3)
    use = F.when(F.size(seen) >= 4, seen).otherwise(landmarks)
    every = lambda c: F.transform(use, lambda p: p[c])
    return F.struct(*[f(every(c)).alias(f"{c}{e}") for c in "xy" for e, f in (("0", F.array_min), ("1", F.array_max))])


def padded_box(landmarks: Column) -> Column:
    """x0, y0, x1, y1 around a player's visible landmarks with some room, in which no ball is looked for; all 0 if none is visible."""
    seen = F.filter(landmarks, lambda p: p["visibility"] > 0.2)
    end = lambda c, f: f(F.transform(seen, lambda p: p[c]))
    tall = end("y", F.array_max) - end("y", F.array_min)
    sides = {"x0": end("x", F.array_min) - tall * 0.12, "y0": end("y", F.array_min) - tall * 0.1, "x1": end("x", F.array_max) + tall * 0.12, "y1": end("y", F.array_max) + tall * 0.05}
    return F.struct(*[F.coalesce(v, F.lit(0.0)).alias(k) for k, v in sides.items()])


def same_person(a: Column, b: Column) -> Column:
    """Whether two poses show one body: their boxes overlap by 0.45 of the smaller, or their hips nearly meet."""
    p, q = pose_box(a), pose_box(b)
    over = lambda c: F.greatest(F.lit(0.0), F.least(p[f"{c}1"], q[f"{c}1"]) - F.greatest(p[f"{c}0"], q[f"{c}0"]))
    area = lambda r: F.greatest(F.lit(1e-9), (r["x1"] - r["x0"]) * (r["y1"] - r["y0"]))
    hip = lambda pose, c: (F.get(pose, F.lit(HIPS[0]))[c] + F.get(pose, F.lit(HIPS[1]))[c]) / 2
    apart = F.hypot(hip(a, "x") - hip(b, "x"), hip(a, "y") - hip(b, "y"))
    tall = F.greatest(p["y1"] - p["y0"], q["y1"] - q["y0"])
    return (over("x") * over("y") / F.least(area(p), area(q)) > 0.45) | (apart < 0.25 * tall)


def in_frame(landmarks: Column, tile: Column) -> Column:
    """Landmarks of a tile (x, y, w, h) in the frame's coordinates."""
    return F.transform(landmarks, lambda p: F.struct((tile["x"] + p["x"] * tile["w"]).alias("x"), (tile["y"] + p["y"] * tile["h"]).alias("y"), p["visibility"].alias("visibility")))


def feet(landmarks: Column) -> Column:
    """Mean x and greatest y of the ankles."""
    a, b = (F.get(landmarks, F.lit(i)) for i in ANKLES)
    return F.struct(((a["x"] + b["x"]) / 2).alias("x"), F.greatest(a["y"], b["y"]).alias("y"))


def scene_cuts(thumbs: DataFrame, least: float = 12.0) -> DataFrame:
    """(match_id, frame_no): frames whose thumbnail differs by more than ``least`` on average from the one before.

    thumbs(match_id, frame_no, pixels array<int>) of equal sizes, red and green values only.
    """
    before = F.lag("pixels").over(Window.partitionBy("match_id").orderBy("frame_no"))
    change = F.aggregate(F.zip_with("pixels", "before", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda t, x: t + x) / F.size("pixels")
    return thumbs.withColumn("before", before).where(F.col("before").isNotNull() & (change > least)).select("match_id", "frame_no")
