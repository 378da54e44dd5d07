"""Queries on body landmarks: wrist speeds, swings, hands, shots, snapshots and views."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtflow.operators import movement as m
from courtflow.operators import shots as sh
from courtflow.plans.movement import ZONE
from courtflow.plans.shared import query, r6, s6
from courtflow.sources.surrogate import with_tables

ASPECT, THRESHOLD, COOLDOWN = 1.5, 3.0, 2.2
# Where a test body's landmarks lie from its middle, by place in a pose of 33.
OFFSETS = {0: (0.0, -0.1), 11: (-0.02, -0.07), 12: (0.02, -0.07), 23: (-0.015, 0.0), 24: (0.015, 0.0), 27: (-0.01, 0.08), 28: (0.01, 0.08)}


def landmarks(bodies):
    """bodies with 33 landmarks: those of the test body around (cx, cy), wrists where the columns say, others in the middle."""

    def point(i: int):
        if i in sh.WRISTS:
            w = f"w{sh.WRISTS.index(i)}"
            return F.struct((F.col("cx") + F.col(f"{w}x")).alias("x"), (F.col("cy") + F.col(f"{w}y")).alias("y"), F.col(f"{w}v").alias("visibility"))
        x, y = OFFSETS.get(i, (0.0, 0.0))
        return F.struct((F.col("cx") + x).alias("x"), (F.col("cy") + y).alias("y"), F.lit(1.0).alias("visibility"))

    return bodies.withColumn("landmarks", F.array(*map(point, range(33))))


def posed(bodies):
    """Poses of the test bodies."""
    return landmarks(bodies).select("match_id", "frame_no", "t", "player_id", "court_x", "court_y", F.lit(False).alias("interpolated"), "landmarks")


@query("bodies")
def body_frames(bodies):
    b = sh.body_frames(posed(bodies), ASPECT)
    return b.select("match_id", "frame_no", "player_id", r6("torso"), r6(F.col("hip.x"), "hip_x"), r6(F.col("nose.y"), "nose_y"), r6(F.col("wrist0.x"), "w0"), r6(F.col("wrist1.y"), "w1"))


def _speeds(bodies):
    return sh.wrist_speeds(sh.body_frames(posed(bodies), ASPECT))


@query("bodies")
def wrist_speeds(bodies):
    return _speeds(bodies).select("match_id", "frame_no", "player_id", "wrist", r6("speed"))


@query("bodies")
def swing_peaks(bodies):
    return sh.swing_peaks(_speeds(bodies), THRESHOLD, COOLDOWN).select("match_id", "player_id", "frame_no", r6("speed"))


@query("bodies")
def swing_hands(bodies):
    return m.dominant_hand(sh.swing_peaks(_speeds(bodies), THRESHOLD, COOLDOWN))


@query("bodies")
def swing_classes(bodies):
    """The class of every body frame with either hand, as a shot from where the player stands."""
    b = sh.body_frames(posed(bodies), ASPECT)
    kind = lambda hand: sh.shot_type(sh.swing(F.lit(hand)), F.col("court_y"))
    return b.select("match_id", "frame_no", "player_id", kind("right").alias("as_right"), kind("left").alias("as_left"))


@query("bodies")
def detected_shots(bodies):
    found = sh.detected_shots(posed(bodies), ASPECT, THRESHOLD, COOLDOWN)
    return found.select("match_id", "player_id", r6("t"), "shot_type", r6("swing_speed"), "zone")


@query("heard", "bodies")
def heard_shots(heard, bodies):
    found = sh.heard_shots(heard, posed(bodies), ASPECT, THRESHOLD)
    return found.select("match_id", r6("t"), "player_id", r6("swing_speed"))


@query("bodies")
def best_snapshots(bodies):
    return sh.best_snapshot(posed(bodies)).select("match_id", "player_id", r6("t"), r6("score"))


@query("bodies")
def pose_views(bodies):
    """Quality, box and feet of poses that were seen in a tile of the frame."""
    tile = F.struct(F.lit(0.1).alias("x"), F.lit(0.3).alias("y"), F.lit(0.5).alias("w"), F.lit(0.6).alias("h"))
    p = posed(bodies).withColumn("moved", sh.in_frame(F.col("landmarks"), tile)).withColumn("box", sh.pose_box(F.col("moved")))
    return p.select(
        "match_id", "frame_no", "player_id", r6(sh.pose_quality(F.col("landmarks")), "quality"), r6(F.col("box.x0"), "x0"), r6(F.col("box.y0"), "y0"), r6(F.col("box.x1"), "x1"), r6(F.col("box.y1"), "y1"),
        r6(sh.feet(F.col("landmarks"))["x"], "feet_x"), r6(sh.feet(F.col("landmarks"))["y"], "feet_y"),
    )


def boxes(bodies):
    """Boxes with room around players, in which no ball is looked for."""
    p = posed(bodies).withColumn("box", sh.padded_box(F.col("landmarks")))
    return p.select("match_id", "frame_no", "player_id", "box.*")


@query("bodies")
def padded_boxes(bodies):
    return boxes(bodies).select("match_id", "frame_no", "player_id", *[r6(c) for c in ("x0", "y0", "x1", "y1")])


@query("bodies")
def same_bodies(bodies):
    """Pairs of a frame's poses that show one body."""
    p = posed(bodies).select("match_id", "frame_no", "player_id", "landmarks")
    other = p.withColumnsRenamed({"player_id": "other_id", "landmarks": "other"})
    return p.join(other, ["match_id", "frame_no"]).where("player_id < other_id").where(sh.same_person(F.col("landmarks"), F.col("other"))).select("match_id", "frame_no", "player_id", "other_id")


_names = "body_frames wrist_speeds swing_peaks swing_hands swing_classes detected_shots heard_shots best_snapshots pose_views padded_boxes same_bodies"
QUERIES = {n: globals()[n] for n in _names.split()}

_BODY = """body as (select *, cx * 1.5::double as hx, cy as hy, cy - 0.07::double as sy, 0.07::double as torso, case when w0v >= 0.4 then (cx + w0x) * 1.5::double end as ax, case when w0v >= 0.4 then cy + w0y end as ay,
  case when w1v >= 0.4 then (cx + w1x) * 1.5::double end as bx, case when w1v >= 0.4 then cy + w1y end as by_ from bodies)"""
_MOVE = lambda x, y: f"sqrt(power(({x} - hx) - (lag({x}) over w - lag(hx) over w), 2) + power(({y} - hy) - (lag({y}) over w - lag(hy) over w), 2)) / torso / (t - lag(t) over w)"
_SPEEDS = f"""{_BODY}, raw as (select *, t - lag(t) over w as dt, {_MOVE('ax', 'ay')} as v0, {_MOVE('bx', 'by_')} as v1 from body window w as (partition by match_id, player_id order by t)),
speeds as (select *, case when v0 is null or v1 > v0 then 1 else 0 end as wrist, case when v0 is null or v1 > v0 then v1 else v0 end as speed from raw where dt > 0 and dt <= 0.5 and (v0 is not null or v1 is not null))"""
_PEAKS = f"""{_SPEEDS}, locals as (select *, row_number() over (partition by match_id, player_id order by t) as i from (select *, lag(speed) over w as ps, lead(speed) over w as ns from speeds window w as (partition by match_id, player_id order by t))
  where speed >= {THRESHOLD} and speed >= coalesce(ps, -1) and speed >= coalesce(ns, -1)),
kept as (with recursive k as (select match_id, player_id, i, t, speed as v, null::double as closed from locals where i = 1
  union all select match_id, player_id, i, case when near and nv <= v then t else nt end, case when near and nv <= v then v else nv end, case when not near then t end from (
    select k.match_id, k.player_id, n.i, k.t, k.v, n.t as nt, n.speed as nv, n.t - k.t < {COOLDOWN} as near from k join locals n on n.match_id = k.match_id and n.player_id = k.player_id and n.i = k.i + 1)) select * from k),
times as (select match_id, player_id, closed as t from kept where closed is not null union select match_id, player_id, arg_max(t, i) from kept group by 1, 2),
peaks as (select s.* from speeds s join times using (match_id, player_id, t)),
hands as (select match_id, player_id, case when 2 * sum(wrist) >= count(*) then 'right' else 'left' end as hand from peaks group by 1, 2)"""


def _class(hand: str) -> str:
    """SQL of a body frame's swing class: the wrist of that hand, else the other one, across the shoulders (which lie level)."""
    first = lambda a, b: f"case when {hand} = 'right' then coalesce({b}, {a}) else coalesce({a}, {b}) end"
    x, y, side = first("ax", "bx"), first("ay", "by_"), f"case when {hand} = 'right' then 1 else -1 end"
    base = f"case when {x} is null then 'forehand' when (cy - 0.1::double) - ({y}) > torso * 0.15 then 'overhead' when ({x} - hx) * ({side}) >= 0 then 'forehand' else 'backhand' end"
    return f"case when ({base}) <> 'overhead' and {ZONE.format('court_y')} = 'net' then ({base}) || '-volley' else ({base}) end"


PADDED = """seen as (select *, least(-0.02::double, case when w0v > 0.2 then w0x else 0 end, case when w1v > 0.2 then w1x else 0 end) as x0, greatest(0.02::double, case when w0v > 0.2 then w0x else 0 end, case when w1v > 0.2 then w1x else 0 end) as x1,
  least(-0.1::double, case when w0v > 0.2 then w0y else 0 end, case when w1v > 0.2 then w1y else 0 end) as y0, greatest(0.08::double, case when w0v > 0.2 then w0y else 0 end, case when w1v > 0.2 then w1y else 0 end) as y1 from bodies),
padded as (select match_id, frame_no, player_id, cx + x0 - (y1 - y0) * 0.12::double as x0, cy + y0 - (y1 - y0) * 0.1::double as y0, cx + x1 + (y1 - y0) * 0.12::double as x1, cy + y1 + (y1 - y0) * 0.05::double as y1 from seen)"""

ORACLE_SQL = {
    "body_frames": with_tables(f", {_BODY} select match_id, frame_no, player_id, {s6('torso')} as torso, {s6('hx')} as hip_x, {s6('cy - 0.1::double')} as nose_y, {s6('ax')} as w0, {s6('by_')} as w1 from body", "bodies"),
    "wrist_speeds": with_tables(f", {_SPEEDS} select match_id, frame_no, player_id, wrist, {s6('speed')} as speed from speeds", "bodies"),
    "swing_peaks": with_tables(f", {_PEAKS} select match_id, player_id, frame_no, {s6('speed')} as speed from peaks", "bodies"),
    "swing_hands": with_tables(f", {_PEAKS} select * from hands", "bodies"),
    "swing_classes": with_tables(f""", {_BODY} select match_id, frame_no, player_id, {_class("'right'")} as as_right, {_class("'left'")} as as_left from body""", "bodies"),
    "detected_shots": with_tables(f", {_PEAKS} select match_id, player_id, {s6('t')} as t, {_class('hand')} as shot_type, {s6('speed')} as swing_speed, {ZONE.format('court_y')} as zone from peaks join hands using (match_id, player_id)", "bodies"),
    "heard_shots": with_tables(
        f""", {_SPEEDS}, near as (select match_id, ht, player_id, speed from (select h.match_id, h.t as ht, s.player_id, s.speed, row_number() over (partition by h.match_id, h.t, s.player_id order by s.speed desc, s.t) as k
          from heard h join speeds s on s.match_id = h.match_id and abs(s.t - h.t) <= 0.35) where k = 1),
        o as (select match_id, ht, row_number() over (partition by match_id order by ht) as i, list({{'p': player_id, 'v': speed}} order by speed desc, player_id) as l from near group by 1, 2),
        f as (with recursive k as (select match_id, 0 as i, null::varchar as side, -1e9::double as since, null::integer as p, null::double as v, null::double as ht from o where i = 1
          union all select match_id, i, case when pick is null then side when pick.p < 2 then 'A' else 'B' end, case when pick is null then since else nt end, pick.p, pick.v, nt from (
            select k.match_id, o.i, k.side, k.since, o.ht as nt, case when o.ht - k.since < 0.45 then null when o.ht - k.since < 3 and k.side is not null
              then list_filter(o.l, lambda x: case when x.p < 2 then 'A' else 'B' end <> k.side and x.v >= {THRESHOLD} * 0.35 * 0.5)[1] else list_filter(o.l, lambda x: x.v >= {THRESHOLD} * 0.35)[1] end as pick
            from k join o on o.match_id = k.match_id and o.i = k.i + 1)) select * from k)
        select match_id, {s6('ht')} as t, p as player_id, {s6('v')} as swing_speed from f where p is not null""", "heard", "bodies"),
    "best_snapshots": with_tables(
        f""", seen as (select *, 33 - (case when w0v < 0.5 then 1 else 0 end) - (case when w1v < 0.5 then 1 else 0 end) as n,
          least(-0.02::double, case when w0v >= 0.5 then w0x else 0 end, case when w1v >= 0.5 then w1x else 0 end) as x0, greatest(0.02::double, case when w0v >= 0.5 then w0x else 0 end, case when w1v >= 0.5 then w1x else 0 end) as x1,
          least(-0.1::double, case when w0v >= 0.5 then w0y else 0 end, case when w1v >= 0.5 then w1y else 0 end) as y0, greatest(0.08::double, case when w0v >= 0.5 then w0y else 0 end, case when w1v >= 0.5 then w1y else 0 end) as y1 from bodies),
        sized as (select *, y1 - y0 as h, cx + (x0 + x1) / 2 as mx, cy + (y0 + y1) / 2 as my from seen),
        boxed as (select *, h * 1.35::double as high, greatest(x1 - x0 + h * 0.2::double, h * 1.35::double * 0.75::double) as wide from sized),
        crowd as (select distinct a.match_id, a.frame_no, a.player_id from boxed a join bodies o on o.match_id = a.match_id and o.frame_no = a.frame_no and o.player_id <> a.player_id
          and abs(o.cx - a.mx) < a.wide * 0.6 and abs(o.cy - 0.1::double - a.my) < a.high * 0.6),
        s as (select b.match_id, b.player_id, b.t, h * n / 33 * case when c.match_id is null then 1.0::double else 0.3::double end as score from boxed b left join crowd c on c.match_id = b.match_id and c.frame_no = b.frame_no and c.player_id = b.player_id)
        select match_id, player_id, {s6('t')} as t, {s6('score')} as score from (select *, row_number() over (partition by match_id, player_id order by score desc, t) as k from s) where k = 1""", "bodies"),
    "pose_views": with_tables(
        f""", v as (select *, least(-0.02::double, case when w0v > 0.3 then w0x else 0 end, case when w1v > 0.3 then w1x else 0 end) as x0, greatest(0.02::double, case when w0v > 0.3 then w0x else 0 end, case when w1v > 0.3 then w1x else 0 end) as x1,
          least(-0.1::double, case when w0v > 0.3 then w0y else 0 end, case when w1v > 0.3 then w1y else 0 end) as y0, greatest(0.08::double, case when w0v > 0.3 then w0y else 0 end, case when w1v > 0.3 then w1y else 0 end) as y1 from bodies)
        select match_id, frame_no, player_id, {s6('(6 + w0v + w1v) / 8')} as quality, {s6('0.1::double + (cx + x0) * 0.5::double')} as x0, {s6('0.3::double + (cy + y0) * 0.6::double')} as y0, {s6('0.1::double + (cx + x1) * 0.5::double')} as x1,
          {s6('0.3::double + (cy + y1) * 0.6::double')} as y1, {s6('cx')} as feet_x, {s6('cy + 0.08::double')} as feet_y from v""", "bodies"),
    "padded_boxes": with_tables(f", {PADDED} select match_id, frame_no, player_id, {', '.join(f'{s6(c)} as {c}' for c in ('x0', 'y0', 'x1', 'y1'))} from padded", "bodies"),
    "same_bodies": with_tables(
        """, v as (select match_id, frame_no, player_id, cx, cy, cx + least(-0.02::double, case when w0v > 0.3 then w0x else 0 end, case when w1v > 0.3 then w1x else 0 end) as x0, cx + greatest(0.02::double, case when w0v > 0.3 then w0x else 0 end, case when w1v > 0.3 then w1x else 0 end) as x1,
          cy + least(-0.1::double, case when w0v > 0.3 then w0y else 0 end, case when w1v > 0.3 then w1y else 0 end) as y0, cy + greatest(0.08::double, case when w0v > 0.3 then w0y else 0 end, case when w1v > 0.3 then w1y else 0 end) as y1 from bodies),
        j as (select a.match_id, a.frame_no, a.player_id, b.player_id as other_id, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) as common,
          least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)) as area, sqrt(power(a.cx - b.cx, 2) + power(a.cy - b.cy, 2)) as apart, greatest(a.y1 - a.y0, b.y1 - b.y0) as tall
          from v a join v b on a.match_id = b.match_id and a.frame_no = b.frame_no and a.player_id < b.player_id)
        select match_id, frame_no, player_id, other_id from j where common / area > 0.45 or apart < 0.25 * tall""", "bodies"),
}
