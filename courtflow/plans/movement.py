"""Queries on positions and movement."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtflow.functions import geometry as g
from courtflow.functions import text as tx
from courtflow.operators import movement as m
from courtflow.operators import timeseries as ts
from courtflow.plans.shared import query, r6, s6
from courtflow.sources.surrogate import with_tables

ZONE = "case when abs({0} - 10) < 4 then 'net' when abs({0} - 10) < 6.95::double + 1 then 'transition' else 'baseline' end"
_W = "over (partition by match_id, player_id order by t, frame_no"
TRACK = f"""
track as (select *, t - lag(t) {_W}) as dt, sqrt(power(court_x - lag(court_x) {_W}), 2) + power(court_y - lag(court_y) {_W}), 2)) as dist
  from (select match_id, frame_no, t, player_id, avg(court_x) {_W} rows between 2 preceding and 2 following) as court_x,
               avg(court_y) {_W} rows between 2 preceding and 2 following) as court_y from poses) as s)"""
FRAME_DT = "timed as (select *, coalesce(least(1, greatest(0, lead(t) over (partition by match_id order by t, frame_no) - t)), 0) as dt from frames)"


@query("poses")
def on_court_filter(poses):
    inside = poses.where(g.on_court(F.col("court_x"), F.col("court_y")))
    return inside.groupBy("match_id", "player_id").agg(F.count("*").alias("n"))


@query("poses")
def zone_classify(poses):
    y = F.col("court_y")
    return poses.groupBy("match_id", g.zone(y).alias("zone"), g.depth_band(g.net_distance(y)).alias("depth")).agg(F.count("*").alias("n"))


@query("poses")
def player_identity(poses):
    p = F.col("player_id")
    return poses.select("player_id", g.team(p).alias("team"), g.slot_tag(p).alias("label")).distinct()


@query("poses")
def smooth_track(poses):
    track = ts.smooth(poses, m.PLAYER, ["t", "frame_no"], ["court_x", "court_y"])
    return track.select("match_id", "player_id", "frame_no", r6("court_x"), r6("court_y"))


@query("poses")
def segment_speed(poses):
    return m.smoothed_track(poses).where("dt is not null").select("match_id", "player_id", "frame_no", r6("dt"), r6("dist"), r6("speed"))


@query("frames", "poses")
def detected_seconds(frames, poses):
    return m.detected_seconds(frames, poses).select("match_id", "player_id", r6("detected_seconds"))


@query("frames", "poses", "shots")
def player_stats(frames, poses, shots):
    renamed = shots.withColumn("match_id", F.floor(F.col("seq") / 400))
    s = m.player_stats(frames, poses, renamed)
    return s.select(
        "match_id", "player_id", "team", "label", r6("distance"), r6("max_speed"), r6("tracked_seconds"), r6("avg_speed"), r6("share_net"), r6("share_transition"),
        r6("share_baseline"), r6("avg_net_distance"), r6("detected_seconds"), "n_forehand", "n_backhand", "n_overhead", "total_shots", r6("avg_swing_speed"),
    )


@query("poses")
def heatmap(poses):
    return m.heatmap(m.smoothed_track(poses)).select("match_id", "player_id", "row", "col", r6("share"))


@query("poses")
def heatmap_argmax(poses):
    heat = m.heatmap(m.smoothed_track(poses)).withColumn("share", F.floor(F.col("share") * 1e9 + 0.5) / 1e9)
    return m.combined_heatmap(heat).select("match_id", "row", "col", r6("total"), "top_player", r6("most"))


@query("frames", "poses")
def gap_fill(frames, poses):
    filled = ts.fill_gaps(frames, poses).where("interpolated")
    return filled.select("match_id", "player_id", "frame_no", r6("t"), r6("court_x"), r6("court_y"))


@query("poses")
def canonical_ids(poses):
    shuffled = poses.withColumn("player_id", (F.col("player_id") * 7 + F.col("match_id") % 3 + F.when(F.col("frame_no") % 10 == 9, 20).otherwise(0)).cast("int"))
    return m.canonical_ids(shuffled)


@query("shots", "frames")
def asof_nearest(shots, frames):
    probes = shots.select(F.floor(F.col("seq") / 400).alias("match_id"), "seq", (F.col("seq") % 997 / F.lit(20.0)).alias("t"))
    return ts.asof_nearest(probes, frames, ["match_id"], "t", ["frame_no"]).select("match_id", "seq", r6("t"), r6("near_t"), F.col("near_frame_no").alias("frame_no"))


@query("frames")
def greedy_sampling(frames):
    return ts.sampled(frames, ["match_id"], "t", 1.2)


@query("poses")
def swapped_identities(poses):
    track = m.smoothed_track(m.swapped(poses, 0, 2, 20.0))
    return m.movement(track).select("match_id", "player_id", r6("distance"), r6("share_net"))


@query("poses")
def court_projection(poses):
    h = g.homography(g.COURT_CORNERS, g.DEFAULT_CORNERS)
    x, y = g.project(h, F.col("court_x"), F.col("court_y"))
    seen = poses.where(g.on_court(F.col("court_x"), F.col("court_y"), 0.0)).withColumns({"ix": x, "iy": y})
    inside = seen.where(g.in_polygon(F.col("ix"), F.col("iy"), g.DEFAULT_CORNERS))
    return inside.groupBy("match_id").agg(F.count("*").alias("n"), r6(F.avg("ix"), "mean_x"), r6(F.avg("iy"), "mean_y"))


@query("poses")
def session_texts(poses):
    ends = poses.groupBy("match_id").agg(F.max("t").alias("t"), F.avg(F.when(g.zone(F.col("court_y")) == "net", 1.0).otherwise(0.0)).alias("net"))
    return ends.select("match_id", tx.clock(F.col("t") * 7).alias("clock"), tx.percent(F.col("net")).alias("net"), tx.signed(F.col("net") * 100 - 50, " pts").alias("delta"))


QUERIES = {
    n: globals()[n]
    for n in (
        "on_court_filter", "zone_classify", "player_identity", "smooth_track", "segment_speed", "detected_seconds", "player_stats", "heatmap", "heatmap_argmax",
        "gap_fill", "canonical_ids", "asof_nearest", "greedy_sampling", "swapped_identities", "court_projection", "session_texts",
    )
}

_REAL = "dt > 0 and dt <= 1 and dist / dt <= 8"
_MOVES = f"""coalesce(sum(case when {_REAL} then dist end), 0)"""
_HEAT = """heat as (select match_id, player_id, least(19, greatest(0, floor(court_y)))::integer as row, least(9, greatest(0, floor(court_x)))::integer as col,
    count(*)::double / sum(count(*)) over (partition by match_id, player_id) as share from track group by 1, 2, 3, 4)"""
_H = g.homography(g.COURT_CORNERS, g.DEFAULT_CORNERS)
_P = f"(court_x * {_H[6]!r} + court_y * {_H[7]!r} + 1)"
_IX, _IY = f"(court_x * {_H[0]!r} + court_y * {_H[1]!r} + {_H[2]!r}) / {_P}", f"(court_x * {_H[3]!r} + court_y * {_H[4]!r} + {_H[5]!r}) / {_P}"

ORACLE_SQL = {
    "on_court_filter": with_tables("select match_id, player_id, count(*) as n from poses where court_x > -2 and court_x < 12 and court_y > -2 and court_y < 22 group by all", "poses"),
    "zone_classify": with_tables(
        f"select match_id, {ZONE.format('court_y')} as zone, case when abs(court_y - 10) < 4 then 'net' when abs(court_y - 10) < 7.5 then 'mid' else 'back' end as depth, count(*) as n from poses group by all", "poses"
    ),
    "player_identity": with_tables("select distinct player_id, case when player_id < 2 then 'A' else 'B' end as team, case player_id when 0 then 'A1' when 1 then 'A2' when 2 then 'B1' else 'B2' end as label from poses", "poses"),
    "smooth_track": with_tables(f", {TRACK} select match_id, player_id, frame_no, {s6('court_x')} as court_x, {s6('court_y')} as court_y from track", "poses"),
    "segment_speed": with_tables(f", {TRACK} select match_id, player_id, frame_no, {s6('dt')} as dt, {s6('dist')} as dist, {s6('dist / dt')} as speed from track where dt is not null", "poses"),
    "detected_seconds": with_tables(f", {FRAME_DT} select match_id, player_id, {s6('sum(dt)')} as detected_seconds from poses join timed using (match_id, frame_no) group by all", "poses", "frames"),
    "player_stats": with_tables(
        f""", {TRACK}, {FRAME_DT}, seen as (select match_id, player_id, sum(dt) as detected_seconds from poses join timed using (match_id, frame_no) group by all),
        counts as (select seq // 400 as match_id, player_id, count(*) filter (shot_type = 'forehand') as f, count(*) filter (shot_type = 'backhand') as b,
                          count(*) filter (shot_type = 'overhead') as o, count(*) as n, avg(swing_speed) as s from shots group by all),
        moved as (select match_id, player_id, {_MOVES} as distance, coalesce(sum(case when {_REAL} then dt end), 0) as moving, coalesce(max(case when {_REAL} then dist / dt end), 0) as max_speed,
                         coalesce(sum(case when dt > 0 and dt <= 1 then dt end), 0) as tracked, avg(case when {ZONE.format('court_y')} = 'net' then 1 else 0 end) as zn,
                         avg(case when {ZONE.format('court_y')} = 'transition' then 1 else 0 end) as zt, avg(case when {ZONE.format('court_y')} = 'baseline' then 1 else 0 end) as zb,
                         avg(abs(court_y - 10)) as nd from track group by all)
        select match_id, player_id, case when player_id < 2 then 'A' else 'B' end as team, case player_id when 0 then 'A1' when 1 then 'A2' when 2 then 'B1' else 'B2' end as label,
               {s6('distance')} as distance, {s6('max_speed')} as max_speed, {s6('tracked')} as tracked_seconds, {s6('case when moving > 0 then distance / moving else 0 end')} as avg_speed,
               {s6('zn')} as share_net, {s6('zt')} as share_transition, {s6('zb')} as share_baseline, {s6('nd')} as avg_net_distance, {s6('detected_seconds')} as detected_seconds,
               coalesce(f, 0) as n_forehand, coalesce(b, 0) as n_backhand, coalesce(o, 0) as n_overhead, coalesce(n, 0) as total_shots, {s6('coalesce(s, 0)')} as avg_swing_speed
        from moved left join seen using (match_id, player_id) left join counts using (match_id, player_id)""",
        "poses", "frames", "shots",
    ),
    "heatmap": with_tables(f", {TRACK}, {_HEAT} select match_id, player_id, row, col, {s6('share')} as share from heat", "poses"),
    "heatmap_argmax": with_tables(
        f""", {TRACK}, {_HEAT}, r as (select match_id, player_id, row, col, floor(share * 1e9 + 0.5) / 1e9 as share from heat),
        cells as (select match_id, row, col, sum(share) as total, arg_max(player_id, share * 100 - player_id * 1e-9) as top_player from r where share > 0 group by all)
        select match_id, row, col, {s6('total')} as total, top_player, {s6('max(total) over (partition by match_id)')} as most from cells""", "poses",
    ),
    "gap_fill": with_tables(
        f""", n as (select *, row_number() over (partition by match_id order by t, frame_no) as i from frames),
        seen as (select p.*, n.i, lead(n.i) {_W.replace('order by t, frame_no', 'order by p.t, p.frame_no').replace('match_id, player_id', 'p.match_id, p.player_id')}) as j,
                        lead(p.t) over w as nt, lead(court_x) over w as nx, lead(court_y) over w as ny
                 from poses p join n on p.match_id = n.match_id and p.frame_no = n.frame_no window w as (partition by p.match_id, p.player_id order by p.t, p.frame_no))
        select s.match_id, s.player_id, n.frame_no, {s6('n.t')} as t, {s6('court_x + (nx - court_x) * ((n.t - s.t) / (nt - s.t))')} as court_x, {s6('court_y + (ny - court_y) * ((n.t - s.t) / (nt - s.t))')} as court_y
        from seen s join n on s.match_id = n.match_id and n.i > s.i and n.i < s.j where nt - s.t <= 1""", "poses", "frames",
    ),
    "canonical_ids": with_tables(
        """, q as (select match_id, (player_id * 7 + match_id % 3 + case when frame_no % 10 = 9 then 20 else 0 end)::integer as raw_id, court_x, court_y from poses),
        s as (select match_id, raw_id, count(*) as n, avg(court_x) as mx, case when avg(court_y) > 10 then 0 else 2 end as base from q group by all),
        r as (select *, row_number() over (partition by match_id, base order by n desc, raw_id) as place from s),
        b as (select *, count(*) over (partition by match_id, base) as size, row_number() over (partition by match_id, base order by mx, raw_id) - 1 as across from r where place <= 2),
        best as (select match_id, raw_id, (base + case when size = 1 then case when mx < 5 then 0 else 1 end else across end)::integer as player_id from b),
        free as (select m.match_id, x.i as player_id, row_number() over (partition by m.match_id order by x.i) as pos from (select distinct match_id from s) m, (values (0), (1), (2), (3)) as x(i)
                 where not exists (select 1 from best where best.match_id = m.match_id and best.player_id = x.i)),
        rest as (select match_id, raw_id, row_number() over (partition by match_id order by n desc, base, raw_id) as pos from r where place > 2)
        select * from best union all select rest.match_id, raw_id, player_id from rest join free using (match_id, pos)""", "poses",
    ),
    "asof_nearest": with_tables(
        f""", p as (select seq // 400 as match_id, seq, (seq % 997) / 20.0::double as t from shots),
        b as (select p.*, f.t as bt, f.frame_no as bf from p asof left join frames f on p.match_id = f.match_id and p.t >= f.t),
        a as (select b.*, f.t as nt, f.frame_no as af from b asof left join frames f on b.match_id = f.match_id and b.t <= f.t)
        select match_id, seq, {s6('t')} as t, {s6('case when bt is not null and (nt is null or t - bt < nt - t) then bt else nt end')} as near_t,
               case when bt is not null and (nt is null or t - bt < nt - t) then bf else af end as frame_no from a""", "shots", "frames",
    ),
    "greedy_sampling": with_tables(
        """, recursive_frames as (select match_id, t from frames),
        s as (select match_id, min(t) as t from frames group by 1)
        select match_id, t from (
          with recursive k as (select match_id, t from s union all
            select k.match_id, (select min(f.t) from frames f where f.match_id = k.match_id and f.t >= k.t + 1.2::double - 0.001) from k where k.t is not null)
          select * from k where t is not null)""", "frames",
    ),
    "swapped_identities": with_tables(
        f""", swapped as (select match_id, frame_no, t, case when t >= 20 and player_id = 0 then 2 when t >= 20 and player_id = 2 then 0 else player_id end as player_id, court_x, court_y from poses),
        {TRACK.replace('from poses', 'from swapped')}
        select match_id, player_id::integer as player_id, {s6(_MOVES)} as distance, {s6("avg(case when " + ZONE.format('court_y') + " = 'net' then 1 else 0 end)")} as share_net from track group by all""", "poses",
    ),
    "court_projection": with_tables(
        f"""select match_id, count(*) as n, {s6(f'avg({_IX})')} as mean_x, {s6(f'avg({_IY})')} as mean_y from poses where court_x > 0 and court_x < 10 and court_y > 0 and court_y < 20 group by all""", "poses",
    ),
    "session_texts": with_tables(
        f""", e as (select match_id, max(t) * 7 as t, avg(case when {ZONE.format('court_y')} = 'net' then 1 else 0 end) as net from poses group by 1)
        select match_id, format('{{}}:{{:02d}}', floor(floor(t) / 60)::bigint, (floor(t)::bigint % 60)) as clock, floor(net * 100 + 0.5)::bigint || '%' as net,
               case when net * 100 - 50 < 0 then '-' else '+' end || floor(abs(net * 100 - 50) + 0.5)::bigint || ' pts' as delta from e""", "poses",
    ),
}
