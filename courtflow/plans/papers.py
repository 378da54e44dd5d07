"""Queries on JSON documents that are built from a match's tables, read back and checked."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtflow.functions import schemas as sc
from courtflow.operators import export as ex
from courtflow.operators import movement as m
from courtflow.operators import tactics as tc
from courtflow.plans import movement as mv
from courtflow.plans.shared import query, r6, s6
from courtflow.sources.surrogate import with_tables

_TABLES = ("frames", "poses", "ball_shots")


def _summaries(frames, poses, shots):
    """Summaries of the matches with frames; hands are known of even players only."""
    counted = shots.groupBy("match_id").agg(F.count("*").alias("rally_shots"))
    rows = frames.groupBy("match_id").agg(F.max("t").alias("seconds")).join(counted, "match_id", "left")
    matches = rows.select("match_id", "seconds", (F.col("match_id") % 2 == 0).alias("calibrated"), F.lit(7).alias("rallies"), F.coalesce("rally_shots", F.lit(0)).alias("rally_shots"))
    hands = poses.where("player_id % 2 = 0").select("match_id", "player_id", F.lit("left").alias("hand")).distinct()
    return ex.coach_summaries(matches, m.player_stats(frames, poses, shots), hands, tc.team_tactics(tc.paired_frames(frames, poses)), shots)


@query(*_TABLES)
def summary_players(frames, poses, shots):
    """What the summaries say of each player, read back from their JSON by one parse."""
    v = _summaries(frames, poses, shots).select("match_id", F.try_parse_json("document").alias("v"))
    get = lambda v, path, kind: F.try_variant_get(v, path, kind)
    rows = v.select("match_id", "v", F.explode(get(F.col("v"), "$.players", "array<variant>")).alias("p"))
    p, w = F.col("p"), F.col("v")
    return rows.select(
        "match_id", r6(get(w, "$.durationSeconds", "double"), "seconds"), r6(get(w, "$.avgRallyShots", "double"), "rally_shots"), get(w, "$.calibrated", "boolean").cast("int").alias("calibrated"),
        F.size(get(w, "$.shots", "array<variant>")).alias("listed"), get(p, "$.playerId", "int").alias("player_id"), get(p, "$.label", "string").alias("label"), get(p, "$.dominantHand", "string").alias("hand"),
        r6(get(p, "$.distanceMeters", "double"), "distance"), r6(get(p, "$.zoneShare.net", "double"), "net"), get(p, "$.totalShots", "int").alias("shots"),
    )


@query(*_TABLES)
def document_problems(frames, poses, shots):
    """Requests made of the summaries, one in six whole, the others each with a fault of its own: the paths that are wrong."""
    d, kind = F.col("document"), F.col("match_id") % 6
    cut = lambda what, by: F.regexp_replace(d, what, by)
    summary = (
        F.when(kind == 1, cut(r'"durationSeconds":[0-9.E]+,', "")).when(kind == 2, cut('"team":"A","distance', '"team":"C","distance')).when(kind == 3, cut('"zone":"net"', '"zone":5')).otherwise(d)
    )
    frame = '{"t":1,"caption":"c","image":"data:image/jpeg;base64,x"}'
    frames9 = F.when(kind == 5, ",".join([frame] * 8 + ['{"t":1,"image":"x"}'])).otherwise(frame)
    whole = F.concat(F.lit('{"summary":'), summary, F.lit(',"keyframes":['), frames9, F.lit("]"), F.when(kind == 4, "").otherwise("}"))
    docs = _summaries(frames, poses, shots).withColumn("document", whole)
    return sc.problems(docs, sc.REQUEST).select("match_id", F.array_join(F.array_sort("problems"), " ").alias("problems"))


QUERIES = {"summary_players": summary_players, "document_problems": document_problems}

_ZONE_NET = "abs(court_y - 10) < 4"
ORACLE_SQL = {
    "summary_players": with_tables(
        f""", {mv.TRACK}, moved as (select match_id, player_id, {mv._MOVES} as distance, avg(case when {_ZONE_NET} then 1 else 0 end) as net from track group by 1, 2),
        ends as (select match_id, max(t) as seconds from frames group by 1), counts as (select match_id, player_id, count(*) as n from ball_shots group by 1, 2), alls as (select match_id, count(*) as n from ball_shots group by 1)
        select match_id, {s6('floor(seconds * 10 + 0.5) / 10')} as seconds, {s6('floor(coalesce(a.n, 0) / 7 * 10 + 0.5) / 10')} as rally_shots, case when match_id % 2 = 0 then 1 else 0 end as calibrated, least(2000, coalesce(a.n, 0)) as listed, player_id,
          case player_id when 0 then 'A1' when 1 then 'A2' when 2 then 'B1' else 'B2' end as label, case when player_id % 2 = 0 then 'left' else 'right' end as hand, {s6('floor(distance + 0.5)')} as distance,
          {s6('floor(net * 100 + 0.5) / 100')} as net, coalesce(c.n, 0) as shots
        from moved join ends using (match_id) left join alls a using (match_id) left join counts c using (match_id, player_id)""", *_TABLES),
    "document_problems": with_tables(
        f""", own as (select match_id, list(distinct player_id order by player_id) as players from poses group by 1),
        netted as (select match_id, string_agg('$.summary.shots[' || place || '].zone', ' ' order by '$.summary.shots[' || place || '].zone') as wrong
          from (select match_id, court_y, row_number() over (partition by match_id order by t, seq) - 1 as place from ball_shots) where {_ZONE_NET} and place < 2000 group by 1),
        teamed as (select match_id, string_agg('$.summary.players[' || (place - 1) || '].team', ' ' order by place) as wrong
          from (select match_id, unnest(players) as id, generate_subscripts(players, 1) as place from own) where id < 2 group by 1)
        select f.match_id, case f.match_id % 6 when 0 then '' when 1 then '$.summary.durationSeconds' when 2 then coalesce(t.wrong, '') when 3 then coalesce(n.wrong, '') when 4 then '$'
          else '$.keyframes $.keyframes[8].caption $.keyframes[8].image' end as problems
        from (select distinct match_id from frames) f left join teamed t using (match_id) left join netted n using (match_id)""", *_TABLES),
}
