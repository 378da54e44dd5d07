"""Queries on time scans, what is shown after a match, and edits in review."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtflow.functions import geometry as g
from courtflow.functions import text as tx
from courtflow.operators import history as h
from courtflow.operators import movement as m
from courtflow.operators import points as p
from courtflow.operators import review as rv
from courtflow.operators import rules as ru
from courtflow.operators import scoring as sc
from courtflow.operators import timeseries as ts
from courtflow.plans import points as pp
from courtflow.plans.movement import ZONE
from courtflow.plans.shared import query, r6, s6
from courtflow.sources.surrogate import with_tables


def _spans(frames):
    k = F.col("match_id")
    return frames.groupBy("match_id").agg(F.max("t").alias("duration")).withColumns({"start": F.when(k % 4 > 0, (k % 5) * 5.0 - 5), "end": F.when(k % 3 > 0, (k % 5) * 5.0 + (k % 7) * 6)})


@query("frames")
def analysed_seconds(frames):
    return _spans(frames).select("match_id", r6(rv.analysed_seconds(F.col("duration"), F.col("start"), F.col("end")), "seconds"))


@query("frames", "poses")
def segment_scan(frames, poses):
    kept = ts.segment(poses, _spans(frames), ["match_id"], "t")
    return kept.groupBy("match_id").agg(F.count("*").alias("n"), r6(F.min("t"), "first"), r6(F.max("t"), "last"))


@query("frames")
def seek_scan(frames):
    """Exact steps from after the last saved frame to the end, each with the frame nearest to it."""
    spans = frames.groupBy("match_id").agg((F.max("t") * 0.25).alias("start"), F.max("t").alias("end"))
    met = ts.asof_nearest(ts.steps(spans, ["match_id"], 0.7), frames, ["match_id"], "t", ["frame_no"])
    return met.select("match_id", r6("t"), r6("near_t"), "near_frame_no")


def _probes(shots):
    return shots.select(F.floor(F.col("seq") / 400).alias("match_id"), "seq", (F.col("seq") % 997 / F.lit(20.0)).alias("t"))


@query("shots", "frames")
def asof_tolerance(shots, frames):
    return ts.asof_within(_probes(shots), frames, ["match_id"], "t", ["frame_no"], 0.12).select("match_id", "seq", r6("near_t"), "near_frame_no")


@query("shots", "frames")
def recent_shots(shots, frames):
    times = shots.select(F.floor(F.col("seq") / 400).alias("match_id"), (F.col("seq") % 997 / F.lit(20.0)).alias("t"), F.col("seq").alias("shot"))
    return ts.latest_within(frames, times, ["match_id"], "t", ["shot"], 0.12).select("match_id", "frame_no", r6("last_at"), "last_shot")


@query("rallies", "shots")
def rally_timeline(rallies, shots):
    lengths = shots.groupBy("match_id").agg(F.max("t").alias("duration"))
    return rv.timeline(rallies.select("match_id", "rally_idx", "start_t", "end_t"), lengths).select("match_id", "rally_idx", r6("left"), r6("width"))


@query("poses")
def greedy_dedupe(poses):
    apart = lambda k, x: F.hypot(k["x"] - x["x"], k["y"] - x["y"]) < 0.75
    found = poses.select("match_id", "frame_no", "player_id", (F.col("court_x") / 10).alias("x"), (F.col("court_y") / 10).alias("y"))
    return ts.greedily_apart(found, ["match_id", "frame_no"], ["player_id"], apart).select("match_id", "frame_no", "player_id")


@query("poses")
def body_suppression(poses):
    """Of boxes that share over 0.45 of the smaller one the best view stays."""
    over = lambda k, x, c, size: F.greatest(F.lit(0.0), size - F.abs(k[c] - x[c]))
    same = lambda k, x: over(k, x, "x", F.lit(0.3)) * over(k, x, "y", F.lit(0.4)) / 0.12 > 0.45
    boxes = poses.select("match_id", "frame_no", "player_id", (F.col("court_x") / 25).alias("x"), (F.col("court_y") / 25).alias("y"), (-F.pmod(F.col("court_x") * 3 + F.col("player_id"), F.lit(1.7))).alias("worse"))
    return ts.greedily_apart(boxes, ["match_id", "frame_no"], ["worse", "player_id"], same).select("match_id", "frame_no", "player_id")


@query("shots", "matches")
def key_frames(shots, matches):
    hard = shots.where("swing_speed >= 4.9").withColumn("zone", g.zone(F.col("court_y")))
    spans = matches.select("match_id", (F.col("match_id") % 10).cast("double").alias("start"), (F.col("match_id") % 10 + 20).cast("double").alias("end"))
    return rv.key_frames(hard, spans).select("match_id", r6("t"), "caption")


@query("ball_shots")
def highlight_list(shots):
    """The hardest overheads and forehands of each match, forty at most, and how many are left out."""
    picked = shots.where(F.col("shot_type").isin("overhead", "forehand"))
    return rv.listed(picked, [F.desc("swing_speed"), "seq"]).select("match_id", "seq", "place", "more")


@query("shots")
def shot_list(shots):
    return rv.first_rows(shots, ["t", "seq"], 30).groupBy("match_id").agg(F.count("*").alias("n"), F.max("seq").alias("last"))


@query("shots")
def thinned_json(shots):
    kept = rv.thinned_to_size(shots, ["t", "seq"], F.to_json(F.struct("seq", "player_id", "shot_type")), 1500)
    return kept.select("match_id", "seq")


@query("point_feed")
def score_summary(feed):
    return rv.score_summary(pp._scored(feed))


@query("matches", "shots")
def focus_player(matches, shots):
    return rv.focus_player(matches, m.shot_counts(shots))


@query("matches")
def match_days(matches):
    return matches.select("match_id", rv.day(F.col("created_at")).alias("day"))


@query("shots")
def dominant_hands(shots):
    return m.dominant_hand(shots.select("match_id", "player_id", F.floor(F.col("swing_speed") % 2).cast("int").alias("wrist")))


@query("shots")
def player_cards(shots):
    hands = m.dominant_hand(shots.select("match_id", "player_id", F.floor(F.col("swing_speed") % 2).cast("int").alias("wrist")))
    stats = shots.groupBy("match_id", "player_id").agg(F.count("*").alias("total_shots"), (F.max("swing_speed") + F.col("player_id") / 8.0).alias("max_speed"))
    return rv.card(stats.join(hands, ["match_id", "player_id"]), 18)


@query("matches", "point_feed")
def result_labels(matches, feed):
    won = sc.winners(pp._scored(feed), feed)
    return matches.join(won, "match_id").select("match_id", rv.result_label(F.col("winner"), F.col("me")).alias("result"))


@query("matches")
def unused_goals(matches):
    names = F.array(*map(F.lit, h.GOALS))
    k = F.col("match_id")
    used = matches.select(k.alias("owner"), F.explode(F.array(F.get(names, (k % 7).cast("int")), F.get(names, ((k * 3 + 1) % 7).cast("int")))).alias("metric"))
    return rv.unused_metrics(matches.select(k.alias("owner")), used)


def _keys(rallies):
    key = lambda by: F.get(F.array(*map(F.lit, "abWfux")), (by % 6).cast("int"))
    two = F.array(F.struct(F.lit(0).alias("at"), key(F.col("rally_idx") + F.col("match_id")).alias("key")), F.struct(F.lit(1).alias("at"), key(F.col("rally_idx") * 5 + F.col("match_id") * 3 + 2).alias("key")))
    return rallies.select("match_id", "rally_idx", F.inline(two))


@query("rallies", "point_tags")
def rapid_review(rallies, tags):
    return rv.reviewed(_keys(rallies), tags.where("ending <> 'forced'"))


@query("shots")
def rising_ticks(shots):
    return ts.rising(shots.withColumn("t", F.col("t") / 20), ["match_id"], ["t", "seq"], "t").select("match_id", "seq", "tick")


@query("shots")
def work_marks(shots):
    return ts.marks_by_count_or_time(shots, ["match_id"], "t", 9, 3, 30.0).select("match_id", r6("t"))


@query("frames", "poses", "rallies", "point_tags")
def best_patterns(frames, poses, rallies, tags):
    patterns, own = pp._pattern_inputs(frames, poses, rallies)
    best = ru.best_and_worst(p.point_stats(own, tags, patterns)[1])
    return best.select("match_id", "team", "best", "worst", r6("best_rate"), r6("worst_rate"))


@query("names")
def display_names(names):
    spaced = F.when(F.col("slot") == 2, F.lit("  ")).when(F.col("slot") == 3, F.concat(F.lit(" "), "name", F.lit(" "))).otherwise(F.col("name"))
    of = names.groupBy("match_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", spaced))).alias("of"))
    shown = g.player_name(F.col("of"), F.col("slot"))
    title = F.concat(F.lit("Match #"), F.col("match_id").cast("string"), F.lit(" - "), "name", F.lit("!"))
    rows = names.join(of, "match_id")
    return rows.select("match_id", "slot", shown.alias("shown"), tx.file_name(title).alias("file"), tx.shortened(title, 12).alias("short"), tx.signed(F.col("slot") - 1.5, " pts", 1).alias("delta"))


_names = (
    "analysed_seconds segment_scan seek_scan asof_tolerance recent_shots rally_timeline greedy_dedupe body_suppression key_frames highlight_list shot_list thinned_json score_summary focus_player match_days "
    "dominant_hands player_cards result_labels unused_goals rapid_review rising_ticks work_marks best_patterns display_names"
)
QUERIES = {n: globals()[n] for n in _names.split()}

_SPANS = """spans as (select match_id, max(t) as duration, case when match_id % 4 > 0 then (match_id % 5) * 5.0::double - 5 end as s, case when match_id % 3 > 0 then (match_id % 5) * 5.0::double + (match_id % 7) * 6 end as e from frames group by 1)"""
_NEAREST = """b as (select p.*, f.t as bt, f.frame_no as bf from p asof left join frames f on p.match_id = f.match_id and p.t >= f.t),
  a as (select b.*, f.t as nt, f.frame_no as af from b asof left join frames f on b.match_id = f.match_id and b.t <= f.t),
  met as (select *, case when bt is not null and (nt is null or t - bt < nt - t) then bt else nt end as near_t, case when bt is not null and (nt is null or t - bt < nt - t) then bf else af end as near_frame_no from a)"""
_PROBES = "select seq // 400 as match_id, seq, (seq % 997) / 20.0::double as t from shots"


def _greedy(boxes: str, order: str, near: str) -> str:
    """SQL for at most four rows a frame: a row stays if no row kept before is near; k1 to k4 say which stay."""
    cols = ", ".join(f"max(case when k = {i} then {c} end) as {c}{i}" for i in range(1, 5) for c in ("player_id", "x", "y"))
    kept = []
    for i in range(1, 5):
        far = " and ".join(f"not (k{j} and {near.format(i=i, j=j)})" for j in range(1, i)) or "true"
        kept.append(f"s{i} as (select *, coalesce(player_id{i} is not null and {far}, false) as k{i} from {'wide' if i == 1 else f's{i - 1}'})")
    out = " union all ".join(f"select match_id, frame_no, player_id{i} as player_id from s4 where k{i}" for i in range(1, 5))
    return f", boxes as ({boxes}), placed as (select *, row_number() over (partition by match_id, frame_no order by {order}) as k from boxes), wide as (select match_id, frame_no, {cols} from placed group by 1, 2), {', '.join(kept)} {out}"


_HANDS = "hands as (select match_id, player_id, case when 2 * count(*) filter (floor(swing_speed % 2) = 1) >= count(*) then 'right' else 'left' end as hand from shots group by 1, 2)"
_SETS = "case when len({0}) > 10 then {0}[-10:] else {0} end".format("string_split(trim(sets || case when ga + gb + pa + pb > 0 or sets = '' then ga || '-' || gb else '' end), ' ')")

ORACLE_SQL = {
    "analysed_seconds": with_tables(f", {_SPANS} select match_id, {s6('greatest(coalesce(e - s, duration), 0.001)')} as seconds from spans", "frames"),
    "segment_scan": with_tables(
        f""", {_SPANS}, c as (select match_id, greatest(0, least(coalesce(s, 0), duration)) as f, least(coalesce(e, duration), duration) as l from spans)
        select match_id, count(*) as n, {s6('min(t)')} as first, {s6('max(t)')} as last from poses join c using (match_id) where t >= f and t <= greatest(l, f + 0.5) group by 1""", "frames", "poses"),
    "seek_scan": with_tables(
        f""", sp as (select match_id, max(t) * 0.25::double as s, max(t) as e from frames group by 1), p as (select match_id, s + i * 0.7::double as t from (select match_id, s, unnest(range(0, floor((e - s) / 0.7::double + 1e-9)::bigint + 1)) as i from sp)),
        {_NEAREST} select match_id, {s6('t')} as t, {s6('near_t')} as near_t, near_frame_no from met""", "frames"),
    "asof_tolerance": with_tables(f", p as ({_PROBES}), {_NEAREST} select match_id, seq, case when abs(near_t - t) < 0.12::double then {s6('near_t')} end as near_t, case when abs(near_t - t) < 0.12::double then near_frame_no end as near_frame_no from met", "shots", "frames"),
    "recent_shots": with_tables(
        f""", s as ({_PROBES}), j as (select f.match_id, f.frame_no, s.t, s.seq, row_number() over (partition by f.match_id, f.frame_no order by s.t desc, s.seq desc) as k from frames f left join s on s.match_id = f.match_id and s.t <= f.t and s.t >= f.t - 0.12::double)
        select match_id, frame_no, {s6('t')} as last_at, seq as last_shot from j where k = 1""", "shots", "frames"),
    "rally_timeline": with_tables(f"select r.match_id, rally_idx, {s6('start_t / d * 100')} as left, {s6('(end_t - start_t) / d * 100')} as width from rallies r join (select match_id, max(t) as d from shots group by 1) using (match_id)", "rallies", "shots"),
    "greedy_dedupe": with_tables(_greedy("select match_id, frame_no, player_id, court_x / 10 as x, court_y / 10 as y from poses", "player_id", "sqrt(power(x{j} - x{i}, 2) + power(y{j} - y{i}, 2)) < 0.75"), "poses"),
    "body_suppression": with_tables(
        _greedy("select match_id, frame_no, player_id, court_x / 25 as x, court_y / 25 as y, -((court_x * 3 + player_id) % 1.7::double) as worse from poses", "worse, player_id",
                "greatest(0, 0.3::double - abs(x{j} - x{i})) * greatest(0, 0.4::double - abs(y{j} - y{i})) / 0.12::double > 0.45"), "poses"),
    "key_frames": with_tables(
        f""", hard as (select *, {ZONE.format('court_y')} as zone from shots where swing_speed >= 4.9),
        r as (select *, player_id || ':' || shot_type as kind, count(*) over (partition by match_id) as n, row_number() over (partition by match_id order by t, seq) - 1 as pos from hard),
        b as (select r.*, x.i as b from r join (values (0), (1), (2), (3), (4), (5)) as x(i) on pos >= floor(x.i * (n / 6.0::double)) and pos < floor((x.i + 1) * (n / 6.0::double)) where n > 6),
        packed as (select match_id, b, list({{'seq': seq, 'kind': kind, 'v': swing_speed}} order by pos) as l from b group by 1, 2),
        folded as (with recursive k as (select match_id, -1 as b, []::varchar[] as seen, null::bigint as seq from packed where b = 0
          union all
          select match_id, b, list_append(seen, pick.kind), pick.seq from (
            select k.match_id, p.b, k.seen, coalesce(list_filter(p.l, lambda x: not list_contains(k.seen, x.kind))[1], list_reduce(p.l, lambda m, x: case when x.v > m.v then x else m end)) as pick
            from k join packed p on p.match_id = k.match_id and p.b = k.b + 1)) select * from k),
        picked as (select match_id, seq from folded where seq is not null union all select match_id, seq from r where n <= 6)
        select match_id, {s6('t')} as t, case when player_id < 2 then 'A' else 'B' end || (player_id % 2 + 1) || ': ' || shot_type || ' from the ' || zone as caption from hard join picked using (match_id, seq)
        union all select match_id, {s6('match_id % 10 + (i + 0.5::double) / 4 * 20')} as t, 'general play' from (select match_id, unnest([0, 1, 2, 3]) as i from matches where match_id not in (select match_id from hard))""", "shots", "matches"),
    "highlight_list": with_tables(
        """select match_id, seq, place, greatest(n - 40, 0) as more from (select match_id, seq, row_number() over (partition by match_id order by swing_speed desc, seq) as place, count(*) over (partition by match_id) as n
        from ball_shots where shot_type in ('overhead', 'forehand')) where place <= 40""", "ball_shots"),
    "shot_list": with_tables("select match_id, count(*) as n, max(seq) as last from (select *, row_number() over (partition by match_id order by t, seq) as k from shots) where k <= 30 group by 1", "shots"),
    "thinned_json": with_tables(
        """, r as (select match_id, seq, length(to_json({'seq': seq, 'player_id': player_id, 'shot_type': shot_type})) as l, row_number() over (partition by match_id order by t, seq) - 1 as pos from shots),
        z as (select match_id, k, count(*) as n, sum(l) + count(*) + 1 as chars from r, (select unnest(range(0, 14)) as k) where pos % (1 << k) = 0 group by 1, 2),
        c as (select match_id, min(k) as k from z where chars <= 1500 or n <= 20 group by 1) select match_id, seq from r join c using (match_id) where pos % (1 << k) = 0""", "shots"),
    "score_summary": with_tables(
        f"""{pp._REPLAY}, s as (select match_id, {_SETS} as l, {pp._label('pa', 'pb')} as la, {pp._label('pb', 'pa')} as lb, ba, bb, ha, hb from final)
        select match_id, '{{"sets":[' || array_to_string(list_transform(l, lambda x: '{{"A":' || regexp_extract(x, '^(\\d+)-(\\d+)', 1) || ',"B":' || regexp_extract(x, '^(\\d+)-(\\d+)', 2) || '}}'), ',') || '],"current_game":{{"A":"' || la || '","B":"' || lb
          || '"}},"breaks":{{"A":' || ba || ',"B":' || bb || '}},"held":{{"A":' || ha || ',"B":' || hb || '}}}}' as document from s""", "point_feed"),
    "focus_player": with_tables("select m.match_id, coalesce(me, c.player_id, 0) as player_id from matches m left join (select match_id, player_id, row_number() over (partition by match_id order by count(*) desc, player_id) as k from shots group by 1, 2) c on c.match_id = m.match_id and k = 1", "matches", "shots"),
    "match_days": with_tables("select match_id, strftime(make_timestamp(created_at * 1000), '%b %-d') as day from matches", "matches"),
    "dominant_hands": with_tables(f", {_HANDS} select * from hands", "shots"),
    "player_cards": with_tables(
        f""", {_HANDS}, st as (select match_id, player_id, count(*) as n, max(swing_speed) + player_id / 8.0::double as v from shots group by 1, 2)
        select match_id, player_id, printf('%.1f km/h', floor(v * 36 + 0.5) / 10) as speed_text, case when n >= 18 then 'likely ' || hand || '-handed' end as hand_text from st join hands using (match_id, player_id)""", "shots"),
    "result_labels": with_tables(
        f"""{pp._REPLAY}, w as (select match_id, case when sa > sb then 'A' when sb > sa then 'B' when gamesa > gamesb then 'A' when gamesb > gamesa then 'B' when a > b then 'A' when b > a then 'B' end as winner
        from final join (select match_id, count(*) filter (winner = 'A') as a, count(*) filter (winner = 'B') as b from point_feed group by 1) using (match_id))
        select match_id, case when me is not null and winner is not null then case when winner = case when me < 2 then 'A' else 'B' end then 'won' else 'lost' end end as result from matches join w using (match_id)""", "point_feed", "matches"),
    "unused_goals": with_tables(
        f"""select match_id as owner, metric from matches, (select unnest({list(h.GOALS)}) as metric, unnest(range(0, 7)) as i) where i <> match_id % 7 and i <> (match_id * 3 + 1) % 7""", "matches"),
    "rapid_review": with_tables(
        """, k as (select match_id, rally_idx, 'abWfux'[((rally_idx + match_id) % 6 + 1)::integer] as a, 'abWfux'[((rally_idx * 5 + match_id * 3 + 2) % 6 + 1)::integer] as b from rallies),
        j as (select k.*, t.winner, t.ending from k left join (select * from point_tags where ending <> 'forced') t using (match_id, rally_idx)),
        w as (select *, case when lower(a) in ('a', 'b') then upper(a) end as w0, case when lower(b) in ('a', 'b') then upper(b) end as w1, case lower(a) when 'w' then 'winner' when 'f' then 'forced' when 'u' then 'unforced' end as e0, case lower(b) when 'w' then 'winner' when 'f' then 'forced' when 'u' then 'unforced' end as e1 from j)
        select match_id, rally_idx, coalesce(w1, w0, winner) as winner, case when e1 is not null and coalesce(w0, winner) is not null then e1 when e0 is not null and winner is not null then e0 else ending end as ending from w where coalesce(w1, w0, winner) is not null""", "rallies", "point_tags"),
    "rising_ticks": with_tables(
        """, o as (select match_id, seq, floor(t / 20 * 1000 + 0.5)::bigint as ms, row_number() over (partition by match_id order by t, seq) as i from shots),
        f as (with recursive k as (select match_id, seq, i, ms as tick from o where i = 1 union all select o.match_id, o.seq, o.i, greatest(k.tick + 1, o.ms) from k join o on o.match_id = k.match_id and o.i = k.i + 1) select * from k) select match_id, seq, tick from f""", "shots"),
    "work_marks": with_tables(
        f""", o as (select match_id, t, row_number() over (partition by match_id order by t) as i from shots),
        f as (with recursive k as (select match_id, i, t, 1 as n, t as since, false as mark from o where i = 1
          union all select match_id, i, t, n, case when n >= 9 or (n >= 3 and t - since > 30) then t else since end, n >= 9 or (n >= 3 and t - since > 30)
          from (select o.match_id, o.i, o.t, case when k.mark then 1 else k.n + 1 end as n, k.since from k join o on o.match_id = k.match_id and o.i = k.i + 1)) select * from k)
        select match_id, {s6('t')} as t from f where mark""", "shots"),
    "best_patterns": with_tables(
        f""", {pp._PATTERNS}, rates as (select match_id, team, pattern, count(*) filter (winner = team) as won, count(*) as played from point_tags join patterns using (match_id, rally_idx) group by 1, 2, 3), ok as (select *, won / played as rate, (won + 1) / (played + 2) as rank_rate from rates where played >= 2),
        e as (select match_id, team, count(*) as n, arg_min(pattern, {{'k': -rank_rate, 'p': pattern}}) as best, arg_min(rate, {{'k': -rank_rate, 'p': pattern}}) as best_rate, arg_min(pattern, {{'k': rank_rate, 'p': pattern}}) as worst, arg_min(rate, {{'k': rank_rate, 'p': pattern}}) as worst_rate from ok group by 1, 2)
        select match_id, team, best, worst, {s6('best_rate')} as best_rate, {s6('worst_rate')} as worst_rate from e where n >= 2 and best_rate - worst_rate >= 0.2""", "frames", "poses", "rallies", "point_tags"),
    "display_names": with_tables(
        """select match_id, slot, case when slot = 2 then 'B1' else name end as shown, 'match-' || match_id || '-' || lower(name) as file, case when length(t) > 12 then t[1:11] || '…' else t end as short,
        case when slot < 1.5 then '-' else '+' end || printf('%.1f', abs(slot - 1.5::double)) || ' pts' as delta from (select *, 'Match #' || match_id || ' - ' || name || '!' as t from names)""", "names"),
}
