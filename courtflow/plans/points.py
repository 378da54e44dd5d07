"""Queries on rallies, pairs, points and scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from courtflow.operators import history as h
from courtflow.operators import movement as m
from courtflow.operators import points as p
from courtflow.operators import scoring as sc
from courtflow.operators import tactics as tc
from courtflow.operators import timeseries as ts
from courtflow.plans.movement import FRAME_DT, TRACK, ZONE
from courtflow.plans.shared import kept, query, r6, s6
from courtflow.sources.surrogate import with_tables


@query("shots")
def rallies(shots):
    return p.rallies(shots).select("match_id", "rally_idx", r6("start_t"), r6("end_t"), "n_shots")


@query("shots")
def longest_rallies(shots):
    """The five longest rallies of all matches (ties by match and order)."""
    return p.rallies(shots).orderBy(F.desc("n_shots"), "match_id", "rally_idx").limit(5).select("match_id", "rally_idx", "n_shots", r6("start_t"))


@query("shots")
def hardest_swings(shots):
    return shots.orderBy(F.desc("swing_speed"), "seq").limit(40).select("match_id", "seq", "player_id", "shot_type", r6("swing_speed"))


@query("shots")
def highlight_filter(shots):
    """Lobs and overheads of the near team, and how many each player of a match has."""
    kept = shots.where((F.col("shot_type").isin("overhead", "forehand") | F.col("lob")) & (F.col("player_id") < 2))
    return kept.groupBy("match_id", "player_id").agg(F.count("*").alias("n"), r6(F.max("swing_speed"), "best"))


@query("shots")
def shot_mix(shots):
    counts = m.shot_counts(shots)
    return counts.withColumn("most", F.max("total_shots").over(Window.partitionBy("match_id"))).select("match_id", "player_id", "n_forehand", "n_backhand", "n_overhead", "n_forehand_volley", "n_backhand_volley", "total_shots", "most", r6("avg_swing_speed"))


@query("shots")
def match_kpis(shots):
    r = p.rallies(shots).groupBy("match_id").agg(F.count("*").alias("n_rallies"), F.max("n_shots").alias("longest"), r6(F.floor(F.avg("n_shots") * 10 + 0.5) / 10, "mean_shots"))
    s = shots.groupBy("match_id").agg(F.count("*").alias("n_shots"), F.sum(F.when(F.col("lob"), 1).otherwise(0)).cast("bigint").alias("n_lobs"), r6(F.max("t") - F.min("t"), "length"))
    return s.join(r, "match_id", "left")


@query("shots", "rallies")
def last_hitters(shots, rallies):
    return p.last_hitters(shots, rallies)


@query("shots", "rallies")
def serve_marking(shots, rallies):
    return p.marked_serves(shots, rallies).where("shot_type = 'serve'").select("match_id", "seq", "player_id")


@query("shots", "rallies")
def rally_servers(shots, rallies):
    return p.rally_servers(p.marked_serves(shots, rallies), rallies)


@query("rallies", "point_tags")
def first_untagged(rallies, tags):
    return p.first_untagged(rallies, tags.where("ending <> 'unforced'"))


@query("point_tags")
def tag_upsert(tags):
    key = F.col("rally_idx") % 5
    edits = tags.where(key < 2).withColumn("winner", F.when(key == 0, F.when(F.col("winner") == "A", "B").otherwise("A")))
    return p.tag_upsert(tags, edits).groupBy("match_id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("winner") == "A", 1).otherwise(0)).cast("bigint").alias("a"))


@query("shots")
def shot_edit(shots):
    key = ["match_id", "t", "player_id", "shot_type"]
    edits = shots.where("seq % 10 < 2").select(*key, F.when(F.col("seq") % 10 == 0, "overhead").alias("new_type"), (F.col("seq") % 10 == 1).alias("deleted"))
    edited = p.shot_edits(shots, edits)
    return edited.groupBy("match_id", "shot_type").agg(F.count("*").alias("n"), F.sum(F.when(F.col("edited"), 1).otherwise(0)).cast("bigint").alias("n_edited"))


@query("shots", "rallies", "point_tags")
def default_players(shots, rallies, tags):
    named = tags.join(p.last_hitters(shots, rallies), p.RALLY)
    return named.select("match_id", "rally_idx", p.default_player(F.col("winner"), F.col("ending"), F.col("last_player")).alias("player"))


@query("frames", "poses")
def team_tactics(frames, poses):
    t = tc.team_tactics(tc.paired_frames(frames, poses))
    return t.select("match_id", "team", *[r6(c) for c in t.columns if c not in ("match_id", "team", "net_takings")], "net_takings")


def _pattern_inputs(frames, poses, rallies):
    own = rallies.withColumns({"start_t": F.col("rally_idx") * 3.0, "end_t": F.col("rally_idx") * 3.0 + 4.5})
    return tc.rally_patterns(tc.paired_frames(frames, poses), own), own


@query("frames", "poses", "rallies")
def rally_patterns(frames, poses, rallies):
    return _pattern_inputs(frames, poses, rallies)[0]


@query("frames", "poses")
def swapped_tactics(frames, poses):
    """Tactics after two players of different pairs were exchanged from a time on."""
    t = tc.team_tactics(tc.paired_frames(frames, m.swapped(poses, 0, 2, 20.0)))
    return t.select("match_id", "team", r6("paired_seconds"), r6("share_net"), r6("share_split"), r6("avg_spacing"), "net_takings")


@query("frames", "poses", "rallies")
def swapped_patterns(frames, poses, rallies):
    return _pattern_inputs(frames, m.swapped(poses, 0, 2, 20.0), rallies)[0]


@query("shots")
def swapped_shots(shots):
    return m.shot_counts(m.swapped(shots, 0, 2, 20.0)).select("match_id", "player_id", "total_shots", r6("avg_swing_speed"))


@query("frames", "poses", "rallies", "point_tags")
def point_rates(frames, poses, rallies, tags):
    patterns, own = _pattern_inputs(frames, poses, rallies)
    return p.point_stats(own, tags, patterns)[1].select("match_id", "team", "pattern", "won", "played", r6("rank_rate"))


@query("rallies", "point_tags")
def point_scores(rallies, tags):
    empty = rallies.limit(0).selectExpr("match_id", "rally_idx", "'A' as team", "'net' as pattern")
    return p.point_stats(rallies, tags, empty)[0]


@query("rallies", "point_tags")
def point_endings(rallies, tags):
    empty = rallies.limit(0).selectExpr("match_id", "rally_idx", "'A' as team", "'net' as pattern")
    return p.point_stats(rallies, tags, empty)[2]


def _scored(feed):
    return sc.scores(feed.withColumn("golden", F.col("match_id") % 2 == 0))


@query("point_feed")
def score_match(feed):
    s = _scored(feed)
    return s.select(
        "match_id", sc.score_text(F.col("sets")).alias("score"), "label_a", "label_b", "serving", "games_a", "games_b", "chances_a", "breaks_a", "chances_b", "breaks_b",
        "served_a", "held_a", "served_b", "held_b", "points",
    )


@query("point_feed")
def match_winner(feed):
    return sc.winners(_scored(feed), feed)


@query("matches", "names", "point_feed")
def people_records(matches, names, feed):
    won = matches.select("match_id", F.when(F.col("match_id") % 5 == 0, None).when(F.col("match_id") % 5 < 3, "A").otherwise("B").alias("winner"))
    r = h.people(matches, names, won)
    return r.select("role", "name", "matches", "won", "lost", r6("win_rate"))


@query("matches")
def my_record(matches):
    won = matches.select("match_id", F.when(F.col("match_id") % 5 == 0, None).when(F.col("match_id") % 5 < 3, "A").otherwise("B").alias("winner"))
    return h.my_record(matches, won)


def _metrics(matches, frames, poses, rallies, tags):
    """Match metrics of the matches that have poses, owned by four people."""
    rallies, tags = kept(rallies, "rallies"), kept(tags, "tags")  # scores and endings both go by them
    stats = m.movement(m.smoothed_track(poses))
    scores, _, endings = p.point_stats(rallies, tags, rallies.limit(0).selectExpr("match_id", "rally_idx", "'A' as team", "'net' as pattern"))
    length = frames.groupBy("match_id").agg(F.max("t").alias("seconds"))
    rows = matches.join(length, "match_id")
    out = h.match_metrics(rows, stats, tc.team_tactics(tc.paired_frames(frames, poses)), scores, endings)
    return out.withColumns({"owner": F.col("match_id") % 4, "break_points": F.when(F.col("match_id") % 3 > 0, F.col("match_id") * 2.0)})


@query("matches", "frames", "poses", "rallies", "point_tags")
def match_metrics(*tables):
    return _metrics(*tables).select("match_id", "my_team", "tagged", *[r6(c) for c in h.COMPARED])


@query("matches", "frames", "poses", "rallies", "point_tags")
def usual_vs_now(*tables):
    u = h.usual_and_now(_metrics(*tables))
    return u.select("match_id", "owner", "metric", r6("current"), r6("usual"), r6("delta"), "basis")


@query("matches", "frames", "poses", "rallies", "point_tags")
def trend_metrics(*tables):
    t = h.trends(_metrics(*tables), ["net", "together", "split", "pace", "won"])
    return t.select("owner", "metric", "n", r6("low"), r6("high"), r6("first"), r6("last"), r6("change"))


@query("matches", "frames", "poses", "rallies", "point_tags")
def trend_axes(*tables):
    t = h.trend_axes(h.trends(_metrics(*tables), ["net", "together", "split", "pace", "won"]))
    return t.select("owner", "metric", r6("axis_low"), r6("axis_high"), F.col("rising").cast("int").alias("rising"))


def _goals(spark):
    return spark.createDataFrame([(k, v[1]) for k, v in h.GOALS.items()], "metric string, target double")


@query("matches", "frames", "poses", "rallies", "point_tags")
def goal_board(*tables):
    """Goals met in each owner's newest eight matches."""
    recent = h.latest(_metrics(*tables))
    return h.goals_met(h.goal_results(recent, _goals(recent.sparkSession), ("owner", "match_id")), ("owner",))


@query("matches", "frames", "poses", "rallies", "point_tags")
def goal_grid(*tables):
    metrics = _metrics(*tables)
    goals = _goals(metrics.sparkSession)
    return h.goal_results(metrics, goals).select("match_id", "metric", "target", r6("value"), F.col("met").cast("int").alias("met"))


@query("matches", "frames", "poses", "rallies", "point_tags")
def goals_met(*tables):
    metrics = _metrics(*tables)
    return h.goals_met(h.goal_results(metrics, _goals(metrics.sparkSession)))


@query("shots")
def cooldown_peaks(shots):
    """Swings of at least 9 that no neighbour exceeds, thinned to one in 8 time units per player."""
    keys = ["match_id", "player_id"]
    peaks = ts.local_peaks(shots, keys, ["t", "seq"], "swing_speed", 9.0)
    return ts.spaced_peaks(peaks, keys, "t", "swing_speed", 8.0).select(*keys, r6("t"), r6("swing_speed"))


@query("shots")
def debounced_shots(shots):
    return ts.debounced(shots, ["match_id"], "t", 2.0).select("match_id", r6("t"))


@query("shots")
def local_peaks(shots):
    return ts.local_peaks(shots, ["match_id", "player_id"], ["t", "seq"], "swing_speed", 9.0).select("match_id", "seq", r6("swing_speed"))


_names = (
    "rallies longest_rallies hardest_swings highlight_filter shot_mix match_kpis last_hitters serve_marking rally_servers first_untagged tag_upsert shot_edit default_players "
    "team_tactics rally_patterns point_rates point_scores point_endings score_match match_winner people_records my_record match_metrics usual_vs_now trend_metrics goal_grid "
    "goals_met cooldown_peaks debounced_shots local_peaks trend_axes goal_board swapped_tactics swapped_patterns swapped_shots"
)
QUERIES = {n: globals()[n] for n in _names.split()}

_INSIDE = "inside as (select r.match_id, r.rally_idx, s.seq, s.t, s.player_id, s.shot_type, s.court_y, r.start_t from shots s join rallies r on s.match_id = r.match_id and s.t between r.start_t and r.end_t)"
_SERVES = f"""{_INSIDE}, firsts as (select distinct match_id, seq from (select *, row_number() over (partition by match_id, rally_idx order by t, seq) as k from inside) where k = 1),
served as (select s.match_id, s.seq, s.t, s.player_id from shots s join firsts using (match_id, seq) where {ZONE.format('court_y')} = 'baseline' and shot_type <> 'overhead')"""
_BAND = lambda y: f"case when abs({y} - 10) < 4 then 'net' when abs({y} - 10) < 7.5 then 'mid' else 'back' end"
_PAIRS = f"""{FRAME_DT}, both_in as (select match_id, frame_no, case when player_id < 2 then 'A' else 'B' end as team, max(case when player_id % 2 = 0 then court_x end) as x0, max(case when player_id % 2 = 0 then court_y end) as y0,
  max(case when player_id % 2 = 1 then court_x end) as x1, max(case when player_id % 2 = 1 then court_y end) as y1 from poses group by 1, 2, 3),
pairs as (select *, case when a = b then a when (a = 'net' and b = 'back') or (a = 'back' and b = 'net') then 'split' else 'staggered' end as pattern from (
  select p.*, f.t, case when f.dt = 0 then 0.1 else f.dt end as dt, {_BAND('y0')} as a, {_BAND('y1')} as b from both_in p join timed f using (match_id, frame_no) where x0 is not null and x1 is not null))"""
_TACTICS = f"""{_PAIRS}, tactics as (select match_id, team, sum(dt) as paired_seconds, {', '.join(f"sum(case when pattern = '{k}' then dt else 0 end) / sum(dt) as share_{k}" for k in ('net', 'mid', 'back', 'staggered', 'split'))},
  sum(sqrt(power(x0 - x1, 2) + power(y0 - y1, 2)) * dt) / sum(dt) as avg_spacing, sum(abs(abs(y0 - 10) - abs(y1 - 10)) * dt) / sum(dt) as avg_depth_gap, sum(abs(x0 - x1) * dt) / sum(dt) as avg_lateral_gap,
  count(*) filter (pattern = 'net' and not before) as net_takings from (select *, coalesce(lag(pattern) over (partition by match_id, team order by t, frame_no) = 'net', false) as before from pairs) group by 1, 2)"""
_PATTERNS = f"""{_PAIRS}, own as (select match_id, rally_idx, rally_idx * 3.0::double as start_t, rally_idx * 3.0::double + 4.5::double as end_t from rallies),
counted as (select o.match_id, rally_idx, team, pattern, count(*) as n, min(t) as first from pairs p join own o on p.match_id = o.match_id and p.t between o.start_t and o.end_t group by 1, 2, 3, 4),
patterns as (select match_id, rally_idx, team, pattern from (select *, row_number() over (partition by match_id, rally_idx, team order by n desc, first) as k from counted) where k = 1)"""
_REAL = "dt > 0 and dt <= 1 and dist / dt <= 8"
_METRICS = f""", {TRACK}, {_TACTICS}, stats as (select match_id, player_id, avg(case when {ZONE.format('court_y')} = 'net' then 1 else 0 end) as share_net, coalesce(sum(case when {_REAL} then dist end), 0) as distance from track group by 1, 2),
sc as (select match_id, count(*) as tagged, count(*) filter (winner = 'A') as pa, count(*) filter (winner = 'B') as pb from point_tags group by 1),
en as (select match_id, player, count(*) filter (ending = 'winner') as w, count(*) filter (ending = 'unforced') as u from point_tags where player is not null group by 1, 2),
metrics as (select m.match_id, m.created_at, m.demo, m.match_id % 4 as owner, case when me < 2 then 'A' else 'B' end as my_team, coalesce(tagged, 0) as tagged, s.share_net * 100 as net, t.share_net * 100 as together,
  t.share_split * 100 as split, s.distance / (greatest(f.seconds, 0.001) / 60) as pace, case when tagged > 0 then case when me < 2 then pa else pb end / tagged * 100 end as won,
  case when tagged >= 5 then coalesce(u, 0) / tagged * 10 end as unforced, case when tagged > 0 then coalesce(w, 0) end as winners, case when tagged > 0 then coalesce(u, 0) end as unforced_count,
  case when m.match_id % 3 > 0 then m.match_id * 2.0 end as break_points
  from matches m join (select match_id, max(t) as seconds from frames group by 1) f using (match_id) left join stats s on s.match_id = m.match_id and s.player_id = me
  left join tactics t on t.match_id = m.match_id and t.team = case when me < 2 then 'A' else 'B' end left join sc on sc.match_id = m.match_id left join en on en.match_id = m.match_id and en.player = me where me is not null)"""
_MELT = lambda names: " union all ".join(f"select match_id, created_at, demo, owner, '{k}' as metric, {c}::double as value from metrics" for k, c in names.items())
_GOALS = f""", goals(metric, target, most) as (values {', '.join(f"('{k}', {v[1]}::double, {str(v[0]).lower()})" for k, v in h.GOALS.items())}),
vals as ({_MELT({'split': 'split', 'netTogether': 'together', 'netTime': 'net', 'unforced': 'unforced_count', 'winners': 'winners', 'breakPoints': 'break_points', 'distance': 'pace'})}),
graded as (select match_id, metric, target, value, case when value is not null then case when most then value <= target else value >= target end end as met from vals join goals using (metric))"""
_SWAPPED = "swapped as (select * replace (case when t >= 20 and player_id = 0 then 2 when t >= 20 and player_id = 2 then 0 else player_id end as player_id) from {0})"
_M_TABLES = ("matches", "frames", "poses", "rallies", "point_tags")
_WON = "case when m.match_id % 5 = 0 then null when m.match_id % 5 < 3 then 'A' else 'B' end"
_wins = lambda a, b: f"(case when tb then {a} >= 7 and {a} - {b} >= 2 else {a} >= 4 and {a} - {b} >= case when golden then 1 else 2 end end)"
#: One recursive row for each point: the state after it.
_REPLAY = f""", feed as (select *, match_id % 2 = 0 as golden from point_feed),
replay as (with recursive st as (
  select match_id, -1::bigint as k, 0 as pa, 0 as pb, false as tb, null::varchar as srv, null::varchar as gs, 0 as ga, 0 as gb, ''::varchar as sets, 0 as sa, 0 as sb, 0 as gamesa, 0 as gamesb,
         0 as ca, 0 as ba, 0 as cb, 0 as bb, 0 as va, 0 as ha, 0 as vb, 0 as hb from (select distinct match_id from feed)
  union all
  select match_id, k, case when over then 0 else pa end, case when over then 0 else pb end,
         case when set_over then false when over then ga = 6 and gb = 6 else tb end,
         case when over then case gs when 'A' then 'B' when 'B' then 'A' end else srv end, case when over then null else gs end,
         case when set_over then 0 else ga end, case when set_over then 0 else gb end,
         case when set_over then sets || ga || '-' || gb || case when tb then '(' || pa || '-' || pb || ')' else '' end || ' ' else sets end,
         sa + case when set_over and ga > gb then 1 else 0 end, sb + case when set_over and gb > ga then 1 else 0 end,
         gamesa + case when over and w = 'A' then 1 else 0 end, gamesb + case when over and w = 'B' then 1 else 0 end,
         ca + na, ba + case when w = 'A' then na else 0 end, cb + nb, bb + case when w = 'B' then nb else 0 end,
         va + case when over and not tb and gs = 'A' then 1 else 0 end, ha + case when over and not tb and gs = 'A' and w = 'A' then 1 else 0 end,
         vb + case when over and not tb and gs = 'B' then 1 else 0 end, hb + case when over and not tb and gs = 'B' and w = 'B' then 1 else 0 end
  from (select *, over and (tb or (greatest(ga, gb) >= 6 and abs(ga - gb) >= 2)) as set_over
        from (select * exclude (ga, gb), ga + case when over and w = 'A' then 1 else 0 end as ga, gb + case when over and w = 'B' then 1 else 0 end as gb
              from (select * exclude (pa0, pb0), case when w = 'A' then {_wins('pa', 'pb')} else {_wins('pb', 'pa')} end as over,
                           case when not tb and gs = 'B' and {_wins('(pa0 + 1)', 'pb0')} then 1 else 0 end as na, case when not tb and gs = 'A' and {_wins('(pb0 + 1)', 'pa0')} then 1 else 0 end as nb
                    from (select st.* exclude (k, gs, pa, pb), f.rally_idx as k, f.winner as w, f.golden, st.pa as pa0, st.pb as pb0,
                                 st.pa + case when f.winner = 'A' then 1 else 0 end as pa, st.pb + case when f.winner = 'B' then 1 else 0 end as pb,
                                 case when st.pa = 0 and st.pb = 0 then coalesce(f.server, st.srv) else coalesce(st.gs, f.server) end as gs
                          from st join feed f on f.match_id = st.match_id and f.rally_idx = st.k + 1)))))
  select * from st),
final as (select r.*, r.match_id % 2 = 0 as golden from replay r join (select match_id, max(rally_idx) as k from feed group by 1) using (match_id, k))"""
_label = lambda a, b: f"case when tb then {a}::varchar when {a} <= 3 and {b} <= 3 then ['0', '15', '30', '40'][{a} + 1] when not golden and {a} > {b} then 'Ad' else '40' end"
_PEAKS = "peaks as (select match_id, player_id, seq, t, swing_speed from (select *, lag(swing_speed) over w as a, lead(swing_speed) over w as c from shots window w as (partition by match_id, player_id order by t, seq)) where swing_speed >= 9 and swing_speed >= coalesce(a, swing_speed) and swing_speed >= coalesce(c, swing_speed))"

ORACLE_SQL = {
    "rallies": with_tables(f"select match_id, rally_idx, {s6('start_t')} as start_t, {s6('end_t')} as end_t, n_shots from rallies", "rallies"),
    "longest_rallies": with_tables(f"select match_id, rally_idx, n_shots, {s6('start_t')} as start_t from rallies order by n_shots desc, match_id, rally_idx limit 5", "rallies"),
    "hardest_swings": with_tables(f"select match_id, seq, player_id, shot_type, {s6('swing_speed')} as swing_speed from shots order by shots.swing_speed desc, seq limit 40", "shots"),
    "highlight_filter": with_tables(f"select match_id, player_id, count(*) as n, {s6('max(swing_speed)')} as best from shots where (shot_type in ('overhead', 'forehand') or lob) and player_id < 2 group by 1, 2", "shots"),
    "shot_mix": with_tables(
        f"""select match_id, player_id, {', '.join(f"count(*) filter (shot_type = '{k}') as n_{k.replace('-', '_')}" for k in ('forehand', 'backhand', 'overhead', 'forehand-volley', 'backhand-volley'))},
        count(*) as total_shots, max(count(*)) over (partition by match_id) as most, {s6('avg(swing_speed)')} as avg_swing_speed from shots group by 1, 2""", "shots"),
    "match_kpis": with_tables(
        f"""select * from (select match_id, count(*) as n_shots, count(*) filter (lob) as n_lobs, {s6('max(t) - min(t)')} as length from shots group by 1)
        left join (select match_id, count(*) as n_rallies, max(n_shots) as longest, {s6('floor(avg(n_shots) * 10 + 0.5) / 10')} as mean_shots from rallies group by 1) using (match_id)""", "shots", "rallies"),
    "last_hitters": with_tables(f", {_INSIDE} select r.match_id, r.rally_idx, l.player_id as last_player from rallies r left join (select *, row_number() over (partition by match_id, rally_idx order by t desc, seq desc) as k from inside) l on l.match_id = r.match_id and l.rally_idx = r.rally_idx and k = 1", "shots", "rallies"),
    "serve_marking": with_tables(f", {_SERVES} select match_id, seq, player_id from served", "shots", "rallies"),
    "rally_servers": with_tables(
        f""", {_SERVES}, f as (select r.match_id, r.rally_idx, s.player_id, row_number() over (partition by r.match_id, r.rally_idx order by s.t, s.seq) as k from served s join rallies r on s.match_id = r.match_id and s.t between r.start_t and r.end_t)
        select r.match_id, r.rally_idx, case when player_id < 2 then 'A' when player_id >= 2 then 'B' end as server from rallies r left join f on f.match_id = r.match_id and f.rally_idx = r.rally_idx and k = 1""", "shots", "rallies"),
    "first_untagged": with_tables("select match_id, min(rally_idx) as rally_idx from rallies where rally_idx % 3 = 2 group by 1", "rallies"),
    "tag_upsert": with_tables("select match_id, count(*) as n, count(*) filter (case when rally_idx % 5 = 0 then winner = 'B' else winner = 'A' end) as a from point_tags where rally_idx % 5 <> 1 group by 1", "point_tags"),
    "shot_edit": with_tables("select match_id, case when seq % 10 = 0 then 'overhead' else shot_type end as shot_type, count(*) as n, count(*) filter (seq % 10 = 0) as n_edited from shots where seq % 10 <> 1 group by 1, 2", "shots"),
    "default_players": with_tables(
        f""", {_INSIDE}, l as (select match_id, rally_idx, player_id as p from (select *, row_number() over (partition by match_id, rally_idx order by t desc, seq desc) as k from inside) where k = 1)
        select t.match_id, t.rally_idx, case when (case when p < 2 then 'A' else 'B' end) = (case when ending = 'winner' then winner when winner = 'A' then 'B' else 'A' end) then p end as player from point_tags t left join l using (match_id, rally_idx)""", "shots", "rallies", "point_tags"),
    "team_tactics": with_tables(f", {_TACTICS} select match_id, team, {', '.join(f'{s6(c)} as {c}' for c in ('paired_seconds', 'share_net', 'share_mid', 'share_back', 'share_staggered', 'share_split', 'avg_spacing', 'avg_depth_gap', 'avg_lateral_gap'))}, net_takings from tactics", "frames", "poses"),
    "rally_patterns": with_tables(f", {_PATTERNS} select * from patterns", "frames", "poses", "rallies"),
    "point_rates": with_tables(f", {_PATTERNS} select match_id, team, pattern, count(*) filter (winner = team) as won, count(*) as played, {s6('(count(*) filter (winner = team) + 1) / (count(*) + 2)')} as rank_rate from point_tags join patterns using (match_id, rally_idx) group by 1, 2, 3", "frames", "poses", "rallies", "point_tags"),
    "point_scores": with_tables("select match_id, count(*) as tagged, count(*) filter (winner = 'A') as points_a, count(*) filter (winner = 'B') as points_b from point_tags group by 1", "point_tags"),
    "point_endings": with_tables("select match_id, player as player_id, count(*) filter (ending = 'winner') as n_winner, count(*) filter (ending = 'forced') as n_forced, count(*) filter (ending = 'unforced') as n_unforced from point_tags where player is not null group by 1, 2", "point_tags"),
    "score_match": with_tables(
        f"""{_REPLAY} select match_id, trim(sets || case when ga + gb + pa + pb > 0 or sets = '' then ga || '-' || gb else '' end) as score, {_label('pa', 'pb')} as label_a, {_label('pb', 'pa')} as label_b,
        case when pa + pb > 0 then gs else srv end as serving, gamesa as games_a, gamesb as games_b, ca as chances_a, ba as breaks_a, cb as chances_b, bb as breaks_b, va as served_a, ha as held_a, vb as served_b, hb as held_b, (k + 1)::integer as points from final""", "point_feed"),
    "match_winner": with_tables(
        f"""{_REPLAY} select match_id, case when sa > sb then 'A' when sb > sa then 'B' when gamesa > gamesb then 'A' when gamesb > gamesa then 'B' when a > b then 'A' when b > a then 'B' end as winner
        from final join (select match_id, count(*) filter (winner = 'A') as a, count(*) filter (winner = 'B') as b from point_feed group by 1) using (match_id)""", "point_feed"),
    "people_records": with_tables(
        f""", r as (select case when (slot < 2) = (me < 2) then 'partner' else 'rival' end as role, lower(trim(name)) as key, trim(name) as name, m.created_at, m.match_id, slot, {_WON} as winner, case when me < 2 then 'A' else 'B' end as mine
          from names n join matches m on m.match_id = n.match_id where me is not null and not demo and slot <> me and trim(name) <> '')
        select role, arg_min(name, created_at * 10 + slot) as name, count(*) as matches, count(*) filter (winner = mine) as won, count(*) filter (winner <> mine) as lost,
               {s6('case when count(winner) > 0 then count(*) filter (winner = mine) / count(winner) end')} as win_rate from r group by role, key""", "matches", "names"),
    "my_record": with_tables(f"select count(*) as matches, count(*) filter (winner = mine) as won, count(*) filter (winner <> mine) as lost from (select {_WON} as winner, case when me < 2 then 'A' else 'B' end as mine from matches m where me is not null and not demo)", "matches"),
    "match_metrics": with_tables(f"{_METRICS} select match_id, my_team, tagged, {', '.join(f'{s6(c)} as {c}' for c in h.COMPARED)} from metrics", *_M_TABLES),
    "usual_vs_now": with_tables(
        f"""{_METRICS}, long as ({_MELT({c: c for c in h.COMPARED})}), c as (select *, avg(value) over w as usual, count(value) over w as basis from long where not demo
        window w as (partition by owner, metric order by created_at, match_id rows between 5 preceding and 1 preceding))
        select match_id, owner, metric, {s6('value')} as current, {s6('usual')} as usual, {s6('value - usual')} as delta, basis from c where value is not null and usual is not null""", *_M_TABLES),
    "trend_metrics": with_tables(
        f"""{_METRICS}, long as ({_MELT({c: c for c in ('net', 'together', 'split', 'pace', 'won')})})
        select owner, metric, count(*) as n, {s6('min(value)')} as low, {s6('max(value)')} as high, {s6('first(value order by created_at, match_id)')} as first, {s6('last(value order by created_at, match_id)')} as last,
               {s6('last(value order by created_at, match_id) - first(value order by created_at, match_id)')} as change from long where value is not null and not demo group by 1, 2 having count(*) >= 2""", *_M_TABLES),
    "trend_axes": with_tables(
        f"""{_METRICS}, long as ({_MELT({c: c for c in ('net', 'together', 'split', 'pace', 'won')})}),
        ends as (select owner, metric, min(value) as low, max(value) as high, arg_min(value, (created_at, match_id)) as a, arg_max(value, (created_at, match_id)) as b from long where value is not null and not demo group by 1, 2 having count(*) >= 2)
        select owner, metric, {s6('case when high - low < 1e-9 then low - 1 else low end')} as axis_low, {s6('case when high - low < 1e-9 then high + 1 else high end')} as axis_high, (b >= a)::integer as rising from ends""", *_M_TABLES),
    "goal_board": with_tables(
        f"""{_METRICS}{_GOALS}, recent as (select match_id, owner from metrics qualify row_number() over (partition by owner order by created_at desc, match_id desc) <= 8)
        select owner, metric, count(*) filter (met) as met, count(met) as checked from graded join recent using (match_id) group by 1, 2""", *_M_TABLES),
    "swapped_tactics": with_tables(
        f", {_SWAPPED.format('poses')}, {_TACTICS.replace('from poses', 'from swapped')} select match_id, team, {', '.join(f'{s6(c)} as {c}' for c in ('paired_seconds', 'share_net', 'share_split', 'avg_spacing'))}, net_takings from tactics", "frames", "poses"),
    "swapped_patterns": with_tables(f", {_SWAPPED.format('poses')}, {_PATTERNS.replace('from poses', 'from swapped')} select * from patterns", "frames", "poses", "rallies"),
    "swapped_shots": with_tables(f", {_SWAPPED.format('shots')} select match_id, player_id, count(*) as total_shots, {s6('avg(swing_speed)')} as avg_swing_speed from swapped group by 1, 2", "shots"),
    "goal_grid": with_tables(f"{_METRICS}{_GOALS} select match_id, metric, target, {s6('value')} as value, met::integer as met from graded", *_M_TABLES),
    "goals_met": with_tables(f"{_METRICS}{_GOALS} select metric, count(*) filter (met) as met, count(met) as checked from graded group by 1", *_M_TABLES),
    "local_peaks": with_tables(f", {_PEAKS} select match_id, seq, {s6('swing_speed')} as swing_speed from peaks", "shots"),
    "debounced_shots": with_tables(
        f"""select match_id, {s6('t')} as t from (with recursive k as (select match_id, min(t) as t from shots group by 1 union all
          select k.match_id, (select min(s.t) from shots s where s.match_id = k.match_id and s.t > k.t and s.t - k.t >= 2) from k where k.t is not null) select * from k where t is not null)""", "shots"),
    "cooldown_peaks": with_tables(
        f""", {_PEAKS}, numbered as (select *, row_number() over (partition by match_id, player_id order by t, swing_speed) as i from peaks),
        folded as (with recursive k as (
            select match_id, player_id, i, t, swing_speed as v, false as closed, null::double as ct, null::double as cv from numbered where i = 1
            union all
            select n.match_id, n.player_id, n.i, case when n.t - k.t < 8 and n.swing_speed <= k.v then k.t else n.t end, case when n.t - k.t < 8 and n.swing_speed <= k.v then k.v else n.swing_speed end,
                   n.t - k.t >= 8, case when n.t - k.t >= 8 then k.t end, case when n.t - k.t >= 8 then k.v end
            from k join numbered n on n.match_id = k.match_id and n.player_id = k.player_id and n.i = k.i + 1) select * from k),
        done as (select match_id, player_id, ct as t, cv as v from folded where closed
                 union all select match_id, player_id, arg_max(t, i), arg_max(v, i) from folded group by 1, 2)
        select match_id, player_id, {s6('t')} as t, {s6('v')} as swing_speed from done""", "shots"),
}
