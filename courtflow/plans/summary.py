"""Queries that go the whole way from a match's tables to what its review says."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtflow.operators import analysis as an
from courtflow.operators import history as h
from courtflow.operators import points as p
from courtflow.operators import rules as ru
from courtflow.operators import scoring as sc
from courtflow.operators import tactics as tc
from courtflow.plans import bodies as bd
from courtflow.plans import movement as mv
from courtflow.plans import points as pp
from courtflow.plans import signals as sg
from courtflow.plans.shared import kept, query, r6, s6
from courtflow.sources.surrogate import with_tables

_REVIEWED = ("shots", "matches", "frames", "poses", "rallies", "point_tags", "corners", "ball_obs")


@query(*_REVIEWED)
def match_takeaways(shots, matches, frames, poses, rallies, tags, corners, obs):
    """Takeaways from tactics, win rates by pattern, goals, replayed points and coverage of each match."""
    patterns, own = pp._pattern_inputs(frames, poses, rallies)
    scores, rates, endings = p.point_stats(own, tags, patterns)
    goals = h.goal_results(pp._metrics(matches, frames, poses, rallies, tags), pp._goals(matches.sparkSession))
    served = p.rally_servers(p.marked_serves(shots, rallies), rallies)
    score = sc.scores(tags.join(served, p.RALLY, "left").select(*p.RALLY, "winner", "server", (F.col("match_id") % 2 == 0).alias("golden")))
    facts = ru.review_facts(matches, tc.team_tactics(tc.paired_frames(frames, poses)), ru.best_and_worst(rates), goals, scores, endings, score, sg._graded(frames, poses, corners, obs, shots))
    return ru.takeaways(facts).select("match_id", "rule", "tone", "section", r6("priority"), "place")


@query("matches", "shots", "rallies", "point_feed")
def match_next_steps(matches, shots, rallies, feed):
    """What is left to do: tags are the fed points that have a rally; only demos come with a report."""
    count = lambda rows, name: rows.groupBy("match_id").agg(F.count("*").alias(name))
    facts = matches.select("match_id", "me", F.col("demo").alias("has_report"))
    for rows, name in ((shots, "n_shots"), (rallies, "n_rallies"), (feed.join(rallies.select(*p.RALLY), p.RALLY), "tagged")):
        facts = facts.join(count(rows, name), "match_id", "left")
    return ru.next_steps(facts.fillna(0, ["n_shots", "n_rallies", "tagged"])).select("match_id", F.array_join("steps", ",").alias("steps"))


SWING = 12.0


def _analysis(frames, sightings):
    """The analysis of bodies that nobody has named."""
    landmarks = bd.landmarks(sightings).select("match_id", "frame_no", "t", "seq", "x", "y", "landmarks")
    return an.analysed(frames, landmarks, bd.ASPECT, kept, SWING, bd.COOLDOWN)


@query("frames", "sightings")
def match_analysis(frames, sightings):
    """All players of each match after the whole analysis of unnamed bodies, beside the match's rallies."""
    a = _analysis(frames, sightings)
    rallies = a.rallies.groupBy("match_id").agg(F.count("*").alias("n_rallies"), F.max("n_shots").alias("longest"))
    rows = a.stats.join(rallies, "match_id", "left")
    return rows.select("match_id", "player_id", *[r6(c) for c in ("distance", "tracked_seconds", "detected_seconds", "avg_swing_speed")], "total_shots", "n_rallies", "longest")


@query("frames", "sightings")
def analysed_tactics(frames, sightings):
    """Tactics of both pairs after the same analysis."""
    t = _analysis(frames, sightings).tactics
    return t.select("match_id", "team", *[r6(c) for c in ("paired_seconds", "share_net", "share_mid", "avg_spacing")], "net_takings")


QUERIES = {"match_analysis": match_analysis, "analysed_tactics": analysed_tactics, "match_takeaways": match_takeaways, "match_next_steps": match_next_steps}

_SERVERS = f"""{pp._SERVES}, served_first as (select r.match_id, r.rally_idx, s.player_id, row_number() over (partition by r.match_id, r.rally_idx order by s.t, s.seq) as k
  from served s join rallies r on s.match_id = r.match_id and s.t between r.start_t and r.end_t),
fed as (select g.match_id, g.rally_idx, g.winner, case when player_id < 2 then 'A' when player_id >= 2 then 'B' end as server
  from point_tags g left join served_first s on s.match_id = g.match_id and s.rally_idx = g.rally_idx and k = 1)"""
_BEST = """rates as (select match_id, team, count(*) as played, count(*) filter (winner = team) / count(*) as rate, (count(*) filter (winner = team) + 1) / (count(*) + 2) as rank_rate
  from point_tags join patterns using (match_id, rally_idx) group by match_id, team, pattern),
ends as (select match_id, team, arg_max(rate, rank_rate) - arg_min(rate, rank_rate) as gap from rates where played >= 2 group by 1, 2 having count(*) >= 2 and gap >= 0.2)"""
_FACTS = """facts as (select m.match_id as k, m.me, m.demo, coalesce(sc.tagged, 0) as tagged, t.paired_seconds as paired, t.share_net as net, t.share_split as split, e.gap is not null as gap, g.checked, g.missed,
    case when m.side = 'A' then f.ca else f.cb end as chances, case when m.side = 'A' then f.ba else f.bb end as breaks, en.u as unforced, en.w as winners, v.grade
  from (select *, case when me >= 2 then 'B' else 'A' end as side from matches) m left join tactics t on t.match_id = m.match_id and t.team = m.side left join ends e on e.match_id = m.match_id and e.team = m.side
  left join (select match_id, count(met) as checked, count(*) filter (not met) as missed from graded group by 1) g on g.match_id = m.match_id left join sc on sc.match_id = m.match_id
  left join en on en.match_id = m.match_id and en.player = m.me left join final f on f.match_id = m.match_id
  left join (select match_id, case when mean >= 0.75 and low >= 0.5 and cal then 'good' when mean >= 0.45 then 'fair' else 'poor' end as grade from covered) v on v.match_id = m.match_id)"""
_PATTERNS = pp._PATTERNS.removeprefix(f"{pp._PAIRS}, ")
_COVERED = sg._DET[sg._DET.index("det as") :].replace("facts as", "covered as")
_REPLAY = pp._REPLAY.replace("from point_feed", "from fed")

_SEEN = "seen_poses as (select match_id, frame_no, t, place as player_id, x as court_x, y as court_y from sightings)"
_FILLED = """n as (select *, row_number() over (partition by match_id order by t, frame_no) as i from frames),
gaps as (select p.*, n.i, lead(n.i) over w as j, lead(p.t) over w as nt, lead(court_x) over w as nx, lead(court_y) over w as ny
  from seen_poses p join n on p.match_id = n.match_id and p.frame_no = n.frame_no window w as (partition by p.match_id, p.player_id order by p.t, p.frame_no)),
poses as (select match_id, frame_no, t, player_id, court_x, court_y from seen_poses union all
  select s.match_id, n.frame_no, n.t, s.player_id, court_x + (nx - court_x) * ((n.t - s.t) / (nt - s.t)), court_y + (ny - court_y) * ((n.t - s.t) / (nt - s.t))
  from gaps s join n on s.match_id = n.match_id and n.i > s.i and n.i < s.j where nt - s.t <= 1)"""
_HITS = bd._PEAKS.replace("from bodies", "from (select *, place as player_id, x as court_x, y as court_y from sightings)").replace(f"speed >= {bd.THRESHOLD}", f"speed >= {SWING}")

ORACLE_SQL = {
    "match_analysis": with_tables(
        f""", {_SEEN}, {_FILLED}, {mv.TRACK}, {mv.FRAME_DT}, {_HITS}, seconds as (select match_id, player_id, sum(dt) as s from seen_poses join timed using (match_id, frame_no) group by 1, 2),
        counts as (select match_id, player_id, count(*) as n, avg(speed) as v from peaks group by 1, 2),
        runs as (select match_id, island, count(*) as n from (select *, sum(case when gap > 4 then 1 else 0 end) over (partition by match_id order by t, player_id rows unbounded preceding) as island
          from (select *, t - lag(t) over (partition by match_id order by t, player_id) as gap from peaks)) group by 1, 2 having count(*) >= 2),
        played as (select match_id, count(*) as n_rallies, max(n) as longest from runs group by 1),
        moved as (select match_id, player_id, {mv._MOVES} as distance, coalesce(sum(case when dt > 0 and dt <= 1 then dt end), 0) as tracked from track group by 1, 2)
        select match_id, player_id, {s6('distance')} as distance, {s6('tracked')} as tracked_seconds, {s6('s')} as detected_seconds, {s6('coalesce(v, 0)')} as avg_swing_speed, coalesce(n, 0) as total_shots, n_rallies, longest
        from moved left join seconds using (match_id, player_id) left join counts using (match_id, player_id) left join played using (match_id)""", "frames", "sightings"),
    "analysed_tactics": with_tables(
        f", {_SEEN}, {_FILLED}, {pp._TACTICS} select match_id, team, {s6('paired_seconds')} as paired_seconds, {s6('share_net')} as share_net, {s6('share_mid')} as share_mid, {s6('avg_spacing')} as avg_spacing, net_takings from tactics", "frames", "sightings"),
    "match_takeaways": with_tables(f"{pp._METRICS}{pp._GOALS}, {_PATTERNS}, {_BEST}, {_COVERED}, {_SERVERS}{_REPLAY}, {_FACTS}, {sg._RULES}", *_REVIEWED),
    "match_next_steps": with_tables(
        """select match_id, concat_ws(',', case when r > 0 and t < r then 'points' end, case when me is null then 'players' end, case when not demo then 'coach' end, case when n > 0 then 'highlights' end) as steps
        from (select m.*, (select count(*) from shots s where s.match_id = m.match_id) as n, (select count(*) from rallies r where r.match_id = m.match_id) as r,
          (select count(*) from point_feed f join rallies r using (match_id, rally_idx) where f.match_id = m.match_id) as t from matches m)""", "matches", "shots", "rallies", "point_feed"),
}
