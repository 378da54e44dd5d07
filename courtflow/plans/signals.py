"""Queries on the ball, the soundtrack, rules and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtflow.operators import audio as au
from courtflow.operators import ball as bl
from courtflow.operators import export as ex
from courtflow.operators import movement as m
from courtflow.operators import rules as ru
from courtflow.operators import tactics as tc
from courtflow.operators import timeseries as ts
from courtflow.plans.courts import SOUND, courts
from courtflow.plans.points import _TACTICS
from courtflow.plans.shared import kept, query, r6, s6
from courtflow.sources.surrogate import with_tables


@query("ball_obs")
def clean_track(obs):
    return bl.clean_track(obs.withColumn("x", F.when(F.col("seq") % 41 == 0, F.col("x") + 0.5).otherwise(F.col("x")))).select("match_id", "seq", r6("t"))


@query("ball_obs")
def turn_points(obs):
    return bl.turns(obs).select("match_id", "seq", r6("vx0"), r6("vy0"), r6("vx1"), r6("vy1"))


@query("ball_obs")
def ball_events(obs):
    return bl.events(bl.turns(obs)).select("match_id", "seq", r6("t"), "kind")


@query("ball_obs", "wrists")
def wrist_events(obs, wrists):
    found = bl.events(bl.nearest_wrists(bl.turns(obs), wrists))
    return found.select("match_id", "seq", r6("t"), "kind", "player_id")


@query("ball_obs", "wrists", "ball_shots")
def hit_confirm(obs, wrists, shots):
    found = kept(bl.events(bl.nearest_wrists(bl.turns(obs), wrists)), "ball-events")  # flights and shots both go by the events
    done = bl.annotated_shots(shots, found, obs, 0.8, 0.2)
    return done.select("match_id", "seq", F.col("confirmed").cast("int").alias("confirmed"), F.col("lob").cast("int").alias("lob"))


@query("ball_obs")
def ball_coverage(obs):
    return bl.coverage(obs).select("match_id", r6("covered"))


@query("ball_obs")
def ball_trail(obs):
    return bl.trail(obs, 5.0).select("match_id", "seq", r6("alpha"))


@query("audio_env")
def running_median(env):
    return ts.running_median(env, ["match_id"], ["hop"], "env").select("match_id", "hop", r6("median"))


@query("audio_env")
def onset_pops(env):
    return au.pops(env).select("match_id", r6("t"), r6("ratio"))


@query("audio_env")
def pop_usability(env):
    seconds = env.groupBy("match_id").agg((F.max("hop") * 0.01).alias("seconds"))
    return au.usable(au.pops(env), seconds).select("match_id", "n", r6("rate"), F.col("usable").cast("int").alias("usable"))


@query("audio_env")
def sound_envelope(env):
    samples = env.select("match_id", F.col("hop").alias("i"), F.col("env").alias("v"))
    return au.envelope(samples, 800).select("match_id", "hop", r6("env"))


@query("audio_env")
def chunked_envelope(env):
    """The envelope of two channels that come in chunks of 30 samples, the first of a match shorter; hops of 8 cross them."""
    channel = F.array_sort(F.collect_list(F.struct("hop", "env")))["env"]
    parts = env.groupBy("match_id", F.floor((F.col("hop") + 17) / 30).alias("part")).agg(F.min("hop").alias("start"), channel.alias("a"))
    chunks = parts.select("match_id", "start", F.array("a", F.transform("a", lambda v: v / 2 + 1)).alias("channels"))
    return au.chunk_envelope(au.mono_chunks(chunks), 800).select("match_id", "hop", r6("env"))


@query("shots")
def clip_budget(shots):
    return ex.within_budget(ex.clips(shots), 60.0).select("match_id", "seq", r6("start_t"), r6("end_t"), "label", r6("total"))


@query("shots")
def key_shots(shots):
    return ex.key_shots(shots)


@query("shots")
def thinned_shots(shots):
    return ex.thinned(shots, ["t", "seq"], 20).select("match_id", "seq")


@query("frames", "poses")
def pair_insights(frames, poses):
    out = ru.pair_insights(tc.team_tactics(tc.paired_frames(frames, poses)))
    return out.select("match_id", "team", F.array_join("insights", "; ").alias("insights"))


_GRADED = ("frames", "poses", "corners", "ball_obs", "shots")


def _graded(frames, poses, corners, obs, shots):
    """Reliability of each match that has poses: its players' and ball's share of the time, whether its corners are sound, its confirmed shots."""
    length = frames.groupBy("match_id").agg(F.greatest(F.max("t"), F.lit(1e-3)).alias("seconds"))
    share = lambda i: F.least(F.lit(1.0), F.coalesce(F.max(F.when(F.col("player_id") == i, F.col("detected_seconds"))), F.lit(0.0)) / F.first("seconds")).alias(f"share{i}")
    rows = m.detected_seconds(frames, poses).join(length, "match_id").groupBy("match_id").agg(*[share(i) for i in range(4)], F.first("seconds").alias("seconds"))
    sound = courts(corners).select("match_id", F.col("to_court").isNotNull().alias("calibrated"))
    sure = shots.groupBy("match_id").agg(F.avg(F.col("confirmed").cast("double")).alias("confirmed"))
    for more in (sound, bl.coverage(obs), sure):
        rows = rows.join(more, "match_id", "left")
    return ru.reliability(rows.withColumns({"calibrated": F.coalesce("calibrated", F.lit(False)), "ball": F.when(F.col("covered").isNotNull(), F.least(F.lit(1.0), F.col("covered") / F.col("seconds")))}))


@query(*_GRADED)
def coverage(frames, poses, corners, obs, shots):
    return _graded(frames, poses, corners, obs, shots).select("match_id", r6("mean_share"), r6("min_share"), "grade", F.array_join("tips", ",").alias("tips"))


def _facts(shots):
    """One row of made-up facts for each match, by arithmetic on its number."""
    k = F.col("match_id")
    n = lambda mod, add=0: ((k * 7 + add) % mod).cast("double")
    return shots.select("match_id").distinct().withColumns({
        "me": F.when(k % 5 > 0, k % 4), "demo": k % 11 == 0, "tagged": (k % 9).cast("int"), "paired_seconds": n(60), "share_net": n(10, 3) / 15, "share_split": n(8, 1) / 30,
        "rate_gap": F.when(k % 3 == 0, F.lit(0.3)), "goals_checked": (k % 4).cast("int"), "goals_missed": F.least(k % 4, k % 3).cast("int"), "chances": (k % 6).cast("int"), "breaks": (k % 2).cast("int"),
        "unforced": (k % 7).cast("int"), "winners": (k % 5).cast("int"), "grade": F.when(k % 3 == 0, "good").when(k % 3 == 1, "fair").otherwise("poor"),
    })


@query("shots")
def takeaways(shots):
    return ru.takeaways(_facts(shots)).select("match_id", "rule", "tone", "section", r6("priority"), "place")


@query("shots")
def next_steps(shots):
    k = F.col("match_id")
    facts = shots.groupBy("match_id").agg(F.count("*").alias("n_shots")).withColumns({"n_rallies": k % 4, "tagged": k % 3, "me": F.when(k % 5 > 0, k % 4), "has_report": k % 2 == 0})
    return ru.next_steps(facts).select("match_id", F.array_join("steps", ",").alias("steps"))


def trimmed_turns(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role")
    return ex.trimmed_turns(c, 4)


_names = (
    "clean_track turn_points ball_events wrist_events hit_confirm ball_coverage ball_trail running_median onset_pops pop_usability sound_envelope chunked_envelope clip_budget key_shots thinned_shots pair_insights "
    "coverage takeaways next_steps trimmed_turns"
)
QUERIES = {n: globals()[n] for n in _names.split()}

_TURNS = """turned as (select *, (x - ax) / (t - pt) as vx0, (y - ay) / (t - pt) as vy0, (cx - x) / (ct - t) as vx1, (cy - y) / (ct - t) as vy1 from (
  select *, lag(t) over w as pt, lag(x) over w as ax, lag(y) over w as ay, lead(t) over w as ct, lead(x) over w as cx, lead(y) over w as cy from ball_obs window w as (partition by match_id order by t, seq))
  where t - pt <= 0.25 and ct - t <= 0.25),
turns as (select * from turned where sqrt(vx0 * vx0 + vy0 * vy0) >= 0.05 and sqrt(vx1 * vx1 + vy1 * vy1) >= 0.05
  and (vx0 * vx1 + vy0 * vy1) / (sqrt(vx0 * vx0 + vy0 * vy0) * sqrt(vx1 * vx1 + vy1 * vy1)) <= 0.5)"""
_EVENTS = f"""{_TURNS}, times as (with recursive k as (select match_id, min(t) as t from turns group by 1 union all
  select k.match_id, (select min(u.t) from turns u where u.match_id = k.match_id and u.t > k.t and not (u.t - k.t < 0.12)) from k where k.t is not null) select * from k where t is not null),
events as (select u.*, case when vy0 > 0 and vy1 < 0 then 'bounce' else 'wall' end as kind from turns u join times using (match_id, t))"""
_WRISTS = f"""{_EVENTS}, wt as (select distinct match_id, t from wrists),
  wb as (select e.*, f.t as bt from events e asof left join wt f on e.match_id = f.match_id and e.t >= f.t),
  wa as (select wb.*, f.t as nt from wb asof left join wt f on wb.match_id = f.match_id and wb.t <= f.t),
  beside as (select *, case when bt is not null and (nt is null or t - bt < nt - t) then bt else nt end as near_t from wa),
  best as (select a.match_id, a.seq, min({{'d': sqrt(power(a.x - w.x, 2) + power(a.y - w.y, 2)), 'p': w.player_id}}) as w from beside a join wrists w on w.match_id = a.match_id and w.t = a.near_t and w.visibility > 0.3 group by 1, 2),
  seen as (select e.*, case when w.d < 0.06 then 'hit' else kind end as near_kind, case when w.d < 0.06 then w.p end as player_id from events e left join best using (match_id, seq))"""
_RATIO = """medians as (select *, list_sort(list(env) over (partition by match_id order by hop rows between 25 preceding and 25 following)) as l from audio_env),
ratios as (select match_id, hop, env, l[len(l) // 2 + 1] as median, env / (l[len(l) // 2 + 1] + 0.000001) as ratio from medians),
peaks as (select match_id, hop * 0.01::double as t, ratio as v, row_number() over (partition by match_id order by hop) as i from (select *, lag(ratio) over w as a, lead(ratio) over w as c from ratios window w as (partition by match_id order by hop))
  where ratio >= 3 and ratio >= a and ratio >= c),
folded as (with recursive k as (
    select match_id, i, t, v, false as closed, null::double as ot, null::double as ov from peaks where i = 1
    union all
    select n.match_id, n.i, case when n.t - k.t < 0.15 and n.v <= k.v then k.t else n.t end, case when n.t - k.t < 0.15 and n.v <= k.v then k.v else n.v end,
           n.t - k.t >= 0.15, case when n.t - k.t >= 0.15 then k.t end, case when n.t - k.t >= 0.15 then k.v end
    from k join peaks n on n.match_id = k.match_id and n.i = k.i + 1) select * from k),
pops as (select match_id, ot as t, ov as ratio from folded where closed union all select match_id, arg_max(t, i), arg_max(v, i) from folded group by 1)"""
_FACTS = """facts as (select match_id as k, case when match_id % 5 > 0 then match_id % 4 end as me, match_id % 11 = 0 as demo, match_id % 9 as tagged, (match_id * 7) % 60 as paired, ((match_id * 7 + 3) % 10) / 15.0::double as net,
  ((match_id * 7 + 1) % 8) / 30.0::double as split, match_id % 3 = 0 as gap, match_id % 4 as checked, least(match_id % 4, match_id % 3) as missed, match_id % 6 as chances, match_id % 2 as breaks, match_id % 7 as unforced,
  match_id % 5 as winners, case match_id % 3 when 0 then 'good' when 1 then 'fair' else 'poor' end as grade from (select distinct match_id from shots))"""
#: The rules over facts, and the first four of each match.
_RULES = f"""r(k, pos, rule, tone, section, priority) as (
          select k, 0, 'positions', 'warn', 'points', 100::double from facts where tagged >= 4 and gap
          union all select k, 1, 'split', 'warn', 'pair', 80 + 40 * split from facts where paired >= 20 and split >= 0.15
          union all select k, 2, 'net control', 'good', 'pair', 60 from facts where paired >= 20 and split < 0.15 and net >= 0.35
          union all select k, 3, 'goals met', 'good', 'goals', 70 from facts where me is not null and checked > 0 and missed = 0
          union all select k, 4, 'goals missed', 'warn', 'goals', 75 from facts where me is not null and missed > 0
          union all select k, 5, 'break points', 'warn', 'points', 65 from facts where tagged > 0 and chances >= 3 and breaks / chances < 0.3
          union all select k, 6, 'unforced errors', 'warn', 'points', 62 from facts where me is not null and tagged > 0 and unforced >= 3 and unforced > winners
          union all select k, 7, 'reliability', 'info', 'reliability', case when grade = 'poor' then 110 else 50 end from facts where not demo and grade <> 'good')
        select * from (select k as match_id, rule, tone, section, {s6('priority')} as priority, row_number() over (partition by k order by r.priority desc, pos) as place from r) where place <= 4"""
_DET = """timed as (select *, coalesce(least(1, greatest(0, lead(t) over (partition by match_id order by t, frame_no) - t)), 0) as dt from frames),
det as (select match_id, player_id, sum(dt) as d from poses join timed using (match_id, frame_no) group by 1, 2),
cov as (select match_id, any_value(s) as s, """ + ", ".join(f"least(1, coalesce(max(case when player_id = {i} then d end), 0) / any_value(s)) as s{i}" for i in range(4)) + """ from det join (select match_id, greatest(max(t), 0.001) as s from frames group by 1) using (match_id) group by 1),
cal_of as (select match_id, """ + SOUND + """ as cal from corners),
ball_of as (select match_id, coalesce(sum(case when dt > 0 and dt < 0.2 then dt end), 0) as covered from (select match_id, t - lag(t) over (partition by match_id order by t, seq) as dt from ball_obs) group by 1),
sure_of as (select match_id, avg(case when confirmed then 1::double else 0 end) as confirmed from shots group by 1),
facts as (select cov.*, coalesce(cal, false) as cal, case when covered is not null then least(1, covered / s) end as ball, confirmed, (s0 + s1 + s2 + s3) / 4 as mean, least(s0, s1, s2, s3) as low
  from cov left join cal_of on cal_of.match_id = cov.match_id left join ball_of on ball_of.match_id = cov.match_id left join sure_of on sure_of.match_id = cov.match_id)"""

ORACLE_SQL = {
    "clean_track": with_tables(
        f""", o as (select match_id, seq, t, case when seq % 41 = 0 then x + 0.5::double else x end as x, y from ball_obs),
        n as (select *, lag(t) over w as pt, lag(x) over w as ax, lag(y) over w as ay, lead(t) over w as ct, lead(x) over w as cx, lead(y) over w as cy from o window w as (partition by match_id order by t, seq))
        select match_id, seq, {s6('t')} as t from n where (t - pt > 0 and t - pt < 0.25 and sqrt(power(ax - x, 2) + power(ay - y, 2)) < 0.05 + 1.5 * (t - pt)) or (ct - t > 0 and ct - t < 0.25 and sqrt(power(cx - x, 2) + power(cy - y, 2)) < 0.05 + 1.5 * (ct - t))""", "ball_obs"),
    "turn_points": with_tables(f", {_TURNS} select match_id, seq, {s6('vx0')} as vx0, {s6('vy0')} as vy0, {s6('vx1')} as vx1, {s6('vy1')} as vy1 from turns", "ball_obs"),
    "ball_events": with_tables(f", {_EVENTS} select match_id, seq, {s6('t')} as t, kind from events", "ball_obs"),
    "hit_confirm": with_tables(
        f""", {_WRISTS}, own as (select * from ball_shots),
        hits as (select match_id, seq as hseq, t as ht, player_id, least(coalesce((select min(e.t) from events e where e.match_id = h.match_id and e.t > h.t + 0.05), 1e9), h.t + 2.5) as until from seen h where near_kind = 'hit'),
        flown as (select h.match_id, hseq, count(*) as n, min(y) as apex from hits h join ball_obs o on o.match_id = h.match_id and o.t > ht and o.t <= until group by 1, 2),
        near as (select o.match_id, o.seq, h.hseq, row_number() over (partition by o.match_id, o.seq order by ht, hseq) as k from own o join hits h on h.match_id = o.match_id and h.player_id = o.player_id and abs(ht - o.t) < 0.4)
        select o.match_id, o.seq, case when k is null then 0 else 1 end as confirmed, case when f.n >= 3 and f.apex < 0.8 - 0.5 * 0.2 and shot_type <> 'overhead' then 1 else 0 end as lob
        from own o left join near on near.match_id = o.match_id and near.seq = o.seq and k = 1 left join flown f on f.match_id = near.match_id and f.hseq = near.hseq""", "ball_obs", "wrists", "ball_shots"),
    "wrist_events": with_tables(f", {_WRISTS} select match_id, seq, {s6('t')} as t, near_kind as kind, player_id from seen", "ball_obs", "wrists"),
    "ball_coverage": with_tables(f"select match_id, {s6('coalesce(sum(case when dt > 0 and dt < 0.2 then dt end), 0)')} as covered from (select match_id, t - lag(t) over (partition by match_id order by t, seq) as dt from ball_obs) group by 1", "ball_obs"),
    "ball_trail": with_tables(f"select match_id, seq, {s6('1 - (5 - t) / 0.5')} as alpha from ball_obs where t between 4.5 and 5", "ball_obs"),
    "running_median": with_tables(f", {_RATIO} select match_id, hop, {s6('median')} as median from ratios", "audio_env"),
    "onset_pops": with_tables(f", {_RATIO} select match_id, {s6('t')} as t, {s6('ratio')} as ratio from pops", "audio_env"),
    "pop_usability": with_tables(
        f""", {_RATIO}, g as (select match_id, t - lag(t) over (partition by match_id order by t) as gap from pops), st as (select match_id, count(*) as n, avg(gap) as mean, stddev_pop(gap) as sd from g group by 1)
        select e.match_id, coalesce(n, 0) as n, {s6('coalesce(n, 0) / greatest(seconds, 1)')} as rate, case when n >= 4 and n / greatest(seconds, 1) between 0.15 and 3 and sd / mean >= 0.15 then 1 else 0 end as usable
        from (select match_id, max(hop) * 0.01::double as seconds from audio_env group by 1) e left join st using (match_id)""", "audio_env"),
    "sound_envelope": with_tables(
        f"""select match_id, hop // 8 as hop, {s6('sqrt(sum(d * d) / 8)')} as env from (select match_id, hop, lead(env, 2) over w - 2 * lead(env) over w + env as d from audio_env window w as (partition by match_id order by hop)) group by 1, hop // 8 having count(d) = 8""", "audio_env"),
    "chunked_envelope": with_tables(
        f"""select match_id, hop // 8 as hop, {s6('sqrt(sum(d * d) / 8)')} as env from (select match_id, hop, lead(v, 2) over w - 2 * lead(v) over w + v as d from (select match_id, hop, (env + env / 2 + 1) / 2 as v from audio_env) window w as (partition by match_id order by hop)) group by 1, hop // 8 having count(d) = 8""", "audio_env"),
    "clip_budget": with_tables(
        f""", c as (select match_id, seq, greatest(0, t - 1.5) as start_t, t + 1.2 as end_t, 'player ' || player_id || ' ' || shot_type as label from shots),
        r as (select *, sum(greatest(0, end_t - start_t)) over w as total, row_number() over w as k from c window w as (partition by match_id order by start_t, seq rows unbounded preceding))
        select match_id, seq, {s6('start_t')} as start_t, {s6('end_t')} as end_t, label, {s6('total')} as total from r where total <= 60 or k = 1""", "shots"),
    "key_shots": with_tables(
        """, r as (select match_id, seq, player_id || ':' || shot_type as kind, swing_speed, count(*) over (partition by match_id) as n, row_number() over (partition by match_id order by t, seq) - 1 as pos from shots),
        b as (select r.*, x.i as b from r join (values (0), (1), (2), (3), (4), (5)) as x(i) on pos >= floor(x.i * (n / 6.0::double)) and pos < floor((x.i + 1) * (n / 6.0::double)) where n > 6),
        packed as (select match_id, b, list({'seq': seq, 'kind': kind, 'v': swing_speed} order by pos) as l from b group by 1, 2),
        folded as (with recursive k as (select match_id, -1 as b, []::varchar[] as seen, null::bigint as seq from packed where b = 0
          union all
          select match_id, b, list_append(seen, pick.kind), pick.seq from (
            select k.match_id, p.b, k.seen, coalesce(list_filter(p.l, lambda x: not list_contains(k.seen, x.kind))[1], list_reduce(p.l, lambda m, x: case when x.v > m.v then x else m end)) as pick
            from k join packed p on p.match_id = k.match_id and p.b = k.b + 1)) select * from k)
        select match_id, seq from folded where seq is not null union all select match_id, seq from r where n <= 6""", "shots"),
    "thinned_shots": with_tables(
        """, r as (select match_id, seq, count(*) over (partition by match_id) as n, row_number() over (partition by match_id order by t, seq) - 1 as pos from shots)
        select match_id, seq from r where pos % (case when n <= 20 then 1 when n <= 40 then 2 when n <= 80 then 4 when n <= 160 then 8 when n <= 320 then 16 when n <= 640 then 32 when n <= 1280 then 64 when n <= 2560 then 128 else 256 end) = 0""", "shots"),
    "pair_insights": with_tables(
        f""", {_TACTICS}, told as (select match_id, team, paired_seconds, concat_ws('; ', case when share_net >= 0.35 then 'good: together at the net ' || floor(share_net * 100 + 0.5)::bigint || '%' when share_net < 0.2 then 'warn: together at the net only ' || floor(share_net * 100 + 0.5)::bigint || '%' end,
          case when share_split >= 0.15 then 'warn: split ' || floor(share_split * 100 + 0.5)::bigint || '%' end, case when avg_depth_gap > 3 then 'warn: far apart in depth' end) as x from tactics)
        select match_id, team, case when paired_seconds < 20 then 'warn: too little footage' when x = '' then 'good: balanced' else x end as insights from told""", "frames", "poses"),
    "coverage": with_tables(
        f""", {_DET} select match_id, {s6('mean')} as mean_share, {s6('low')} as min_share, case when mean >= 0.75 and low >= 0.5 and cal then 'good' when mean >= 0.45 then 'fair' else 'poor' end as grade,
        concat_ws(',', case when low < 0.5 then 'lost' end, case when (s2 + s3) / 2 < (s0 + s1) / 2 * 0.6 then 'far' end, case when not cal then 'corners' end, case when ball < 0.15 then 'ball' end, case when ball >= 0.15 and coalesce(confirmed, 1) < 0.3 then 'confirm' end) as tips from facts""", *_GRADED),
    "takeaways": with_tables(
        f", {_FACTS}, {_RULES}", "shots"),
    "next_steps": with_tables(
        """select match_id, concat_ws(',', case when match_id % 4 > 0 and match_id % 3 < match_id % 4 then 'points' end, case when match_id % 5 = 0 then 'players' end, case when match_id % 2 > 0 then 'coach' end, 'highlights') as steps
        from (select distinct match_id from shots)""", "shots"),
    "trimmed_turns": """with r as (select conv_id, turn, role, row_number() over (partition by conv_id order by turn desc) as k from conversations), l as (select * from r where k <= 4),
        s as (select *, min(case when role = 'user' then turn end) over (partition by conv_id) as f from l) select conv_id, turn, role from s where turn >= f""",
}
