"""Match tables derived from the test data's ``events`` by plain arithmetic.

One SQL text per table, written once in the common part of two dialects, so that
queries and their oracles read the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPARK = {"us": "unix_micros(cast(ts as timestamp))", "div": "div", "int": "int", "hundred": "cast(floor(value * 100) as bigint)"}
DUCK = {"us": "epoch_us(ts)", "div": "//", "int": "integer", "hundred": "cast(floor(value * 100) as bigint)"}


def _tri(n: str, p: int) -> str:
    return f"({p // 2} - abs({p // 2} - (({n}) % {p})))"


TABLES = {
    "shots": f"""
        select user_id as match_id, event_id as seq, ({{us}} - 1704067200000000) / cast(10000000000 as double) as t,
               cast(event_id % 4 as {{int}}) as player_id,
               case event_type when 'click' then 'forehand' when 'view' then 'backhand' when 'purchase' then 'overhead'
                    when 'signup' then 'forehand-volley' else 'backhand-volley' end as shot_type,
               value / cast(20 as double) as swing_speed,
               cast((event_id * 37) % 1000 as double) / 100 as court_x,
               case when event_id % 4 < 2 then 10 + cast((event_id * 91) % 1000 as double) / 100
                    else 10 - cast((event_id * 91) % 1000 as double) / 100 end as court_y,
               event_id % 3 = 0 as confirmed, event_id % 7 = 0 and event_type <> 'purchase' as lob
        from events""",
    "ball_shots": """
        select seq {div} 500 as match_id, seq, (seq % 500) / cast(30 as double) as t, player_id, shot_type, swing_speed, court_x, court_y from ({shots}) as s""",
    "frames": """
        select match_id, frame_no, cast(frame_no as double) / 2 as t
        from (select distinct event_id {div} 400 as match_id, (event_id % 400) {div} 4 as frame_no from events) as f""",
    "poses": f"""
        select match_id, frame_no, cast(frame_no as double) / 2 as t, player_id,
               case when player_id % 2 = 0 then cast(2.5 as double) else cast(7.5 as double) end + value / cast(1000 as double)
                 + case when e % 97 = 0 then 25 else 0 end as court_x,
               case when player_id < 2 then 10 + depth else 10 - depth end as court_y
        from (select *, cast(0.5 as double) + cast(0.45 as double) * {_tri('frame_no * 3 + player_id * 17 + match_id * 5', 40)} as depth
              from (select event_id as e, event_id {{div}} 400 as match_id, (event_id % 400) {{div}} 4 as frame_no,
                           cast(event_id % 4 as {{int}}) as player_id, value from events) as a) as b
        where e % 11 <> 0 and not (player_id = 1 and (e {{div}} 4) % 23 in (5, 6))""",
    "point_feed": """
        select match_id, rally_idx, case when (e * e + v) % 5 < 3 then 'A' else 'B' end as winner,
               case when event_type = 'signup' then case when e % 2 = 0 then 'A' else 'B' end end as server
        from (select event_id {div} 400 as match_id, event_id as e, {hundred} as v, event_type,
                     row_number() over (partition by event_id {div} 400 order by event_id) - 1 as rally_idx from events) as p""",
    "ball_obs": f"""
        select event_id {{div}} 500 as match_id, event_id % 500 as seq, cast(event_id % 500 as double) / 30 as t,
               cast({_tri('2 * event_id', 120)} as double) / 60 as x, cast({_tri('3 * event_id', 40)} as double) / 40 + cast(0.1 as double) as y
        from events where event_id % 13 <> 0""",
    "wrists": f"""
        select event_id {{div}} 500 as match_id, cast(event_id % 500 as double) / 30 as t, cast(event_id % 4 as {{int}}) as player_id,
               cast({_tri('2 * event_id', 120)} as double) / 60 + cast((event_id * 7) % 11 - 5 as double) / 60 as x,
               cast({_tri('3 * event_id', 40)} as double) / 40 + cast(0.1 as double) + cast((event_id * 5) % 9 - 4 as double) / 60 as y,
               cast(event_id % 10 as double) / 10 as visibility
        from events where event_id % 13 <> 5""",
    "bodies": """
        select match_id, frame_no, t, player_id, court_x, court_y, cast(0.2 as double) + player_id / cast(5 as double) + (e % 5) / cast(500 as double) as cx, cast(0.5 as double) + (e % 9) / cast(300 as double) as cy,
               cast((e * 37) % 200 - 100 as double) / 500 + (court_x - floor(court_x)) / 50 as w0x, cast((e * 53) % 240 - 140 as double) / 700 as w0y, case when e % 7 = 0 then cast(0.2 as double) else cast(0.9 as double) end as w0v,
               cast((e * 91) % 220 - 110 as double) / 500 as w1x, cast((e * 29) % 250 - 150 as double) / 700 - (court_x - floor(court_x)) / 30 as w1y, case when e % 6 = 1 then cast(0.3 as double) else cast(0.8 as double) end as w1v
        from (select *, frame_no * 4 + match_id * 400 + player_id as e from ({poses}) as p) as b""",
    "corners": """
        select match_id, flx, fly, case when match_id % 7 = 3 then (flx + nrx) / 2 else frx end as frx, case when match_id % 7 = 3 then (fly + nry) / 2 else fry end as fry, nrx, nry,
               case when match_id % 7 = 3 then flx + (nrx - flx) / 4 else nlx end as nlx, case when match_id % 7 = 3 then fly + (nry - fly) / 4 else nly end as nly
        from (select match_id, cast(0.3 as double) + a / cast(5000 as double) as flx, cast(0.3 as double) - b / cast(6000 as double) as fly, cast(0.7 as double) + b / cast(4500 as double) as frx, cast(0.3 as double) + c / cast(5500 as double) as fry,
                     cast(0.95 as double) - c / cast(4000 as double) as nrx, cast(0.95 as double) - d / cast(7000 as double) as nry, cast(0.05 as double) + d / cast(6000 as double) as nlx, cast(0.95 as double) - a / cast(6500 as double) as nly
              from (select event_id {div} 400 as match_id, max(case when event_id % 4 = 0 then value else 0 end) as a, max(case when event_id % 4 = 1 then value else 0 end) as b,
                           max(case when event_id % 4 = 2 then value else 0 end) as c, max(case when event_id % 4 = 3 then value else 0 end) as d from events group by event_id {div} 400) as m) as q""",
    "heard": """
        select event_id {div} 400 as match_id, cast((event_id % 400) {div} 4 as double) / 2 + cast(event_id % 3 as double) / 10 as t
        from events where event_id % 9 = 4""",
    "pixels": """
        select match_id, frame_no, y, x, case when ball then 200 + e % 9 when court then 30 + e % 11 else 60 + (x * 3 + y * 5 + frame_no * 23) % 60 end as r,
               case when ball then 220 - e % 7 when court then 90 + e % 13 else 62 + (x * 3 + y * 5 + frame_no * 23) % 60 end as g,
               case when ball then 60 + e % 5 when court then 190 + e % 17 else 58 + (x * 3 + y * 5 + frame_no * 23) % 60 end as b
        from (select *, (x + frame_no * 3) % 20 in (4, 5) and y in (3, 4) or e % 83 = 0 as ball, y >= 8 and x >= 3 and x <= 16 and e % 19 <> 3 as court
              from (select event_id as e, event_id {div} 4000 as match_id, (event_id {div} 400) % 10 as frame_no, (event_id % 400) {div} 20 as y, event_id % 20 as x from events) as p) as q""",
    "known_ball": """
        select event_id {div} 100 as match_id, cast(event_id % 100 as double) / 30 as t, case when event_id % 5 = 0 then cast(0.9 as double) else cast(0.05 as double) + cast(0.008 as double) * (event_id % 100) end as x,
               case when event_id % 5 = 0 then cast(0.95 as double) else cast(0.4 as double) + cast(0.001 as double) * (event_id % 100) end as y, event_id % 5 <> 0 as moving from events""",
    "known_players": """
        select event_id {div} 400 as match_id, cast((event_id % 400) {div} 4 as double) / 2 as t, cast(event_id % 4 as {int}) as seq, place,
               case when place % 2 = 0 then cast(2.5 as double) else cast(7.5 as double) end + value / cast(500 as double) as x, case when place < 2 then cast(15 as double) else cast(5 as double) end + value / cast(400 as double) as y
        from (select *, cast((event_id % 4 + ((event_id % 400) {div} 4) * 3) % 4 as {int}) as place from events) as p""",
    "sightings": """
        select match_id, frame_no, t, seq, place, x, y, cast(0.2 as double) + place / cast(5 as double) + (e % 5) / cast(500 as double) as cx, cast(0.5 as double) + (e % 9) / cast(300 as double) as cy,
               cast((e * 37) % 200 - 100 as double) / 500 as w0x, cast((e * 53) % 240 - 140 as double) / 700 as w0y, case when e % 7 = 0 then cast(0.2 as double) else cast(0.9 as double) end as w0v,
               cast((e * 91) % 220 - 110 as double) / 500 as w1x, cast((e * 29) % 250 - 150 as double) / 700 as w1y, case when e % 6 = 1 then cast(0.3 as double) else cast(0.8 as double) end as w1v
        from (select *, frame_no * 4 + match_id * 400 + seq as e from (select *, cast(t * 2 as bigint) as frame_no from ({known_players}) as k) as f) as p
        where frame_no = 0 or e % 11 <> 5""",
    "audio_env": """
        select event_id {div} 1000 as match_id, event_id % 1000 as hop, value as env from events""",
    "matches": """
        select user_id as match_id, min({us}) {div} 1000 as created_at,
               case when user_id % 9 <> 0 then cast(user_id % 4 as {int}) end as me, user_id % 17 = 5 as demo
        from events group by user_id""",
    "names": """
        select match_id, slot, concat('P', cast((match_id + slot) % 7 as varchar(9))) as name
        from (select distinct user_id as match_id, cast(event_id % 4 as {int}) as slot from events) as n""",
    "rallies": """
        select match_id, cast(row_number() over (partition by match_id order by island) - 1 as bigint) as rally_idx,
               case when first_t - cast(0.5 as double) > 0 then first_t - cast(0.5 as double) else cast(0 as double) end as start_t, last_t + 1 as end_t, n_shots
        from (select match_id, island, min(t) as first_t, max(t) as last_t, count(*) as n_shots
              from (select *, sum(case when gap > 4 then 1 else 0 end) over (partition by match_id order by t, seq rows unbounded preceding) as island
                    from (select *, t - lag(t) over (partition by match_id order by t, seq) as gap from ({shots}) as s) as g) as i
              group by match_id, island having count(*) >= 2) as r""",
    "point_tags": """
        select match_id, rally_idx, case when (rally_idx * rally_idx + 3 * match_id) % 5 < 3 then 'A' else 'B' end as winner,
               case rally_idx % 3 when 0 then 'winner' when 1 then 'forced' else 'unforced' end as ending,
               case when (7 * rally_idx + match_id) % 5 < 4 then cast((7 * rally_idx + match_id) % 5 as {int}) end as player
        from ({rallies}) as r""",
}


def sql(table: str, dialect: dict[str, str]) -> str:
    """The SELECT of a table in a dialect, tables that it needs included."""
    text = TABLES[table]
    inner = {t: sql(t, dialect) for t in TABLES if "{" + t + "}" in text}
    return text.format(**dialect, **inner)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table as a DataFrame; ``events`` itself is only read for the columns it needs."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.sql(sql(name, SPARK).replace("from events", "from {events}"), events=events)


def with_tables(query: str, *names: str) -> str:
    """A DuckDB query over derived tables of these names; a text that starts with a comma goes on with tables of its own."""
    parts = ", ".join(f"{n} as materialized ({sql(n, DUCK)})" for n in names)
    return f"with {parts} {query}"
