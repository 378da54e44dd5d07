"""Queries with keyed state: trackers, and rallies as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtflow.functions.geometry import on_court
from courtflow.operators import shots as sh
from courtflow.operators import tracking as tr
from courtflow.plans import bodies as bo
from courtflow.plans.pictures import HIGH, WIDE
from courtflow.plans.shared import query, r6, s6, shared_folder
from courtflow.sources.store import Checkpoint, MatchStore, pack_frames, unpack_frames
from courtflow.sources.surrogate import table, with_tables
from courtflow.streaming import live


@query("poses")
def identity_tracks(poses):
    """How often the tracker's slots agree with the players that detections came from."""
    seen = poses.where(on_court(F.col("court_x"), F.col("court_y"))).select("match_id", "t", ((F.col("player_id") * 7 + F.col("frame_no")) % 4).cast("int").alias("seq"), F.col("court_x").alias("x"), F.col("court_y").alias("y"))
    return tr.identified(seen).groupBy("match_id", "player_id").agg(F.count("*").alias("n"), r6(F.avg("x"), "x"))


@query("ball_obs")
def ball_tracks(obs):
    return tr.ball_track(obs.select("match_id", "t", "x", "y")).groupBy("match_id").agg(F.count("*").alias("n"), r6(F.min("t"), "first"), r6(F.max("t"), "last"))


GAP, LATE = "40000 seconds", "1 hour"


def streamed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of events per user without a pause over 40,000 s, by a stream that appends each once its end has passed.

    The stream reads the table and stops; started again from its checkpoint it meets one
    row of nobody after all others, which lets the watermark pass the sessions that were
    still open. What is closed leaves the state.
    """
    path = f"{shared_folder(spark)}/sessions-{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    last = events.select(F.lit(None).cast("long").alias("match_id"), (F.max(F.col("ts").cast("timestamp")) + F.expr(f"interval {GAP}") * 2 + F.expr(f"interval {LATE}") * 2).alias("ts"))
    last.where("false").write.parquet(f"{path}/end")
    exactly = f"{sf_dir}/events.parque[t]"  # a stream takes a folder or a pattern; this one fits the table alone, file or folder
    for _ in range(2):
        source = spark.readStream.schema(events.schema).parquet(exactly).select(F.col("user_id").alias("match_id"), F.col("ts").cast("timestamp").alias("ts"))
        end = spark.readStream.schema(last.schema).parquet(f"{path}/end")
        live.append_parquet(live.rallies(source.unionByName(end), GAP, LATE), f"{path}/out", f"{path}/state").awaitTermination()
        last.write.mode("append").parquet(f"{path}/end")
    found = spark.read.schema("match_id long, start_ts timestamp, last_ts timestamp, n_shots long").parquet(f"{path}/out")
    return found.select("match_id", "n_shots", F.unix_micros("start_ts").alias("start_us"), F.unix_micros("last_ts").alias("last_us"))


@query("known_players")
def known_identities(seen):
    """Four players who keep their places, listed in another order in each frame: the tracker must tell who is who."""
    found = tr.identified(seen.select("match_id", "t", "seq", "x", "y"))
    return found.groupBy("match_id", "player_id").agg(F.count("*").alias("n"), r6(F.sum("x"), "x"), r6(F.sum("y"), "y"))


def _by_player(found: DataFrame) -> DataFrame:
    return found.groupBy("match_id", "player_id").agg(F.count("*").alias("n"), r6(F.sum("x"), "x"), r6(F.sum("y"), "y"))


#: A player is hidden in every fifth frame, each in turn, and the picture cuts to players five metres to the right at this time.
HIDDEN, CUT_T, MOVED = "cast(t * 2 as int) % 5 = 2 and place = cast(t * 2 as int) div 5 % 4", 20.0, 5.0


@query("known_players")
def focused_identities(seen):
    """Players who are hidden now and then and found by a closer look, and a cut: the tracker goes by detections, looks and the cut.

    Before the place that is right a look offers a body that is found already and, to no
    avail, one across the net.
    """
    x = F.when(F.col("t") >= CUT_T, F.col("x") + MOVED).otherwise(F.col("x"))
    places = seen.withColumn("x", x)
    hidden = places.where(HIDDEN)
    # after the cut each side's right player is where the left one is looked for
    slot = F.when(F.col("t") >= CUT_T, F.col("place").bitwiseXOR(F.lit(1))).otherwise(F.col("place"))
    partner = places.withColumn("place", F.col("place").bitwiseXOR(F.lit(1))).select("match_id", "t", "place", F.col("seq").alias("partner"))
    looks = hidden.join(partner, ["match_id", "t", "place"], "left").select("match_id", "t", slot.alias("slot"), "x", "y", "partner")
    body, across, right = (
        looks.withColumns({"seq": F.lit(10), "same": F.array("partner")}),
        looks.withColumns({"seq": F.lit(12), "same": F.lit(None).cast("array<int>"), "y": 20 - F.col("y")}),
        looks.withColumns({"seq": F.lit(11), "same": F.lit(None).cast("array<int>")}),
    )
    cuts = seen.where(F.col("t") == CUT_T).select("match_id", "t").distinct()
    events = tr.sightings(places.where(f"not ({HIDDEN})"), body.unionByName(right).unionByName(across), cuts)
    return _by_player(tr.followed(events))


def resumed_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tracker's first half of each match saved, the rest streamed from the places saved last, and both joined without a frame twice."""
    path = f"{shared_folder(spark)}/resumed-{uuid.uuid4().hex}"
    events = tr.sightings(table(spark, sf_dir, "known_players").select("match_id", "t", "seq", "x", "y"))
    tr.followed(events.where("t < 25")).write.parquet(f"{path}/saved")
    events.where("t >= 24").write.parquet(f"{path}/rest")
    saved = spark.read.parquet(f"{path}/saved")
    stream = spark.readStream.schema(events.schema).parquet(f"{path}/rest")
    live.append_parquet(live.followed(stream, tr.last_places(saved)), f"{path}/out", f"{path}/state").awaitTermination()
    return _by_player(tr.joined_parts(saved, spark.read.schema(saved.schema).parquet(f"{path}/out")))


@query("known_ball")
def resumed_ball(seen):
    """A ball track saved half-way and one that begins a little earlier, joined: no observation comes twice."""
    track = lambda df: tr.ball_track(df.select("match_id", "t", "x", "y")).drop("seq")
    whole = tr.joined_parts(track(seen.where("t < 1.6")), track(seen.where("t >= 1.3")))
    return whole.groupBy("match_id").agg(F.count("*").alias("n"), F.count_distinct("t").alias("times"), r6(F.min("t"), "first"), r6(F.max("t"), "last"), r6(F.sum("x"), "x"))


@query("pixels")
def picture_cuts(pixels):
    """Whole pictures whose red and green differ much from the one before."""
    ordered = F.array_sort(F.collect_list(F.struct("y", "x", "r", "g")))
    thumbs = pixels.groupBy("match_id", "frame_no").agg(F.flatten(F.transform(ordered, lambda p: F.array(p["r"], p["g"]))).alias("pixels"))
    return sh.scene_cuts(thumbs.where(F.size("pixels") == 2 * WIDE * HIGH))


@query("known_ball")
def known_ball(seen):
    """One ball that flies and a spot that stays: the track is the flight."""
    return tr.ball_track(seen.select("match_id", "t", "x", "y")).groupBy("match_id").agg(F.count("*").alias("n"), r6(F.min("t"), "first"), r6(F.max("t"), "last"), r6(F.sum("x"), "x"), F.max("seq").alias("last_seq"))


def saved_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches saved, saved again in part with other values, read back newest first and slim."""
    store = MatchStore(spark, f"{shared_folder(spark)}/matches-{uuid.uuid4().hex}", 16)
    rows = table(spark, sf_dir, "matches").select("created_at", "me", F.lit("first").alias("title"), F.array(F.lit(1.0)).alias("frames"), "match_id")
    store.save(rows)
    store.save(rows.where("me is not null").withColumn("title", F.concat(F.lit("again "), "me")))
    return store.list(rows.drop("frames").schema).select("match_id", "created_at", "title")


def joined_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames saved in four chunks and joined again; a job with a chunk missing gives none."""
    chunks = Checkpoint(spark, f"{shared_folder(spark)}/chunks-{uuid.uuid4().hex}")
    frames = table(spark, sf_dir, "frames")
    quarter = F.floor(F.col("t") / 12.5)
    for i in range(4):
        chunks.append("whole", i, frames.where(quarter == i))
        if i != 2:
            chunks.append("torn", i, frames.where(quarter == i))
    whole, torn = chunks.load("whole", 4), chunks.load("torn", 4)
    return whole.groupBy("match_id").agg(F.count("*").alias("n"), r6(F.max("t"), "last"), F.lit(torn is None).cast("int").alias("torn"))


def packed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames and poses packed into flat arrays, saved in chunks, joined and unpacked: what each player's poses hold afterwards."""
    chunks = Checkpoint(spark, f"{shared_folder(spark)}/packed-{uuid.uuid4().hex}")
    frames, bodies = table(spark, sf_dir, "frames"), table(spark, sf_dir, "bodies")
    # every third body has but its first sixteen landmarks, wrists left out
    cut = F.when((F.col("frame_no") + F.col("player_id")) % 3 == 0, F.slice("landmarks", 1, 16)).otherwise(F.col("landmarks"))
    packed = pack_frames(frames, bo.posed(bodies).withColumn("landmarks", cut), 40)
    for i in range(3):
        chunks.append("job", i, packed.where(F.col("chunk") == i).withColumnRenamed("chunk", "part"))
    joined = chunks.load("job", 3).withColumnRenamed("part", "chunk")
    times, poses = unpack_frames(joined)
    sums = poses.groupBy("match_id", "player_id").agg(
        F.count("*").alias("n"), r6(F.sum(F.col("court_x").cast("double")), "x"), r6(F.sum(F.col("court_y").cast("double")), "y"), r6(F.sum(F.get("landmarks", F.lit(15))["x"].cast("double")), "wrist"), r6(F.sum(F.get("landmarks", F.lit(16))["x"].cast("double")), "other")
    )
    return sums.join(times.groupBy("match_id").agg(F.count("*").alias("frames"), F.max("t").cast("double").alias("last")), "match_id")


QUERIES = {"packed_frames": packed_frames, "focused_identities": focused_identities, "resumed_identities": resumed_identities, "resumed_ball": resumed_ball, "picture_cuts": picture_cuts, "known_identities": known_identities, "known_ball": known_ball, "saved_matches": saved_matches, "joined_chunks": joined_chunks, "identity_tracks": identity_tracks, "ball_tracks": ball_tracks, "streamed_sessions": streamed_sessions}

ORACLE_SQL = {
    "packed_frames": with_tables(
        f"""select match_id, player_id, count(*) as n, {s6('sum(court_x::float::double)')} as x, {s6('sum(court_y::float::double)')} as y, {s6('sum((cx + w0x)::float::double)')} as wrist,
          {s6('sum(case when (frame_no + player_id) % 3 = 0 then 0 else (cx + w1x)::float::double end)')} as other, any_value(f.n) as frames, any_value(f.last) as last
        from bodies join (select match_id, count(*) as n, max(t) as last from frames group by 1) f using (match_id) group by 1, 2""", "frames", "bodies"),
    "known_identities": with_tables("select match_id, place as player_id, count(*) as n, floor(sum(x) * 1000000 + 0.5) / 1000000 as x, floor(sum(y) * 1000000 + 0.5) / 1000000 as y from known_players group by 1, 2", "known_players"),
    "focused_identities": with_tables(
        f"""select match_id, case when t >= {CUT_T} then xor(place, 1) else place end as player_id, count(*) as n, {s6(f'sum(case when t >= {CUT_T} then x + {MOVED}::double else x end)')} as x, {s6('sum(y)')} as y
        from known_players group by 1, 2""", "known_players"),
    "resumed_identities": with_tables(f"select match_id, place as player_id, count(*) as n, {s6('sum(x)')} as x, {s6('sum(y)')} as y from known_players group by 1, 2", "known_players"),
    "resumed_ball": with_tables(f"select match_id, count(*) as n, count(*) as times, {s6('min(t)')} as first, {s6('max(t)')} as last, {s6('sum(x)')} as x from known_ball where moving group by 1", "known_ball"),
    "picture_cuts": with_tables(
        """select p.match_id, p.frame_no from pixels p join pixels q on q.match_id = p.match_id and q.frame_no = p.frame_no - 1 and q.y = p.y and q.x = p.x
        group by 1, 2 having avg((abs(p.r - q.r) + abs(p.g - q.g)) / 2) > 12 and count(*) = 400""", "pixels"),
    "known_ball": with_tables("select match_id, count(*) as n, floor(min(t) * 1000000 + 0.5) / 1000000 as first, floor(max(t) * 1000000 + 0.5) / 1000000 as last, floor(sum(x) * 1000000 + 0.5) / 1000000 as x, count(*) - 1 as last_seq from known_ball where moving group by 1", "known_ball"),
    "saved_matches": with_tables("select match_id, created_at, case when me is null then 'first' else 'again ' || me end as title from matches", "matches"),
    "joined_chunks": with_tables("select match_id, count(*) as n, max(t) as last, 1 as torn from frames where t < 50 group by 1", "frames"),
    "streamed_sessions": """
        select match_id, count(*) as n_shots, min(us) as start_us, max(us) as last_us
        from (select *, sum(case when gap > 40000000000 then 1 else 0 end) over (partition by match_id order by us, event_id rows unbounded preceding) as island
              from (select user_id as match_id, event_id, epoch_us(ts) as us, epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) as gap from events))
        group by match_id, island having count(*) >= 2""",
}
