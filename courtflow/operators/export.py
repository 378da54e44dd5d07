"""Clips, key moments and documents made of a match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtflow.functions.geometry import js_round, zone
from courtflow.functions.text import SHOT_TYPES

BEFORE_S, AFTER_S, MOST_CLIP_S = 1.5, 1.2, 180.0


def clips(shots: DataFrame) -> DataFrame:
    """(match_id, seq, start_t, end_t, label): the moments around shots."""
    label = F.concat_ws(" ", F.concat(F.lit("player "), F.col("player_id").cast("string")), "shot_type")
    return shots.select("match_id", "seq", F.greatest(F.lit(0.0), F.col("t") - BEFORE_S).alias("start_t"), (F.col("t") + AFTER_S).alias("end_t"), label.alias("label"))


def within_budget(cut: DataFrame, seconds: float = MOST_CLIP_S) -> DataFrame:
    """Each match's clips in time order until one would exceed the budget; the first is kept in any case."""
    w = Window.partitionBy("match_id").orderBy("start_t", "seq")
    total = F.sum(F.greatest(F.lit(0.0), F.col("end_t") - F.col("start_t"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumns({"total": total, "__at": F.row_number().over(w)}).where((F.col("total") <= seconds) | (F.col("__at") == 1)).drop("__at")


def key_shots(shots: DataFrame, n: int = 6) -> DataFrame:
    """(match_id, seq): up to ``n`` shots spread over a match, varied in player and type.

    The match's shots in time order fall into n buckets; each gives its first shot of a
    player and type not picked yet, else its hardest (ties: the first). One fold per match.
    """
    w = Window.partitionBy("match_id")
    size = F.count("*").over(w)
    at = F.row_number().over(w.orderBy("t", "seq")) - 1
    rows = shots.withColumns({"__n": size, "__at": at})
    # the bucket whose half-open range of positions holds this one
    guess = F.floor((F.col("__at") + 1) * n / F.col("__n"))
    lower = lambda k: F.floor(k * (F.col("__n") / n))
    bucket = F.when(lower(guess) <= F.col("__at"), guess).otherwise(guess - 1)
    kind = F.concat_ws(":", F.col("player_id").cast("string"), "shot_type")
    row = F.struct(F.col("__at").alias("at"), "seq", kind.alias("kind"), "swing_speed")
    every = rows.where(F.col("__n") <= n).select("match_id", "seq")
    groups = rows.where(F.col("__n") > n).groupBy("match_id", bucket.alias("b")).agg(F.array_sort(F.collect_list(row)).alias("a"))
    folded = groups.groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct("b", "a"))).alias("buckets"))
    state = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast("array<bigint>").alias("picked"))

    def step(s: Column, b: Column) -> Column:
        fresh = F.get(F.filter(b["a"], lambda x: ~F.array_contains(s["seen"], x["kind"])), F.lit(0))
        hardest = F.aggregate(b["a"], F.get(b["a"], F.lit(0)), lambda best, x: F.when(x["swing_speed"] > best["swing_speed"], x).otherwise(best))
        pick = F.coalesce(fresh, hardest)
        return F.struct(F.array_union(s["seen"], F.array(pick["kind"])).alias("seen"), F.concat(s["picked"], F.array(pick["seq"])).alias("picked"))

    picked = folded.select("match_id", F.explode(F.aggregate("buckets", state, step)["picked"]).alias("seq"))
    return every.unionByName(picked)


def thinned(rows: DataFrame, order: list[str], most: int) -> DataFrame:
    """Keeps every other row of each match, again and again, until at most ``most`` are left."""
    w = Window.partitionBy("match_id")
    counted = rows.withColumns({"__n": F.count("*").over(w), "__at": F.row_number().over(w.orderBy(*order)) - 1})
    times = F.greatest(F.lit(0), F.ceil(F.log2(F.col("__n") / most) - 1e-12))
    return counted.where(F.col("__at") % F.pow(F.lit(2), times).cast("bigint") == 0).drop("__n", "__at")


def summary_documents(matches: DataFrame, players: DataFrame, teams: DataFrame) -> DataFrame:
    """(match_id, document): a match as JSON with rounded numbers; missing parts are left out."""
    rounded = lambda df, skip: [F.when(F.col(c).isNotNull(), F.floor(F.col(c) * 100 + 0.5) / 100).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if c not in skip]
    p = players.groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct("player_id", *rounded(players, ("match_id", "player_id"))))).alias("players"))
    t = teams.groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct("team", *rounded(teams, ("match_id", "team"))))).alias("teams"))
    rows = matches.join(p, "match_id", "left").join(t, "match_id", "left")
    return rows.select("match_id", F.to_json(F.struct(*[c for c in rows.columns if c != "match_id"])).alias("document"))


def coach_summaries(matches: DataFrame, stats: DataFrame, hands: DataFrame, teams: DataFrame, shots: DataFrame, most_shots: int = 2000) -> DataFrame:
    """(match_id, document): the whole summary of a match as JSON, rounded as it is shown.

    matches(match_id, seconds, calibrated, rallies, rally_shots, ...) with an optional map
    column ``names`` and an optional ``me``; stats, teams and hands as ``player_stats``,
    ``team_tactics`` and ``dominant_hand`` give them; shots(match_id, seq, t, player_id,
    shot_type, court_y, swing_speed), of which the first ``most_shots`` by time are listed.
    Flags of shots are only given where they are set, names and me where they are known.
    """
    tidy = lambda c, d=2: js_round(F.col(c), d)
    have = set(matches.columns)
    named = F.substring(F.trim(F.element_at("names", F.col("player_id"))), 1, 60) if "names" in have else F.lit(None).cast("string")
    me = F.when(F.col("me") == F.col("player_id"), True) if "me" in have else F.lit(None).cast("boolean")
    extra = [c for c in ("names", "me") if c in have]
    rows = stats.join(hands, ["match_id", "player_id"], "left").join(matches.select("match_id", *extra), "match_id")
    player = F.struct(
        F.col("player_id").alias("playerId"), "label", F.when(named != "", named).alias("name"), me.alias("isMe"), "team",
        tidy("distance", 0).alias("distanceMeters"), tidy("avg_speed").alias("avgSpeed"), tidy("max_speed").alias("maxSpeed"), tidy("tracked_seconds", 0).alias("trackedSeconds"),
        F.struct(*[tidy(f"share_{z}").alias(z) for z in ("net", "transition", "baseline")]).alias("zoneShare"),
        F.struct(*[F.col(f"n_{k.replace('-', '_')}").alias(k) for k in SHOT_TYPES]).alias("shots"),
        F.col("total_shots").alias("totalShots"), tidy("avg_swing_speed", 1).alias("avgSwingSpeed"), F.coalesce("hand", F.lit("right")).alias("dominantHand"), tidy("avg_net_distance", 1).alias("avgNetDistance"),
    )
    players = rows.groupBy("match_id").agg(F.array_sort(F.collect_list(player)).alias("players"))
    shares = {"togetherNet": "share_net", "togetherMid": "share_mid", "togetherBack": "share_back", "staggered": "share_staggered", "split": "share_split"}
    pair = F.struct(
        "team", tidy("paired_seconds", 0).alias("pairedSeconds"), *[tidy(c).alias(n) for n, c in shares.items()],
        tidy("avg_spacing", 1).alias("avgSpacing"), tidy("avg_depth_gap", 1).alias("avgDepthGap"), tidy("avg_lateral_gap", 1).alias("avgLateralGap"), F.col("net_takings").alias("netTakings"),
    )
    pairs = teams.groupBy("match_id").agg(F.array_sort(F.collect_list(pair)).alias("teams"))
    place = F.row_number().over(Window.partitionBy("match_id").orderBy("t", "seq"))
    flags = [F.when(F.col(c), True).alias(c) for c in ("confirmed", "lob", "edited", "heard") if c in shots.columns]
    shot = F.struct(tidy("t", 1).alias("t"), F.col("player_id").alias("playerId"), F.col("shot_type").alias("type"), zone(F.col("court_y")).alias("zone"), tidy("swing_speed", 1).alias("swingSpeed"), *flags)
    listed = shots.withColumn("place", place).where(F.col("place") <= most_shots).groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct("place", shot.alias("shot"))))["shot"].alias("shots"))
    whole = matches.join(players, "match_id", "left").join(pairs, "match_id", "left").join(listed, "match_id", "left")
    empty = lambda c: F.coalesce(F.col(c), F.array())
    document = F.struct(
        tidy("seconds", 1).alias("durationSeconds"), "calibrated", "rallies", F.when(F.col("rallies") > 0, js_round(F.col("rally_shots") / F.col("rallies"), 1)).otherwise(0.0).alias("avgRallyShots"),
        empty("players").alias("players"), empty("teams").alias("teams"), empty("shots").alias("shots"),
    )
    return whole.select("match_id", F.to_json(document).alias("document"))


def chat_documents(summaries: DataFrame, reports: DataFrame, turns: DataFrame, most: int = 12) -> DataFrame:
    """(match_id, document): a chat about a match: its summary, its report (null where there is none) and the last turns.

    summaries(match_id, document), reports(match_id, report as JSON), turns(match_id,
    turn, role, text), which begin with the user as ``trimmed_turns`` says. Matches
    without such turns have no chat.
    """
    recent = trimmed_turns(turns.withColumnRenamed("match_id", "conv_id"), most)
    line = F.struct("turn", F.struct("role", F.col("text").alias("content")).alias("m"))
    said = recent.groupBy(F.col("conv_id").alias("match_id")).agg(F.to_json(F.array_sort(F.collect_list(line))["m"]).alias("messages"))
    rows = summaries.join(said, "match_id").join(reports.select("match_id", "report"), "match_id", "left")
    text = F.concat(F.lit('{"summary":'), "document", F.lit(',"report":'), F.coalesce("report", F.lit("null")), F.lit(',"messages":'), "messages", F.lit("}"))
    return rows.select("match_id", text.alias("document"))


def trimmed_turns(conversations: DataFrame, most: int = 12) -> DataFrame:
    """The last ``most`` turns of each conversation from the first one of the user on; earlier ones go."""
    last = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    recent = conversations.withColumn("__back", last).where(F.col("__back") <= most).drop("__back")
    start = F.min(F.when(F.col("role") == "user", F.col("turn"))).over(Window.partitionBy("conv_id"))
    return recent.withColumn("__start", start).where(F.col("turn") >= F.col("__start")).drop("__start")


def job_key(settings: Column) -> Column:
    """A name for a job that is the same for the same settings."""
    return F.sha2(F.to_json(settings), 256)
