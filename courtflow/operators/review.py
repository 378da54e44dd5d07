"""What a user looks at after a match: key frames, timelines, cards, score summaries, rapid review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtflow.functions.geometry import slot_tag, team
from courtflow.operators.export import key_shots
from courtflow.operators.history import GOALS

#: The keys that end a point in rapid review.
ENDING_KEYS = {"w": "winner", "f": "forced", "u": "unforced"}


def analysed_seconds(duration: Column, start: Column, end: Column) -> Column:
    """Length of the chosen segment, or of the whole where none is chosen; never zero."""
    return F.greatest(F.coalesce(end - start, duration), F.lit(1e-3))


def key_frames(shots: DataFrame, matches: DataFrame, n: int = 6, spare: int = 4) -> DataFrame:
    """(match_id, t, caption): the times of each match's key shots, or ``spare`` evenly spaced times where it has no shots.

    matches(match_id, start, end) has a row for each match; shots need seq, t, player_id, shot_type, swing_speed, zone.
    """
    said = F.concat(slot_tag(F.col("player_id")), F.lit(": "), "shot_type", F.lit(" from the "), "zone")
    picked = shots.join(key_shots(shots, n), ["match_id", "seq"], "left_semi").select("match_id", "t", said.alias("caption"))
    without = matches.join(shots.select("match_id").distinct(), "match_id", "left_anti")
    at = F.col("start") + (F.col("i") + 0.5) / spare * (F.col("end") - F.col("start"))
    even = without.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(spare - 1)))).select("match_id", at.alias("t"), F.lit("general play").alias("caption"))
    return picked.unionByName(even)


def first_rows(rows: DataFrame, order: list[str], most: int) -> DataFrame:
    """Each match's first ``most`` rows, for documents of bounded length."""
    at = F.row_number().over(Window.partitionBy("match_id").orderBy(*order))
    return rows.withColumn("__at", at).where(F.col("__at") <= most).drop("__at")


def listed(rows: DataFrame, order: list[str | Column], most: int = 40) -> DataFrame:
    """Each match's first ``most`` rows with their ``place``, and how many ``more`` the list leaves out."""
    w = Window.partitionBy("match_id")
    placed = rows.withColumns({"place": F.row_number().over(w.orderBy(*order)), "more": F.greatest(F.count("*").over(w) - most, F.lit(0))})
    return placed.where(F.col("place") <= most)


def thinned_to_size(rows: DataFrame, order: list[str], json: Column, most_chars: int, least_rows: int = 20) -> DataFrame:
    """Keeps every other row of each match, again and again, while its JSON list is too long and has over ``least_rows`` rows.

    The lengths after each number of halvings are sums over the match, so one pass finds
    how often to halve.
    """
    w = Window.partitionBy("match_id")
    placed = rows.withColumns({"__at": F.row_number().over(w.orderBy(*order)) - 1, "__long": F.length(json), "__n": F.count("*").over(w)})
    halvings = F.explode(F.sequence(F.lit(0), F.ceil(F.log2("__n")).cast("int")))
    kept = placed.select("match_id", "__at", "__long", halvings.alias("k")).where(F.col("__at") % F.pow(F.lit(2), F.col("k")).cast("bigint") == 0)
    sizes = kept.groupBy("match_id", "k").agg(F.count("*").alias("n"), (F.sum("__long") + F.count("*") + 1).alias("chars"))
    chosen = sizes.where((F.col("chars") <= most_chars) | (F.col("n") <= least_rows)).groupBy("match_id").agg(F.min("k").alias("__k"))
    return placed.join(chosen, "match_id").where(F.col("__at") % F.pow(F.lit(2), F.col("__k")).cast("bigint") == 0).drop("__at", "__long", "__n", "__k")


def timeline(spans: DataFrame, lengths: DataFrame) -> DataFrame:
    """Adds left and width in percent to spans(match_id, start_t, end_t); lengths(match_id, duration)."""
    share = lambda x: x / F.col("duration") * 100
    return spans.join(lengths, "match_id").withColumns({"left": share(F.col("start_t")), "width": share(F.col("end_t") - F.col("start_t"))}).drop("duration")


def focus_player(matches: DataFrame, counts: DataFrame) -> DataFrame:
    """(match_id, player_id): who a match's card shows: me, else who hit most (ties: the least id), else slot 0."""
    most = counts.groupBy("match_id").agg(F.min(F.struct((-F.col("total_shots")).alias("k"), "player_id"))["player_id"].alias("top"))
    return matches.join(most, "match_id", "left").select("match_id", F.coalesce("me", "top", F.lit(0)).alias("player_id"))


def card(stats: DataFrame, least_shots: int = 5) -> DataFrame:
    """(match_id, player_id, speed_text, hand_text): km/h with one decimal; the hand only from ``least_shots`` shots on."""
    speed = F.format_string("%.1f km/h", F.floor(F.col("max_speed") * 36 + 0.5) / 10)
    hand = F.when(F.col("total_shots") >= least_shots, F.concat(F.lit("likely "), "hand", F.lit("-handed")))
    return stats.select("match_id", "player_id", speed.alias("speed_text"), hand.alias("hand_text"))


def result_label(winner: Column, me: Column) -> Column:
    """won or lost from my side of the net; null without a winner or without me."""
    return F.when(me.isNotNull() & winner.isNotNull(), F.when(winner == team(me), "won").otherwise("lost"))


def day(created_at: Column) -> Column:
    """Month and day of a time in milliseconds."""
    return F.date_format(F.timestamp_millis(created_at), "MMM d")


def unused_metrics(owners: DataFrame, goals: DataFrame) -> DataFrame:
    """(owner, metric): the goal metrics that an owner has no goal for; goals(owner, metric)."""
    every = owners.select("owner", F.explode(F.array(*map(F.lit, GOALS))).alias("metric"))
    return every.join(goals, ["owner", "metric"], "left_anti")


def score_summary(scored: DataFrame, most: int = 10) -> DataFrame:
    """(match_id, document): the last ``most`` sets, the running game, break points and held service games as JSON."""
    sets = F.slice("sets", -F.least(F.size("sets"), F.lit(most)), F.least(F.size("sets"), F.lit(most)))
    games = F.when(F.size("sets") == 0, F.array().cast("array<struct<A:int,B:int>>")).otherwise(F.transform(sets, lambda s: F.struct(s["a"].cast("int").alias("A"), s["b"].cast("int").alias("B"))))
    pair = lambda a, b: F.struct(F.col(a).alias("A"), F.col(b).alias("B"))
    document = F.struct(games.alias("sets"), pair("label_a", "label_b").alias("current_game"), pair("breaks_a", "breaks_b").alias("breaks"), pair("held_a", "held_b").alias("held"))
    return scored.select("match_id", F.to_json(document).alias("document"))


def reviewed(keys: DataFrame, tags: DataFrame) -> DataFrame:
    """(match_id, rally_idx, winner, ending): tags after rapid review, whose keys(match_id, rally_idx, at, key) come in order of ``at``.

    a and b set the winner; the keys of ``ENDING_KEYS`` set how the point ended, if it has
    a winner by then; other keys change nothing.
    """
    point = ["match_id", "rally_idx"]
    winner = F.when(F.lower("key").isin("a", "b"), F.upper("key"))
    old = tags.select(*point, F.lit(-1).cast("long").alias("at"), F.col("winner").alias("w"), F.col("ending").alias("e"))
    end = F.create_map(*[F.lit(x) for pair in ENDING_KEYS.items() for x in pair])[F.lower("key")]
    steps = old.unionByName(keys.select(*point, F.col("at").cast("long").alias("at"), winner.alias("w"), end.alias("e")))
    so_far = Window.partitionBy(*point).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    known = steps.withColumn("known", F.last("w", ignorenulls=True).over(so_far))
    last = lambda c, when: F.max_by(c, F.when(when, F.col("at")))
    out = known.groupBy(*point).agg(last("w", F.col("w").isNotNull()).alias("winner"), last("e", F.col("e").isNotNull() & F.col("known").isNotNull()).alias("ending"))
    return out.where("winner is not null")
