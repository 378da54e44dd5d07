"""Match scores replayed from tagged points: one ordered fold for each match."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What the fold carries: points and games of the current game and set, who serves, and totals. sets holds finished ones.
STATE = (
    "struct<pa:int,pb:int,tiebreak:boolean,server:string,game_server:string,ga:int,gb:int,"
    "sets:array<struct<a:int,b:int,ta:int,tb:int>>,games_a:int,games_b:int,"
    "chances_a:int,breaks_a:int,chances_b:int,breaks_b:int,served_a:int,held_a:int,served_b:int,held_b:int,points:int>"
)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Names a value inside a lambda, so that it is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def wins_game(mine: Column, theirs: Column, golden: Column, tiebreak: Column) -> Column:
    """Whether these points win the game for the first side."""
    return F.when(tiebreak, (mine >= 7) & (mine - theirs >= 2)).otherwise((mine >= 4) & (mine - theirs >= F.when(golden, 1).otherwise(2)))


def game_label(mine: Column, theirs: Column, golden: Column, tiebreak: Column) -> Column:
    """0, 15, 30, 40 or Ad; plain numbers in a tiebreak."""
    plain = F.element_at(F.array(*map(F.lit, ("0", "15", "30", "40"))), F.least(mine, F.lit(3)) + 1)
    ahead = ~golden & (mine > theirs)
    return F.when(tiebreak, mine.cast("string")).when((mine <= 3) & (theirs <= 3), plain).otherwise(F.when(ahead, "Ad").otherwise("40"))


def _plus(cond: Column) -> Column:
    return F.when(F.coalesce(cond, F.lit(False)), 1).otherwise(0)


def _point(s: Column, p: Column) -> Column:
    """The state after one point p(winner, server, golden)."""
    server = F.when((s["pa"] == 0) & (s["pb"] == 0), F.coalesce(p["server"], s["server"])).otherwise(F.coalesce(s["game_server"], p["server"]))
    won_a = p["winner"] == "A"
    base = _let(F.struct(server.alias("gs"), (s["pa"] + _plus(won_a)).alias("pa"), (s["pb"] + _plus(~won_a)).alias("pb")), lambda x: _scored(s, p, x, won_a))
    return base.cast(STATE)


def _scored(s: Column, p: Column, x: Column, won_a: Column) -> Column:
    golden, tb = p["golden"], s["tiebreak"]
    chance_a = ~tb & (x["gs"] == "B") & wins_game(s["pa"] + 1, s["pb"], golden, tb)
    chance_b = ~tb & (x["gs"] == "A") & wins_game(s["pb"] + 1, s["pa"], golden, tb)
    over = F.when(won_a, wins_game(x["pa"], x["pb"], golden, tb)).otherwise(wins_game(x["pb"], x["pa"], golden, tb))
    y = F.struct(
        x["gs"].alias("gs"), x["pa"].alias("pa"), x["pb"].alias("pb"), over.alias("over"),
        (s["ga"] + _plus(over & won_a)).alias("ga"), (s["gb"] + _plus(over & ~won_a)).alias("gb"),
        _plus(chance_a).alias("ca"), _plus(chance_b).alias("cb"),
    )
    return _let(y, lambda y: _closed(s, y, won_a, tb))


def _closed(s: Column, y: Column, won_a: Column, tb: Column) -> Column:
    over = y["over"]
    set_over = over & (tb | ((F.greatest(y["ga"], y["gb"]) >= 6) & (F.abs(y["ga"] - y["gb"]) >= 2)))
    other = F.when(y["gs"] == "A", "B").when(y["gs"] == "B", "A")
    zero, none = F.lit(0), F.lit(None)
    done = F.struct(y["ga"].alias("a"), y["gb"].alias("b"), F.when(tb, y["pa"]).alias("ta"), F.when(tb, y["pb"]).alias("tb"))
    counted = over & ~tb
    return F.struct(
        F.when(over, zero).otherwise(y["pa"]).alias("pa"), F.when(over, zero).otherwise(y["pb"]).alias("pb"),
        F.when(set_over, F.lit(False)).when(over, (y["ga"] == 6) & (y["gb"] == 6)).otherwise(tb).alias("tiebreak"),
        F.when(over, other).otherwise(s["server"]).alias("server"), F.when(over, none).otherwise(y["gs"]).cast("string").alias("game_server"),
        F.when(set_over, zero).otherwise(y["ga"]).alias("ga"), F.when(set_over, zero).otherwise(y["gb"]).alias("gb"),
        F.when(set_over, F.concat(s["sets"], F.array(done))).otherwise(s["sets"]).alias("sets"),
        (s["games_a"] + _plus(over & won_a)).alias("games_a"), (s["games_b"] + _plus(over & ~won_a)).alias("games_b"),
        (s["chances_a"] + y["ca"]).alias("chances_a"), (s["breaks_a"] + F.when(won_a, y["ca"]).otherwise(0)).alias("breaks_a"),
        (s["chances_b"] + y["cb"]).alias("chances_b"), (s["breaks_b"] + F.when(won_a, 0).otherwise(y["cb"])).alias("breaks_b"),
        (s["served_a"] + _plus(counted & (y["gs"] == "A"))).alias("served_a"), (s["held_a"] + _plus(counted & (y["gs"] == "A") & won_a)).alias("held_a"),
        (s["served_b"] + _plus(counted & (y["gs"] == "B"))).alias("served_b"), (s["held_b"] + _plus(counted & (y["gs"] == "B") & ~won_a)).alias("held_b"),
        (s["points"] + 1).alias("points"),
    )


def scores(points: DataFrame) -> DataFrame:
    """Per match the state after all points(match_id, rally_idx, winner, server, golden), with labels.

    A game's server is the detected one, else the one carried over (the other team after
    each game); break chances are seen before the point is added; tiebreaks count neither
    as breaks nor as holds. ``sets`` lists finished sets and the current one, unless that
    is empty and not the first; a match of no points has no row.
    """
    row = F.struct("rally_idx", "winner", "server", "golden")
    ordered = points.groupBy("match_id").agg(F.array_sort(F.collect_list(row)).alias("p"), F.max("golden").alias("golden"))
    zero = F.expr(
        "named_struct('pa', 0, 'pb', 0, 'tiebreak', false, 'server', string(null), 'game_server', string(null), 'ga', 0, 'gb', 0,"
        "'sets', cast(array() as array<struct<a:int,b:int,ta:int,tb:int>>), 'games_a', 0, 'games_b', 0, 'chances_a', 0, 'breaks_a', 0,"
        "'chances_b', 0, 'breaks_b', 0, 'served_a', 0, 'held_a', 0, 'served_b', 0, 'held_b', 0, 'points', 0)"
    ).cast(STATE)
    s = ordered.select("match_id", "golden", F.aggregate("p", zero, _point).alias("__state")).select("match_id", "golden", "__state.*")
    now = F.array(F.struct(F.col("ga").alias("a"), F.col("gb").alias("b"), F.lit(None).cast("int").alias("ta"), F.lit(None).cast("int").alias("tb")))
    pending = (F.col("ga") + F.col("gb") + F.col("pa") + F.col("pb") > 0) | (F.size("sets") == 0)
    label = lambda a, b: game_label(F.col(a), F.col(b), F.col("golden"), F.col("tiebreak"))
    return s.withColumns(
        {
            "finished": F.col("sets"),
            "sets": F.when(pending, F.concat("sets", now)).otherwise(F.col("sets")),
            "label_a": label("pa", "pb"), "label_b": label("pb", "pa"),
            "serving": F.when(F.col("pa") + F.col("pb") > 0, F.col("game_server")).otherwise(F.col("server")),
        }
    )


def score_text(sets: Column) -> Column:
    """Sets as 6-4 7-6(7-3)."""
    one = lambda x: F.concat(x["a"].cast("string"), F.lit("-"), x["b"].cast("string"), F.coalesce(F.concat(F.lit("("), x["ta"].cast("string"), F.lit("-"), x["tb"].cast("string"), F.lit(")")), F.lit("")))
    return F.array_join(F.transform(sets, one), " ")


def winners(score: DataFrame, points: DataFrame) -> DataFrame:
    """(match_id, winner): by finished sets, then games, then points; null if level."""
    done = F.filter("finished", lambda x: (F.greatest(x["a"], x["b"]) >= 6) & (x["a"] != x["b"]) & ((F.abs(x["a"] - x["b"]) >= 2) | x["ta"].isNotNull()))
    mine = F.size(F.filter(done, lambda x: x["a"] > x["b"]))
    tally = points.groupBy("match_id").agg(F.sum(F.when(F.col("winner") == "A", 1).otherwise(-1)).alias("points_lead"))
    lead = score.withColumn("sets_lead", 2 * mine - F.size(done)).join(tally, "match_id")
    side = lambda c: F.when(c > 0, "A").when(c < 0, "B")
    return lead.select("match_id", F.coalesce(side(F.col("sets_lead")), side(F.col("games_a") - F.col("games_b")), side(F.col("points_lead"))).alias("winner"))
