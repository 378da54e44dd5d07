"""Rules name what is wrong in a document; documents of match tables keep them."""

import copy
import json

from pyspark.sql import functions as F

from courtflow.functions import schemas as sc
from courtflow.functions.text import SHOT_TYPES
from courtflow.operators import export as ex


def summary():
    player = {
        "playerId": 0, "label": "A1", "team": "A", "dominantHand": "left", "shots": {k: 1 for k in SHOT_TYPES}, "zoneShare": {"net": 0.2, "transition": 0.3, "baseline": 0.5},
        **dict.fromkeys(("distanceMeters", "avgSpeed", "maxSpeed", "trackedSeconds", "totalShots", "avgSwingSpeed", "avgNetDistance"), 1.5),
    }
    return {"durationSeconds": 1.5, "calibrated": True, "rallies": 2, "avgRallyShots": 1, "players": [player], "shots": [{"t": 1, "playerId": 0, "type": "serve", "zone": "net", "swingSpeed": 3, "lob": True}]}


def changed(doc, path, value="gone"):
    out = copy.deepcopy(doc)
    at = out
    for k in path[:-1]:
        at = at[k]
    if value == "gone":
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return out


def found(spark, rule, docs):
    rows = spark.createDataFrame([(i, d if d is None or isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)], "id int, document string")
    return [sorted(r.problems) for r in sc.problems(rows, rule).orderBy("id").collect()]


def test_requests_and_their_faults(spark):
    frame = {"t": 1, "caption": "c", "image": "data:image/jpeg;base64,x"}
    good = {"summary": summary(), "keyframes": [frame], "extra": 1}
    s = ("summary",)
    cases = [
        (good, []), (changed(good, ("context",), {"level": "x"}), []), (changed(good, ("context",), {"focus": "x" * 501, "level": 1}), ["$.context.focus", "$.context.level"]),
        (changed(good, (*s, "rallies"), "2"), ["$.summary.rallies"]), (changed(good, (*s, "calibrated"), None), ["$.summary.calibrated"]), (changed(good, (*s, "players", 0, "team"), "C"), ["$.summary.players[0].team"]),
        (changed(good, (*s, "players", 0, "shots", "serve")), ["$.summary.players[0].shots.serve"]), (changed(good, (*s, "players", 0, "shots", "lob"), 1), ["$.summary.players[0].shots.lob"]),
        (changed(good, (*s, "players", 0, "name"), "x" * 61), ["$.summary.players[0].name"]), (changed(good, (*s, "players", 0, "name"), None), ["$.summary.players[0].name"]),
        (changed(good, (*s, "players"), {}), ["$.summary.players"]), (changed(good, (*s, "players", 0), 3), ["$.summary.players[0]"]), (changed(good, (*s, "shots"), summary()["shots"] * 2001), ["$.summary.shots"]),
        (changed(good, (*s, "goals"), [{"goal": "g", "met": 1}] * 2), ["$.summary.goals[0].met", "$.summary.goals[1].met"]),
        (changed(good, (*s, "points"), {"tagged": 1, "score": {"A": 1, "B": 2}, "byPattern": {"A": {"net": {"won": 1, "played": 2}}, "B": {"odd": {}}}}), ["$.summary.points.byPattern.B.odd"]),
        (changed(good, ("keyframes",), [frame] * 9), ["$.keyframes"]), (changed(good, ("keyframes", 0, "image"), "http"), ["$.keyframes[0].image"]),
        ({}, ["$.keyframes", "$.summary"]), ([], ["$"]), ("{not json", ["$"]), (None, ["$"]), ("", ["$"]),
    ]
    for (doc, want), got in zip(cases, found(spark, sc.REQUEST, [d for d, _ in cases]), strict=True):
        assert got == want, (str(doc)[:200], got, want)


def test_chats(spark):
    report = {"headline": "h", "summary": "s", "players": [{"playerId": 1, "strengths": ["a"], "improvements": [], "drills": [{"name": "n", "description": "d"}]}], "teamTactics": [], "keyMoments": [{"t": 1, "title": "k", "observation": "o"}], "caveats": []}
    ask = {"role": "user", "content": "why?"}
    chat = {"summary": summary(), "report": None, "messages": [ask]}
    say = lambda n, role="assistant": {"role": role, "content": "x" * n}
    cases = [
        (chat, []), (changed(chat, ("report",), report), []), (changed(chat, ("report",)), ["$.report"]), (changed(chat, ("report",), changed(report, ("teamTactics",), [{"team": "Z", "observations": [1]}])), ["$.report.teamTactics[0].observations[0]", "$.report.teamTactics[0].team"]),
        (changed(chat, ("messages",), []), ["$.messages"]), (changed(chat, ("messages",), [ask] * 41), ["$.messages"]), (changed(chat, ("messages",), [ask, say(40_000), say(4_000, "user")]), []),
        (changed(chat, ("messages",), [say(4_001, "user"), say(40_001), say(1, "system"), say(0)]), ["$.messages[0].content", "$.messages[1].content", "$.messages[2].role", "$.messages[3].content"]),
    ]
    for (doc, want), got in zip(cases, found(spark, sc.CHAT, [d for d, _ in cases]), strict=True):
        assert got == want, (str(doc)[:200], got, want)


def test_built_documents_keep_the_rules(spark):
    stats = [F.lit(1.234).alias(c) for c in ("distance", "avg_speed", "max_speed", "tracked_seconds", "share_net", "share_transition", "share_baseline", "avg_swing_speed", "avg_net_distance")]
    stats += [F.lit(2).alias(f"n_{k.replace('-', '_')}") for k in SHOT_TYPES] + [F.lit(12).alias("total_shots"), F.lit("A").alias("team"), F.lit("A1").alias("label")]
    players = spark.createDataFrame([(1, 0), (1, 1)], "match_id long, player_id int").select("match_id", "player_id", *stats)
    matches = spark.createDataFrame([(1, 61.26, True, 2, 7, {0: "  Ana  ", 1: " "}, 1), (2, 5.0, False, 0, 0, None, None)], "match_id long, seconds double, calibrated boolean, rallies long, rally_shots long, names map<int, string>, me int")
    hands = spark.createDataFrame([(1, 0, "left")], "match_id long, player_id int, hand string")
    teams = spark.createDataFrame([(1, "A", 3.4, 2)], "match_id long, team string, paired_seconds double, net_takings long").select(
        "*", *[F.lit(0.257).alias(c) for c in ("share_net", "share_mid", "share_back", "share_staggered", "share_split", "avg_spacing", "avg_depth_gap", "avg_lateral_gap")]
    )
    shots = spark.createDataFrame([(1, i, i / 3, 0, "serve", 19.0, 3.14, i == 1) for i in range(5)], "match_id long, seq long, t double, player_id int, shot_type string, court_y double, swing_speed double, lob boolean")
    docs = ex.coach_summaries(matches, players, hands, teams, shots, 3).cache()
    one, two = (json.loads(r.document) for r in docs.orderBy("match_id").collect())
    assert (one["durationSeconds"], one["avgRallyShots"], two["avgRallyShots"], two["players"], two["shots"]) == (61.3, 3.5, 0.0, [], [])
    assert [p.get("name") for p in one["players"]] == ["Ana", None] and [p.get("isMe") for p in one["players"]] == [None, True] and [p["dominantHand"] for p in one["players"]] == ["left", "right"]
    assert [(x["t"], x["zone"], x.get("lob")) for x in one["shots"]] == [(0.0, "baseline", None), (0.3, "baseline", True), (0.7, "baseline", None)] and one["teams"][0]["togetherNet"] == 0.26
    assert [r.problems for r in sc.problems(docs, sc.SUMMARY).collect()] == [[], []]
    turns = spark.createDataFrame([(1, t, "assistant" if t % 2 else "user", f"t{t}") for t in range(15)] + [(3, 0, "user", "x")], "match_id long, turn int, role string, text string")
    (chat,) = sc.problems(ex.chat_documents(docs, spark.createDataFrame([], "match_id long, report string"), turns), sc.CHAT).collect()
    said = [x["content"] for x in json.loads(chat.document)["messages"]]
    assert chat.problems == [] and chat.match_id == 1 and said == [f"t{t}" for t in range(4, 15)]
