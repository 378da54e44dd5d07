"""Documents are checked and cleaned."""

import json

from pyspark.sql import functions as F

from courtflow.functions import documents as dc
from courtflow.operators import export as ex
from courtflow.sources.matches import new_match


def summary(**more):
    player = {"playerId": 0, "label": "A1", "team": "A", "dominantHand": "left", "shots": {"serve": 1}}
    return {"durationSeconds": 1.5, "calibrated": True, "rallies": 2, "avgRallyShots": 1, "players": [player], "shots": [{"t": 1, "type": "serve", "zone": "net"}]} | more


def test_requests(spark):
    good = {"summary": summary(), "keyframes": [{"t": 1, "caption": "c", "image": "data:image/jpeg;base64,x"}]}
    bad = [
        {**good, "summary": summary(players=[{"playerId": 0, "label": "x", "team": "C", "dominantHand": "left"}])}, {**good, "summary": summary(durationSeconds=None)}, {**good, "keyframes": [{"t": 1, "caption": "c" * 201, "image": "data:image/jpeg;base64,x"}]},
        {**good, "keyframes": good["keyframes"] * 9}, {**good, "context": {"focus": "x" * 501}}, {"keyframes": []}, {**good, "summary": summary(shots=[{"t": 1, "type": "lob", "zone": "net"}])},
    ]
    docs = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate([good, *bad])] + [(99, "not json"), (100, None)], "id long, document string")
    assert [r.id for r in dc.requests(docs).where("valid").collect()] == [0]
    chat = {"summary": summary(), "messages": [{"role": "user", "content": "why?"}]}
    rows = [(0, chat), (1, {**chat, "messages": []}), (2, {**chat, "messages": [{"role": "user", "content": "x" * 4001}]}), (3, {**chat, "messages": [{"role": "assistant", "content": "x" * 4001}]}), (4, {**chat, "messages": [{"role": "other", "content": "x"}]})]
    docs = spark.createDataFrame([(i, json.dumps(d)) for i, d in rows], "id long, document string")
    assert sorted(r.id for r in dc.chats(docs).where("valid").collect()) == [0, 3]


def test_reports(spark):
    loose = {"headline": "h", "summary": "s", "players": [{"playerId": 1, "strengths": ["a"], "drills": [{"name": "n"}, {"description": "x"}]}, {"playerId": "no"}, 5], "teamTactics": [{"team": "A"}, {"team": "Z"}], "keyMoments": [{"t": 1.5, "title": "k"}, {"title": "no time"}], "caveats": "none"}
    rows = dc.normalised_reports(spark.createDataFrame([(json.dumps(loose),), ('{"headline": "h"}',)], "document string")).collect()
    r = rows[0].report
    assert rows[1].report is None and r.headline == "h" and [(x.playerId, x.strengths, [d.name for d in x.drills]) for x in r.players] == [(1, ["a"], ["n"])]
    assert [t.team for t in r.teamTactics] == ["A"] and [(k.t, k.title, k.observation) for k in r.keyMoments] == [(1.5, "k", "")] and r.caveats == []


def test_texts(spark):
    row = spark.range(1).select(
        dc.goal_text(F.lit("split"), F.lit(15.0), F.lit(True)).alias("a"), dc.goal_text(F.lit("winners"), F.lit(3.0), F.lit(False)).alias("b"), dc.goal_value(F.lit("distance"), F.lit(39.6)).alias("c"),
        dc.prompt_text(F.lit("{}"), F.lit(None).cast("string"), F.lit("net"), F.array(F.lit("x"), F.lit("y"))).alias("d"),
    ).first()
    assert (row.a, row.b, row.c, row.d) == ("Pair split ≤ 15%", "My winners ≥ 3", "40 m/min", "Match summary:\n{}\n\nFocus: net\n\nPictures:\nx\ny")
    from courtflow.operators import movement as m
    from courtflow.operators import tactics as tc
    from courtflow.sources.surrogate import table

    d = {n: table(spark, "/root/testdata/sf0.001", n).where("match_id = 1") for n in ("frames", "poses")}
    doc = ex.summary_documents(d["frames"].groupBy("match_id").agg(F.max("t").alias("seconds")), m.movement(m.smoothed_track(d["poses"])), tc.team_tactics(tc.paired_frames(d["frames"], d["poses"]))).first().document
    assert len(json.loads(doc)["players"]) == 4 and len(json.loads(doc)["teams"]) == 2


def test_new_match():
    row = new_match(3, 5, "final")
    assert (row["match_id"], row["created_at"], row["title"], row["me"], row["names"], row["demo"]) == (3, 5, "final", None, {}, False)
