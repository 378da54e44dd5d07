"""Facts about single operators on small inputs."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from courtflow.functions import geometry as g
from courtflow.operators import movement as m
from courtflow.operators import points as p
from courtflow.operators import rules as ru
from courtflow.operators import scoring as sc
from courtflow.operators import shots as sh
from courtflow.operators import timeseries as ts
from courtflow.operators import tracking as tr
from courtflow.operators import vision as vi


def table(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def frames(spark, times):
    return table(spark, "match_id long, frame_no long, t double", [(0, i, float(t)) for i, t in enumerate(times)])


POSE = "match_id long, frame_no long, t double, player_id int, court_x double, court_y double"


def test_player_statistics(spark):
    times = [i / 10 for i in range(51)]
    poses = table(spark, POSE, [(0, i, t, 0, 5.0, 19 - t) for i, t in enumerate(times)])
    shots = table(spark, "match_id long, seq long, t double, player_id int, shot_type string, swing_speed double", [])
    row = m.player_stats(frames(spark, times), poses, shots).first()
    assert 4.3 < row.distance < 5.1 and round(row.avg_speed, 1) == 1 and row.share_net == 0 and row.tracked_seconds == pytest.approx(5)
    assert row.total_shots == 0 and row.label == "A1"
    heat = m.heatmap(m.smoothed_track(poses)).agg(F.sum("share")).first()[0]
    assert heat == pytest.approx(1)


def test_nearest_frame_prefers_the_later_of_two(spark):
    left = table(spark, "match_id long, t double", [(0, t) for t in (0.22, 0.16, -1.0, 9.0, 0.05)])
    rows = ts.asof_nearest(left, frames(spark, [0, 0.1, 0.25, 0.4]), ["match_id"], "t", ["frame_no"]).collect()
    assert {r.t: r.near_t for r in rows} == {0.22: 0.25, 0.16: 0.1, -1.0: 0.0, 9.0: 0.4, 0.05: 0.1}


def test_short_gaps_are_filled_and_long_ones_left(spark):
    times = [0, 0.1, 0.2, 0.3, 2.0]
    poses = table(spark, POSE, [(0, 0, 0.0, 1, 2.0, 5.0), (0, 3, 0.3, 1, 5.0, 5.0), (0, 4, 2.0, 1, 9.0, 5.0)])
    rows = {r.frame_no: r for r in ts.fill_gaps(frames(spark, times), poses).collect()}
    assert sorted(rows) == [0, 1, 2, 3, 4] and rows[1].court_x == pytest.approx(3) and rows[2].court_x == pytest.approx(4)
    assert rows[1].interpolated and not rows[3].interpolated


def test_spaced_peaks_move_their_anchor(spark):
    rows = [(0, t, v) for t, v in ((0.0, 1.0), (0.1, 12.0), (0.2, 3.0), (0.3, 15.0), (0.4, 2.0), (2.0, 11.0), (2.1, 1.0))]
    samples = table(spark, "k long, t double, v double", rows)
    peaks = ts.spaced_peaks(ts.local_peaks(samples, ["k"], ["t"], "v", 9.0), ["k"], "t", "v", 0.8)
    assert sorted(r.t for r in peaks.collect()) == [0.3, 2.0]


def test_rallies_and_serves(spark):
    shot = "match_id long, seq long, t double, player_id int, shot_type string, court_y double"
    runs = p.rallies(table(spark, shot, [(0, i, t, 0, "forehand", 19.0) for i, t in enumerate((1.0, 2.5, 4.0, 20.0, 40.0, 41.0))]))
    assert [(r.n_shots, r.start_t, r.end_t) for r in runs.orderBy("rally_idx").collect()] == [(3, 0.5, 5.0), (2, 39.5, 42.0)]
    shots = table(spark, shot, [(0, 0, 1.0, 0, "forehand", 19.0), (0, 1, 2.0, 2, "forehand", 8.0), (0, 2, 10.0, 0, "forehand", 11.0), (0, 3, 11.0, 2, "forehand", 1.0)])
    kinds = p.marked_serves(shots, p.rallies(shots)).orderBy("seq").collect()
    assert [r.shot_type for r in kinds] == ["serve", "forehand", "forehand", "forehand"]


def play(spark, winners, golden=False, serves=None):
    serves = serves or [None] * len(winners)
    rows = [(0, i, w, s, golden) for i, (w, s) in enumerate(zip(winners, serves, strict=True))]
    return sc.scores(table(spark, "match_id long, rally_idx long, winner string, server string, golden boolean", rows)).withColumn("text", sc.score_text(F.col("sets"))).first()


def test_scores(spark):
    row = play(spark, "AAAABBA")
    assert (row.text, row.label_a, row.label_b) == ("1-0", "15", "30")
    row = play(spark, "AAABBBA")
    assert (row.label_a, row.label_b) == ("Ad", "40")
    assert play(spark, "AAABBBA", golden=True).games_a == 1
    games = "".join(w * 4 for w in "AB" * 6)
    row = play(spark, games + "A" * 7 + "B" * 4)
    assert row.text == "7-6(7-0) 0-1"
    row = play(spark, "A" * 24)
    assert row.text == "6-0" and row.pa == 0
    row = play(spark, "AAAAAAAA", serves=["B"] * 4 + ["A"] * 4)
    assert (row.breaks_a, row.chances_a, row.held_b, row.served_b, row.held_a, row.served_a) == (1, 1, 0, 1, 1, 1)
    row = play(spark, "BBBBBBBB", serves=["B"] * 4 + [None] * 4)
    assert (row.held_b, row.breaks_b, row.chances_b) == (1, 1, 1)


def test_projection_and_polygon(spark):
    h = g.homography(g.DEFAULT_CORNERS, g.COURT_CORNERS)
    back = g.homography(g.COURT_CORNERS, g.DEFAULT_CORNERS)
    one = spark.range(1)
    for (x, y), (u, v) in zip(g.DEFAULT_CORNERS, g.COURT_CORNERS, strict=True):
        a, b = g.project(h, F.lit(x), F.lit(y))
        c, d = g.project(back, a, b)
        row = one.select(a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d")).first()
        assert row.a == pytest.approx(u, abs=1e-6) and row.b == pytest.approx(v, abs=1e-6) and row.c == pytest.approx(x) and row.d == pytest.approx(y)
    with pytest.raises(ValueError):
        g.homography([(0, 0), (1, 1), (2, 2), (3, 3)], g.COURT_CORNERS)
    row = one.select(g.in_polygon(F.lit(0.5), F.lit(0.5), g.DEFAULT_CORNERS).alias("a"), g.in_polygon(F.lit(0.1), F.lit(0.4), g.DEFAULT_CORNERS).alias("b"), g.polygon_area(F.array(*map(F.lit, (0.0, 4.0, 4.0, 0.0))), F.array(*map(F.lit, (0.0, 0.0, 3.0, 3.0)))).alias("c")).first()
    assert (row.a, row.b, row.c) == (True, False, 12.0)


FOUR = np.array([[2.5, 15.0], [7.5, 15.0], [2.5, 5.0], [7.5, 5.0]])


def test_identities_survive_shuffling_and_reject_a_fifth():
    t = tr.Players()
    assert t.assign(0.0, FOUR) == [0, 1, 2, 3]
    assert t.assign(0.1, FOUR[[3, 0, 1, 2]]) == [3, 0, 1, 2]
    assert t.assign(0.2, np.vstack([FOUR, [[5.0, 15.0]]]))[4] == -1
    # a player lost for over two seconds is found again anywhere on the same half
    assert t.assign(1.0, FOUR[[0, 2, 3]]) == [0, 2, 3]
    assert t.assign(4.0, np.vstack([FOUR[0], [5.0, 11.0], FOUR[2:]])) == [0, 1, 2, 3]
    seeded = tr.Players.known(pd.DataFrame({"slot": [0, 1, 2, 3, 7], "t": 0.0, "x": [*FOUR[:, 0], 1], "y": [*FOUR[:, 1], 1]}))
    assert seeded.assign(0.1, FOUR[[3, 0, 1, 2]]) == [3, 0, 1, 2]
    # a slot that is only reserved waits for somebody new
    gap = tr.Players.known(pd.DataFrame({"slot": [2], "t": [0.0], "x": [2.5], "y": [5.0]}))
    assert np.isnan(gap.seen).tolist() == [True, True, False] and gap.assign(0.1, FOUR)[2] == 2 and len(gap.seen) == 4


def test_closer_looks_and_cuts():
    look = lambda n, slot, xy, same=(): (n, slot, xy, frozenset(same))
    start = lambda: (t := tr.Players(), t.assign(0.0, FOUR))[0]
    three, numbers = FOUR[[0, 1, 2]], [0, 1, 2]
    # the clearest look that shows nobody who is found, near enough and on the right side
    assert start().frame(0.5, three, numbers, [look(5, 3, (2.6, 5.1), {2}), look(6, 3, (7.4, 5.2)), look(7, 3, (7.5, 5.0))]) == ([0, 1, 2], [6])
    assert start().frame(0.5, three, numbers, [look(5, 3, (7.5, 9.5))]) == ([0, 1, 2], [])
    assert start().frame(0.1, three, numbers, [look(5, 3, (7.5, 7.5)), look(6, 3, (7.5, 5.0))]) == ([0, 1, 2], [])  # only the clearest is tried
    assert start().frame(0.5, FOUR, [0, 1, 2, 3], [look(5, 3, (7.5, 5.0))]) == ([0, 1, 2, 3], [])
    assert start().frame(5.5, three, numbers, [look(5, 3, (7.5, 5.0))]) == ([0, 1, 2], [])  # unseen for too long
    assert start().frame(0.5, FOUR[:2], [0, 1], [look(5, 2, (4.9, 5.0)), look(6, 3, (5.0, 5.0), {5}), look(7, 3, (7.0, 5.0))]) == ([0, 1], [5, 7])
    moved = FOUR + [[5.0, 0.0]]
    assert start().frame(0.5, moved, [0, 1, 2, 3], [])[0] == [1, -1, 3, -1] and start().frame(0.5, moved, [0, 1, 2, 3], [], True)[0] == [1, 0, 3, 2]
    # a cut holds until somebody is seen
    t = start()
    assert t.frame(0.5, np.zeros((0, 2)), [], [], True) == ([], []) and t.jumped
    assert t.frame(0.6, moved, [0, 1, 2, 3], [])[0] == [1, 0, 3, 2] and not t.jumped


def test_identities_and_ball_in_spark(spark):
    rows = [(k, t / 10, i, *map(float, FOUR[j])) for k in range(2) for t in range(5) for i, j in enumerate(np.random.default_rng(t).permutation(4))]
    found = tr.identified(table(spark, "match_id long, t double, seq int, x double, y double", rows)).collect()
    assert len(found) == 40 and len({(r.match_id, r.player_id, r.x, r.y) for r in found}) == 8
    ball = [(0, i / 30, 0.1 + 0.02 * i, 0.5) for i in range(20)] + [(0, i / 30, 0.9 + 0.001 * (i % 2), 0.1) for i in range(20)]
    track = tr.ball_track(table(spark, "match_id long, t double, x double, y double", ball)).collect()
    assert len(track) == 20 and max(r.y for r in track) == 0.5 and min(r.y for r in track) == 0.5


def body(wrist=(0.025, -0.01), cx=0.5, cy=0.5):
    pts = [(cx, cy, 1.0)] * 33
    for i, (x, y) in {0: (0, -0.1), 11: (-0.02, -0.07), 12: (0.02, -0.07), 23: (-0.015, 0), 24: (0.015, 0), 27: (-0.01, 0.08), 28: (0.01, 0.08), 15: (-0.025, -0.01), 16: wrist}.items():
        pts[i] = (cx + x, cy + y, 1.0)
    return pts


def test_swings_are_classed(spark):
    schema = "match_id long, frame_no long, t double, player_id int, court_x double, court_y double, landmarks array<struct<x:double,y:double,visibility:double>>"
    wrists = {"forehand": (0.06, -0.05), "backhand": (-0.06, -0.05), "overhead": (0.03, -0.14)}
    for kind, wrist in wrists.items():
        rest = (0.0, 0.0)
        rows = [(0, i, i / 10, 0, 5.0, 19.0, body(wrist if i == 5 else rest)) for i in range(11)]
        shots = sh.detected_shots(table(spark, schema, rows), 1.0, threshold=4.0).collect()
        assert shots and {r.shot_type for r in shots} <= {kind, "forehand"} and shots[0].shot_type == kind
        assert all(r.zone == "baseline" for r in shots)
    rows = [(0, i, i / 10, k, 5.0, 19.0 if k < 2 else 1.0, body((0.06, -0.05) if i == (5 if k == 0 else 25) else (0.0, 0.0), 0.2 + 0.2 * k)) for k in (0, 2) for i in range(31)]
    hits = table(spark, "match_id long, t double", [(0, 0.52), (0, 0.7), (0, 2.48), (0, 9.0)])
    heard = sh.heard_shots(hits, table(spark, schema, rows), 1.0, threshold=4.0).orderBy("t").collect()
    assert [(r.t, r.player_id) for r in heard] == [(0.52, 0), (2.48, 2)]
    best = sh.best_snapshot(table(spark, schema + ", interpolated boolean", [(*r, False) for r in rows])).collect()
    assert {r.player_id for r in best} == {0, 2}


def test_pictures(spark):
    w, h = 80, 60
    rows = []
    for y in range(h):
        half = 15 + (y - 12) * 20 / 40
        for x in range(w):
            court = 12 <= y < 52 and abs(x - 40) < half
            rows.append((0, 0, y, x, *((30, 90, 200) if court else (120, 120, 118))))
    corners = vi.court_corners(table(spark, "match_id long, frame_no long, y int, x int, r int, g int, b int", rows), w, h).collect()
    assert len(corners) == 1
    for (x, y), (u, v) in zip(corners[0].corners, ((25 / 80, 12 / 60), (55 / 80, 12 / 60), (74.5 / 80, 51 / 60), (5.5 / 80, 51 / 60)), strict=True):
        assert math.dist((x, y), (u, v)) < 0.03
    dark = [(0, f, y, x, 60, 60, 60) for f in (0, 1) for y in range(20) for x in range(20)]
    lit = [(*r[:4], 200, 220, 60) if r[1] == 1 and r[2] in (9, 10) and r[3] in (4, 5) else r for r in dark]
    found = vi.ball_candidates(table(spark, "match_id long, frame_no long, y int, x int, r int, g int, b int", lit), 20, 20).collect()
    assert [(r.frame_no, r.area, r.x, r.y) for r in found] == [(1, 4, 0.25, 0.5)]


def test_rules(spark):
    schema = "match_id long, share0 double, share1 double, share2 double, share3 double, calibrated boolean, ball double, confirmed double"
    rows = ru.reliability(table(spark, schema, [(0, 0.9, 0.9, 0.8, 0.8, True, None, None), (1, 0.9, 0.9, 0.2, 0.3, False, 0.1, 0.1)])).orderBy("match_id").collect()
    assert [(r.grade, r.tips) for r in rows] == [("good", []), ("fair", ["lost", "far", "corners", "ball"])]


def test_listed_says_what_it_leaves_out(spark):
    from courtflow.operators import review as rv

    rows = spark.createDataFrame([(m, i, i % 3) for m, n in ((1, 7), (2, 3), (3, 4)) for i in range(n)], "match_id long, seq long, v int")
    found = rv.listed(rows, [F.desc("v"), "seq"], 4).orderBy("match_id", "place").collect()
    assert [(r.seq, r.more) for r in found if r.match_id == 1] == [(2, 3), (5, 3), (1, 3), (4, 3)]
    assert {(r.match_id, r.more) for r in found} == {(1, 3), (2, 0), (3, 0)} and len(found) == 11
    assert rv.listed(rows.limit(0), ["seq"]).count() == 0


def test_ball_tracks_of_many_matches_need_no_table_each(spark):
    flight = lambda k: [(k, i / 30, 0.1 + 0.01 * i, 0.5 + (k or 0) / 100) for i in range(20)]
    ball = [o for k in (*range(40), None) for o in [*flight(k), (k, None, 0.5, 0.5)]]
    df = table(spark, "match_id long, t double, x double, y double", ball)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        track = tr.ball_track(df)
        assert "FlatMapGroups" not in track._jdf.queryExecution().toString()
        found = sorted(map(tuple, track.collect()), key=str)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert found == sorted(((k, i, *o[1:]) for k in (*range(40), None) for i, o in enumerate(flight(k))), key=str)


def test_identities_of_many_matches_need_no_table_each(spark):
    rows = [(k, i / 2, s, float(x), float(y)) for k in range(30) for i in range(6) for s, (x, y) in enumerate(FOUR)]
    found = tr.identified(table(spark, "match_id long, t double, seq int, x double, y double", rows))
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
    assert sorted(map(tuple, found.collect())) == [(*r, r[2]) for r in rows]


def test_tactics_of_an_analysis_find_no_shots(spark):
    from courtflow.operators import analysis
    from courtflow.plans import bodies as bd
    from courtflow.sources.surrogate import table as derived

    kept, data = [], "/root/testdata/sf0.001"
    seen = bd.landmarks(derived(spark, data, "sightings")).select("match_id", "frame_no", "t", "seq", "x", "y", "landmarks")
    a = analysis.analysed(derived(spark, data, "frames"), seen, bd.ASPECT, lambda rows, name: kept.append(name) or rows)
    a.tactics.schema  # noqa: B018
    assert kept == ["poses"]
    assert "shot_type" in a.shots.columns and "longest" not in a.rallies.columns and kept == ["poses", "shots"]
