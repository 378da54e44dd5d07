"""Streams agree with their batch forms and go on after a restart; saved matches are replaced one by one."""

import datetime as dt

import numpy as np

from courtflow.operators.tracking import ball_track, followed, identified, joined_parts, last_places, sightings, track_of_paths
from courtflow.sources.store import Checkpoint, MatchStore, checkpoint_key, valid_goals
from courtflow.streaming import live


def test_session_rallies(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    at = lambda s: start + dt.timedelta(seconds=s)
    rows = [(0, at(s)) for s in (1, 2.5, 4, 20, 40, 41)] + [(1, at(3)), (1, at(5))] + [(9, at(900))]
    spark.createDataFrame(rows, "match_id long, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("match_id long, ts timestamp").parquet(str(tmp_path / "in"))
    live.append_parquet(live.rallies(stream), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.match_id, r.n_shots) for r in found) == [(0, 2), (0, 3), (1, 2)]


def test_streamed_identities_agree_with_batch_over_a_restart(spark, tmp_path):
    four = np.array([[2.5, 15.0], [7.5, 15.0], [2.5, 5.0], [7.5, 5.0]])
    schema = "match_id long, t double, seq int, x double, y double"
    rows = [(0, t / 10, i, *map(float, four[j] + 0.01 * t)) for t in range(8) for i, j in enumerate(np.random.default_rng(t).permutation(4))]
    for part in (rows[:16], rows[16:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        live.append_parquet(live.identities(stream), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "out")).select("t", "seq", "player_id").collect()
    batch = identified(spark.createDataFrame(rows, schema)).select("t", "seq", "player_id").collect()
    assert sorted(map(tuple, streamed)) == sorted(map(tuple, batch))


def test_a_tracker_goes_on_from_saved_rows(spark, tmp_path):
    """In one piece, in two batches, and as a batch and a stream: the same identities, also where a slot is missing at the seam."""
    four = np.array([[2.5, 15.0], [7.5, 15.0], [2.5, 5.0], [7.5, 5.0]])
    schema = "match_id long, t double, seq int, x double, y double"
    rows = [(m, t / 10, i, *map(float, four[j] + 0.01 * t)) for m in (4, 5) for t in range(20) for i, j in enumerate(np.random.default_rng(t).permutation(4)) if (m, t, j) != (5, 9, 1)]
    rows += [(6, 1.5, 0, 2.5, 15.0), (7, 0.2, 0, 2.5, 15.0)]  # matches of one part only
    whole = sightings(spark.createDataFrame(rows, schema))
    saved = followed(whole.where("t < 1")).cache()
    known, rest = last_places(saved), whole.where("t >= 0.8")
    assert known.where("match_id = 5").count() == 3
    batch = joined_parts(saved, followed(rest, known))
    # three micro-batches; one match ends in the second and starts anew in the third
    again = sightings(spark.createDataFrame([(6, 0.0, 0, 7.5, 5.0)], schema))
    ends = sightings(spark.createDataFrame([], schema), ends=spark.createDataFrame([(6, 1.6)], "match_id long, t double"))
    for part in (rest.where("t < 1.4"), rest.where("t >= 1.4").unionByName(ends), again):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rest.schema).parquet(str(tmp_path / "in"))
        live.append_parquet(live.followed(stream, known), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert [tuple(r) for r in out.where("match_id = 6").orderBy("t").collect()] == [(6, 0.0, 0, 7.5, 5.0, 0), (6, 1.5, 0, 2.5, 15.0, 0)]
    streamed = joined_parts(saved, out.where("t > 0"))
    want = sorted(map(tuple, followed(whole).collect()))
    assert len(want) == len(rows)
    for got in (batch, streamed):
        assert sorted(map(tuple, got.collect())) == want


def test_streamed_ball_agrees_with_batch_over_restarts(spark, tmp_path):
    """Three flights, the last two at one time, a spot that stays, and stray candidates away from them, in three runs of the stream."""
    noise = np.random.default_rng(3)
    rows = []
    for frame in range(90):
        t = frame / 30
        rows.append((7, t, 0.9, 0.9))
        if frame < 25:
            rows.append((7, t, 0.1 + 0.02 * frame, 0.3))
        if frame >= 45:
            rows += [(7, t, 0.05 + 0.015 * (frame - 45), 0.5), (7, t, 0.6 - 0.004 * (frame - 45), 0.1)]
        if frame % 4 == 0:
            rows.append((7, t, 0.5 + 0.03 * float(noise.random()), 0.75 + 0.03 * float(noise.random())))  # a path of these travels less than the flights
        rows.append((8, t, 0.2, 0.1 + 0.008 * frame))
    schema = "match_id long, t double, x double, y double"
    for lo, hi in ((0, 0.5), (0.5, 1.7), (1.7, 9)):
        spark.createDataFrame([r for r in rows if lo <= r[1] < hi], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        live.append_parquet(live.ball_paths(stream), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    paths = spark.read.parquet(str(tmp_path / "out"))
    assert paths.count() == len(rows)
    streamed = sorted(map(tuple, track_of_paths(paths).collect()))
    assert streamed == sorted(map(tuple, ball_track(spark.createDataFrame(rows, schema)).collect()))
    kept = {(r[0], *r[2:]) for r in streamed}
    flights = {r for r in rows if r[0] == 8 or r[3] in (0.3, 0.5)}
    shorter = {r for r in rows if r[3] == 0.1 and r[0] == 7}
    assert len(flights) == 25 + 45 + 90 and flights <= kept and len(shorter) == 45 and not shorter & kept


def test_saved_matches(spark, tmp_path):
    store = MatchStore(spark, str(tmp_path / "matches"))
    schema = "title string, created_at long, me int, match_id long"
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(schema)
    assert store.list(kind).count() == 0
    store.save(spark.createDataFrame([("a", 1, 0, 1), ("b", 2, 1, 2)], schema))
    store.save(spark.createDataFrame([("c", 3, 1, 1)], schema))
    assert [(r.match_id, r.title) for r in store.list(kind).collect()] == [(1, "c"), (2, "b")]
    assert store.delete(2) and [r.match_id for r in store.list(kind).collect()] == [1]
    assert not store.delete(2) and not store.delete(77)


def test_a_store_of_many_matches_has_few_folders(spark, tmp_path):
    """Saves rewrite the buckets they touch; later columns are null in older rows; nothing staged is left."""
    from pyspark.sql.types import _parse_datatype_string

    schema = "title string, created_at long, match_id long"
    store = MatchStore(spark, str(tmp_path / "matches"), 4)
    store.save(spark.createDataFrame([(f"t{i}", i, i) for i in range(200)], schema))
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "matches").glob("*/*.parquet")}
    assert len(list((tmp_path / "matches").glob("__bucket=*"))) == 4 and len(before) == 4
    store.save(spark.createDataFrame([("new", 500, 7, 3)], f"{schema}, extra int"))
    after = {f for f in (tmp_path / "matches").glob("*/*.parquet")}
    assert len(after & set(before)) == 3 and [f.name for f in tmp_path.iterdir()] == ["matches"]
    rows = store.list(_parse_datatype_string(f"{schema}, extra int")).collect()
    assert len(rows) == 200 and tuple(rows[0]) == ("new", 500, 7, 3) and all(r.extra is None for r in rows[1:])
    assert all(store.delete(i) for i in (7, 100)) and not store.delete(7) and store.list(_parse_datatype_string(schema)).count() == 198
    store.save(spark.createDataFrame([], schema))
    one = MatchStore(spark, str(tmp_path / "one"), 1)
    one.save(spark.createDataFrame([("a", 1, 5)], schema))
    assert one.delete(5) and one.list(_parse_datatype_string(schema)).count() == 0


def test_chunks_count_only_together(spark, tmp_path):
    chunks = Checkpoint(spark, str(tmp_path / "chunks"))
    part = lambda *t: spark.createDataFrame([(x,) for x in t], "t double")
    chunks.append("k", 0, part(0.0, 0.1))
    chunks.append("k", 2, part(0.4))
    assert chunks.load("k", 3) is None
    chunks.append("k", 1, part(0.2, 0.3))
    assert sorted(r.t for r in chunks.load("k", 3).collect()) == [0.0, 0.1, 0.2, 0.3, 0.4]
    assert chunks.clear("k")
    assert checkpoint_key(spark, fps=10, start=0.10001) == checkpoint_key(spark, start=0.1, fps=10) != checkpoint_key(spark, start=0.2, fps=10)
    goals = spark.createDataFrame([("split", 15.0), ("split", 10.0), ("unknown", 1.0), ("winners", -1.0)], "metric string, target double")
    assert [(r.metric, r.target) for r in valid_goals(goals).collect()] == [("split", 10.0)]
