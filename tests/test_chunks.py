"""Sound and frames in chunks: the same as sample by sample and row by row."""

import math
import random

from courtflow.operators import audio
from courtflow.sources.store import pack_frames, unpack_frames

POSES = "match_id long, frame_no long, player_id int, court_x double, court_y double, landmarks array<struct<x: double, y: double, visibility: double>>"


def test_envelope_of_chunks_equals_that_of_samples(spark):
    r = random.Random(3)
    chunks, samples = [], []
    for m in range(4):
        at = 0
        while at < 300:
            n = r.choice([1, 1, 2, 7, 40])
            channels = [[r.uniform(-1, 1) for _ in range(n)] for _ in range(1 + m % 3)]
            chunks.append((m, at, channels))
            samples += [(m, c, at + i, v) for c, ch in enumerate(channels) for i, v in enumerate(ch)]
            at += n
    chunks.append((0, 10_000, [[]]))
    table = spark.createDataFrame(chunks, "match_id long, start long, channels array<array<double>>").repartition(3)
    rows = spark.createDataFrame(samples, "match_id long, ch int, i long, v double")
    got = {(x.match_id, x.hop): x.env for x in audio.chunk_envelope(audio.mono_chunks(table), 1000).collect()}
    want = {(x.match_id, x.hop): x.env for x in audio.envelope(audio.mono(rows), 1000).collect()}
    assert got.keys() == want.keys() and len(got) > 100 and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_no_sample_is_borrowed_over_a_gap(spark):
    table = spark.createDataFrame([(0, 0, [0.0] * 20), (0, 25, [5.0] * 20), (0, 45, [5.0] * 7)], "match_id long, start long, v array<double>")
    assert sorted((x.hop, x.env) for x in audio.chunk_envelope(table, 1000).collect()) == [(0, 0.0), (3, 0.0), (4, 0.0)]


def test_range_and_cap(spark):
    """Clicks in noiseless sound; a range leaves those within it, a file beyond the cap has none."""
    clicks = [0.5, 1.3, 1.9, 3.1, 3.6, 4.6]
    sound = [1e-4 * ((i * 7919) % 13) + (1.0 if any(abs(i / 1000 - c) < 0.0005 for c in clicks) else 0.0) for i in range(6000)]
    chunks = [(m, a, [sound[a : a + 512]]) for m in range(4) for a in range(0, 6000, 512)]
    files = [(0, 1000, 6.0, None, None), (1, 1000, 6.0, 1.0, 5.0), (2, 700_000_000, 6.0, None, None), (3, None, 6.0, 0.0, 2.0), (9, 10, 6.0, None, None)]
    found, usable = audio.heard(
        spark.createDataFrame(chunks, "match_id long, start long, channels array<array<double>>"), spark.createDataFrame(files, "match_id long, bytes long, seconds double, from_t double, to_t double"), 1000
    )
    times = {}
    for x in found.collect():
        times.setdefault(x.match_id, []).append(round(x.t, 1))
    assert sorted(times[0]) == clicks and sorted(times[1]) == clicks[1:] and sorted(times[3]) == clicks[:3] and 2 not in times
    assert {x.match_id: (x.n, x.usable) for x in usable.collect()} == {0: (6, True), 1: (5, True), 2: (0, False), 3: (3, False), 9: (0, False)}


def test_packed_frames_come_back(spark):
    r = random.Random(4)
    frames = [(m, f * 2, f / 4) for m in range(2) for f in range(23)]
    mark = lambda: (r.randrange(256) / 256, r.randrange(256) / 256, r.randrange(2) / 2)
    poses = [(m, f, p, p + 0.5, f + 0.25, [mark() for _ in range(r.choice([33, 33, 5, 40, 0]))] if p != 2 else None) for m, f, _ in frames for p in r.sample(range(-1, 4), r.randrange(0, 5))]
    packed = pack_frames(spark.createDataFrame(frames, "match_id long, frame_no long, t double"), spark.createDataFrame(poses, POSES).repartition(5), 10).cache()
    assert sorted((x.match_id, x.chunk, len(x.t)) for x in packed.collect()) == [(m, c, n) for m in range(2) for c, n in ((0, 10), (1, 10), (2, 3))]
    out_frames, out_poses = unpack_frames(packed)
    number = lambda x: x.chunk * 20 + x.place * 2
    assert sorted((x.match_id, number(x), x.t) for x in out_frames.collect()) == frames
    zeros = lambda marks: [*(marks or [])[:33], *[(0.0, 0.0, 0.0)] * (33 - len(marks or []))]
    got = sorted((x.match_id, number(x), x.player_id, x.court_x, x.court_y, [tuple(q) for q in x.landmarks]) for x in out_poses.collect())
    assert got == sorted((*p[:5], zeros(p[5])) for p in poses)
    none = pack_frames(spark.createDataFrame([], "match_id long, frame_no long, t double"), spark.createDataFrame([], POSES))
    assert none.count() == 0 and unpack_frames(none)[1].count() == 0
