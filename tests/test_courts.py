"""Courts of matches: solved against numpy, tiles and crops as facts, candidates outside boxes and inside the area."""

import math

import numpy as np
from pyspark.sql import functions as F

from courtflow.functions import geometry as g
from courtflow.operators import court, vision

CORNERS = "match_id long, corners array<struct<x: double, y: double>>"


def corner_table(spark, rows):
    return spark.createDataFrame([(i, [(float(x), float(y)) for x, y in c] if c is not None else None) for i, c in enumerate(rows)], CORNERS)


def test_homographies_of_rows_agree_with_the_solver(spark):
    r = np.random.default_rng(4)
    quads = [np.array(g.DEFAULT_CORNERS) + r.uniform(-0.04, 0.04, (4, 2)) for _ in range(20)]
    line = [(k / 4, k / 4) for k in range(4)]
    rows = corner_table(spark, [*quads, line, None, [(0.5, 0.5)] * 4])
    got = {x.match_id: x for x in court.calibrated(rows).collect()}
    for i, quad in enumerate(quads):
        assert np.allclose(got[i].to_court, g.homography(quad, g.COURT_CORNERS), rtol=1e-9)
        assert np.allclose(got[i].to_image, g.homography(g.COURT_CORNERS, quad), rtol=1e-9)
    assert all(got[i].to_court is None and got[i].to_image is None for i in (20, 21, 22))


def test_corners_and_centre_map_to_the_court(spark):
    c = court.calibrated(corner_table(spark, [g.DEFAULT_CORNERS]))
    places = [*g.DEFAULT_CORNERS, (0.5, 0.3)]
    out = c.select(*[F.struct(*[v.alias(n) for n, v in zip("xy", g.project(F.col("to_court"), F.lit(x), F.lit(y)), strict=True)]).alias(f"p{i}") for i, (x, y) in enumerate(places)]).first()
    want = [*g.COURT_CORNERS, (5, 0)]
    assert all(math.isclose(p.x, x, abs_tol=1e-9) and math.isclose(p.y, y, abs_tol=1e-9) for p, (x, y) in zip(out, want, strict=True))


def test_elimination_swaps_rows(spark):
    table = spark.createDataFrame([(1, [[0.0, 2.0, 4.0], [3.0, 1.0, 5.0]]), (2, [[1.0, 2.0, 3.0], [2.0, 4.0, 1.0]]), (3, None)], "k int, m array<array<double>>")
    got = {r.k: r.x for r in table.select("k", g.solve_linear(F.col("m"), 2).alias("x")).collect()}
    assert np.allclose(got[1], [1, 2]) and None in (got[2] or [None]) and got[3] in (None, [None, None])


def test_tiles_cover_both_halves(spark):
    """Far tiles reach above the far line, near ones below it; neighbours overlap; nothing leaves the picture."""
    courts = court.calibrated(corner_table(spark, [g.DEFAULT_CORNERS, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)], None]))
    rows = court.match_tiles(courts, 16 / 9).orderBy("match_id", "tile").collect()
    assert {r.match_id for r in rows} == {0, 1}
    for m in (0, 1):
        own = [r for r in rows if r.match_id == m]
        assert [r.tile for r in own] == list(range(len(own))) and 2 <= len(own) <= 6
        assert all(0 <= r.x and r.x + r.w <= 1 + 1e-12 and 0 <= r.y and r.y + r.h <= 1 + 1e-12 for r in own)
        bands = sorted({r.y for r in own})
        assert len(bands) == 2 or m == 1
        for a, b in zip(own[:-1], own[1:], strict=True):
            assert b.y != a.y or b.x < a.x + a.w
    assert min(r.y for r in rows if r.match_id == 0) < 0.3


def test_play_area_and_focus(spark):
    courts = court.calibrated(corner_table(spark, [g.DEFAULT_CORNERS]))
    area = F.col("area")
    inside = lambda x, y: g.in_polygon_of(F.lit(x), F.lit(y), area)
    crop = lambda x, y: court.focus_tile(F.col("to_image"), F.lit(x), F.lit(y), 16 / 9)
    r = courts.withColumn("area", court.play_area(F.col("corners"), 16 / 9)).select(
        inside(0.5, 0.6).alias("middle"), inside(0.5, 0.2).alias("head"), inside(0.5, 0.02).alias("crowd"), inside(0.02, 0.4).alias("aside"), crop(5.0, 1.0).alias("far"), crop(5.0, 19.0).alias("near")
    ).first()
    assert (r.middle, r.head, r.crowd, r.aside) == (True, True, False, False)
    assert r.far.h < r.near.h and all(0 <= c.x <= 1 - c.w and 0 <= c.y <= 1 - c.h for c in (r.far, r.near)) and math.isclose(r.far.w * 16 / 9, r.far.h)


def test_polygons_of_rows(spark):
    shape = [(0.1, 0.1), (0.9, 0.1), (0.9, 0.9), (0.5, 0.4), (0.1, 0.9)]
    r = np.random.default_rng(1)
    pts = [(float(x), float(y)) for x, y in r.uniform(0, 1, (300, 2))]
    rows = spark.createDataFrame([(x, y, shape) for x, y in pts], "x double, y double, p array<struct<x: double, y: double>>")
    got = rows.select(g.in_polygon_of(F.col("x"), F.col("y"), F.col("p")).alias("of"), g.in_polygon(F.col("x"), F.col("y"), shape).alias("fixed")).collect()
    assert all(x.of == x.fixed for x in got) and 50 < sum(x.of for x in got) < 200


def test_free_candidates(spark):
    """By brute force: boxes of the same frame only, also ones that stick out of the picture or cover much of it."""
    r = np.random.default_rng(2)
    pts = [(int(m), int(f), float(x), float(y), 3) for m, f, x, y in zip(r.integers(0, 3, 400), r.integers(0, 4, 400), r.uniform(0, 1, 400), r.uniform(0, 1, 400), strict=True)]
    pts += pts[:3] + [(0, 0, 1.0, 1.0, 1), (0, 0, 0.0, 0.0, 1)]
    boxes = [(int(m), int(f), float(x), float(y), float(x + w), float(y + h)) for m, f, x, y, w, h in zip(r.integers(0, 3, 20), r.integers(0, 4, 20), r.uniform(-0.2, 1, 20), r.uniform(-0.2, 1, 20), r.uniform(0, 0.6, 20), r.uniform(0, 0.6, 20), strict=True)]
    boxes += [(0, 0, 0.0, 0.0, 0.0, 0.0), boxes[0]]
    area = [(0.05, 0.05), (0.95, 0.1), (0.8, 0.9), (0.1, 0.8)]
    areas = spark.createDataFrame([(0, area), (1, None)], "match_id long, area array<struct<x: double, y: double>>")
    c = spark.createDataFrame(pts, "match_id long, frame_no long, x double, y double, area long")
    b = spark.createDataFrame(boxes, "match_id long, frame_no long, x0 double, y0 double, x1 double, y1 double")
    got = sorted(map(tuple, vision.free_candidates(c, b, areas).collect()))

    def in_area(x, y):
        inside = False
        for (ax, ay), (bx, by) in zip(area, [area[-1], *area[:-1]], strict=True):
            inside ^= (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax
        return inside

    want = sorted(p for p in pts if not any(p[:2] == q[:2] and q[2] <= p[2] <= q[4] and q[3] <= p[3] <= q[5] for q in boxes) and (p[0] != 0 or in_area(p[2], p[3])))
    assert got == want and 50 < len(want) < len(pts) - 50


def test_poses_of_a_tile_reach_the_court(spark):
    courts = court.calibrated(corner_table(spark, [g.DEFAULT_CORNERS, None]))
    tile = (0.25, 0.2, 0.5, 0.7)
    foot = ((0.5 - tile[0]) / tile[2], (0.3 - tile[1]) / tile[3])
    body = [(foot[0], foot[1] - 0.2, 1.0)] * 27 + [(foot[0], foot[1], 1.0)] * 2 + [(foot[0], foot[1] - 0.1, 0.5)] * 4
    away = [(0.5, -3.0, 1.0)] * 33
    rows = spark.createDataFrame([(0, 1, body, tile), (0, 2, away, tile), (1, 3, body, tile), (7, 4, body, tile)], "match_id long, k int, landmarks array<struct<x: double, y: double, visibility: double>>, tile struct<x: double, y: double, w: double, h: double>")
    (r,) = court.seen_poses(rows, courts).collect()
    assert r.k == 1 and math.isclose(r.court_x, 5, abs_tol=1e-9) and abs(r.court_y) < 1e-9 and math.isclose(r.quality, 1.0) and math.isclose(r.landmarks[27].y, 0.3)


def test_blobs_by_runs_agree_with_spreading():
    def spread(y, x, diagonal):
        """Blobs as sets of places, one flood at a time."""
        steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (diagonal or abs(a) + abs(b) == 1) and (a or b)]
        left, blobs = set(zip(y.tolist(), x.tolist(), strict=True)), set()
        while left:
            todo, blob = [left.pop()], set()
            while todo:
                p = todo.pop()
                blob.add(p)
                near = {(p[0] + a, p[1] + b) for a, b in steps} & left
                left -= near
                todo += near
            blobs.add(frozenset(blob))
        return blobs

    r = np.random.default_rng(7)
    for share in (0.05, 0.3, 0.5, 0.6, 0.95):
        for _ in range(20):
            y, x = np.nonzero(r.random((r.integers(1, 15), r.integers(1, 15))) < share)
            if not len(y):
                continue
            order = r.permutation(len(y))
            y, x = y[order], x[order] + int(r.integers(0, 5))
            for diagonal in (False, True):
                got = vision.labels(y, x, diagonal)
                assert {frozenset((int(a), int(b)) for a, b in zip(y[got == k], x[got == k], strict=True)) for k in np.unique(got)} == spread(y, x, diagonal)
    # a spiral of one pixel's width is one blob
    grid = np.zeros((61, 61), bool)
    for k in range(0, 30, 2):
        grid[k, max(k - 1, 0) : 61 - k], grid[k : 61 - k, 60 - k], grid[60 - k, k : 61 - k], grid[k + 2 : 61 - k, k] = True, True, True, True
    y, x = np.nonzero(grid)
    assert len(np.unique(vision.labels(y, x, False))) == 1


def test_largest_quads_agree_with_every_choice():
    from itertools import combinations

    r = np.random.default_rng(8)
    for n in (4, 5, 6, 9, 30, 60):
        for _ in range(5):
            pts = r.normal(size=(n, 2)) * [3, 1] if n < 30 else np.stack([np.cos(a := r.uniform(0, 6.3, n)), np.sin(a)], 1) * [2, 1]
            hull = vision._hull(pts)
            if len(hull) < 4:
                continue
            some = hull if len(hull) <= 25 else hull[np.sort(r.choice(len(hull), 25, replace=False))]
            best = max(vision._area(some[list(c)]) for c in combinations(range(len(some)), 4))
            assert math.isclose(vision._area(vision.largest_quad(some)), best, rel_tol=1e-12)


def test_corners_of_a_drawn_court(spark):
    """A blue trapezoid with a white line across, on grey: its corners to a pixel."""
    wide, high = 64, 36
    left, right = (lambda y: 20 - 14 * (y - 8) / 24), (lambda y: 44 + 14 * (y - 8) / 24)
    rows = []
    for y in range(high):
        for x in range(wide):
            on = 8 <= y <= 32 and left(y) <= x <= right(y)
            rows.append((1, 0, y, x, *((240, 240, 240) if on and y == 20 else (30, 90, 190) if on else (80, 80, 80))))
    table = spark.createDataFrame(rows, "match_id long, frame_no long, y int, x int, r int, g int, b int")
    (found,) = vision.court_corners(table, wide, high).collect()
    want = [(20 / wide, 8 / high), (45 / wide, 8 / high), (59 / wide, 32 / high), (6 / wide, 32 / high)]
    assert all(abs(a - b) <= 2 / high for p, q in zip(found.corners, want, strict=True) for a, b in zip(p, q, strict=True))


def test_a_homography_is_solved_once_a_row(spark):
    """The elimination stands once in the plan: what names its result twice must not solve it again for each coefficient."""
    h = corner_table(spark, [g.DEFAULT_CORNERS]).select(g.image_to_court(F.col("corners")).alias("h"))
    plan = h._jdf.queryExecution().analyzed().toString()
    assert plan.count("1.0E-12") == 1  # the least pivot
    assert np.allclose(h.first().h, g.homography(g.DEFAULT_CORNERS, g.COURT_CORNERS), rtol=1e-9)


def test_poses_in_metres_join_before_landmarks_are_made(spark, tmp_path):
    """What the join carries are a body's columns, not its 33 landmarks."""
    from courtflow.plans.registry import QUERIES

    events = "id as event_id, timestamp_seconds(id) as ts, id % 7 as user_id, 'click' as event_type, id % 500 * 1.0D as value"
    spark.range(800).selectExpr(*events.split(", ")).write.parquet(str(tmp_path / "events.parquet"))
    plan = QUERIES["poses_in_metres"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Join Inner", 1)
    assert "landmarks" in above and "landmarks" not in below
