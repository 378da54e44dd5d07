"""Court geometry as Column functions; positions are metres on a 10 x 20 court, the net at y = 10."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

WIDTH, LENGTH, NET_Y = 10, 20, 10.0
#: Corners of an uncalibrated picture: far left, far right, near right, near left.
DEFAULT_CORNERS = ((0.3, 0.3), (0.7, 0.3), (0.95, 0.95), (0.05, 0.95))
COURT_CORNERS = ((0.0, 0.0), (10.0, 0.0), (10.0, 20.0), (0.0, 20.0))
SERVICE_LINE = 6.95


def net_distance(y: Column) -> Column:
    return F.abs(y - NET_Y)


def zone(y: Column) -> Column:
    """net, transition or baseline by the distance from the net."""
    d = net_distance(y)
    return F.when(d < 4, "net").when(d < SERVICE_LINE + 1, "transition").otherwise("baseline")


def depth_band(d: Column) -> Column:
    """net, mid or back, the coarser bands of pair positions."""
    return F.when(d < 4, "net").when(d < 7.5, "mid").otherwise("back")


def pair_pattern(y1: Column, y2: Column) -> Column:
    """net, mid, back, split or staggered from two partners' positions."""
    a, b = depth_band(net_distance(y1)), depth_band(net_distance(y2))
    apart = F.array_sort(F.array(a, b)) == F.array(F.lit("back"), F.lit("net"))
    return F.when(a == b, a).when(apart, "split").otherwise("staggered")


def on_court(x: Column, y: Column, margin: float = 2.0) -> Column:
    """Strictly within the court widened by a margin."""
    return (x > -margin) & (x < WIDTH + margin) & (y > -margin) & (y < LENGTH + margin)


def team(player_id: Column) -> Column:
    return F.when(player_id < 2, "A").otherwise("B")


def slot_tag(player_id: Column) -> Column:
    """Team and place in it: A1, A2, B1, B2."""
    return F.concat(team(player_id), (player_id % 2 + 1).cast("string"))


def player_name(names: Column, player_id: Column) -> Column:
    """The name given to a slot, or its tag where that is missing or blank."""
    given = F.trim(F.element_at(names, player_id))
    return F.coalesce(F.when(given != "", given), slot_tag(player_id))


def js_round(x: Column, digits: int = 0) -> Column:
    """Rounds halves up, also below zero."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def cell(v: Column, size: int) -> Column:
    """The unit cell of a coordinate, clamped to 0..size-1."""
    return F.least(F.lit(size - 1), F.greatest(F.lit(0), F.floor(v))).cast("int")


def homography(source: Sequence[Sequence[float]], target: Sequence[Sequence[float]]) -> list[float]:
    """The nine coefficients (the last is 1) that map four points to four others; degenerate corners raise ValueError."""
    rows, right = [], []
    for (x, y), (u, v) in zip(source, target, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    matrix = np.array(rows, dtype=float)
    if abs(np.linalg.det(matrix)) < 1e-12:
        raise ValueError("the corners lie on a line")
    return [*np.linalg.solve(matrix, np.array(right, dtype=float)).tolist(), 1.0]


PIVOT = 1e-12


def bound(value: Column, kind: str, f: Callable[[Column], Column]) -> Column:
    """f(value), of the SQL type ``kind``, with value evaluated once however often f names it: a fold over a list of one."""
    return F.aggregate(F.array(value), F.lit(None).cast(kind), lambda _, v: f(v))


def solve_linear(rows: Column, n: int) -> Column:
    """The solution of n linear equations given as n rows of n + 1 numbers (array<array<double>>), null if they are degenerate.

    Elimination with partial pivoting as a fold over the columns, so that every row of a
    table can bring equations of its own.
    """
    at = lambda m, i, j: F.get(F.get(m, i), j)
    grid = "array<array<double>>"

    def step(m: Column, c: Column) -> Column:
        # of equal pivots the first row's
        best = F.array_max(F.transform(F.sequence(c, F.lit(n - 1)), lambda r: F.struct(F.abs(at(m, r, c)).alias("size"), (-r).alias("minus"))))

        def pivoted(p: Column) -> Column:
            top = -p["minus"]
            swapped = F.transform(m, lambda row, i: F.when(i == c, F.get(m, top)).when(i == top, F.get(m, c)).otherwise(row))
            clear = lambda s: F.transform(s, lambda row, i: F.when(i == c, row).otherwise(F.zip_with(row, F.get(s, c), lambda a, b: a - F.get(row, c) / at(s, c, c) * b)))
            return F.when(p["size"] >= PIVOT, bound(swapped, grid, clear))

        return bound(best, grid, pivoted)

    last = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), rows.cast(grid), step)
    return bound(last, "array<double>", lambda m: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: at(m, i, F.lit(n)) / at(m, i, i)))


def points(corners: Sequence[Sequence[float]]) -> Column:
    """Fixed points as an array of structs (x, y)."""
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in corners])


def homographies(source: Column, target: Column) -> Column:
    """The nine coefficients (the last is 1) that map four points to four others, both array<struct<x, y>>; null if there are none.

    The column form of ``homography``: corners belong to a match, so each row has its own.
    """
    rows = []
    for i in range(4):
        p, q = F.get(source, F.lit(i)), F.get(target, F.lit(i))
        for own, row in ((q["x"], [p["x"], p["y"], 1, 0, 0, 0]), (q["y"], [0, 0, 0, p["x"], p["y"], 1])):
            rows.append(F.array(*[(c if isinstance(c, Column) else F.lit(float(c))) for c in row], -own * p["x"], -own * p["y"], own))
    return bound(solve_linear(F.array(*rows), 8), "array<double>", lambda h: F.when(F.forall(h, lambda v: v.isNotNull()), F.concat(h, F.array(F.lit(1.0)))))


def image_to_court(corners: Column) -> Column:
    return homographies(corners, points(COURT_CORNERS))


def court_to_image(corners: Column) -> Column:
    return homographies(points(COURT_CORNERS), corners)


def project(h: Sequence[float] | Column, x: Column, y: Column) -> tuple[Column, Column]:
    """Applies a homography, nine numbers or an array column of them, to a point."""
    w = x * h[6] + y * h[7] + h[8]
    return (x * h[0] + y * h[1] + h[2]) / w, (x * h[3] + y * h[4] + h[5]) / w


def polygon_area(xs: Column, ys: Column) -> Column:
    """Shoelace area of a polygon given as two arrays."""
    n = F.size(xs)
    at = lambda a, i: F.get(a, i % n)
    twice = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda t, i: t + at(xs, i) * at(ys, i + 1) - at(xs, i + 1) * at(ys, i))
    return F.abs(twice) / 2


def in_polygon(x: Column, y: Column, polygon: Sequence[Sequence[float]]) -> Column:
    """Ray casting against a fixed polygon, edge by edge."""
    inside = F.lit(False)
    for (ax, ay), (bx, by) in zip(polygon, [*polygon[-1:], *polygon[:-1]], strict=True):
        if ay == by:
            continue
        crosses = ((F.lit(float(ay)) > y) != (F.lit(float(by)) > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
        inside = inside != crosses
    return inside


def in_polygon_of(x: Column, y: Column, polygon: Column) -> Column:
    """Ray casting against a polygon of the row, array<struct<x, y>>."""
    n = F.size(polygon)

    def crossed(inside: Column, i: Column) -> Column:
        a, b = F.get(polygon, i), F.get(polygon, (i + n - 1) % n)
        at = (b["x"] - a["x"]) * F.try_divide(y - a["y"], b["y"] - a["y"]) + a["x"]
        return inside != (((a["y"] > y) != (b["y"] > y)) & F.coalesce(x < at, F.lit(False)))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(False), crossed)


def court_lines() -> list[tuple[float, float, float, float]]:
    """Segments of the court's lines: borders, net, service lines, centre line."""
    far, near = NET_Y - SERVICE_LINE, NET_Y + SERVICE_LINE
    corners = [*COURT_CORNERS, COURT_CORNERS[0]]
    borders = [(*a, *b) for a, b in zip(corners[:-1], corners[1:], strict=True)]
    return [*borders, (0, NET_Y, WIDTH, NET_Y), (0, far, WIDTH, far), (0, near, WIDTH, near), (WIDTH / 2, far, WIDTH / 2, near)]
