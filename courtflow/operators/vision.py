"""Pixels as rows: ball candidates and court corners.

A picture is a table pixels(match_id, frame_no, y, x, r, g, b). Colours, motion,
local brightness and morphology are window expressions over its rows; only labelling
the connected blobs of one frame's mask, and choosing four corners of one hull, are
small numpy helpers run per frame.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtflow.functions.geometry import DEFAULT_CORNERS, cell, in_polygon_of
from courtflow.operators.ball import ball_color

FRAME = ["match_id", "frame_no"]
MOTION, CONTRAST, REACH, MOST_SHARE = 14, 18, 5, 0.0012


def gray(r: Column, g: Column, b: Column) -> Column:
    """Brightness in whole steps, 0..255."""
    return F.floor((r * 77 + g * 150 + b * 29) / 256).cast("int")


def box_mean(pixels: DataFrame, value: str, reach: int) -> DataFrame:
    """Adds ``mean``: the mean over the square of ``reach`` pixels to every side, smaller at the edges.

    Two passes of running sums, along rows and then along columns.
    """
    along = Window.partitionBy(*FRAME, "y").orderBy("x").rowsBetween(-reach, reach)
    down = Window.partitionBy(*FRAME, "x").orderBy("y").rowsBetween(-reach, reach)
    rows = pixels.withColumns({"__s": F.sum(value).over(along), "__n": F.count(value).over(along)})
    return rows.withColumn("mean", F.sum("__s").over(down) / F.sum("__n").over(down)).drop("__s", "__n")


def ball_mask(pixels: DataFrame) -> DataFrame:
    """Pixels that changed since the frame before and are ball-coloured or clearly brighter than around them."""
    lit = pixels.withColumn("gray", gray(F.col("r"), F.col("g"), F.col("b")))
    before = F.lag("gray").over(Window.partitionBy("match_id", "y", "x").orderBy("frame_no"))
    moved = box_mean(lit.withColumn("before", before), "gray", REACH).where(F.abs(F.col("gray") - F.col("before")) > MOTION)
    return moved.where(ball_color(F.col("r"), F.col("g"), F.col("b")) | (F.col("gray") - F.col("mean") > CONTRAST)).select(*FRAME, "y", "x")


def labels(y: np.ndarray, x: np.ndarray, diagonal: bool) -> np.ndarray:
    """A number for the connected blob of each masked pixel.

    Runs of a row are the nodes; a run and those it touches in the next row are found in
    one search over sorted run ends and united. The work grows with runs, not with how
    long or bent a blob is.
    """
    order = np.lexsort((x, y))
    ys, xs = y[order].astype(np.int64), x[order].astype(np.int64)
    first = np.concatenate([[True], (ys[1:] != ys[:-1]) | (xs[1:] > xs[:-1] + 1)])
    run = np.cumsum(first) - 1
    last = np.concatenate([first[1:], [True]])
    row, low, high = ys[first], xs[first], xs[last]
    wide = int(xs.max() - xs.min()) + 3
    at = lambda r, c: r * wide + (c - xs.min() + 1)
    reach = 1 if diagonal else 0
    begin = np.searchsorted(at(row, high), at(row + 1, low - reach), side="left")
    end = np.searchsorted(at(row, low), at(row + 1, high + reach), side="right")
    top = list(range(len(row)))

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for i, (s, e) in enumerate(zip(begin.tolist(), end.tolist(), strict=True)):
        for j in range(s, e):
            p, q = find(i), find(j)
            top[max(p, q)] = min(p, q)
    out = np.empty(len(y), dtype=np.int64)
    out[order] = np.array([find(i) for i in range(len(row))], dtype=np.int64)[run]
    return out


def ball_candidates(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """(match_id, frame_no, x, y, area): centres of small moving blobs, in shares of the picture."""
    most = max(6, MOST_SHARE * width * height)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(blob=labels(rows["y"].to_numpy(), rows["x"].to_numpy(), True))
        out = rows.groupby(["match_id", "frame_no", "blob"], as_index=False).agg(x=("x", "mean"), y=("y", "mean"), area=("x", "size"))
        out = out[out["area"] <= most]
        return out.assign(x=(out["x"] + 0.5) / width, y=(out["y"] + 0.5) / height)[["match_id", "frame_no", "x", "y", "area"]]

    return ball_mask(pixels).groupBy(*FRAME).applyInPandas(run, "match_id long, frame_no long, x double, y double, area long")


#: Cells a side into which a frame is parted to find boxes around a point.
CELLS = 8


def free_candidates(candidates: DataFrame, boxes: DataFrame, areas: DataFrame) -> DataFrame:
    """Candidates in none of their frame's boxes and inside their match's play area.

    candidates(match_id, frame_no, x, y, ...), boxes(match_id, frame_no, x0, y0, x1, y1),
    borders included, areas(match_id, area array<struct<x, y>>). A candidate meets only
    the boxes that cover its cell of the frame; a match without an area has no bounds.
    """
    cells = lambda low, high: F.explode(F.sequence(cell(F.col(low) * CELLS, CELLS), F.greatest(cell(F.col(low) * CELLS, CELLS), cell(F.col(high) * CELLS, CELLS))))
    covered = boxes.select(*FRAME, "x0", "y0", "x1", "y1").withColumn("__cx", cells("x0", "x1")).withColumn("__cy", cells("y0", "y1"))
    placed = candidates.withColumns({"__cx": cell(F.col("x") * CELLS, CELLS), "__cy": cell(F.col("y") * CELLS, CELLS)})
    on = [placed[c] == covered[c] for c in (*FRAME, "__cx", "__cy")]
    inside = placed["x"].between(covered["x0"], covered["x1"]) & placed["y"].between(covered["y0"], covered["y1"])
    free = placed.join(covered, [*on, inside], "left_anti").drop("__cx", "__cy")
    bounds = areas.select("match_id", F.col("area").alias("__area"))
    kept = free.join(bounds, "match_id", "left").where(F.col("__area").isNull() | in_polygon_of(F.col("x"), F.col("y"), F.col("__area")))
    return kept.select(*candidates.columns)


# ---- the court


def chroma(r: Column, g: Column, b: Column) -> dict[str, Column]:
    total = r + g + b + 1
    return {"cr": r / total, "cg": g / total, "lum": total / 3}


def surface_color(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """(match_id, frame_no, sr, sg, sl): upper medians of the lower middle's colour; greyish ones give no row."""
    middle = (F.col("y") >= math.floor(height * 0.6)) & (F.col("y") < height * 0.92) & (F.col("x") >= math.floor(width * 0.3)) & (F.col("x") < width * 0.7)
    every_other = ((F.col("y") - math.floor(height * 0.6)) % 2 == 0) & ((F.col("x") - math.floor(width * 0.3)) % 2 == 0)
    rows = pixels.where(middle & every_other).withColumns(chroma(F.col("r"), F.col("g"), F.col("b")))
    upper = lambda c: F.get(F.sort_array(F.collect_list(c)), F.floor(F.count("*") / 2).cast("int"))
    found = rows.groupBy(*FRAME).agg(upper("cr").alias("sr"), upper("cg").alias("sg"), upper("lum").alias("sl"))
    return found.where(F.hypot(F.col("sr") - 1 / 3, F.col("sg") - 1 / 3) >= 0.03)


def carpet_mask(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Pixels of the surface's colour, gaps of lines and net closed (dilated, then eroded)."""
    alike = (F.hypot(F.col("cr") - F.col("sr"), F.col("cg") - F.col("sg")) < 0.045) & (F.col("lum") > F.col("sl") * 0.45) & (F.col("lum") < F.col("sl") * 1.8)
    seen = pixels.withColumns(chroma(F.col("r"), F.col("g"), F.col("b"))).join(surface_color(pixels, width, height), FRAME)
    seen = seen.select(*FRAME, "y", "x", alike.cast("int").alias("on"))
    reach = max(2, round(width / 110))
    for f in (F.max, F.min):
        for across, down in (("y", "x"), ("x", "y")):
            seen = seen.withColumn("on", f("on").over(Window.partitionBy(*FRAME, across).orderBy(down).rowsBetween(-reach, reach)))
    return seen.where("on = 1").select(*FRAME, "y", "x")


def _area(p: np.ndarray) -> float:
    x, y = p[:, 0], p[:, 1]
    return abs(float(x @ np.roll(y, -1) - y @ np.roll(x, -1))) / 2


def _hull(p: np.ndarray) -> np.ndarray:
    """Convex hull in order: the lower chain, then the upper one."""

    def chain(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return out[:-1]

    points = sorted(set(map(tuple, p.tolist())))
    return np.array(chain(points) + chain(points[::-1]))


def largest_quad(hull: np.ndarray) -> np.ndarray:
    """The four points of a convex hull (in order) whose quadrilateral is largest.

    For every diagonal the farthest point on either side: as the diagonal's end moves on
    round the hull, so do both of them, so the work grows with the square of the hull.
    """
    n, best, found = len(hull), -1.0, (0, 0, 0, 0)
    x, y = hull[:, 0].tolist(), hull[:, 1].tolist()

    def off(a: int, b: int, c: int) -> float:
        return abs((x[b] - x[a]) * (y[c] - y[a]) - (y[b] - y[a]) * (x[c] - x[a]))

    for i in range(n):
        j, m = i + 1, i + 3
        for k in range(i + 2, i + n - 1):
            while j + 1 < k and off(i, k % n, (j + 1) % n) >= off(i, k % n, j % n):
                j += 1
            m = max(m, k + 1)
            while m + 1 < i + n and off(i, k % n, (m + 1) % n) >= off(i, k % n, m % n):
                m += 1
            area = off(i, k % n, j % n) + off(i, k % n, m % n)
            if area > best:
                best, found = area, (i, j % n, k % n, m % n)
    return hull[list(found)]


def largest_quads(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., area): of the point sets points(keys..., x, y) the area of the largest quadrilateral, if three points don't lie on a line."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        hull = _hull(rows[["x", "y"]].to_numpy(dtype=float))
        out = rows[keys].head(1 if len(hull) > 2 else 0)
        return out.assign(area=_area(largest_quad(hull) if len(hull) > 3 else hull) if len(out) else 0.0)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.select(*keys).schema.fields)
    return points.select(*keys, "x", "y").groupBy(*keys).applyInPandas(run, f"{fields}, area double")


def court_corners(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """(match_id, frame_no, corners): far left, far right, near right, near left in shares of the picture; [x, y] each.

    The carpet's blob under the lower middle must fill 5 to 92 % of the picture and nearly
    a quadrilateral whose far edge isn't much the wider one; else there is no row.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        y, x, none = rows["y"].to_numpy(), rows["x"].to_numpy(), pd.DataFrame(columns=["match_id", "frame_no", "corners"])
        blob = labels(y, x, False)
        at = int(np.argmin(np.maximum(np.abs(x - width // 2), np.abs(y - int(height * 0.75)))))
        y, x = y[blob == blob[at]], x[blob == blob[at]]
        if not 0.05 <= len(y) / (width * height) <= 0.92:
            return none
        hull = _hull(np.concatenate([np.stack([x, y], 1), np.stack([x + 1, y], 1)]).astype(float))
        if len(hull) < 4 or _area(quad := largest_quad(hull)) < 0.85 * _area(hull):
            return none
        quad = quad[np.argsort(quad[:, 1], kind="stable")] / [width, height]
        far, near = (q[np.argsort(q[:, 0])] for q in (quad[:2], quad[2:]))
        spans = far[1, 0] - far[0, 0], near[1, 0] - near[0, 0]
        if min(spans) <= 0 or spans[0] > 1.15 * spans[1]:
            return none
        corners = [far[0], far[1], near[1], near[0]]
        return pd.DataFrame({"match_id": [rows["match_id"].iloc[0]], "frame_no": [rows["frame_no"].iloc[0]], "corners": [[c.tolist() for c in corners]]})

    return carpet_mask(pixels, width, height).groupBy(*FRAME).applyInPandas(run, "match_id long, frame_no long, corners array<array<double>>")


# ---- parts of the picture


def bands(corners=DEFAULT_CORNERS, aspect: float = 16 / 9, net_y: float | None = None, overlap: float = 0.15) -> list[tuple[float, float, float, float]]:
    """Overlapping tiles (x, y, w, h) for the far and the near half of the court, about square each, three at most in a row."""
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    net = net_y if net_y is not None else (min(ys) + max(ys)) / 2
    far, near = max(net - min(ys), 0.02), max(max(ys) - net, 0.02)
    clamp = lambda v: min(1.0, max(0.0, v))
    pad = (max(xs) - min(xs)) * 0.06
    left, right = clamp(min(xs) - pad), clamp(max(xs) + pad)
    tiles = []
    for top, bottom in ((clamp(min(ys) - far * 1.1), clamp(net + near * 0.12)), (clamp(net - far * 0.9), clamp(max(ys) + near * 0.08))):
        n = min(3, max(1, math.floor((right - left) * aspect / (bottom - top) + 0.5)))
        step = (right - left) / n
        for i in range(n):
            a, b = clamp(left + (i - overlap) * step), clamp(left + (i + 1 + overlap) * step)
            tiles.append((a, top, b - a, bottom - top))
    return tiles


def photo_crop(x: Column, y: Column, w: Column, h: Column, aspect: float) -> tuple[Column, Column, Column, Column]:
    """A 3:4 crop around a box, moved inside the picture (all in shares, ``aspect`` is the picture's)."""
    high = F.least(F.lit(1.0), F.greatest(h, w * aspect * 4 / 3))
    wide = F.least(F.lit(1.0), high * 0.75 / aspect)
    inside = lambda c, size: F.greatest(F.lit(0.0), F.least(c - size / 2, 1 - size))
    return inside(x + w / 2, wide), inside(y + h / 2, high), wide, high
