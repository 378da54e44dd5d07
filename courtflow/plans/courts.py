"""Queries on courts that belong to matches: homographies, play areas, tiles, crops, poses in metres, free ball candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtflow.functions import geometry as g
from courtflow.operators import court as co
from courtflow.operators import vision as vi
from courtflow.plans import bodies as bo
from courtflow.plans import pictures as pi
from courtflow.plans.shared import query, r6, s6
from courtflow.sources.surrogate import with_tables

ASPECT = 1.5
#: Where the surrogate bodies were seen: a tile of the picture.
TILE = (0.0, 0.2, 0.9, 0.7)


def courts(corners):
    """Calibrated courts of the corner table, a column for each coordinate there."""
    at = [F.struct(F.col(f"{c}x").alias("x"), F.col(f"{c}y").alias("y")) for c in ("fl", "fr", "nr", "nl")]
    return co.calibrated(corners.select("match_id", F.array(*at).alias("corners")))


@query("corners")
def match_homographies(corners):
    """Each match's homography and where the middle of the picture lies on its court; null where corners are degenerate."""
    c = courts(corners)
    x, y = g.project(F.col("to_court"), F.lit(0.5), F.lit(0.6))
    back_x, back_y = g.project(F.col("to_image"), x, y)
    h = [r6(F.get("to_court", F.lit(i)), f"h{i}") for i in range(8)]
    return c.select("match_id", *h, r6(x, "x"), r6(y, "y"), r6(back_x, "back_x"), r6(back_y, "back_y"))


@query("corners")
def play_areas(corners):
    area = courts(corners).withColumn("area", co.play_area(F.col("corners"), ASPECT))
    size = g.polygon_area(F.col("area.x"), F.col("area.y"))
    return area.select("match_id", r6(size, "size"), *[r6(F.get("area", F.lit(i))[c], f"{c}{i}") for i in range(4) for c in "xy"])


@query("corners")
def match_tiles(corners):
    return co.match_tiles(courts(corners), ASPECT).select("match_id", "tile", *[r6(c) for c in "xywh"])


@query("corners")
def projected_lines(corners):
    """In thousandths of the picture: in shares, corners lie halfway between two values of six places."""
    return co.projected_lines(courts(corners)).select("match_id", "line", *[r6(F.col(c) * 1000, c) for c in ("x0", "y0", "x1", "y1")])


@query("corners", "poses")
def focus_crops(corners, poses):
    """The crop in which each player would be looked for again."""
    met = poses.join(courts(corners).where("to_image is not null"), "match_id").where(g.on_court(F.col("court_x"), F.col("court_y")))
    crop = co.focus_tile(F.col("to_image"), F.col("court_x"), F.col("court_y"), ASPECT)
    return met.withColumn("crop", crop).select("match_id", "frame_no", "player_id", *[r6(F.col(f"crop.{c}"), c) for c in "xywh"])


@query("corners", "bodies")
def poses_in_metres(corners, bodies):
    """Bodies seen in a tile, as poses of the picture whose feet are on their match's court."""
    tile = F.struct(*[F.lit(v).alias(c) for c, v in zip("xywh", TILE, strict=True)])
    met = co.on_own_court(bodies, courts(corners))
    tiled = bo.landmarks(met).select("match_id", "frame_no", "player_id", "to_court", "landmarks", tile.alias("tile"))
    seen = co.seen_poses(tiled)
    return seen.select("match_id", "frame_no", "player_id", r6("quality"), r6("court_x"), r6("court_y"), r6(F.get("landmarks", F.lit(0))["y"], "nose_y"))


@query("corners", "pixels", "bodies")
def free_candidates(corners, pixels, bodies):
    """Moving blobs that are in no player's padded box and inside the play area."""
    blobs = vi.ball_candidates(pixels, pi.WIDE, pi.HIGH)
    boxes = bo.boxes(bodies)
    areas = courts(corners).select("match_id", co.play_area(F.col("corners"), ASPECT).alias("area"))
    return vi.free_candidates(blobs, boxes, areas).select("match_id", "frame_no", r6("x"), r6("y"), "area")


_names = "match_homographies projected_lines play_areas match_tiles focus_crops poses_in_metres free_candidates"
QUERIES = {n: globals()[n] for n in _names.split()}

# the unit square's mapping to a quadrilateral in closed form, its inverse, and both in metres
_TURN = lambda a, b, c: f"abs(({b}x - {a}x) * ({c}y - {a}y) - ({b}y - {a}y) * ({c}x - {a}x))"
SOUND = f"greatest({_TURN('fl', 'fr', 'nr')}, {_TURN('fr', 'nr', 'nl')}, {_TURN('nr', 'nl', 'fl')}, {_TURN('nl', 'fl', 'fr')}) > 1e-9"
COURTS = f"""sums as (select *, frx - nrx as dx1, fry - nry as dy1, nlx - nrx as dx2, nly - nry as dy2, flx - frx + nrx - nlx as sx, fly - fry + nry - nly as sy,
  {SOUND} as sound from corners),
bent as (select *, (sx * dy2 - dx2 * sy) / (dx1 * dy2 - dx2 * dy1) as g, (dx1 * sy - sx * dy1) / (dx1 * dy2 - dx2 * dy1) as h from sums),
square as (select *, frx - flx + g * frx as a, nlx - flx + h * nlx as b, flx as c, fry - fly + g * fry as d, nly - fly + h * nly as e, fly as f from bent),
adjoint as (select *, e - f * h as ia, c * h - b as ib, b * f - c * e as ic, f * g - d as id, a - c * g as ie, c * d - a * f as if_, d * h - e * g as ig, b * g - a * h as ih, a * e - b * d as ii from square),
solved as (select *, (e * 0.5::double + f) / (h * 0.5::double + 1) as net0, (d + e * 0.5::double + f) / (g + h * 0.5::double + 1) as net1 from adjoint)"""
_TO = lambda x, y: (f"10 * (ia * {x} + ib * {y} + ic) / (ig * {x} + ih * {y} + ii)", f"20 * (id * {x} + ie * {y} + if_) / (ig * {x} + ih * {y} + ii)")
_BACK = lambda u, v: (f"(a * {u} + b * {v} + c) / (g * {u} + h * {v} + 1)", f"(d * {u} + e * {v} + f) / (g * {u} + h * {v} + 1)")
_MID = _TO("0.5::double", "0.6::double")
_AREA = f"""areas as (select match_id, flx - far * {co.SIDE_ROOM} / {ASPECT} as x0, fly - far * {co.HEADROOM} as y0, frx + far * {co.SIDE_ROOM} / {ASPECT} as x1, fry - far * {co.HEADROOM} as y1,
  nrx + near * {co.SIDE_ROOM} / {ASPECT} as x2, nry + near * {co.NEAR_ROOM} as y2, nlx - near * {co.SIDE_ROOM} / {ASPECT} as x3, nly + near * {co.NEAR_ROOM} as y3
  from (select *, sqrt(power((frx - flx) * {ASPECT}::double, 2) + power(fry - fly, 2)) / 10 as far, sqrt(power((nrx - nlx) * {ASPECT}::double, 2) + power(nry - nly, 2)) / 10 as near from corners))"""
_CLAMP = lambda v: f"least(1::double, greatest(0::double, {v}))"
_TILES = f"""{COURTS}, spans as (select match_id, (net0 + net1) / 2 as net, least(flx, frx, nrx, nlx) as l, greatest(flx, frx, nrx, nlx) as r, least(fly, fry, nry, nly) as t, greatest(fly, fry, nry, nly) as b from solved where sound),
depths as (select *, greatest(net - t, 0.02::double) as far, greatest(b - net, 0.02::double) as near, {_CLAMP('l - (r - l) * 0.06::double')} as x0, {_CLAMP('r + (r - l) * 0.06::double')} as x1 from spans),
strips as (select match_id, 0 as half, x0, x1, {_CLAMP('t - far * 1.1::double')} as top, {_CLAMP('net + near * 0.12::double')} as bottom from depths
  union all select match_id, 1, x0, x1, {_CLAMP('net - far * 0.9::double')}, {_CLAMP('b + near * 0.08::double')} from depths),
cut as (select *, least(3, greatest(1, floor((x1 - x0) * {ASPECT} / (bottom - top) + 0.5)))::integer as n from strips),
dealt as (select *, (x1 - x0) / n as step, unnest(range(n)) as i from cut),
ends as (select *, {_CLAMP('x0 + (i - 0.15::double) * step')} as lo, {_CLAMP('x0 + (i + 1.15::double) * step')} as hi from dealt)"""
_FEET_X, _FEET_Y = f"({TILE[0]}::double + cx * {TILE[2]}::double)", f"({TILE[1]}::double + (cy + 0.08::double) * {TILE[3]}::double)"
_ON = _TO(_FEET_X, _FEET_Y)
_ACROSS = lambda i, j: f"(case when (y{i} > y) <> (y{j} > y) and x < (x{j} - x{i}) * (y - y{i}) / nullif(y{j} - y{i}, 0) + x{i} then 1 else 0 end)"
_SIDE = f"least(1::double, greatest({co.LEAST_CROP}::double, tall * {co.CROP_HEIGHTS}::double))"

ORACLE_SQL = {
    "match_homographies": with_tables(
        f""", {COURTS}, m as (select *, {_MID[0]} as x, {_MID[1]} as y from solved where sound)
        select match_id, {', '.join(f'{s6(v)} as h{i}' for i, v in enumerate(('10 * ia / ii', '10 * ib / ii', '10 * ic / ii', '20 * id / ii', '20 * ie / ii', '20 * if_ / ii', 'ig / ii', 'ih / ii')))},
          {s6('x')} as x, {s6('y')} as y, {s6('0.5::double')} as back_x, {s6('0.6::double')} as back_y from m
        union all select match_id, {', '.join(['null'] * 12)} from solved where not sound""", "corners"),
    "projected_lines": with_tables(
        f""", {COURTS}, lines(line, u0, v0, u1, v1) as (values {', '.join(f"({i}, {', '.join(f'{u / 10}::double, {v / 20}::double' for u, v in (line[:2], line[2:]))})" for i, line in enumerate(g.court_lines()))})
        select match_id, line, {', '.join(f'{s6(f"({v}) * 1000")} as {c}{i}' for i in range(2) for c, v in zip('xy', _BACK(f'u{i}', f'v{i}')))} from solved cross join lines where sound""", "corners"),
    "play_areas": with_tables(
        f""", {_AREA} select match_id, {s6('abs(x0 * y1 - x1 * y0 + x1 * y2 - x2 * y1 + x2 * y3 - x3 * y2 + x3 * y0 - x0 * y3) / 2')} as size, {', '.join(f'{s6(f"{c}{i}")} as {c}{i}' for i in range(4) for c in 'xy')} from areas""", "corners"),
    "match_tiles": with_tables(
        f""", {_TILES} select match_id, (row_number() over (partition by match_id order by half, i) - 1)::integer as tile, {s6('lo')} as x, {s6('top')} as y, {s6('hi - lo')} as w, {s6('bottom - top')} as h from ends""", "corners"),
    "focus_crops": with_tables(
        f""", {COURTS}, p as (select p.match_id, p.frame_no, p.player_id, p.court_x / 10 as u, p.court_y / 20 as v, (p.court_x + 1) / 10 as u1, s.* exclude (match_id) from poses p join solved s using (match_id) where sound and court_x > -2 and court_x < 12 and court_y > -2 and court_y < 22),
        q as (select match_id, frame_no, player_id, {_BACK('u', 'v')[0]} as ax, {_BACK('u', 'v')[1]} as ay, {_BACK('u1', 'v')[0]} as bx, {_BACK('u1', 'v')[1]} as by_ from p),
        r as (select *, sqrt(power((bx - ax) * {ASPECT}::double, 2) + power(by_ - ay, 2)) * {co.PLAYER_M * co.SEEN_FROM_ABOVE!r}::double as tall from q),
        w as (select *, {_SIDE} as hi, least(1::double, {_SIDE} / {ASPECT}) as wi from r)
        select match_id, frame_no, player_id, {s6('least(1 - wi, greatest(0::double, ax - wi / 2))')} as x, {s6('least(1 - hi, greatest(0::double, ay - tall * 0.45::double - hi / 2))')} as y, {s6('wi')} as w, {s6('hi')} as h from w""", "corners", "poses"),
    "poses_in_metres": with_tables(
        f""", {COURTS}, p as (select b.match_id, frame_no, player_id, w0v, w1v, cy, {_ON[0]} as x, {_ON[1]} as y, cy + 0.08::double as foot from bodies b join solved using (match_id) where sound)
        select match_id, frame_no, player_id, {s6('(6 + w0v + w1v) / 8 * case when foot between -0.02 and 1.02 then 1 else 0.5 end')} as quality, {s6('x')} as court_x, {s6('y')} as court_y, {s6(f'{TILE[1]}::double + (cy - 0.1::double) * {TILE[3]}::double')} as nose_y
        from p where x > -2 and x < 12 and y > -2 and y < 22""", "corners", "bodies"),
    "free_candidates": with_tables(
        f""", {pi.BLOBS}, {bo.PADDED}, {_AREA}
        select match_id, frame_no, {s6('x')} as x, {s6('y')} as y, area from blobs join areas using (match_id)
        where ({' + '.join(_ACROSS(i, (i - 1) % 4) for i in range(4))}) % 2 = 1 and not exists (select 1 from padded p where p.match_id = blobs.match_id and p.frame_no = blobs.frame_no
          and blobs.x between p.x0 and p.x1 and blobs.y between p.y0 and p.y1)""", "corners", "pixels", "bodies"),
}
