"""Queries on tables of pixels: brightness, moving ball pixels and blobs, surface colour and mask."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtflow.operators import vision as vi
from courtflow.plans.shared import query, r6, s6
from courtflow.sources.surrogate import with_tables

WIDE, HIGH = 20, 20


@query("pixels")
def box_means(pixels):
    lit = pixels.withColumn("gray", vi.gray(F.col("r"), F.col("g"), F.col("b")))
    return vi.box_mean(lit, "gray", 2).select("match_id", "frame_no", "y", "x", "gray", r6("mean"))


@query("pixels")
def ball_pixels(pixels):
    return vi.ball_mask(pixels)


@query("pixels")
def ball_blobs(pixels):
    return vi.ball_candidates(pixels, WIDE, HIGH).select("match_id", "frame_no", r6("x"), r6("y"), "area")


@query("pixels")
def surface_colors(pixels):
    return vi.surface_color(pixels, WIDE, HIGH).select("match_id", "frame_no", r6("sr"), r6("sg"), r6("sl"))


@query("pixels")
def carpet_pixels(pixels):
    return vi.carpet_mask(pixels, WIDE, HIGH).groupBy("match_id", "frame_no").agg(F.count("*").alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y"))


@query("pixels")
def court_outlines(pixels):
    """The corners of each picture's court, found from its colour."""
    found = vi.court_corners(pixels, WIDE, HIGH)
    at = lambda i, j: F.get(F.get("corners", F.lit(i)), F.lit(j))
    return found.select("match_id", "frame_no", *[r6(at(i, j), f"{c}{i}") for i in range(4) for j, c in enumerate("xy")])


@query("poses")
def reach_quads(poses):
    """The largest quadrilateral between places where players stood within five frames."""
    places = poses.select("match_id", F.floor(F.col("frame_no") / 5).alias("part"), F.col("court_x").alias("x"), F.col("court_y").alias("y"))
    return vi.largest_quads(places, ["match_id", "part"]).select("match_id", "part", r6(F.sqrt("area"), "root"))


_names = "court_outlines reach_quads box_means ball_pixels ball_blobs surface_colors carpet_pixels"
QUERIES = {n: globals()[n] for n in _names.split()}


def _mean(reach: int) -> str:
    """SQL of the mean brightness around each pixel, by joining the square itself."""
    return f"lit as (select *, (r * 77 + g * 150 + b * 29) // 256 as gray from pixels), around as (select p.match_id, p.frame_no, p.y, p.x, p.gray, avg(q.gray) as mean from lit p join lit q on q.match_id = p.match_id and q.frame_no = p.frame_no and abs(q.x - p.x) <= {reach} and abs(q.y - p.y) <= {reach} group by all)"


_MASK = f"""{_mean(vi.REACH)}, moved as (select l.*, a.mean, lag(l.gray) over (partition by l.match_id, l.y, l.x order by l.frame_no) as before from lit l join around a using (match_id, frame_no, y, x)),
mask as (select match_id, frame_no, y, x from moved where abs(gray - before) > {vi.MOTION} and ((r + g + b >= 250 and b / (r + g + b) < 0.24 and g / (r + g + b) > 0.36 and r / (r + g + b) > 0.24 and abs(r - g) / (r + g + b) < 0.12) or gray - mean > {vi.CONTRAST}))"""
_SURFACE = f"""colored as (select *, r / (r + g + b + 1) as cr, g / (r + g + b + 1) as cg, (r + g + b + 1) / 3 as lum from pixels),
middle as (select match_id, frame_no, list_sort(list(cr)) as a, list_sort(list(cg)) as c, list_sort(list(lum)) as l from colored where y >= 12 and y < {HIGH * 0.92} and x >= 6 and x < {WIDE * 0.7} and y % 2 = 0 and x % 2 = 0 group by 1, 2),
surface as (select * from (select match_id, frame_no, a[len(a) // 2 + 1] as sr, c[len(c) // 2 + 1] as sg, l[len(l) // 2 + 1] as sl from middle) where sqrt(power(sr - 1 / 3, 2) + power(sg - 1 / 3, 2)) >= 0.03)"""
_SQUARE = "from {0} p join {0} q on q.match_id = p.match_id and q.frame_no = p.frame_no and abs(q.x - p.x) <= 2 and abs(q.y - p.y) <= 2 group by 1, 2, 3, 4"

# twice the area of the largest quadrilateral with corners a, b, c, d: half the cross product of its diagonals
_CROSS = lambda p, q, r, t: f"abs(({q}.x - {p}.x) * ({t}.y - {r}.y) - ({q}.y - {p}.y) * ({t}.x - {r}.x))"
_QUAD = f"greatest({_CROSS('a', 'c', 'b', 'd')}, {_CROSS('a', 'b', 'c', 'd')}, {_CROSS('a', 'd', 'b', 'c')})"
_CLOSED = f"""on0 as (select match_id, frame_no, y, x, case when sqrt(power(cr - sr, 2) + power(cg - sg, 2)) < 0.045 and lum > sl * 0.45 and lum < sl * 1.8 then 1 else 0 end as v from colored join surface using (match_id, frame_no)),
        on1 as (select p.match_id, p.frame_no, p.y, p.x, max(q.v) as v {_SQUARE.format('on0')}), on2 as (select p.match_id, p.frame_no, p.y, p.x, min(q.v) as v {_SQUARE.format('on1')})"""
BLOBS = f"""{_MASK}, reach as (with recursive k as (select match_id, frame_no, y, x, y * 100 + x as seed from mask
  union select m.match_id, m.frame_no, m.y, m.x, k.seed from k join mask m on m.match_id = k.match_id and m.frame_no = k.frame_no and abs(m.y - k.y) <= 1 and abs(m.x - k.x) <= 1) select * from k),
named as (select match_id, frame_no, y, x, min(seed) as blob from reach group by 1, 2, 3, 4),
blobs as (select match_id, frame_no, (avg(x) + 0.5) / {WIDE} as x, (avg(y) + 0.5) / {HIGH} as y, count(*) as area from named group by match_id, frame_no, blob having count(*) <= {max(6, vi.MOST_SHARE * WIDE * HIGH)})"""

ORACLE_SQL = {
    "box_means": with_tables(f", {_mean(2)} select match_id, frame_no, y, x, gray, {s6('mean')} as mean from around", "pixels"),
    "ball_pixels": with_tables(f", {_MASK} select * from mask", "pixels"),
    "ball_blobs": with_tables(f", {BLOBS} select match_id, frame_no, {s6('x')} as x, {s6('y')} as y, area from blobs", "pixels"),
    "surface_colors": with_tables(f", {_SURFACE} select match_id, frame_no, {s6('sr')} as sr, {s6('sg')} as sg, {s6('sl')} as sl from surface", "pixels"),
    "court_outlines": with_tables(
        f""", {_SURFACE}, {_CLOSED}, spread as (with recursive k as (select p.match_id, p.frame_no, p.y, p.x from on2 p where v = 1 and y = {HIGH * 3 // 4} and x = {WIDE // 2}
          union select m.match_id, m.frame_no, m.y, m.x from k join on2 m on m.match_id = k.match_id and m.frame_no = k.frame_no and abs(m.y - k.y) + abs(m.x - k.x) = 1 and m.v = 1) select * from k),
        filled as (select match_id, frame_no from spread group by 1, 2 having count(*) between {WIDE * HIGH * 0.05} and {WIDE * HIGH * 0.92}),
        ends as (select match_id, frame_no, y, min(x) as l, max(x) + 1 as r from spread join filled using (match_id, frame_no) group by 1, 2, 3),
        p as (select *, row_number() over (partition by match_id, frame_no order by y, x) as i from (select match_id, frame_no, y, l as x from ends union select match_id, frame_no, y, r from ends)),
        best as (select a.match_id, a.frame_no, arg_max([{{'y': a.y, 'x': a.x}}, {{'y': b.y, 'x': b.x}}, {{'y': c.y, 'x': c.x}}, {{'y': d.y, 'x': d.x}}], {_QUAD}) as q
          from p a join p b using (match_id, frame_no) join p c using (match_id, frame_no) join p d using (match_id, frame_no) where a.i < b.i and b.i < c.i and c.i < d.i group by 1, 2),
        sides as (select match_id, frame_no, least(q[1].x, q[2].x) as x0, case when q[1].x < q[2].x then q[1].y else q[2].y end as y0, greatest(q[1].x, q[2].x) as x1, case when q[1].x < q[2].x then q[2].y else q[1].y end as y1,
          greatest(q[3].x, q[4].x) as x2, case when q[3].x > q[4].x then q[3].y else q[4].y end as y2, least(q[3].x, q[4].x) as x3, case when q[3].x > q[4].x then q[4].y else q[3].y end as y3 from best)
        select match_id, frame_no, {', '.join(f'{s6(f"x{i} / {WIDE}")} as x{i}, {s6(f"y{i} / {HIGH}")} as y{i}' for i in range(4))} from sides where x1 > x0 and x2 > x3 and x1 - x0 <= 1.15 * (x2 - x3)""", "pixels"),
    "reach_quads": with_tables(
        f""", p as (select match_id, frame_no // 5 as part, court_x as x, court_y as y, row_number() over (partition by match_id, frame_no // 5 order by frame_no, player_id) as i from poses),
        q as (select a.match_id, a.part, a, b, c, d from p a join p b using (match_id, part) join p c using (match_id, part) join p d using (match_id, part) where a.i < b.i and b.i < c.i and c.i <= d.i)
        select match_id, part, {s6(f'sqrt(max({_QUAD}) / 2)')} as root from q group by 1, 2""", "poses"),
    "carpet_pixels": with_tables(
        f""", {_SURFACE}, {_CLOSED}
        select match_id, frame_no, count(*) as n, sum(x)::bigint as x, sum(y)::bigint as y from on2 where v = 1 group by 1, 2""", "pixels"),
}
