"""A match's own court: corners, homographies, play area, tiles, focus crops, and poses in metres.

corners(match_id, corners) has array<struct<x, y>> of far left, far right, near right
and near left in shares of the picture; ``aspect`` is the picture's width by its height.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from courtflow.functions import geometry as g
from courtflow.operators import shots as sh
from courtflow.operators.vision import bands

HEADROOM, SIDE_ROOM, NEAR_ROOM = 1.8, 0.5, 0.3
PLAYER_M, SEEN_FROM_ABOVE, CROP_HEIGHTS, LEAST_CROP = 1.85, 0.85, 2.4, 0.08


def calibrated(corners: DataFrame) -> DataFrame:
    """Adds the homographies ``to_court`` and ``to_image``; both are null where corners are missing or fix no homography, as where all lie on a line."""
    to_court = g.image_to_court(F.col("corners"))
    both = corners.withColumn("to_court", to_court)
    return both.withColumn("to_image", F.when(F.col("to_court").isNotNull(), g.court_to_image(F.col("corners"))))


def projected_lines(courts: DataFrame) -> DataFrame:
    """(match_id, line, x0, y0, x1, y1): the court's lines as they lie in the picture; courts without homographies have none."""
    ends = ("u0", "v0", "u1", "v1")
    lines = [F.struct(F.lit(i).alias("line"), *[F.lit(float(v)).alias(c) for c, v in zip(ends, line, strict=True)]) for i, line in enumerate(g.court_lines())]
    drawn = courts.where("to_image is not null").select("match_id", "to_image", F.explode(F.array(*lines)).alias("l"))
    (x0, y0), (x1, y1) = (g.project(F.col("to_image"), F.col(f"l.u{i}"), F.col(f"l.v{i}")) for i in range(2))
    return drawn.select("match_id", "l.line", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def net_row(to_image: Column) -> Column:
    """The height in the picture at which the middle of the net's foot is seen."""
    ends = [g.project(to_image, F.lit(x), F.lit(g.NET_Y))[1] for x in (0.0, float(g.WIDTH))]
    return (ends[0] + ends[1]) / 2


def play_area(corners: Column, aspect: float, headroom: float = HEADROOM) -> Column:
    """The part of the picture where players can be: the court with room at the sides and a standing player's above the far line."""
    fl, fr, nr, nl = (F.get(corners, F.lit(i)) for i in range(4))
    metre = lambda a, b: F.hypot((b["x"] - a["x"]) * aspect, b["y"] - a["y"]) / g.WIDTH
    far, near = metre(fl, fr), metre(nl, nr)
    moved = lambda p, dx, dy: F.struct((p["x"] + dx / aspect).alias("x"), (p["y"] + dy).alias("y"))
    return F.array(
        moved(fl, -far * SIDE_ROOM, -far * headroom), moved(fr, far * SIDE_ROOM, -far * headroom), moved(nr, near * SIDE_ROOM, near * NEAR_ROOM), moved(nl, -near * SIDE_ROOM, near * NEAR_ROOM)
    )


class Tiles:
    """Table function: the tiles of one match's corners, numbered from the far left."""

    def eval(self, corners: list | None, net_y: float | None, aspect: float) -> Iterator[tuple[int, float, float, float, float]]:
        if corners is not None and net_y is not None:
            for i, tile in enumerate(bands([(c["x"], c["y"]) for c in corners], aspect, net_y)):
                yield i, *tile


TILE = StructType([StructField("tile", IntegerType()), *[StructField(c, DoubleType()) for c in "xywh"]])


def match_tiles(courts: DataFrame, aspect: float) -> DataFrame:
    """(match_id, tile, x, y, w, h) for each match of calibrated courts: the function is called laterally for its corners."""
    tiles = F.udtf(Tiles, returnType=TILE)
    own = courts.select("match_id", "corners", net_row(F.col("to_image")).alias("net_y"))
    return own.lateralJoin(tiles(F.col("corners").outer(), F.col("net_y").outer(), F.lit(aspect))).select("match_id", "tile", "x", "y", "w", "h")


def focus_tile(to_image: Column, x: Column, y: Column, aspect: float) -> Column:
    """A square crop (x, y, w, h) around where a player at a place on the court is seen, sized to the player there."""
    (ax, ay), (bx, by) = g.project(to_image, x, y), g.project(to_image, x + 1, y)
    tall = F.hypot((bx - ax) * aspect, by - ay) * (PLAYER_M * SEEN_FROM_ABOVE)
    side = F.least(F.lit(1.0), F.greatest(F.lit(LEAST_CROP), tall * CROP_HEIGHTS))
    wide = F.least(F.lit(1.0), side / aspect)
    inside = lambda middle, size: F.least(1 - size, F.greatest(F.lit(0.0), middle - size / 2))
    return F.struct(inside(ax, wide).alias("x"), inside(ay - tall * 0.45, side).alias("y"), wide.alias("w"), side.alias("h"))


def on_own_court(rows: DataFrame, courts: DataFrame) -> DataFrame:
    """Rows with their match's ``to_court``; those of matches without a homography are left out."""
    return rows.join(courts.where("to_court is not null").select("match_id", "to_court"), "match_id")


def seen_poses(tiled: DataFrame, courts: DataFrame | None = None, margin: float = 2.0) -> DataFrame:
    """Poses seen in tiles as poses on the court.

    tiled(match_id, tile, landmarks, ...) with landmarks in shares of the struct column
    ``tile`` (x, y, w, h). Landmarks become shares of the picture, ``quality`` is what the
    tile shows of the body, and court_x, court_y are the feet in metres; poses off the
    court, and those of matches without a homography, are left out. Without ``courts``
    the rows bring ``to_court`` themselves: where landmarks are derived from less, as
    ``on_own_court`` before that lets the join carry the less.
    """
    met = tiled if courts is None else on_own_court(tiled, courts)
    framed = met.withColumn("quality", sh.pose_quality(F.col("landmarks"))).withColumn("landmarks", sh.in_frame(F.col("landmarks"), F.col("tile"))).withColumn("__feet", sh.feet(F.col("landmarks")))
    x, y = g.project(F.col("to_court"), F.col("__feet.x"), F.col("__feet.y"))
    return framed.withColumns({"court_x": x, "court_y": y}).where(g.on_court(F.col("court_x"), F.col("court_y"), margin)).drop("to_court", "__feet", "tile")
