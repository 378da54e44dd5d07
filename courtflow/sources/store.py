"""Saved matches, chunks of unfinished work, and settings, as Parquet folders."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from courtflow.operators.export import job_key

#: Columns that saved matches do without.
HEAVY = ("landmarks", "frames", "ball_track")


BUCKET = "__bucket"


class MatchStore:
    """Saved rows by match, in a fixed number of bucket folders however many matches there are.

    A save or delete rewrites the buckets that it touches and no other. The rows of a
    match lie in one bucket, by a hash of its id; the number of buckets can't change.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _folder(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _there(self) -> bool:
        where, fs = self._folder(self.path)
        return fs.exists(where)

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(F.col("match_id").cast("long")), F.lit(self.buckets)).cast("int"))

    def _saved(self, buckets: list[int]) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(self.path).where(F.col(BUCKET).isin(buckets))

    def _replace(self, rows: DataFrame, buckets: list[int]) -> None:
        """These buckets hold these rows from now on; the rows are written beside the store first, as they are read from it."""
        staged = f"{self.path}-staged-{uuid.uuid4().hex}"
        rows.write.partitionBy(BUCKET).parquet(staged)
        full = [r[0] for r in rows.sparkSession.read.schema(rows.schema).parquet(staged).select(BUCKET).distinct().collect()]
        new = self.spark.read.schema(rows.schema).parquet(staged).repartition(BUCKET)
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
        for path in [staged, *[f"{self.path}/{BUCKET}={b}" for b in buckets if b not in full]]:
            where, fs = self._folder(path)
            fs.delete(where, True)

    def save(self, rows: DataFrame) -> None:
        """Replaces the matches that occur in rows, and only those; heavy columns aren't stored."""
        slim = self._placed(rows.drop(*[c for c in HEAVY if c in rows.columns]))
        touched = [r[0] for r in slim.select(BUCKET).distinct().collect()]  # at most the number of buckets
        if touched and self._there():
            others = self._saved(touched).join(slim.select("match_id").distinct(), "match_id", "left_anti")
            slim = others.unionByName(slim, allowMissingColumns=True)
        if touched:
            self._replace(slim, touched)

    def list(self, schema: StructType) -> DataFrame:
        """All saved rows, newest first; columns that older rows lack are null, a store that isn't there is empty."""
        if not self._there():
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path).select(schema.names).orderBy(F.desc("created_at"), "match_id")

    def delete(self, match_id: int) -> bool:
        """Removes one match; whether there was one. An empty bucket's folder goes, the store itself stays."""
        if not self._there():
            return False
        bucket = self._placed(self.spark.range(1).select(F.lit(match_id).cast("long").alias("match_id"))).first()[BUCKET]
        own = self._saved([bucket])
        if not own.where(F.col("match_id") == match_id).limit(1).count():
            return False
        self._replace(own.where(~F.col("match_id").eqNullSafe(F.lit(match_id))), [bucket])
        return True


class Checkpoint:
    """Chunks of a job's frames; they count only if every chunk up to the last is there."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, key: str, index: int, frames: DataFrame) -> None:
        frames.withColumns({"job": F.lit(key), "chunk": F.lit(index)}).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job", "chunk").parquet(self.path)

    def load(self, key: str, chunks: int) -> DataFrame | None:
        """The frames of all chunks 0..chunks-1, or None if one is missing."""
        rows = self.spark.read.parquet(self.path).where((F.col("job") == key) & (F.col("chunk") < chunks))
        if rows.select(F.countDistinct("chunk")).first()[0] != chunks:
            return None
        return rows.drop("job", "chunk")

    def clear(self, key: str) -> bool:
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/job={key}")
        return folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


LANDMARKS = 33
PACKED = "match_id long, chunk long, t array<float>, counts array<tinyint>, ids array<tinyint>, courts array<float>, lms array<float>"


def pack_frames(frames: DataFrame, poses: DataFrame, per_chunk: int = 150) -> DataFrame:
    """Stretches of ``per_chunk`` frames as one row each, every field a flat array of small numbers.

    frames(match_id, frame_no, t), poses(match_id, frame_no, player_id, court_x, court_y,
    landmarks). Poses go by frame and player; landmarks that are missing, or beyond the
    33rd, are zeros and left out. Numbers are kept as floats. Nothing else is packed.
    """
    pose = F.struct("player_id", "court_x", "court_y", "landmarks")
    seen = poses.groupBy("match_id", "frame_no").agg(F.collect_list(pose).alias("poses"))
    by_player = F.array_sort("poses", lambda a, b: a["player_id"] - b["player_id"])
    rows = frames.select("match_id", "frame_no", "t").join(seen, ["match_id", "frame_no"], "left").withColumn("poses", F.coalesce(by_player, F.array()))
    chunk = F.floor((F.row_number().over(Window.partitionBy("match_id").orderBy("frame_no")) - 1) / per_chunk)
    packed = rows.withColumn("chunk", chunk).groupBy("match_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("frame_no", "t", "poses")), lambda a, b: F.signum(a["frame_no"] - b["frame_no"]).cast("int")).alias("f"))
    every = F.flatten("f.poses")
    mark = lambda p, i: F.get(p["landmarks"], i)
    three = lambda p, i: F.transform(F.array(mark(p, i)["x"], mark(p, i)["y"], mark(p, i)["visibility"]), lambda v: F.coalesce(v, F.lit(0.0)))
    lms = F.flatten(F.transform(every, lambda p: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LANDMARKS - 1)), lambda i: three(p, i)))))
    columns = {
        "t": F.col("f.t"), "counts": F.transform("f", lambda f: F.size(f["poses"])), "ids": F.transform(every, lambda p: p["player_id"]),
        "courts": F.flatten(F.transform(every, lambda p: F.array(p["court_x"], p["court_y"]))), "lms": lms,
    }
    kinds = dict(f.split(" ") for f in PACKED.split(", "))
    return packed.select("match_id", "chunk", *[c.cast(kinds[n]).alias(n) for n, c in columns.items()])


def unpack_frames(packed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """frames(match_id, chunk, place, t) and poses(match_id, chunk, place, player_id, court_x, court_y, landmarks) of packed rows.

    ``place`` numbers a chunk's frames. Every pose has 33 landmarks, zeros where there were none.
    """
    frames = packed.select("match_id", "chunk", F.posexplode("t").alias("place", "t"))
    of = F.flatten(F.transform("counts", lambda n, i: F.array_repeat(i, n.cast("int"))))
    rows = packed.select("match_id", "chunk", "ids", "courts", "lms", F.posexplode(of).alias("k", "place"))
    k = F.col("k")
    at = lambda j, c: F.get("lms", (k * LANDMARKS + j) * 3 + c)
    landmarks = F.transform(F.sequence(F.lit(0), F.lit(LANDMARKS - 1)), lambda j: F.struct(at(j, 0).alias("x"), at(j, 1).alias("y"), at(j, 2).alias("visibility")))
    poses = rows.select("match_id", "chunk", "place", F.get("ids", k).cast("int").alias("player_id"), F.get("courts", k * 2).alias("court_x"), F.get("courts", k * 2 + 1).alias("court_y"), landmarks.alias("landmarks"))
    return frames, poses


def checkpoint_key(spark: SparkSession, **settings) -> str:
    """The job key of settings; numbers are rounded to three places, order doesn't matter."""
    fixed = {k: round(v, 3) if isinstance(v, float) else v for k, v in sorted(settings.items())}
    row = spark.range(1).select(job_key(F.struct(*[F.lit(v).alias(k) for k, v in fixed.items()])).alias("key")).first()
    return row["key"][:32]


def valid_goals(goals: DataFrame) -> DataFrame:
    """Saved goals(metric, target) that are known and positive; of repeated metrics the first by target."""
    from courtflow.operators.history import GOALS

    known = goals.where(F.col("metric").isin(list(GOALS)) & (F.col("target") > 0))
    return known.groupBy("metric").agg(F.min("target").alias("target"))
