"""Structured Streaming forms: rallies as session windows, identities and ball paths as keyed state, checkpoints for recovery."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from courtflow.operators.tracking import END, IDENTITY, Paths, Players, advance, sightings


def rallies(shots: DataFrame, gap: str = "4 seconds", late: str = "10 seconds") -> DataFrame:
    """(match_id, start_ts, last_ts, n_shots) of a stream of shots(match_id, ts): sessions of at least two shots.

    A session is emitted once the watermark has passed its end; sessions merge at
    exactly the gap, as in the batch form. Shots later than ``late`` are dropped.
    """
    windowed = shots.withWatermark("ts", late).groupBy("match_id", F.session_window("ts", gap).alias("w"))
    return windowed.agg(F.count("*").alias("n_shots"), F.min("ts").alias("start_ts"), F.max("ts").alias("last_ts")).where("n_shots >= 2").select("match_id", "start_ts", "last_ts", "n_shots")


#: The tracker's whole state of a match.
PLAYERS_STATE = "x array<double>, y array<double>, seen array<double>, jumped boolean"
PLACES = "array<struct<slot: int, t: double, x: double, y: double>>"


def followed(events: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The tracker on a stream of ``tracking.sightings``, each match going on from known(match_id, slot, t, x, y) where that is given.

    Within a match sightings must arrive in order of time over micro-batches, those of
    one time together. ``known`` is a batch table; its places, four a match at most, come
    with the rows and count where a match has no state yet. The state is typed numbers,
    four places at most, and goes with the row that ends the match (a timeout by the
    clock would keep a stream that reads what is there from ever ending).
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches))
        if state.exists:
            x, y, seen, jumped = state.get
            players = Players(list(zip(map(float, x), map(float, y), strict=True)), list(map(float, seen)), bool(jumped))
        else:
            given = rows["known"].iloc[0]
            players = Players.known(pd.DataFrame(list(map(dict, given)) if given is not None else [], columns=["slot", "t", "x", "y"]))
        out = advance(players, rows)
        if (rows["kind"] == END).any():
            if state.exists:
                state.remove()
        else:
            state.update(([x for x, _ in players.xy], [y for _, y in players.xy], players.seen, bool(players.jumped)))
        yield out

    if known is None:
        events = events.withColumn("known", F.lit(None).cast(PLACES))
    else:
        place = F.struct(F.col("slot").cast("int").alias("slot"), F.col("t").cast("double").alias("t"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
        events = events.join(known.groupBy("match_id").agg(F.collect_list(place).alias("known")), "match_id", "left")
    grouped = events.where("t is not null").groupBy("match_id")
    return grouped.applyInPandasWithState(run, IDENTITY, PLAYERS_STATE, "append", GroupStateTimeout.NoTimeout)


def identities(detections: DataFrame) -> DataFrame:
    """``followed`` for detections(match_id, t, seq, x, y) alone."""
    return followed(sightings(detections.select("match_id", "t", "seq", "x", "y")))


def ball_paths(candidates: DataFrame) -> DataFrame:
    """The ball tracker on a stream of candidates(match_id, t, x, y): each with the number of its path, -1 if it begins none.

    ``tracking.track_of_paths`` makes the track from the rows written. Within a match
    candidates must arrive in order of time over micro-batches, those of one time
    together. The state holds at most twelve paths, of each its last observations.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        saved = json.loads(state.get[0]) if state.exists else {"live": [], "speed": [], "numbers": [], "begun": 0}
        paths = Paths([[tuple(o) for o in p] for p in saved["live"]], [tuple(v) for v in saved["speed"]], [], saved["numbers"], saved["begun"])
        rows = pd.concat(list(batches)).sort_values("t", kind="stable").reset_index(drop=True)
        owner, xs, ys = np.full(len(rows), -1), rows["x"].to_numpy(), rows["y"].to_numpy()
        for t, at in rows.groupby("t", sort=True).indices.items():
            owner[at] = paths.push(float(t), list(zip(xs[at].tolist(), ys[at].tolist(), strict=True)))
        # whether a path has one observation or more decides how its speed is updated
        state.update((json.dumps({"live": [p[-2:] for p in paths.live], "speed": paths.speed, "numbers": paths.numbers, "begun": paths.begun}),))
        yield rows.assign(path=owner.astype("int64"))[["match_id", "path", "t", "x", "y"]]

    grouped = candidates.select("match_id", "t", "x", "y").groupBy("match_id")
    return grouped.applyInPandasWithState(run, "match_id long, path long, t double, x double, y double", "paths string", "append", GroupStateTimeout.NoTimeout)


def append_parquet(stream: DataFrame, path: str, checkpoint: str, every: str | None = None):
    """Starts writing a stream to Parquet; a restart with the same checkpoint goes on where it stopped.

    Without ``every`` all that is there is written and the query ends.
    """
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
