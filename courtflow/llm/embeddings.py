"""Near-duplicate embeddings by an epsilon grid order join.

Unit vectors are laid on a grid of cells as wide as the join distance, along their
leading principal dimensions, and sorted by cell. Stretches of that order are blocks
with bounding boxes; only pairs of blocks whose boxes come within the distance meet.
A home block meets its neighbours a few at a time, each such deal in a task of its
own, where the two stretches are halved recursively and halves that are provably too
far apart are skipped. Equal vectors are collapsed before, so copies cost nothing, and
a block pair reports how many links each vector has and a spanning forest of them,
never the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtflow.llm.components import connected_components
from courtflow.llm.shared import arrow_rows, lookup, stash, unstash

THRESHOLD = 0.9
#: Principal dimensions that order the vectors, and vectors that they are fitted on (the join is exact whatever they are).
LEADING, FIT_VECTORS, FIT_NUMBERS = 6, 10_000, 4_000_000
#: Numbers in an Arrow batch, about.
BATCH_NUMBERS = 1_000_000
#: Vectors in a block, and in a stretch that is no longer halved.
BLOCK, LEAF = 4096, 512
#: Neighbours that a home block meets in one deal.
DEAL = 8


def _usable(e: Column) -> Column:
    """No null, no non-finite component, not zero."""
    odd = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~odd & F.exists(e, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors of a list column whose lists all have ``dim`` numbers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dim)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def _dims(column: pa.Array) -> np.ndarray:
    return np.diff(column.offsets.to_numpy())


def principal_axes(nodes: DataFrame) -> dict[int, np.ndarray]:
    """For each vector length its leading axes, columns of a (length, LEADING) matrix.

    Fitted on about FIT_VECTORS vectors, fewer if they are long (FIT_NUMBERS in all).
    """
    n, longest = nodes.agg(F.count("*"), F.max(F.size("e"))).first()
    share = min(1.0, FIT_VECTORS / max(1, n), FIT_NUMBERS / max(1, n * (longest or 1)))
    some = nodes.where(F.pmod(F.xxhash64("e"), F.lit(1 << 30)) < int(share * (1 << 30))).select("e").toArrow()["e"].combine_chunks()
    some = some.chunk(0) if isinstance(some, pa.ChunkedArray) else some
    axes, dims = {}, _dims(some)
    for dim in np.unique(dims).tolist():
        x = _matrix(some.filter(pa.array(dims == dim)), dim)
        x = x - x.mean(axis=0)
        _, vectors = np.linalg.eigh(x.T @ x)
        axes[dim] = vectors[:, ::-1][:, :LEADING]
    return axes


def _axes_for(axes: dict[int, np.ndarray], dim: int) -> np.ndarray:
    """The fitted axes of a length, or its first coordinates; fewer than LEADING for short vectors."""
    return axes.get(dim, np.eye(dim)[:, :LEADING])


def _gridded(nodes: DataFrame, axes: dict[int, np.ndarray], width: float) -> DataFrame:
    """Adds each node's coordinates on the leading axes (zeros where there are fewer) and its cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = _dims(batch.column("e"))
            at = np.zeros((len(batch), LEADING))
            for dim in np.unique(dims).tolist():
                own = dims == dim
                a = _axes_for(axes, dim)
                at[own, : a.shape[1]] = _matrix(batch.column("e").filter(pa.array(own)), dim) @ a
            cells = np.floor(at / width).astype(np.int32)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), LEADING).cast(pa.list_(t)) for x, t in ((at, pa.float64()), (cells, pa.int32()))]
            columns = [batch.column("node"), batch.column("n"), batch.column("e"), pa.array(dims.astype(np.int32)), *lists]
            yield pa.RecordBatch.from_arrays(columns, ["node", "n", "e", "dim", "at", "cells"])

    return nodes.mapInArrow(run, "node long, n long, e array<double>, dim int, at array<double>, cells array<int>")


def _block_pairs(blocks: DataFrame, width: float) -> DataFrame:
    """(part, home), part <= home, for blocks(block, dim, low, high) whose boxes come within the width.

    Blocks meet over the cells of the two leading dimensions that one covers and the
    other comes near, then their boxes decide.
    """
    cell = lambda c, i: F.floor(F.get(c, F.lit(i)) / width).cast("int")
    cover = lambda i, more: F.explode(F.sequence(cell("low", i) - more, cell("high", i) + more))
    own = blocks.withColumn("c0", cover(0, 0)).withColumn("c1", cover(1, 0))
    near = blocks.withColumn("c0", cover(0, 1)).withColumn("c1", cover(1, 1))
    near = near.select("dim", "c0", "c1", F.col("block").alias("home"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    apart = F.aggregate(
        F.zip_with(F.zip_with("low", "high2", lambda a, b: a - b), F.zip_with("low2", "high", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0))),
        F.lit(0.0), lambda t, x: t + x * x,
    )
    met = own.join(near, ["dim", "c0", "c1"]).where(F.col("block") <= F.col("home")).where(apart <= width * width)
    return met.select(F.col("block").alias("part"), "home").distinct()


class _Stretch:
    """Vectors in grid order with their projections; links found so far and a union-find over places."""

    def __init__(self, nodes: np.ndarray, n: np.ndarray, x: np.ndarray, at: np.ndarray):
        self.nodes, self.n, self.x, self.at, self.links = nodes, n, x, at, np.zeros(len(nodes), dtype=np.int64)
        self.x32 = x.astype(np.float32)

    def box(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        return self.at[a:b].min(axis=0), self.at[a:b].max(axis=0)


def _join(p: _Stretch, a: int, b: int, h: _Stretch, c: int, d: int, threshold: float, width: float, forest: dict[int, int]) -> None:
    """Joins p[a:b] with h[c:d]; where both are one stretch, only its pairs in order."""
    if p is h and c < a:
        return
    (low, high), (low2, high2) = p.box(a, b), h.box(c, d)
    apart = np.maximum(np.maximum(low - high2, low2 - high), 0)
    if apart @ apart > width * width:
        return
    if max(b - a, d - c) > LEAF:
        if b - a >= d - c:
            m = (a + b) // 2
            halves = [(a, m, c, d), (m, b, c, d)]
        else:
            m = (c + d) // 2
            halves = [(a, b, c, m), (a, b, m, d)]
        if p is h and (a, b) == (c, d):
            m = (a + b) // 2
            halves = [(a, m, a, m), (a, m, m, b), (m, b, m, b)]
        for i, j, k, m in halves:
            _join(p, i, j, h, k, m, threshold, width, forest)
        return
    i, j = np.nonzero(p.x32[a:b] @ h.x32[c:d].T >= threshold - 1e-4)
    i, j = i + a, j + c
    if p is h:
        i, j = i[i < j], j[i < j]
    if not len(i):
        return
    keep = np.concatenate([np.einsum("ij,ij->i", p.x[i[s : s + 65536]], h.x[j[s : s + 65536]]) for s in range(0, len(i), 65536)]) >= threshold
    i, j = i[keep], j[keep]
    np.add.at(p.links, i, h.n[j])
    np.add.at(h.links, j, p.n[i])
    _grow(forest, p.nodes[i], h.nodes[j])


def _find(forest: dict[int, int], x: int) -> int:
    top = x
    while (up := forest.get(top, top)) != top:
        top = up
    while x != top:
        forest[x], x = top, forest.get(x, x)
    return top


def _grow(forest: dict[int, int], left: np.ndarray, right: np.ndarray) -> None:
    """Unites linked nodes: first each right node with the first left one, then what that leaves apart."""
    order = np.lexsort((left, right))
    left, right = left[order], right[order]
    first = np.concatenate([[True], right[1:] != right[:-1]])
    least = left[np.maximum.accumulate(np.where(first, np.arange(len(left)), 0))]
    pairs = np.unique(np.concatenate([np.stack([least[first], right[first]], 1), np.stack([least[~first], left[~first]], 1)]), axis=0)
    for a, b in pairs.tolist():
        a, b = _find(forest, a), _find(forest, b)
        if a != b:
            forest[max(a, b)] = min(a, b)


def _joined(axes: dict[int, np.ndarray], threshold: float, width: float):
    """Rows sorted by home and deal, home rows first, then part by part: per node its links with others, and edges."""

    def stretch(kept: list[pa.RecordBatch]) -> _Stretch:
        table = pa.Table.from_batches(kept).combine_chunks()
        e = table["e"].chunk(0)
        dim = int(_dims(e)[0])
        x = _matrix(e, dim)
        order = np.lexsort(np.floor(x @ _axes_for(axes, dim) / width).T[::-1])
        x = x[order]
        return _Stretch(table["node"].to_numpy()[order], table["n"].to_numpy()[order], x, x @ _axes_for(axes, dim))

    def edges(forest: dict[int, int]) -> Iterator[tuple[list[int], list[int], list[int]]]:
        found = [(x, top) for x in list(forest) if (top := _find(forest, x)) != x]
        yield [x for x, _ in found], [top for _, top in found], [0] * len(found)

    def links(own: _Stretch) -> Iterator[tuple[list[int], list[int], list[int]]]:
        some = np.nonzero(own.links)[0]
        yield own.nodes[some].tolist(), own.nodes[some].tolist(), own.links[some].tolist()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], _Stretch]]:
        """Each block that was sent with its (home, deal, part)."""
        key, kept = None, []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("home", "deal", "part")], axis=1)
            cuts = [0, *(1 + np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0]).tolist(), len(batch)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if key != (now := tuple(keys[a].tolist())):
                    if kept:
                        yield key, stretch(kept)
                    key, kept = now, []
                kept.append(batch.slice(a, b - a))
        if kept:
            yield key, stretch(kept)

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[int], list[int]]]:
        home: _Stretch | None = None
        for (home_id, deal, part), own in blocks(batches):
            forest: dict[int, int] = {}
            if part == home_id:  # home rows come first; the first deal joins them with each other
                if home is not None:
                    yield from links(home)
                home = own
                if deal == 0:
                    _join(own, 0, len(own.nodes), own, 0, len(own.nodes), threshold, width, forest)
            else:
                _join(own, 0, len(own.nodes), home, 0, len(home.nodes), threshold, width, forest)
                yield from links(own)
            yield from edges(forest)
        if home is not None:
            yield from links(home)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in results(batches):
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "links"])

    return run


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Adds block to stashed rows(place, dim, ...): stretches of ``BLOCK`` places in the whole order, each of one vector length.

    The places before each writing task come from one count a task, at most
    ``spark.sql.shuffle.partitions`` rows.
    """
    task = F.shiftright("place", 33)
    counts = rows.groupBy(task.alias("task")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = stash(counts.select("task", before.alias("base")), "ego-tasks")
    at = F.col("base") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = rows.withColumn("task", task).join(F.broadcast(bases), "task")
    return numbered.withColumn("block", F.shiftleft(F.floor(at / BLOCK), 31).bitwiseOR(F.col("dim").cast("long"))).drop("task", "base", "place")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors(vec_id, embedding, ...).

    Links join vectors with a cosine of at least ``threshold`` (in double precision).
    n_links counts the other rows linked directly, copies included; component_id is
    the least vec_id reachable; kept says whether that is the row's own. Vectors that
    are null, empty, zero or hold null or non-finite components, and rows without a
    vec_id, link with nothing; vectors of different lengths don't link. Repeated rows
    are vectors of their own, also where unlike vectors share a vec_id: each has its own
    links, and what both reach has that id as its component's. Other columns are
    ignored; an empty table gives none.
    """
    spark, width = vectors.sparkSession, float(np.sqrt(2 - 2 * threshold)) + 1e-6
    base = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("e"))
    usable = _usable(F.col("e")) & F.col("vec_id").isNotNull()
    # equal vectors are one node, numbered by its place in the written table
    distinct = base.where(usable).groupBy("e").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    nodes = stash(distinct.withColumn("node", F.monotonically_increasing_id()).select("node", "least", "n", "e"), "ego-nodes")
    axes = principal_axes(nodes)
    longest = nodes.agg(F.max(F.size("e"))).first()[0] or 1
    batch = max(64, min(10_000, BATCH_NUMBERS // longest))
    keys = [F.get("cells", F.lit(i)) for i in range(LEADING)]
    ordered = _gridded(nodes.select("node", "n", "e"), axes, width).withColumn("tie", F.xxhash64("e"))
    ordered = ordered.repartitionByRange("dim", *keys, "tie").sortWithinPartitions("dim", *keys, "tie")
    with arrow_rows(spark, batch):
        # the partition in the upper bits, the place in it below
        placed = stash(ordered.withColumn("place", F.monotonically_increasing_id()).select("node", "n", "e", "dim", "at", "place"), "ego-rows")
    rows = _in_blocks(placed)
    corner = lambda f: F.array(*[f(F.get("at", F.lit(i))) for i in range(LEADING)])
    blocks = stash(rows.groupBy("block", "dim").agg(corner(F.min).alias("low"), corner(F.max).alias("high")), "ego-blocks")
    # one row for each pair of near blocks; a block and itself are the first pair of its first deal
    turn = F.row_number().over(Window.partitionBy("home").orderBy(F.col("part") != F.col("home"), "part"))
    pairs = stash(_block_pairs(blocks, width).withColumn("deal", F.floor((turn - 1) / DEAL).cast("int")), "ego-pairs")
    sends = pairs.where("part != home").select("home", "deal", "part").unionByName(pairs.select("home", "deal", F.col("home").alias("part")).distinct())
    sent = rows.select(F.col("block").alias("part"), "node", "n", "e").join(sends, "part").select("home", "deal", "part", "node", "n", "e")
    met = sent.repartition("home", "deal").sortWithinPartitions("home", "deal", F.col("part") != F.col("home"), "part")
    with arrow_rows(spark, batch):
        found = stash(met.mapInArrow(_joined(axes, threshold, width), "a long, b long, links long"), "ego-links")
    unstash(placed, blocks, pairs)
    links = found.where("links > 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("a != b"), "ego-edges")
    linked = stash(
        nodes.select("node", "least", F.col("n").alias("copies"), *_hashes(F.col("e")))
        .join(links, "node", "left").join(roots, "node", "left")
        .select("h1", "h2", "least", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")),
        "ego-linked",
    )
    unstash(found)
    heads = stash(linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "ego-heads")
    known = stash(lookup(linked, heads, ["root"]).select("h1", "h2", "n_links", "component_id", F.col("copies").alias("n")), "ego-known")
    # the two hashes only spare the long key in the join back
    own = stash(base.select("vec_id", *[F.when(usable, h).alias(h_name) for h, h_name in zip(_hashes(F.col("e")), ("h1", "h2"), strict=True)]), "ego-own")
    single = own.where("h1 is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    joined = lookup(own.where("h1 is not null"), known, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    return joined.unionAll(single).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _hashes(e: Column) -> list[Column]:
    """Two hashes that tell vectors apart."""
    return [F.xxhash64(e).alias("h1"), F.xxhash64(F.lit(1), e).alias("h2")]
