"""Near-duplicate documents by SimHash, compared exactly in tiles.

Every document gets a 64-bit fingerprint of its word shingles. Equal fingerprints
are collapsed first, so copies cost nothing later. The distinct fingerprints are
compared exactly (exclusive-or and bit counts in numpy) tile by tile. A tile holds
fingerprints with the same population counts in their four 16-bit words; two
fingerprints differ in at least as many bits as those counts differ in sum, so tile
pairs beyond the radius are never formed. Each tile is first reduced to groups of
its own; tile pairs then report one edge for each pair of such groups, so a large
group of near copies never becomes all its pairs.

Cost: with random fingerprints about 4 % of all pairs are compared, at about 2 ns.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtflow.llm.components import connected_components
from courtflow.llm.shared import arrow_rows, lookup, stash, unstash

SEED = 42
RADIUS = 3
#: Words of a shingle: of the registered query, and of a pipeline's stage.
SHINGLE, STAGE_SHINGLE = 3, 5
#: Fingerprints in a tile, about; a fuller cell is dealt to several tiles by hash.
TILE = 1024


# ---- fingerprints


def shingle_hashes(text: bytes | None, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of each ``width``-word shingle of a UTF-8 text, A-Z lower-cased, repeats included.

    A text with fewer words is one shingle; one without words (null, empty, blank) has none.
    """
    words = (text or b"").lower().split()
    if len(words) < width:
        shingles = [b" ".join(words)] if words else []
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    one = xxhash.xxh64_intdigest
    return np.fromiter((one(s, SEED) for s in shingles), dtype="<u8")


def fingerprint_of(hashes: np.ndarray) -> int:
    """The unsigned fingerprint of hashes: a bit is 1 if set in over half of them; 0 of none."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """The fingerprint of a UTF-8 text's shingles; 0 without words."""
    return fingerprint_of(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) for every row of docs(doc_id, text); fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = np.fromiter((fingerprint(t.as_py(), width) for t in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


# ---- tiles


def _word_count(fp: Column, i: int) -> Column:
    return F.bit_count(F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF)))


def _half_space(radius: int) -> list[tuple[int, ...]]:
    """Zero and one of each opposite pair of steps between cells within the radius."""
    steps = product(range(-radius, radius + 1), repeat=4)
    return [s for s in steps if sum(map(abs, s)) <= radius and s >= (0, 0, 0, 0)]


class _Groups:
    """Union-find over positions of one tile."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


def _near(left: np.ndarray, right: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs within the radius, a slice of right at a time."""
    step = max(1, (1 << 20) // max(1, len(left)))
    for at in range(0, len(right), step):
        near = np.bitwise_count(left[:, None] ^ right[None, at : at + step]) <= radius
        if near.any():
            i, j = np.nonzero(near)
            yield i, j + at


def _group_tiles(radius: int):
    """Adds to each tile the group of each member: the least member that it reaches within the tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column("members")
            values = members.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            groups = values.copy()
            at = 0
            for n in np.diff(members.offsets.to_numpy()):
                own = values[at : at + n]
                if n > 1:
                    up = _Groups(n)
                    for i, j in _near(own, own, radius):
                        first = np.full(n, n)
                        np.minimum.at(first, j, i)
                        seen = np.unique(first[j] * np.int64(n) + i)
                        for code in seen.tolist():
                            up.join(code // n, code % n)
                        for a, b in zip(np.nonzero(first < n)[0].tolist(), first[first < n].tolist(), strict=True):
                            up.join(a, b)
                    groups[at : at + n] = own[[up.find(i) for i in range(n)]]
                at += n
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.diff(members.offsets.to_numpy()))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.view(np.int64))) for x in (values, groups)]
            yield pa.RecordBatch.from_arrays([batch.column("cell"), batch.column("salt"), *lists], ["cell", "salt", "members", "groups"])

    return run


def _cross_tiles(radius: int):
    """Edges between groups of each home tile and of the tiles sent to it; rows come sorted, the home tile first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, home = None, None
        for batch in batches:
            keys = np.stack([batch.column("target").to_numpy(), batch.column("slot").to_numpy()], axis=1)
            is_home = batch.column("home").to_numpy(zero_copy_only=False)
            cuts = np.concatenate([[0], 1 + np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0], [len(keys)]]) if len(keys) else [0]
            lists = [batch.column(c) for c in ("members", "groups")]
            offsets = [x.offsets.to_numpy() for x in lists]
            flat = [x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in lists]
            found = []
            for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
                if key != tuple(keys[start]):
                    key, home = tuple(keys[start]), None
                if is_home[start]:
                    home = [v[o[start] : o[start + 1]].copy() for v, o in zip(flat, offsets, strict=True)]
                    start += 1
                if home is None or start == stop:
                    continue
                other = [v[o[start] : o[stop]] for v, o in zip(flat, offsets, strict=True)]
                for i, j in _near(home[0], other[0], radius):
                    edges = np.stack([home[1][i], other[1][j]], axis=1)
                    found.append(np.unique(edges, axis=0))
            edges = np.unique(np.concatenate(found), axis=0).view(np.int64) if found else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"])

    return run


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges (a, b) over distinct fingerprints fps(fp) that connect exactly what pairs within the radius connect."""
    cell = sum((_word_count(F.col("fp"), i).cast("int") * (32**i) for i in range(4)), F.lit(0))
    cells = fps.select("fp", cell.alias("cell"))
    # at most 17^4 = 83,521 rows, whatever the input: small enough to broadcast by proof
    slots = stash(cells.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("slots")), "simhash-cells")
    tiles = (
        cells.join(F.broadcast(slots), "cell")
        .groupBy("cell", F.pmod(F.xxhash64("fp"), F.col("slots")).cast("int").alias("salt"))
        .agg(F.sort_array(F.collect_list("fp")).alias("members"))
        .mapInArrow(_group_tiles(radius), "cell int, salt int, members array<long>, groups array<long>")
    )
    tiles = stash(tiles, "simhash-tiles")
    within = tiles.select(F.explode(F.arrays_zip("members", "groups")).alias("x")).select(
        F.col("x.members").alias("a"), F.col("x.groups").alias("b")
    ).where("a != b")
    steps = F.array(*[F.struct(F.lit(sum(d * 32**i for i, d in enumerate(s))).alias("by"), *[F.lit(d).alias(f"d{i}") for i, d in enumerate(s)]) for s in _half_space(radius)])
    # a step from a count beyond 0..16 would reach another cell's number
    fits = [(F.shiftright("cell", 5 * i).bitwiseAND(F.lit(31)) + F.col(f"step.d{i}")).between(0, 16) for i in range(4)]
    sent = (
        tiles.withColumn("step", F.explode(steps))
        .where(fits[0] & fits[1] & fits[2] & fits[3])
        .withColumn("target", F.col("cell") + F.col("step.by"))
        .join(F.broadcast(slots.withColumnRenamed("cell", "target")), "target")
        .withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
        .withColumn("home", (F.col("cell") == F.col("target")) & (F.col("salt") == F.col("slot")))
        .where("cell != target or salt <= slot")
        .select("target", "slot", "home", "members", "groups")
    )
    across = (
        sent.repartition("target", "slot").sortWithinPartitions("target", "slot", F.desc("home"))
        .mapInArrow(_cross_tiles(radius), "a long, b long").where("a != b")
    )
    return within.unionAll(across)


def near_duplicates(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE, tile: int = TILE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs(doc_id, text, ...); other columns are ignored.

    component_id is the least doc_id reachable over links of at most ``radius`` bits.
    Texts without words (null, empty) share fingerprint 0 and are linked like any
    other. Repeated rows each give a row. A null doc_id is never a component_id
    unless no document of the component has an id. An empty table gives none.
    """
    own = stash(fingerprints(docs, width), "simhash-fps")
    distinct = stash(own.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "simhash-distinct")
    roots = connected_components(links(distinct.select("fp"), radius, tile), "simhash-edges")
    nodes = stash(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "simhash-nodes")
    unstash(distinct)
    heads = stash(nodes.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "simhash-heads")
    linked = stash(lookup(nodes, heads, ["root"]).select("fp", "component_id", F.col("copies").alias("n")), "simhash-linked")
    unstash(nodes, heads)
    return lookup(own, linked, ["fp"]).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# ---- similar documents, for a pipeline's stage

#: Least Jaccard similarity of the sets of shingles of two linked texts; as a fraction, so that pairs at the limit are decided exactly.
SIMILAR = (4, 5)
#: MinHash band keys of a text and minima in each, which propose pairs beyond the fingerprints' radius. Texts that share a key are proposed: of pairs at the limit all but (1 - 0.8^8)^64, 8 in a million.
BANDS, IN_BAND = 64, 8
#: Proposed texts that are compared in one go; a larger group is dealt to blocks, and each two blocks are compared.
WIDE_TILE = 2048
#: Rows of the Arrow batches that hold sets of shingles, and nodes that a task remembers to send them once.
SET_BATCH, LATELY = 500, 200_000

_RANDOM = np.random.Generator(np.random.PCG64(SEED))
_ODD = _RANDOM.integers(0, 1 << 32, BANDS * IN_BAND, dtype=np.uint32) | np.uint32(1)
_MIX = _RANDOM.integers(0, 1 << 63, (BANDS, IN_BAND), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The MinHash band keys of a set of shingles; none of an empty one."""
    if not len(hashes):
        return np.zeros(0, dtype=np.uint64)
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * IN_BAND, np.iinfo(np.uint32).max, dtype=np.uint32)
    for i in range(0, len(high), 64):
        least = np.minimum(least, (high[i : i + 64, None] * _ODD).min(axis=0))
    return (least.reshape(BANDS, IN_BAND) * _MIX).sum(axis=1, dtype=np.uint64)


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, text_hash) for every row of docs."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def _banded(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, node, fp, bands) for every row; node is a hash of the set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text_hash", "node", "fp", "bands"]
        for batch in batches:
            nodes, fps, bands = [], [], []
            for text in batch.column("text").cast(pa.binary()):
                hashes = shingle_hashes(text.as_py(), STAGE_SHINGLE)
                own = np.unique(hashes)
                nodes.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                fps.append(fingerprint_of(hashes))
                bands.append(band_keys(own).view(np.int64))
            longs = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (nodes, fps)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *longs, pa.array(bands, pa.list_(pa.int64()))], names)

    return _keyed(docs).mapInArrow(run, "doc_id long, text_hash long, node long, fp long, bands array<long>")


def _near_nodes(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) between nodes(node, fp) whose fingerprints differ in at most ``RADIUS`` bits, by way of one node for each fingerprint."""
    of = stash(nodes.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("n")), "similar-fps")
    same = lookup(nodes.select("node", "fp"), of, ["fp"]).select(F.col("node").alias("a"), F.col("first").alias("b"))
    near = stash(links(of.select("fp")), "similar-near")
    ends = of.select("fp", "first")
    across = near.join(ends.withColumnsRenamed({"fp": "a", "first": "x"}), "a").join(ends.withColumnsRenamed({"fp": "b", "first": "y"}), "b")
    return same.unionAll(across.select(F.col("x").alias("a"), F.col("y").alias("b"))).where("a != b")


def similar_links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of places whose sets are similar; pairs that earlier ones have joined are not looked at."""
    n, edges = len(sets), []
    sizes = np.array(list(map(len, sets)), dtype=np.int64)
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1].reshape(-1) if n else np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    marked, top = np.zeros(len(flat) + 1, dtype=bool), np.arange(n)
    over, under = SIMILAR
    for x in range(n):
        # the lesser set is at least as large a part of the larger one
        rest = x + 1 + np.nonzero((top[x + 1 :] != top[x]) & (under * np.minimum(sizes[x + 1 :], sizes[x]) >= over * np.maximum(sizes[x + 1 :], sizes[x])) & (sizes[x + 1 :] > 0))[0]
        if not len(rest):
            continue
        own = flat[ends[x] - sizes[x] : ends[x]]
        marked[own] = True
        step = max(1, (1 << 22) // int(sizes[rest].max()))
        for s in range(0, len(rest), step):
            some = rest[s : s + step]
            starts = np.cumsum(sizes[some]) - sizes[some]
            places = np.arange(sizes[some].sum()) + np.repeat(ends[some] - sizes[some] - starts, sizes[some])
            common = np.add.reduceat(marked[flat[places]], starts, dtype=np.int64)
            for y in some[under * common >= over * (sizes[x] + sizes[some] - common)].tolist():
                if top[y] != top[x]:
                    edges.append((x, y))
                    top[top == top[y]] = top[x]
        marked[own] = False
    return edges


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces text by its set of shingles; a node that the task has met lately isn't given again."""
    names, met = ["root", "node", "block", "blocks", "shingles"], set()
    for batch in batches:
        for at in range(0, len(batch), SET_BATCH):
            part = batch.slice(at, SET_BATCH)
            new = []
            for i, node in enumerate(part.column("node").to_pylist()):
                if node not in met:
                    met.add(node)
                    new.append(i)
            if len(met) > LATELY:
                met.clear()
            part = part.take(pa.array(new, pa.int32()))
            sets = pa.array([np.unique(shingle_hashes(t.as_py(), STAGE_SHINGLE)).tobytes() for t in part.column("text").cast(pa.binary())], pa.binary())
            yield pa.RecordBatch.from_arrays([*map(part.column, names[:-1]), sets], names)


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges between the similar ones of the nodes of each (root, low, high); rows come sorted by these and node, and a node counts once."""
    key, nodes, sets = None, [], []

    def found() -> pa.RecordBatch:
        edges = np.array([(nodes[a], nodes[b]) for a, b in similar_links(sets)], dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"])

    for batch in batches:
        keys = zip(*(batch.column(c).to_pylist() for c in ("root", "low", "high")), strict=True)
        for now, node, shingles in zip(keys, batch.column("node").to_pylist(), batch.column("shingles").to_pylist(), strict=True):
            if now != key:
                if len(sets) > 1:
                    yield found()
                key, nodes, sets = now, [], []
            if not nodes or nodes[-1] != node:
                nodes.append(node)
                sets.append(np.frombuffer(shingles, dtype=np.uint64))
    if len(sets) > 1:
        yield found()


def _components(docs: DataFrame, tile: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, node) for every row of docs, and (node, root) of the nodes that are linked to others."""
    spark = docs.sparkSession
    own = stash(_banded(docs), "similar-rows")
    # one text of each node stands for it
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "fp", "bands"))
    nodes = stash(own.where(F.size("bands") > 0).groupBy("node").agg(first.alias("x")).select("node", "x.doc_id", "x.text_hash", "x.fp", "x.bands"), "similar-nodes")
    keys = nodes.select("node", F.explode("bands").alias("band"))
    shared = keys.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count("*").alias("n")).where("least != most").select("band", "least", "n")
    by_band = lookup(keys, stash(shared, "similar-bands"), ["band"]).select(F.col("node").alias("a"), F.col("least").alias("b"))
    proposed = stash(connected_components(by_band.unionAll(_near_nodes(nodes)), "similar-proposed"), "similar-groups")
    blocks = stash(proposed.groupBy("root").agg(F.ceil(F.count("*") / tile).cast("int").alias("blocks"), F.count("*").alias("n")), "similar-blocks")
    texts = (
        lookup(nodes.select("node", "doc_id", "text_hash").join(proposed, "node"), blocks, ["root"])
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    )
    # exact repeats of a row are the same node: tasks send it once each, and it is compared once
    chosen = texts.withColumnsRenamed({"doc_id": "own_id", "text_hash": "own_hash"})
    rows = _keyed(docs)
    held = rows.join(chosen, (F.col("text_hash") == F.col("own_hash")) & F.col("doc_id").eqNullSafe(F.col("own_id"))).select("root", "node", "block", "blocks", "text")
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: b != F.col("block"))))
    sent = (
        held.mapInArrow(_with_sets, "root long, node long, block int, blocks int, shingles binary")
        .withColumn("other", other)
        .select("root", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node", "shingles")
        .repartition("root", "low", "high").sortWithinPartitions("root", "low", "high", "node")
    )
    with arrow_rows(spark, SET_BATCH):
        edges = stash(sent.mapInArrow(_decide, "a long, b long"), "similar-links")
    return own.select("doc_id", "text_hash", "node"), connected_components(edges, "similar-edges")


def similar_documents(docs: DataFrame, tile: int = WIDE_TILE) -> DataFrame:
    """(doc_id, component_id) for every row of docs: components of texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

    Fingerprints within the radius, compared in tiles, propose; at a similarity of 0.8
    two fingerprints differ in about ten bits, so MinHash band keys propose as well.
    Texts proposed to each other, directly or over others, form a group, and every pair
    of a group that is not joined over others already is decided by its exact similarity.
    Texts without words are one component. Nulls and repeats are as in ``near_duplicates``.
    """
    own, roots = _components(docs, tile)
    nodes = own.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")).join(roots, "node", "left")
    nodes = stash(nodes.withColumn("root", F.coalesce("root", "node")), "similar-rooted")
    heads = stash(nodes.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "similar-heads")
    of = stash(lookup(nodes, heads, ["root"]).select("node", "component_id", F.col("copies").alias("n")), "similar-of")
    return lookup(own.select("doc_id", "node"), of, ["node"]).select("doc_id", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of docs of each component of similar documents: that of the least doc_id, or one without an id if none has one.

    Ids name nothing here: unrelated texts stay whether they share an id or have none.
    Ties of the id go by a hash of the text, and exact repeats of id and text by a hash
    of the row, so reruns keep the same rows. All columns are kept.
    """
    own, roots = _components(docs, WIDE_TILE)
    key = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash"))
    nodes = own.groupBy("node").agg(key.alias("x")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    marks = nodes.groupBy("root").agg(F.min("x").alias("x")).select(F.col("x.doc_id").alias("__id"), F.col("x.text_hash").alias("__hash"))
    own_id, own_hash = docs["doc_id"].cast("long"), F.xxhash64(docs["text"].cast("string"))
    kept = docs.join(marks, (own_hash == F.col("__hash")) & own_id.eqNullSafe(F.col("__id")), "left_semi")
    row = [kept[c] for c in docs.columns]
    one = F.min_by(F.struct(*row), F.xxhash64(*row)).alias("__row")
    return kept.groupBy(kept["doc_id"].alias("__id"), F.xxhash64(kept["text"].cast("string")).alias("__hash")).agg(one).select("__row.*")
