"""Lines that many documents share, found in one sorted stream of line hashes.

Every line of some length is two hashes, its document and its place; texts don't
travel. The rows are range-partitioned by hash with the document (largest first) and
the place as secondary order, so that even one very common line spreads over many
tasks. Each task streams its range once: the first document of a hash keeps the line,
the third and later ones lose it, the second loses it if there is a third. Only the
hash at either end of a range may go on in the next one; of these a task reports
three documents at most, and the few lines that hang on them are decided afterwards.
What comes back for a document is a compressed bitmap of the lines it keeps.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtflow.llm.shared import slices, stash, unstash

#: Code points that a key has at least, and documents that hold it at least, for its lines to go.
LEAST_CHARS, LEAST_DOCS = 20, 3
#: What is stripped from both ends of a line.
ENDS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What a streamed row says: a line that goes, a line that hangs on what other ranges hold, a document of a hash at the end of a range.
GONE, OPEN, EDGE = 0, 1, 2
#: Rows and bytes of texts that are handled at once.
SLICE_ROWS, SLICE_BYTES = 2_000, 16_000_000


def whole(text: str | Column) -> Column:
    return F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit(""))


def line_rows(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(h1, h2, doc_id, version, place) of every line whose key is long enough; version is a hash of the text."""
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("t")).select(
        "doc_id", F.xxhash64("t").alias("version"), F.posexplode(F.split("t", "\n")).alias("place", "line")
    )
    bare = lines.select("doc_id", "version", "place", F.btrim("line", F.lit(ENDS)).alias("bare")).where(F.length("bare") >= least_chars)
    key = bare.select("doc_id", "version", "place", F.translate("bare", UPPER, LOWER).alias("key"))
    return key.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "version", "place")


class _Stream:
    """The rows of one range in order, chunk by chunk; what it holds between chunks is the lines of one document for one hash."""

    def __init__(self, least_docs: int):
        self.least = least_docs
        self.last: tuple | None = None  # hash, document, version and place of the row before
        self.docs = 0  # documents of the current hash so far
        self.inner = False  # whether the current hash began after the range did
        self.held: list[dict[str, np.ndarray]] = []  # its lines that hang on how many documents follow
        self.edge: list[tuple] = []  # its first documents

    @staticmethod
    def rows(kind: int, c: dict[str, np.ndarray], where: np.ndarray) -> pa.RecordBatch:
        n = int(where.sum())
        doc = pa.array(c["doc"][where], mask=c["none"][where])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, kind, np.int32)), pa.array(c["h1"][where]), pa.array(c["h2"][where]), doc, pa.array(c["version"][where]), pa.array(c["place"][where])],
            ["kind", "h1", "h2", "doc_id", "version", "place"],
        )

    def edges(self) -> Iterator[pa.RecordBatch]:
        """The first documents of the current hash."""
        if self.edge:
            h1, h2, doc, none = (np.array(x) for x in zip(*self.edge, strict=True))
            c = {"h1": h1, "h2": h2, "doc": doc, "none": none, "version": np.zeros(len(h1), np.int64), "place": np.zeros(len(h1), np.int32)}
            yield self.rows(EDGE, c, np.ones(len(h1), bool))

    def ended(self, last: bool) -> Iterator[pa.RecordBatch]:
        """The current hash ends, perhaps with the range: its held lines stay, or hang on other ranges."""
        if last or not self.inner:
            for c in self.held:
                yield self.rows(OPEN, c, np.ones(len(c["h1"]), bool))
            yield from self.edges()
        self.held, self.edge, self.docs = [], [], 0

    def chunk(self, c: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        n, before = len(c["h1"]), self.last
        self.last = tuple(c[x][-1] for x in ("h1", "h2", "doc", "none", "version", "place"))
        first = tuple(c[x][0] for x in ("h1", "h2", "doc", "none", "version", "place"))

        def changes(*names: str, upto: int) -> np.ndarray:
            out = np.ones(n, bool)
            out[1:] = np.logical_or.reduce([c[x][1:] != c[x][:-1] for x in names])
            out[0] = before is None or first[:upto] != before[:upto]
            return out

        new_hash = changes("h1", "h2", upto=2)
        new_doc = new_hash | changes("doc", "none", upto=4)
        new_row = new_doc | changes("version", "place", upto=6)
        if new_hash[0] and before is not None:
            yield from self.ended(False)
            self.inner = True
        cuts = np.unique(np.concatenate([[0], np.flatnonzero(new_hash), [n]]))
        sizes = np.diff(cuts)
        # documents of its hash up to each row, itself included, and in all so far
        upto = np.cumsum(new_doc)
        base = upto[cuts[:-1]] - new_doc[cuts[:-1]]
        base[0] = 0 if new_hash[0] else -self.docs
        nth = upto - np.repeat(base, sizes)
        most = np.repeat(nth[cuts[1:] - 1], sizes)
        inner = np.arange(n) >= (0 if self.inner else cuts[1])
        later = nth > 1
        yield self.rows(GONE, c, new_row & later & (most >= self.least))
        # the first document of a range's first hash is perhaps not the largest that holds it
        yield self.rows(OPEN, c, new_row & ~later & ~inner)
        wait = new_row & later & (most < self.least)
        docs = new_doc & (nth <= self.least)
        self._meet(c, wait, docs, 0, int(cuts[1]))
        if most[0] >= self.least:
            for held in self.held:
                yield self.rows(GONE, held, np.ones(len(held["h1"]), bool))
            self.held = []
        if len(cuts) > 2:
            yield from self.ended(False)
            self.inner = True
            self._meet(c, wait, docs, int(cuts[-2]), n)
        self.docs = int(nth[-1])

    def _meet(self, c: dict[str, np.ndarray], wait: np.ndarray, docs: np.ndarray, a: int, b: int) -> None:
        """Holds the waiting lines and first documents of the rows from a to b, which are of the current hash."""
        if wait[a:b].any():
            self.held.append({k: v[a:b][wait[a:b]] for k, v in c.items()})
        self.edge += [tuple(c[x][i].item() for x in ("h1", "h2", "doc", "none")) for i in a + np.flatnonzero(docs[a:b])]


def _streamed(least_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = _Stream(least_docs)
        for batch in batches:
            if len(batch):
                doc = batch.column("doc_id")
                c = {x: batch.column(x).to_numpy() for x in ("h1", "h2", "version", "place")}
                c |= {"doc": pc.fill_null(doc, 0).to_numpy(), "none": pc.is_null(doc).to_numpy(zero_copy_only=False)}
                yield from (b for b in stream.chunk(c) if len(b))
        if stream.last is not None:
            yield from stream.ended(True)

    return run


def dropped_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(doc_id, version, place) of the lines that go; a row may come more than once where a document's row is repeated."""
    rows = stash(line_rows(docs, least_chars), "line-rows")
    order = ["h1", "h2", F.col("doc_id").desc_nulls_last(), "version", "place"]
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    found = stash(ranges.mapInArrow(_streamed(least_docs), "kind int, h1 long, h2 long, doc_id long, version long, place int"), "line-found")
    unstash(rows)
    # documents of the hashes at the ends of ranges: two hashes a task at most
    docs_of = found.where(F.col("kind") == EDGE).select("h1", "h2", "doc_id").distinct()
    ends = docs_of.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("doc_id").alias("largest")).where(F.col("docs") >= least_docs)
    late = found.where(F.col("kind") == OPEN).join(ends, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("largest")))
    columns = ["doc_id", "version", "place"]
    return found.where(F.col("kind") == GONE).select(columns).unionAll(late.select(columns))


def _bitmap(places: pd.Series) -> pd.Series:
    """Keep bits up to the byte of the last line that goes, packed and deflated; lines beyond stay."""

    def one(gone: np.ndarray) -> bytes:
        keep = np.ones((int(gone.max()) // 8 + 1) * 8, bool)
        keep[gone] = False
        return zlib.compress(np.packbits(keep).tobytes(), 1)

    return places.map(one)


def keep_bits(bitmap: bytes | None, n: int) -> np.ndarray:
    """Which of a text's n lines stay, from its bitmap."""
    keep = np.ones(n, bool)
    if bitmap is not None:
        some = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[:n]
        keep[: len(some)] = some
    return keep


def keep_bitmaps(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, version, n_dropped, keep) for each document that loses a line; version is xxhash64 of its text.

    A line's key is the line without white space at both ends, A-Z lower-cased. Keys of
    at least ``least_chars`` code points in at least ``least_docs`` documents lose all
    their lines except in the largest doc_id holding them, which keeps all of its own.
    Rows alike in doc_id and text are one document; rows that share a doc_id with
    different texts count as one document when documents are counted but have bitmaps
    of their own. Rows without a doc_id together count as one document, lesser than
    any. Null and empty texts are one empty line. An empty table gives none.
    """
    gone = dropped_lines(docs, **how).groupBy("doc_id", "version").agg(F.collect_set("place").alias("places"))
    return gone.select("doc_id", "version", F.size("places").cast("long").alias("n_dropped"), F.pandas_udf(_bitmap, "binary")("places").alias("keep"))


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces each text by its kept lines; adds how many lines it had and lost."""
    for batch in batches:
        at = batch.schema.get_field_index("__text")
        for start, stop in slices(batch.column(at), SLICE_ROWS, SLICE_BYTES):
            part = batch.slice(start, stop - start)
            texts, lines, gone = [], [], []
            for text, bitmap in zip(part.column("__text").to_pylist(), part.column("__keep").to_pylist(), strict=True):
                n = text.count("\n") + 1
                if bitmap is not None:
                    keep = keep_bits(bitmap, n)
                    text = "\n".join(line for line, stays in zip(text.split("\n"), keep.tolist(), strict=True) if stays)
                    gone.append(n - int(keep.sum()))
                else:
                    gone.append(0)
                texts.append(text)
                lines.append(n)
            names = [f.name for f in batch.schema if f.name not in ("__text", "__keep")]
            own = [pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(gone, pa.int64())]
            yield pa.RecordBatch.from_arrays([*(part.column(x) for x in names), *own], [*names, "__kept", "__lines", "__gone"])


def without_shared_lines(docs: DataFrame, **how) -> DataFrame:
    """Every row of docs(doc_id, text, ...) with its text reduced to the lines it keeps; all columns stay.

    A null text becomes an empty one. Nulls, repeats and empty tables are as in ``keep_bitmaps``.
    """
    names = [f"__in{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index("text")]
    kept = _kept(docs, docs.toDF(*names), names[docs.columns.index("doc_id")], text, how).withColumn(text, F.col("__kept"))
    return kept.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def _kept(docs: DataFrame, rows: DataFrame, doc_id: str, text: str, how: dict) -> DataFrame:
    bitmaps = stash(keep_bitmaps(docs, **how), "line-keep").withColumnsRenamed({"doc_id": "__doc", "version": "__version", "keep": "__keep"}).drop("n_dropped")
    rows = rows.withColumn("__text", whole(text)).drop(text)
    met = rows.join(bitmaps.hint("shuffle_hash"), F.col(doc_id).cast("long").eqNullSafe(F.col("__doc")) & (F.xxhash64("__text") == F.col("__version")), "left")
    met = met.drop("__doc", "__version")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in met.schema.fields if f.name not in ("__text", "__keep")]
    return met.mapInArrow(_applied, ", ".join([*fields, "__kept string, __lines long, __gone long"]))


def line_digest(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) for every row of docs; see ``keep_bitmaps``."""
    base = docs.select("doc_id", "text")
    kept = _kept(base, base, "doc_id", "text", how)
    return kept.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__gone").alias("n_dropped"), F.sha2(F.col("__kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = f"""
with docs as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
lines as (
  select rid, doc_id, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as place from docs),
keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') as key from lines),
found as (
  select key, max(doc_id) as largest from keyed where length(key) >= {LEAST_CHARS} group by key having count(distinct coalesce(doc_id::varchar, '')) >= {LEAST_DOCS}),
judged as (
  select rid, k.doc_id, line, place, f.key is not null and k.doc_id is distinct from f.largest as gone from keyed k left join found f on k.key = f.key)
select any_value(doc_id) as doc_id, count(*)::bigint as n_lines, count(*) filter (where gone)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by place) filter (where not gone), '')) as kept_sha256
from judged group by rid
"""
