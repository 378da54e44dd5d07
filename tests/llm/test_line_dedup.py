"""Line dedup held against a plain loop, over many ranges and small chunks."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from tests.llm.inputs import awkward_docs, no_docs

from courtflow.llm import linededup
from courtflow.llm.shared import arrow_rows

ENDS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans(linededup.UPPER, linededup.LOWER)


def plain(rows, least_chars=20, least_docs=3):
    """(doc_id, n_lines, n_dropped, kept text) of each (doc_id, text)."""
    key = lambda line: line.strip(ENDS).translate(LOWER)
    held = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            held[key(line)].add(d)
    largest = {k: max(ds, key=lambda d: (d is not None, d or 0)) for k, ds in held.items() if len(k) >= least_chars and len(ds) >= least_docs}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if key(x) not in largest or largest[key(x)] == d]
        out.append((d, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def compare(spark, docs, **how):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = [(d, n, gone, hashlib.sha256(t.encode()).hexdigest()) for d, n, gone, t in plain(rows, **how)]
    got = [tuple(r) for r in linededup.line_digest(docs, **how).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    return got


@pytest.mark.parametrize("seed, least_docs", [(1, 3), (2, 3), (3, 2), (4, 1), (5, 5)])
def test_stream_agrees_with_plain_loop(spark, seed, least_docs):
    r = random.Random(seed)
    pool = [f"Shared line number {i} which is long enough" for i in range(6)] + ["short", "", "  Shared LINE number 0 which is long enough\t", "one line that nearly every document holds"]
    docs = []
    for i in range(120):
        lines = [r.choice(pool[:-1]) if r.random() < 0.5 else f"own line {r.random()} of a document" for _ in range(r.randrange(0, 9))]
        docs.append((r.choice([i, i, i, 7, None]), "\n".join([*lines, *[pool[-1]] * r.randrange(0, 4)])))
    docs += docs[:5]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    # many ranges, so that the common line lies in several, and chunks of a few rows
    keys = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        with arrow_rows(spark, 3 + seed):
            got = compare(spark, df, least_docs=least_docs)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(x[2] for x in got) > 100


def test_one_line_in_every_document(spark):
    docs = spark.range(0, 3000, 1, 12).selectExpr("id as doc_id", "concat('x', id, '\nA line that all documents hold\n a line that ALL documents hold') as text")
    got = {r.doc_id: r.n_dropped for r in linededup.line_digest(docs).collect()}
    assert got == {i: 0 if i == 2999 else 2 for i in range(3000)}


def test_awkward_and_empty(spark):
    odd = awkward_docs(spark)
    compare(spark, odd)
    kept = linededup.without_shared_lines(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert linededup.line_digest(no_docs(spark)).count() == 0
    long = "\n".join(f"a long line of text, number {i % 40_000}" for i in range(80_000))
    more = spark.createDataFrame([(1, long), (2, long), (3, long), (4, None), (5, "")], "doc_id long, text string")
    assert {r[0]: r[1:] for r in compare(spark, more)}[1][:2] == (80_000, 80_000)


def test_bitmaps_round_trip():
    import pandas as pd

    r = random.Random(0)
    for n in (1, 7, 8, 9, 1000):
        gone = r.sample(range(n), max(1, n // 3))
        keep = linededup.keep_bits(linededup._bitmap(pd.Series([np.array(gone)]))[0], n)
        assert sorted(np.flatnonzero(~keep).tolist()) == sorted(gone)
    assert linededup.keep_bits(None, 5).all()
    assert len(linededup._bitmap(pd.Series([np.arange(100_000)]))[0]) < 200
