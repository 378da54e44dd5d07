"""Whitening held against numpy's eigenvectors of the whole covariance and exact sums."""

import random

import numpy as np
import pytest

from courtflow.llm import whitening

FIELDS = "vec_id long, embedding array<double>, label string, x string, n string, component string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, None, "clash", "clash", "clash") for i, v in rows], FIELDS)


def plain(rows):
    """{vec_id: (n, deviation, |whitened|, explained)} of rows whose vectors have one length."""
    whole = {i: tuple(int(np.floor(64 * c)) + 1_000_000 for c in v) for i, v in rows}
    fit = sorted(set(whole.values()))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = lambda x: np.array([(n * c - s) / n for c, s in zip(x, sums, strict=True)])
    c = np.array([centred(x) for x in fit])
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    k = min(16, int((e > 1e-12 * e[0]).sum()))
    return {i: (n, sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)), centred(x) @ u[:, :k] / np.sqrt(e[:k]), e[:k] / np.trace(v)) for i, x in whole.items()}


def compare(got, rows):
    want, by = plain(rows), {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    assert set(by) == set(want)
    signs = None
    for i, (n, deviation, white, explained) in want.items():
        own = sorted(by[i], key=lambda r: r.component)
        assert [r.component for r in own] == list(range(1, len(white) + 1))
        assert all(r.n == n and r.deviation == deviation and r.identity_error < 1e-9 for r in own)
        values = np.array([r.whitened for r in own])
        if signs is None:
            signs = np.where(np.abs(values + white) < np.abs(values - white), -1, 1)
            firm = np.abs(white) > 1e-3
        assert np.allclose((values * signs)[firm], white[firm], rtol=1e-6, atol=1e-6)
        assert np.allclose([r.explained for r in own], explained, rtol=1e-9)


@pytest.mark.parametrize("dim, rank", [(64, 64), (40, 5), (7, 7), (60, 20)])
def test_agrees_with_whole_covariance(spark, dim, rank):
    r = np.random.default_rng(dim)
    x = r.normal(size=(400, rank)) * np.geomspace(8, 1, rank) @ np.linalg.qr(r.normal(size=(dim, rank)))[0].T + 3
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    rows += [(1000 + i, v) for i, v in rows[:50]]  # repeats count once in the fit
    compare(whitening.whitened(table(spark, rows).repartition(5)).collect(), rows)


def test_steep_spectrum_needs_no_expansion(spark, monkeypatch):
    r = np.random.default_rng(3)
    x = r.normal(size=(500, 16)) * np.geomspace(2000, 100, 16) @ np.linalg.qr(r.normal(size=(50, 16)))[0].T
    rows = list(enumerate((np.round(x * 64) / 64).tolist()))
    blocks = []
    times = whitening._times
    monkeypatch.setattr(whitening, "_times", lambda f, c, b: blocks.append({d: q.shape[1] for d, q in b.items()}) or times(f, c, b))
    got = whitening.whitened(table(spark, rows)).collect()
    compare(got, rows)
    assert 2 <= len(blocks) <= whitening.PASSES and set(map(str, blocks)) == {"{50: 26}"}


def test_odd_rows(spark):
    good = [(i, [float(i % 5), float(i % 3), 1.0]) for i in range(30)]
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [1.0, float("nan"), 2.0]), (104, [float("inf"), 0.0, 0.0]), (105, [1.0, 2.0]), (106, [4.0, 9.0])]
    got = whitening.whitened(table(spark, [*good, *odd])).collect()
    compare([r for r in got if r.vec_id < 100], good)
    # vectors of another length are fitted apart: two points span one dimension
    assert {(r.vec_id, r.component, r.n) for r in got if r.vec_id >= 100} == {(105, 1, 2), (106, 1, 2)}
    assert all(abs(abs(r.whitened) - 1) < 1e-12 and abs(r.explained - 1) < 1e-12 for r in got if r.vec_id >= 100)
    ties = whitening.whitened(table(spark, [(1, [0.5, 0.5])] * 4)).collect()
    assert ties == [] and whitening.whitened(table(spark, [])).collect() == []
    nameless = whitening.whitened(table(spark, [(None, [0.0, 1.0]), (None, [0.0, 1.0]), (2, [2.0, 5.0])])).collect()
    assert [r.vec_id for r in nameless].count(None) == 2


def test_deviation_is_exact_or_null():
    r = random.Random(1)
    x = np.array([[r.randrange(-(10**15), 10**15) for _ in range(3)] for _ in range(4)])
    for n in (4, 10**6):
        sums = [r.randrange(-(10**15) * n, 10**15 * n) for _ in range(3)]
        want = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
        assert whitening.Centre(n, sums).deviations(x) == [v if v < 1 << 63 else None for v in want]
    small = np.array([[1_000_001, 999_999]])
    assert whitening.Centre(3, [3_000_001, 2_999_999]).deviations(small) == [(3 * 1_000_001 - 3_000_001) ** 2 + (3 * 999_999 - 2_999_999) ** 2]
