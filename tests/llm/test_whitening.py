"""Embedding whitening: eigenpairs against numpy's, the query against brute force, odd inputs."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import registry, whitening

SF = "/root/testdata/sf0.001"


def spectra():
    r = np.random.default_rng(7)
    yield r.random(30)
    yield np.array([5.0] * 20 + [1.0] * 20)
    yield np.array([3.0] * 4 + [2.0] * 9 + [1.0] * 3 + [0.0] * 5)
    yield 10.0 ** -r.integers(0, 13, 40)
    yield np.append(np.ones(6), np.full(8, 1 - 1e-9))
    yield np.linspace(10, 9.999, 48)
    yield np.ones(33)
    yield np.array([2.0])
    yield 2.0 ** -np.arange(64)


@pytest.mark.parametrize("values", list(spectra()))
@pytest.mark.parametrize("k", [1, 5, 16])
def test_contour_integration_misses_no_eigenpair(values, k):
    d = len(values)
    q = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))[0]
    v = q @ np.diag(values) @ q.T
    v = (v + v.T) / 2
    e, x = whitening.eigenpairs(v, k)
    want = np.linalg.eigvalsh(v)[::-1]
    assert len(e) == min(k, (want > 8 * d * np.finfo(float).eps * np.abs(v).sum(1).max()).sum())
    assert np.abs(e - want[: len(e)]).max() <= 1e-14 * want[0] * 4
    assert np.abs(v @ x - x * e).max() <= 4e-15 * want[0] * math.sqrt(d) and np.abs(x.T @ x - np.eye(len(e))).max() < 1e-13


def test_inertia_counts():
    a = np.random.default_rng(3).standard_normal((25, 25))
    a = a + a.T
    shifts = np.linspace(-12, 12, 41)
    want = (np.linalg.eigvalsh(a)[:, None] < shifts).sum(0)
    assert whitening.count_below(*whitening.tridiagonal(a), shifts).tolist() == want.tolist()


def brute(rows, k=16):
    """rows: (vec_id, list or None) of one length where they count; x as the contract says."""
    good = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, d = len(fit), len(fit[0])
    s = [sum(x[j] for x in fit) for j in range(d)]
    centred = np.array([[(n * x[j] - s[j]) / n for j in range(d)] for x in fit])
    v = centred.T @ centred / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    out = []
    for i, x in good:
        w = np.array([(n * a - b) / n for a, b in zip(x, s, strict=True)]) @ q / np.sqrt(e)
        out.append((i, n, sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True)), w, e / np.trace(v)))
    return out


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query_equals_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = {i: x for i, *x in brute(rows)}
    got = registry.QUERIES["op13_whitening"](spark, SF).collect()
    assert len(got) == 16 * len(want) and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-6
    sign = {}
    for r in got:
        n, deviation, w, explained = want[r.vec_id]
        assert (r.n, r.deviation) == (n, deviation) and abs(r.explained - explained[r.component - 1]) < 1e-9 * explained[0]
        if abs(r.whitened) > 1e-6:
            sign.setdefault(r.component, np.sign(r.whitened * w[r.component - 1]))
        assert abs(r.whitened - sign.get(r.component, 1) * w[r.component - 1]) < 1e-8


def table(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return df.withColumn("v", F.lit("clash")).withColumn("x", F.lit(1)).withColumn("d", F.lit(2)).withColumn("id", F.lit(None).cast("int"))


def random_rows(n=80, d=5, seed=4):
    r = np.random.default_rng(seed)
    return [(i, (r.standard_normal(d) * [3, 1, 1, 0.5, 0.2][:d]).tolist()) for i in range(n)]


def test_odd_inputs(spark):
    rows = random_rows()
    odd = [(100, None), (101, []), (102, [1.0, None, 0.0, 0.0, 0.0]), (103, [float("nan")] + [0.0] * 4), (104, [float("inf")] + [0.0] * 4), (105, [1e300] * 5), (106, [1.0, 2.0])]
    again = [(None, rows[0][1]), (3, rows[3][1]), (3, rows[4][1]), (200, rows[5][1])]
    df = table(spark, rows + odd + again).repartition(7)
    model = whitening.fit(df)
    got = whitening.whiten(df, model).collect()
    want = brute(rows + again)
    assert (model.n, model.d, len(model.values), model.identity_error < 1e-6) == (80, 5, 5, True)
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted([(r.vec_id, r.deviation) for r in got], key=key) == sorted([(i, dev) for i, _, dev, _, _ in want], key=key)
    assert whitening.fit(table(spark, rows + again).coalesce(1)).components.tolist() == model.components.tolist()


def test_large_entries_are_summed_exactly(spark):
    r = np.random.default_rng(9)
    rows = [(i, (r.standard_normal(3) * [1e9, 1e6, 1e13]).tolist()) for i in range(40)]
    model = whitening.fit(table(spark, rows))
    got = {x.vec_id: x.deviation for x in whitening.whiten(table(spark, rows), model).collect()}
    want = {i: dev if dev < 1 << 63 else None for i, _, dev, _, _ in brute(rows)}
    assert got == want and np.allclose(model.values / model.trace, brute(rows)[0][4], rtol=1e-12)


def test_tables_without_spread(spark):
    assert whitening.fit(table(spark, []).limit(0)) is None and whitening.fit(table(spark, [(1, None), (2, [])])) is None
    same = table(spark, [(k, [1.0, 2.0]) for k in range(5)])
    model = whitening.fit(same)
    assert model.n == 1 and len(model.values) == 0 and [x.deviation for x in whitening.whiten(same, model).collect()] == [0] * 5
    line = whitening.fit(table(spark, [(k, [float(k), 2.0 * k, 0.0]) for k in range(9)]))
    assert len(line.values) == 1 and line.identity_error < 1e-6
