import math
from fractions import Fraction

import duckdb
import numpy as np

from trekmill.llm import queries, whitening


def brute(rows, scale=256):
    """Exact sums over the distinct vectors, their covariance in fractions, numpy's eigenvectors."""
    kept = [(i, tuple(math.floor(scale * c) for c in v)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({x for _, x in kept})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(d)]
    centred = np.array([[float(Fraction(n * x[k] - sums[k], n)) for k in range(d)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:4]
    out = {}
    for i, x in kept:
        c = np.array([float(Fraction(n * x[k] - sums[k], n)) for k in range(d)])
        out.setdefault((i, x), (sum((n * x[k] - sums[k]) ** 2 for k in range(d)), c @ vectors[:, order] / np.sqrt(values[order])))
    return n, out, values[order] / values.sum(), kept


def test_query_against_brute_force(spark):
    rows = duckdb.sql("select vec_id, embedding from '/root/testdata/sf0.01/embeddings.parquet'").fetchall()
    n, want, explained, kept = brute(rows)
    got = queries.op13_whitening(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == 4 * len(kept)
    by_id = dict(kept)
    signs = {}
    for r in sorted(got, key=lambda r: (r.component, r.vec_id)):
        deviation, z = want[r.vec_id, by_id[r.vec_id]]
        assert (r.n, r.deviation) == (n, deviation) and abs(r.explained / explained[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9
        s = signs.setdefault(r.component, 1.0 if z[r.component - 1] * r.whitened > 0 else -1.0)
        assert abs(r.whitened - s * z[r.component - 1]) < 1e-9


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.001]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (8, [0.0, -0.0]), (None, [-3.5, 4.0]), (9, [1.0]), (10, [1e300, 0.0])]
    docs = spark.createDataFrame([(i, v, "c", "r", 7) for i, v in rows], "vec_id long, embedding array<double>, component string, row string, x int")
    got = whitening.whiten(docs).collect()
    assert sorted((r.vec_id or -1, r.component) for r in got) == sorted([(i, c) for i in (1, 1, 2, 8, -1) for c in (1, 2)])
    assert {r.n for r in got} == {3} and all(r.row == "r" and r.x == 7 for r in got)  # 2.001 and 2 are one vector in steps of 1/256
    assert len({r.whitened for r in got if r.vec_id in (1, 2) and r.component == 1}) == 1


def test_directions_without_variance_are_left_out(spark):
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(6)], "vec_id long, embedding array<float>")
    got = whitening.whiten(line).collect()
    assert len(got) == 6 and {r.component for r in got} == {1} and abs(got[0].explained - 1) < 1e-12
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(3)], "vec_id long, embedding array<double>")
    assert whitening.whiten(same).count() == 0 and whitening.whiten(same.limit(0)).count() == 0


def test_large_entries_stay_exact(spark):
    big = [[2.0**50 + 256 * i, float(i * i)] for i in range(5)]
    got = whitening.whiten(spark.createDataFrame([(i, v) for i, v in enumerate(big)], "vec_id long, embedding array<double>")).collect()
    x = [[math.floor(256 * c) for c in v] for v in big]
    sums = [sum(c) for c in zip(*x, strict=True)]
    assert {(r.vec_id, r.deviation) for r in got} == {(i, sum((5 * c - s) ** 2 for c, s in zip(v, sums, strict=True))) for i, v in enumerate(x)}
    assert all(r.identity_error < 1e-4 for r in got)
