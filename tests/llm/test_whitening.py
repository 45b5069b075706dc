"""Whitening against exact fractions and plain numpy."""

from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from structlens.llm import whitening

VECTORS = "vec_id long, embedding array<float>, label int, x string, v int, y int"


def _brute(rows, components=32):
    good = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = [[int(np.floor(np.float64(np.float32(c)) * 64)) + 1_000_000 for c in v] for _, v in good]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    dev = [[n * a - b for a, b in zip(r, s)] for r in x]
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in dev), n**3)) for j in range(d)] for i in range(d)])
    e, a = np.linalg.eigh(cov)
    e, a = e[::-1], a[:, ::-1]
    w = np.array([[float(Fraction(c, n)) for c in r] for r in dev]) @ a[:, :components] / np.sqrt(e[:components])
    return {(i, k + 1): (n, sum(c * c for c in r), w[m, k], e[k] / np.trace(cov)) for m, ((i, _), r) in enumerate(zip(good, dev)) for k in range(min(d, components))}


def _compare(got, want):
    assert {(r.vec_id, r.component) for r in got} == set(want) and len(got) == len(want)
    for k in {r.component for r in got}:
        own = [r for r in got if r.component == k]
        a, b = np.array([r.whitened for r in own]), np.array([want[r.vec_id, k][2] for r in own])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8
        assert all((r.n, r.deviation) == want[r.vec_id, k][:2] and abs(r.explained / want[r.vec_id, k][3] - 1) < 1e-9 for r in own)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_against_fractions(spark):
    rng = np.random.default_rng(0)
    for d, n in ((5, 40), (40, 300), (8, 60)):
        v = (rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) + 3).astype(np.float32)
        rows = [(i, r.tolist()) for i, r in enumerate(v)] + [(9001, None), (9002, [None] + [1.0] * (d - 1)), (9003, [float("nan")] * d), (9004, [float("-inf")] + [0.0] * (d - 1)), (9005, [])]
        frame = spark.createDataFrame([(i, r, 0, "a", 1, 2) for i, r in rows], VECTORS).repartition(3)
        _compare(whitening.whiten(frame).collect(), _brute(rows))


def test_all_the_table(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    want = _brute([(r.vec_id, r.embedding) for r in vectors.collect()])
    _compare(whitening.query(spark, "/root/testdata/sf0.001").collect(), want)


def test_awkward_vectors(spark):
    make = lambda rows: whitening.whiten(spark.createDataFrame([(i, v, None, None, None, None) for i, v in rows], VECTORS))
    assert make([]).count() == 0 and make([(1, None), (2, [])]).columns == make([]).columns
    # one vector, or equal ones: no variance, so no components to project on
    for rows in ([(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])]):
        got = make(rows).collect()
        assert len(got) == 2 * len(rows) and all(r.deviation == 0 and r.whitened is None and r.explained is None and r.identity_error is None for r in got)
    # a dimension without variance: its component has no values, the others are right
    got = make([(i, [float(i), 5.0]) for i in range(4)]).orderBy("vec_id", "component").collect()
    assert [r.whitened is None for r in got] == [False, True] * 4 and got[0].explained == 1.0 and got[0].identity_error < 1e-12
    # other lengths than the most frequent one are left out, repeated rows stay
    got = make([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, 1.0]), (3, [1.0]), (4, [1.0, 2.0, 3.0])]).collect()
    assert sorted(r.vec_id for r in got) == [1, 1, 1, 1, 2, 2] and {r.n for r in got} == {3}
    # entries beyond the longs are left out; deviations beyond them are null and the rest stays right
    big = [(i, [float(2**40) * (i % 3), float(i)]) for i in range(9)] + [(99, [1e30, 1.0])]
    got = make(big).collect()
    assert {r.vec_id for r in got} == set(range(9)) and all((r.deviation is None) == (r.vec_id % 3 != 1) for r in got) and got[0].identity_error < 1e-9


def test_no_vector_is_shuffled(spark):
    rows = whitening.whole_vectors(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet"))
    plan = whitening.whiten(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    many = whitening.pair_sums(rows.select(F.col("x").alias("y")), "y", 64)
    x = np.array([r.x for r in rows.collect()], object)
    assert (many == x.T @ x).all()
