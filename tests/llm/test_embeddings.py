"""Embedding dedup against all pairs, and its recall with cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from structlens.llm import embedding_dedup

SCHEMA = "vec_id long, embedding array<float>, label int"


def _expected(rows, cosine=0.9):
    good = {}
    for i, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.asarray(v, np.float32).astype(np.float64)
    ids = [i for i, _ in rows]
    label, links = {i: i for i in ids}, dict.fromkeys(ids, 0)

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in good:
        for b in good:
            if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.sqrt(good[a] @ good[a]) / np.sqrt(good[b] @ good[b]) >= cosine:
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return sorted((i, links[i], find(i), i == find(i)) for i in ids)


def _vectors(n, d=8, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 6 + 1, d))
    return [(i, [float(x) for x in centres[i % len(centres)] + rng.normal(size=d) * rng.choice([0, 0.05, 0.4])]) for i in range(n)]


def test_few_cells_are_exact(spark):
    rows = _vectors(150) + [(900, None), (901, []), (902, [0.0] * 8), (903, [1.0, None] * 4), (904, [float("nan")] * 8), (905, [float("inf")] * 8), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (908, [-0.0, 1.0]), (909, [0.0, 1.0])]
    got = embedding_dedup.near_duplicates(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA), chunk_rows=20, segment_rows=30).collect()
    assert sorted(tuple(r) for r in got) == _expected(rows)


def test_cells_count_each_pair_once(spark):
    rows = _vectors(300, seed=2)
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    # as many probes as cells: every pair shares several cells, and the result is exact
    got = embedding_dedup.near_duplicates(df, cell_rows=80, probes=99, chunk_rows=16, segment_rows=50).collect()
    assert sorted(tuple(r) for r in got) == _expected(rows)


def test_recall_and_precision_with_few_probes(spark):
    rows = _vectors(900, d=16, seed=3)
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    options = {"cell_rows": 60, "probes": 4}
    found, there = embedding_dedup.recall(df, **options)
    assert there > 0 and found >= 0.9 * there
    exact = {i: n for i, n, _, _ in _expected(rows)}
    assert all(r.n_links <= exact[r.vec_id] for r in embedding_dedup.near_duplicates(df, **options).collect())


def test_two_levels_of_cells(spark):
    rows = _vectors(900, d=16, seed=3)
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    exact = embedding_dedup.near_duplicates(df, cell_rows=10, most_cells=9, probes=200, chunk_rows=16).collect()
    assert sorted(tuple(r) for r in exact) == _expected(rows)
    found, there = embedding_dedup.recall(df, cell_rows=20, most_cells=9, probes=6)
    assert there > 0 and found >= 0.9 * there


def test_a_dense_group_is_one_cell(spark):
    rng = np.random.default_rng(1)
    far, centre = rng.normal(size=(600, 16)), rng.normal(size=16)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(far)] + [(1000 + i, [float(x) for x in centre + rng.normal(size=16) * 0.05]) for i in range(400)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    got = embedding_dedup.near_duplicates(df, cell_rows=20, probes=2, chunk_rows=50, segment_rows=70).collect()
    assert sorted(tuple(r) for r in got if r.vec_id >= 1000) == [r for r in _expected(rows) if r[0] >= 1000]


@pytest.mark.parametrize(("noise", "cells"), [(0.01, 1024), (0.04, 80), (0.08, 80), (0.2, 1024)])
def test_a_dense_group_in_chunks_by_angle(spark, noise, cells):
    """Links that are sure by their angles, links that are compared, and visitors: all pairs, whatever the spread."""
    rng = np.random.default_rng(int(noise * 100))
    centre = rng.normal(size=8)
    rows = [(i, [float(x) for x in centre + rng.normal(size=8) * noise * rng.choice([0.2, 1, 2])]) for i in range(260)] + [(1000 + i, [float(x) for x in centre + rng.normal(size=8) * 0.6]) for i in range(140)] + [(2000 + i, [float(x) for x in -centre + rng.normal(size=8) * 0.02]) for i in range(60)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    got = embedding_dedup.near_duplicates(df, chunk_rows=16, segment_rows=40, cell_rows=cells, probes=99).collect()
    assert sorted(tuple(r) for r in got) == _expected(rows)


def test_rows_dealt_grow_with_a_dense_group(spark):
    """No vector of a dense group is written once for every chunk."""
    written = {}
    for n in (5000, 25_000):
        rng = np.random.default_rng(n)
        v = (rng.normal(size=16) + rng.normal(size=(n, 16)) * 0.03).astype(np.float32)
        df = spark.createDataFrame([(i, r.tolist(), 0) for i, r in enumerate(v)], SCHEMA)
        rows, found = embedding_dedup.classes(df)
        of = embedding_dedup.fit(rows, cell_rows=1024, most_cells=5000, sample_rows=40_000)
        found = found.select("first", F.size("v").alias("dim"), F.xxhash64("cls.h1", "cls.h2").alias("id"), "n", "v")
        cells = found.mapInArrow(embedding_dedup._assign(of, 4), "first long, dim int, id long, n long, v array<float>, near array<long>, angles array<double>")
        dealt, sure = embedding_dedup._dealt(cells, 100, 400, 0.9)
        written[n] = dealt.count()
        assert sure.count() + dealt.where("role = 0").select("id").distinct().count() >= n
    assert written[25_000] <= 2 * 25_000 and written[5000] <= 2 * 5000


def test_very_large_and_very_small_components_and_clashing_names(spark):
    rows = [(0, [1e200, 0.0]), (1, [1e200, 1e199]), (2, [1e-200, 0.0]), (3, [1e-200, 1e-201]), (4, [0.0, 1e300])]
    df = spark.createDataFrame([(i, v, "x", 7, "y") for i, v in rows], "vec_id long, embedding array<double>, id string, n int, cls string").withColumns({c: F.lit(1) for c in ("v", "near", "cell", "dim", "role", "unit")})
    got = sorted(tuple(r) for r in embedding_dedup.near_duplicates(df).collect())
    assert got == [(0, 3, 0, True), (1, 3, 0, False), (2, 3, 0, False), (3, 3, 0, False), (4, 0, 4, True)]


def test_hot_copies_repeated_rows_and_empty(spark):
    rows = [(i, [1.0, 2.0, 3.0], 0) for i in range(200)] + [(5, [1.0, 2.0, 3.0], 0), (700, [3.0, 6.0, 9.0], 0), (None, [0.0, 1.0, 0.0], 1)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows) and {(r.n_links, r.component_id) for r in got if r.vec_id is not None} == {(201, 0)}
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, True)]
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_kmeans_is_deterministic():
    x = np.asarray([v for _, v in _vectors(200)])
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    a, b = embedding_dedup.spherical_kmeans(x, 9), embedding_dedup.spherical_kmeans(x, 9)
    assert np.array_equal(a, b) and np.allclose((a * a).sum(1), 1)
