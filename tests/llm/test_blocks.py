"""Links within a unit of work, against union-find."""

import numpy as np
import pytest

from structlens.llm import embedding_dedup, simhash
from structlens.llm._blocks import star


def _union_find(left, right, n):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in zip(left, right, strict=True):
        x, y = sorted((find(int(a)), find(int(b))))
        label[y] = x
    return [find(x) for x in range(n)]


def test_star_keeps_a_chain_with_a_low_end():
    assert star(np.array([1, 2, 3]), np.array([2, 3, 0]), 4).tolist() == [0, 0, 0, 0]


@pytest.mark.parametrize("n", [2, 5, 30, 200])
def test_star_of_chains_and_sparse_links(n):
    rng = np.random.default_rng(n)
    for _ in range(30):
        order = rng.permutation(n)
        assert not star(order[:-1], order[1:], n).any()
        i, j = rng.integers(0, n, (2, n))
        assert star(i, j, n).tolist() == _union_find(i, j, n)
    assert star(np.array([], int), np.array([], int), n).tolist() == list(range(n))


def test_chain_of_vectors_is_one_component(spark):
    # each vector links with its two neighbours on the arc only
    angle = np.random.default_rng(5).permutation(40) * 0.11
    rows = [(i, [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate(angle)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), cosine=float(np.cos(0.15))).collect()
    assert len(got) == 40 and {r.component_id for r in got} == {0} and sum(r.n_links for r in got) == 78


def test_chain_of_fingerprints_in_one_long_unit(spark):
    # neighbours in a chain differ in one bit, and the two chains in two bits more
    rng = np.random.default_rng(3)
    fp = np.bitwise_xor.accumulate(np.append(rng.integers(0, 1 << 48), 1 << rng.permutation(48)))
    df = spark.createDataFrame([(int(x),) for x in np.append(fp, fp + (3 << 60))], "fp long")
    batches = df.selectExpr("0L key", "0 ci", "0 cj", "0 side", "fp").coalesce(1).sortWithinPartitions("fp").mapInArrow(simhash._verify(1), "a long, b long").collect()
    left, right = zip(*((r.a, r.b) for r in batches), strict=True)
    at = {int(r.fp): k for k, r in enumerate(df.collect())}
    assert len(set(_union_find([at[x] for x in left], [at[x] for x in right], 98))) == 2
