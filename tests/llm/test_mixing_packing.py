"""Mixing and packing: targets, order, conflicts."""

import pytest
from pyspark.sql import functions as F

from structlens.llm import mixing, packing

SCHEMA = "doc_id long, text string, source string, n_chars long"


def _docs(spark, n=400):
    return spark.createDataFrame([(i, " ".join(["w"] * (i % 37 * 3)), None if i % 11 == 0 else ["a", "b", "c", "d"][min(3, i % 9)], i) for i in range(n)], SCHEMA)


def test_plan_meets_targets(spark):
    rows = mixing.plan(_docs(spark)).collect()
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        by.setdefault((r.source_size, r.target), [0, 0])
        by[r.source_size, r.target][0] += r.taken
        by[r.source_size, r.target][1] += r.size
    total = sum(r.size for r in rows)
    assert abs(sum(t for _, t in by) - 1.5 * total) < 1e-6 * total
    for (size, target), (taken, own) in by.items():
        assert own == size and target <= 2 * size + 1e-9 and abs(taken - target) <= 1
    assert [tuple(r) for r in rows] == [tuple(r) for r in mixing.plan(_docs(spark).repartition(7)).collect()]
    order = [r.position for r in rows if r.position is not None]
    assert order == sorted(order)


def test_water_filling(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 0)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    # weights 3, 1, 2, 3: a stops at 20, the rest is shared 1 : 2 up to c's 2000
    assert got["a"] == 20 and got[None] == 0 and abs(got["b"] - 1005 - 0) < 11 and abs(got["c"] - 2 * got["b"]) < 1e-6 and abs(sum(got.values()) - 3015) < 1e-6


def test_schedule_inverse(spark):
    for k, points in enumerate(mixing.SCHEDULES):
        area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:], strict=False))
        for u in (0.0, 0.3, 0.9999):
            t = spark.range(1).select(mixing.position(F.lit(u), F.lit(k)).alias("t")).first().t
            (t0, w0), (t1, w1) = points[0], points[-1]
            demand = ((w0 * t) + (w1 - w0) / (t1 - t0) * t * t / 2) / area
            assert abs(demand - u) < 1e-9


def test_mixed_documents_are_whole(spark):
    docs = _docs(spark)
    mix = mixing.mixed_documents(docs)
    assert mix.columns == docs.columns
    n = {r.doc_id: r["count"] for r in mix.groupBy("doc_id").count().collect()}
    assert max(n.values()) <= 2 and mix.join(docs, docs.columns, "left_anti").where("source IS NOT NULL").count() == 0
    p = {r.source_size: r.target for r in mixing.plan(docs).collect()}
    got = mix.select("source", mixing.size_of(F.col("text")).alias("s")).groupBy("source").agg(F.sum("s").alias("s")).collect()
    assert all(min(abs(r.s - t) for t in p.values()) <= 60 for r in got)


def _repeated_ids(spark):
    """Rows of one id, or none, with different texts and sources, and some that are the same."""
    rows = [(7 if i % 3 else None, " ".join(["w"] * (i % 23 + 1)), ["a", "b", None][i % 3 if i % 5 else 0], i % 4) for i in range(300)]
    return rows + rows[:60] + [(1, "x y", "a", 0)] * 40


def test_reruns_agree_whatever_the_order_of_the_rows(spark):
    rows = _repeated_ids(spark)
    plans, mixes, packs = set(), set(), set()
    for n, own in ((1, rows), (5, rows[::-1]), (9, sorted(rows, key=lambda r: (r[3], len(r[1]))))):
        df = spark.createDataFrame(own, SCHEMA).repartition(n) if n > 1 else spark.createDataFrame(own, SCHEMA).coalesce(1)
        plans.add(str(sorted(map(str, mixing.plan(df).collect()))))
        mixes.add(str(sorted(map(str, mixing.mixed_documents(df).collect()))))
        packs.add(str(sorted(map(str, packing.best_fit(df, capacity=20, shard_pieces=64).collect()))))
    assert len(plans) == len(mixes) == len(packs) == 1


def test_mixed_awkward_documents_are_whole_rows(spark, awkward):
    mix = [tuple(r) for r in mixing.mixed_documents(awkward).collect()]
    own = [tuple(r) for r in awkward.collect()]
    assert set(mix) <= set(own) and all(mix.count(r) <= 2 * own.count(r) for r in set(mix))
    assert all(r[1] and r[1].split() for r in mix)


def test_many_rows_that_are_the_same(spark, monkeypatch):
    monkeypatch.setattr(packing, "SAME_ROWS", 100)
    docs = spark.createDataFrame([(1, "a b c", "s", 0)] * 1234 + [(2, "d", None, 0)] * 3, SCHEMA)
    rows = packing.best_fit(docs, capacity=4, shard_pieces=50).collect()
    assert sorted((r.doc_id, r["copy"]) for r in rows) == [(1, i) for i in range(1234)] + [(2, i) for i in range(3)]
    assert len({(r.shard, r.bin) for r in rows if r.doc_id == 1}) == 1234


def test_mixing_awkward_and_empty(spark, awkward, empty):
    assert mixing.plan(awkward).count() == awkward.count()
    assert mixing.plan(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    assert mixing.mixed_documents(awkward).columns == awkward.columns


def _check_packing(docs, rows, capacity, one_per_source=True):
    import re
    from collections import Counter, defaultdict

    bins, covered = defaultdict(list), Counter()
    for r in rows:
        bins[r.shard, r.bin].append(r)
        covered[r.doc_id] += r.n_words
    n = Counter()
    text, source = {}, {}
    for r in docs.collect():
        n[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        text[r.doc_id], source[r.doc_id] = r.text, r.source
    assert covered == +n
    for own in bins.values():
        assert sum(r.n_words for r in own) <= capacity
        texts = [text[r.doc_id] for r in own]
        assert len(set(texts)) == len(texts)
        if one_per_source:
            s = [source[r.doc_id] for r in own if source[r.doc_id] is not None]
            assert len(set(s)) == len(s)
    return len(bins)


def test_packing(spark, awkward, empty):
    docs = _docs(spark)
    _check_packing(docs, packing.best_fit(docs, capacity=100, shard_pieces=64).collect(), 100)
    free = packing.best_fit(docs, capacity=100, one_per_source=False, cluster=F.col("doc_id")).collect()
    assert len({(r.shard, r.bin) for r in free}) <= 1.05 * sum(r.n_words for r in free) / 100 + 1
    _check_packing(awkward, packing.best_fit(awkward, capacity=50).collect(), 50)
    assert packing.best_fit(empty).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_bins_equal_a_plain_best_fit(seed):
    import random

    rng = random.Random(seed)
    n = 300
    sizes = sorted((rng.randint(1, 60) for _ in range(n)), reverse=True)
    sources = [rng.choice([None, *range(70)]) if rng.random() < 0.6 else 0 for _ in range(n)]
    clusters = [rng.choice([None, *range(90)]) for _ in range(n)]
    bins = []  # residual, sources, clusters
    got = packing.pack(sizes, sources, clusters, 100)
    for size, s, c, b in zip(sizes, sources, clusters, got, strict=True):
        fits = [x for x in bins if x[0] >= size and (s is None or s not in x[1]) and (c is None or c not in x[2])]
        if fits:
            assert b < len(bins) and bins[b] in fits and bins[b][0] == min(x[0] for x in fits)
        else:
            assert b == len(bins)
            bins.append([100, set(), set()])
        bins[b][0] -= size
        bins[b][1].add(s)
        bins[b][2].add(c)
