"""PU learning: held-out accuracy, folds and awkward inputs."""

import random
import zlib

import numpy as np
import pytest

from structlens.llm import toxicity

VOCAB = [f"{a}{b}{c}" for a in ("ba", "ko", "ri", "ten", "mu") for b in ("la", "so", "ne", "dim") for c in ("", "ra", "ti", "gon")]
BAD = ["zark", "vool", "nixx"]


def _tables(spark, n=1500):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(VOCAB) for _ in range(rng.randint(20, 80))]
        toxic = int(rng.random() < 0.12)
        if toxic:
            for _ in range(rng.randint(2, 6)):
                w[rng.randrange(len(w))] = rng.choice(BAD)
        docs.append((i, " ".join(w)))
        if rng.random() < 0.5:
            labels.append((i, 1, toxic))
    truth = {i: int(any(b in t.split() for b in BAD)) for i, t in docs}
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), truth


def test_held_out_accuracy_and_determinism(spark):
    docs, labels, truth = _tables(spark)
    rows = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    again = toxicity.score(docs.repartition(5), toxicity.train(docs.repartition(7), labels.repartition(2))).collect()
    assert {r.doc_id: round(r.score, 6) for r in again} == {r.doc_id: round(r.score, 6) for r in rows}


def test_labels_of_the_held_out_fold_are_never_read(spark):
    docs, labels, _ = _tables(spark, 600)
    flipped = spark.createDataFrame([(r.doc_id, 1, 1 - r.toxic if zlib.crc32(str(r.doc_id).encode()) % 3 == 1 else r.toxic) for r in labels.collect()], labels.schema)
    one, two = toxicity.train(docs, labels), toxicity.train(docs, flipped)
    assert one.bias == two.bias and one.weights == two.weights


@pytest.mark.parametrize("below", [False, True])
def test_steps_follow_the_published_risk(below):
    rng = np.random.default_rng(2)
    zp, zu, prior = rng.normal(size=7) + (9 if below else 0), rng.normal(size=11) - (6 if below else 0), 0.3
    loss = lambda z, y: np.mean(np.logaddexp(0, -y * z))
    negative = lambda p, u: loss(u, -1) - prior * loss(p, -1)
    assert (negative(zp, zu) < 0) == below
    # the whole risk down, or the risk of the negatives up
    target = (lambda p, u: -negative(p, u)) if below else (lambda p, u: prior * loss(p, 1) + negative(p, u))
    rp, ru = toxicity.risk_step(zp, zu, prior)
    for z, r, at in ((zp, rp, 0), (zu, ru, 1)):
        for i in range(len(z)):
            step = np.zeros(len(z))
            step[i] = 1e-6
            ends = [target(*((z + s, zu) if at == 0 else (zp, z + s))) for s in (step, -step)]
            assert abs((ends[0] - ends[1]) / 2e-6 - r[i]) < 1e-6


def test_risk_is_lower_after_fitting():
    rng = np.random.default_rng(0)
    pos = toxicity.SparseRows([np.array([0, 2 + rng.integers(5)]) for _ in range(60)])
    unl = toxicity.SparseRows([np.array([0, 2 + rng.integers(5)]) if i < 20 else np.array([1, 2 + rng.integers(5)]) for i in range(200)])
    w, b = toxicity.fit(pos, unl, 7, 0.1)
    assert w[0] > 2 and w[1] < w[0] and b + w[1] < 0


def test_awkward_rows(spark, awkward, empty):
    labels = spark.createDataFrame([(5, 1, None), (14, 0, 1), (14, 0, 1), (None, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.train(awkward, labels)
    rows = toxicity.score(awkward, model).collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.held_out for r in rows if r.doc_id is None} == {False}
    assert len({r.score for r in rows if r.doc_id in (0, 1, 2)}) == 1
    assert toxicity.score(empty, model).count() == 0
    none = toxicity.train(empty, labels.limit(0))
    assert none.score("anything") < 1e-6
    kept = toxicity.non_toxic(awkward, labels.limit(0))
    assert kept.schema == awkward.schema and kept.count() == awkward.count()


def test_features_do_not_depend_on_the_number_of_tasks(spark):
    # a word that each task sees at most once
    rows = [(f"zark {VOCAB[i % len(VOCAB)]}", True) for i in range(12)] + [(f"{VOCAB[i % len(VOCAB)]} {VOCAB[-1 - i]}", False) for i in range(24)]
    sample = spark.createDataFrame(rows, "text string, positive boolean")
    one, many = (toxicity._pick_features(df, 12, 24, 2000, 5, 2.5) for df in (sample.coalesce(1), sample.repartition(36)))
    assert "=zark" in one and many == one
