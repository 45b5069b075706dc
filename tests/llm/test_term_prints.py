"""Weighted fingerprints, edited texts and radius search against plain restatements."""

import hashlib
import math
import random

import numpy as np
import pytest
from awkward_data import awkward_rows

from structlens.llm import term_prints


def _print(text):
    text, count = chr(1) * 7 + text.lower(), {}
    for i in range(len(text) - 7):
        count[text[i : i + 8]] = count.get(text[i : i + 8], 0) + 1
    votes = [0] * 64
    for term, n in count.items():
        h = 0
        for c in term:
            h = (h * 0x9E3779B97F4A7C15 + (0x110000 if c == chr(1) else ord(c))) % (1 << 64)
        h = ((h ^ h >> 30) * 0xBF58476D1CE4E5B9) % (1 << 64)
        h = ((h ^ h >> 27) * 0x94D049BB133111EB) % (1 << 64)
        h ^= h >> 31
        for b in range(64):
            votes[b] += (1 if h >> b & 1 else -1) * math.floor(16 * (1 + math.log2(n)))
    return sum(1 << b for b in range(64) if votes[b] > 0)


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def _edits(texts):
    out = []
    for i, t in enumerate(texts):
        k, following = len(t) // 4, texts[(i + 1) % len(texts)]
        out.append(t[: len(t) - k] + following[:k])
    return out


def _want(ids, texts):
    new = _edits(texts)
    return [(i, len(t), hashlib.sha256(e.encode()).hexdigest(), _signed(_print(t)), _signed(_print(e)), _signed(_print(texts[(k + 1) % len(texts)]))) for k, (i, t, e) in enumerate(zip(ids, texts, new))]


@pytest.mark.parametrize("text", ["", "a", "Aa", "é ß 漢字 😀", "aaaaaaaaaaaaaaaaaaaaaaaaa", "the same words, the same words, and others " * 30])
def test_fingerprint(text):
    assert term_prints.fingerprint(text) == _print(text)


def test_slices_change_nothing(monkeypatch):
    text = "".join(random.Random(3).choices("abc d", k=5000))
    want = term_prints.fingerprint(text)
    monkeypatch.setattr(term_prints, "_SLICE", 700)
    assert term_prints.fingerprint(text) == want == _print(text)


def test_every_number_of_tasks(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices("ab cdé\n😀", k=rng.choice([0, 1, 3, 4, 50, 300]))) for _ in range(60)]
    want = sorted(_want(range(60), texts))
    rows = [(i, t or None) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    for n in (1, 3, 60):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        try:
            got = term_prints.with_edits(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert sorted(map(tuple, got)) == want


def test_awkward_rows(spark, awkward, empty):
    assert term_prints.with_edits(empty).count() == 0
    got = term_prints.with_edits(awkward).collect()
    rows = awkward_rows()
    assert len(got) == len(rows) and sorted(r.n_chars for r in got) == sorted(len(r[1] or "") for r in rows)
    of = {r.doc_id: r for r in got}
    texts = {r[0]: r[1] or "" for r in rows}
    assert all(r.fp == _signed(_print(texts[r.doc_id])) for r in got if r.n_chars < 2000)
    # neighbours with ids of their own are in order; the row without an id comes first and follows the last one
    assert of[0].edited_sha256 == hashlib.sha256(b"").hexdigest() and of[2].next_fp == of[3].fp and of[14].next_fp == of[None].fp and of[None].next_fp == of[0].fp
    assert [r.next_fp == r.fp for r in got if r.doc_id == 5] == [True] * 3  # repeated rows, and row 6 has the same text
    one = term_prints.with_edits(spark.createDataFrame([(7, "abcdefgh")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one.next_fp == one.fp


def _bits(rng, fp, n):
    for b in rng.choice(64, n, replace=False):
        fp ^= 1 << int(b)
    return fp


@pytest.mark.parametrize(("radius", "chunk"), [(3, 4096), (3, 7), (0, 4096), (6, 50)])
def test_all_within_the_radius(spark, radius, chunk):
    rng = np.random.default_rng(radius + chunk)
    base = [int(x) for x in rng.integers(0, 2**64, 40, dtype=np.uint64)] + [0, 2**64 - 1]
    prints = [_bits(rng, b, n) for b in base for n in (0, 0, *rng.integers(0, 9, 12))]
    # one hot group: many fingerprints that share nearly all bits
    prints += [_bits(rng, base[0], int(n)) for n in rng.integers(0, 5, 300)]
    asked = prints[::20] + [12345]
    frame = lambda x: spark.createDataFrame([(_signed(f),) for f in x], "fp long")
    got = {r.asked % (1 << 64): r.hits for r in term_prints.within(frame(prints), frame(asked), radius=radius, chunk_rows=chunk).collect()}
    assert got == {q: n for q in set(asked) if (n := sum((q ^ p).bit_count() <= radius for p in prints))}
    assert term_prints.within(frame([]), frame([]), radius=radius).count() == 0


def test_edits_are_nearer_than_strangers(spark):
    got = term_prints.query(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    want = _want([r.doc_id for r in docs], [r.text or "" for r in docs])
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256, int(r.fingerprint, 16), int(r.edited_fingerprint, 16)) for r in got) == [(i, n, s, f % (1 << 64), e % (1 << 64)) for i, n, s, f, e, _ in want]
    assert all(abs(r.near_edited - (1 - bin(int(r.fingerprint, 16) ^ int(r.edited_fingerprint, 16)).count("1") / 64)) < 1e-12 for r in got)
    assert sum(r.near_edited > r.near_next for r in got) >= 0.99 * len(got)
    fps = [int(r.fingerprint, 16) for r in got]
    assert all(r.n_within == (sum((int(r.fingerprint, 16) ^ f).bit_count() <= 3 for f in fps) - 1 if r.doc_id % 20 == 0 else None) for r in got)
