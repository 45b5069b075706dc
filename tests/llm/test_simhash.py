"""SimHash components against brute force over all pairs."""

import re

import numpy as np
import xxhash
from awkward_data import awkward_rows

from structlens.llm import _components, simhash


def _print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    s = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _roots(fps, distance=4):
    n, label = len(fps), list(range(len(fps)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(n):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return [find(i) for i in range(n)]


def test_awkward_rows(spark, awkward, empty):
    rows = sorted(((-1 if r[0] is None else r[0], r[1]) for r in awkward_rows()), key=lambda r: r[0])
    fps = [_print(t) for _, t in rows]
    roots = _roots(fps)
    members = {}
    for r, (i, _) in zip(roots, rows, strict=True):
        members.setdefault(r, []).append(i)
    low = {r: min((i for i in m if i >= 0), default=None) for r, m in members.items()}
    want = sorted((i, f, low[r]) for (i, _), f, r in zip(rows, fps, roots, strict=True) if i >= 0)
    got = [(r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(awkward).collect() if r.doc_id is not None]
    assert sorted(got) == want
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.representatives(awkward)
    assert kept.columns == awkward.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, _, c in want} | {None}


def test_links_at_any_number_of_blocks_and_chunks(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base[:20]:
        for _ in range(12):
            f = int(b)
            for bit in rng.choice(64, rng.integers(1, 6), replace=False):
                f ^= 1 << int(bit)
            fps.add(f)
    fps = sorted(f - (1 << 64) if f >= 1 << 63 else f for f in fps)
    roots = _roots([f % (1 << 64) for f in fps])
    want = {}
    for f, r in zip(fps, roots, strict=True):
        want.setdefault(r, set()).add(f)
    want = sorted(map(sorted, (m for m in want.values() if len(m) > 1)))
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    for n, chunk in ((1, 2048), (10**7, 2048), (10**10, 2048), (1, 5)):
        found = {}
        for r in _components.components(simhash.links(frame, n, chunk_rows=chunk)).collect():
            found.setdefault(r.root, {r.root}).add(r.a)
        assert sorted(map(sorted, found.values())) == want


def test_large_groups_in_chunks(spark):
    """One hot key: near copies by the thousand, in several chunks and long runs."""
    fps = sorted({1 << i | 1 << j for i in range(64) for j in range(64)})
    fps = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    found = _components.components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), 1, chunk_rows=700)).collect()
    assert {r.a for r in found} | {r.root for r in found} == set(fps) and len({r.root for r in found}) == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7), (100, 95)] + [(1000 + i, 1000) for i in range(50)]
    got = {r.a: r.root for r in _components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 95: 90, 100: 90, **{1000 + i: 1000 for i in range(1, 50)}}
    assert _components.components(spark.createDataFrame([], "a long, b long")).count() == 0
