"""Substring dedup against a direct restatement."""

import hashlib
import random
import re

from awkward_data import awkward_rows

from structlens.llm import substring

SCHEMA = "doc_id long, text string, n_chars long, note string"


def _expected(rows, window=50):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, w in words:
        gone = set()
        if i is not None:
            for k in range(len(w) - window + 1):
                if first[tuple(w[k : k + window])] < i:
                    gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((-1 if i is None else i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def _got(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def test_awkward_rows(spark, awkward, empty):
    assert _got(substring.digests(awkward)) == _expected([r[:2] for r in awkward_rows()])
    assert substring.digests(empty).count() == 0


def test_random_splices(spark):
    rng = random.Random(4)
    vocab = [f"v{i}" for i in range(500)] + ["é", "漢", "😀", "x.y"]
    sources = [[rng.choice(vocab) for _ in range(rng.randint(60, 300))] for _ in range(6)]
    rows = []
    for i in range(120):
        w = []
        for _ in range(rng.randint(0, 4)):
            s = rng.choice(sources)
            a = rng.randrange(len(s))
            w += s[a : a + rng.randint(1, 120)] + [rng.choice(vocab) for _ in range(rng.randint(0, 30))]
        if i % 9 == 0:
            w = ["same"] * rng.randint(0, 130)
        rows.append((i * 7 % 121, rng.choice([" ", "\n", "  ", "\t"]).join(w), 0, "n"))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert _got(substring.digests(df)) == _expected([r[:2] for r in rows])
    # small shards compile many automata and find the same
    assert _got(substring.digests(df, shard_chars=2000)) == _expected([r[:2] for r in rows])


def test_deduplicated_keeps_untouched_rows(spark):
    p = " ".join(f"w{i}" for i in range(55))
    rows = [(1, f"a  b\n{p}", 9, "x"), (2, f"{p} tail", 9, "y"), (3, p, 9, None), (4, "  free\ttext ", 9, "z"), (5, None, None, "k")]
    got = {r.doc_id: (r.text, r.n_chars, r.note) for r in substring.deduplicated(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (rows[0][1], 9, "x"), 2: ("tail", 4, "y"), 3: ("", 0, None), 4: ("  free\ttext ", 9, "z"), 5: (None, None, "k")}


def test_nothing_is_removed_where_the_automata_find_nothing(spark, monkeypatch):
    p = " ".join(f"w{i}" for i in range(70))
    rows = [(i, f"head{i} {p} tail{i}", 9, "x") for i in range(4)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": [i for i, *_ in rows], "k": [0] * 4, "text": [t for _, t, *_ in rows], "recurring": [substring.anchors(substring.word_hashes(substring.normal(t)))[1].view("int64").tolist() for _, t, *_ in rows]})
    work = substring._locate(50, 20, 1 << 20)
    found = [len(x) for b in work(iter([batch])) for x in b.column(3).to_pylist()]
    assert len(found) == 4 and min(found) >= 21
    monkeypatch.setattr(substring, "_occurrences", lambda *_: [])
    assert list(work(iter([batch]))) == []


def test_a_phrase_is_read_from_one_document_and_located_in_all(spark):
    p = " ".join(f"w{i}" for i in range(70))
    texts = [f"{p} a", f"b {p}", f"c d {p} e"]
    known = substring.anchors(substring.word_hashes(substring.normal(p)))[1].view("int64").tolist()
    import pyarrow as pa

    # only the first document brings its phrases along
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "k": [0] * 3, "text": texts, "recurring": pa.array([known, None, None], pa.list_(pa.int64()))})
    out = [r for b in substring._locate(50, 20, 1 << 20)(iter([batch])) for r in b.to_pylist()]
    assert {r["doc_id"]: set(range(k, k + 21)) <= set(r["pos"]) for k, r in zip((0, 1, 2), out, strict=True)} == {1: True, 2: True, 3: True}


def test_very_frequent_copies_take_the_broadcast(spark):
    rows = [(i, "same text here", 9, "x") for i in range(30)] + [(100 + i, f"other {i // 2}", 9, "x") for i in range(3000)] + [(None, "same text here", 9, "x")]
    seen = spark.createDataFrame(rows, SCHEMA)
    assert _got(substring.digests(seen)) == _expected([r[:2] for r in rows])
    found, _ = substring.repeated_passages(seen)
    assert {r.rep for r in found.where("doc_id < 100").collect()} == {0}
