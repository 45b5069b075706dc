"""Conversation repair against a plain search for the cheapest, ASCII-least edits."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from structlens.llm import repair

TALK = "conv_id long, turn long, role string, text string, key string, seg int, cost string"


def _cheapest(rows):
    """(cost, edits, lines) of the best way to repair rows of (role, text, fault); memoised search over whole strings."""

    @cache
    def best(at, state):  # state: b(egin), s, u, a; no more than two turns put in anywhere
        return min(_ways(at, state, 2))

    def _ways(at, state, inserts):
        fit = "a" if state == "u" else "u"
        full = {"u": "user", "a": "assistant"}
        if at == len(rows) and state in "ba":
            yield 0, "", ()
        if at < len(rows):
            role, text, fault = rows[at]
            more = lambda here, edit, line, rest: (here + rest[0], edit + rest[1], ((line,) if line is not None else ()) + rest[2])
            yield more(4, "D", None, best(at + 1, state))
            if fault not in ("blank", "duplicate"):
                cut = 3 * (fault == "truncated")
                if role[:1] == fit or role[:1] == "s" and state == "b":
                    yield more(cut, "K", f"{role}:{text}", best(at + 1, role[:1]))
                yield more(3 + cut, "R", f"{full[fit]}:{text}", best(at + 1, fit))
        if inserts:
            for c, e, lines in _ways(at, fit, inserts - 1):
                yield c + 3, "I" + e, (f"{full[fit]}:", *lines)

    for at in range(len(rows), -1, -1):
        for state in "bsua":
            best(at, state)
    return best(0, "b")


def _damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        way = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        out += [] if way == 0 else [(conv, turn, "user" if way == 4 else role, text)] * (2 if way == 3 else 1)
    return out


def _want(rows, convs):
    out = []
    for conv in convs:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, marked = set(), []
        for _, _, role, text in own:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated"
            seen.add((role, text))
            marked.append((role, text, fault))
        cost, audit, lines = _cheapest(marked)
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        count = [sum(m[2] == f for m in marked) for f in ("blank", "duplicate", "truncated")]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        out.append((conv, gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def _random_rows(rng, convs, longest):
    rows = []
    for conv in range(convs):
        for turn in range(rng.randint(0, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "ursula", "a", None, "User"])
            text = rng.choice(["", " \t\n", "a.", "b!", "c? \n", "no end", "é", f"t{turn}.", f"t{turn}", None, "\xa0", ". ."])
            rows.append((conv, rng.choice([turn, turn, turn, turn // 2, None, 3 * turn]), role, text))
    return rows


def _rows(got):
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize(("seed", "convs", "longest", "segment", "tasks"), [(1, 150, 8, 512, 3), (2, 60, 14, 512, 1), (3, 40, 12, 1, 7), (4, 3, 60, 4, 4)])
def test_random_conversations(spark, seed, convs, longest, segment, tasks):
    rng = random.Random(seed)
    rows = _random_rows(rng, convs, longest)
    frame = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], TALK)
    want = _want([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows], {r[0] for r in rows})
    spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
    try:
        assert _rows(repair.repair(frame, segment_rows=segment)) == want
        assert _rows(repair.repair(repair.damage(frame), gone_col="gone", segment_rows=segment)) == _want(_damaged(rows), {r[0] for r in rows})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_all_the_table(spark):
    talk = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert _rows(repair.query(spark, "/root/testdata/sf0.001")) == _want(_damaged(talk), {r[0] for r in talk})


def test_awkward_conversations(spark):
    make = lambda rows, **o: _rows(repair.repair(spark.createDataFrame([(*r, None, None, None) for r in rows], TALK), **o))
    assert make([]) == []
    nothing = hashlib.sha256(b"").hexdigest()
    rows = [(None, None, None, None), (None, 5, "user", "x."), (1, 2, "user", " "), (2, None, "user", "y." * 10**6), (2, None, "assistant", "z")]
    filled = [(c, t, r or " ", x or " ") for c, t, r, x in rows]
    assert make(rows) == _want(filled, {None, 1, 2})
    gone = spark.createDataFrame([(7, 1, "user", "x", True), (7, 2, "user", "x", True)], "conv_id long, turn long, role string, text string, gone boolean")
    assert _rows(repair.repair(gone, gone_col="gone")) == [(7, 0, 0, 0, 0, 0, 0, "", nothing)]


def test_one_conversation_over_all_tasks(spark):
    """A hot conversation: no task sees more than its range until the texts pass through the digest."""
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant", "tool"]), rng.choice(["same.", f"{t}.", f"cut {t}"])) for t in range(700)] + [(2, 0, "user", "q."), (2, 1, "assistant", "a.")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = _rows(repair.repair(frame, segment_rows=64))
    whole = _rows(repair.repair(frame.coalesce(1), segment_rows=10**6, segment_chars=10**9))
    assert got == whole == _want(rows, {1, 2})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        held = repair.cut(frame, segment_rows=64).where("seg IS NOT NULL").groupBy(F.shiftright("seg", 32)).agg(F.sum(F.size("roles")).alias("rows")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(held) == 4 and max(r["rows"] for r in held) < 300
