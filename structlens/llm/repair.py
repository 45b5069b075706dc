"""Repairing the structure of conversations: the cheapest edits, by time-major dynamic programming over tensors.

A sound conversation has the roles ``(system? (user assistant)+)?``. A row is kept if its role fits (0), gets the role that fits (3) or is deleted (4); an
empty turn of the role that fits is put in anywhere (3). Blank rows and rows whose role and text were seen before are deleted; a
truncated row that stays costs 3 more. Costs are over four states (nothing yet, after system, after user, after assistant).

Conversations of about one length are one tensor with turns along its first axis: going backward, each turn updates the costs of all states of all
conversations at once, and every turn's costs are stored; going forward, each turn takes the least edit that is still cheapest in all
conversations at once. Edits are Delete, Insert, Keep, Rerole; of equally cheap ones the first by that order is taken at every place, which is
the ASCII-least of all cheapest sequences.

Rows are dealt by ranges of (conversation, turn, role, start of the text) and sorted, so a conversation of any length is in as many tasks as it needs. Whole
conversations inside a task are settled there. Others are cut into segments of bounded size: a segment's costs from each state to
each state are a matrix, matrices compose by (min, +), and composed from the end they give the costs behind each
segment; from then on its edits follow for every state that it may start in, and a last pass in order takes those of the state that it does.
What was seen in an earlier segment is found by an aggregation over digests (128 bits). Only a row a segment is gathered for one
conversation; its texts pass through its last task as a stream, since a digest has to see them in order, and its edits are held there since they are one string of the result.

Defined results: null roles and texts are one space, so such rows are blank or get a role; rows without a turn come first; rows of one turn are ordered by
role and text; other roles than system, user and assistant go by their first letter; null conversation ids are one conversation; repeated
rows are duplicates; a conversation without rows has zeros, no edits and the digest of nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _work

DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
SPACE = " \t\n\x0b\x0c\r"
SEGMENT_ROWS, SEGMENT_CHARS = 512, 1 << 20
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_PARTS = RESULT + ", seg long, roles array<string>, texts array<string>, faults binary, digests binary, first_turn long, last_turn long, turns long"

# states: nothing yet, after system, after user, after assistant; the role that fits next is user but for the third
_FIT = np.array([2, 2, 3, 2])
_ROLE = ("user", "user", "assistant", "user")
_NEVER = 1 << 40
_BLANK, _DUPLICATE, _CUT = 1, 2, 3
_PAD = 16
#: Costs of all states once the rows are over: 2 turns to put in, or 1.
_END = np.array([0, 2 * INSERT, INSERT, 0])


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code (4 * role class + fault; class 0 system, 1 user, 2 assistant, 3 other): costs of keeping and of a new role in each state, and the state after keeping."""
    keep, rerole, after = np.full((_PAD + 1, 4), _NEVER), np.full((_PAD + 1, 4), _NEVER), np.zeros(_PAD + 1, int)
    for role, (start, then) in enumerate((((0,), 1), ((0, 1, 3), 2), ((2,), 3), ((), 0))):
        for fault, more in ((0, 0), (_CUT, TRUNCATED)):
            keep[4 * role + fault, list(start)] = more
            rerole[4 * role + fault] = REROLE + more
        after[4 * role : 4 * role + 4] = then
    return keep, rerole, after


_KEEP, _REROLE, _AFTER = _tables()


def backward(codes: np.ndarray, end: np.ndarray) -> np.ndarray:
    """costs[t, n, s]: the least cost from state s before turn t on, for codes[t, n] and the costs end[n, s] after the last turn."""
    turns, n = codes.shape
    costs = np.empty((turns + 1, n, 4), np.int64)
    costs[turns] = end
    for t in range(turns - 1, -1, -1):
        code, rest = codes[t], costs[t + 1]
        c = np.minimum(rest + DELETE, _KEEP[code] + np.take_along_axis(rest, _AFTER[code][:, None], 1))
        np.minimum(c, _REROLE[code] + rest[:, _FIT], out=c)
        for _ in range(2):  # after system two turns may be missing
            c = np.minimum(c, INSERT + c[:, _FIT])
        costs[t] = np.where((code == _PAD)[:, None], rest, c)
    return costs


def trace(codes: np.ndarray, costs: np.ndarray, state: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edits (places along the first axis, 0 where there is none) from the states before the first turn, and the states behind the last one.

    Where ``last``, the turns that are missing at the end are put in.
    """
    turns, n = codes.shape
    lanes, out = np.arange(n), np.zeros((3 * turns + 2, n), np.uint8)
    for t in range(turns):
        code, own, rest = codes[t], costs[t], costs[t + 1]
        pad = code == _PAD
        for k in range(2):
            best = own[lanes, state]
            put = ~pad & (rest[lanes, state] + DELETE != best) & (own[lanes, _FIT[state]] + INSERT == best)
            out[3 * t + k, put] = ord("I")
            state = np.where(put, _FIT[state], state)
        best = own[lanes, state]
        gone = pad | (rest[lanes, state] + DELETE == best)
        kept = ~gone & (_KEEP[code, state] + rest[lanes, _AFTER[code]] == best)
        out[3 * t + 2] = np.where(pad, 0, np.where(gone, ord("D"), np.where(kept, ord("K"), ord("R"))))
        state = np.where(gone, state, np.where(kept, _AFTER[code], _FIT[state]))
    for k in range(2):
        put = last & ((state == 1) | (state == 2))
        out[3 * turns + k, put] = ord("I")
        state = np.where(put, _FIT[state], state)
    return out, state


def _lengths(n: int) -> int:
    """The bucket of a length: itself up to 8, beyond at most a quarter more."""
    step = 1 << max(0, n.bit_length() - 3)
    return -(-n // step) * step


def _buckets(codes: list[np.ndarray]):
    """(numbers of the sequences, time-major codes) of each bucket of lengths."""
    of: dict[int, list[int]] = {}
    for k, c in enumerate(codes):
        of.setdefault(_lengths(len(c)), []).append(k)
    for length, numbers in of.items():
        block = np.full((length, len(numbers)), _PAD, np.int64)
        for lane, k in enumerate(numbers):
            block[: len(codes[k]), lane] = codes[k]
        yield numbers, block


def _strings(audit: np.ndarray) -> list[str]:
    lanes = np.ascontiguousarray(audit.T)
    ends = np.cumsum((lanes != 0).sum(1))
    flat = lanes[lanes != 0].tobytes().decode("ascii")
    return [flat[a:b] for a, b in pairwise([0, *ends.tolist()])]


def settle(codes: list[np.ndarray]) -> list[tuple[int, str]]:
    """The cost and the edits of every whole conversation."""
    out: list = [None] * len(codes)
    for numbers, block in _buckets(codes):
        n = len(numbers)
        costs = backward(block, np.tile(_END, (n, 1)))
        audit, _ = trace(block, costs, np.zeros(n, int), np.ones(n, bool))
        for lane, text in enumerate(_strings(audit)):
            out[numbers[lane]] = (int(costs[0, lane, 0]), text)
    return out


def passages(codes: list[np.ndarray]) -> list[np.ndarray]:
    """The 4 x 4 costs from each state before a segment to each state behind it."""
    out: list = [None] * len(codes)
    for numbers, block in _buckets(codes):
        n = len(numbers)
        costs = backward(np.repeat(block, 4, 1), np.tile(np.where(np.eye(4, dtype=bool), 0, _NEVER), (n, 1)))
        for lane, k in enumerate(numbers):
            out[k] = costs[0, 4 * lane : 4 * lane + 4].T
    return out


def ways(codes: list[np.ndarray], behind: np.ndarray, last: np.ndarray) -> list[list[tuple[str, int]]]:
    """For each segment and each state before it: its edits, and the state behind it."""
    out: list = [None] * len(codes)
    for numbers, block in _buckets(codes):
        n = len(numbers)
        four = np.repeat(block, 4, 1)
        audit, state = trace(four, backward(four, np.repeat(behind[numbers], 4, 0)), np.tile(np.arange(4), n), np.repeat(last[numbers], 4))
        text = _strings(audit)
        for lane, k in enumerate(numbers):
            out[k] = [(text[4 * lane + s], int(state[4 * lane + s])) for s in range(4)]
    return out


@dataclass
class Segment:
    """Rows of one conversation in order."""

    conv_id: int | None
    roles: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    faults: bytearray = field(default_factory=bytearray)
    seen: set = field(default_factory=set)
    turns: int = 0
    first: int | None = None
    last: int | None = None
    chars: int = 0

    def add(self, turn: int | None, role: str, text: str) -> None:
        solid, key = text.rstrip(SPACE), (role, text)
        self.faults.append(_BLANK if not solid else _DUPLICATE if key in self.seen else 0 if solid[-1] in ".!?" else _CUT)
        self.seen.add(key)
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text)
        if turn is not None and turn != self.last:
            self.turns += 1
            self.first, self.last = turn if self.first is None else self.first, turn

    def row(self, number: int) -> tuple:
        """As a row of the segments; a digest a row tells what later segments have seen."""
        digests = b"".join(hashlib.blake2b(f"{len(r)}:{r}{t}".encode("utf-8", "surrogatepass"), digest_size=16).digest() for r, t in zip(self.roles, self.texts, strict=True))
        return (self.conv_id, *[None] * 8, number, self.roles, self.texts, bytes(self.faults), digests, self.first, self.last, self.turns)


def _codes(roles: list[str], faults: bytes) -> np.ndarray:
    kind = np.fromiter(("sua".find(r[:1]) if r else 3 for r in roles), np.int64, len(roles))
    return 4 * np.where(kind < 0, 3, kind) + np.frombuffer(faults, np.uint8)


def _illegal(roles: list[str], before: str | None = None) -> int:
    return sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in pairwise(roles if before is None else [before, *roles]))


class Repaired:
    """The digest of the repaired turns, fed by edits."""

    def __init__(self):
        self.sha, self.state, self.any = hashlib.sha256(), 0, False

    def feed(self, audit: str, roles: list[str], texts: list[str]) -> None:
        lines, at, state = [], 0, self.state
        for edit in audit:
            if edit == "I":
                lines.append(_ROLE[state] + ":")
                state = int(_FIT[state])
                continue
            if edit == "K":
                lines.append(f"{roles[at]}:{texts[at]}")
                state = "sua".index(roles[at][0]) + 1
            elif edit == "R":
                lines.append(f"{_ROLE[state]}:{texts[at]}")
                state = int(_FIT[state])
            at += 1
        if lines:
            self.sha.update(("\n" * self.any + "\n".join(lines)).encode("utf-8", "surrogatepass"))
            self.any = True
        self.state = state


def _gaps(first: int | None, last: int | None, turns: int) -> int:
    return min(last - first + 1 - turns, 2**63 - 1) if turns else 0


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def _settled(whole: list[Segment]) -> list[tuple]:
    rows = []
    for seg, (cost, audit) in zip(whole, settle([_codes(s.roles, bytes(s.faults)) for s in whole]), strict=True):
        repaired = Repaired()
        repaired.feed(audit, seg.roles, seg.texts)
        counts = [seg.faults.count(f) for f in (_BLANK, _DUPLICATE, _CUT)]
        rows.append((seg.conv_id, _gaps(seg.first, seg.last, seg.turns), *counts, _illegal(seg.roles), cost, audit, repaired.sha.hexdigest(), *[None] * 8))
    return rows


def _cut(segment_rows: int, segment_chars: int):
    """Rows in order: a result for each whole conversation inside the task, segments of the others."""

    def work(batches):
        schema, number = _arrow(_PARTS), TaskContext.get().partitionId() << 32
        whole, size, rows, chars, own, torn = [], 0, [], 0, None, True  # the first conversation of a task may have begun before it
        for batch in batches:
            for conv, turn, role, text, gone in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                new = own is None or conv != own.conv_id
                if new or len(own.roles) >= segment_rows or own.chars >= segment_chars:
                    if own is not None:
                        if new and not torn:
                            whole.append(own)
                            size += len(own.roles) + own.chars // 256
                        else:
                            rows.append(own.row(number))
                            chars += own.chars
                            number += 1
                        torn = not new
                    own = Segment(conv)
                if not gone:
                    own.add(turn, role, text)
            if size >= 1 << 15:
                yield _batch(_settled(whole), schema)
                whole, size = [], 0
            if chars >= 1 << 23 or len(rows) >= 64:
                yield _batch(rows, schema)
                rows, chars = [], 0
        if own is not None:
            rows.append(own.row(number))
        yield from (_batch(x, schema) for x in (_settled(whole), rows) if x)

    return work


def _digests(batches):
    """(key, seg, at, digest) of the rows that a later segment may repeat, or that may repeat an earlier one."""
    schema = pa.schema([("key", pa.string()), ("seg", pa.int64()), ("at", pa.int32()), ("digest", pa.binary())])
    for batch in batches:
        rows = []
        for key, seg, faults, digests in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            rows += [(key, seg, at, digests[16 * at : 16 * at + 16]) for at, f in enumerate(faults) if f in (0, _CUT)]
        if rows:
            yield _batch(rows, schema)


def _with_repeats(faults: bytes, repeats: list[int] | None) -> bytes:
    out = bytearray(faults)
    for at in repeats or ():
        out[at] = _DUPLICATE
    return bytes(out)


def _matrices(batches):
    schema = _arrow("key string, seg long, costs array<long>")
    for batch in batches:
        keys, segs, roles, faults, repeats = (x.to_pylist() for x in batch.columns)
        if keys:
            found = passages([_codes(r, _with_repeats(f, again)) for r, f, again in zip(roles, faults, repeats, strict=True)])
            yield _batch([(k, s, m.ravel().tolist()) for k, s, m in zip(keys, segs, found, strict=True)], schema)


def _behind(frame: pd.DataFrame) -> pd.DataFrame:
    """The costs behind each segment of one conversation, by (min, +) from its end."""
    frame = frame.sort_values("seg", ascending=False)
    rest, out = _END, []
    for costs in frame["costs"]:
        out.append(rest.tolist())
        rest = (np.asarray(costs).reshape(4, 4) + rest).min(1)
    return pd.DataFrame({"s": frame["seg"].to_numpy(), "behind": out, "ends": np.arange(len(frame)) == 0, "cost": [int(rest[0])] * len(frame)})


def _joined(batches):
    """Segments in order, with the costs behind each: a result a conversation."""
    schema, key, rows = _arrow(RESULT), None, []
    for batch in batches:
        columns = [x.to_pylist() for x in batch.columns]
        keys, _, convs, roles, texts, faults, repeats, firsts, lasts, turns, behind, ends, costs = columns
        if not keys:
            continue
        faults = [_with_repeats(f, again) for f, again in zip(faults, repeats, strict=True)]
        paths = ways([_codes(r, f) for r, f in zip(roles, faults, strict=True)], np.array(behind), np.array(ends))
        for k in range(len(keys)):
            if keys[k] != key:
                key, repaired, audit, counts, illegal, before, first, last, distinct = keys[k], Repaired(), [], [0, 0, 0], 0, None, None, None, 0
            edits, state = paths[k][repaired.state]
            repaired.feed(edits, roles[k], texts[k])
            assert repaired.state == state
            audit.append(edits)
            counts = [c + faults[k].count(f) for c, f in zip(counts, (_BLANK, _DUPLICATE, _CUT), strict=True)]
            illegal += _illegal(roles[k], before)
            before = roles[k][-1] if roles[k] else before
            if turns[k]:
                distinct += turns[k] - (firsts[k] == last)
                first, last = firsts[k] if first is None else first, lasts[k]
            if ends[k]:
                rows.append((convs[k], _gaps(first, last, distinct), *counts, illegal, costs[k], "".join(audit), repaired.sha.hexdigest()))
        if len(rows) >= 512:
            yield _batch(rows, schema)
            rows = []
    if rows:
        yield _batch(rows, schema)


def cut(talk: DataFrame, *, gone_col: str | None = None, segment_rows: int = SEGMENT_ROWS, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """The results of conversations that are whole in one task (seg null), and the segments of the others (seg: task and number)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    rows = talk.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), text.alias("text"),
        (F.coalesce(F.col(gone_col), F.lit(False)) if gone_col else F.lit(False)).alias("gone"), F.substring(text, 1, 32).alias("start"),
    )
    order = ["conv_id", "turn", "role", "start"]  # no whole text among the range keys
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").select("conv_id", "turn", "role", "text", "gone")
    return _work.keep(dealt.mapInArrow(_cut(segment_rows, segment_chars), _PARTS), "conversations")


def repair(talk: DataFrame, *, gone_col: str | None = None, segment_rows: int = SEGMENT_ROWS, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """A row a conversation of (conv_id, turn, role, text): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows marked in ``gone_col`` are no rows, but their conversations have a result.
    """
    spark = talk.sparkSession
    parts = cut(talk, gone_col=gone_col, segment_rows=segment_rows, segment_chars=segment_chars)
    done = parts.where("seg IS NULL").select(*[c.split()[0] for c in RESULT.split(", ")])
    segments = parts.where("seg IS NOT NULL").withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit("none")))

    with _work.batches_of(spark, 32):  # segments are large rows
        marks = segments.select("key", "seg", "faults", "digests").mapInArrow(_digests, "key string, seg long, at int, digest binary")
        first = marks.groupBy("key", "digest").agg(F.min("seg").alias("least")).select(F.col("key").alias("k"), F.col("digest").alias("d"), "least")
        again = marks.join(first, (marks["key"] == first["k"]) & (marks["digest"] == first["d"]) & (F.col("seg") > F.col("least"))).groupBy(F.col("seg").alias("r_seg")).agg(F.collect_list("at").alias("repeats"))
        marked = segments.join(_work.keep(again, "repeats"), F.col("seg") == F.col("r_seg"), "left").drop("r_seg")
        costs = _work.keep(marked.select("key", "seg", "roles", "faults", "repeats").mapInArrow(_matrices, "key string, seg long, costs array<long>"), "passages")
        behind = costs.groupBy("key").applyInPandas(_behind, "s long, behind array<long>, ends boolean, cost long")
        ordered = marked.drop("cost").join(behind, F.col("seg") == F.col("s")).select("key", "seg", "conv_id", "roles", "texts", "faults", "repeats", "first_turn", "last_turn", "turns", "behind", "ends", "cost")
        rest = _work.keep(ordered.repartition("key").sortWithinPartitions("key", "seg").mapInArrow(_joined, RESULT), "repaired")
    return done.unionByName(rest)


def damage(talk: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: rows by crc32 of ``conv_id:turn`` modulo 20 dropped (0: marked gone), emptied (1), without ``.!?`` (2), repeated (3) or by a user (4); nulls are one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = F.pmod(F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")), F.lit(20))
    text = F.when(F.col("way") == 1, "").when(F.col("way") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return (
        talk.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), way.alias("way"))
        .select("conv_id", "turn", F.when(F.col("way") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("way") == 0).alias("gone"), F.explode(F.sequence(F.lit(1), F.when(F.col("way") == 3, 2).otherwise(1))).alias("copy"))
        .drop("copy")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired."""
    return repair(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")), gone_col="gone")
