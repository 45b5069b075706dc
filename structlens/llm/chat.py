"""Chat formatting from event logs.

A log is dealt by conversation and sorted by sequence; one streaming pass folds it into final messages and
renders them. Events:

* ``message``  a new turn with role and text;
* ``start``    opens a new turn with a role, ``delta`` appends text to the last turn;
* ``edit``     replaces the text of turn ``target`` and drops all turns after it (null target: the last turn);
* ``regenerate`` drops turn ``target`` and all after it (null target: the last turn).

The template of a turn is ``<|im_start|>role LF text <|im_end|> LF``. Texts are escaped reversibly: between "<" and "|",
with any number of backslashes between them, one more backslash is put, so no text holds a control string; in a
role, backslashes and line feeds are escaped first. Assistant texts are under the loss mask, given as
code point spans of the formatted text.

A log is dealt by ranges of (conversation, sequence), so a conversation of any length is folded by as many tasks as it
needs. Conversations that lie inside one task are folded and rendered there. Those at its borders are cut into segments of bounded size, and a
segment is a function of what came before it. How many turns there are behind a segment is ``min(max(n + add, low), high)`` of the n before it, and
such functions compose, so a row a segment settles all counts. With its count known, a segment says how many of the turns
before it stay, what it does to the last of them (more text, or another), and which turns it adds; turns that a later segment drops go, and the
others are put together by turn. No task ever holds all turns of such a conversation.

A conversation is written as rows of at most about ``chunk_chars`` characters, cut between turns. Reading back streams a
conversation's chunks in order, since a digest has to see them so.

Defined results: a null text is empty, a null role is an empty role; events without a known type are messages; events
with the same sequence are ordered by type, role, text and target (they are never dealt to different tasks); an edit or regeneration of a turn that isn't there
changes nothing, and a delta without a turn opens one without a role; null conversation ids are one conversation;
repeated rows are repeated turns; a conversation without turns in the end has no rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _work

START, END = "<|im_start|>", "<|im_end|>"
_OPEN, _SHUT = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)
SCHEMA = "conv_id long, chunk long, formatted string, mask_starts array<int>, mask_ends array<int>"


def escape(text: str) -> str:
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _SHUT.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


_MANY = 1 << 40


@dataclass
class Count:
    """How many turns there are after the events so far, as min(max(n + add, low), high) of the n turns before them."""

    add: int = 0
    low: int = 0
    high: int = _MANY

    def then(self, add: int, low: int, high: int) -> None:
        self.add, self.low, self.high = self.add + add, min(max(self.low + add, low), high), min(max(self.high + add, low), high)

    def apply(self, kind: str | None, target: int | None) -> None:
        if kind == "delta":
            self.then(0, 1, _MANY)
        elif kind in ("edit", "regenerate"):
            if target is None:
                self.then(-1 if kind == "regenerate" else 0, 0, _MANY)
            elif target >= 0:
                self.then(0, 0, target + (kind == "edit"))
        else:
            self.then(1, 0, _MANY)

    def of(self, n: int) -> int:
        return min(max(n + self.add, self.low), self.high)


class Fold:
    """What events make of ``before`` turns: the first ``kept`` of them stay, the last of these gets ``patch`` (in place of its text?, texts), and ``turns`` follow."""

    def __init__(self, before: int = 0):
        self.kept, self.patch, self.turns = before, None, []

    def apply(self, kind: str | None, target: int | None, role: str | None, text: str | None) -> None:
        turns, kept = self.turns, self.kept
        count = kept + len(turns)
        at = count - 1 if target is None else target
        if kind == "delta":
            if turns or not kept:
                if not turns:
                    turns.append(["", []])
                turns[-1][1].append(text or "")
            else:
                self.patch = self.patch or (False, [])
                self.patch[1].append(text or "")
        elif kind in ("edit", "regenerate"):
            if not 0 <= at < count:
                return
            edit = kind == "edit"
            if at >= kept:
                if edit:
                    turns[at - kept][1] = [text or ""]
                del turns[at - kept + edit :]
            else:
                turns.clear()
                self.kept, self.patch = at + edit, (True, [text or ""]) if edit else None
        else:
            turns.append([role or "", [text or ""]])


class Renderer:
    """Chunks of formatted text with their loss spans."""

    def __init__(self, chunk_chars: int, first: int):
        self.limit, self.chunk, self.rows = chunk_chars, first, []
        self._clear()

    def _clear(self) -> None:
        self.parts, self.chars, self.starts, self.ends = [], 0, [], []

    def add(self, role: str, text: str) -> None:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if role == "assistant":
            self.starts.append(self.chars + len(head))
            self.ends.append(self.chars + len(head) + len(body))
        self.parts += [head, body, END, "\n"]
        self.chars += len(head) + len(body) + len(END) + 1
        if self.chars >= self.limit:
            self.cut()

    def cut(self) -> None:
        if self.parts:
            self.rows.append((self.chunk, "".join(self.parts), self.starts, self.ends))
            self.chunk += 1
            self._clear()


_SEGMENT = "seg long, kinds array<string>, targets array<int>, roles array<string>, texts array<string>, add long, low long, high long"
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    fields = [c.split() for c in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, _ARROW[f[1]]) for x, f in zip(zip(*rows, strict=True), fields, strict=True)], names=[f[0] for f in fields])


def _folded(chunk_chars: int, segment_events: int, segment_chars: int):
    """Sorted events: chunks of the conversations inside the task (seg null), segments of those at its borders."""

    def work(batches):
        first = TaskContext.get().partitionId() << 32
        held, size, conv, events, chars, segments, border, none = [], 0, object(), [], 0, 0, True, True

        def segment() -> tuple:
            nonlocal segments
            count = Count()
            for kind, target, _, _ in events:
                count.apply(kind, target)
            segments += 1
            return (conv, *[None] * 4, first + segments, *map(list, zip(*events, strict=True)), count.add, count.low, count.high)

        def whole() -> list[tuple]:
            fold, out = Fold(), Renderer(chunk_chars, 0)
            for event in events:
                fold.apply(*event)
            for role, parts in fold.turns:
                out.add(role, "".join(parts))
            out.cut()
            return [(conv, *r, *[None] * 8) for r in out.rows]

        for batch in batches:
            columns = [batch.column(name).to_pylist() for name in ("conv_id", "kind", "target", "role", "text")]
            for c, *event in zip(*columns, strict=True):
                new = none or c != conv
                if new or len(events) >= segment_events or chars >= segment_chars:
                    if events:
                        border = border or not new  # cut here, or begun before this task
                        held += [segment()] if border else whole()
                        size += chars + 64
                    border = border and not new if not none else True
                    conv, events, chars, none = c, [], 0, False
                events.append(event)
                chars += len(event[3] or "")
                if len(held) >= 512 or size >= 1 << 23:
                    yield _batch(held, f"{SCHEMA}, {_SEGMENT}")
                    held, size = [], 0
        if events:
            held.append(segment())  # it may go on behind this task
        if held:
            yield _batch(held, f"{SCHEMA}, {_SEGMENT}")

    return work


def _counted(frame: pd.DataFrame) -> pd.DataFrame:
    """The turns before each segment of one conversation."""
    frame, n, before = frame.sort_values("seg"), 0, []
    for add, low, high in zip(frame["add"], frame["low"], frame["high"], strict=True):
        before.append(n)
        n = Count(add, low, high).of(n)
    return pd.DataFrame({"s": frame["seg"].to_numpy(), "before": before})


_DONE = "conv_id long, seg long, kept int, replaced boolean, patch string, roles array<string>, texts array<string>"


def _segments(batches):
    """Segments with the turns before them, folded."""
    for batch in batches:
        rows = []
        for conv, seg, before, *events in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            fold = Fold(before)
            for event in zip(*events, strict=True):
                fold.apply(*event)
            patch = fold.patch
            rows.append((conv, seg, fold.kept, patch and patch[0], "".join(patch[1]) if patch else None, [r for r, _ in fold.turns], ["".join(t) for _, t in fold.turns]))
        if rows:
            yield _batch(rows, _DONE)


def _rendered(chunk_chars: int):
    """Sorted turns (conv_id, idx, role, text) as chunks, numbered by their first turn."""

    def work(batches):
        conv, out = object(), None
        for batch in batches:
            rows = []
            for c, idx, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if out is None or c != conv:
                    if out is not None:
                        out.cut()
                        rows += [(conv, *r) for r in out.rows]
                    conv, out = c, Renderer(chunk_chars, idx)
                out.chunk = idx if not out.parts else out.chunk
                out.add(role, text)
                rows += [(c, *r) for r in out.rows]
                out.rows.clear()
            if rows:
                yield _batch(rows, SCHEMA)
        if out is not None:
            out.cut()
            if out.rows:
                yield _batch([(conv, *r) for r in out.rows], SCHEMA)

    return work


def segments(events: DataFrame, *, chunk_chars: int = 1 << 20, segment_events: int = 512, segment_chars: int = 1 << 20, conv_col: str = "conv_id", seq_cols: Sequence[str] = ("seq",), kind_col: str | None = "kind", target_col: str | None = "target", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The formatted chunks of conversations inside a task (seg null) and the segments of the others, of a log dealt by ranges."""
    keys = [f"seq{i}" for i in range(len(seq_cols))]
    log = events.select(
        F.col(conv_col).cast("long").alias("conv_id"), *[F.col(c).cast("long").alias(k) for c, k in zip(seq_cols, keys, strict=True)],
        (F.col(kind_col) if kind_col else F.lit(None)).cast("string").alias("kind"), (F.col(target_col) if target_col else F.lit(None)).cast("int").alias("target"),
        F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"),
    )
    order = ["conv_id", *keys, "kind", "role", "text", "target"]
    # equal keys stay together, so events of one sequence are never torn apart
    dealt = log.repartitionByRange("conv_id", *keys).sortWithinPartitions(*order)
    return _work.keep(dealt.mapInArrow(_folded(chunk_chars, segment_events, segment_chars), f"{SCHEMA}, {_SEGMENT}"), "segments")


def format_log(events: DataFrame, *, chunk_chars: int = 1 << 20, **options) -> DataFrame:
    """Formatted chunks of every conversation of an event log, folded; without ``kind_col`` all events are messages. Options are those of :func:`segments`."""
    spark = events.sparkSession
    parts = segments(events, chunk_chars=chunk_chars, **options)
    chunks = parts.where("seg IS NULL").select("conv_id", "chunk", "formatted", "mask_starts", "mask_ends")
    torn = parts.where("seg IS NOT NULL").withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit("none")))
    before = torn.select("key", "seg", "add", "low", "high").groupBy("key").applyInPandas(_counted, "s long, before int")  # a row a segment
    with _work.batches_of(spark, 32):  # segments are large rows
        known = torn.join(before, F.col("seg") == F.col("s")).select("conv_id", "seg", "before", "kinds", "targets", "roles", "texts")
        done = _work.keep(known.mapInArrow(_segments, _DONE), "folded")
        key = F.coalesce(F.col("conv_id").cast("string"), F.lit("none"))
        later = W.partitionBy(key).orderBy("seg").rowsBetween(1, W.unboundedFollowing)
        limits = done.select("conv_id", "seg", "kept").select(F.col("seg").alias("s"), F.min("kept").over(later).alias("most"))
        done = done.join(limits, F.col("seg") == F.col("s")).drop("s")
        stays = lambda idx: F.col("most").isNull() | (idx < F.col("most"))
        own = done.select("conv_id", "seg", "most", "kept", F.posexplode(F.arrays_zip("roles", "texts")).alias("at", "t")).withColumn("idx", F.col("kept") + F.col("at"))
        own = own.where(stays(F.col("idx"))).select("conv_id", "idx", "seg", F.lit(True).alias("anew"), F.col("t.roles").alias("role"), F.col("t.texts").alias("text"))
        patches = done.where("patch IS NOT NULL").withColumn("idx", F.col("kept") - 1).where(stays(F.col("idx"))).select("conv_id", "idx", "seg", F.col("replaced").alias("anew"), F.lit(None).cast("string").alias("role"), F.col("patch").alias("text"))
        pieces = own.unionByName(patches).groupBy("conv_id", "idx").agg(F.array_sort(F.collect_list(F.struct("seg", "anew", "text"))).alias("p"), F.max("role").alias("role"))
        start = F.array_max(F.transform("p", lambda x, i: F.when(x["anew"], i).otherwise(0)))
        text = F.array_join(F.transform(F.slice("p", start + 1, F.size("p")), lambda x: x["text"]), "")
        turns = pieces.select("conv_id", "idx", "role", text.alias("text"))
        rest = _work.keep(turns.repartitionByRange("conv_id", "idx").sortWithinPartitions("conv_id", "idx").mapInArrow(_rendered(chunk_chars), SCHEMA), "rendered")
    return chunks.unionByName(rest)


def read_back(chunks: DataFrame) -> DataFrame:
    """Digests of every conversation, parsed and unescaped from formatted chunks."""

    def work(batches):
        rows, none = [], object()
        conv = none
        for batch in batches:
            for c, _, formatted, starts, ends in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if conv is none or c != conv:
                    if conv is not none:
                        rows.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                    conv, n, turns, loss_chars, loss, chars = c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0
                chars += len(formatted)
                for m in _TURN.finditer(formatted):
                    n += 1
                    turns.update(f"{unescape_role(m[1])}\n{unescape(m[2])}\n".encode("utf-8", "surrogatepass"))
                for a, b in zip(starts, ends, strict=True):
                    text = unescape(formatted[a:b])
                    loss_chars += len(text)
                    loss.update(text.encode("utf-8", "surrogatepass"))
            if len(rows) >= 4096:
                yield _digests(rows)
                rows.clear()
        if conv is not none:
            rows.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
            yield _digests(rows)

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return chunks.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(work, schema)


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def event_log(talk: DataFrame) -> DataFrame:
    """conv_id, turn, nth, step, kind, target, role, text: messages (conv_id, turn, role, text) as the events that they could come from.

    By a hash of its place, a message is one event, or starts and is streamed in two deltas, or is edited after a draft, or is
    generated again after a first attempt; folded, the log is the messages again. ``nth`` orders messages of one turn by role and text.
    """
    talk = talk.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    place = W.partitionBy("conv_id", "turn").orderBy("role", "text")
    rows = talk.repartitionByRange("conv_id", "turn").withColumn("nth", F.row_number().over(place)).withColumn("half", F.floor(F.length("text") / 2).cast("int"))

    def event(step: int, kind: str, role: Column | None = None, text: Column | None = None) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(F.lit(step).alias("step"), F.lit(kind).alias("kind"), (none if role is None else role).alias("role"), (none if text is None else text).alias("text"))

    role, text = F.col("role"), F.col("text")
    head, tail = F.substring(text, F.lit(1), F.col("half")), F.substring(text, F.col("half") + 1, F.length(text))
    streamed = F.array(event(0, "start", role), event(1, "delta", None, head), event(2, "delta", None, tail))
    edited = F.array(event(0, "message", role, head), event(1, "edit", None, text))
    again = F.array(event(0, "start", role), event(1, "delta", None, tail), event(2, "regenerate"), event(3, "start", role), event(4, "delta", None, text))
    way = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4))
    events = F.when(way == 0, streamed).when(way == 1, edited).when(way == 2, again).otherwise(F.array(event(0, "message", role, text)))
    return rows.select("conv_id", "turn", "nth", F.explode(events).alias("e")).select("conv_id", "turn", "nth", "e.step", "e.kind", F.lit(None).cast("int").alias("target"), "e.role", "e.text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one with control strings in its texts: as an event log, folded, formatted, written and read back."""
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    tricky = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], talk.schema)
    log = _work.keep(event_log(talk.unionByName(extra)), "events")
    chunks = _work.keep(format_log(log, seq_cols=("turn", "nth", "step")), "chat")
    return read_back(chunks)


ORACLE_SQL = """
WITH talk AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|>' || role || '<|im_end|>') + 2 + length(text) + len(regexp_extract_all(text, '<\\\\*\\|'))) AS BIGINT) AS formatted_chars
FROM talk GROUP BY conv_id
"""
