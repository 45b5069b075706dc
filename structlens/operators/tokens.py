"""Identifiers and calls with their places: one scan of each line or file, linear in its length."""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..session import ship, spread
from .ordered import group_starts, in_file_order, whole_groups
from .statements import File

_NAME = regex.compile(r"[\p{Alphabetic}_][\p{Alphabetic}\p{N}_]*")
_CALL = regex.compile(r"([\p{Alphabetic}\p{N}_]+) *\(")
_TOKENS = "file_path string, line_no int, col int, text string"
_KINDS = _TOKENS + ", token_kind string"


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(c.split()[0], pa.int32() if c.endswith(" int") else pa.string()) for c in ddl.split(", ")])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _by_line(find, ddl: str):
    """Rows of ``find(text)`` for each line (file_path, line_no, text) by itself."""

    def work(batches):
        schema = _arrow(ddl)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, rows = batch.slice(at, 512), []
                for path, number, line in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    rows += [(path, number, *found) for found in find(line or "")]
                if rows:
                    yield _batch(rows, schema)

    return work


def tokens(lines: DataFrame) -> DataFrame:
    """file_path, line_no, col (in characters), text of every identifier of lines in any language or none."""
    find = lambda line: [(m.start(), m[0]) for m in _NAME.finditer(line)]
    return lines.select("file_path", F.col("line_no").cast("int"), "text").mapInArrow(_by_line(find, _TOKENS), _TOKENS)


def _named(batches):
    """Of lines (file_path, line_no, text, names) the identifiers that are among their names."""
    schema = _arrow(_TOKENS)
    for batch in batches:
        rows = []
        for path, number, line, names in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            wanted = [n for n in names if n in (line or "")]
            if wanted:
                rows += [(path, number, m.start(), m[0]) for m in _NAME.finditer(line) if m[0] in wanted]
        if rows:
            yield _batch(rows, schema)


def named_tokens(lines: DataFrame, names: DataFrame) -> DataFrame:
    """:func:`tokens` of lines that are among the names (file_path, text) of their file; if the lines have a language, in code only.

    Names reach the lines by file, so that only what matches leaves the scan.
    """
    per = names.groupBy(F.col("file_path").alias("n_path")).agg(F.collect_set("text").alias("names"))
    met = lines.join(per, lines["file_path"] == per["n_path"])
    if "language" not in lines.columns:
        return met.select("file_path", F.col("line_no").cast("int"), "text", "names").mapInArrow(_named, _TOKENS)

    def work(batches):
        for table in whole_groups(batches):
            starts = [*group_starts(table.column("file_path")).tolist(), table.num_rows]
            paths, languages, numbers, texts, wanted = (table.column(c).to_pylist() for c in ("file_path", "language", "line_no", "text", "names"))
            files = ((paths[a], numbers[a], File("\n".join(t or "" for t in texts[a:b]), languages[a]), set(wanted[a])) for a, b in zip(starts[:-1], starts[1:], strict=True))
            for batch in _lexed(files):
                yield batch.select(["file_path", "line_no", "col", "text"]).filter(pc.equal(batch.column("token_kind"), "code"))

    return in_file_order(met.select("file_path", "language", "line_no", "text", "names"), "line_no").mapInArrow(work, _TOKENS)


def _lexed(files):
    """Tokens with their kinds of (path, number of the first line, file, names or none for all)."""
    schema, rows = _arrow(_KINDS), []
    for path, first, file, names in files:
        spans = file.spans
        for line, start in enumerate(file.starts):
            end = file.starts[line + 1] - 1 if line + 1 < len(file.starts) else len(file.source)
            k = bisect_right(spans, (start, len(file.source), "")) - 1
            for m in _NAME.finditer(file.source, start, end):
                if names is not None and m[0] not in names:
                    continue
                while k + 1 < len(spans) and spans[k + 1][0] <= m.start():
                    k += 1
                kind = spans[k][2] if k >= 0 and spans[k][1] > m.start() else "code"
                rows.append((path, line + first, m.start() - start, m[0], kind))
        if len(rows) >= 1 << 14:
            yield _batch(rows, schema)
            rows = []
    if rows:
        yield _batch(rows, schema)


def lexed_tokens(lines: DataFrame) -> DataFrame:
    """:func:`tokens` of lines (file_path, language, line_no, text) with token_kind: code, comment or string, by the rules of the language."""

    def work(batches):
        def files():
            for table in whole_groups(batches):
                starts = [*group_starts(table.column("file_path")).tolist(), table.num_rows]
                paths, languages, numbers, texts = (table.column(c).to_pylist() for c in ("file_path", "language", "line_no", "text"))
                for a, b in zip(starts[:-1], starts[1:], strict=True):
                    yield paths[a], numbers[a], File("\n".join(t or "" for t in texts[a:b]), languages[a]), None

        yield from _lexed(files())

    return in_file_order(lines.select("file_path", "language", "line_no", "text"), "line_no").mapInArrow(work, _KINDS)


def source_tokens(files: DataFrame) -> DataFrame:
    """:func:`lexed_tokens` of whole files (file_path, language, source), without a shuffle of their texts."""
    ship(files.sparkSession)

    def work(batches):
        yield from _lexed((path, 0, File(source.replace("\r\n", "\n"), language), None) for batch in batches for path, language, source in zip(*(c.to_pylist() for c in batch.columns), strict=True) if source is not None)

    return spread(files.select("file_path", "language", "source")).mapInArrow(work, _KINDS)


def _calls(line: str) -> list[tuple[str, int]]:
    out, at, column = [], 0, 0
    for m in _CALL.finditer(line):
        column += len(line[at : m.start()].encode("utf-8", "surrogatepass"))
        at = m.start()
        out.append((m[1], column))
    return out


def call_columns(lines: DataFrame) -> DataFrame:
    """Call sites with the byte column of the name, for callers that need a cursor position."""
    t = text.trim(F.col("text"))
    rows = lines.where(~(t.startswith("//") | t.startswith("#")) & F.col("text").contains("("))
    ddl = "file_path string, line_no int, name string, column int"
    return rows.select("file_path", F.col("line_no").cast("int"), "text").mapInArrow(_by_line(_calls, ddl), ddl).where(~F.col("name").isin(fixed.CALL_KEYWORDS))
