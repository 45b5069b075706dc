"""Edits as plans over lines: nothing is changed in place, the result is the new text."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ship


def _renumber(rows: DataFrame) -> DataFrame:
    w = W.partitionBy("file_path").orderBy("major", "minor")
    return rows.withColumn("line_no", (F.row_number().over(w) - 1).cast("int")).select("file_path", "line_no", "text")


def _old(lines: DataFrame) -> DataFrame:
    return lines.select("file_path", "text", F.col("line_no").cast("double").alias("major"), F.lit(0).alias("minor"))


def _new(edits: DataFrame, at, content: str = "content") -> DataFrame:
    """New lines that sort to the place ``at``; content is a text of lines."""
    return edits.select("file_path", at.alias("major"), F.posexplode(F.split(content, "\n")).alias("minor", "text")).select("file_path", "text", F.col("major").cast("double"), "minor")


def _checked(lines: DataFrame, edits: DataFrame, first: str, bad, what: str) -> DataFrame:
    """Edits of known files; one that is ``bad`` (which may name n, the lines of the file) raises."""
    n = lines.groupBy(F.col("file_path").alias("n_path")).agg((F.max("line_no") + 1).alias("n"))
    # the message names columns of both sides, so the check stays above the join
    problem = F.raise_error(F.concat(F.lit(f"{what} out of bounds: "), "file_path", F.lit(" of "), "n_path")).cast("int")
    return edits.join(n, F.col("file_path") == F.col("n_path")).withColumn(first, F.when(bad, problem).otherwise(F.col(first))).drop("n", "n_path")


_BAD_RANGE = "start_line < 1 OR start_line > end_line OR end_line > n"


def replace_lines(lines: DataFrame, edits: DataFrame) -> DataFrame:
    """One edit a file: (file_path, start_line, end_line from 1, both included, content). Invalid ranges raise."""
    edits = _checked(lines, edits, "start_line", F.expr(_BAD_RANGE), "line range")
    e = edits.select(F.col("file_path").alias("e_path"), "start_line", "end_line")
    left = lines.join(e, (lines["file_path"] == e["e_path"]) & lines["line_no"].between(e["start_line"] - 1, e["end_line"] - 1), "left_anti")
    return _renumber(_old(left).unionByName(_new(edits, F.col("start_line") - 1)))


def insert_at_line(lines: DataFrame, edits: DataFrame) -> DataFrame:
    """New lines (file_path, line from 1, content) before the line that is there, or behind the last; other places raise."""
    edits = _checked(lines, edits, "line", F.expr("line < 1 OR line > n + 1"), "line")
    return _renumber(_old(lines).unionByName(_new(edits, F.col("line") - 1.5)))


def delete_lines(lines: DataFrame, edits: DataFrame) -> DataFrame:
    """Lines without those of (file_path, start_line, end_line from 1, both included). Invalid ranges raise."""
    e = _checked(lines, edits, "start_line", F.expr(_BAD_RANGE), "line range").select(F.col("file_path").alias("e_path"), "start_line", "end_line")
    return _renumber(_old(lines.join(e, (lines["file_path"] == e["e_path"]) & lines["line_no"].between(e["start_line"] - 1, e["end_line"] - 1), "left_anti")))


def create_file(lines: DataFrame, new: DataFrame, *, overwrite: bool = False) -> DataFrame:
    """Lines with new files (file_path, content) added; an existing file stays unless ``overwrite``."""
    if overwrite:
        lines = lines.join(new.select("file_path"), "file_path", "left_anti")
    else:
        new = new.join(lines.select("file_path").distinct(), "file_path", "left_anti")
    return lines.select("file_path", "line_no", "text").unionByName(new.select("file_path", F.posexplode(F.split("content", "\n")).alias("line_no", "text")))


def _symbol_spans(edits: DataFrame, symbols: DataFrame) -> DataFrame:
    first = symbols.groupBy("file_path", F.col("name").alias("symbol")).agg(F.min_by(F.struct("line_start", "line_end"), "seq").alias("x"))
    return edits.join(first, ["file_path", "symbol"]).withColumns({"start_line": F.col("x.line_start") + 1, "end_line": F.col("x.line_end") + 1}).drop("x")


def replace_symbol_body(lines: DataFrame, symbols: DataFrame, edits: DataFrame) -> DataFrame:
    """(file_path, symbol, content): the lines of the first symbol of that name make way for the content."""
    return replace_lines(lines, _symbol_spans(edits, symbols))


def insert_after_symbol(lines: DataFrame, symbols: DataFrame, edits: DataFrame) -> DataFrame:
    e = _symbol_spans(edits, symbols).withColumn("content", F.concat(F.lit("\n"), "content"))
    return insert_at_line(lines, e.withColumn("line", F.col("end_line") + 1))


def insert_before_symbol(lines: DataFrame, symbols: DataFrame, edits: DataFrame) -> DataFrame:
    e = _symbol_spans(edits, symbols).withColumn("content", F.concat("content", F.lit("\n")))
    return insert_at_line(lines, e.withColumn("line", F.col("start_line")))


def symbol_text(lines: DataFrame, symbols: DataFrame, wanted: DataFrame) -> DataFrame:
    """(file_path, symbol, content) of wanted (file_path, symbol)."""
    spans = _symbol_spans(wanted, symbols)
    l = lines.select(F.col("file_path").alias("l_path"), "line_no", "text")  # noqa: E741
    met = spans.join(l, (spans["file_path"] == l["l_path"]) & l["line_no"].between(spans["start_line"] - 1, spans["end_line"] - 1))
    return met.groupBy("file_path", "symbol").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("content"))


def copy_symbol(lines: DataFrame, symbols: DataFrame, moves: DataFrame, *, after: bool = True) -> DataFrame:
    """(source_file, symbol, target_file, target_symbol): puts the symbol's lines beside the target symbol."""
    body = symbol_text(lines, symbols, moves.select(F.col("source_file").alias("file_path"), "symbol").distinct()).withColumnRenamed("file_path", "source_file")
    edits = moves.join(body, ["source_file", "symbol"]).select(F.col("target_file").alias("file_path"), F.col("target_symbol").alias("symbol"), "content")
    return (insert_after_symbol if after else insert_before_symbol)(lines, symbols, edits)


def move_symbol(lines: DataFrame, symbols: DataFrame, moves: DataFrame, *, after: bool = True) -> DataFrame:
    """A copy, and the original gone, in one plan; a move within one file raises."""
    same = F.col("source_file") == F.col("target_file")
    moves = moves.withColumn("source_file", F.when(same, F.raise_error(F.lit("source and target are one file")).cast("string")).otherwise(F.col("source_file")))
    added = copy_symbol(lines, symbols, moves, after=after)
    cut = _symbol_spans(moves.select(F.col("source_file").alias("file_path"), "symbol").distinct(), symbols)
    sources = cut.select("file_path").distinct()
    return delete_lines(added.join(sources, "file_path", "left_semi"), cut).unionByName(added.join(sources, "file_path", "left_anti"))


def overlapping(edits: DataFrame) -> DataFrame:
    """Files with two edits (file_path, start, end as offsets) that overlap."""
    w = W.partitionBy("file_path").orderBy("start", "end")
    return edits.withColumn("before", F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))).where("start < before").select("file_path").distinct()


def _pieces(batches):
    """Old slices and new texts in turn, joined once: linear in the text and its edits."""
    for batch in batches:
        paths, sources, edits = (c.to_pylist() for c in batch.columns)
        for k, own in enumerate(edits):
            if own and sources[k] is not None:
                parts, at = [], 0
                for e in own:
                    parts += [sources[k][at : e["start"]], e["new_text"] or ""]
                    at = e["end"]
                sources[k] = "".join([*parts, sources[k][at:]])
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sources, pa.string())], names=["file_path", "source"])


def apply_edits(files: DataFrame, edits: DataFrame) -> DataFrame:
    """file_path, source after the edits (file_path, start, end, new_text; offsets in characters from 0); all edits of a file
    with an overlap are rejected and it keeps its text. Edits of one place go in by their texts."""
    ship(files.sparkSession)
    good = edits.join(overlapping(edits), "file_path", "left_anti")
    per = good.groupBy("file_path").agg(F.sort_array(F.collect_list(F.struct("start", "end", "new_text"))).alias("edits"))
    met = files.join(per, "file_path", "left").select(F.col("file_path").cast("string"), F.col("source").cast("string"), "edits")
    return met.mapInArrow(_pieces, "file_path string, source string")


def preview(edits: DataFrame) -> DataFrame:
    """One row: n_edits, n_files (different files) and n_groups, the groups of edits if they have a ``group_id``, else the files."""
    groups = F.countDistinct("group_id") if "group_id" in edits.columns else F.countDistinct("file_path")
    return edits.agg(F.count(F.lit(1)).alias("n_edits"), F.countDistinct("file_path").alias("n_files"), groups.alias("n_groups"))


def preview_files(edits: DataFrame) -> DataFrame:
    """file_path, n_edits of every file that edits touch, sorted."""
    return edits.groupBy("file_path").agg(F.count(F.lit(1)).alias("n_edits")).orderBy("file_path")


def resource_operations(files: DataFrame, operations: DataFrame) -> DataFrame:
    """file_path, source after (op, path, new_path): create (an empty file, unless it is there), rename, delete."""
    gone = operations.where("op IN ('delete', 'rename')").select(F.col("path").alias("file_path")).distinct()
    source = F.col("source") if "source" in files.columns else F.lit(None).cast("string")
    now = files.select("file_path", source.alias("source"))
    stay = now.join(gone, "file_path", "left_anti")
    moves = operations.where("op = 'rename'").select(F.col("path").alias("file_path"), "new_path")
    moved = now.join(moves, "file_path").select(F.col("new_path").alias("file_path"), "source")
    # what a rename puts in a place takes it over
    there = stay.join(moved.select("file_path"), "file_path", "left_anti").unionByName(moved)
    new = operations.where("op = 'create'").select(F.col("path").alias("file_path"), F.lit("").alias("source")).distinct()
    return there.unionByName(new.join(there.select("file_path"), "file_path", "left_anti"))
