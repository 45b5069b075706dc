"""Relations between symbols, lines and tokens: references, calls, related names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from . import tokens
from .spans import meet


def dependency_map(functions: DataFrame, lines: DataFrame) -> DataFrame:
    """file_path, caller, callee: within a file, a function whose lines hold ``callee(``, itself excluded.

    Lines meet functions by file and neighbourhood; calls then meet names by an equi join, so the cost is
    linear in calls and not functions times lines times functions. For a name that occurs twice, the last function counts.
    """
    calls = lines.select(F.col("file_path").alias("l_path"), "line_no", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([\p{IsAlphabetic}\p{N}_]+)\("), F.lit(1)))).alias("callee"))
    last = functions.groupBy("file_path", "name").agg(F.max_by(F.struct("line_start", "line_end"), "seq").alias("x")).select("file_path", F.col("name").alias("caller"), "x.line_start", "x.line_end")
    met = meet(calls, last, path="l_path", line="line_no", span_path="file_path", start="line_start", end="line_end")
    known = functions.select(F.col("file_path").alias("n_path"), F.col("name").alias("n_name")).distinct()
    out = met.join(known, (met["file_path"] == known["n_path"]) & (met["callee"] == known["n_name"]), "left_semi")
    return out.where("caller <> callee").select("file_path", "caller", "callee").distinct()


def callers_and_callees(calls: DataFrame) -> DataFrame:
    """file_path, name, callers, callees as sorted texts."""
    into = calls.groupBy("file_path", F.col("callee").alias("name")).agg(F.array_sort(F.collect_set("caller")).alias("callers"))
    out = calls.groupBy("file_path", F.col("caller").alias("name")).agg(F.array_sort(F.collect_set("callee")).alias("callees"))
    both = into.join(out, ["file_path", "name"], "full_outer")
    joined = lambda c: F.coalesce(F.array_join(c, ","), F.lit(""))
    return both.select("file_path", "name", joined("callers").alias("callers"), joined("callees").alias("callees"))


def find_references(targets: DataFrame, lines: DataFrame, definitions: DataFrame | None = None) -> DataFrame:
    """file_path, target, line_no, col (in characters): identifiers of the same file equal to the target, without exact
    definition spans. If the lines have a language, identifiers in comments and strings are none.

    Targets reach the lines by file, and only what matches leaves the scan of a line.
    """
    out = tokens.named_tokens(lines, targets.select("file_path", "text")).withColumnRenamed("text", "target").select("file_path", "target", "line_no", "col")
    return out if definitions is None else out.join(definitions.select("file_path", "target", "line_no", "col"), ["file_path", "target", "line_no", "col"], "left_anti")


def references_by_file(references: DataFrame) -> DataFrame:
    return references.groupBy("file_path").agg(F.count(F.lit(1)).alias("n_references"))


def related_symbols(symbols: DataFrame) -> DataFrame:
    """stable_id, related_id, same_qualified: symbols of the same name elsewhere."""
    a = symbols.select("name", "stable_id", "qualified_name")
    b = symbols.select("name", F.col("stable_id").alias("related_id"), F.col("qualified_name").alias("related_name"))
    return a.join(b, "name").where("stable_id <> related_id").select("stable_id", "related_id", (F.col("qualified_name") == F.col("related_name")).alias("same_qualified"))


def diff_symbols(changed: DataFrame, symbols: DataFrame, present: DataFrame) -> DataFrame:
    """file_path, stable_id, kind of the innermost symbol of each changed line, each once; a line of a missing
    file is a row of its own with the id ``(deleted)``."""
    c = changed.select(F.col("file_path").alias("c_path"), F.col("line_no").alias("c_line")).distinct()
    here = c.join(present.select(F.col("file_path").alias("h_path")).distinct(), F.col("c_path") == F.col("h_path"), "left_semi")
    gone = c.join(present.select(F.col("file_path").alias("h_path")).distinct(), F.col("c_path") == F.col("h_path"), "left_anti")
    spans = symbols.select("file_path", "line_start", "line_end", "seq", "stable_id", "kind")
    met = meet(here, spans, path="c_path", line="c_line", span_path="file_path", start="line_start", end="line_end")
    best = met.groupBy("c_path", "c_line").agg(F.min_by(F.struct("stable_id", "kind"), F.struct(F.col("line_end") - F.col("line_start"), F.col("seq"))).alias("b"))
    kept = best.select(F.col("c_path").alias("file_path"), "b.stable_id", "b.kind", F.lit(None).cast("int").alias("line_no")).distinct()
    return kept.unionByName(gone.select(F.col("c_path").alias("file_path"), F.lit("(deleted)").alias("stable_id"), F.lit(None).cast("string").alias("kind"), F.col("c_line").alias("line_no")))


def changed_files(files: DataFrame, stats: DataFrame, symbols: DataFrame) -> DataFrame:
    """file_path, changes ("?" if unknown), n_symbols (0 if none)."""
    counts = symbols.groupBy("file_path").agg(F.count(F.lit(1)).alias("n_symbols"))
    return files.select("file_path").distinct().join(stats.select("file_path", "changes"), "file_path", "left").join(counts, "file_path", "left").select("file_path", F.coalesce("changes", F.lit("?")).alias("changes"), F.coalesce("n_symbols", F.lit(0)).alias("n_symbols"))


def call_hierarchy(calls: DataFrame) -> DataFrame:
    """file_path, name, direction (incoming, outgoing), other."""
    out = calls.select("file_path", F.col("caller").alias("name"), F.lit("outgoing").alias("direction"), F.col("callee").alias("other"))
    return out.unionByName(calls.select("file_path", F.col("callee").alias("name"), F.lit("incoming").alias("direction"), F.col("caller").alias("other")))


def go_to_definition(positions: DataFrame, lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """For each (file_path, line, column in bytes): the identifier there and the first symbol of that name in the file;
    ``ambiguous`` if there are several."""
    l = lines.select(F.col("file_path").alias("l_path"), "line_no", "text")  # noqa: E741
    at = positions.join(l, (positions["file_path"] == l["l_path"]) & (positions["line"] == l["line_no"]), "left")
    at = at.select("file_path", "line", "column", text.identifier_at(F.col("text"), F.col("column")).alias("identifier"))
    s = symbols.groupBy(F.col("file_path").alias("s_path"), F.col("name").alias("s_name")).agg(F.min_by("stable_id", "seq").alias("definition"), (F.count(F.lit(1)) > 1).alias("ambiguous"))
    return at.join(s, (at["file_path"] == s["s_path"]) & (at["identifier"] == s["s_name"]), "left").select("file_path", "line", "column", "identifier", "definition", "ambiguous")


def related_counts(symbols: DataFrame) -> DataFrame:
    """name, n, n_qualified (different qualified names): what :func:`related_symbols` pairs, a row a name instead of all pairs."""
    return symbols.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("qualified_name").alias("n_qualified"), F.min("stable_id").alias("first_id"))


def rename_edits(references: DataFrame, names: DataFrame, lines: DataFrame) -> DataFrame:
    """file_path, start, end, new_text: edits for :func:`edit.apply_edits` that put the new name over every reference of a
    target (file_path, target, new_name). Offsets count characters of the file, line ends included as one each."""
    met = references.join(names, ["file_path", "target"])
    ahead = W.partitionBy("o_path").orderBy("o_line").rowsBetween(W.unboundedPreceding, -1)
    offsets = lines.select(F.col("file_path").alias("o_path"), F.col("line_no").alias("o_line"), "text").select("o_path", "o_line", F.coalesce(F.sum(F.length("text") + 1).over(ahead), F.lit(0)).alias("offset"))
    met = met.join(offsets, (met["file_path"] == offsets["o_path"]) & (met["line_no"] == offsets["o_line"]))
    start = (F.col("offset") + F.col("col")).cast("int")
    return met.select("file_path", start.alias("start"), (start + F.length("target")).alias("end"), F.col("new_name").alias("new_text"))
