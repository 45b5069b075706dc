"""Read queries over symbols and lines: each is one plan for all files, a parameter is a filter or a small join side."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed, text
from .graph import shared_folder
from .spans import meet
from .tokens import call_columns  # noqa: F401

MEMBER_ROWS = 256
TASK_BYTES = 8 << 20


def get_symbols(symbols: DataFrame) -> DataFrame:
    return symbols.select("file_path", "seq", "name", "qualified_name", "stable_id", "kind", "line_start", "line_end", "signature")


def get_structure(symbols: DataFrame, depth: int | None = None) -> DataFrame:
    """file_path, structure: one indented line a symbol, down to ``depth`` (0 keeps the roots)."""
    rows = symbols if depth is None else symbols.where(F.col("depth") <= depth)
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.col("kind"), F.lit(" "), F.col("name"))
    parts = F.array_sort(F.collect_list(F.struct("seq", line.alias("line"))))
    return rows.groupBy("file_path").agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("structure"))


def first_by_name(symbols: DataFrame) -> DataFrame:
    """The first symbol of each name in a file, in preorder."""
    w = W.partitionBy("file_path", "name").orderBy("seq")
    return symbols.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def get_definition(symbols: DataFrame, lines: DataFrame, *, full: bool = False) -> DataFrame:
    """The first symbol of each name with its body; of more than 50 lines only the first 11 are shown, and no more than 51 are read."""
    last = lines.groupBy(F.col("file_path").alias("n_path")).agg(F.max("line_no").alias("last"))
    own = first_by_name(symbols).join(last, F.col("file_path") == F.col("n_path"), "left").drop("n_path")
    own = own.withColumn("n", F.least("line_end", F.coalesce("last", F.lit(-1))) - F.col("line_start") + 1).drop("last")
    body = with_lines(own, lines, most=None if full else 51)
    n = F.col("n")
    shown = F.array_join("body", "\n") if full else F.when(n > 50, F.concat(F.array_join(F.slice("body", 1, 11), "\n"), F.lit("\n... ("), (n - 11).cast("string"), F.lit(" more lines)"))).otherwise(F.array_join("body", "\n"))
    return body.select("file_path", "name", "kind", "line_start", "line_end", shown.alias("body"))


def with_lines(symbols: DataFrame, lines: DataFrame, *, most: int | None = None) -> DataFrame:
    """Adds body, the texts of a symbol's lines in order (of its first ``most``, if given). Only places and texts are shuffled."""
    until = F.col("line_end") if most is None else F.least(F.col("line_end"), F.col("line_start") + most - 1)
    spans = symbols.select(F.col("file_path").alias("s_path"), F.col("line_start").alias("s_start"), F.col("line_end").alias("s_end"), until.alias("s_until")).distinct()
    points = lines.select(F.col("file_path").alias("l_path"), "line_no", F.col("text").alias("l_text"))
    met = meet(points, spans, path="l_path", line="line_no", span_path="s_path", start="s_start", end="s_until")
    parts = F.array_sort(F.collect_list(F.struct("line_no", "l_text")))
    bodies = met.groupBy("s_path", "s_start", "s_end").agg(F.transform(parts, lambda p: p["l_text"]).alias("body"))
    out = symbols.join(bodies, (symbols["file_path"] == bodies["s_path"]) & (symbols["line_start"] == bodies["s_start"]) & (symbols["line_end"] == bodies["s_end"]), "left")
    return out.drop("s_path", "s_start", "s_end").withColumn("body", F.coalesce("body", F.array().cast("array<string>")))


def search_symbols(symbols: DataFrame, pattern: str, *, kind: str | None = None, limit: int | None = None) -> DataFrame:
    """Symbols whose name holds the pattern in any case, ordered by file and place; ``truncated`` tells whether there were more."""
    if kind is not None and kind not in fixed.KINDS:
        raise ValueError(f"unknown kind: {kind}")
    hit = symbols.where(F.contains(F.lower("name"), F.lit(pattern.lower())))
    hit = hit if kind is None else hit.where(F.col("kind") == kind)
    if limit is None:
        return hit.withColumn("truncated", F.lit(False))
    # one row more than asked for tells whether there are more; the windows see those few rows only
    few = hit.orderBy("file_path", "seq").limit(limit + 1)
    every = W.orderBy("file_path", "seq")
    few = few.withColumn("nth", F.row_number().over(every)).withColumn("truncated", F.max("nth").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) > limit)
    return few.where(F.col("nth") <= limit).drop("nth")


def capped(symbols: DataFrame, cap: int = fixed.SEARCH_SYMBOLS) -> DataFrame:
    """The first ``cap`` symbols by file and place; ``truncated`` tells that the cap was reached."""
    few = symbols.orderBy("file_path", "seq").limit(cap)
    n = F.count(F.lit(1)).over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))  # over at most ``cap`` rows
    return few.withColumn("truncated", n >= cap)


def capped_by_subtree(symbols: DataFrame, pattern: str = "", cap: int = fixed.SEARCH_SYMBOLS) -> DataFrame:
    """Symbols whose name holds the pattern in any case, by file and place, up to the end of the first subtree that reaches the cap; ``truncated`` tells that one did.

    A symbol at the top and what is below it are taken whole. Each has a match at least, so the first ``cap`` of them are enough, and only these are put in order.
    """
    hit = symbols.where(F.contains(F.lower("name"), F.lit(pattern.lower()))).withColumn("root", F.coalesce("parent_seq", "seq"))
    few = hit.groupBy("file_path", "root").agg(F.count(F.lit(1)).alias("n")).orderBy("file_path", "root").limit(cap)
    order = W.orderBy("file_path", "root")  # at most ``cap`` rows
    few = few.withColumn("before", F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("truncated", F.sum("n").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) >= cap)
    kept = few.where(F.col("before") < cap).select(F.col("file_path").alias("k_path"), F.col("root").alias("k_root"), "truncated")
    return hit.join(F.broadcast(kept), (hit["file_path"] == kept["k_path"]) & (hit["root"] == kept["k_root"])).drop("k_path", "k_root", "root")


def flat_text(symbols: DataFrame) -> DataFrame:
    """file_path, seq, line: kind, name and place of each symbol, with its signature below."""
    place = F.concat(F.lit(" ["), F.concat_ws("-", F.concat_ws(":", "line_start", "column_start"), F.concat_ws(":", "line_end", "column_end")), F.lit("]"))
    return symbols.select("file_path", "seq", F.concat_ws("\n  ", F.concat("kind", F.lit(" "), "name", place), "signature").alias("line"))


def as_json(symbols: DataFrame) -> DataFrame:
    """file_path, json: the symbols of a file in order, as one JSON list."""
    fields = [c for c in ("name", "kind", "line_start", "line_end", "signature") if c in symbols.columns]
    parts = F.array_sort(F.collect_list(F.struct("seq", F.struct(*fields).alias("x"))))
    return symbols.groupBy("file_path").agg(F.to_json(F.transform(parts, lambda p: p["x"])).alias("json"))


def get_region(wanted: DataFrame, heuristic: DataFrame, parserless: DataFrame, symbols: DataFrame) -> DataFrame:
    """file_path, region_id, line, line_end (from 1) of wanted (file_path, region_id): ids that begin with "h-" and "region-" are regions of the two outlines,
    others stable ids of symbols."""
    way = F.when(F.col("region_id").startswith("h-"), 0).when(F.col("region_id").startswith("region-"), 1).otherwise(2)
    known = heuristic.select("file_path", "region_id", "line", "line_end", F.lit(0).alias("way")).unionByName(parserless.select("file_path", "region_id", "line", "line_end", F.lit(1).alias("way")))
    known = known.unionByName(symbols.select("file_path", F.col("stable_id").alias("region_id"), (F.col("line_start") + 1).alias("line"), (F.col("line_end") + 1).alias("line_end"), F.lit(2).alias("way")))
    return wanted.select("file_path", "region_id", way.alias("way")).join(known, ["file_path", "region_id", "way"]).drop("way")


def get_signature(symbols: DataFrame) -> DataFrame:
    return first_by_name(symbols).select("file_path", "name", F.coalesce("signature", F.concat("name", F.lit(" (no signature available)"))).alias("signature"))


def get_imports(symbols: DataFrame) -> DataFrame:
    return symbols.where("kind = 'Import' AND depth = 0")


def get_exports(symbols: DataFrame) -> DataFrame:
    ext = text.extension(F.col("file_path"))
    return symbols.where(F.coalesce(text.is_exported(ext, F.col("name"), F.col("signature")), F.lit(False)))


def chunk_boundaries(symbols: DataFrame, strategy: str) -> DataFrame:
    """Top-level symbols that start a chunk under a strategy; an unknown strategy has none."""
    top = symbols.where("depth = 0")
    rest = ~F.col("kind").isin("Variable", "Import")
    rules: dict[str, Column] = {"Function": F.col("kind") == "Function", "Class": F.col("kind").isin("Class", "Struct"), "TopLevel": rest, "Semantic": rest}
    return top.where(rules.get(strategy, F.lit(False)))


def get_scope(positions: DataFrame, symbols: DataFrame) -> DataFrame:
    """For each (file_path, line) the innermost symbol around it: least span, then first in preorder; else top level."""
    p = positions.select(F.col("file_path").alias("p_path"), F.col("line").alias("p_line")).distinct()
    s = symbols.select("file_path", "line_start", "line_end", "seq", "qualified_name", "kind")
    met = meet(p, s, path="p_path", line="p_line", span_path="file_path", start="line_start", end="line_end", how="left")
    best = met.groupBy("p_path", "p_line").agg(F.min_by(F.struct("qualified_name", "kind"), F.struct(F.col("line_end") - F.col("line_start"), F.col("seq"))).alias("b"))
    return best.select(F.col("p_path").alias("file_path"), F.col("p_line").alias("line"), F.coalesce("b.qualified_name", F.lit("Top-level scope")).alias("scope"), F.col("b.kind").alias("kind"))


def enclosing_class(symbols: DataFrame) -> DataFrame:
    """For each (file, member name) the first symbol that has a child of that name, with the names of all its children.

    The list of a symbol is repeated for each member name that it is first for. Lists are made, as texts, only for symbols that are first for some name, and meet
    their rows last, in a join behind which nothing is sorted or shuffled. A task gets the rows of one long list only (many rows are dealt over several tasks), or
    those of short lists, ``TASK_BYTES`` or so in all: a writer that judges sizes by the rows before, as Parquet's does, meets no run of equal lists that hides what
    follows it. The symbols and the names are written to the shared folder first, since the tasks have to be counted.
    """
    key = ["file_path", "p_seq"]
    symbols = _written(symbols.select("file_path", "seq", "parent_seq", "name", "kind"))
    child = symbols.where("parent_seq IS NOT NULL").select("file_path", F.col("parent_seq").alias("p_seq"), F.col("name").alias("method"), F.col("seq").alias("c_seq"))
    first = child.groupBy("file_path", "method").agg(F.min("p_seq").alias("p_seq")).groupBy(*key).agg(F.collect_list(F.struct("method")).alias("methods"))
    width = child.groupBy(*key).agg(F.sum(F.octet_length("method") + 1).alias("width"))
    n = F.size("methods")
    first = first.join(width, key).withColumn("size", n * F.coalesce("width", F.lit(0)))
    first = _written(first.withColumn("shares", F.when(F.col("size") >= TASK_BYTES, F.ceil(F.least(n / MEMBER_ROWS, F.sqrt(n) / 6)).cast("int"))))
    tasks = first.agg(F.coalesce(F.sum("shares"), F.lit(0)).alias("long"), F.coalesce(F.sum(F.when(F.col("shares").isNull(), F.col("size"))), F.lit(0)).alias("short")).first()
    n_long, n_short = tasks["long"], 1 + tasks["short"] // TASK_BYTES
    # a row for each long list, so no more rows than the result has TASK_BYTES
    at = first.where("shares IS NOT NULL").select(*key, (F.sum("shares").over(W.orderBy(*key)) - F.col("shares")).alias("at"))
    shares = F.coalesce("shares", F.lit(1))
    task = F.coalesce(F.col("at") + F.col("share"), n_long + F.pmod(F.hash(*key), F.lit(n_short))).cast("int")
    placed = first.join(at, key, "left").withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1))).withColumn("task", task)
    step = F.ceil(n / shares).cast("int")
    owner = symbols.select("file_path", F.col("seq").alias("p_seq"), F.col("name").alias("class_name"), F.col("kind").alias("class_kind"))
    named = placed.withColumn("m", F.explode(F.slice("methods", F.col("share") * step + 1, step))).select("task", *key, "m.method").join(owner, key)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_seq", "method"))), lambda x: x["method"]), ",")
    members = child.join(first.select(*key), key).groupBy(*key).agg(listed.alias("members"))
    members = placed.select("task", *key).join(members, key)
    # a merge join makes one row at a time, a broadcast one all rows of a list
    met = named.repartitionById(n_long + n_short, "task").join(members.repartitionById(n_long + n_short, "task").hint("merge"), ["task", *key])
    return met.select("file_path", "method", "class_name", "class_kind", "members")


def _written(df: DataFrame) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/structlens/enclosing-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def symbol_body(hints: DataFrame, symbols: DataFrame) -> DataFrame:
    """For each (file_path, name, hint) the symbol of that name that starts closest to the hint (null: the first)."""
    s = symbols.select(F.col("file_path").alias("s_path"), F.col("name").alias("s_name"), "line_start", "line_end", "seq", "stable_id")
    met = hints.join(s, (hints["file_path"] == s["s_path"]) & (hints["name"] == s["s_name"]))
    far = F.coalesce(F.abs(F.col("line_start") - F.col("hint")), F.lit(0))
    return met.groupBy("file_path", "name", "hint").agg(F.min_by(F.struct("stable_id", "line_start", "line_end"), F.struct(far, F.col("seq"))).alias("b")).select("file_path", "name", "hint", "b.stable_id", "b.line_start", "b.line_end")


def type_definitions(symbols: DataFrame) -> DataFrame:
    """Types at any depth with the first line of their comment and their direct members."""
    types = symbols.where(F.col("kind").isin(fixed.TYPE_KINDS))
    child = symbols.where("parent_seq IS NOT NULL").groupBy(F.col("file_path").alias("c_path"), F.col("parent_seq").alias("c_seq")).agg(F.array_sort(F.collect_list(F.struct("seq", "name"))).alias("m"))
    met = types.join(child, (types["file_path"] == child["c_path"]) & (types["seq"] == child["c_seq"]), "left")
    names = F.coalesce(F.array_join(F.transform("m", lambda x: x["name"]), ","), F.lit(""))
    return met.select("file_path", "seq", "name", "kind", F.substring_index("doc_comment", "\n", 1).alias("doc"), names.alias("members"))


def summarize_file(symbols: DataFrame) -> DataFrame:
    """One text a file: the comment's first line and the signature (or kind and name) of every symbol, indented."""
    pad = F.repeat(F.lit("  "), F.col("depth"))
    doc = F.when(F.col("doc_comment").isNotNull(), F.concat(pad, F.lit("/// "), F.substring_index("doc_comment", "\n", 1), F.lit("\n"))).otherwise("")
    line = F.concat(doc, pad, F.coalesce("signature", F.concat("kind", F.lit(" "), "name")))
    parts = F.array_sort(F.collect_list(F.struct("seq", line.alias("line"))))
    return symbols.groupBy("file_path").agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("summary"))


def marked_above(lines: DataFrame, mark: str, back: int = 5) -> DataFrame:
    """Adds ``marked``: one of the ``back`` lines above starts with the mark."""
    w = W.partitionBy("file_path").orderBy("line_no").rowsBetween(-back, -1)
    hit = F.startswith(text.trim(F.col("text")), F.lit(mark)).cast("int")
    return lines.withColumn("marked", F.coalesce(F.max(hit).over(w), F.lit(0)) == 1)


def get_tests(symbols: DataFrame, lines: DataFrame) -> DataFrame:
    """Tests by the rule of the file's language; Rust functions also count inside a module named ``tests``."""
    ext = text.extension(symbols["file_path"])
    rust = marked_above(lines, "#[test]").where("marked").select(F.col("file_path").alias("m_path"), F.col("line_no").alias("m_line"))
    mods = symbols.where("kind = 'Module' AND name = 'tests'").select(F.col("file_path").alias("t_path"), F.col("line_start").alias("t_start"), F.col("line_end").alias("t_end"))
    inside = symbols.join(mods, (symbols["file_path"] == mods["t_path"]) & symbols["line_start"].between(mods["t_start"], mods["t_end"])).select(F.col("file_path").alias("i_path"), F.col("seq").alias("i_seq")).distinct()
    function = F.col("kind").isin("Function", "Method")
    met = symbols.join(inside, (symbols["file_path"] == inside["i_path"]) & (symbols["seq"] == inside["i_seq"]), "left").join(rust, (symbols["file_path"] == rust["m_path"]) & (symbols["line_start"] == rust["m_line"]), "left")
    rule = (
        F.when(ext == "rs", function & (F.col("m_line").isNotNull() | F.col("i_seq").isNotNull() | F.coalesce(F.contains("doc_comment", F.lit("#[test]")), F.lit(False))))
        .when(ext == "py", (function & F.col("name").startswith("test_")) | ((F.col("kind") == "Class") & F.col("name").startswith("Test")))
        .when(ext.isin("js", "jsx", "ts", "tsx", "mjs"), function & (F.col("name").contains("test") | F.col("name").contains("it") | F.col("name").contains("describe")))
        .otherwise(F.col("name").startswith("test"))
    )
    return met.where(rule).drop("m_path", "m_line", "i_path", "i_seq")


def annotations(lines: DataFrame, tags: list[str] = fixed.TAGS) -> DataFrame:
    """file_path, line_no, tag, message: of the tags that a line holds in any case, the first in the order of ``tags``."""
    # matched in the text itself: upper case may have another length
    tag, at = F.lit(None).cast("string"), F.lit(None).cast("int")
    for t in reversed(tags):
        place = F.regexp_instr("text", F.lit(f"(?i)\\Q{t}\\E"))
        tag, at = F.when(place > 0, t).otherwise(tag), F.when(place > 0, place).otherwise(at)
    rows = lines.withColumn("tag", tag).withColumn("at", at).where("tag IS NOT NULL")
    rest = F.substring("text", F.col("at") + F.length("tag"), F.length("text"))
    message = text.trim(F.regexp_replace(F.regexp_replace(rest, r"^[: \]]+", ""), r"[*/]+$", ""))
    return rows.select("file_path", "line_no", "tag", message.alias("message"))


def call_sites(lines: DataFrame, function: str | None = None) -> DataFrame:
    """file_path, line_no, name, n: names before an opening parenthesis, without keywords; comment lines have none."""
    t = text.trim(F.col("text"))
    rows = lines.where(~(t.startswith("//") | t.startswith("#")) & F.col("text").contains("("))
    calls = rows.select("file_path", "line_no", F.posexplode(F.regexp_extract_all("text", F.lit(r"([\p{IsAlphabetic}\p{N}_]+) *\("), F.lit(1))).alias("n", "name"))
    calls = calls.where(~F.col("name").isin(fixed.CALL_KEYWORDS))
    return calls if function is None else calls.where(F.col("name") == function)


def get_parameters(symbols: DataFrame) -> DataFrame:
    """file_path, name, position, parameter, type of every parameter of every function."""
    rows = symbols.where(F.col("kind").isin("Function", "Method") & F.col("signature").isNotNull())
    rows = rows.select("file_path", "seq", "name", F.posexplode(text.parameters(F.col("signature"))).alias("position", "p"))
    return rows.select("file_path", "seq", "name", "position", F.col("p.name").alias("parameter"), F.col("p.type").alias("type"))


def diagnostics(spark) -> DataFrame:
    """Always empty: diagnostics come from a language server, and there is none."""
    return spark.createDataFrame([], "file_path string, line int, column int, severity string, message string")


def latest_diagnostics(stream_or_table: DataFrame) -> DataFrame:
    """The last list of diagnostics of each file, by arrival."""
    return stream_or_table.groupBy("file_path").agg(F.max_by("diagnostics", "arrival").alias("diagnostics"))


def complexity(symbols: DataFrame, lines: DataFrame) -> DataFrame:
    """Complexity and rating of every function: one plus what its lines add."""
    fns = symbols.where(F.col("kind").isin("Function", "Method")).select("file_path", "seq", "name", "line_start", "line_end")
    run = W.partitionBy("l_path").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    sums = lines.select(F.col("file_path").alias("l_path"), "line_no", text.complexity_of(F.col("text")).alias("n")).withColumn("upto", F.sum("n").over(run))
    # what the lines of a function add is the running sum at its end less that before its start: two equi joins, no ranges
    ends = sums.groupBy(F.col("l_path").alias("t_path")).agg(F.max("line_no").alias("last"), F.max("upto").alias("total"))
    first = sums.select(F.col("l_path").alias("a_path"), F.col("line_no").alias("a_line"), (F.col("upto") - F.col("n")).alias("ahead"))
    until = sums.select(F.col("l_path").alias("z_path"), F.col("line_no").alias("z_line"), "upto")
    out = fns.join(ends, fns["file_path"] == ends["t_path"], "left")
    out = out.join(first, (out["file_path"] == first["a_path"]) & (out["line_start"] == first["a_line"]), "left").join(until, (out["file_path"] == until["z_path"]) & (out["line_end"] == until["z_line"]), "left")
    reached = F.when(F.col("line_end") > F.col("last"), F.col("total")).otherwise(F.col("upto"))
    added = F.greatest(F.coalesce(reached - F.coalesce("ahead", F.col("total")), F.lit(0)), F.lit(0))
    out = out.select("file_path", "seq", "name", "line_start", "line_end", (added + 1).alias("complexity"))
    return out.withColumn("rating", text.complexity_rating(F.col("complexity")))
