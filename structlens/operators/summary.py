"""Summaries of a project."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed, text
from .graph import shared_folder


def count_by_kind(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def files_by_language(files: DataFrame) -> DataFrame:
    """language, n_files, most first; ties by name."""
    return files.where("language IS NOT NULL").groupBy("language").agg(F.count(F.lit(1)).alias("n_files")).orderBy(F.desc("n_files"), "language")


def key_types(symbols: DataFrame, k: int = 10) -> DataFrame:
    """The k most declared type names; ties by name."""
    types = symbols.where(F.col("kind").isin(fixed.TYPE_KINDS)).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return types.orderBy(F.desc("n"), "name").limit(k)


def module_summary(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """module, n_files, n_functions of every first folder."""
    fns = symbols.where(F.col("kind").isin("Function", "Method")).groupBy("file_path").agg(F.count(F.lit(1)).alias("f"))
    rows = files.select("file_path").distinct().join(fns, "file_path", "left").withColumn("module", text.module_of(F.col("file_path"))).where("module IS NOT NULL")
    return rows.groupBy("module").agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("f"), F.lit(0)).alias("n_functions"))


def entry_points(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """file_path, kind of files with a main function or a known name."""
    mains = symbols.where("name = 'main' AND kind = 'Function'").select(F.col("file_path").alias("m_path")).distinct()
    rows = files.select("file_path").distinct().join(mains, F.col("file_path") == F.col("m_path"), "left")
    return rows.select("file_path", text.entry_kind(F.col("m_path").isNotNull(), F.col("file_path")).alias("kind")).where("kind IS NOT NULL")


def surfaces(paths: DataFrame, samples: int = 12, column: str = "path") -> DataFrame:
    """surface, n, samples: the first paths in order, as one text. Only ``samples`` paths a surface are ever gathered."""
    rows = paths.select(F.col(column).alias("path")).withColumn("surface", text.surface(F.col("path"))).where("surface IS NOT NULL")
    counts = rows.groupBy("surface").agg(F.count(F.lit(1)).alias("n"))
    first = rows.select("surface", "path").distinct().withColumn("rank", F.row_number().over(W.partitionBy("surface").orderBy("path"))).where(F.col("rank") <= samples)
    listed = first.groupBy("surface").agg(F.array_join(F.array_sort(F.collect_list("path")), "\n").alias("samples"))
    return counts.join(listed, "surface")


def project_summary(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row: files, symbols, functions, test functions, test files, types, modules and the most frequent type names."""
    function = F.col("kind").isin("Function", "Method")
    s = symbols.agg(
        F.count(F.lit(1)).alias("n_symbols"), F.count_if(function).alias("n_functions"),
        F.count_if(function & text.is_test_function(F.col("name"), F.col("doc_comment"))).alias("n_test_functions"),
        F.count_if(F.col("kind").isin(fixed.TYPE_KINDS)).alias("n_types"),
    )
    f = files.select("file_path").distinct().agg(F.count(F.lit(1)).alias("n_files"), F.count_if(text.mentions_test(F.col("file_path"))).alias("n_test_files"), F.countDistinct(text.module_of(F.col("file_path"))).alias("n_modules"))
    top = key_types(symbols).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col("name")))), lambda x: x["name"]), ",").alias("key_types"))
    return f.crossJoin(s).crossJoin(top)


def _listed(rows: DataFrame, order: list[Column], line: Column) -> DataFrame:
    """line and nth of rows, one for each language, module, entry point or surface of a project."""
    return rows.select(F.row_number().over(W.orderBy(*order)).alias("nth"), line.alias("line"))


def project_report(name: str, root: str, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """section, nth, line: the summary of a project (file_path, language) as text, a row a line; a section without content has no rows.

    What is listed are languages, modules, entry points and key types: as many rows as a project has of them.
    """
    spark = files.sparkSession
    # read by every section: four narrow columns, written once to the shared folder
    path = f"{shared_folder(spark)}/structlens/report-{uuid.uuid4().hex}"
    symbols.select("file_path", "name", "kind", "doc_comment").write.parquet(path)
    symbols = spark.read.parquet(path)
    one = project_summary(files, symbols)
    s = lambda c: F.col(c).cast("string")
    languages = files_by_language(files).select("n_files", text.display_name(F.col("language")).alias("language"))
    shown = F.concat("language", F.lit(" ("), s("n_files"), F.when(F.col("n_files") == 1, " file)").otherwise(" files)"))
    parts = F.array_sort(F.collect_list(F.struct((-F.col("n_files")).alias("o"), "language", shown.alias("shown"))))
    head = spark.createDataFrame([(1, f"Project: {name}"), (2, f"Root: {root}")], "nth int, line string")
    modules = module_summary(files, symbols)
    lines = {
        "head": head,
        "languages": languages.agg(F.concat(F.lit("Languages: "), F.array_join(F.transform(parts, lambda p: p["shown"]), ", ")).alias("line")).select(F.lit(1).alias("nth"), "line"),
        "symbols": one.select(F.lit(1).alias("nth"), F.concat(F.lit("Symbols: "), s("n_symbols"), F.lit(" total")).alias("line")),
        "tests": one.select(F.lit(1).alias("nth"), F.concat(F.lit("Tests: "), s("n_test_functions"), F.lit(" functions across "), s("n_test_files"), F.lit(" files")).alias("line")),
        "entry points": _listed(entry_points(files, symbols), [F.col("file_path")], F.concat(F.lit("  "), "file_path", F.lit(" ("), "kind", F.lit(")"))),
        "key types": one.where("key_types <> ''").select(F.lit(1).alias("nth"), F.concat(F.lit("  "), F.replace("key_types", F.lit(","), F.lit(", "))).alias("line")),
        "modules": _listed(modules, [F.desc("n_files"), F.col("module")], F.concat(F.lit("  "), "module", F.lit("/ \u2014 "), s("n_files"), F.lit(" files, "), s("n_functions"), F.lit(" functions"))),
    }
    out = None
    for section, rows in lines.items():
        rows = rows.select(F.lit(section).alias("section"), F.col("nth").cast("int").alias("nth"), "line")
        out = rows if out is None else out.unionByName(rows)
    return out
