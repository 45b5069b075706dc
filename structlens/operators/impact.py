"""What a change touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def risk_score(direct: Column, transitive: Column, tests: Column) -> Column:
    return F.least(F.lit(1.0), (direct * 2.0 + transitive * 0.5 + tests) / F.lit(10.0))


def blast_radius(targets: DataFrame, symbols: DataFrame) -> DataFrame:
    """For each target (symbol, file_path): dependents are files elsewhere with a symbol whose name holds the target's, in any case.

    Distinct names and targets meet by an equi join on the target's first (up to three) characters, which any name that
    holds it has among its own runs of characters; only those pairs are compared as texts.
    """
    t = targets.select("symbol", F.col("file_path").alias("def_file")).distinct()
    names = symbols.select("name").distinct()
    words = t.select("symbol").distinct()
    low = F.lower("name")
    cut = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - k + 1, F.lit(1))), lambda i: F.substring(low, i, F.lit(k)))
    runs = F.array_distinct(F.concat(cut(1), cut(2), cut(3)))
    names = names.withColumn("run", F.explode(runs))
    words = words.withColumn("start", F.left(F.lower("symbol"), F.lit(3)))
    held = names.join(words, F.col("run") == F.col("start")).where(F.contains(low, F.lower("symbol"))).select("name", "symbol").distinct()
    met = t.join(held, "symbol").join(symbols.select("name", "file_path"), "name").where("file_path <> def_file")
    per = met.select("symbol", "def_file", "file_path").distinct().withColumn("is_test", text.is_test_path(F.col("file_path")))
    counts = per.groupBy("symbol", "def_file").agg(F.count(F.lit(1)).alias("direct"), F.count_if("is_test").alias("tests"))
    out = t.join(counts, ["symbol", "def_file"], "left").select("symbol", F.col("def_file").alias("file_path"), F.coalesce("direct", F.lit(0)).alias("direct"), F.coalesce("tests", F.lit(0)).alias("tests"))
    return out.withColumn("risk", risk_score(F.col("direct"), F.lit(0), F.col("tests")))


def analyze_impact(targets: DataFrame, references: DataFrame, callers: DataFrame, callees: DataFrame, *, cross_file: bool = True) -> DataFrame:
    """target, n_references, n_files, n_callers, n_callees, risk, factors, confidence.

    ``targets`` has target, n_same (symbols of the same qualified name elsewhere) and n_ambiguous (of the same name
    only); ``references`` has target and file_path, one row a reference; ``callers`` target and caller, ``callees`` target and
    callee. ``cross_file`` tells whether references from other files could be found.
    """
    names_test = lambda c: F.max(F.contains(c, F.lit("test")).cast("int"))
    r = references.groupBy("target").agg(F.count(F.lit(1)).alias("n_references"), F.countDistinct("file_path").alias("n_files"), names_test("file_path").alias("t1"))
    c = callers.groupBy("target").agg(F.countDistinct("caller").alias("n_callers"), names_test("caller").alias("t2"))
    a = callees.groupBy("target").agg(F.countDistinct("callee").alias("n_callees"))
    out = targets.join(r, "target", "left").join(c, "target", "left").join(a, "target", "left").na.fill(0)
    files, refs = F.col("n_files"), F.col("n_references")
    risk = F.when((files == 0) | ((files <= 1) & (refs <= 2)), "low").when((files <= 3) & (refs <= 6), "medium").otherwise("high")
    # The texts of the risk factors, in order.
    factors = [
        (files > 1, "cross-file references"),
        (refs > 5, "many references"),
        (F.col("n_callers") > 0, "has local callers"),
        (F.col("n_callees") > 0, "has downstream local callees"),
        (F.greatest("t1", "t2") == 1, "touches tests"),
        (F.col("n_same") > 0, "same scoped symbol elsewhere in project"),
        (F.lit(not cross_file), "cross-file references unavailable in backend"),
        (F.col("n_ambiguous") > 0, "same-name symbols elsewhere in project"),
        (F.col("n_ambiguous") > 0, "related symbol matching is name-based"),
    ]
    listed = F.array_join(F.array_compact(F.array(*[F.when(when, what) for when, what in factors])), ",")
    guess = F.lit(not cross_file) | (F.col("n_same") > 0) | (F.col("n_ambiguous") > 0)
    return out.select("target", "n_references", "n_files", "n_callers", "n_callees", risk.alias("risk"), listed.alias("factors"), F.when(guess, "heuristic").otherwise("strong").alias("confidence"))
