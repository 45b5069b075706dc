"""Source trees and texts as DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed, text

MAX_BYTES = 10 * 1024 * 1024


def languages(spark: SparkSession) -> DataFrame:
    """ext, language, has_patterns, display_name: a dimension of fewer than a hundred rows."""
    rows = [(e, lang, lang in fixed.PATTERN_LANGUAGES, fixed.DISPLAY_NAMES[lang]) for lang, exts in fixed.EXTENSIONS.items() for e in exts]
    return spark.createDataFrame(rows, "ext string, language string, has_patterns boolean, display_name string")


def aliases(spark: SparkSession) -> DataFrame:
    rows = [(n, n) for n in fixed.EXTENSIONS] + list(fixed.ALIASES.items())
    return spark.createDataFrame(rows, "alias string, language string")


def ignore_rules(text_of_file: str, folder: str = "") -> list[tuple[bool, str]]:
    """(ignored, pattern over relative paths) of the lines of an ignore file that lies in ``folder``, in order: the last that matches decides."""
    rules = []
    for line in text_of_file.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        ignored, glob = not line.startswith("!"), line.removeprefix("!").removeprefix("\\")
        only_folders, rooted = glob.endswith("/"), "/" in glob.strip("/") or glob.startswith("/")
        parts = re.split(r"(\*\*/|/\*\*|\*|\?|\[[^\]]*\])", glob.strip("/"))
        meaning = {"**/": "(?:.*/)?", "/**": "/.*", "*": "[^/]*", "?": "[^/]"}
        body = "".join(meaning.get(x) or (x.replace("[!", "[^") if x.startswith("[") else re.escape(x)) for x in parts if x)
        base = re.escape(folder.strip("/") + "/") if folder.strip("/") else ""
        rules.append((ignored, f"^{base}{'' if rooted else '(?:.*/)?'}{body}{'/' if only_folders else '(?:/|$)'}"))
    return rules


def scan_files(spark: SparkSession, root: str, *, ignore: list[str] = (), gitignore: bool = True, max_bytes: int = MAX_BYTES) -> DataFrame:
    """file_path, ext, language, has_patterns, size_bytes, mtime, source, error of every readable source file below ``root``.

    Only names with a known extension are listed at all, and of files over ``max_bytes`` only the size is read (null source and an error).
    Hidden files and folders, what the ``.gitignore`` files say and paths that match one of the ``ignore`` patterns (regular expressions over
    the relative path) are left out. Paths are unique, as they come from one listing.
    """
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^[a-z]+:/*", "/")
    path = F.regexp_replace("path", "^[a-z]+:/*", "/")
    rel = F.when(F.startswith(path, F.concat(base, F.lit("/"))), F.substring(path, F.length(base) + 2, F.length(path))).otherwise(path)
    keep = ~rel.rlike(r"(^|/)\.")
    for pattern in ignore:
        keep = keep & ~rel.rlike(pattern)
    ignored = F.lit(False)
    for out, pattern in _ignore_files(spark, root) if gitignore else []:
        ignored = F.when(rel.rlike(pattern), F.lit(out)).otherwise(ignored)
    names = "*.{" + ",".join(e for exts in fixed.EXTENSIONS.values() for e in exts) + "}"
    meta = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names).load(root)
    facts = [rel.alias("file_path"), text.extension(rel).alias("ext"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime")]
    # the limit on the length reaches the reader, so that no long file is read
    small = meta.where(F.col("length") <= max_bytes).where(keep & ~ignored).select(*facts, "content")
    large = meta.where(F.col("length") > max_bytes).where(keep & ~ignored).select(*facts, F.lit(None).cast("binary").alias("content"))
    files = small.unionByName(large).join(F.broadcast(languages(spark)), "ext")
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    problem = F.when(F.col("content").isNull(), "too large").when(~valid, "not UTF-8")
    return files.select("file_path", "ext", "language", "has_patterns", "size_bytes", "mtime", F.when(valid, F.decode("content", "UTF-8")).alias("source"), problem.alias("error"))


def _ignore_files(spark: SparkSession, root: str) -> list[tuple[bool, str]]:
    """The rules of all .gitignore files below a folder, outer ones first. Spark's listing leaves out names that begin with a dot, so they are
    listed through the file system; there are as many as a project has, and they are short."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(root)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    top, found = system.getFileStatus(where).getPath().toString().rstrip("/"), []
    for status in system.globStatus(jvm.org.apache.hadoop.fs.Path(where, "{.gitignore,*/.gitignore,*/*/.gitignore,*/*/*/.gitignore}")) or []:
        stream = system.open(status.getPath())
        try:
            data = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()
        folder = status.getPath().getParent().toString().removeprefix(top).strip("/")
        found.append((folder.count("/") + bool(folder), folder, data.decode("utf-8", "replace")))
    return [rule for _, folder, data in sorted(found) for rule in ignore_rules(data, folder)]


def scan_counters(files: DataFrame, samples: int = 5) -> DataFrame:
    """One row: supported and failed files of a scan, and the first failures by path."""
    failed = F.col("error").isNotNull()
    first = files.where(failed).select("file_path", "error").orderBy("file_path").limit(samples)
    listed = first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file_path", "error"))), lambda x: F.concat(x["file_path"], F.lit(": "), x["error"])), "\n").alias("failures"))
    return files.agg(F.count(F.lit(1)).alias("supported"), F.count_if(failed).alias("failed")).crossJoin(listed)


def summary_scan(files: DataFrame) -> DataFrame:
    """Adds surface and analysed to (file_path, has_patterns, source): a summary classifies every path, and reads the symbols of source files of languages
    with patterns that aren't too long."""
    short = text.line_count(F.coalesce("source", F.lit(""))) <= fixed.SUMMARY_LINES
    return files.withColumns({"surface": text.surface(F.col("file_path")), "analysed": F.coalesce("has_patterns", F.lit(False)) & F.col("source").isNotNull() & short})


def nested_repositories(paths: DataFrame, column: str = "path") -> DataFrame:
    """First-level folders that hold a ``.git`` of their own."""
    first = F.regexp_extract(column, r"^([^/]+)/\.git(?:/|$)", 1)
    return paths.select(first.alias("repo")).where("repo <> ''").distinct()


def explode_lines(files: DataFrame, *, path: str = "file_path", source: str | Column = "source") -> DataFrame:
    """file_path, line_no (from 0), text; no line after a final line feed, no carriage return at the end of a line."""
    parts = F.split(F.col(source) if isinstance(source, str) else source, "\n")
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    rows = files.select(F.col(path).alias("file_path"), F.posexplode(parts).alias("line_no", "text"))
    return rows.withColumn("text", F.regexp_replace("text", "\r$", ""))


def with_language(files: DataFrame, spark: SparkSession, path: str = "file_path") -> DataFrame:
    """Adds ext and language (null if unknown; extensions are case-sensitive)."""
    known = languages(spark).select("ext", "language")
    return files.withColumn("ext", text.extension(F.col(path))).join(F.broadcast(known), "ext", "left")


def resolve_alias(names: DataFrame, spark: SparkSession, column: str = "name") -> DataFrame:
    known = aliases(spark)
    return names.join(F.broadcast(known), F.lower(names[column]) == known["alias"], "left").drop("alias")


def detect_roots(files: DataFrame, present: DataFrame, spark: SparkSession, *, stop_at: str = "") -> DataFrame:
    """file_path, language, root. ``present`` lists existing paths; a ``workspace`` flag tells manifests that declare a workspace.

    Folders above a file are walked up to ``stop_at``. For Rust the topmost workspace counts, else the nearest manifest; for Go the
    nearest go.work, else the nearest go.mod; for JavaScript and TypeScript the nearest marker in a folder without deno.json; for others the nearest
    marker. Without any it is the nearest folder with a ``.git``, else ``stop_at``. Roots are looked up once for a folder and language; neither
    those folders nor the markers are broadcast by the planner's guess, which doesn't know how many folders are above a file.
    """
    folder = lambda p: F.regexp_replace(p, r"/?[^/]*$", "")
    placed = files.select("file_path", "language", folder(F.col("file_path")).alias("folder"))
    parts = F.split("folder", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    top = stop_at.strip("/")
    inside = F.filter(F.array_distinct(up), lambda d: (F.lit(top) == "") | (d == top) | F.startswith(d, F.lit(top + "/")))
    own = placed.select("folder", "language").distinct().select("folder", "language", F.explode(inside).alias("dir"))
    # the lower the rank, the sooner a marker decides
    ranks = {"rust": {"Cargo.toml": 1}, "go": {"go.work": 0, "go.mod": 1}}
    markers = [(lang, m, ranks.get(lang, {}).get(m, 1)) for lang, ms in fixed.ROOT_MARKERS.items() for m in (ranks.get(lang) or ms)]
    marks = spark.createDataFrame(markers, "m_language string, marker string, rank int")
    known = present if "workspace" in present.columns else present.withColumn("workspace", F.lit(False))
    there = known.select(folder(F.col("path")).alias("p_dir"), text.file_name(F.col("path")).alias("p_name"), F.coalesce("workspace", F.lit(False)).alias("workspace"))
    # a name is met as it is and as "*.extension"
    named = there.withColumn("p_mark", F.explode(F.array_distinct(F.array(F.col("p_name"), F.concat(F.lit("*."), F.substring_index("p_name", ".", -1))))))
    found = named.join(F.broadcast(marks), F.col("p_mark") == F.col("marker"))
    deno = there.where(F.col("p_name").isin("deno.json", "deno.jsonc")).select(F.col("p_dir").alias("d_dir")).distinct()
    found = found.join(deno, found["p_dir"] == deno["d_dir"], "left").where(F.col("d_dir").isNull() | ~F.col("m_language").isin("javascript", "typescript"))
    rank = F.when((F.col("m_language") == "rust") & F.col("workspace"), 0).otherwise(F.col("rank"))
    found = found.groupBy("p_dir", "m_language").agg(F.min(rank).alias("rank"))
    # a .git is for every language, and decides last
    git = there.where("p_name = '.git'").select("p_dir").distinct().select("p_dir", F.lit(None).cast("string").alias("m_language"), F.lit(2).alias("rank"))
    found = found.unionByName(git).hint("merge")
    met = own.join(found, (own["dir"] == found["p_dir"]) & (found["m_language"].isNull() | (own["language"] == found["m_language"])))
    depth = F.length("dir")
    # of workspaces the topmost, of all else the nearest
    order = F.struct("rank", F.when((F.col("language") == "rust") & (F.col("rank") == 0), depth).otherwise(-depth))
    pick = met.groupBy(F.col("folder").alias("r_folder"), F.col("language").alias("r_language")).agg(F.min_by("dir", order).alias("root"))
    out = placed.join(pick, (placed["folder"] == pick["r_folder"]) & placed["language"].eqNullSafe(pick["r_language"]), "left")
    return out.select("file_path", "language", F.coalesce("root", F.lit(stop_at)).alias("root"))


def diff_lines(diffs: DataFrame, *, key: str = "diff_id", diff: str = "diff") -> DataFrame:
    """key, file_path, line_no (from 0) of every line that a unified diff adds or changes; hunks that only delete have none."""
    rows = diffs.select(key, F.posexplode(F.split(diff, "\n")).alias("at", "text"))
    file = F.when(F.col("text").startswith("+++ b/"), F.substring("text", 7, 1 << 20))
    w = W.partitionBy(key).orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    hunk = r"^@@ -\S+ \+(\d+)(?:,(\d+))? @@"
    rows = rows.withColumn("file_path", F.last(file, ignorenulls=True).over(w)).where(F.col("text").rlike(hunk) & F.col("file_path").isNotNull())
    start, n = F.regexp_extract("text", hunk, 1).cast("int"), F.regexp_extract("text", hunk, 2)
    rows = rows.withColumn("first", start - 1).withColumn("n", F.when(n == "", 1).otherwise(F.expr("try_cast(regexp_extract(text, '^@@ -\\\\S+ \\\\+(\\\\d+)(?:,(\\\\d+))? @@', 2) AS INT)")))
    return rows.where("n > 0").select(key, "file_path", F.explode(F.sequence(F.greatest("first", F.lit(0)), F.greatest("first", F.lit(0)) + F.col("n") - 1)).alias("line_no"))


def diff_stat(lines: DataFrame, column: str = "text") -> DataFrame:
    """file_path, changes (+plus/-minus marks of the histogram) of every line of a diff statistic."""
    name, marks = F.trim(F.substring_index(column, "|", 1)), F.substring_index(column, "|", -1)
    out = lines.where(F.col(column).contains("|"))
    return out.withColumn("file_path", name).withColumn("changes", F.concat(F.lit("+"), text.count_of(marks, "+").cast("string"), F.lit("/-"), text.count_of(marks, "-").cast("string")))
