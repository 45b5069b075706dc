"""Which worktree a project lies in, by joins over a listing of git's files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text


def worktrees(roots: DataFrame, listing: DataFrame) -> DataFrame:
    """root, git_dir, head, worktree_id, scope of every project root.

    ``listing`` has path, is_dir and content of the ``.git`` markers and ``HEAD`` files. The nearest marker at a root or above counts: a folder is the
    git folder itself, a file names it after ``gitdir:`` (linked worktrees, submodules), absolute or from where the file lies. A marker that names
    nothing, or whose folder has no ``HEAD``, leaves everything but the scope null, and the scope is then that of the root alone.
    """
    parts = F.split("root", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    above = roots.select("root", F.explode(F.array_distinct(up)).alias("folder"))
    marks = listing.where("path RLIKE '(^|/)[.]git$'").select(F.regexp_replace("path", r"/?\.git$", "").alias("m_folder"), F.col("path").alias("m_path"), "is_dir", "content")
    met = above.join(marks, above["folder"] == marks["m_folder"])
    nearest = met.groupBy("root").agg(F.max_by(F.struct("m_folder", "m_path", "is_dir", "content"), F.length("folder")).alias("m"))
    named = F.trim(F.regexp_extract("m.content", r"(?s)^gitdir:(.*)$", 1), F.lit(" \t\r\n"))
    target = F.when(F.col("m.is_dir"), F.col("m.m_path")).when(named.startswith("/"), named).when(named != "", F.concat("m.m_folder", F.lit("/"), named))
    found = nearest.select(F.col("root").alias("n_root"), text.normal_path(target).alias("git_dir"))
    heads = listing.where("path LIKE '%/HEAD'").select(F.regexp_replace("path", "/HEAD$", "").alias("h_dir"), F.col("content").alias("head"))
    known = found.join(heads, found["git_dir"] == heads["h_dir"]).drop("h_dir")
    return roots.join(known, roots["root"] == known["n_root"], "left").select("root", "git_dir", "head", text.worktree_id(F.col("git_dir")).alias("worktree_id"), text.cache_scope(F.col("root"), F.col("git_dir"), F.col("head")).alias("scope"))
