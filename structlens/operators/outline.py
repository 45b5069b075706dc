"""Outlines of texts without a grammar: indentation, brackets, declaration words and variety of characters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from .ordered import first_at_most, group_starts, in_file_order, whole_groups

def bracket_depths(lines: DataFrame) -> DataFrame:
    """Adds opens, closes, depth_in and depth_out: the running bracket depth, which never goes below zero.

    The clamped sum is the plain one less its running minimum: two windows over one sort.
    """
    t = text.trim(F.col("text"))
    out = lines.withColumns({"t": t, "opens": text.chars_of(t, "{[("), "closes": text.chars_of(t, "}])")})
    w = W.partitionBy("file_path").orderBy("line_no")
    run = w.rowsBetween(W.unboundedPreceding, 0)
    out = out.withColumn("s", F.sum(F.col("opens") - F.col("closes")).over(run))
    out = out.withColumn("depth_out", (F.col("s") - F.least(F.lit(0), F.min("s").over(run))).cast("int"))
    return out.withColumn("depth_in", F.lag("depth_out", 1, 0).over(w)).drop("s")


def effective_depths(lines: DataFrame) -> DataFrame:
    """Adds indent and depth: indentation plus the bracket depth without the closers that lead the line."""
    out = bracket_depths(lines)
    lead = F.length(F.regexp_extract("t", r"^([})\]]*)", 1))
    return out.withColumn("indent", text.indent_depth(F.col("text"))).withColumn("depth", (F.col("indent") + F.greatest(F.col("depth_in") - lead, F.lit(0))).cast("int"))


def structural_lines(lines: DataFrame) -> DataFrame:
    """Lines with depth and the flag ``structural``."""
    out = effective_depths(lines)
    plain = (F.col("t") != "") & ~text.is_comment(F.col("t"))
    return out.withColumn("structural", plain & text.is_structural(F.col("t"), F.col("indent"), F.col("depth")))


def region_ends(regions: DataFrame) -> DataFrame:
    """Adds line_end to (file_path, line_no, depth, last_line, ...): the line before the next region that is not deeper."""

    def work(batches):
        for table in whole_groups(batches):
            starts = [*group_starts(table.column("file_path")).tolist(), table.num_rows]
            line, depth, last = (table.column(c).to_numpy() for c in ("line_no", "depth", "last_line"))
            end = last.copy()
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                own = depth[a:b].tolist()
                stop = np.asarray(first_at_most(own, own))
                inner = np.flatnonzero(stop >= 0)
                end[a + inner] = line[a + stop[inner]] - 1
            yield from table.append_column("line_end", pa.array(np.maximum(end, line).astype(np.int32))).to_batches()

    return in_file_order(regions, "line_no").mapInArrow(work, T.StructType([*regions.schema.fields, T.StructField("line_end", T.IntegerType())]))


def outline(lines: DataFrame, *, hashed: bool = True) -> DataFrame:
    """file_path, region_id, line, line_end (from 1), depth, label.

    A file without any structural line is one region from its first line that isn't blank. Region ids are
    ``h-<FNV-1a of the line>-<line>`` or, with ``hashed=False``, ``region-<line>``.
    """
    rows = structural_lines(lines)
    per = W.partitionBy("file_path")
    rows = rows.withColumn("last_line", F.max("line_no").over(per)).withColumn("any", F.max(F.col("structural").cast("int")).over(per))
    first = F.min(F.when(F.col("t") != "", F.col("line_no"))).over(per)
    rows = rows.withColumn("lone", (F.col("any") == 0) & (F.col("line_no") == first))
    rows = rows.where(F.col("structural") | F.col("lone")).withColumn("depth", F.when(F.col("lone"), 0).otherwise(F.col("depth")))
    rows = region_ends(rows.select("file_path", "line_no", "depth", "last_line", "t"))
    line = F.col("line_no") + 1
    ident = F.concat(F.lit("h-"), text.hex16(text.fnv1a(F.col("t"))), F.lit("-"), line.cast("string")) if hashed else F.concat(F.lit("region-"), line.cast("string"))
    return rows.select("file_path", ident.alias("region_id"), line.alias("line"), (F.col("line_end") + 1).alias("line_end"), "depth", text.compact_label(F.col("t")).alias("label"))


def region_text(files: DataFrame, regions: DataFrame, *, path: str = "file_path", source: str = "source") -> DataFrame:
    """file_path, region_id, body: the lines of a region with their ends."""
    parts = F.split(F.col(source), "\n")
    body = F.array_join(F.slice(parts, F.col("line"), F.col("line_end") - F.col("line") + 1), "\n")
    ended = F.when(F.col("line_end") < F.size(parts), F.concat(body, F.lit("\n"))).otherwise(body)
    src = files.select(F.col(path).alias("s_path"), F.col(source))
    return regions.join(src, regions["file_path"] == src["s_path"]).select("file_path", "region_id", ended.alias("body"))


def outline_symbols(regions: DataFrame, backend: str = "heuristic") -> DataFrame:
    """Regions as symbols of kind Module, lines from 0."""
    return regions.select("file_path", F.col("label").alias("name"), F.lit("Module").alias("kind"), (F.col("line") - 1).alias("line_start"), (F.col("line_end") - 1).alias("line_end"), F.concat("region_id", F.lit(f" [{backend}]")).alias("signature"))
