"""The code graph: building, merging, shortening and walking it."""

from __future__ import annotations

import itertools
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed, text


def build_nodes(symbols: DataFrame, project: str) -> DataFrame:
    """One node a file and one a symbol: project, name, labels, description, file_path, line_start, line_end."""
    ident = F.concat("file_path", F.lit("::"), "qualified_name")
    own = symbols.select(F.lit(project).alias("project"), ident.alias("name"), text.labels(F.col("kind"), F.col("signature")).alias("labels"), text.description(F.col("signature"), F.col("doc_comment")).alias("description"), "file_path", "line_start", "line_end")
    files = symbols.select("file_path").distinct()
    files = files.select(F.lit(project).alias("project"), F.col("file_path").alias("name"), F.array(F.lit("file")).alias("labels"), F.col("file_path").alias("description"), "file_path", F.lit(None).cast("int").alias("line_start"), F.lit(None).cast("int").alias("line_end"))
    return files.unionByName(own)


def build_edges(symbols: DataFrame, project: str) -> DataFrame:
    """``contains`` from the parent (or file) to each symbol, ``imports`` from the file to each import."""
    ident = F.concat("file_path", F.lit("::"), "qualified_name")
    rows = symbols.select("file_path", "seq", "parent_seq", "kind", ident.alias("name"))
    parents = rows.select(F.col("file_path").alias("p_path"), F.col("seq").alias("p_seq"), F.col("name").alias("p_name"))
    met = rows.join(parents, (rows["file_path"] == parents["p_path"]) & (rows["parent_seq"] == parents["p_seq"]), "left")
    relation = F.when((F.col("kind") == "Import"), F.array(F.lit("contains"), F.lit("imports"))).otherwise(F.array(F.lit("contains")))
    source = F.when(F.col("relation") == "imports", F.col("file_path")).otherwise(F.coalesce("p_name", "file_path"))
    weight = F.when(F.col("relation") == "imports", F.lit(fixed.WEIGHTS["imports"])).otherwise(F.lit(fixed.WEIGHTS["contains"]))
    return met.withColumn("relation", F.explode(relation)).select(F.lit(project).alias("project"), source.alias("source"), F.col("name").alias("target"), "relation", weight.alias("weight"))


def merge_nodes(graphs: DataFrame) -> DataFrame:
    """The first node of each name, by (graph_no, node_no)."""
    w = W.partitionBy("name").orderBy("graph_no", "node_no")
    return graphs.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def retain_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are both known; repeated edges stay."""
    known = nodes.select("name").distinct()
    out = edges.join(known.withColumnRenamed("name", "source"), "source", "left_semi")
    return out.join(known.withColumnRenamed("name", "target"), "target", "left_semi")


def skeletonize(nodes: DataFrame) -> DataFrame:
    """Descriptions cut to their first line that isn't blank."""
    return nodes.withColumn("description", text.skeleton(F.col("description")))


def reachable(edges: DataFrame, seeds: DataFrame, *, most_steps: int | None = None) -> DataFrame:
    """seed, node, distance: everything that depends on a seed over edges (source depends on target), by a frontier search.

    Each step joins the frontier with the edges, drops what earlier steps found and appends its own part to the shared folder, so
    lineage stays short, nothing is written twice and a lost executor costs one step. The search ends when nothing new is found; with
    ``most_steps`` it raises if there is more beyond them.
    """
    spark = edges.sparkSession
    path = f"{shared_folder(spark)}/structlens/reach-{uuid.uuid4().hex}"
    back = edges.select(F.col("target").alias("at"), F.col("source").alias("next")).distinct().persist(StorageLevel.DISK_ONLY)

    def part(df: DataFrame, step: int) -> DataFrame:
        df.write.parquet(f"{path}/part={step}")
        return spark.read.schema(df.schema).parquet(f"{path}/part={step}")

    frontier = part(seeds.select(F.col("seed"), F.col("seed").alias("node"), F.lit(0).alias("distance")).distinct(), 0)
    schema = frontier.schema
    for step in itertools.count(1):
        visited = spark.read.schema(schema).parquet(*[f"{path}/part={i}" for i in range(step)])
        found = frontier.join(back, frontier["node"] == back["at"]).select("seed", F.col("next").alias("node")).distinct()
        frontier = part(found.join(visited.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("distance", F.lit(step)), step)
        if not frontier.take(1):
            break
        if most_steps is not None and step > most_steps:
            raise RuntimeError(f"nodes more than {most_steps} steps away")
    back.unpersist()
    return visited


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only on a local master that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return "file://" + tempfile.mkdtemp(prefix="structlens-")
