"""Layered configuration as joins."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed


def load_toml(spark: SparkSession, path: str) -> DataFrame:
    """language, binary, args, enabled of the ``languages`` tables of a TOML text, read through Spark."""
    text = "".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    rows = [(k, v.get("server_binary"), v.get("server_args"), v.get("enabled")) for k, v in tomllib.loads(text).get("languages", {}).items()]
    return spark.createDataFrame(rows, "language string, binary string, args array<string>, enabled boolean")


def overlay(base: DataFrame, over: DataFrame, key: str) -> DataFrame:
    """Field by field, ``over`` where it has a value, else ``base``; rows of either side stay."""
    o = over.select(F.col(key).alias("o_key"), *[F.col(c).alias(f"o_{c}") for c in over.columns if c != key])
    both = base.join(o, base[key] == o["o_key"], "full_outer")
    return both.select(F.coalesce(key, "o_key").alias(key), *[F.coalesce(f"o_{c}", c).alias(c) for c in base.columns if c != key])


def servers(defaults: DataFrame, overrides: DataFrame) -> DataFrame:
    """The server of each language; a language that is switched off has none."""
    both = overlay(defaults, overrides, "language")
    return both.withColumn("binary", F.when(F.coalesce("enabled", F.lit(True)), F.col("binary")))


def plugin_for(files: DataFrame, plugins: DataFrame) -> DataFrame:
    """Adds plugin to files with ext: of the plugins (plugin, place, extensions) that know it, the first registered."""
    known = plugins.select("plugin", "place", F.explode("extensions").alias("p_ext")).groupBy("p_ext").agg(F.min_by("plugin", "place").alias("plugin"))
    return files.join(known, files["ext"] == known["p_ext"], "left").drop("p_ext")


def language_status(spark: SparkSession, servers: DataFrame, installed: DataFrame) -> DataFrame:
    """language, has_patterns, binary, available for every language; ``installed`` lists binaries."""
    known = spark.createDataFrame([(x, x in fixed.PATTERN_LANGUAGES) for x in fixed.EXTENSIONS], "language string, has_patterns boolean")
    there = installed.select(F.col("binary").alias("i_binary")).distinct()
    out = known.join(servers.select("language", "binary"), "language", "left")
    return out.join(there, out["binary"] == there["i_binary"], "left").select("language", "has_patterns", "binary", F.col("i_binary").isNotNull().alias("available"))


def languages_by_binary(servers: DataFrame) -> DataFrame:
    """binary and its languages, sorted, as one text."""
    return servers.where("binary IS NOT NULL").groupBy("binary").agg(F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"))
