"""Tables of TOML texts as symbols and regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import trim


def toml_regions(lines: DataFrame) -> DataFrame:
    """file_path, name, region_id, line, line_end (both from 1): a table reaches to the line before the next header."""
    w = W.partitionBy("file_path")
    rows = lines.withColumn("last", F.max("line_no").over(w))
    t = trim(F.col("text"))
    name = trim(F.regexp_extract(t, r"^\[+([^\[\]]+)\]+$", 1))
    heads = rows.withColumn("name", name).where("name <> ''")
    end = F.coalesce(F.lead("line_no").over(w.orderBy("line_no")), F.col("last") + 1)
    return heads.select("file_path", "name", F.concat(F.lit("table:"), "name").alias("region_id"), (F.col("line_no") + 1).alias("line"), end.alias("line_end"))
