"""Joining lines with spans of lines, without comparing every line of a file with every span of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines of a bucket: a span is one row for each bucket that it reaches into.
BUCKET = 256


def meet(points: DataFrame, spans: DataFrame, *, path: str, line: str, span_path: str, start: str, end: str, how: str = "inner") -> DataFrame:
    """``points`` joined with the ``spans`` of the same file that hold their line.

    File and bucket are the equi keys, so a long file is many small joins and a line only meets spans that reach its neighbourhood.
    ``how`` is inner or left (points without a span stay).
    """
    cut = spans.withColumn("span_bucket", F.explode(F.sequence(F.floor(F.col(start) / BUCKET), F.floor(F.greatest(F.col(end), F.col(start)) / BUCKET))))
    own = points.withColumn("point_bucket", F.floor(F.col(line) / BUCKET))
    on = (own[path] == cut[span_path]) & (own["point_bucket"] == cut["span_bucket"]) & own[line].between(cut[start], cut[end])
    return own.join(cut, on, how).drop("point_bucket", "span_bucket")
