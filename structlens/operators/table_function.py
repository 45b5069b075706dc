"""Extraction as a table function of SQL.

    SELECT * FROM extract_symbols(TABLE(lines) PARTITION BY (file_path) ORDER BY (line_no), 'outline')
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..session import ship
from .statements import File
from .symbols import PATTERNS, Patterns, numbered

_INT = {"line_start", "line_end", "column_start", "column_end", "seq", "depth", "parent_seq"}
_ALL = ["file_path", "language", "line_start", "line_end", "column_start", "column_end", "kind", "name", "signature", "doc_comment", "scope_path", "seq", "depth", "parent_seq"]
#: How much of a symbol a call asks for.
DETAILS = {"full": _ALL, "outline": ["file_path", "name", "kind", "line_start", "line_end", "signature"]}


class ExtractSymbols:
    """One file a partition: its lines in order, then its symbols. Columns of the result follow from the second argument."""

    def __init__(self):
        self.path, self.language, self.lines, self.detail = None, None, [], "full"

    @staticmethod
    def analyze(lines: AnalyzeArgument, detail: AnalyzeArgument | None = None) -> AnalyzeResult:
        have = {f.name for f in lines.dataType.fields} if lines.isTable else set()
        if missing := {"file_path", "language", "text"} - have:
            raise ValueError(f"extract_symbols needs a table with the columns {', '.join(sorted(missing))}")
        wanted = detail.value if detail is not None else "full"
        if wanted not in DETAILS:
            raise ValueError(f"detail is one of {', '.join(DETAILS)}")
        kind = lambda c: IntegerType() if c in _INT else ArrayType(StringType()) if c == "scope_path" else StringType()
        return AnalyzeResult(StructType([StructField(c, kind(c)) for c in DETAILS[wanted]]))

    def eval(self, row, detail: str = "full"):
        self.path, self.language, self.detail = row["file_path"], row["language"], detail
        self.lines.append(row["text"] or "")

    def terminate(self):
        if self.lines:
            at = [_ALL.index(c) for c in DETAILS[self.detail]]
            for found in numbered(self.path, File("\n".join(self.lines), self.language), Patterns(self.language, PATTERNS)):
                yield tuple(found[k] for k in at)


def register(spark: SparkSession, name: str = "extract_symbols") -> None:
    """Make the function known to SQL."""
    ship(spark)
    spark.udtf.register(name, udtf(ExtractSymbols))
