"""Extractors behind one interface, and which of them serves a file."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..sources import toml
from . import outline, read, relate, symbols

#: What every extractor returns.
COLUMNS = ["file_path", "name", "kind", "line_start", "line_end", "signature"]


class Extractor(Protocol):
    """Names what it takes, by file_path, ext and language, and finds the symbols of lines (file_path, language, line_no, text)."""

    name: str

    def takes(self) -> Column: ...

    def symbols(self, lines: DataFrame) -> DataFrame: ...


class Patterns:
    """Languages with line patterns of their own."""

    name = "patterns"

    def takes(self) -> Column:
        return F.coalesce(F.col("language").isin(fixed.PATTERN_LANGUAGES), F.lit(False))

    def symbols(self, lines: DataFrame) -> DataFrame:
        return symbols.extract_symbols(lines).select(COLUMNS)


class Toml:
    """Tables of TOML files."""

    name = "toml"

    def takes(self) -> Column:
        return F.col("ext") == "toml"

    def symbols(self, lines: DataFrame) -> DataFrame:
        found = toml.toml_regions(lines)
        return found.select("file_path", "name", F.lit("Module").alias("kind"), (F.col("line") - 1).alias("line_start"), (F.col("line_end") - 1).alias("line_end"), F.col("region_id").alias("signature"))


class Heuristic:
    """Anything: regions by indentation and brackets."""

    name = "heuristic"

    def takes(self) -> Column:
        return F.lit(True)

    def symbols(self, lines: DataFrame) -> DataFrame:
        return outline.outline_symbols(outline.outline(lines)).select(COLUMNS)


REGISTRY: tuple[Extractor, ...] = (Patterns(), Toml(), Heuristic())


def backend(registry: Sequence[Extractor] = REGISTRY) -> Column:
    """The first extractor in order that takes a file with ext and language; null if none does."""
    out = F.lit(None).cast("string")
    for x in reversed(registry):
        out = F.when(x.takes(), x.name).otherwise(out)
    return out


def dispatch(lines: DataFrame, registry: Sequence[Extractor] = REGISTRY) -> DataFrame:
    """file_path, name, kind, line_start, line_end, signature, backend of lines (file_path, ext, language, line_no, text): each file goes
    to the first extractor that takes it, in one plan."""
    known = lines.withColumn("backend", backend(registry))
    out = None
    for x in registry:
        own = x.symbols(known.where(F.col("backend") == x.name).drop("backend", "ext")).select(*COLUMNS).withColumn("backend", F.lit(x.name))
        out = own if out is None else out.unionByName(own)
    return out


class Analysis:
    """All questions of the interface over lines (file_path, ext, language, line_no, text) of any number of files."""

    def __init__(self, lines: DataFrame, registry: Sequence[Extractor] = REGISTRY):
        self.lines, self.registry = lines, registry
        self.full = symbols.extract_symbols(lines.where(Patterns().takes()))

    def symbols(self) -> DataFrame:
        """By the extractor that serves each file."""
        return dispatch(self.lines, self.registry)

    def definition(self, name: str) -> DataFrame:
        """The first symbol of that name in each file."""
        own = self.full.where(F.col("name") == name)
        return own.groupBy("file_path").agg(F.min_by(F.struct("name", "kind", "line_start", "line_end", "signature"), "seq").alias("x")).select("file_path", "x.*")

    def references(self, positions: DataFrame) -> DataFrame:
        """file_path, target, line_no, col: the places in code of the identifier at each position (file_path, line, column in bytes)."""
        at = self.lines.select(F.col("file_path").alias("l_path"), "line_no", "text")
        met = positions.join(at, (positions["file_path"] == at["l_path"]) & (positions["line"] == at["line_no"]))
        named = met.select("file_path", text.identifier_at(F.col("text"), F.col("column")).alias("text")).where("text IS NOT NULL").distinct()
        return relate.find_references(named, self.lines.select("file_path", "language", "line_no", "text"))

    def search(self, pattern: str, limit: int | None = None) -> DataFrame:
        return read.search_symbols(self.full, pattern, limit=limit)

    def imports(self) -> DataFrame:
        return read.get_imports(self.full)

    def diagnostics(self) -> DataFrame:
        return read.diagnostics(self.lines.sparkSession)

    def capabilities(self) -> DataFrame:
        """backend, cross_file_references, rename, type_info, diagnostics: none of the extractors here is a language server."""
        rows = [(x.name, False, False, False, False) for x in self.registry]
        return self.lines.sparkSession.createDataFrame(rows, "backend string, cross_file_references boolean, rename boolean, type_info boolean, diagnostics boolean")
