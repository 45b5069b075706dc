"""Symbols from source texts.

A pass over each file finds its statements (``statements``), in code whose comments and strings are blank (``lexing``). What a statement declares is
told by patterns over its head: the words up to its block or end, one blank between them, with "{" or ";" behind;
where the statement around it matters, that one's head and a line feed stand before. Ends, comments and signatures come from the
same pass, and so do methods, scopes and numbers. Nothing is joined, and files that are given whole are not shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..session import ship, spread
from .ordered import group_starts, in_file_order, whole_groups
from .statements import ENDED, INDENTED, File
from .statements import block_ends as _file_ends

_ID = r"((?:[^\W\d]|\$)[\w$]*)"
_GEN = r"(?: ?<(?:[^<>]++|<(?:[^<>]++|<(?:[^<>]++|<[^<>]*+>)*+>)*+>)*+>)"
_MOD = r"^(?:(?:public|private|protected|internal|static|final|abstract|async|override|virtual|export|default|open|sealed|partial|unsafe|const|inline|extern|readonly|native|synchronized|transient|volatile|new|fileprivate|mutating|required|convenience|lazy|weak|global) )*+"
_TYPE = r"(?:[^\W\d]|\$)[\w.$]*+(?:::\w++)*+" + _GEN + r"?+(?:\.\w++)*+\??(?: ?\[[ ,]*\])*+\??"
_VIS = r"^(?:pub(?: ?\([^)]*\))? )?"
_WITHIN = _MOD[1:] + r"(?:class|interface|enum|record|struct)\b[^\n]*\n"
_NOT = r"(?!(?:return|new|throw|else|if|while|for|switch|catch|do|try|synchronized|package|import|goto|case|delete|using|namespace|typedef|co_return|co_await|sizeof|yield|await|assert|lock)\b)"
_C_TYPE = r"^(?!(?:return|new|throw|else|if|while|for|switch|do|goto|case|delete|using|namespace|typedef|co_return|co_yield|sizeof)\b)(?:(?:\w++(?:::\w++)*+" + _GEN + r"?+)[ *&]++){1,12}"
#: language -> (kind, pattern with the name as first group), in order of precedence; of an import, the name is its whole text.
PATTERNS: dict[str, list[tuple[str, str]]] = {
    "rust": [
        ("Function", _VIS + r"(?:(?:default|const|async|unsafe|extern) )*fn " + _ID + r".*\{$"), ("Struct", _VIS + "struct " + _ID), ("Enum", _VIS + "enum " + _ID), ("Trait", _VIS + "(?:unsafe )?(?:auto )?trait " + _ID),
        ("Struct", r"^(?:default )?(?:unsafe )?impl" + _GEN + r"? (?:.* for )?(?:\w+::)*" + _ID), ("Import", _VIS + "use "), ("Constant", _VIS + "(?:const|static) (?:mut )?" + _ID + " ?:"),
    ],
    "python": [("Function", r"^\s*(?:async\s+)?def\s+" + _ID), ("Class", r"^\s*class\s+" + _ID), ("Import", r"^\s*(?:import|from)\s+\S")],
    "javascript": [("Function", r"^(?:export )?(?:default )?(?:async )?function ?\*? ?" + _ID), ("Class", "^(?:export )?(?:default )?class " + _ID), ("Import", r"^import\b(?! ?[(.])")],
    "go": [("Function", "^func " + _ID), ("Type", "^type " + _ID), ("Type", r"^type \{\n" + _ID), ("Import", r"^import\b")],
    "java": [
        ("Class", _MOD + "class " + _ID), ("Trait", _MOD + "interface " + _ID), ("Enum", _MOD + "enum " + _ID), ("Import", "^import "),
        ("Function", r"^[^\n]*\b(?:class|enum|record) (\w+)\b[^\n]*\n" + _MOD[1:] + _GEN + r"? ?\1 ?\([^{]*\{$"),
        ("Function", "^" + _WITHIN + _MOD[1:] + _GEN + r"?+ ?" + _NOT + r"(?!(?:class|interface|enum|record)\b)" + _TYPE + " " + _ID + r" ?\([^=]*[{;]$"),
        ("Variable", "^" + _WITHIN + _MOD[1:] + _NOT + r"(?!(?:class|interface|enum|record)\b)" + _TYPE + " " + _ID + r"(?: ?\[ ?\])*(?: ?=.*| ?,.*)? [;{]$"),
    ],
    "c": [
        ("Struct", r"^(?:(?:static|const|extern|volatile) )*struct " + _ID + r"(?: \w+\(.*\))? \{$"), ("Enum", r"^(?:(?:static|const|extern) )*enum " + _ID + r" \{$"), ("Function", r"^# ?define " + _ID + r"\("),
        ("Type", r"^typedef\b.*[ *}]" + _ID + r" ?;$"), ("Function", _C_TYPE + _ID + r" ?\((?![*^])[^{}=]*[;{]$"),
    ],
    "cpp": [
        ("Class", r"^(?:export )?class (?:\w+\(.*?\) )?" + _ID + r"\b[^;(]*\{$"), ("Struct", r"^(?:(?:static|const|export) )*struct " + _ID + r"\b[^;(]*\{$"), ("Enum", r"^enum (?:class |struct )?" + _ID + r".*\{$"), ("Type", r"^(?:inline )?namespace (?:\w+::)*" + _ID + r" \{$"),
        ("Function", _C_TYPE + r"(?:\w+" + _GEN + "?::)*+" + _ID + r" ?\((?![*^])[^{}]*\{$"), ("Function", r"^(?:\w+" + _GEN + "?::)++" + _ID + r" ?\(.*\{$"),
        ("Function", r"^[^\n]*\b(?:class|struct) (\w+)\b[^\n]*\n(?:(?:explicit|inline|constexpr) )*\1 ?\(.*\{$"),
    ],
    "ruby": [("Class", r"^\s*class\s+" + _ID), ("Type", r"^\s*module\s+" + _ID), ("Function", r"^\s*def\s+(?:self\.)?([^\W\d]\w*[?!=]?)"), ("Constant", r"^\s*([A-Z]\w*)\s*=[^=]")],
    "php": [("Class", _MOD + "class " + _ID), ("Trait", "^(?:interface|trait) " + _ID), ("Function", _MOD + "function &? ?" + _ID)],
    "bash": [("Function", r"^(?:function )?([\w:.-]+) ?\( ?\)"), ("Function", r"^function ([\w:.-]+)"), ("Variable", r"^(?:(?:export|local|readonly|declare|typeset)(?: -\w+)* )?([A-Za-z_]\w*)\+?=")],
    "csharp": [
        ("Class", _MOD + "class " + _ID), ("Trait", _MOD + "interface " + _ID), ("Struct", _MOD + "(?:ref )?struct " + _ID), ("Import", r"^(?:global )?using (?!\()(?:static )?[\w.]+(?: ?=.*)? ;$"),
        ("Function", "^" + _WITHIN + _MOD[1:] + _NOT + "(?!(?:delegate|event|operator|class|record)\\b)" + _TYPE + " " + _ID + _GEN + r"? ?\(.*[{;]$"),
        ("Constant", "^" + _WITHIN + r"(?:\w+ )*?const " + _TYPE + " " + _ID + " ?="),
        ("Variable", "^" + _WITHIN + _MOD[1:] + _NOT + "(?!(?:delegate|event|operator|class|record|using)\\b)" + _TYPE + " " + _ID + r"(?: ?=(?!>).*| ?,.*)? ;$"),
    ],
    "elixir": [("Module", r"^\s*defmodule\s+([\w.]+)"), ("Function", r"^\s*defp?\s+([^\W\d]\w*[?!]?)"), ("Import", r"^\s*(?:alias|import|require|use)\s+[A-Z]")],
    "lua": [("Function", r"^\s*(?:local\s+)?function\s+([\w.:]+)"), ("Variable", r"^\s*(?:local\s+)?" + _ID + r"\s*=[^=]")],
    "swift": [
        ("Function", _MOD + r"(?:(?:class|static) )?func " + _ID), ("Class", _MOD + r"(?:class|actor) (?!func\b|var\b|let\b)" + _ID), ("Struct", _MOD + "struct " + _ID), ("Trait", _MOD + "protocol " + _ID),
        ("Import", "^import "), ("Constant", _MOD + "let " + _ID), ("Variable", _MOD + "(?:class )?var " + _ID),
    ],
    "zig": [("Function", "^(?:pub )?(?:export |inline |extern )*fn " + _ID), ("Struct", "^(?:pub )?const " + _ID + r" ?= ?(?:packed |extern )?(?:struct|union|enum)\b"), ("Constant", "^(?:pub )?const " + _ID), ("Variable", "^(?:pub )?(?:threadlocal )?var " + _ID)],
    "haskell": [("Import", "^import "), ("Class", r"^class\s+(?:.*=>\s*)?" + _ID), ("Type", r"^(?:type|newtype|data)\s+" + _ID), ("Struct", r"^instance\s+(?:.*=>\s*)?" + _ID), ("Function", r"^([a-z_][\w']*)\s*::")],
}
PATTERNS["typescript"] = PATTERNS["javascript"]
#: For a language without a set of its own: type-like words are classes.
GENERIC = [("Class", r"^(?:\w+\s+)*?(?:class|struct|interface|trait|enum|type|module|object)\s+" + _ID), ("Function", r"^(?:\w+\s+)*?(?:fn|func|function|fun|def|defn|let rec)\s+" + _ID), ("Import", r"^(?:import|use|require|open|include)\s")]
#: Kinds without a block of their own.
FLAT = ("Import", "Constant", "Variable")
_IMPL = re.compile(PATTERNS["rust"][4][1])
#: Of a head that is longer only so much tells what it declares: an initialiser may be as long as the file.
HEAD_CHARS = 4096

_DECLARED = "file_path string, language string, line_start int, line_end int, column_start int, column_end int, kind string, name string, signature string, doc_comment string, scope_path array<string>, seq int, depth int, parent_seq int"
_WORD_AHEAD = re.compile(r"\s*(?:[^\W\d]|[#<])")
Rules = dict[str, list[tuple[str, str]]]


class Patterns:
    """The rules of a language, compiled; those of a language that has none, or one that isn't valid, are the generic ones."""

    def __init__(self, language: str | None, rules: Rules):
        self.generic = language not in rules
        try:
            own = [(kind, pattern, re.compile(pattern)) for kind, pattern in ([] if self.generic else rules[language])]
        except re.error:
            self.generic = True
        if self.generic:
            own = [(kind, pattern, re.compile(pattern)) for kind, pattern in GENERIC]
        self.rules = [(kind, "\\n" in pattern.replace(r"[^\n]", ""), found) for kind, pattern, found in own]

    def told(self, head: str, around: str) -> tuple[str, str] | None:
        """Kind and name (empty for an import) by the first pattern that matches."""
        both = None
        for kind, within, pattern in self.rules:
            if within and both is None:
                both = f"{around}\n{head}"
            m = pattern.match(both if within else head)
            if m:
                return kind, "" if kind == "Import" else m[1]
        return None


def _signature(file: File, start: int, end: int) -> str | None:
    """Up to the block, else the first line."""
    brace = -1 if file.language == "python" else file.source.find("{", start, end)
    if brace < 0:
        brace = file.source.find("\n", start, end)
    return file.source[start : brace if brace >= 0 else end].strip() or None


def _cut(head: str) -> str:
    return head if len(head) <= HEAD_CHARS else head[: HEAD_CHARS - 2] + head[-2:]


def _declared(path: str, file: File, patterns: Patterns) -> Iterator[tuple]:
    """(place in preorder, row) for each statement that declares something; functions of an impl once more as methods."""
    own, language = file.statements(), file.language
    by_line = language in INDENTED or language in ENDED
    for s in own:
        if patterns.generic and s.depth > 1 or not _WORD_AHEAD.match(s.head):
            continue  # of a language without patterns, what is at the top and one level below
        around = own[s.owner] if s.owner >= 0 else None
        told = patterns.told(_cut(s.head), _cut(around.head) if around else "")
        if told is None:
            continue
        kind, name = told
        end = s.flat if kind in FLAT and by_line else s.end
        if kind == "Import":
            name = file.source[s.start : end].strip().encode("utf-8", "surrogatepass")[:200].decode("utf-8", "ignore")
        line, last = file.line(s.start), file.line(max(end - 1, s.start))
        column = file.column(s.start, line)
        if not name or language == "haskell" and column:
            continue  # in Haskell only what begins a line
        doc = None if file.code[file.starts[line] : s.start].strip() else file.comment_above(line)
        if doc is None and language == "python" and kind in ("Function", "Class"):
            doc = file.docstring(s.flat, s.end)
        scope = []
        if patterns.generic and around and (of := patterns.told(_cut(around.head), "")) and of[1]:
            scope = [of[1]]
        row = (path, language, line, last, column, file.column(end, last), kind, name, _signature(file, s.start, end), doc, scope)
        yield (s.start, False, s.start, -s.end, kind, name), row
        if language == "rust" and kind == "Function" and around and (of := _IMPL.match(around.head)):
            yield (around.start, True, s.start, -s.end, kind, name), (*row[:6], "Method", *row[7:10], [of[1]])


def numbered(path: str, file: File, patterns: Patterns) -> Iterator[tuple]:
    """Rows of a file in preorder, with seq, depth and parent_seq: methods come behind the block of their type."""
    head = None
    for seq, (key, row) in enumerate(sorted(_declared(path, file, patterns), key=lambda x: x[0])):
        if row[6] == "Struct":
            head = seq
        yield (*row, seq, int(key[1]), head if key[1] else None)


def _sources(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str | None, str]]:
    """Whole files (file_path, language, source)."""
    for batch in batches:
        for path, language, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if source is not None:
                source = source.replace("\r\n", "\n")
                yield path, language, source.removesuffix("\n")


def _from_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str | None, str]]:
    """Whole files from sorted lines (file_path, language, line_no, text)."""
    for table in whole_groups(batches):
        starts = [*group_starts(table.column("file_path")).tolist(), table.num_rows]
        paths, languages, texts = (table.column(c).to_pylist() for c in ("file_path", "language", "text"))
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            yield paths[a], languages[a], "\n".join(t or "" for t in texts[a:b])


def _pass(read, rules: Rules):
    def work(batches):
        compiled: dict[str | None, Patterns] = {}
        rows: list[tuple] = []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)
        for path, language, source in read(batches):
            if language not in compiled:
                compiled[language] = Patterns(language, rules)
            rows += numbered(path, File(source, language), compiled[language])
            if len(rows) >= 4096:
                yield batch()
                rows.clear()
        if rows:
            yield batch()

    return work


_ARROW = pa.schema([(c.split()[0], {"int": pa.int32(), "string": pa.string()}.get(c.split()[1], pa.list_(pa.string()))) for c in _DECLARED.split(", ")])


def _symbols(rows: DataFrame) -> DataFrame:
    """The schema of symbols: adds qualified_name and stable_id."""
    q = text.qualified_name(F.col("scope_path"), F.col("name"))
    return rows.withColumn("qualified_name", q).withColumn("stable_id", text.stable_id(F.col("file_path"), q, F.col("line_start"), F.col("column_start")))


def extract_symbols(lines: DataFrame, patterns: Rules = PATTERNS) -> DataFrame:
    """All symbols of lines (file_path, language, line_no, text), in the canonical schema. A language whose patterns don't compile is read as one without any.

    Functions inside a Rust ``impl`` block come twice: as functions and as methods of the type, as in the
    data model that this follows; members of other types are functions with an empty scope. In a language without patterns of its own, a
    symbol within another has that one as scope, and there is nothing below these.
    """
    ordered = in_file_order(lines.select("file_path", "language", "line_no", "text"), "line_no")
    return _symbols(ordered.mapInArrow(_pass(_from_lines, patterns), _DECLARED))


def from_sources(files: DataFrame, patterns: Rules = PATTERNS) -> DataFrame:
    """All symbols of whole files (file_path, language, source), without a shuffle of their texts."""
    ship(files.sparkSession)
    return _symbols(spread(files.select("file_path", "language", "source")).mapInArrow(_pass(_sources, patterns), _DECLARED))


def block_ends(lines: DataFrame) -> DataFrame:
    """Adds line_end to every line (file_path, language, line_no, text), taken as the head of a block."""
    names = lines.columns

    def work(batches):
        for table in whole_groups(batches):
            starts = [*group_starts(table.column("file_path")).tolist(), table.num_rows]
            languages, texts, numbers = (table.column(c).to_pylist() for c in ("language", "text", "line_no"))
            ends: list[int] = []
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                code = File("\n".join(t or "" for t in texts[a:b]), languages[a]).code
                ends += [e + numbers[a] for e in _file_ends(code, languages[a])]
            yield from table.select(names).append_column("line_end", pa.array(ends, pa.int32())).to_batches()

    return in_file_order(lines, "line_no").mapInArrow(work, T.StructType([*lines.schema.fields, T.StructField("line_end", T.IntegerType())]))


def doc_comments(lines: DataFrame) -> DataFrame:
    """file_path, line_no, doc: the comment (or Python docstring) of every line that declares something."""
    return extract_symbols(lines).where("doc_comment IS NOT NULL AND depth = 0").select("file_path", F.col("line_start").alias("line_no"), F.col("doc_comment").alias("doc")).distinct()


def from_files(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Symbols of files (file_path, source), with the language found by extension."""
    from ..sources.files import with_language

    return from_sources(with_language(files, spark))
