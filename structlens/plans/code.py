"""Catalogue queries over source texts that are rendered from a table, one for each customer, in eight languages.

What has to be found is written down beside each text, by hand: kind, name, first and last line, depth, comment and signature.
"@" stands for the customer's name, "~" for one step of indentation: two spaces, four or a tab.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import graph, read, symbols
from ..operators import tokens as words
from ..sources.files import explode_lines
from . import tables as t

Q, O = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return register


STEPS = ["  ", "    ", "\t"]
#: extension -> (language, text, symbols in order)
SOURCES: dict[str, tuple[str, str, list[tuple]]] = {
    "rs": (
        "rust",
        """use std::fmt;

/// Holds @.
/// Two lines.
#[derive(Debug)]
pub struct @ {
~open: u32, // not a block: {
}

impl @ {
~/* nor
~   is { this
~ */
~pub fn open(
~~&self,
~~n: u32,
~) -> u32 {
~~let s = "{";
~~let c = '{';
~~n
~}
}

pub enum Mood { Good, Bad }

const LIMIT: u32 = 3;
""",
        [
            ("Import", "use std::fmt;", 0, 0, 0, None, "use std::fmt;"), ("Struct", "@", 5, 7, 0, "/// Holds @.\n/// Two lines.", "pub struct @"), ("Struct", "@", 9, 21, 0, None, "impl @"),
            ("Function", "open", 13, 20, 0, "/* nor\n~   is { this\n~ */", "pub fn open(\n~~&self,\n~~n: u32,\n~) -> u32"), ("Method", "open", 13, 20, 1, "/* nor\n~   is { this\n~ */", "pub fn open(\n~~&self,\n~~n: u32,\n~) -> u32"),
            ("Enum", "Mood", 23, 23, 0, None, "pub enum Mood"), ("Constant", "LIMIT", 25, 25, 0, None, "const LIMIT: u32 = 3;"),
        ],
    ),
    "py": (
        "python",
        """import os
from sys import (
~path,
)


class @:
~\"\"\"Doc of @.\"\"\"

~def run(
~~self,
~~n,
~):
~~\"\"\"Runs (
~~twice.\"\"\"
~~if n:
~~~return "}"

~~return 2  # (

# Above.
def main():
~pass
""",
        [
            ("Import", "import os", 0, 0, 0, None, "import os"), ("Import", "from sys import (\n~path,\n)", 1, 3, 0, None, "from sys import ("), ("Class", "@", 6, 18, 0, '"""Doc of @."""', "class @:"),
            ("Function", "run", 9, 18, 0, '"""Runs (\n~~twice."""', "def run("), ("Function", "main", 21, 22, 0, "# Above.", "def main():"),
        ],
    ),
    "rb": (
        "ruby",
        """# A zoo.
module Zoo
~class @
~~LIMIT = 3

~~def run(n)
~~~if n
~~~~1
~~~else
~~~~"end"
~~~end
~~end

~~def self.make
~~~new
~~end
~end
end
""",
        [
            ("Type", "Zoo", 1, 17, 0, "# A zoo.", "module Zoo"), ("Class", "@", 2, 16, 0, None, "class @"), ("Constant", "LIMIT", 3, 3, 0, None, "LIMIT = 3"),
            ("Function", "run", 5, 11, 0, None, "def run(n)"), ("Function", "make", 13, 15, 0, None, "def self.make"),
        ],
    ),
    "ts": (
        "typescript",
        """import { a } from "a";

export class @ {
~run(): string {
~~return `}`;
~}
}

export async function main(
~n: number,
): Promise<void> {
~if (n) { return; } // }
}
""",
        [("Import", 'import { a } from "a";', 0, 0, 0, None, "import"), ("Class", "@", 2, 6, 0, None, "export class @"), ("Function", "main", 8, 12, 0, None, "export async function main(\n~n: number,\n): Promise<void>")],
    ),
    "java": (
        "java",
        """import java.util.List;

/**
 * The { class.
 */
public class @ {
~private int size = 0;

~public @(int n) {
~~size = n;
~}

~@Override
~public String run(String s) throws Error {
~~return s + "}";
~}
}

interface Able {
~void go(int n);
}

enum Mood { GOOD }
""",
        [
            ("Import", "import java.util.List;", 0, 0, 0, None, "import java.util.List;"), ("Class", "@", 5, 16, 0, "/**\n * The { class.\n */", "public class @"), ("Variable", "size", 6, 6, 0, None, "private int size = 0;"),
            ("Function", "@", 8, 10, 0, None, "public @(int n)"), ("Function", "run", 13, 15, 0, None, "public String run(String s) throws Error"),
            ("Trait", "Able", 18, 20, 0, None, "interface Able"), ("Function", "go", 19, 19, 0, None, "void go(int n);"), ("Enum", "Mood", 22, 22, 0, None, "enum Mood"),
        ],
    ),
    "go": (
        "go",
        """package zoo

import "fmt"

// @ is a cat.
type @ struct {
~Name string
}

func Run(a int) int {
~fmt.Println("{")
~return a
}
""",
        [("Import", 'import "fmt"', 2, 2, 0, None, 'import "fmt"'), ("Type", "@", 5, 7, 0, "// @ is a cat.", "type @ struct"), ("Function", "Run", 9, 12, 0, None, "func Run(a int) int")],
    ),
    "c": (
        "c",
        """#include <stdio.h>

struct @ {
~int n;
};

/* Adds. */
int add(int a, int b)
{
~return a + b; /* } */
}

int later(int a);
""",
        [("Struct", "@", 2, 4, 0, None, "struct @"), ("Function", "add", 7, 10, 0, "/* Adds. */", "int add(int a, int b)"), ("Function", "later", 12, 12, 0, None, "int later(int a);")],
    ),
    "lua": (
        "lua",
        """-- Runs.
local function run(n)
~if n then
~~return "end"
~end
end

local @ = 3
""",
        [("Function", "run", 1, 5, 0, "-- Runs.", "local function run(n)"), ("Variable", "@", 7, 7, 0, None, "local @ = 3")],
    ),
}
_EXTS = list(SOURCES)


def source_files(spark: SparkSession, d: str) -> DataFrame:
    """file_path, source, language, name: a text for each customer."""
    c = t.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.replace("c_name", F.lit("#"), F.lit("_")).alias("name"))
    pick = lambda values, by: F.element_at(F.array(*[F.lit(v) for v in values]), (by + 1).cast("int"))
    n = len(_EXTS)
    ext, step = pick(_EXTS, F.col("k") % n), pick(STEPS, F.floor(F.col("k") / n) % len(STEPS))
    whole = F.replace(F.replace(pick([SOURCES[e][1] for e in _EXTS], F.col("k") % n), F.lit("@Override"), F.lit("\x01")), F.lit("@"), F.col("name"))
    source = F.replace(F.replace(whole, F.lit("\x01"), F.lit("@Override")), F.lit("~"), step)
    return c.select(F.concat(F.lit("src/c"), F.col("k").cast("string"), F.lit("."), ext).alias("file_path"), source.alias("source"), pick([SOURCES[e][0] for e in _EXTS], F.col("k") % n).alias("language"), "name")


def source_lines(spark: SparkSession, d: str) -> DataFrame:
    files = source_files(spark, d)
    return explode_lines(files).join(files.select("file_path", "language"), "file_path")


def _text(x) -> str:
    return "NULL" if x is None else "'" + str(x).replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _filled(c: str) -> str:
    return f"replace(replace({c}, '@', name), '~', step)"


_LIST = f"(['{chr(39) + ', ' + chr(39)}'])".replace(f"{chr(39)}, {chr(39)}", "', '".join(_EXTS))
_ROWS = ", ".join(f"({e}, {i}, {_text(k)}, {_text(n)}, {a}, {z}, {depth}, {_text(doc)}, {_text(sig)})" for e, x in enumerate(_EXTS) for i, (k, n, a, z, depth, doc, sig) in enumerate(SOURCES[x][2]))
EXPECTED = f"""
src_k AS (SELECT c_custkey, c_custkey % {len(_EXTS)} AS e, replace(c_name, '#', '_') AS name, (['  ', '    ', chr(9)])[CAST(floor(c_custkey / {len(_EXTS)}) AS BIGINT) % 3 + 1] AS step,
  'src/c' || c_custkey || '.' || {_LIST}[c_custkey % {len(_EXTS)} + 1] AS file_path FROM customer),
src_rows(e, i, kind, own, line_start, line_end, depth, doc, sig) AS (VALUES {_ROWS}),
src_symbols AS (SELECT file_path, e, i, kind, {_filled("own")} AS symbol, CAST(line_start AS INTEGER) AS line_start, CAST(line_end AS INTEGER) AS line_end, CAST(depth AS INTEGER) AS depth,
  {_filled("doc")} AS doc_comment, {_filled("sig")} AS signature, CASE WHEN kind = 'Method' THEN name || '::open' ELSE {_filled("own")} END AS qualified_name FROM src_k JOIN src_rows USING (e))"""


@query("symbols_from_source", f"WITH {EXPECTED} SELECT file_path, kind, symbol, line_start, line_end, depth, doc_comment, signature, qualified_name FROM src_symbols")
def symbols_from_source(s, d):
    found = symbols.extract_symbols(source_lines(s, d))
    return found.select("file_path", "kind", F.col("name").alias("symbol"), "line_start", "line_end", "depth", "doc_comment", "signature", "qualified_name")


@query("symbols_from_files", f"WITH {EXPECTED} SELECT kind, count(*) AS n, count(DISTINCT file_path) AS n_files FROM src_symbols GROUP BY kind")
def symbols_from_files(s, d):
    found = symbols.from_files(s, source_files(s, d).select("file_path", "source"))
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file_path").alias("n_files"))


@query("doc_comments", f"WITH {EXPECTED} SELECT file_path, line_start AS line_no, doc_comment AS doc FROM src_symbols WHERE doc_comment IS NOT NULL AND depth = 0")
def doc_comments(s, d):
    return symbols.doc_comments(source_lines(s, d))


@query("methods_and_parents", f"WITH {EXPECTED} SELECT m.file_path, m.symbol, p.symbol AS owner, p.line_start AS owner_start FROM src_symbols m JOIN src_symbols p ON p.file_path = m.file_path AND p.i = 2 WHERE m.depth = 1")
def methods_and_parents(s, d):
    found = symbols.extract_symbols(source_lines(s, d))
    owner = found.select("file_path", F.col("seq").alias("parent_seq"), F.col("name").alias("owner"), F.col("line_start").alias("owner_start"))
    return found.where("depth = 1").join(owner, ["file_path", "parent_seq"]).select("file_path", F.col("name").alias("symbol"), "owner", "owner_start")


@query("source_graph", f"""WITH {EXPECTED}, n AS (SELECT *, file_path || '::' || qualified_name AS node FROM src_symbols)
SELECT n.file_path, count(*) AS n_contains, count(*) FILTER (kind = 'Import') AS n_imports, count(*) FILTER (depth = 1) AS n_nested FROM n GROUP BY n.file_path""")
def source_graph(s, d):
    edges = graph.build_edges(symbols.extract_symbols(source_lines(s, d)), "p")
    return edges.groupBy(F.substring_index("target", "::", 1).alias("file_path")).agg(
        F.count_if(F.col("relation") == "contains").alias("n_contains"), F.count_if(F.col("relation") == "imports").alias("n_imports"),
        F.count_if((F.col("relation") == "contains") & F.col("source").contains("::")).alias("n_nested"),
    )


@query("source_definitions", f"""WITH {EXPECTED} SELECT file_path, symbol, arg_min(line_start, i) AS line_start, CAST(arg_min(line_end - line_start + 1, i) AS INTEGER) AS n_lines FROM src_symbols GROUP BY file_path, symbol""")
def source_definitions(s, d):
    lines = source_lines(s, d)
    body = read.get_definition(symbols.extract_symbols(lines), lines, full=True)
    return body.select("file_path", F.col("name").alias("symbol"), "line_start", F.size(F.split("body", "\n")).alias("n_lines"))


_TOKENS = r"""WITH {doc}, w AS (SELECT file_path, line_no, regexp_extract_all(text, '[\pL_][\pL\pN_]*') AS names, regexp_split_to_array(text, '[\pL_][\pL\pN_]*') AS gaps FROM doc_lines),
x AS (SELECT *, unnest(range(1, len(names) + 1)) AS i FROM w)
SELECT file_path, line_no, CAST(length(array_to_string(gaps[1:i], '')) + length(array_to_string(names[1:i - 1], '')) AS INTEGER) AS col, names[i] AS text FROM x"""


@query("tokens", _TOKENS.replace("{doc}", t.DOC))
def tokens(s, d):
    return words.tokens(t.doc_lines(s, d))


@query("generic_outline", """WITH g AS (SELECT 'g/' || n_nationkey || '.kt' AS file_path, replace(n_name, ' ', '_') AS n FROM nation)
SELECT file_path, 'Class' AS kind, n AS symbol, 0 AS line_start, 5 AS line_end, NULL AS scope FROM g UNION ALL SELECT file_path, 'Function', 'run', 1, 4, n FROM g UNION ALL SELECT file_path, 'Function', 'other', 7, 8, NULL FROM g""")
def generic_outline(s, d):
    name = F.replace("n_name", F.lit(" "), F.lit("_"))
    source = F.concat(F.lit("class "), name, F.lit(" {\n  fun run() {\n    fun deep() {\n    }\n  }\n}\n\nfun other() {\n}\n"))
    files = t.table(s, d, "nation").select(F.concat(F.lit("g/"), F.col("n_nationkey").cast("string"), F.lit(".kt")).alias("file_path"), source.alias("source"))
    return symbols.from_files(s, files).select("file_path", "kind", F.col("name").alias("symbol"), "line_start", "line_end", F.get("scope_path", F.lit(0)).alias("scope"))


@query("source_identifiers", f"WITH {EXPECTED} SELECT file_path, count(*) AS n FROM src_symbols WHERE NOT starts_with(symbol, 'import') GROUP BY file_path")
def source_identifiers(s, d):
    """Stable ids are different for every symbol but a method and its function."""
    found = symbols.extract_symbols(source_lines(s, d)).where(~F.col("name").startswith("import"))
    made = text.stable_id(F.col("file_path"), F.col("qualified_name"), F.col("line_start"), F.col("column_start"))
    return found.where(made == F.col("stable_id")).groupBy("file_path").agg(F.countDistinct("stable_id").alias("n"))
