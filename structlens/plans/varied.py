"""Catalogue queries over source texts that vary in structure: three blocks a file, drawn from what trips line patterns, in seventeen languages.

Beside each block stands what has to be found in it, by hand: kind, name, first and last line within the block. "§" is the place of the block in
the file and makes its names unique.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import edit, extract, relate, symbols, tokens
from ..sources.files import explode_lines, with_language
from . import tables as t

Q, O = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return register


#: extension -> (language, blocks); a block is its text and its symbols in order.
BLOCKS: dict[str, tuple[str, list[tuple[str, list[tuple]]]]] = {
    "rs": (
        "rust",
        [
            ("fn a§<T>(x: T) -> u8\nwhere\n    T: Into<u8>,\n{\n    x.into()\n}\n", [("Function", "a§", 0, 5)]),
            ("impl S§ { fn one§(&self) {} fn two§(&self) {} }\n", [("Struct", "S§", 0, 0), ("Function", "one§", 0, 0), ("Function", "two§", 0, 0), ("Method", "one§", 0, 0), ("Method", "two§", 0, 0)]),
            ('/* out /* in { */ { */\npub fn raw§() -> &\'static str {\n    r#"}"{"#\n}\n', [("Function", "raw§", 1, 3)]),
            ("macro_rules! m§ {\n    () => { fn hidden§() {} };\n}\nstatic mut X§: u8 = b'{';\n", [("Constant", "X§", 3, 3)]),
        ],
    ),
    "py": (
        "python",
        [
            ('def f§(\n    a="(",\n    b={"x": [1]},\n):\n    """Doc\n    (string."""\n    return a\n', [("Function", "f§", 0, 6)]),
            ("class C§: pass\n\n\nx§ = '''\ndef no§():\n    pass\n'''\n", [("Class", "C§", 0, 0)]),
            ("@deco(\n    1\n)\nasync def g§():\n    def inner§():\n        return f\"{'}'}\"\n    return inner§\n", [("Function", "g§", 3, 6), ("Function", "inner§", 4, 5)]),
        ],
    ),
    "js": (
        "javascript",
        [
            ("class A§ {\n  f() { return /[{]/; }\n}\n", [("Class", "A§", 0, 2)]),
            ("function g§() {\n  const s = `}${ { a: `{` }.a }`;\n  return s / 2 / 1;\n}\n", [("Function", "g§", 0, 3)]),
            ("class D§\n  extends B\n{\n}\nconst k§ = 'x'\nexport default async function h§() {}\n", [("Class", "D§", 0, 3), ("Function", "h§", 5, 5)]),
        ],
    ),
    "ts": (
        "typescript",
        [
            ('@Part({ a: "{" })\nexport class T§\n  extends B {\n  run(): void {}\n}\n', [("Class", "T§", 1, 4)]),
            ("function f§(\n  a: number,\n  b: { c: string },\n): Promise<void> {\n  return a > 1 ? b : `${a}`;\n}\n", [("Function", "f§", 0, 5)]),
        ],
    ),
    "go": (
        "go",
        [
            ("type (\n\tA§ struct {\n\t\tx int\n\t}\n\tB§ int\n)\n", [("Type", "A§", 1, 3), ("Type", "B§", 4, 4)]),
            ("func F§(a int,\n\tb string) (int, error) {\n\ts := `}\n{`\n\treturn 1, nil\n}\n", [("Function", "F§", 0, 5)]),
        ],
    ),
    "java": (
        "java",
        [
            ("public class A§<T extends B>\n    extends X\n{\n    Map<String, List<T>> m§ = new HashMap<>();\n    int f§(\n        int a\n    ) throws E {\n        return null;\n    }\n}\n", [("Class", "A§", 0, 9), ("Variable", "m§", 3, 3), ("Function", "f§", 4, 8)]),
            ('interface I§ {\n    String s§ = """\n        }\n        """;\n    <U> U g§(U u);\n}\n', [("Trait", "I§", 0, 5), ("Variable", "s§", 1, 3), ("Function", "g§", 4, 4)]),
            ("enum M§ { GOOD(1) { void x§() {} }, BAD(2); M§(int n) {} int v§; }\n", [("Enum", "M§", 0, 0), ("Function", "M§", 0, 0), ("Variable", "v§", 0, 0)]),
            ("record P§(int a) {\n    int h§() { return a; }\n}\n", [("Function", "h§", 1, 1)]),
        ],
    ),
    "c": (
        "c",
        [
            ("static int\nadd§(int a,\n     int b)\n{\n    return f(a);\n}\n", [("Function", "add§", 0, 5)]),
            ("int main§(void) { return 0; }\ntypedef struct { int x; } Q§;\n", [("Function", "main§", 0, 0), ("Type", "Q§", 1, 1)]),
            ("#define BIG§(a) { \\\n    a\nenum E§ { RED };\n", [("Function", "BIG§", 0, 1), ("Enum", "E§", 2, 2)]),
        ],
    ),
    "cpp": (
        "cpp",
        [
            ("template <typename T>\nclass C§ : public B<T> {\n public:\n  int run§() const { return 1; }\n};\n", [("Class", "C§", 1, 4), ("Function", "run§", 3, 3)]),
            ('int N§::go§(int a)\n{\n  auto s = R"x(}")x";\n  return a;\n}\n', [("Function", "go§", 0, 4)]),
            ("namespace z§ {\nenum class M§ { A };\n}\n", [("Type", "z§", 0, 2), ("Enum", "M§", 1, 1)]),
        ],
    ),
    "rb": (
        "ruby",
        [
            ("module M§\n  def a§?\n    x = <<~SQL\n      end\n    SQL\n  end\nend\n", [("Type", "M§", 0, 6), ("Function", "a§?", 1, 5)]),
            ("=begin\nclass No§\n=end\nLIMIT§ = %w(end {)\nclass C§\n  def self.b§\n    puts /end}/\n  end\nend\n", [("Constant", "LIMIT§", 3, 3), ("Class", "C§", 4, 8), ("Function", "b§", 5, 7)]),
        ],
    ),
    "php": (
        "php",
        [
            ("abstract class B§ extends C\n{\n    public function f§(array $x = []): int { return '}'; }\n}\n", [("Class", "B§", 0, 3), ("Function", "f§", 2, 2)]),
            ("function h§()\n{\n    $x = <<<EOT\n}\nEOT;\n}\ntrait T§ {} // {\n", [("Function", "h§", 0, 5), ("Trait", "T§", 6, 6)]),
        ],
    ),
    "sh": (
        "bash",
        [
            ('f§() {\n  cat <<EOF\n}\nEOF\n  echo "$(ls "}")" # }\n}\n', [("Function", "f§", 0, 5)]),
            ("function g§\n{\n  X§=${Y#z}\n}\n", [("Function", "g§", 0, 3), ("Variable", "X§", 2, 2)]),
        ],
    ),
    "cs": (
        "csharp",
        [
            ("[Attr]\npublic class A§<T> : B where T : class\n{\n    private readonly List<string> names§ = new();\n    public const int K§ = 3;\n    public int P { get; set; }\n    public async Task<int> F§(int a) => 1;\n}\n", [("Class", "A§", 1, 7), ("Variable", "names§", 3, 3), ("Constant", "K§", 4, 4), ("Function", "F§", 6, 6)]),
            ('struct S§ {\n    string G§() { return @"}""{"; }\n}\nusing System.X§;\n', [("Struct", "S§", 0, 2), ("Function", "G§", 1, 1), ("Import", "using System.X§;", 3, 3)]),
        ],
    ),
    "ex": (
        "elixir",
        [
            ('defmodule A§.B do\n  def f§(x) do\n    """\n  end\n    """\n  end\nend\n', [("Module", "A§.B", 0, 6), ("Function", "f§", 1, 5)]),
            ("defmodule C§ do\n  alias D§.E\n  defp g§(x), do: ~r/end/\nend\n", [("Module", "C§", 0, 3), ("Import", "alias D§.E", 1, 1), ("Function", "g§", 2, 2)]),
        ],
    ),
    "lua": (
        "lua",
        [
            ("--[==[ function no§()\nend ]] ]==]\nfunction M.a§()\n  return [[\nend\n]]\nend\n", [("Function", "M.a§", 2, 6)]),
            ("local t§ = {\n  [1] = 'end',\n}\n", [("Variable", "t§", 0, 2)]),
        ],
    ),
    "swift": (
        "swift",
        [
            ('public final class A§\n  : B\n{\n  class func make§() -> A { A() }\n  let x§ = "\\(f("}"))"\n}\n', [("Class", "A§", 0, 5), ("Function", "make§", 3, 3), ("Constant", "x§", 4, 4)]),
            ('protocol P§ { }\nfunc q§() {\n  let s§ = """\n  }\n  """\n}\n', [("Trait", "P§", 0, 0), ("Function", "q§", 1, 5), ("Constant", "s§", 2, 4)]),
        ],
    ),
    "zig": (
        "zig",
        [
            ("pub fn run§(\n    a: u8,\n) void {\n    const s§ =\n        \\\\ }\n    ;\n}\n", [("Function", "run§", 0, 6), ("Constant", "s§", 3, 5)]),
            ("const S§ = struct { x: u8, pub fn m§() void {} };\nvar v§: u8 = '}';\n", [("Struct", "S§", 0, 0), ("Function", "m§", 0, 0), ("Variable", "v§", 1, 1)]),
        ],
    ),
    "hs": (
        "haskell",
        [
            ("{- {- data No§ -} -}\ndata T§ = A | B\n", [("Type", "T§", 1, 1)]),
            ("f§ :: Int\n  -> Int\nf§ x' = x'\nclass Show a => K§ a where\n  k :: a\n", [("Function", "f§", 0, 1), ("Class", "K§", 3, 4)]),
        ],
    ),
}
_EXTS = list(BLOCKS)
_PLACES = 3


def varied_files(spark: SparkSession, d: str) -> DataFrame:
    """file_path, language, source: a text for each part; its key picks the language and, place by place, the blocks."""
    k = F.col("p_partkey")
    e = k % len(_EXTS)
    shapes = t.table(spark, d, "part").select(k.alias("k"), e.cast("int").alias("e"))
    at = lambda values, by: F.element_at(F.array(*[F.lit(v) for v in values]), (by + 1).cast("int"))
    count = at([len(BLOCKS[x][1]) for x in _EXTS], F.col("e"))
    source = F.lit("")
    for place in range(_PLACES):
        pick = F.floor(F.col("k") / (len(_EXTS) * 4**place)) % count
        text = F.lit(None).cast("string")
        for i, x in enumerate(_EXTS):
            text = F.when(F.col("e") == i, at([b for b, _ in BLOCKS[x][1]], pick)).otherwise(text)
        source = F.concat(source, F.replace(text, F.lit("§"), F.lit(str(place))))
    path = F.concat(F.lit("v/p"), F.col("k").cast("string"), F.lit("."), at(_EXTS, F.col("e")))
    return shapes.select(path.alias("file_path"), at([BLOCKS[x][0] for x in _EXTS], F.col("e")).alias("language"), source.alias("source"))


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_SHAPES = ", ".join(f"({i}, {b}, {text.count(chr(10))})" for i, x in enumerate(_EXTS) for b, (text, _) in enumerate(BLOCKS[x][1]))
_ROWS = ", ".join(f"({i}, {b}, {_text(kind)}, {_text(name)}, {first}, {last})" for i, x in enumerate(_EXTS) for b, (_, found) in enumerate(BLOCKS[x][1]) for kind, name, first, last in found)
EXPECTED = f"""
v_blocks(e, b, n) AS (VALUES {_SHAPES}), v_counts AS (SELECT e, count(*) AS c FROM v_blocks GROUP BY e), v_rows(e, b, kind, own, a, z) AS (VALUES {_ROWS}),
v_files AS (SELECT p_partkey AS k, p_partkey % {len(_EXTS)} AS e, ['{"', '".join(_EXTS)}'][p_partkey % {len(_EXTS)} + 1] AS ext FROM part),
v_places AS (SELECT f.*, place, p_block AS b FROM (SELECT f.*, place, CAST(floor(k / ({len(_EXTS)} * power(4, place))) AS BIGINT) % c AS p_block FROM v_files f JOIN v_counts USING (e), range({_PLACES}) r(place)) f),
v_starts AS (SELECT p.*, coalesce(sum(n) OVER (PARTITION BY k ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM v_places p JOIN v_blocks USING (e, b)),
v_symbols AS (SELECT 'v/p' || k || '.' || ext AS file_path, place, kind, replace(own, '§', CAST(place AS VARCHAR)) AS symbol, CAST(first + a AS INTEGER) AS line_start, CAST(first + z AS INTEGER) AS line_end FROM v_starts JOIN v_rows USING (e, b))"""


@query("varied_sources", f"WITH {EXPECTED} SELECT file_path, kind, symbol, line_start, line_end FROM v_symbols")
def varied_sources(s, d):
    return symbols.from_sources(varied_files(s, d)).select("file_path", "kind", F.col("name").alias("symbol"), "line_start", "line_end")


@query("varied_lines", f"WITH {EXPECTED} SELECT file_path, kind, symbol, line_start, line_end FROM v_symbols")
def varied_lines(s, d):
    """The same from lines, which are put together by file."""
    files = varied_files(s, d)
    lines = explode_lines(files).join(files.select("file_path", "language"), "file_path")
    return symbols.extract_symbols(lines).select("file_path", "kind", F.col("name").alias("symbol"), "line_start", "line_end")


# --- identifiers in code, comments and strings ---------------------------------------------------------------------

#: extension -> text with "§" in code, in comments and in strings: so often in each.
MENTIONS: dict[str, tuple[str, str, int, int, int]] = {
    "rs": ("rust", '/* § /* § */ § */\nfn §() {\n    let s = r#"§ "quoted" §"#; // §\n    §(s, "§");\n}\n', 2, 4, 3),
    "js": ("javascript", "// §\nconst § = `§ ${ § } §`;\n/* §\n§ */ f(§, /§[§]/g, '§');\n", 3, 3, 5),
    "py": ("python", "def §(x):\n    '''§\n    § # §'''\n    return § + x[\"§\"]  # §\n", 2, 1, 4),
    "sh": ("bash", "§() {\n  cat <<EOF\n§ §\nEOF\n  § '§' # §\n}\n", 2, 1, 3),
    "lua": ("lua", "local § = [[ §\n§ ]] --[[ § ]]\nprint(§) -- §\n", 2, 2, 2),
    "cs": ("csharp", 'class § {\n  string s = @"x"" §"; // §\n  int n = §.f($"{1}§");\n}\n', 2, 1, 2),
}


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    """file_path, language, name, source: a text for each customer."""
    c = t.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.replace("c_name", F.lit("#"), F.lit("_")).alias("name"))
    exts = list(MENTIONS)
    at = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("k") % len(exts) + 1).cast("int"))
    source = F.replace(at([MENTIONS[e][1] for e in exts]), F.lit("§"), F.col("name"))
    return c.select(F.concat(F.lit("m/c"), F.col("k").cast("string"), F.lit("."), at(exts)).alias("file_path"), at([MENTIONS[e][0] for e in exts]).alias("language"), "name", source.alias("source"))


_MENTIONED = "m_texts(e, ext, code, comment, string) AS (VALUES " + ", ".join(f"({i}, '{e}', {a}, {b}, {c})" for i, (e, (_, _, a, b, c)) in enumerate(MENTIONS.items())) + "), " + (
    f"m_files AS (SELECT 'm/c' || c_custkey || '.' || ext AS file_path, replace(c_name, '#', '_') AS name, code, comment, string FROM customer JOIN m_texts ON e = c_custkey % {len(MENTIONS)})"
)


@query("token_kinds", f"WITH {_MENTIONED} SELECT file_path, name, 'code' AS token_kind, code AS n FROM m_files UNION ALL SELECT file_path, name, 'comment', comment FROM m_files UNION ALL SELECT file_path, name, 'string', string FROM m_files")
def token_kinds(s, d):
    files = _mentions(s, d)
    found = tokens.source_tokens(files).join(files.select("file_path", "name"), "file_path").where("text = name")
    return found.groupBy("file_path", "name", "token_kind").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("references_in_code", f"WITH {_MENTIONED} SELECT file_path, name AS target, code AS n FROM m_files")
def references_in_code(s, d):
    files = _mentions(s, d)
    lines = explode_lines(files).join(files.select("file_path", "language"), "file_path")
    refs = relate.find_references(files.select("file_path", F.col("name").alias("text")), lines)
    return refs.groupBy("file_path", "target").agg(F.count(F.lit(1)).cast("int").alias("n"))


_PLACES_OF = {"rs": (1, 3), "js": (1, 6), "py": (0, 4), "sh": (0, 0), "lua": (0, 6), "cs": (0, 6)}


@query("references_at", f"WITH {_MENTIONED} SELECT file_path, name AS target, code AS n FROM m_files")
def references_at(s, d):
    """The identifier at a place, and all its places in code, through the interface of extractors."""
    files = with_language(_mentions(s, d).drop("language"), s)
    lines = explode_lines(files).join(files.select("file_path", "ext", "language"), "file_path")
    at = lambda k: F.element_at(F.create_map(*[F.lit(x) for e, place in _PLACES_OF.items() for x in (e, place[k])]), F.col("ext"))
    refs = extract.Analysis(lines).references(files.select("file_path", at(0).alias("line"), at(1).alias("column")))
    return refs.groupBy("file_path", "target").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("rename_in_code", f"WITH {_MENTIONED} SELECT file_path, code AS renamed, comment + string AS kept FROM m_files")
def rename_in_code(s, d):
    """Renames leave comments and strings alone."""
    files = _mentions(s, d)
    lines = explode_lines(files).join(files.select("file_path", "language"), "file_path")
    targets = files.select("file_path", F.col("name").alias("text"))
    names = files.select("file_path", F.col("name").alias("target"), F.lit("renamed_it").alias("new_name"))
    done = edit.apply_edits(files.select("file_path", "source"), relate.rename_edits(relate.find_references(targets, lines), names, lines))
    times = lambda what: F.floor((F.length("source") - F.length(F.replace("source", what, F.lit("")))) / F.length(what)).cast("int")
    return done.join(files.select("file_path", "name"), "file_path").select("file_path", times(F.lit("renamed_it")).alias("renamed"), times(F.col("name")).alias("kept"))


@query(
    "call_columns",
    r"""WITH {pages}, c AS (SELECT file_path, line_no, text, unnest(regexp_extract_all(text, '([\pL\pN_]+) *\(', 1)) AS name FROM page_lines WHERE text LIKE '%(%' AND NOT starts_with(trim(text), '//') AND NOT starts_with(trim(text), '#'))
SELECT file_path, line_no, name, count(*) AS n FROM c WHERE name NOT IN ({words}) GROUP BY ALL""".replace("{pages}", t.PAGE).replace("{words}", ", ".join(f"'{w}'" for w in fixed.CALL_KEYWORDS)),
)
def call_columns(s, d):
    """Every column is where its name begins."""
    lines = t.page_lines(s, d)
    found = tokens.call_columns(lines).join(lines, ["file_path", "line_no"])
    there = F.decode(F.substring(F.encode("text", "UTF-8"), F.col("column") + 1, F.octet_length("name")), "UTF-8") == F.col("name")
    return found.where(there).groupBy("file_path", "line_no", "name").agg(F.count(F.lit(1)).alias("n"))
