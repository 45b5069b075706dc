"""Lexing and statements: what line patterns can't see."""

import time

import pytest

from structlens.operators import edit, extract, lexing, symbols, tokens, tools
from structlens.operators.statements import File, Statement
from structlens.plans import varied

FILES = "file_path string, language string, source string"


def _found(spark, *files):
    return {(r.kind, r.name, r.line_start, r.line_end) for r in symbols.from_sources(spark.createDataFrame([(f"f{i}", lang, s) for i, (lang, s) in enumerate(files)], FILES)).collect()}


def test_probes(spark):
    """A where clause, Java's fields, methods over lines, C over lines, a regular expression, a heredoc, two functions on a line."""
    rust = "fn a<T>(x: T) -> u8\nwhere\n    T: Into<u8>,\n{\n    x.into()\n}\nimpl S { fn one_line(&self) {} fn two(&self) {} }\n"
    assert {("Function", "a", 0, 5), ("Function", "one_line", 6, 6), ("Method", "two", 6, 6)} <= _found(spark, ("rust", rust))
    java = "package p;\nclass A\n{\n  Map<String, List<T>> m;\n  int f(\n    int a\n  ) {\n    return null;\n  }\n}\nrecord P(int a) { }\n"
    assert _found(spark, ("java", java)) == {("Class", "A", 1, 9), ("Variable", "m", 3, 3), ("Function", "f", 4, 8)}
    c = "static int\nadd(int a,\n int b)\n{\n}\nint main(void) { return 0; }\ntypedef struct {\n int x;\n} Q;\n"
    assert _found(spark, ("c", c)) == {("Function", "add", 0, 4), ("Function", "main", 5, 5), ("Type", "Q", 6, 8)}
    assert _found(spark, ("javascript", "class A {\n  f() {\n    return /[{]/;\n  }\n}\n")) == {("Class", "A", 0, 4)}
    assert _found(spark, ("bash", "f() {\n  cat <<EOF\n}\nEOF\n}\n")) == {("Function", "f", 0, 4)}


@pytest.mark.parametrize("ext", sorted(varied.BLOCKS))
def test_blocks(spark, ext):
    language, blocks = varied.BLOCKS[ext]
    for source, want in blocks:
        assert _found(spark, (language, source.replace("§", "7"))) == {(kind, name.replace("§", "7"), a, z) for kind, name, a, z in want}


@pytest.mark.parametrize("language", [*lexing._OPENERS, None])
def test_spans_cover_no_line_end_twice(language):
    text = "a '\"' \"x\" `b` /* c */ // d\n# e\n{- f -} --[[ g ]] <<E\nh\nE\n'''i\n''' \"\"\"j\n\"\"\" r#\"k\"# /l[/]/ ${m} \\\n"
    for source in (text, text[::-1], text * 3, "", "\n", "'", '"', "/*", "`${", "<<X"):
        found = lexing.spans(source, language)
        assert all(0 <= a < b <= len(source) for a, b, _ in found) and all(x[1] <= y[0] for x, y in zip(found, found[1:]))
        code = lexing.blanked(source, found)
        assert len(code) == len(source) and [i for i, c in enumerate(code) if c == "\n"] == [i for i, c in enumerate(source) if c == "\n"]


def test_awkward_sources(spark):
    rows = [("a", "rust", None), ("b", "rust", ""), ("c", "rust", "}}}) fn x() {"), ("d", None, "fn y() {}"), ("e", "rust", "fn é() {}\r\nfn z() {}\r\n"), ("f", "python", "def f(")]
    found = symbols.from_sources(spark.createDataFrame(rows, FILES)).collect()
    assert {(r.file_path, r.name, r.line_start, r.line_end) for r in found} == {("c", "x", 0, 0), ("d", "y", 0, 0), ("e", "é", 0, 0), ("e", "z", 1, 1), ("f", "f", 0, 0)}
    assert {r.name: (r.column_start, r.column_end) for r in found if r.file_path == "e"} == {"é": (0, 10), "z": (0, 9)}
    assert symbols.from_sources(spark.createDataFrame([], FILES)).count() == 0


def test_a_bad_pattern_falls_back(spark):
    files = spark.createDataFrame([("a.rs", "rust", "struct A {\n}\nfn f() {\n}\n"), ("b.go", "go", "func g() {\n}\n")], FILES)
    rules = {**symbols.PATTERNS, "rust": [("Function", "^fn (")]}
    assert {(r.kind, r.name) for r in symbols.from_sources(files, rules).collect()} == {("Class", "A"), ("Function", "f"), ("Function", "g")}
    own = {**symbols.PATTERNS, "rust": [("Type", r"^struct (\w+)")]}
    assert {(r.kind, r.name) for r in symbols.from_sources(files, own).collect()} == {("Type", "A"), ("Function", "g")}


def test_several_declarations_on_a_line(spark):
    found = symbols.from_sources(spark.createDataFrame([("a.rs", "rust", "impl A { fn f() {} } impl B { fn g() {} }\n")], FILES))
    methods = {r.name: (r.scope_path, r.parent_seq) for r in found.where("kind = 'Method'").collect()}
    seqs = {r.name: r.seq for r in found.where("kind = 'Struct'").collect()}
    assert methods == {"f": (["A"], seqs["A"]), "g": (["B"], seqs["B"])}


def test_long_inputs_take_linear_time(spark):
    began = time.perf_counter()
    line = " ".join(f"w{i}" for i in range(100_000))
    lines = spark.createDataFrame([("f", 0, line), ("g", 0, line.replace(" ", "( "))], "file_path string, line_no int, text string")
    assert tokens.tokens(lines.where("file_path = 'f'")).where("text = 'w99999'").first().col == line.index("w99999")
    assert tokens.call_columns(lines).where("name = 'w99998'").first().column == line.replace(" ", "( ").index("w99998")
    text = "x" * 1_000_000
    edits = spark.range(100_000).selectExpr("'f' AS file_path", "CAST(id * 10 AS INT) AS start", "CAST(id * 10 + 1 AS INT) AS end", "'yy' AS new_text")
    done = edit.apply_edits(spark.createDataFrame([("f", text)], "file_path string, source string"), edits).first().source
    assert done == ("yy" + "x" * 9) * 100_000
    deep = "fn a() {\n" * 20_000 + "}\n" * 20_000
    assert len(File(deep, "rust").statements()) == 20_000
    flat = File("x = [\n" + "  1,\n" * 100_000 + "]\n", "javascript").statements()
    assert len(flat) == 1 and isinstance(flat[0], Statement)
    assert time.perf_counter() - began < 60


def test_the_interface(spark):
    rows = [("a.rs", "rs", "rust", i, x) for i, x in enumerate(["use b::c;", "fn f() { f(); } // f", "struct F;"])] + [("t.toml", "toml", None, 0, "[x]"), ("z.txt", "txt", None, 0, "section:")]
    it = extract.Analysis(spark.createDataFrame(rows, "file_path string, ext string, language string, line_no int, text string"))
    assert {(r.file_path, r.backend) for r in it.symbols().collect()} == {("a.rs", "patterns"), ("t.toml", "toml"), ("z.txt", "heuristic")}
    assert [(r.kind, r.line_start) for r in it.definition("f").collect()] == [("Function", 1)]
    assert sorted((r.line_no, r.col) for r in it.references(spark.createDataFrame([("a.rs", 1, 3)], "file_path string, line int, column int")).collect()) == [(1, 3), (1, 9)]
    assert {r.name for r in it.search("F").collect()} == {"f", "F"} and [r.name for r in it.imports().collect()] == ["use b::c;"]
    assert it.diagnostics().count() == 0 and {r.backend for r in it.capabilities().where("not rename").collect()} == {"patterns", "toml", "heuristic"}


def test_tools_check_their_arguments(spark):
    known = {x["name"]: x for x in tools.tools()}
    assert known["read.search_symbols"]["input_schema"]["required"] == ["symbols", "pattern"] and known["read.search_symbols"]["read_only"] and not known["export.export"]["read_only"]
    assert all(x["description"] or x["name"] for x in known.values()) and len(known) > 60
    found = symbols.from_sources(spark.createDataFrame([("a.rs", "rust", "fn ab() {}")], FILES))
    assert tools.call("read.search_symbols", symbols=found, pattern="A", limit=3).first().name == "ab"
    for arguments, problem in (({"symbols": found}, "missing pattern"), ({"symbols": found, "pattern": "a", "x": 1}, "unknown x"), ({"symbols": found, "pattern": 3}, "has to be str"), ({"symbols": found, "pattern": "a", "limit": "3"}, "has to be int"), ({"symbols": found, "pattern": "a", "limit": -1}, "negative")):
        with pytest.raises(ValueError, match=problem):
            tools.call("read.search_symbols", **arguments)
    with pytest.raises(ValueError, match="unknown operator"):
        tools.call("read.nothing")
