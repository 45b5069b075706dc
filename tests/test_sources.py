"""Scans, roots, stores and configuration."""

from structlens.operators import config, incremental
from structlens.sources import files, sinks


def test_scan(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / ".hidden").mkdir()
    (tmp_path / "build").mkdir()
    for name, data in {"src/a.rs": b"fn a() {}\r\n", "src/b.py": b"\xff\xfe", ".hidden/c.rs": b"x", "build/d.rs": b"x", "notes.unknown": b"x", "src/E.RS": b"x"}.items():
        (tmp_path / name).write_bytes(data)
    rows = {r.file_path: r for r in files.scan_files(spark, str(tmp_path), ignore=["^build/"]).collect()}
    assert set(rows) == {"src/a.rs", "src/b.py"}
    assert rows["src/a.rs"].language == "rust" and rows["src/a.rs"].error is None
    assert rows["src/b.py"].source is None and rows["src/b.py"].error == "not UTF-8"
    small = {r.file_path: r.error for r in files.scan_files(spark, str(tmp_path), ignore=["^build/"], max_bytes=5).collect()}
    assert small["src/a.rs"] == "too large"
    lines = files.explode_lines(spark.createDataFrame([("a", "x\r\ny\n\n"), ("b", ""), ("c", "\n")], "file_path string, source string")).collect()
    assert sorted((r.file_path, r.line_no, r.text) for r in lines) == [("a", 0, "x"), ("a", 1, "y"), ("a", 2, ""), ("c", 0, "")]


def test_nested_repositories(spark):
    p = spark.createDataFrame([("a/.git",), ("b/.git/HEAD",), ("c/x/.git",), (".git",)], "path string")
    assert {r.repo for r in files.nested_repositories(p).collect()} == {"a", "b"}


def test_index_round_trip(spark, tmp_path):
    s = spark.createDataFrame([("a", "f", "Function"), ("a", "g", "Class")], "file_path string, name string, kind string")
    sinks.write_index(s, str(tmp_path / "i"))
    assert {r.name for r in sinks.read_index(spark, str(tmp_path / "i")).where("kind = 'Class'").collect()} == {"g"}
    assert sinks.read_index(spark, str(tmp_path / "i"), schema_version=3).count() == 0


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "path string, mtime int")
    new = spark.createDataFrame([("b", 2), ("c", 2)], "path string, mtime int")
    assert {tuple(r) for r in incremental.cache_upsert(old, new, prune=False).collect()} == {("a", 1), ("b", 2), ("c", 2)}
    assert {tuple(r) for r in incremental.cache_upsert(old, new, prune=True).collect()} == {("b", 2), ("c", 2)}


def test_toml_config(spark, tmp_path):
    (tmp_path / "c.toml").write_text('[languages.rust]\nserver_binary = "ra"\nserver_args = ["-v"]\n[languages.go]\nenabled = false\n')
    rows = {r.language: r for r in config.load_toml(spark, str(tmp_path / "c.toml")).collect()}
    assert rows["rust"].binary == "ra" and rows["rust"].args == ["-v"] and rows["go"].enabled is False


def test_gitignore(spark, tmp_path):
    for name, data in {".gitignore": "target/\n*.log.py\n!keep.log.py\n/top.rs\ndocs/**/gen_?.py\n# note\n", "target/a.rs": "x", "src/target/b.rs": "x", "src/c.log.py": "x", "src/keep.log.py": "x", "top.rs": "x", "src/top.rs": "x", "docs/a/b/gen_1.py": "x", "docs/gen_22.py": "x", "sub/.gitignore": "own.rs\n", "sub/own.rs": "x", "sub/deep/own.rs": "x", "src/own.rs": "x"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(data)
    assert {r.file_path for r in files.scan_files(spark, str(tmp_path)).collect()} == {"src/keep.log.py", "src/top.rs", "docs/gen_22.py", "src/own.rs"}
    assert files.scan_files(spark, str(tmp_path), gitignore=False).count() == 11


def test_scan_counters(spark):
    rows = spark.createDataFrame([(f"f{i}", "not UTF-8" if i < 7 else None) for i in range(9)], "file_path string, error string")
    r = files.scan_counters(rows).first()
    assert (r.supported, r.failed, r.failures) == (9, 7, "\n".join(f"f{i}: not UTF-8" for i in range(5)))


def test_versions_and_cache(spark, tmp_path):
    path = str(tmp_path / "t")
    a = spark.createDataFrame([("a", 1), ("b", 1)], "path string, mtime int")
    assert sinks.load_cache(spark, path, a.schema).count() == 0
    assert sinks.write_version(a, path, prune=True, keys=["path"]) == 1
    assert sinks.write_version(spark.createDataFrame([("b", 2)], a.schema), path, prune=False, keys=["path"]) == 2
    assert {tuple(r) for r in sinks.read_version(spark, path).collect()} == {("a", 1), ("b", 2)}
    (tmp_path / "t" / "v=3").mkdir()  # not complete: nobody reads it
    assert sinks.read_version(spark, path).count() == 2
    assert sinks.load_cache(spark, path, a.schema).count() == 2 and sinks.load_cache(spark, path, a.withColumn("size", a.mtime).schema).count() == 0


def test_graph_sink(spark, tmp_path):
    nodes = spark.createDataFrame([("n", "p")], "name string, project string")
    edges = spark.createDataFrame([("a", "b", "contains"), ("a", "c", "imports")], "source string, target string, relation string")
    sinks.write_graph(nodes, edges, str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g" / "edges")).where("relation = 'imports'").first().target == "c"


def test_deno_stop_at_and_markers(spark):
    f = spark.createDataFrame([("x/a/m.ts", "typescript"), ("x/a/m.cs", "csharp"), ("x/b/m.hs", "haskell")], "file_path string, language string")
    there = spark.createDataFrame([("x/a/deno.json",), ("x/a/package.json",), ("x/package.json",), ("package.json",), ("x/a/Own.csproj",)], "path string")
    got = {r.file_path: r.root for r in files.detect_roots(f, there, spark, stop_at="x").collect()}
    assert got == {"x/a/m.ts": "x", "x/a/m.cs": "x/a", "x/b/m.hs": "x"}


def _below(plan: str, node: str) -> list[str]:
    """What stands below each node of that name in a plan's text, by its indents."""
    lines, out = plan.splitlines(), []
    at = [next((i for i, c in enumerate(x) if c.isalpha()), 0) for x in lines]
    for i, x in enumerate(lines):
        if x[at[i] :].startswith(node):
            end = next((j for j in range(i + 1, len(lines)) if at[j] <= at[i]), len(lines))
            out.append("\n".join(lines[i + 1 : end]))
    return out


def test_folders_of_files_are_not_broadcast(spark):
    # the planner takes these files for 80 kB, whatever the number of folders above each
    deep = files.F.format_string("a/b/c/d/e/f%d/x.rs", "id")
    f = spark.range(10_000).select(deep.alias("file_path"), files.F.lit("rust").alias("language"))
    there = spark.createDataFrame([("a/Cargo.toml",), ("a/b/c/Cargo.toml",), ("a/b/c/d/e/f7/Cargo.toml",), (".git",)], "path string")
    roots = files.detect_roots(f, there, spark)
    assert not [x for x in _below(roots._jdf.queryExecution().executedPlan().toString(), "BroadcastExchange") if "Range" in x]
    assert {(r.root, r["count"]) for r in roots.groupBy("root").count().collect()} == {("a/b/c", 9_999), ("a/b/c/d/e/f7", 1)}


def test_roots_by_git_language_and_workspace(spark):
    f = [("g/p/q/a.rs", "rust"), ("g/p/q/a.py", "python"), ("g/p/q/notes", None), ("g/p/q/notes", "go"), ("h/a.rs", "rust"), ("top.rs", "rust"), (None, "rust"), ("w/m/n/a.rs", "rust")]
    there = [("g/.git", False), ("g/p/.git", False), ("g/Cargo.toml", False), ("g/p/q/pyproject.toml", None), ("w/Cargo.toml", True), ("w/m/Cargo.toml", True), ("w/m/n/Cargo.toml", False)]
    got = files.detect_roots(spark.createDataFrame(f, "file_path string, language string"), spark.createDataFrame(there, "path string, workspace boolean"), spark)
    want = {("g/p/q/a.rs", "rust", "g"), ("g/p/q/a.py", "python", "g/p/q"), ("g/p/q/notes", None, "g/p"), ("g/p/q/notes", "go", "g/p"), ("h/a.rs", "rust", ""), ("top.rs", "rust", ""), (None, "rust", ""), ("w/m/n/a.rs", "rust", "w")}
    assert len(got.collect()) == len(want) and {tuple(r) for r in got.collect()} == want
