"""The tree source, server symbols, the table function, tables under a manifest and state that expires."""

import datetime
import json
import os

import pytest

from structlens.operators import table_function
from structlens.sources import buckets, server, sinks, tree, worktrees
from structlens.streaming import expiry, index


def _tree(root, files):
    for name, data in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data if isinstance(data, bytes) else data.encode())


@pytest.mark.parametrize("parts", [1, 3, 64])
def test_scan_tree(spark, tmp_path, parts):
    deep = "a/b/c/d/e/f"
    _tree(tmp_path, {
        "pkg/__init__.py": "x\n", "pkg/__tests__/_t.js": "y", f"{deep}/.gitignore": "*.rs\n!keep.rs\n", f"{deep}/x.rs": "x", f"{deep}/keep.rs": "x", f"{deep}/g/h.rs": "x", "a/b/.gitignore": "/c/no.py\nbuild/\n", "a/b/c/no.py": "x",
        "a/b/c/build/z.py": "x", "a/no.py": "x", ".hidden/z.py": "x", "bad.py": b"\xff", "long.py": "z" * 50, "notes.unknown": "x",
    })
    os.symlink(tmp_path, tmp_path / "a/loop")
    os.symlink(tmp_path / "pkg/__init__.py", tmp_path / "link.py")
    spark.dataSource.register(tree.SourceTree)
    rows = spark.read.format("source_tree").option("parts", parts).option("maxBytes", 40).load(str(tmp_path)).collect()
    got = {r.file_path: r.error for r in rows}
    assert got == {"pkg/__init__.py": None, "pkg/__tests__/_t.js": None, f"{deep}/keep.rs": None, "a/no.py": None, "bad.py": "not UTF-8", "long.py": "too large"} and len(rows) == len(got)
    assert {r.file_path: r.source for r in rows}["pkg/__init__.py"] == "x\n"
    found = {r.file_path: (r.language, r.has_patterns) for r in tree.scan_tree(spark, f"file://{tmp_path}", ignore=["^pkg/__t"], gitignore=False).collect()}
    assert found["a/b/c/build/z.py"] == ("python", True) and "pkg/__tests__/_t.js" not in found and f"{deep}/x.rs" in found
    missing = tree.scan_tree(spark, str(tmp_path / "none")).collect()
    assert [(r.file_path, r.error, r.language) for r in missing] == [(".", "unreadable folder: No such file or directory", None)]


def test_server_symbols(spark):
    node = {"name": "leaf", "kind": 8, "range": {"start": {"line": 1, "character": 2}, "end": {"line": 3, "character": 4}}}
    for i in range(3000):  # no depth is too deep
        node = {"name": f"n{i}", "kind": 5, "detail": "d", "children": [node]}
    text = json.dumps({"name": "flat", "kind": 99, "containerName": "C", "location": {"uri": "u", "range": {"start": {"line": 7, "character": 0}, "end": {"line": 8, "character": 1}}}})
    deep = "[" + "".join('{"name":"n%d","kind":5,"children":[' % i for i in range(400)) + "]}" * 400 + "]"
    rows = server.server_symbols(spark.createDataFrame([("a", f"[{text}]"), ("b", deep), ("c", None), ("d", ""), ("e", "[]"), ("f", "null"), ("g", "[{}]")], "file_path string, json string")).collect()
    flat = next(r for r in rows if r.file_path == "a")
    assert (flat.kind, flat.signature, flat.scope_path, flat.line_start, flat.column_end) == ("Variable", "C", ["C"], 7, 1)
    own = sorted((r.seq, r.parent_seq, r.depth, len(r.scope_path)) for r in rows if r.file_path == "b")
    assert own == [(i, i - 1 if i else None, i, i) for i in range(400)]
    assert [(r.name, r.line_start, r.scope_path) for r in rows if r.file_path == "g"] == [(None, None, [])] and {r.file_path for r in rows} == {"a", "b", "g"}
    assert server._flat("x", [node])[-1][4] == "leaf"


def test_table_function(spark):
    table_function.register(spark)
    spark.createDataFrame([("a.rs", "rust", i, x) for i, x in enumerate(["impl A {", "  fn f() {", "  }", "}"])] + [("b.py", "python", 0, "def g(): pass")], "file_path string, language string, line_no int, text string").createOrReplaceTempView("tf_lines")
    full = spark.sql("SELECT * FROM extract_symbols(TABLE(tf_lines) PARTITION BY (file_path) ORDER BY (line_no))")
    assert {(r.file_path, r.kind, r.name, r.line_end, r.depth) for r in full.collect()} == {("a.rs", "Struct", "A", 3, 0), ("a.rs", "Function", "f", 2, 0), ("a.rs", "Method", "f", 2, 1), ("b.py", "Function", "g", 0, 0)}
    assert spark.sql("SELECT * FROM extract_symbols(TABLE(tf_lines) PARTITION BY (file_path) ORDER BY (line_no), 'outline')").columns == table_function.DETAILS["outline"]
    with pytest.raises(Exception, match="detail is one of"):
        spark.sql("SELECT * FROM extract_symbols(TABLE(tf_lines) PARTITION BY (file_path), 'all')").collect()
    with pytest.raises(Exception, match="needs a table with the columns"):
        spark.sql("SELECT * FROM extract_symbols(TABLE(SELECT 1 AS x) PARTITION BY (x))").collect()


def test_a_commit_writes_what_it_touches(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = lambda rows: spark.createDataFrame(rows, "path string, n int")
    sinks.write_version(frame([(f"p{i}", 0) for i in range(200)]), path, prune=True, keys=["path"])
    want = {f"p{i}": 0 for i in range(200)}
    for n in range(1, 13):
        sinks.write_version(frame([(f"p{n}", n)]), path, prune=False, keys=["path"])
        want[f"p{n}"] = n
        assert len(list((tmp_path / "t" / f"v={n + 1}").glob("bucket=*"))) == 1
        # whatever number of commits: two manifests, and no folder that neither names
        assert buckets.numbers(spark, path) == [n, n + 1]
        live = [set(json.loads((tmp_path / "t" / "_manifest" / f"{k}.json").read_text())["live"].values()) for k in (n, n + 1)]
        assert {str(b.relative_to(tmp_path / "t")) for b in (tmp_path / "t").glob("v=*/bucket=*")} == live[0] | live[1]
    assert {r.path: r.n for r in sinks.read_version(spark, path).collect()} == want


def test_a_crash_before_the_manifest_loses_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    frame = lambda rows: spark.createDataFrame(rows, "path string, n int")
    sinks.write_version(frame([("a", 1), ("b", 1)]), path, prune=True, keys=["path"])

    def crash(*_):
        raise OSError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(buckets, "_publish", crash)
        with pytest.raises(OSError):
            sinks.write_version(frame([("b", 2)]), path, prune=False, keys=["path"])
    assert {tuple(r) for r in sinks.read_version(spark, path).collect()} == {("a", 1), ("b", 1)}
    sinks.write_version(frame([("b", 3)]), path, prune=False, keys=["path"])
    assert {tuple(r) for r in sinks.read_version(spark, path).collect()} == {("a", 1), ("b", 3)}


def test_summaries_expire(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    batches = [[("a", 0, "1"), ("a", 299, "2"), ("b", 10, "3")], [("a", 300, "4"), ("b", 311, "5"), ("b", 312, "6")], [("a", 599, "7"), ("a", 90_000, "8"), ("c", 90_000, "9")], [("a", 90_001, "10")]]
    for rows in batches:
        spark.createDataFrame([(k, at(s), x) for k, s, x in rows], "key string, asked timestamp, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("key string, asked timestamp, text string").parquet(str(tmp_path / "in"))
        expiry.served_summaries(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
    got = {(r.key, r.asked, r.text, r.cached) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = [("a", 0, "1", False), ("a", 299, "1", True), ("b", 10, "3", False), ("a", 300, "4", False), ("b", 311, "5", False), ("b", 312, "5", True), ("a", 599, "4", True), ("a", 90_000, "8", False), ("c", 90_000, "9", False), ("a", 90_001, "8", True)]
    assert got == {(k, at(s), x, c) for k, s, x, c in want}


def test_batches_read_one_manifest(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    schema = index.SCHEMA
    for n in range(4):
        spark.createDataFrame([(f"p{n}", at, "s", "c", False)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        index.merge_batches(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "ix"), str(tmp_path / "ck"), n_buckets=4).awaitTermination(120)
    assert sorted(p.name for p in (tmp_path / "ix" / "_manifest").glob("[0-9]*.json")) == ["2.json", "3.json"]
    assert {r.path for r in index.read_merged(spark, str(tmp_path / "ix")).collect()} == {"p0", "p1", "p2", "p3"}


def test_worktrees(spark):
    roots = spark.createDataFrame([("/w/a/x/y",), ("/w/b",), ("/z",)], "root string")
    listing = [("/w/a/.git", True, None), ("/w/a/.git/HEAD", False, "main"), ("/w/a/x/.git", False, "gitdir: ../.git/worktrees/x \n"), ("/w/a/.git/worktrees/x/HEAD", False, "h"), ("/w/b/.git", False, "gitdir: /gone"), ("/w/.git", True, None), ("/w/.git/HEAD", False, "up")]
    got = {r.root: (r.git_dir, r.head, r.worktree_id) for r in worktrees.worktrees(roots, spark.createDataFrame(listing, "path string, is_dir boolean, content string")).collect()}
    assert got == {"/w/a/x/y": ("/w/a/.git/worktrees/x", "h", "x"), "/w/b": (None, None, None), "/z": (None, None, None)}
