"""Symbols from small source texts of our own."""

import pytest
from pyspark.sql import functions as F

from structlens.operators import graph, read, symbols

RUST = """use std::fmt;

/// A shop.
#[derive(Debug)]
pub struct Shop {
    stock: u32,
}

impl Shop {
    /// Opens it.
    pub fn open(&mut self, hour: u32) -> bool {
        if hour > 8 && self.stock > 0 {
            return true;
        }
        false
    }

    fn shut(&self) {
    }
}

pub enum Mood { Good, Bad }

trait Sells {
    fn sell(&self);
}

const LIMIT: u32 = 3;

#[test]
fn test_open() {
    helper(1);
}

fn helper(n: u32) {
}
"""
PYTHON = """import os
from sys import path


class Dog:
    def bark(self):
        return 1

    def sit(self, n):
        if n:
            return 2


def main():
    print(Dog())
"""


@pytest.fixture(scope="module")
def found(spark):
    files = spark.createDataFrame([("a/shop.rs", RUST), ("a/dog.py", PYTHON)], "file_path string, source string")
    return symbols.from_files(spark, files).cache()


def _of(found, path):
    return {(r.kind, r.name, r.line_start, r.line_end) for r in found.where(f"file_path = '{path}'").collect()}


def test_rust(found):
    got = _of(found, "a/shop.rs")
    assert {("Struct", "Shop", 4, 6), ("Struct", "Shop", 8, 19), ("Function", "open", 10, 15), ("Method", "open", 10, 15), ("Method", "shut", 17, 18), ("Enum", "Mood", 21, 21)} <= got
    assert {k for k, n, _, _ in got if n == "Sells"} == {"Trait"}
    assert {k for k, n, _, _ in got if n == "LIMIT"} == {"Constant"}
    assert any(k == "Import" and n.startswith("use std::fmt") for k, n, _, _ in got)


def test_methods_have_scope_parent_and_comment(found):
    row = found.where("kind = 'Method' AND name = 'open'").first()
    assert row.scope_path == ["Shop"] and row.depth == 1 and row.qualified_name == "Shop::open"
    assert row.doc_comment == "/// Opens it." and row.signature.startswith("pub fn open(&mut self, hour: u32) -> bool")
    parent = found.where(f"file_path = 'a/shop.rs' AND seq = {row.parent_seq}").first()
    assert parent.name == "Shop" and parent.line_start < row.line_start <= parent.line_end


def test_python_blocks_end_by_indentation(found):
    got = _of(found, "a/dog.py")
    assert ("Class", "Dog", 4, 10) in got and ("Function", "bark", 5, 6) in got and ("Function", "sit", 8, 10) in got and ("Function", "main", 13, 14) in got
    assert sum(k == "Import" for k, *_ in got) == 2


def test_read_queries_on_real_source(spark, found):
    from structlens.sources.files import explode_lines

    files = spark.createDataFrame([("a/shop.rs", RUST), ("a/dog.py", PYTHON)], "file_path string, source string")
    lines = explode_lines(files)
    assert {r.name for r in read.get_tests(found, lines).collect()} == {"test_open", "helper"}  # the mark counts for five lines
    c = {r.name: r.complexity for r in read.complexity(found.where("kind = 'Function'"), lines).collect()}
    assert c["open"] == 3 and c["helper"] == 1
    sites = {(r.name, r.column) for r in read.call_columns(lines).where("file_path = 'a/dog.py' AND line_no = 14").collect()}
    assert sites == {("print", 4), ("Dog", 10)}
    p = [(r.parameter, r.type) for r in read.get_parameters(found.where("name = 'open' AND kind = 'Method'")).collect()]
    assert p == [("hour", "u32")]
    assert {r.name for r in read.get_exports(found.where("file_path = 'a/shop.rs' AND kind IN ('Struct', 'Enum', 'Method')")).collect()} == {"Shop", "Mood", "open"}


def test_graph_of_source(found):
    nodes = {r.name: r.labels for r in graph.build_nodes(found, "p").collect()}
    assert nodes["a/dog.py::Dog"] == ["class", "type"] and nodes["a/dog.py"] == ["file"]
    edges = {(r.source, r.target, r.relation) for r in graph.build_edges(found, "p").collect()}
    assert ("a/shop.rs::Shop", "a/shop.rs::Shop::open", "contains") in edges
    assert any(r == "imports" and s == "a/dog.py" for s, _, r in edges)


@pytest.mark.parametrize(
    ("path", "source", "kind", "name"),
    [
        ("x.go", "type Cat struct {\n}\n", "Type", "Cat"), ("x.go", "func Run(a int) {\n}\n", "Function", "Run"), ("x.java", "public class Cat {\n  void run() {\n  }\n}\n", "Function", "run"),
        ("x.c", "int run(int a)\n{\n  return a;\n}\n", "Function", "run"), ("x.cpp", "namespace zoo {\nclass Cat {\n};\n}\n", "Class", "Cat"), ("x.rb", "module Zoo\n  def run\n  end\nend\n", "Function", "run"),
        ("x.php", "interface Cat {\n}\n", "Trait", "Cat"), ("x.sh", "run() {\n  x=1\n}\n", "Function", "run"), ("x.ts", "export class Cat {\n}\n", "Class", "Cat"), ("x.lua", "function run()\nend\n", "Function", "run"),
        ("x.kt", "class Cat {\n}\n", "Class", "Cat"), ("x.swift", "protocol Cat {\n}\n", "Trait", "Cat"), ("x.zig", "pub fn run() void {\n}\n", "Function", "run"), ("x.hs", "run :: Int -> Int\n", "Function", "run"), ("x.cs", "public struct Cat {\n}\n", "Struct", "Cat"), ("x.ex", "defmodule Cat do\nend\n", "Module", "Cat"),
    ],
)
def test_languages(spark, path, source, kind, name):
    rows = symbols.from_files(spark, spark.createDataFrame([(path, source)], "file_path string, source string")).collect()
    assert (kind, name) in {(r.kind, r.name) for r in rows}


def _wide(spark, n):
    """A module of n classes of different names, each with a method; the last class has a method of its own too."""
    row = "file_path string, seq int, parent_seq int, name string, kind string"
    rows = [("a.rs", 0, None, "top", "Module")]
    for i in range(n):
        rows += [("a.rs", 2 * i + 1, 0, f"C{i:04d}", "Class"), ("a.rs", 2 * i + 2, 2 * i + 1, f"run{i % 3}", "Method")]
    return spark.createDataFrame([*rows, ("a.rs", 2 * n + 1, 2 * n - 1, "own", "Method"), ("b.rs", 0, None, "alone", "Class")], row)


def test_enclosing_class_of_many_names(spark):
    got = {(r.file_path, r.method): (r.class_name, r.class_kind, r.members) for r in read.enclosing_class(_wide(spark, 1000)).collect()}
    every = ",".join(f"C{i:04d}" for i in range(1000))
    want = {("a.rs", f"C{i:04d}"): ("top", "Module", every) for i in range(1000)}
    want |= {("a.rs", f"run{k}"): (f"C{k:04d}", "Class", f"run{k}") for k in range(3)} | {("a.rs", "own"): ("C0999", "Class", "run0,own")}
    assert got == want


def test_enclosing_class_deals_the_rows_of_one_symbol(spark):
    held = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        out = read.enclosing_class(_wide(spark, 2000))
        sizes = out.where("class_name = 'top'").groupBy(F.spark_partition_id()).count().collect()
        plan = out._jdf.queryExecution().optimizedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(r["count"] for r in sizes) == 2000 and max(r["count"] for r in sizes) <= 1200
    # the lists come to the last join as texts, and none is made in each of its rows
    assert plan.index("Join Inner") < plan.index("array_join")


def test_enclosing_class_gives_a_task_one_long_list(spark):
    row = "file_path string, seq int, parent_seq int, name string, kind string"
    rows = [(f"{f}.rs", i, 0 if i else None, f"C{i:05d}" if i else f"top{f}", "Class" if i else "Module") for f in range(3) for i in range(1201)]
    rows += [(f"s{f}.rs", i, 0 if i else None, f"run{i}", "Method" if i else "Class") for f in range(20) for i in range(3)]
    out = read.enclosing_class(spark.createDataFrame(rows, row))
    tasks = out.groupBy(F.spark_partition_id().alias("task"), "class_name", "class_kind").count().collect()
    long = [r for r in tasks if r["class_kind"] == "Module"]
    # a writer that holds a run of equal lists cheaply meets no other long list behind it
    assert sum(r["count"] for r in long) == 3600 and len({r["task"] for r in long}) == len(long)
    assert not {r["task"] for r in long} & {r["task"] for r in tasks if r["class_kind"] == "Class"}
    every = ",".join(f"C{i:05d}" for i in range(1, 1201))
    assert {(r.file_path, r.method) for r in out.where(F.col("members") == every).select("file_path", "method").collect()} == {(f"{f}.rs", f"C{i:05d}") for f in range(3) for i in range(1, 1201)}
    assert {(r.file_path, r.method, r.members) for r in out.where("class_kind = 'Class'").collect()} == {(f"s{f}.rs", f"run{i}", "run1,run2") for f in range(20) for i in (1, 2)}
