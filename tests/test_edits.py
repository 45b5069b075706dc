"""Edits against plain list operations."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from structlens.operators import edit
from structlens.sources.sinks import rebuild_text

LINES = "file_path string, line_no int, text string"


def _frame(spark, files):
    return spark.createDataFrame([(f, i, x) for f, xs in files.items() for i, x in enumerate(xs)], LINES)


def _back(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.file_path, r.line_no)):
        out.setdefault(r.file_path, []).append(r.text)
    return out


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab", max_size=2), min_size=2, max_size=9), st.data())
def test_replace_then_put_back(spark, lines, data):
    a = data.draw(st.integers(1, len(lines)))
    z = data.draw(st.integers(a, len(lines)))
    e = spark.createDataFrame([("f", a, z, "x\ny")], "file_path string, start_line int, end_line int, content string")
    once = edit.replace_lines(_frame(spark, {"f": lines, "g": ["k"]}), e)
    assert _back(once) == {"f": [*lines[: a - 1], "x", "y", *lines[z:]], "g": ["k"]}
    undo = spark.createDataFrame([("f", a, a + 1, "\n".join(lines[a - 1 : z]))], "file_path string, start_line int, end_line int, content string")
    assert _back(edit.replace_lines(once, undo)) == {"f": lines, "g": ["k"]}


def test_out_of_bounds_raises(spark):
    e = spark.createDataFrame([("f", 2, 5, "x")], "file_path string, start_line int, end_line int, content string")
    with pytest.raises(Exception, match="out of bounds"):
        edit.replace_lines(_frame(spark, {"f": ["a", "b"]}), e).collect()


def test_inserts_and_deletions_out_of_bounds_raise(spark):
    lines = _frame(spark, {"f": ["a", "b"]})
    at = lambda n: spark.createDataFrame([("f", n, "x")], "file_path string, line int, content string")
    assert _back(edit.insert_at_line(lines, at(3))) == {"f": ["a", "b", "x"]}
    for n in (0, 4):
        with pytest.raises(Exception, match="out of bounds"):
            edit.insert_at_line(lines, at(n)).collect()
    for a, z in ((0, 1), (2, 1), (1, 3)):
        with pytest.raises(Exception, match="out of bounds"):
            edit.delete_lines(lines, spark.createDataFrame([("f", a, z)], "file_path string, start_line int, end_line int")).collect()


def test_move_symbol(spark):
    lines = _frame(spark, {"a": ["one", "fn x", "body", "two"], "b": ["fn y", "end"]})
    sym = spark.createDataFrame([("a", "x", 1, 2, 0), ("b", "y", 0, 1, 0)], "file_path string, name string, line_start int, line_end int, seq int")
    moves = spark.createDataFrame([("a", "x", "b", "y")], "source_file string, symbol string, target_file string, target_symbol string")
    assert _back(edit.move_symbol(lines, sym, moves)) == {"a": ["one", "two"], "b": ["fn y", "end", "", "fn x", "body"]}
    assert _back(edit.copy_symbol(lines, sym, moves, after=False)) == {"a": ["one", "fn x", "body", "two"], "b": ["fn x", "body", "", "fn y", "end"]}


def test_create_and_resources(spark):
    lines = _frame(spark, {"a": ["one"]})
    new = spark.createDataFrame([("a", "new"), ("c", "p\nq")], "file_path string, content string")
    assert _back(edit.create_file(lines, new)) == {"a": ["one"], "c": ["p", "q"]}
    assert _back(edit.create_file(lines, new, overwrite=True)) == {"a": ["new"], "c": ["p", "q"]}
    ops = spark.createDataFrame([("rename", "a", "b"), ("create", "z", None), ("delete", "k", None)], "op string, path string, new_path string")
    files = spark.createDataFrame([("a",), ("k",), ("m",)], "file_path string")
    assert {r.file_path for r in edit.resource_operations(files, ops).collect()} == {"b", "m", "z"}


def test_overlap_rejects_the_file(spark):
    files = spark.createDataFrame([("a", "0123456789"), ("b", "0123456789")], "file_path string, source string")
    e = spark.createDataFrame([("a", 1, 4, "X"), ("a", 3, 5, "Y"), ("b", 1, 4, "X"), ("b", 4, 5, "")], "file_path string, start int, end int, new_text string")
    assert {r.file_path: r.source for r in edit.apply_edits(files, e).collect()} == {"a": "0123456789", "b": "0X56789"}


def test_rebuild(spark):
    assert rebuild_text(_frame(spark, {"a": ["x", "y"]}), "\r\n").first().source == "x\r\ny\r\n"
