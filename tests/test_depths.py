"""Long chains and deep blocks, which no limit of ours may cut."""

import inspect

import pytest

from structlens.operators import graph, symbols


def test_a_limit_of_steps_is_never_silent(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(5)], "source int, target int").coalesce(1)
    seeds = spark.createDataFrame([(0,)], "seed int")
    assert inspect.signature(graph.reachable).parameters["most_steps"].default is None
    assert sorted((r.node, r.distance) for r in graph.reachable(edges, seeds, most_steps=5).collect()) == [(i, i) for i in range(6)]
    with pytest.raises(RuntimeError):
        graph.reachable(edges, seeds, most_steps=3)


def _ends(spark, source, language):
    lines = spark.createDataFrame([("f", language, i, t) for i, t in enumerate(source)], "file_path string, language string, line_no int, text string")
    return [r.line_end for r in symbols.block_ends(lines).orderBy("line_no").collect()]


def test_brackets_beyond_the_windows(spark):
    n = 30
    source = ["{"] * n + ["x"] + ["}"] * n
    assert _ends(spark, source, "rust")[:n] == [2 * n - i for i in range(n)]


def test_indentation_beyond_the_windows(spark):
    n = 20
    source = [" " * 4 * i + "if x:" for i in range(n)] + [" " * 4 * n + "y"] + [" " * 4 * i + "z" for i in reversed(range(n))]
    assert _ends(spark, source, "python")[:n] == [2 * n - i - 1 for i in range(n)]
