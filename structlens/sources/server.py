"""Symbols as language servers send them, as rows."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..session import ship

SCHEMA = "file_path string, seq int, parent_seq int, depth int, name string, kind string, line_start int, line_end int, column_start int, column_end int, signature string, scope_path array<string>"


def _flat(path: str, tree: list[dict]) -> list[tuple]:
    """Preorder by a stack, so that no depth is too deep."""
    out, stack = [], [(node, None, 0, []) for node in reversed(tree)]
    while stack:
        node, parent, depth, scope = stack.pop()
        place, holder = node.get("location"), node.get("containerName")
        if place:  # the flat form, which names its container
            scope = [holder] if holder else []
        span = (place or node).get("range") or {}
        start, end = span.get("start") or {}, span.get("end") or {}
        name, seq = node.get("name"), len(out)
        out.append((path, seq, parent, depth, name, fixed.SERVER_KINDS.get(node.get("kind"), "Variable"), start.get("line"), end.get("line"), start.get("character"), end.get("character"), holder if place else node.get("detail"), scope))
        stack += [(child, seq, depth + 1, [*scope, name]) for child in reversed(node.get("children") or [])]
    return out


def server_symbols(answers: DataFrame) -> DataFrame:
    """Rows in preorder of answers (file_path, json): arrays of nested symbols of any depth, or of flat ones with their containers.

    A null answer or an empty one has no rows; missing fields are null; scopes are the names above.
    """
    ship(answers.sparkSession)
    kinds = {"int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in SCHEMA.split(", ")])

    def work(batches):
        for batch in batches:
            for path, answer in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = _flat(path, (json.loads(answer) if answer else None) or [])
                for at in range(0, len(rows), 8192):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + 8192], strict=True), schema, strict=True)], schema=schema)

    return answers.select(F.col("file_path").cast("string"), F.col("json").cast("string")).mapInArrow(work, SCHEMA)
