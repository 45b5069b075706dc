"""The pipeline: every stage on its own input, and the guard around the subpackage."""

import subprocess
import sys
from pathlib import Path

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from structlens.llm import _work, simhash  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = _work.keep(stage(spark, before, FOLDER), name)
        assert after.columns == columns
        if name in ("toxicity", "simhash"):
            assert after.join(before, columns, "left_anti").where("text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL").count() == 0
        if name == "simhash":
            found = simhash.near_duplicates(before).collect()
            assert {r.doc_id for r in after.collect()} == {r.component_id for r in found}
        if name == "substring":
            assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, before, FOLDER).collect()
    assert {r.doc_id for r in last} == {r.doc_id for r in before.where("text <> ''").collect()}
    assert all(r.n_words <= 2048 for r in last)
    whole = corpus_pipeline.run(spark, FOLDER).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, last))


def test_awkward_and_empty_tables(spark, awkward, empty, tmp_path):
    import re

    labels = spark.createDataFrame([(5, 1, None), (14, 0, 1), (14, 0, 1), (None, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    for name, docs in (("awkward", awkward), ("empty", empty)):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
        before = docs
        for stage, function in corpus_pipeline.STAGES[:-1]:
            after = _work.keep(function(spark, before, str(tmp_path / name)), stage)
            assert after.columns == docs.columns
            before = after
        words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in before.collect()}
        rows = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert {r.doc_id for r in rows} == {i for i, n in words.items() if n} and all(0 < r.n_words <= 2048 for r in rows)
        assert (name == "awkward") == bool(rows)


def test_the_rest_imports_without_the_subpackage(tmp_path):
    root = Path(corpus_pipeline.__file__).parent
    subprocess.run(["cp", "-r", str(root / "structlens"), str(root / "__spark_entry__.py"), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "structlens" / "llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(k.startswith('op1_') or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
