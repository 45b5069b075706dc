"""Token counts of documents in flat, unindexed token files, by scanning for separators.

A flat file is nothing but token ids as little-endian unsigned integers of ``width`` bytes (two for vocabularies of
up to 65,536 ids, else four), each document followed by the end id. Files are cut into blocks of ``block_tokens``; any task reads any block by its byte range, finds
all end ids with one vectorised comparison, and reports them with a one-row summary. A prefix scan over the
summaries (running maximum of the last separator, running sum of the number of separators; within a file over its
blocks, then over files in name order) carries into every block where its first document began and which document
it is, so a document may span any number of blocks, and a file any number of tasks.

Files are written by Spark's own committing writer, so a lost executor leaves no partial file. Blocks are read by their byte ranges, with a block's
memory, from every file system that Arrow knows (``RANGED``); from others Spark's own reader brings whole files, which the task cuts into
blocks, so these should be of moderate size.

The flat files know nothing of documents' ids: the same tasks write them, in the same order, beside them
(``kind=ids``), so that a count can be given to its document.

Defined results: a null or empty text is a document of no tokens; two separators in a row enclose one; tokens after the
last separator of a file are a document that isn't ended (``ended`` false); an empty file has no documents; a
file whose size is no multiple of the width is an error; repeated rows are repeated documents; an end id that the
tokenizer also gives inside a text can't be told from an end, as in any such file.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import spread
from . import _work
from .token_output import encoded

BLOCK_TOKENS = 1 << 20
#: Schemes of paths whose files are read by ranges.
RANGED = ("file", "hdfs", "viewfs", "s3", "s3a", "gs", "gcs", "abfs", "abfss")
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def write_flat(docs: DataFrame, tokenizer_path: str, out: str, *, end_id: int = 2, width: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all documents, in the order in which they are read, into flat files in ``out``; nothing is shuffled
    (but an input so small that it would not use the cores).

    The text writer puts the raw bytes of a column and its line separator one after another; with the end id
    as separator (its bytes have to be ASCII) that is the flat format.
    """
    separator = int(end_id).to_bytes(width, "little")
    if not separator.isascii():
        raise ValueError("the end id's bytes must be ASCII")

    def encode(batches):
        for rows, offsets, ids in encoded(batches, 1, tokenizer_path, None):
            if width == 2 and len(ids) and ids.max() >= 1 << 16:
                raise ValueError("an id doesn't fit into two bytes")
            data = ids.astype(f"<u{width}")
            column = pa.Array.from_buffers(pa.binary(), rows.num_rows, [None, pa.py_buffer((offsets * width).astype(np.int32)), pa.py_buffer(data)])
            names = pc.fill_null(rows.column(0).cast(pa.string()), "").cast(pa.binary())
            for kind, values in (("flat", column), ("ids", names)):
                yield pa.RecordBatch.from_arrays([values, pa.array([kind] * rows.num_rows)], names=["value", "kind"])

    spark = docs.sparkSession
    rows = spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))).mapInArrow(encode, "value binary, kind string")
    # with a writer a kind, rows are written as they come; otherwise they would be sorted by kind first
    before = spark.conf.get(_WRITERS)
    spark.conf.set(_WRITERS, "2")
    try:
        rows.select(F.col("value").cast("string").alias("value"), "kind").write.partitionBy("kind").option("lineSep", separator.decode("ascii")).option("compression", "none").text(out)
    finally:
        spark.conf.set(_WRITERS, before)


def flat_files(spark: SparkSession, path: str) -> DataFrame:
    """path, size and content of every flat file; content is read only where it is asked for."""
    listed = spark.read.format("binaryFile").load(path)
    listed = listed.where("kind = 'flat'") if "kind" in listed.columns else listed
    return listed.select("path", F.col("length").alias("size"), "content")


def file_number(path: Column) -> Column:
    return F.regexp_extract(path, r"part-(\d+)[^/]*$", 1).cast("int")


def document_ids(spark: SparkSession, path: str, *, end_id: int = 2, width: int = 2) -> DataFrame:
    """file, nth, doc_id: which document is the nth of each flat file, as :func:`write_flat` noted it."""
    listed = spark.read.format("text").option("wholetext", "true").load(path)
    if "kind" not in listed.columns:
        return spark.createDataFrame([], "file int, nth long, doc_id long")
    separator = int(end_id).to_bytes(width, "little").decode("ascii")
    # every entry ends with a separator, so the last part is none
    parts = F.split("value", separator)
    rows = listed.where("kind = 'ids'").select(file_number(F.col("_metadata.file_path")).alias("file"), F.posexplode(F.slice(parts, 1, F.size(parts) - 1)).alias("nth", "d"))
    return rows.select("file", F.col("nth").cast("long").alias("nth"), F.when(F.col("d") != "", F.col("d")).cast("long").alias("doc_id"))


def blocks(files: DataFrame, block_tokens: int = BLOCK_TOKENS, width: int = 2) -> DataFrame:
    """path, block, first (token), tokens."""
    per = F.lit(block_tokens).cast("long")
    tokens = F.when(F.col("size") % width == 0, F.expr(f"size div {width}")).otherwise(F.raise_error(F.concat(F.lit(f"not a file of ids of {width} bytes: "), F.col("path"))).cast("long"))
    n = F.ceil(F.col("all") / per)
    rows = files.select("path", tokens.alias("all")).where("all > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    return rows.select("path", "block", (F.col("block") * per).alias("first"), F.least(per, F.col("all") - F.col("block") * per).alias("tokens"))


def _found(path: str, block: int, first: int, ids: np.ndarray, end_id: int) -> pa.RecordBatch:
    """The end ids of one block, with its summary."""
    at = first + np.flatnonzero(ids == end_id)
    lists = pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), pa.array(at))
    last = pa.array([int(at[-1]) if len(at) else None], pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([block]), pa.array([len(ids)]), pa.array([len(at)], pa.int64()), last, lists], names=["path", "block", "tokens", "n", "last", "ends"])


def _scan_whole(end_id: int, width: int, block_tokens: int):
    """Blocks of files whose content comes with them."""

    def work(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                path, data = batch.column(0)[row].as_py(), batch.column(1)[row].as_buffer()
                if data.size % width:
                    raise ValueError(f"not a file of ids of {width} bytes: {path}")
                ids = np.frombuffer(data, f"<u{width}")
                for block, at in enumerate(range(0, len(ids), block_tokens)):
                    yield _found(path, block, at, ids[at : at + block_tokens], end_id)

    return work


def _scan_ranges(end_id: int, width: int):
    """Blocks read by their byte ranges."""

    def work(batches):
        for batch in batches:
            for path, block, first, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                where, name = fs.FileSystem.from_uri(path.replace("file:///", "/", 1) if path.startswith("file:///") else path.replace("file:/", "/", 1) if path.startswith("file:/") else re.sub("^s3a:", "s3:", path))
                with where.open_input_file(name) as f:
                    yield _found(path, block, first, np.frombuffer(f.read_at(width * tokens, width * first), f"<u{width}"), end_id)

    return work


def documents(files: DataFrame, *, end_id: int = 2, width: int = 2, block_tokens: int = BLOCK_TOKENS, ranged: Sequence[str] = RANGED) -> DataFrame:
    """path, ordinal (over all files, in name order), nth (in its file), start (token in its file), n_tokens (without the end
    id) and ended."""
    schema = "path string, block long, tokens long, n long, last long, ends array<long>"
    by_range = F.regexp_extract("path", "^([a-z0-9]+):", 1).isin("", *ranged)
    cut = blocks(files.where(by_range).select("path", "size"), block_tokens, width)
    found = cut.repartition("path", "block").mapInArrow(_scan_ranges(end_id, width), schema)
    # asked of the listing first: a plan with contents reads them, whatever is left of them
    if files.where(~by_range).select("path").take(1):
        found = found.unionByName(files.where(~by_range).select("path", "content").mapInArrow(_scan_whole(end_id, width, block_tokens), schema))
    with _work.batches_of(files.sparkSession, 1):  # a file is a row
        found = _work.keep(found, "separators")
    summary = found.select("path", "block", "tokens", "n", "last")
    ahead = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = summary.select("path", "block", F.coalesce(F.max("last").over(ahead) + 1, F.lit(0)).alias("begin"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    whole = summary.groupBy("path").agg(F.sum("n").alias("n"), F.max("last").alias("last"), F.sum("tokens").alias("tokens"), F.max("block").alias("last_block"))
    open_end = F.coalesce(F.col("last") + 1, F.lit(0)) < F.col("tokens")
    # one row a file: the scan over files
    by_name = W.orderBy("path").rowsBetween(W.unboundedPreceding, -1)
    whole = whole.select(F.col("path").alias("w_path"), "last_block", open_end.alias("open"), F.col("tokens").alias("all"), F.coalesce(F.sum(F.col("n") + open_end.cast("long")).over(by_name), F.lit(0)).alias("files_before"))
    carried = carried.join(whole, carried["path"] == whole["w_path"]).select(F.col("path").alias("c_path"), F.col("block").alias("c_block"), "begin", (F.col("before") + F.col("files_before")).alias("ordinal"), "before", ((F.col("block") == F.col("last_block")) & F.col("open")).alias("open"), "all")
    both = found.join(carried, (found["path"] == carried["c_path"]) & (found["block"] == carried["c_block"]))

    def split(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                path, begin, ordinal, before, open_, n_all = (batch.column(k)[at].as_py() for k in range(6))
                ends = batch.column(6)[at].values.to_numpy()
                stops = np.append(ends, n_all) if open_ else ends
                starts = np.append(begin, ends + 1)[: len(stops)]
                ended = np.ones(len(stops), bool)
                if open_:
                    ended[-1] = False
                if len(stops):
                    yield pa.RecordBatch.from_arrays([pa.array([path]).take(pa.array(np.zeros(len(stops), np.int64))), pa.array(ordinal + np.arange(len(stops))), pa.array(before + np.arange(len(stops))), pa.array(starts.astype(np.int64)), pa.array((stops - starts).astype(np.int64)), pa.array(ended)], names=["path", "ordinal", "nth", "start", "n_tokens", "ended"])

    return both.select("path", "begin", "ordinal", "before", "open", "all", "ends").mapInArrow(split, "path string, ordinal long, nth long, start long, n_tokens long, ended boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as flat token files, and what a scan of the files finds in them, with the documents' ids."""
    import public_tokenizers

    out = _work.folder(spark, "flat")
    write_flat(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), out)
    found = documents(flat_files(spark, out))
    found = found.withColumn("file", file_number(F.col("path"))).drop("path")
    return found.join(document_ids(spark, out), ["file", "nth"], "left").select("doc_id", "ordinal", "file", "start", "n_tokens", "ended")
