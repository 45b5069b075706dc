"""Token output and the separator scan, against the tokenizer itself."""

import glob
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from awkward_data import awkward_rows
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
import public_tokenizers  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from structlens.llm import _work, separator_scan, token_output  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tk():
    return Tokenizer.from_file(PATH)


def _ids(tk, text):
    return tk.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_library(tk):
    texts = ["", " a", "a ", "a  b", "a\n b", "a \nb", "a b c", "x.,y z.", "don't we'll it's, o'clock.", "éa. ß, 漢字。 😀.", "<|endoftext|>", "a<|endoftext|> b. <|endoftext|>,", "٣. ²,", "#, #. ...", "\x1c q \x1c. r", "n\n\n\nm. k\n", "a." * 50, "tab\tx y"]
    encode = token_output.PieceEncoder(PATH)
    for _ in range(2):  # cold and from the store
        offsets, ids = encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == [_ids(tk, t) for t in texts]
    encode._forget()
    offsets, ids = encode(pa.array(texts), 7)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == [[*_ids(tk, t), 7] for t in texts]


def test_index_of_awkward_rows(spark, awkward, tk):
    out = _work.folder(spark, "t")
    token_output.write_tokens(awkward, PATH, out)
    got = token_output.token_index(spark, out).collect()
    want = sorted((-1 if r[0] is None else r[0], [*_ids(tk, r[1]), 2]) for r in awkward_rows())
    at, rows = 0, []
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
        rows.append((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32))
    assert [x[0] for x in rows] == [x[0] for x in want]
    assert sorted(rows) == sorted((i, len(t), zlib.crc32(np.asarray(t, "<u4").tobytes())) for i, t in want)


def test_file_format_and_selective_reads(spark, awkward):
    out = _work.folder(spark, "t")
    token_output.write_tokens(awkward, PATH, out)
    files = [f for f in glob.glob(out.removeprefix("file://") + "/*.parquet") if pq.ParquetFile(f).metadata.num_row_groups]
    meta = pq.ParquetFile(files[0]).metadata.row_group(0)
    cols = {meta.column(i).path_in_schema: meta.column(i) for i in range(meta.num_columns)}
    assert "DELTA_BINARY_PACKED" in cols["doc_id"].encodings and "DELTA_BINARY_PACKED" in cols["token_ids.list.element"].encodings
    assert all(c.has_offset_index for c in cols.values()) and cols["doc_id"].has_column_index
    plan = token_output.read_tokens(spark, out).where("doc_id = 5").select("n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,5)" in plan and "token_ids" not in plan.split("ReadSchema")[1]


def test_dictionary_encoding(spark, awkward):
    out = _work.folder(spark, "t")
    token_output.write_tokens(awkward, PATH, out, ids_encoding="dictionary")
    found = set()
    for f in glob.glob(out.removeprefix("file://") + "/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            found |= {e for i in range(meta.num_columns) if meta.row_group(g).column(i).path_in_schema == "token_ids.list.element" for e in meta.row_group(g).column(i).encodings}
    assert "RLE_DICTIONARY" in found


def test_empty(spark, empty):
    out = _work.folder(spark, "t")
    token_output.write_tokens(empty, PATH, out)
    assert token_output.token_index(spark, out).count() == 0
    flat = _work.folder(spark, "f")
    separator_scan.write_flat(empty, PATH, flat)
    assert separator_scan.documents(separator_scan.flat_files(spark, flat)).count() == 0


@pytest.mark.parametrize("width", [2, 4])
def test_flat_files_of_awkward_rows(spark, awkward, tk, width):
    out = _work.folder(spark, "f")
    separator_scan.write_flat(awkward, PATH, out, width=width)
    got = separator_scan.documents(separator_scan.flat_files(spark, out), width=width, block_tokens=37).collect()
    assert sorted(r.n_tokens for r in got) == sorted(len(_ids(tk, r[1])) for r in awkward_rows()) and all(r.ended for r in got)
    assert sorted(r.ordinal for r in got) == list(range(len(got)))


def test_counts_are_given_to_their_documents(spark, awkward, tk):
    out = _work.folder(spark, "f")
    separator_scan.write_flat(awkward, PATH, out)
    found = separator_scan.documents(separator_scan.flat_files(spark, out), block_tokens=50).withColumn("file", separator_scan.file_number(F.col("path")))
    got = found.join(separator_scan.document_ids(spark, out), ["file", "nth"]).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in got) == sorted((-1 if r[0] is None else r[0], len(_ids(tk, r[1]))) for r in awkward_rows())


@pytest.mark.parametrize("ranged", [(), ("file",)])
@pytest.mark.parametrize("block", [1, 3, 1000])
def test_scan_of_any_blocks(spark, tmp_path, block, ranged):
    rng = np.random.default_rng(block)
    want = []
    for k, n in enumerate([0, 1, 50, 200]):
        ids = rng.choice([2, 2, 5, 6, 7], n).astype("<u2")
        (tmp_path / f"f{k}.bin").write_bytes(ids.tobytes())
        ends, last = np.flatnonzero(ids == 2).tolist(), -1
        for e in ends:
            want.append((f"f{k}.bin", last + 1, e - last - 1, True))
            last = e
        if last + 1 < n:
            want.append((f"f{k}.bin", last + 1, n - last - 1, False))
    got = separator_scan.documents(separator_scan.flat_files(spark, str(tmp_path)), block_tokens=block, ranged=ranged).collect()
    got = sorted((r.ordinal, r.path.rsplit("/", 1)[1], r.start, r.n_tokens, r.ended) for r in got)
    assert [g[1:] for g in got] == want and [g[0] for g in got] == list(range(len(want)))


def test_odd_size_raises(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"123")
    with pytest.raises(Exception, match="not a file of ids"):
        separator_scan.documents(separator_scan.flat_files(spark, str(tmp_path))).collect()


def test_random_texts_and_a_small_store(tk, monkeypatch):
    import random

    monkeypatch.setattr(token_output, "_MAX_STORE", 60)
    encode, rng = token_output.PieceEncoder(PATH), random.Random(0)
    atoms = ["a", "B", "foo", ".", ",", "..", "\n", " ", "\n\n", "é", "1", "'s", "#", "漢", "😀", "\t", "<|endoftext|>", "-", "foo.", "bar,"]
    for _ in range(60):
        texts = ["".join(rng.choice(atoms) for _ in range(rng.randint(0, 14))) for _ in range(20)]
        offsets, ids = encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == [_ids(tk, t) for t in texts]
