"""Token-ID output: Parquet list columns with dictionary and delta encoding.

Documents are range-partitioned and sorted by id, encoded, and written as
``(part, doc_id, local_start, n_tokens, token_ids)``:

* ``token_ids`` is a list column with delta encoding (DELTA_BINARY_PACKED, about
  as small as indexes into a dictionary of 50,000 ids and cheaper to write) or, with
  ``ids_encoding="dictionary"``, dictionary encoding; ``doc_id``, ``local_start`` and
  ``n_tokens`` are delta encoded, ``part`` by a dictionary;
* row groups are bounded by ``row_group_bytes``, data pages by
  ``page_bytes``, and the writer adds column and offset indexes, so a filter
  on ``doc_id`` reads only the pages it needs and a read of the metadata
  columns never touches the ids.

Defined results: a null text is empty and has only the end id; repeated ids
are all kept, ordered by the hash of their text; an empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _work

#: White space other than single spaces and line feeds after other characters: such texts are encoded whole.
_ODD = r"[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|  |\n |^ | $"
#: Between a letter or digit and one of these, pre-tokens always end.
_MARKS = (".", ",")
_MARKED = r"[\pL\pN][.,]$"
_MAX_STORE = 700_000
SCHEMA = "part int, doc_id long, local_start long, n_tokens long, token_ids array<int>"


class PieceEncoder:
    """Encodes texts with a byte-level BPE tokenizer of the tokenizers library.

    A boundary between a character that is not white space and a space is always a
    boundary of pre-tokens, so the ids of a text are the ids of its pieces (a space,
    then all up to the next space) one after another. Pieces seen before come from a bounded
    store; the others go to the library joined to longer texts, and the byte lengths of the returned
    tokens cut the ids into pieces again (checked: if the end of a piece is not the end of a token,
    each is encoded alone). Texts with other white space, or more than one space in a row, go to
    the library whole. Pieces are split, numbered and put together again by Arrow and numpy; Python
    sees each distinct piece of a batch once.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.n_bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.n_bytes[i] = len(token)
        self.marks = self._library(list(_MARKS))
        self.place: dict[str, int] = {}
        self._forget()

    def _forget(self) -> None:
        """Start the store again with the pieces that several batches had: place 0 is the empty piece, then the marks."""
        least, words = 2, []
        while self.place:
            words = [w for w, p in self.place.items() if self.hits[p] >= least and w]
            if len(words) <= _MAX_STORE // 2:
                break
            least *= 2
        old = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        offsets, ids = self._take(old) if words else (np.zeros(1, np.int64), np.empty(0, np.uint32))
        hits = self.hits[old] // 2 if words else np.empty(0, np.int64)
        self.place = {"": 0}
        self.ids, self.ends, self.hits, self.n = np.zeros(1 << 16, np.uint32), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 1
        self._append(np.concatenate(self.marks), np.cumsum([len(x) for x in self.marks]))
        first = self._append(ids[offsets[0] : offsets[-1]], offsets[1:] - offsets[0])
        self.hits[first : self.n] = hits
        self.place.update(zip(words, range(first, self.n), strict=True))

    def _append(self, ids: np.ndarray, ends: np.ndarray) -> int:
        """Put lists of ids into the store; the place of the first."""
        first, used = self.n, int(self.ends[self.n - 1])
        for name, need in (("ids", used + len(ids)), ("ends", first + len(ends)), ("hits", first + len(ends))):
            old = getattr(self, name)
            if need > len(old):
                new = np.zeros(max(need, 2 * len(old)), old.dtype)
                new[: len(old)] = old
                setattr(self, name, new)
        self.ids[used : used + len(ids)] = ids
        self.ends[first : first + len(ends)] = used + ends
        self.hits[first : first + len(ends)] = 0
        self.n += len(ends)
        return first

    def _take(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of the lists at ``places``, one after another."""
        offsets = pa.array(np.append(0, self.ends[: self.n]).astype(np.int32))
        out = pa.ListArray.from_arrays(offsets, pa.array(self.ids[: int(self.ends[self.n - 1])].view(np.int32))).take(pa.array(places))
        return out.offsets.to_numpy().astype(np.int64), out.values.to_numpy().view(np.uint32)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        # the library's results take about a hundred bytes a token: only a few texts at a time
        out = []
        for at in range(0, len(texts), 64):
            out += [np.asarray(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts[at : at + 64], add_special_tokens=False)]
        return out

    def _learn(self, words: list[str], run: int = 256) -> None:
        """Put the ids of " " + word into the store for each word."""
        if not words:
            return
        rows = self._library([" " + " ".join(words[i : i + run]) for i in range(0, len(words), run)])
        ids = np.concatenate(rows)
        ends = np.cumsum(pc.binary_length(pa.array(words, pa.string())).to_numpy().astype(np.int64) + 1)
        reach = np.cumsum(self.n_bytes[ids])
        cut = np.searchsorted(reach, ends)
        if cut[-1] >= len(reach) or not np.array_equal(reach[cut], ends):
            rows = self._library([" " + w for w in words])
            ids, cut = np.concatenate(rows), np.cumsum([len(x) for x in rows]) - 1
        first = self._append(ids, cut + 1)
        self.place.update(zip(words, range(first, self.n), strict=True))

    def _meet(self, words: list[str]) -> None:
        """Learn words; one that ends in a letter or digit and a mark is learnt as the two."""
        all_ = pa.array(words, pa.string())
        marked = pc.match_substring_regex(all_, _MARKED)
        plain, both = all_.filter(pc.invert(marked)).to_pylist(), all_.filter(marked)
        stems = pc.utf8_slice_codeunits(both, 0, -1).to_pylist()
        place = self.place
        self._learn([*plain, *{w for w in stems if w not in place}.difference(plain)])
        if stems:
            mark = np.where(pc.ends_with(both, _MARKS[0]).to_numpy(zero_copy_only=False), 1, 2)
            pairs = np.column_stack([np.fromiter(map(self.place.__getitem__, stems), np.int64, len(stems)), mark]).ravel()
            offsets, ids = self._take(pairs)
            first = self._append(ids, offsets[2::2] - offsets[0])
            self.place.update(zip(both.to_pylist(), range(first, self.n), strict=True))

    def __call__(self, texts: pa.StringArray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of the texts and the ids of all of them, each followed by ``end`` if given."""
        n = len(texts)
        odd = pc.match_substring_regex(texts, _ODD)
        lists = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        pieces, at = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        at -= at[0]
        coded = pieces.dictionary_encode()
        number, distinct = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.place) > _MAX_STORE:
            self._forget()
        found = list(map(self.place.get, distinct))
        new = [k for k, f in enumerate(found) if f is None]
        if new:
            words = [distinct[k] for k in new]
            self._meet(words)
            for k, w in zip(new, words, strict=True):
                found[k] = self.place[w]
        found = np.asarray(found, np.int64)
        self.hits[found] += 1
        places = found[number]
        # first pieces have no space before them, and whole texts no pieces
        starts = pc.if_else(odd, texts, pieces.take(pa.array(at[:-1]))).dictionary_encode()
        first = self._library(starts.dictionary.to_pylist())
        kept = self.n
        places[at[:-1]] = self._append(np.concatenate(first), np.cumsum([len(x) for x in first])) + starts.indices.to_numpy()
        if end is not None:
            places = np.insert(places, at[1:], self._append(np.asarray([end], np.uint32), np.asarray([1])))
            at = at + np.arange(n + 1)
        offsets, ids = self._take(places)
        self.n = kept
        return offsets[at] - offsets[0], ids[offsets[0] : offsets[-1]]


@functools.cache
def encoder(path: str) -> PieceEncoder:
    """One encoder for each Python worker; its cache outlives a task."""
    return PieceEncoder(path)


def encoded(batches: Iterable[pa.RecordBatch], column: int, path: str, end: int | None, most_bytes: int = 8 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with at most about ``most_bytes`` of text, their token offsets and ids."""
    encode = encoder(path)
    for batch in batches:
        texts = pc.fill_null(batch.column(column), "")
        reach = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + most_bytes, "right")))
            yield batch.slice(at, stop - at), *encode(texts.slice(at, stop - at), end)
            at = stop


def ordered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents in ranges of ascending id; the hash of the text spreads repeated ids over ranges."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return src.withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")


def write_tokens(docs: DataFrame, tokenizer_path: str, out: str, *, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", row_group_bytes: int = 16 << 20, page_bytes: int = 64 << 10, ids_encoding: str = "delta") -> None:
    """Encode all documents and write the token files to ``out``."""

    def encode(batches):
        part, at = TaskContext.get().partitionId(), 0
        for rows, offsets, ids in encoded(batches, 1, tokenizer_path, end_id):
            starts = at + offsets[:-1]
            at += len(ids)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.view(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(rows.num_rows, part, np.int32)), rows.column(0), pa.array(starts), pa.array(np.diff(offsets)), lists], names=["part", "doc_id", "local_start", "n_tokens", "token_ids"])

    options = {
        "compression": "uncompressed",
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.block.size": str(row_group_bytes),
        "parquet.page.size": str(page_bytes),
        "parquet.enable.dictionary": "false",
        "parquet.enable.dictionary#part": "true",
        "parquet.enable.dictionary#token_ids.list.element": str(ids_encoding == "dictionary").lower(),
    }
    with _work.batches_of(docs.sparkSession, 1800):
        ordered(docs, id_col, text_col).mapInArrow(encode, SCHEMA).write.options(**options).parquet(out)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The token files; select columns and filter on ``doc_id`` to read them selectively."""
    return spark.read.schema(SCHEMA).parquet(path)


def part_offsets(spark: SparkSession, path: str) -> dict[int, int]:
    """Ids before each file; one entry a file, whatever the number of documents."""
    sums = read_tokens(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()
    at, out = 0, {}
    for row in sorted(sums):
        out[row.part] = at
        at += row.n
    return out


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, all from the ids in the files."""
    offsets = part_offsets(spark, path)

    def digest(batches):
        for batch in batches:
            col = batch.column(3)
            ends, ids = col.offsets.to_numpy(), memoryview(np.ascontiguousarray(col.values.to_numpy(), "<i4")).cast("B")
            crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            start = [offsets[p] + s for p, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(start, pa.int64()), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_tokens(spark, path).select("part", "doc_id", "local_start", "token_ids").mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the tokens of all documents in ascending doc_id order and index them from the files."""
    import public_tokenizers

    out = _work.folder(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), out)
    return token_index(spark, out)
