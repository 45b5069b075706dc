"""Substring dedup: words inside passages that already start in a document with a smaller id are removed.

A window is ``window`` consecutive words. Each window has one anchor: of its runs of ``phrase`` words, the one
with the smallest hash. Two equal windows have equal anchors, so only windows around recurring
anchors can recur. In steps, each linear in the words of the corpus:

1. every text is hashed once; exact copies are classes with their smallest id, and only that member goes on;
2. anchors that occur in two or more different texts are confirmed as recurring phrases (an aggregation
   with map-side minimum and maximum, so a phrase of millions of documents is one row a task);
3. all of these documents that hold a window are dealt out by id; each shard of them (``shard_chars`` characters of texts and phrases at
   most) compiles the recurring phrases of its documents into one Aho-Corasick automaton, each read once from the first of them
   that has it, and streams all its documents through it, which locates every occurrence; windows whose
   anchor is at a located occurrence become candidates;
4. candidates are confirmed by 95 bits of hash over all their words: the smallest id per window, joined
   back, gives the words to remove.

A document's phrases are only in the automaton of its own shard, so automata grow with a shard and not with the
corpus, and every document is streamed once.

The classes of a few very frequent texts (at most ``1 / HOT`` of them, since each has more than that share of all rows) reach their rows by a
broadcast, the others by a join, so that no task gets all copies of one text.

Defined results: a null text has no words; a text shorter than a window loses nothing; repeated rows
have the same id, so none counts as smaller and all stay; rows without an id remove nothing and lose nothing;
an empty table gives an empty result; other columns are ignored or, by :func:`deduplicated`, kept.
"""

from __future__ import annotations

import hashlib
import math
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread
from . import _work
from ._text import Grams, HashCache, encode, mix, small, word_chunks

WINDOW = 50
PHRASE = 20
#: The share of all rows from which on a text is one of the few very frequent ones.
HOT = 0.001
_SPACE = re.compile(rb"[ \t\n\v\f\r]+")
_EMPTY = hashlib.sha256(b"").hexdigest()
_cache = HashCache()
_phrases, _first, _second = Grams(0x9E3779B97F4A7C15), Grams(0xC2B2AE3D27D4EB4F), Grams(0x165667B19E3779F9)


def normal(text: str | None) -> bytes:
    """The words of a text joined by single spaces."""
    return _SPACE.sub(b" ", encode(text)).strip(b" ")


def word_hashes(norm: bytes) -> np.ndarray:
    parts = [np.fromiter(map(_cache.__getitem__, chunk), np.uint64, len(chunk)) for chunk in word_chunks(norm)]
    return np.concatenate([np.empty(0, np.uint64), *parts])


def _minima(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values."""
    n, step = len(x) - width + 1, 1
    if n <= 0:
        return x[:0]
    while step * 2 <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return x if step == width else np.minimum(x[:n], x[width - step : width - step + n])


def anchors(hashes: np.ndarray, window: int = WINDOW, phrase: int = PHRASE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``phrase`` words, and the anchor hash of every window."""
    g = _phrases.runs(hashes, phrase)
    return g, _minima(g, window - phrase + 1)


def _survey(window: int, phrase: int):
    def work(batches):
        for batch in small(batches):
            n, sha, found = [], [], []
            for t in batch.column(2).to_pylist():
                norm = normal(t)
                h = word_hashes(norm)
                n.append(len(h))
                sha.append(hashlib.sha256(norm).digest())
                found.append(np.unique(anchors(h, window, phrase)[1]).view(np.int64))
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *found])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sha, pa.binary()), lists], names=["doc_id", "k", "n_words", "sha", "anchors"])

    return work


def _occurrences(text: str, automaton) -> np.ndarray:
    """Characters at which a phrase of the automaton starts; ``text`` begins and ends with a space."""
    return np.fromiter((end - size + 1 for end, size in automaton.iter(text)), np.int64)


def _spaces(text: str) -> np.ndarray:
    if text.isascii():
        return np.flatnonzero(np.frombuffer(text.encode(), np.uint8) == 32)
    return np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") == 32)


def _shards(batches, phrase: int, window: int, shard_chars: int):
    """Lists of (id, k, text, text between spaces) and the recurring phrases in them."""
    rows, phrases, read, chars = [], {}, set(), 0
    for batch in small(batches):
        for doc_id, k, t, recurring in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3), strict=True):
            norm = normal(t)
            text = " " + norm.decode("utf-8", "surrogatepass") + " "
            wanted = [x for x in recurring.as_py() or () if x not in read]
            if wanted:
                # the first place of each phrase that no document before had; the automaton finds all others
                g, _ = anchors(word_hashes(norm), window, phrase)
                places, spaces = np.flatnonzero(np.isin(g, np.asarray(wanted, np.int64).view(np.uint64))), _spaces(text)
                for p in places[np.unique(g[places], return_index=True)[1]].tolist():
                    own = text[spaces[p] : spaces[p + phrase] + 1]
                    phrases[own] = len(own)
                    chars += len(own)
                read.update(wanted)
            rows.append((doc_id, k, t, text))
            chars += len(text)
            if chars >= shard_chars:
                yield rows, phrases
                rows, phrases, read, chars = [], {}, set(), 0
    if rows:
        yield rows, phrases


def compiled(phrases: dict[str, int]):
    """The automaton of recurring phrases with their lengths; None if there are none."""
    if not phrases:
        return None
    automaton = ahocorasick.Automaton()
    for p, size in phrases.items():
        automaton.add_word(p, size)
    automaton.make_automaton()
    return automaton


def _located(g: np.ndarray, low: np.ndarray, found: np.ndarray, window: int, phrase: int) -> np.ndarray:
    """Windows whose anchor is one of the phrases that start at the words ``found``."""
    if not len(low) or not len(found):
        return np.empty(0, np.int64)
    # elsewhere nothing can be as small as the anchor: the least hash of a window is its anchor's only if that was found
    far = np.full(len(g), np.uint64(0xFFFFFFFFFFFFFFFF))
    far[found] = g[found]
    near = np.zeros(len(g), np.int64)
    near[found] = 1
    near = np.append(0, np.cumsum(near))
    width = window - phrase + 1
    return np.flatnonzero((_minima(far, width) == low) & (near[width:] > near[:-width]))


def _locate(window: int, phrase: int, shard_chars: int):
    """Candidate windows of the documents of a partition."""

    def work(batches):
        for rows, phrases in _shards(batches, phrase, window, shard_chars):
            automaton = compiled(phrases)
            if automaton is None:
                continue
            ids, ks, texts, at, one, two = [], [], [], [], [], []
            for doc_id, k, t, text in rows:
                starts = _occurrences(text, automaton)
                if not len(starts):
                    continue
                h = word_hashes(text.encode("utf-8", "surrogatepass"))
                g, low = anchors(h, window, phrase)
                p = _located(g, low, np.unique(np.searchsorted(_spaces(text), starts)), window, phrase)
                if len(p):
                    ids.append(doc_id)
                    ks.append(k)
                    texts.append(t)
                    at.append(p.astype(np.int32))
                    one.append(_first.runs(h, window)[p].view(np.int64))
                    two.append((_second.runs(mix(h), window)[p] >> np.uint64(33)).astype(np.int32))
            if ids:
                ends = pa.array(np.cumsum([0, *map(len, at)]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in (at, one, two)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ks, pa.int64()), pa.array(texts, pa.string()), *lists], names=["doc_id", "k", "text", "pos", "h1", "h2"])

    return work


def removed_words(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """True for the words of ``n`` that a window starting at one of ``starts`` covers."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + window, n), -1)
    return np.cumsum(edge)[:-1] > 0


def _cut(window: int):
    def work(batches):
        for batch in small(batches):
            gone, sha, kept = [], [], []
            for t, starts in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                words = normal(t).split(b" ")
                out = removed_words(len(words), np.asarray(starts.values, np.int64), window)
                text = b" ".join(w for w, x in zip(words, out.tolist(), strict=True) if not x)
                gone.append(int(out.sum()))
                sha.append(hashlib.sha256(text).hexdigest())
                kept.append(text.decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(gone, pa.int64()), pa.array(sha), pa.array(kept, pa.string())], names=["c_id", "c_k", "n_gone", "kept_sha", "kept"])

    return work


def _with_classes(seen: DataFrame) -> DataFrame:
    """Adds rep, the smallest id with the same words; null ids form no class."""
    reps = seen.where("doc_id IS NOT NULL").groupBy("sha").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    reps = _work.keep(reps, "copied")
    least = F.lit(math.ceil(seen.count() * HOT))
    hot, cold = reps.where(F.col("n") > least), reps.where(F.col("n") <= least)
    # fewer than 1 / HOT rows, whatever the input
    rows = seen.join(F.broadcast(hot.select(F.col("sha").alias("h_sha"), F.col("rep").alias("h_rep"))), F.col("sha") == F.col("h_sha"), "left").drop("h_sha")
    done = rows.where("h_rep IS NOT NULL").withColumnRenamed("h_rep", "rep")
    rest = rows.where("h_rep IS NULL").drop("h_rep").join(cold.select(F.col("sha").alias("r_sha"), "rep"), F.col("sha") == F.col("r_sha"), "left").drop("r_sha")
    return done.unionByName(rest).withColumn("rep", F.coalesce("rep", "doc_id"))


def repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, phrase: int = PHRASE, shard_chars: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """Per row doc_id, k (hash of the text), n_words, sha and rep (the smallest id with these words); and, per
    document of smallest id that loses words, c_id, c_k, n_gone, kept_sha and the kept text."""
    text = F.col(text_col).cast("string")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("k"), text.alias("text"))
    seen = _work.keep(spread(src).mapInArrow(_survey(window, phrase), "doc_id long, k long, n_words long, sha binary, anchors array<long>"), "survey")
    rows = _with_classes(seen)
    rows = _work.keep(rows.withColumn("anchors", F.when(F.col("doc_id") == F.col("rep"), F.col("anchors"))), "rows")
    loose = rows.where("doc_id = rep").select("doc_id", "k", F.explode("anchors").alias("a"))
    common = loose.groupBy("a").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select(F.col("a").alias("c_a"))
    # kept, so that both sides of the join below are plain exchanges, which adaptive execution can split
    common = _work.keep(common, "common")
    firsts = rows.where(F.expr(f"doc_id = rep AND n_words >= {window}")).select(F.col("doc_id").alias("f_id"), F.col("k").alias("f_k")).distinct()
    own = loose.join(common, loose["a"] == common["c_a"]).groupBy("doc_id", "k").agg(F.collect_set("a").alias("recurring")).select(F.col("doc_id").alias("o_id"), F.col("k").alias("o_k"), "recurring")
    own = firsts.join(own, (firsts["f_id"] == own["o_id"]) & (firsts["f_k"] == own["o_k"]), "left").select("f_id", "f_k", "recurring")
    busy = src.join(own, (src["doc_id"] == own["f_id"]) & (src["k"] == own["f_k"])).select("doc_id", "k", "text", "recurring")
    found = _work.keep(busy.mapInArrow(_locate(window, phrase, shard_chars), "doc_id long, k long, text string, pos array<int>, h1 array<long>, h2 array<int>"), "windows", compression="zstd")
    wins = found.select("doc_id", "k", F.explode(F.arrays_zip("h1", "h2", "pos")).alias("w")).select("doc_id", "k", "w.h1", "w.h2", "w.pos")
    least = wins.groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select(F.col("h1").alias("l1"), F.col("h2").alias("l2"), "lo")
    least = _work.keep(least, "least")
    late = wins.join(least, (wins["h1"] == least["l1"]) & (wins["h2"] == least["l2"])).where("doc_id > lo")
    late = late.groupBy("doc_id", "k").agg(F.collect_set("pos").alias("starts")).select(F.col("doc_id").alias("s_id"), F.col("k").alias("s_k"), "starts")
    texts = found.select("doc_id", "k", "text").dropDuplicates(["doc_id", "k"])
    hit = texts.join(late, (texts["doc_id"] == late["s_id"]) & (texts["k"] == late["s_k"])).select("doc_id", "k", "text", "starts")
    cut = _work.keep(hit.mapInArrow(_cut(window), "c_id long, c_k long, n_gone long, kept_sha string, kept string"), "cut", compression="zstd")
    return rows.drop("anchors"), cut


def digests(docs: DataFrame, *, window: int = WINDOW, **options) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row."""
    rows, cut = repeated_passages(docs, window=window, **options)
    cut = cut.drop("kept")
    out = rows.join(cut, (rows["doc_id"] == cut["c_id"]) & (rows["k"] == cut["c_k"]), "left")
    copy = (F.col("doc_id") > F.col("rep")) & (F.col("n_words") >= window)
    n = F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_gone", F.lit(0)))
    sha = F.when(copy, F.lit(_EMPTY)).otherwise(F.coalesce("kept_sha", F.lower(F.hex("sha"))))
    return out.select("doc_id", "n_words", n.cast("long").alias("n_removed"), sha.alias("kept_sha256"))


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars", window: int = WINDOW, **options) -> DataFrame:
    """``docs`` with the removed words gone: a text that loses nothing is unchanged, another is its kept words joined
    by single spaces (empty if none is left). ``size_col``, if there, becomes the new length of a changed text."""
    rows, cut = repeated_passages(docs, id_col=id_col, text_col=text_col, window=window, **options)
    copies = rows.where((F.col("doc_id") > F.col("rep")) & (F.col("n_words") >= window)).select(F.col("doc_id").alias("c_id"), F.col("k").alias("c_k"), F.lit("").alias("kept"))
    changed = cut.select("c_id", "c_k", "kept").unionByName(copies).dropDuplicates(["c_id", "c_k"])
    src = docs.select(F.col(id_col).cast("long").alias("d_id"), F.xxhash64(F.col(text_col).cast("string")).alias("d_k"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    out = src.join(changed, (src["d_id"] == changed["c_id"]) & (src["d_k"] == changed["c_k"]), "left")
    fields = []
    for c in docs.columns:
        was = F.col("row").getField(c)
        if c == text_col:
            was = F.coalesce("kept", was)
        elif c == size_col:
            was = F.when(F.col("kept").isNotNull(), F.length("kept").cast(docs.schema[c].dataType)).otherwise(was)
        fields.append(was.alias(c))
    return out.select(*fields)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = """
WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
wins AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM docs)),
late AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS lo FROM wins) WHERE doc_id > lo),
gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM late, (SELECT unnest(range(0, 50)) AS k)),
kept AS (
  SELECT d.doc_id, string_agg(d.word, ' ' ORDER BY d.i) AS text, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docs) d
  ANTI JOIN gone g ON d.doc_id = g.doc_id AND d.i = g.i GROUP BY d.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k USING (doc_id)
"""
