"""Near-duplicate vectors by spherical k-means cells and blocked cosine products.

Centroids are fitted on a bounded sample of distinct directions (``sample_rows``), and their number grows with the
vectors: about one for every ``cell_rows``. What one level of centroids can't give, since the sample is bounded, a
second gives: centroids of the residuals, shared by all cells, so that a cell is a pair of a centroid and a residual
centroid. Centroids that nearly coincide are merged, so a dense group of copies is one cell and not scattered over
many. Every vector lives in its nearest cell and visits the next ``probes - 1``; a cell compares its own vectors with
each other and with its visitors by matrix products in double precision, in units of bounded size. A pair that two
cells would meet is counted in the lower one only. Vectors with equal components are one class with a
multiplicity before anything is compared, so copies are never expanded into pairs; a unit of work
emits link counts per class and a spanning star of its links, never the pairs.

A link is found if one of its vectors visits the cell of the other: always, if there are no more cells than probes;
beyond that, ``recall`` measures it against all rows for a fixed share of queries.

Defined results: null or zero vectors and vectors with null or non-finite components link with
nothing; vectors of different lengths never link; repeated rows are linked copies; null
ids form rows like any other but are never a component's id; an empty table gives an
empty result; other columns are ignored. Vectors are scaled by their largest component before norms are taken, so
neither very large nor very small components overflow.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _work
from ._blocks import runs, star, units
from ._components import components

COSINE = 0.9
#: Up to so many cells of more than one unit, their sizes reach the vectors by a broadcast (under 10 MB); beyond, by a join.
BROADCAST_CELLS = 200_000
#: Angles to the middle of a cell are told apart by so many bins of half a circle.
BINS = 4096


def directions(batch_column: pa.Array) -> np.ndarray:
    """Unit vectors (double) of a list column; all lists have the same length and are usable."""
    values = batch_column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = values.reshape(len(batch_column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int, spherical: bool) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[np.sort(rng.choice(len(x), k, replace=False))].copy()
    for _ in range(rounds):
        best, score = np.empty(len(x), np.int64), np.empty(len(x))
        shift = 0 if spherical else (c * c).sum(1) / 2
        for at in range(0, len(x), 4096):
            s = x[at : at + 4096] @ c.T - shift
            best[at : at + 4096], score[at : at + 4096] = s.argmax(1), s.max(1)
        total = np.zeros_like(c)
        np.add.at(total, best, x)
        size = np.sqrt((total * total).sum(1)) if spherical else np.bincount(best, minlength=k).astype(np.float64)
        empty = np.flatnonzero(size < 1e-12)
        total[empty] = x[np.argsort(score, kind="stable")[: len(empty)]]
        size[empty] = 1
        c = total / size[:, None]
    return c


def _apart(c: np.ndarray, distance: float) -> np.ndarray:
    """Centroids in order, without those within ``distance`` of one before them."""
    kept = np.empty((0, c.shape[1]))
    for row in c:
        if not len(kept) or ((kept - row) ** 2).sum(1).min() > distance * distance:
            kept = np.vstack([kept, row])
    return kept


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """k unit centroids of unit vectors; empty cells are moved to the worst-served vectors."""
    return _kmeans(x, k, rounds, seed, True)


class Cells:
    """Cells of vectors of one length: a centroid and a residual centroid each."""

    #: Two centroids nearer than this (cosine 0.8) are one: vectors that link are within 0.45 of each other.
    MERGED = math.sqrt(0.4)

    def __init__(self, x: np.ndarray, cells: int, most: int):
        first = min(cells, len(x) // 8 + 1, most)
        self.centroids = _apart(spherical_kmeans(x, first), self.MERGED)
        second = min(-(-cells // first), len(x) // 8 + 1, most)
        self.residuals = np.zeros((1, x.shape[1]))
        if second > 1:
            rest = x - self.centroids[np.concatenate([(x[at : at + 4096] @ self.centroids.T).argmax(1) for at in range(0, len(x), 4096)])]
            self.residuals = _apart(_kmeans(rest, second, 12, 1, False), self.MERGED / 2)

    def nearest(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The numbers of the nearest cells of each unit vector, nearest first; -1 where there are no more."""
        k, m = len(self.centroids), len(self.residuals)
        s = x @ self.centroids.T
        take = min(probes, k)
        coarse = np.argpartition(-s, take - 1, axis=1)[:, :take]
        if m == 1:
            score, cell = np.take_along_axis(s, coarse, 1), coarse
        else:
            shift, few = (self.residuals**2).sum(1) / 2, min(probes, m)
            scores, cells = [], []
            for j in range(take):
                # |x - c - r|^2 is least where (x - c) r - |r|^2 / 2 + x c is greatest
                part = (x - self.centroids[coarse[:, j]]) @ self.residuals.T - shift
                best = np.argpartition(-part, few - 1, axis=1)[:, :few]
                scores.append(np.take_along_axis(part, best, 1) + np.take_along_axis(s, coarse[:, j : j + 1], 1))
                cells.append(coarse[:, j : j + 1] * m + best)
            score, cell = np.hstack(scores), np.hstack(cells)
        order = np.lexsort((cell, -score))[:, :probes]
        out = np.full((len(x), probes), -1, np.int64)
        out[:, : order.shape[1]] = np.take_along_axis(cell, order, 1)
        return out


    def angles(self, x: np.ndarray, near: np.ndarray) -> np.ndarray:
        """The angle of each unit vector to the middle of each of its cells."""
        out = np.full(near.shape, np.pi / 2)
        for j in range(near.shape[1]):
            own = near[:, j] >= 0
            middle = self.centroids[near[own, j] // len(self.residuals)] + self.residuals[near[own, j] % len(self.residuals)]
            middle /= np.maximum(np.sqrt((middle * middle).sum(1, keepdims=True)), 1e-300)
            out[own, j] = np.arccos(np.clip((middle * x[own]).sum(1), -1, 1))
        return out


def classes(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """All rows with the class they belong to (null: links with nothing), and the classes: cls, first id, n, v."""
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    v = F.col(vector_col).cast("array<float>" if single else "array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    good = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    zero = F.lit(0).cast(T.FloatType() if single else T.DoubleType())
    plain = F.transform("v", lambda x: F.when(x == 0, zero).otherwise(x))  # -0.0 becomes 0.0
    rows = rows.withColumn("v", F.when(good, plain))
    rows = rows.withColumn("cls", F.when(F.col("v").isNotNull(), F.struct(F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))))
    found = rows.where("v IS NOT NULL").groupBy("cls").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
    return rows, found


def fit(rows: DataFrame, *, cell_rows: int, most_cells: int, sample_rows: int) -> dict[int, Cells]:
    """Cells by length of vector, from a sample of at most about ``sample_rows`` different vectors of ``rows`` (v)."""
    usable = rows.where("v IS NOT NULL")
    n = usable.count()
    if not n:
        return {}
    rate = min(1.0, sample_rows / n)
    chosen = F.pmod(F.xxhash64("v", F.lit(3)), F.lit(1 << 30)) < int(rate * (1 << 30))
    # copies are all in or all out, and one of each is enough
    sample = usable.where(chosen).select(F.xxhash64("v").alias("h"), "v").groupBy("h").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("n")).orderBy("h").toArrow()
    lists, of = sample.column("v").combine_chunks(), {}
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    lengths = np.diff(lists.offsets.to_numpy())
    for dim in np.unique(lengths).tolist():
        own = np.flatnonzero(lengths == dim)
        x = directions(lists.take(pa.array(own)))
        # how many different vectors of this length there are, by the sample's share
        of[dim] = Cells(x, math.ceil(len(own) / rate / cell_rows) + 1, most_cells)
    return of


def _assign(of: dict[int, Cells], probes: int):
    """Adds near, the nearest cells (the first is home), and the angles to their middles to batches whose last column is v."""

    def work(batches):
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            lengths = np.diff(lists.offsets.to_numpy())
            near = np.full((batch.num_rows, probes), -1, np.int64)
            near[:, 0] = 0
            angle = np.full(near.shape, np.pi / 2)
            for dim in np.unique(lengths).tolist():
                if dim in of:
                    own = np.flatnonzero(lengths == dim)
                    for at in range(0, len(own), 1024):
                        part = own[at : at + 1024]
                        x = directions(lists.take(pa.array(part)))
                        near[part] = of[dim].nearest(x, probes)
                        angle[part] = of[dim].angles(x, near[part])
            flat = near.ravel()
            ends = np.append(0, np.cumsum((near >= 0).sum(1))).astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat[flat >= 0]))
            angles = pa.ListArray.from_arrays(pa.array(ends), pa.array(angle.ravel()[flat >= 0]))
            yield pa.RecordBatch.from_arrays([*batch.columns, column, angles], names=[*batch.schema.names, "near", "angles"])

    return work


def _bins(visits: DataFrame, chunk_rows: int, segment_rows: int) -> DataFrame:
    """dim, cell, bin, residents, before, away: the residents of the cells of more than one unit by their angle to the middle, with those before them and
    the visitors of the cell."""
    at = F.col("angle") * (BINS / math.pi)
    bins = visits.groupBy("dim", "cell", F.floor(at).cast("int").alias("bin")).agg(F.count_if("home").alias("residents"), F.count_if(~F.col("home")).alias("visitors"))
    per = W.partitionBy("dim", "cell")
    bins = bins.withColumns({"all": F.sum("residents").over(per), "away": F.sum("visitors").over(per)}).where((F.col("all") > chunk_rows) | (F.col("all") + F.col("away") > segment_rows))
    ahead = per.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    return _work.keep(bins.where("residents > 0").withColumn("before", F.coalesce(F.sum("residents").over(ahead), F.lit(0))).select("dim", "cell", "bin", "residents", "before", "away"), "bins")


def _intervals(bins: DataFrame, members: DataFrame, chunk_rows: int, segment_rows: int, limit: float) -> DataFrame:
    """c_dim, c_cell, c_chunk, its angles lo and hi, own (has it to be compared with itself), below (the chunks that it has to be compared with), sure (rows that
    each of its rows is linked with for sure, itself among them unless own), first_id (the one that these are linked with, too) and parts of every chunk."""
    width = math.pi / BINS
    spans = members.groupBy("dim", "cell", "chunk").agg(F.min("bin").alias("b0"), F.max("bin").alias("b1"), F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"), F.min("id").alias("id"))
    away = bins.groupBy("dim", "cell").agg(F.max("away").alias("away"))
    spans = spans.join(away, ["dim", "cell"]).select("dim", "cell", "chunk", (F.col("b0") * width).alias("lo"), ((F.col("b1") + 1) * width).alias("hi"), "rows", "n", "id", "away")
    cell = spans.groupBy("dim", "cell").agg(F.array_sort(F.collect_list(F.struct("chunk", "lo", "hi", "n", "id"))).alias("all"))
    met = spans.join(cell, ["dim", "cell"])
    hi, lo, slack = F.col("hi"), F.col("lo"), F.lit(1e-6)
    sure = F.filter("all", lambda o: o["hi"] + hi <= limit - slack)
    # chunks below come in order of their angles: what is linked for sure is at their start, and so is what is too far
    near = F.filter("all", lambda o: (o["chunk"] < F.col("chunk")) & (o["hi"] + hi > limit - slack) & (lo - o["hi"] <= limit + slack))
    met = met.withColumns({"own": 2 * hi > limit - slack, "below": F.transform(near, lambda o: o["chunk"]), "sure": F.aggregate(sure, F.lit(0).cast("long"), lambda a, o: a + o["n"]), "first_id": F.get("all", F.lit(0))["id"]})
    met = _work.keep(met.drop("all", "n", "id"), "chunks")
    later = met.select("dim", "cell", "rows", F.explode("below").alias("base")).groupBy("dim", "cell", "base").agg(F.sum("rows").alias("later")).select(F.col("dim").alias("l_dim"), F.col("cell").alias("l_cell"), "base", "later")
    met = met.join(later, (met["dim"] == later["l_dim"]) & (met["cell"] == later["l_cell"]) & (met["chunk"] == later["base"]), "left")
    others = F.coalesce("later", F.lit(0)) + F.col("away")
    parts = F.when((others == 0) & ~F.col("own"), 0).otherwise(F.greatest(F.ceil((others + F.when(F.col("own"), F.col("rows")).otherwise(0)) / segment_rows), F.lit(1))).cast("int")
    return met.select(F.col("dim").alias("c_dim"), F.col("cell").alias("c_cell"), F.col("chunk").alias("c_chunk"), "lo", "hi", "own", "below", "sure", "first_id", parts.alias("parts"))


def _dealt(cells: DataFrame, chunk_rows: int, segment_rows: int, cosine: float) -> tuple[DataFrame, DataFrame]:
    """dim, cell, base, part, role, id, n, near, v: the units of work; and (id, links, root) of the links that are sure without them.

    The residents of a cell are cut into chunks. A unit has one chunk as base (role 0) and one part of what the
    base is compared with (role 1): residents of later chunks and visitors. Chunks are cut by the angle to the middle of the cell. Two vectors at angles a and b
    to it are between abs(a - b) and a + b apart, so of two chunks all pairs are linked for sure if the sum of their greatest angles is within that of
    the cosine, and none is if their angles differ by more; only the others are compared. A dense group around its middle is dealt once, then, and not once a chunk.
    Part 0 compares the base with itself; where these links are sure, parts are numbered from 1.
    """
    limit = math.acos(cosine)
    visits = cells.select("dim", "id", "n", "near", "v", F.posexplode(F.arrays_zip("near", "angles")).alias("rank", "x")).select("dim", "id", "n", "near", "v", F.col("x.near").alias("cell"), F.col("x.angles").alias("angle"), (F.col("rank") == 0).alias("home"))
    bins = _bins(visits.select("dim", "cell", "angle", "home"), chunk_rows, segment_rows)
    known = bins.select(F.col("dim").alias("s_dim"), F.col("cell").alias("s_cell")).distinct()
    known = _work.keep(known, "large-cells")
    known = F.broadcast(known) if known.count() <= BROADCAST_CELLS else known
    rows = visits.join(known, (visits["dim"] == known["s_dim"]) & (visits["cell"] == known["s_cell"]), "left").drop("s_dim")
    whole = rows.where("s_cell IS NULL").select("dim", "cell", F.lit(0).alias("base"), F.lit(0).alias("part"), (~F.col("home")).cast("int").alias("role"), "id", "n", "near", "v")
    large = rows.where("s_cell IS NOT NULL").withColumn("bin", F.floor(F.col("angle") * (BINS / math.pi)).cast("int")).drop("s_cell")
    place = bins.select(F.col("dim").alias("b_dim"), F.col("cell").alias("b_cell"), F.col("bin").alias("b_bin"), "residents", "before")
    inside = large.where("home").join(place, (large["dim"] == place["b_dim"]) & (large["cell"] == place["b_cell"]) & (large["bin"] == place["b_bin"])).drop("b_dim", "b_cell", "b_bin")
    # the rows of one bin are spread over its share of the order by a hash
    spread = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    inside = _work.keep(inside.withColumn("chunk", F.floor((F.col("before") + spread * F.col("residents")) / chunk_rows).cast("int")).drop("residents", "before"), "residents")
    spans = _work.keep(_intervals(bins, inside.select("dim", "cell", "chunk", "bin", "n", "id"), chunk_rows, segment_rows, limit), "intervals")
    own = inside.join(spans, (inside["dim"] == spans["c_dim"]) & (inside["cell"] == spans["c_cell"]) & (inside["chunk"] == spans["c_chunk"]))
    others = F.col("sure") - F.when(F.col("own"), F.lit(0)).otherwise(F.col("n"))
    sure = own.where(others > 0).select("id", others.alias("links"), F.col("first_id").alias("root"))
    shift = (~F.col("own")).cast("int")
    bases = own.where("parts > 0").select("dim", "cell", F.col("chunk").alias("base"), F.explode(F.sequence(shift, shift + F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), "id", "n", "near", "v")
    of = spans.select(F.col("c_dim").alias("p_dim"), F.col("c_cell").alias("p_cell"), F.col("c_chunk").alias("p_chunk"), F.col("parts").alias("p_parts"), F.col("own").alias("p_own"))
    met = own.select("dim", "cell", F.explode("below").alias("base"), "id", "n", "near", "v")
    reach = spans.groupBy("c_dim", "c_cell").agg(F.collect_list(F.struct("c_chunk", "lo", "hi")).alias("all"))
    guests = large.where("NOT home").join(reach, (large["dim"] == reach["c_dim"]) & (large["cell"] == reach["c_cell"]))
    touched = F.filter("all", lambda o: (F.col("angle") - o["hi"] <= limit + 1e-6) & (o["lo"] - F.col("angle") <= limit + 1e-6))
    met = met.unionByName(guests.select("dim", "cell", F.explode(F.transform(touched, lambda o: o["c_chunk"])).alias("base"), "id", "n", "near", "v"))
    met = met.join(of, (met["dim"] == of["p_dim"]) & (met["cell"] == of["p_cell"]) & (met["base"] == of["p_chunk"]))
    part = (F.pmod(F.xxhash64("id", F.lit(8)), F.col("p_parts")) + (~F.col("p_own")).cast("int")).cast("int")
    met = met.select("dim", "cell", "base", part.alias("part"), F.lit(1).alias("role"), "id", "n", "near", "v")
    return whole.unionByName(bases).unionByName(met), sure


def _compare(cosine: float):
    """Per unit: (id, links, root) for the classes that have links in it; links counts linked rows."""

    def work(batches):
        for table in units(batches, 4):
            table = table.combine_chunks()
            keys = [table.column(k).to_numpy() for k in range(4)]
            edge = runs(keys)
            role, ident, n = (table.column(k).to_numpy() for k in (4, 5, 6))
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                part = table.slice(a, b - a)
                lists = part.column("near").combine_chunks()
                lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
                base = int((role[a:b] == 0).sum())
                if not base or (b - a < 2):
                    continue
                x = directions(part.column("v").combine_chunks())
                off, flat, cell = lists.offsets.to_numpy(), lists.values.to_numpy(), keys[1][a]
                width = int(np.diff(off).max())
                near = np.full((b - a, width), -1, np.int64)
                near[np.arange(width)[None, :] < np.diff(off)[:, None]] = flat[off[0] : off[-1]]
                home, own_n = near[:, 0], n[a:b]
                # rows after ``base`` are compared with the base, and the base with itself in the first part
                first = 0 if keys[3][a] == 0 else base
                count, label = np.zeros(b - a, np.int64), np.arange(b - a)
                for at in range(first, b - a, 512):
                    stop = min(at + 512, b - a)
                    j, i = np.nonzero(x[at:stop] @ x[:base].T >= cosine)
                    j = j + at
                    # of two rows of the base, each pair once; what the lower of two cells meets is not counted here
                    keep = (j >= base) | (i < j)
                    away = (home[j] != cell) & (home[j] < cell)
                    keep &= ~(away & (near[i] == home[j][:, None]).any(1))
                    i, j = i[keep], j[keep]
                    np.add.at(count, i, own_n[j])
                    np.add.at(count, j, own_n[i])
                    label = star(np.concatenate([np.arange(b - a), i]), np.concatenate([label, j]), b - a)
                hit = np.flatnonzero(count)
                if len(hit):
                    yield pa.RecordBatch.from_arrays([pa.array(ident[a:b][hit]), pa.array(count[hit]), pa.array(ident[a:b][label[hit]])], names=["id", "links", "root"])

    return work


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, probes: int = 4, cell_rows: int = 1024, most_cells: int = 5000, sample_rows: int = 40_000, chunk_rows: int = 2048, segment_rows: int = 8192) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    rows, found = classes(vectors, id_col=id_col, vector_col=vector_col)
    of = fit(rows, cell_rows=cell_rows, most_cells=most_cells, sample_rows=sample_rows)
    rows = _work.keep(rows.select("vec_id", "cls"), "vectors")
    found = found.select("cls", "first", F.size("v").alias("dim"), F.xxhash64("cls.h1", "cls.h2").alias("id"), "n", "v")
    schema = T.StructType([*found.schema.fields, T.StructField("near", T.ArrayType(T.LongType())), T.StructField("angles", T.ArrayType(T.DoubleType()))])
    cells = _work.keep(found.mapInArrow(_assign(of, probes), schema), "cells")
    dealt, sure = _dealt(cells, chunk_rows, segment_rows, cosine)
    dealt = dealt.repartition("dim", "cell", "base", "part").sortWithinPartitions("dim", "cell", "base", "part", "role", "id")
    links = _work.keep(dealt.mapInArrow(_compare(cosine), "id long, links long, root long").unionByName(sure), "links")
    counts = links.groupBy("id").agg(F.sum("links").alias("links")).withColumnRenamed("id", "l_id")
    roots = components(links.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("a", "r_id")
    by = cells.select("cls", "id", "first", "n")
    by = by.join(counts, by["id"] == counts["l_id"], "left").join(roots, by["id"] == roots["r_id"], "left")
    by = _work.keep(by.select("cls", "first", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "id").alias("root")), "linked")
    lowest = by.groupBy("root").agg(F.min("first").alias("component_id")).withColumnRenamed("root", "o_root")
    by = by.join(lowest, by["root"] == lowest["o_root"]).select(F.col("cls").alias("b_cls"), "n_links", "component_id")
    out = rows.join(by, rows["cls"] == by["b_cls"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def recall(vectors: DataFrame, *, every: int = 20, cosine: float = COSINE, **options) -> tuple[int, int]:
    """(links found, links there are) of the rows whose id is divisible by ``every``, against all rows."""
    found = near_duplicates(vectors, cosine=cosine, **options)
    got = found.where(F.col("vec_id") % every == 0).agg(F.sum("n_links")).first()[0] or 0
    rows, known = classes(vectors)
    known = _work.keep(known, "classes")
    queries = rows.select("vec_id", "cls").where(F.col("vec_id") % every == 0).join(known.select("cls", "v"), "cls")
    there = 0
    for block in _blocks(queries.select("v")):

        def count(batches, q=block):
            for batch in batches:
                hit = (q @ directions(batch.column(1)).T >= cosine).sum(0)
                yield pa.RecordBatch.from_arrays([pa.array(hit * batch.column(0).to_numpy())], names=["n"])

        there += (known.select("n", "v").mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0) - len(block)
    return got, there


def _blocks(queries: DataFrame, rows: int = 2048):
    batch = []
    for row in queries.toLocalIterator():
        batch.append(row.v)
        if len(batch) == rows:
            yield _unit(batch)
            batch = []
    if batch:
        yield _unit(batch)


def _unit(rows: list) -> np.ndarray:
    x = np.asarray(rows, np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and verdict of every vector."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(embedding, lambda x: x * x)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)) >= 0.9::DOUBLE),
reach AS (
  SELECT a AS v, b AS r FROM links UNION SELECT reach.v, links.b FROM reach JOIN links ON reach.r = links.a)
SELECT e.vec_id, CAST(coalesce((SELECT count(*) FROM links WHERE a = e.vec_id), 0) AS BIGINT) AS n_links,
  least(e.vec_id, coalesce((SELECT min(r) FROM reach WHERE v = e.vec_id), e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce((SELECT min(r) FROM reach WHERE v = e.vec_id), e.vec_id)) AS kept
FROM embeddings e
"""
