"""Whitening of embeddings from upper-triangle column aggregates.

One aggregation gives the rows, the exact sum and the range of every dimension. The covariance is a second one: dimensions
are cut into blocks of ``BLOCK``, every pair of blocks of the upper triangle is a group, and generated SQL
expressions sum the products of its dimensions, so a plan has as many expressions for a thousand dimensions as
for sixteen, all in generated code and combined before the shuffle. Values are centred before they are multiplied: by the whole number
nearest to the mean, which keeps the sums exact longs (what is left of the mean is taken off exactly on the
driver), or by the mean itself in doubles where longs could overflow. The driver gets one number a pair of dimensions, assembles the covariance
and decomposes it by LAPACK; the rows are projected by matrix products in Arrow batches. No pass shuffles or writes vectors.

Defined results: vectors that are null, empty or hold null or non-finite entries, or entries of 2**56 or more (their long would
overflow), are left out; if lengths differ, the most frequent one counts (of equal ones the longest) and the other vectors are left out; null
ids are kept; repeated rows are rows of their own; a component without variance has null values, and ``identity_error`` and ``explained`` are over the others (null if there are none);
``deviation`` is null where it exceeds a long; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 8
SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
_LIMIT = float(2**62)
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and x, the array of floor(64 * c) + 1000000 as longs, of all usable vectors."""
    whole = F.transform(F.col(vector_col).cast("array<double>"), lambda c: F.when(F.abs(c * SCALE) < _LIMIT, F.floor(c * SCALE).cast("long") + F.lit(SHIFT).cast("long")))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("x")).where("size(x) > 0 AND forall(x, c -> c IS NOT NULL)")


def ranges(rows: DataFrame) -> list[tuple]:
    """(n, S, least, greatest) of each dimension of the array column x, over the most frequent length."""
    each = rows.select(F.size("x").alias("d"), F.posexplode("x").alias("at", "c")).groupBy("d", "at").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("c").cast("decimal(20,0)")).alias("s"), F.min("c").alias("lo"), F.max("c").alias("hi")).collect()
    if not each:
        return []
    d = max((r.n, r.d) for r in each)[1]
    return [(r.n, int(r.s), r.lo, r.hi) for r in sorted((r for r in each if r.d == d), key=lambda r: r["at"])]


def pair_sums(rows: DataFrame, column: str, d: int) -> np.ndarray:
    """The d x d matrix of sums of products of the entries of an array column; a Python int each if they are longs.

    Groups are pairs of blocks, expressions are generated for the places in them; the last block runs over the end with zeros.
    """
    blocks = -(-d // BLOCK)
    upper = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(blocks) for j in range(i, blocks)])
    kind = rows.schema[column].dataType.elementType.simpleString()

    def entry(block: str, k: int) -> Column:
        at = f"p.{block} * {BLOCK} + {k}"
        return F.expr(f"{column}[{at}]" if d % BLOCK == 0 else f"if({at} < {d}, {column}[{at}], cast(0 as {kind}))").alias(f"{block}{k}")

    paired = rows.select(column, F.explode(upper).alias("p")).select("p", *[entry(b, k) for b in "ij" for k in range(BLOCK)])
    sums = paired.groupBy("p").agg(*[F.expr(f"sum(i{a} * j{b})").alias(f"s{a}_{b}") for a in range(BLOCK) for b in range(BLOCK)]).collect()
    out = np.zeros((blocks * BLOCK, blocks * BLOCK), object if kind == "bigint" else float)
    for row in sums:
        i, j = row[0].i * BLOCK, row[0].j * BLOCK
        part = np.array(row[1:], out.dtype).reshape(BLOCK, BLOCK)
        out[i : i + BLOCK, j : j + BLOCK] = part
        out[j : j + BLOCK, i : i + BLOCK] = part.T
    return out[:d, :d]


@dataclass
class Whitening:
    """The fit: ``centre`` + ``rest`` is the mean of n vectors, ``axes`` are eigenvectors by falling ``values``."""

    n: int
    sums: list[int]
    centre: np.ndarray
    rest: np.ndarray
    covariance: np.ndarray
    values: np.ndarray
    axes: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n of a matrix of longs, in double precision: whole numbers are taken off before anything is rounded."""
        return (x - self.centre).astype(np.float64) - self.rest

    def whitened(self, x: np.ndarray, components: int) -> np.ndarray:
        """One row a vector; null components are NaN."""
        k = min(components, len(self.values))
        scale = np.where(self.positive()[:k], self.values[:k], np.nan)
        return self.centred(x) @ self.axes[:, :k] / np.sqrt(scale)

    def positive(self) -> np.ndarray:
        """Components whose eigenvalue is more than rounding."""
        return self.values > max(self.values[0], 0.0) * len(self.values) * 1e-15

    def deviation(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of (n x - S)^2 as longs, and where they exceed one. Longs wrap, so what fits is right whatever came before."""
        apart = (self.centred(x) * float(self.n)) ** 2
        wrap = lambda v: (v + (1 << 63)) % (1 << 64) - (1 << 63)
        sums = np.array([wrap(s) for s in self.sums], np.int64)
        rough = apart.sum(1)
        with np.errstate(over="ignore"):
            diff = x * np.int64(wrap(self.n)) - sums
            exact = (diff * diff).sum(1)
        over = rough > 2.0**63 * (1 - 1e-12)
        return exact, over


def fit(rows: DataFrame) -> Whitening | None:
    """The whitening of all vectors ``x`` (longs) of the most frequent length; null if there are none."""
    dims = ranges(rows)
    if not dims:
        return None
    n, d, sums = dims[0][0], len(dims), [s for _, s, _, _ in dims]
    centre = [(2 * s + n) // (2 * n) for s in sums]
    reach = max(max(hi - m, m - lo) for (_, _, lo, hi), m in zip(dims, centre, strict=True))
    rest = [Fraction(s - n * m, n) for s, m in zip(sums, centre, strict=True)]
    own = rows.where(F.size("x") == d)
    whole = n * reach * reach < 1 << 63
    taken = F.array(*[F.lit(m).cast("long") if whole else F.lit(float(Fraction(s, n))) for m, s in zip(centre, sums, strict=True)])
    products = pair_sums(own.select(F.zip_with("x", taken, lambda a, b: a - b).alias("y")), "y", d)
    if whole:
        covariance = np.array([[float(Fraction(int(products[i, j]), n) - rest[i] * rest[j]) for j in range(d)] for i in range(d)])
    else:
        covariance = products / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(d)] < 0, -1.0, 1.0)
    return Whitening(n, sums, np.array(centre, np.int64), np.array([float(r) for r in rest]), covariance, values, np.ascontiguousarray(axes))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def identity_error(own: DataFrame, model: Whitening, components: int) -> float | None:
    """The largest absolute entry of the covariance of the whitened rows minus the identity, measured over all rows."""
    used = np.flatnonzero(model.positive()[:components])
    k = len(used)
    if not k:
        return None

    def work(batches):
        for batch in batches:
            w = np.ascontiguousarray(model.whitened(_matrix(batch.column(0)), components)[:, used]) if batch.num_rows else np.empty((0, k))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, k, dtype=np.int32)), pa.array(w.ravel()))], names=["w"])

    # the projection centres by S/n already; what rounding leaves of the mean is taken off
    found = own.select("x").mapInArrow(work, "w array<double>")
    means = np.zeros(k)
    for at, total in found.select(F.posexplode("w").alias("at", "c")).groupBy("at").agg(F.sum("c")).collect():
        means[at] = total / model.n
    return float(np.abs(pair_sums(found, "w", k) / model.n - np.outer(means, means) - np.eye(k)).max())


def whiten(vectors: DataFrame, *, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for every usable vector and component."""
    rows = whole_vectors(vectors, id_col=id_col, vector_col=vector_col)
    model = fit(rows)
    if model is None:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    d = len(model.values)
    k = min(components, d)
    own = rows.where(F.size("x") == d)
    error = identity_error(own, model, k)
    positive = model.positive()[:k]
    trace = float(np.trace(model.covariance))
    explained = np.where(positive, model.values[:k] / trace if trace > 0 else 0.0, 0.0)

    def work(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                x, b = _matrix(batch.column(1)), batch.num_rows
                w = model.whitened(x, k).ravel()
                deviation, over = model.deviation(x)
                null = np.tile(~positive, b)
                ids = batch.column(0).take(pa.array(np.repeat(np.arange(b), k)))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), b)), pa.array(np.full(b * k, model.n)), pa.array(np.repeat(deviation, k), mask=np.repeat(over, k)),
                        pa.array(w, mask=null), pa.array(np.tile(explained, b), mask=null), pa.array(np.full(b * k, np.nan if error is None else error), mask=np.full(b * k, error is None)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return own.mapInArrow(work, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the first 32 components, whitened."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
