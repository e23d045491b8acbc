"""Whitening of embeddings by a compensated covariance.

Entries become integers, so their sums are exact and a mean is known to some 32 digits.  Each row is centred before anything is
multiplied, as the unevaluated sum of two doubles.  Tasks add up outer products in double-double arithmetic: products and sums
come with their rounding errors (error-free transformations), which are added up beside them.  What a task holds is a high and a low part
for each pair of dimensions; these parts are merged across tasks the same way, piece by piece of the matrix, in two
steps, so that no task gathers what all others hold.  The matrix is rounded to doubles once, at the end.  It is then reduced to
tridiagonal form and solved by divide and conquer (LAPACK's ``syevd`` behind ``numpy.linalg.eigh``) in the task that has it.

Everything is keyed by the vectors' length, so rows of other lengths have a covariance of their own.  A matrix has the square of
that length as entries, whatever the number of rows; no rows and no matrix go through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweir.plans.durable import durable

#: Components that are returned, the scale and the shift of entries.
COMPONENTS, SCALE, SHIFT = 8, 1024, 100000
#: Entries are held within 2^42 either way, so that the integers are exact as doubles.
HELD = float(1 << 42)
#: Pairs of dimensions in one piece of the matrix; entries of a product block; bytes of sums after which a task puts out what it has.
PIECE, BLOCK, FULL = 1024, 1 << 18, 128 << 20
#: Tasks whose parts are merged apart in the first step: every 64th goes to the same group.
SLOTS = 64

Pair = tuple[np.ndarray, np.ndarray]


def two_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    """a + b and its rounding error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def two_product(a: np.ndarray, b: np.ndarray) -> Pair:
    """a * b and its rounding error, by splitting both factors into halves."""
    p = a * b
    c, d = a * 134217729.0, b * 134217729.0
    ah, bh = c - (c - a), d - (d - b)
    al, bl = a - ah, b - bh
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def added(a: Pair, b: Pair) -> Pair:
    """The sum of two double-doubles."""
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def summed(rows: Pair) -> Pair:
    """The sum over the first axis, in pairs of pairs."""
    hi, lo = rows
    while len(hi) > 1:
        if len(hi) % 2:
            hi, lo = np.concatenate([hi, np.zeros_like(hi[:1])]), np.concatenate([lo, np.zeros_like(lo[:1])])
        hi, lo = added((hi[::2], lo[::2]), (hi[1::2], lo[1::2]))
    return hi[0], lo[0]


class Outer:
    """The sum of outer products of centred rows of one length: its upper triangle, in double-double."""

    def __init__(self, dims: int):
        self.i, self.j = np.triu_indices(dims)
        self.hi, self.lo = np.zeros(len(self.i)), np.zeros(len(self.i))

    def add(self, hi: np.ndarray, lo: np.ndarray) -> None:
        hi, lo = two_sum(hi, lo)  # what cancels in the difference from the mean leaves a low part too large to be left out of a product
        for at in range(0, len(self.i), BLOCK):
            i, j, here = self.i[at : at + BLOCK], self.j[at : at + BLOCK], slice(at, at + BLOCK)
            step = max(1, BLOCK // len(i))
            for k in range(0, len(hi), step):
                a, b, c, d = hi[k : k + step, i], hi[k : k + step, j], lo[k : k + step, i], lo[k : k + step, j]
                p, e = two_product(a, b)
                self.hi[here], self.lo[here] = added((self.hi[here], self.lo[here]), summed(two_sum(p, e + (a * d + c * b))))


def _outer_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, sums = TaskContext.get().partitionId(), {}

    def out() -> Iterator[pa.RecordBatch]:
        for dims, s in sums.items():
            for at in range(0, len(s.hi), PIECE):
                yield pa.RecordBatch.from_pydict({"dims": pa.array([dims], pa.int32()), "piece": pa.array([at // PIECE], pa.int32()), "task": pa.array([task], pa.int32()), "hi": [s.hi[at : at + PIECE]], "lo": [s.lo[at : at + PIECE]]})
        sums.clear()

    for batch in batches:
        lengths = batch.column(0).to_numpy()
        for dims in np.unique(lengths).tolist():
            rows = batch if (lengths == dims).all() else batch.filter(pa.array(lengths == dims))
            hi, lo = (rows.column(k).flatten().to_numpy().reshape(len(rows), -1) for k in (1, 2))
            if dims not in sums:
                sums[dims] = Outer(hi.shape[1])
            sums[dims].add(hi, lo)
            if sum(16 * len(s.hi) for s in sums.values()) > FULL and len(sums) > 1:
                yield from out()
    yield from out()


def _merge(group: pd.DataFrame) -> pd.DataFrame:
    """Parts of one piece of the matrix, added in the order of their tasks."""
    g = group.sort_values("task")
    hi, lo = summed((np.stack(g["hi"].to_list()), np.stack(g["lo"].to_list())))
    return pd.DataFrame({"dims": g["dims"].iloc[:1], "piece": g["piece"].iloc[:1], "task": g["task"].iloc[:1], "hi": [hi], "lo": [lo]})


def outer_products(centred_rows: DataFrame) -> DataFrame:
    """dims, piece, hi, lo: the sums of outer products of centred rows (dims, hi, lo), a row for each piece of a matrix.

    ``dims`` is a key, all of whose rows are equally long.
    """
    schema = "dims int, piece int, task int, hi array<double>, lo array<double>"
    parts = centred_rows.mapInArrow(_outer_products, schema)
    some = parts.groupBy("dims", "piece", F.pmod("task", F.lit(SLOTS)).alias("slot")).applyInPandas(lambda g: _merge(g), schema)
    return some.groupBy("dims", "piece").applyInPandas(lambda g: _merge(g), schema).drop("task")


def difference(a: Column, b: Column) -> tuple[Column, Column]:
    """a - b and its rounding error."""
    s = a - b
    t = s - a
    return s, (a - (s - t)) - (b + t)


def centred(rows: DataFrame, means: DataFrame, vector: str) -> DataFrame:
    """``rows`` with ``hi`` and ``lo``: the vector less the mean of its length (means: dims, mean_hi, mean_lo), as double-doubles."""
    both = rows.join(means, "dims")
    less = lambda which: F.transform(vector, lambda c, i: which(difference(c.cast("double"), F.get("mean_hi", i)), F.get("mean_lo", i)))
    return both.withColumns({"hi": less(lambda d, m: d[0]), "lo": less(lambda d, m: d[1] - m)}).drop("mean_hi", "mean_lo")


def _exact_means(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        hi, lo = [], []
        for n, sums in zip(f["n"], f["sums"]):
            top = [float(int(s) / n) for s in sums]
            hi.append(top)
            lo.append([(int(s) * b - a * n) / (n * b) for s, (a, b) in zip(sums, (t.as_integer_ratio() for t in top))])
        yield pd.DataFrame({"dims": f["dims"], "n": f["n"], "sums": f["sums"], "mean_hi": hi, "mean_lo": lo})


def integer_means(rows: DataFrame, vector: str) -> DataFrame:
    """dims, n, sums, mean_hi, mean_lo of integer vectors: sums are exact, means differ from them by parts in 10^32."""
    each = rows.select("dims", F.posexplode(vector).alias("pos", "x")).groupBy("dims", "pos").agg(F.sum(F.col("x").cast("decimal(19,0)")).cast("decimal(38,0)").alias("s"), F.count("*").alias("n"))
    lists = each.groupBy("dims").agg(F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda p: p["s"]).alias("sums"))
    return lists.mapInPandas(_exact_means, "dims int, n long, sums array<decimal(38,0)>, mean_hi array<double>, mean_lo array<double>")


def _matrix(pieces: pd.DataFrame, n: int) -> np.ndarray:
    """The covariance of ``n`` rows, from all pieces of their outer products."""
    p = pieces.sort_values("piece")
    hi, lo = np.concatenate(p["hi"].to_list()), np.concatenate(p["lo"].to_list())
    dims = (math.isqrt(8 * len(hi) + 1) - 1) // 2
    out, (i, j) = np.zeros((dims, dims)), np.triu_indices(dims)
    out[i, j] = out[j, i] = (hi + lo) / n
    return out


def _solver(components: int):
    def solve(group: pd.DataFrame) -> pd.DataFrame:
        dims, n = int(group["dims"].iloc[0]), int(group["n"].iloc[0])
        v = _matrix(group, n)
        e, q = np.linalg.eigh(v)
        e, q = e[::-1][:components], q.T[::-1][:components]
        q = q * np.where(q[np.arange(len(q)), np.abs(q).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
        trace = float(np.trace(v))
        e = np.where(e > dims * np.finfo(float).eps * trace, e, 0.0)
        return pd.DataFrame({"dims": [dims], "vectors": [q.tolist()], "values": [e], "trace": [trace]})

    return solve


def components_of(products: DataFrame, means: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """dims, vectors, values, trace: the leading unit eigenvectors, largest entry positive, and eigenvalues, 0 where rounding hides them."""
    with_n = products.join(means.select("dims", "n"), "dims")
    return with_n.groupBy("dims").applyInPandas(_solver(components), "dims int, vectors array<array<double>>, values array<double>, trace double")


def _off_identity(group: pd.DataFrame) -> pd.DataFrame:
    v = _matrix(group, int(group["n"].iloc[0]))
    return pd.DataFrame({"error": [float(np.abs(v - np.eye(len(v))).max())]})


def identity_error(rows: DataFrame) -> float:
    """The largest entry, over all ``dims``, of the covariance of ``w`` less the identity; 0 without rows."""
    rows = rows.filter(F.size("w") > 0)
    each = rows.select("dims", F.posexplode("w").alias("pos", "x")).groupBy("dims", "pos").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    lists = each.groupBy("dims").agg(F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda p: p["m"]).alias("mean_hi"))
    means = durable(lists.withColumn("mean_lo", F.transform("mean_hi", lambda m: F.lit(0.0))), "whitened-means")
    products = outer_products(centred(rows, means.drop("n"), "w").select("dims", "hi", "lo"))
    errors = products.join(means.select("dims", "n"), "dims").groupBy("dims").applyInPandas(_off_identity, "error double")
    return errors.agg(F.max("error")).first()[0] or 0.0


def whitened(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per usable vector and component: id, component, n, deviation, whitened, explained, identity_error, dims.

    Vectors that are null, or hold null, NaN or infinite entries, have no rows, nor have empty ones.  Entries beyond 2^42 either way count as 2^42.  Vectors
    of each length are fitted and returned apart; n is their number.  Rows that repeat count each time; ids may repeat or be null.  A component
    along which all vectors are equal has ``whitened`` 0 and no part in the identity error, which is the largest of all lengths,
    and 0 where nothing varies; ``explained`` is then 0.  ``deviation`` is null where it passes 64 bits.  An empty table gives an empty result; other columns
    are ignored.
    """
    v = F.col(vector_col).cast("array<double>")
    usable = rows.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), v.alias("v")).filter((F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    held = lambda c: F.least(F.greatest(c, F.lit(-HELD)), F.lit(HELD))
    whole = usable.select("id", F.size("v").alias("dims"), F.transform("v", lambda c: F.floor(held(c) * SCALE) + SHIFT).alias("x"))

    means = durable(integer_means(whole, "x"), "means")
    fit = centred(whole.select("dims", "x"), means.select("dims", "mean_hi", "mean_lo"), "x").select("dims", "hi", "lo")
    model = durable(components_of(outer_products(fit), means, components), "components")

    exact = lambda c: c.cast("decimal(19,0)")
    square = lambda d: F.try_multiply(d.try_cast("decimal(19,0)"), d.try_cast("decimal(19,0)")).cast("decimal(38,0)")
    deviation = F.aggregate(F.zip_with("x", "sums", lambda x, s: square(exact(F.col("n")) * exact(x) - s)), F.lit(0).cast("decimal(38,0)"), lambda a, b: F.try_add(a, b).cast("decimal(38,0)"))
    dot = lambda q: F.aggregate(F.zip_with(q, "hi", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    w = F.zip_with(F.transform("vectors", dot), "values", lambda p, e: F.when(e > 0, p / F.sqrt(e)).otherwise(0.0))
    projected = centred(whole, means, "x").withColumn("deviation", deviation.try_cast("bigint")).join(model, "dims")
    done = durable(projected.select("id", "dims", "deviation", w.alias("w")), "whitened")

    error = identity_error(done.join(model.select("dims", "values"), "dims").select("dims", F.transform(F.filter(F.arrays_zip("w", "values"), lambda p: p["values"] > 0), lambda p: p["w"]).alias("w")))

    parts = F.transform("w", lambda x, i: F.struct((i + 1).alias("component"), x.alias("whitened"), F.coalesce(F.try_divide(F.get("values", i), F.col("trace")), F.lit(0.0)).alias("explained")))
    told = done.join(means.select("dims", "n"), "dims").join(model.select("dims", "values", "trace"), "dims").select("id", "dims", "n", "deviation", F.explode(parts).alias("c"))
    return told.select(F.col("id").alias(id_col), "c.component", "n", "deviation", "c.whitened", "c.explained", F.lit(error).alias("identity_error"), "dims")
