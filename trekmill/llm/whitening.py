"""Whitening of embeddings: exact sums, a RowMatrix of centred vectors, eigenvectors on the driver, projections in tasks.

Vectors are compared and summed as whole numbers, so that equal ones count once and sums don't depend on their order. Of the
vectors the driver gets sums and products alone, whose size is that of one vector and its square.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trekmill.llm.common import cut

#: Whole steps for each unit of an entry.
SCALE = 256
#: An eigenvalue of which more is lost to rounding than this share of the largest has no direction of its own.
RANK = 1e-12
_MOST = float(1 << 62)


@dataclass
class Whitening:
    """n vectors with sums; components[k] is a unit eigenvector of their covariance and values[k] its eigenvalue, falling."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows of whole numbers centred exactly, projected, and scaled to variance one."""
        return centred(x, self.sums, self.n) @ self.components.T / np.sqrt(self.values)

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace


def centred(x: np.ndarray, sums: np.ndarray, n: int) -> np.ndarray:
    """x - sums / n: the difference is taken in whole numbers, so that nothing cancels; Python's where 64 bits don't do."""
    bound = float(np.abs(x).max(initial=0)) * n + float(np.abs(sums.astype(float)).max(initial=0))
    if bound < 2.0**62:
        return (x * np.int64(n) - sums.astype(np.int64)) / n
    return ((x.astype(object) * n - sums) / n).astype(float)


def steps(rows: DataFrame, vector_col: str = "embedding", scale: int = SCALE, to: str = "x") -> DataFrame:
    """rows with the array<long> `to` = floor(scale * entry), without rows that have no such array.

    Those are rows whose vector is null, has no entries or holds one that is null, not finite, or beyond 2^62 steps. Of the
    others those stay whose length is that of most rows (the greatest of such lengths), as vectors of other lengths have no
    covariance with them. A column named `to` is replaced.
    """
    entry = lambda e: F.floor(F.lit(float(scale)) * e.cast("double"))
    fits = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(F.lit(float(scale)) * e.cast("double")) < _MOST)
    v = F.col(f"`{vector_col}`")
    good = rows.where(v.isNotNull() & (F.size(v) > 0) & F.forall(v, fits))
    lengths = good.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if lengths:
        good = good.where(F.size(v) == lengths[0].d)
    return good.withColumn(to, F.transform(v, entry).cast("array<long>"))


def _sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of a task's vectors their number and sums, in parts that 64 bits hold."""
    for batch in batches:
        if len(batch):
            x = np.stack(batch["x"].to_numpy())
            big = float(np.abs(x).max(initial=0)) * len(x) >= 2.0**62
            total = x.astype(object).sum(axis=0) if big else x.sum(axis=0)
            yield pd.DataFrame({"at": range(-1, len(total)), "total": [str(len(x)), *map(str, total)]})


def fit(stepped: DataFrame, components: int = 4, x_col: str = "x") -> Whitening:
    """Whitening of the distinct arrays of `x_col` (as `steps` makes them), each counted once.

    The Gramian of the exactly centred vectors is summed by RowMatrix; divided by their number it is the covariance.
    identity_error is measured: the whitened vectors' own covariance, by a second pass, against the identity. As many
    components as `components` at most; directions without variance have none. No rows: none, n 0.
    """
    distinct = cut(stepped.select(F.col(f"`{x_col}`").alias("x")).distinct())
    parts = distinct.mapInPandas(_sums, "at int, total string")
    found = {r.at: int(r.total) for r in parts.groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
    n = found.pop(-1, 0)
    sums = np.array([found[i] for i in range(len(found))], object)
    if not n:
        return Whitening(0, sums, np.zeros((0, 0)), np.zeros(0), 0.0)
    v = _gramian(_projected(distinct, lambda x: centred(x, sums, n))) / n
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > RANK * max(values.max(), 0.0)]
    out = Whitening(n, sums, vectors[:, order].T, values[order], float(np.trace(v)))
    if len(order):
        again = _gramian(_projected(distinct, out.whitened)) / n
        out.identity_error = float(np.abs(again - np.eye(len(order))).max())
    return out


def _projected(distinct: DataFrame, rows_of) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"v": list(rows_of(np.stack(batch["x"].to_numpy())))})

    return distinct.mapInPandas(run, "v array<double>").select(array_to_vector("v").alias("v"))


def _gramian(vectors: DataFrame) -> np.ndarray:
    return RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "v")).computeGramianMatrix().toArray()


def whiten(rows: DataFrame, vector_col: str = "embedding", components: int = 4, scale: int = SCALE) -> DataFrame:
    """A row for each row of `rows` that `steps` keeps and each component, with all of its columns but the vector.

    New columns: component (from 1, by falling variance), n, deviation (exact sum of (n * x - sums)^2; an error if it
    doesn't fit a long), whitened, explained and identity_error; columns with these names are replaced. Rows that repeat stay
    apart. Without rows, or where all vectors are equal, there are no components and so no rows.
    """
    own = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    kept = [F.col(f"`{c}`") for c in rows.columns if c != vector_col and c not in own]
    stepped = cut(steps(rows.select(F.struct(*kept).alias("row"), F.col(f"`{vector_col}`").alias("v")), "v", scale).drop("v"))
    model = fit(stepped, components)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("deviation string, whitened array<double>")
    def run(arrays: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in arrays:
            if not len(batch):
                yield pd.DataFrame({"deviation": [], "whitened": []})
                continue
            x = np.stack(batch.to_numpy())
            far = float(np.abs(x).max(initial=0)) * m.n + float(np.abs(m.sums.astype(float)).max(initial=0))
            off = x * np.int64(m.n) - m.sums.astype(np.int64) if far**2 * x.shape[1] < 2.0**62 else x.astype(object) * m.n - m.sums
            yield pd.DataFrame({"deviation": list(map(str, (off * off).sum(axis=1))), "whitened": list(m.whitened(x))})

    by_component = F.posexplode(F.arrays_zip(F.col("w.whitened").alias("z"), F.array(*map(F.lit, model.explained.tolist())).cast("array<double>").alias("e"))).alias("at", "c")
    found = stepped.select("row", run("x").alias("w")).select("row", "w.deviation", by_component)
    return found.select("row.*", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), F.col("deviation").cast("long").alias("deviation"), F.col("c.z").alias("whitened"), F.col("c.e").alias("explained"), F.lit(model.identity_error).alias("identity_error"))
