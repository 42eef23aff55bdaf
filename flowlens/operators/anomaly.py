"""Anomalies as reconstruction errors of a linear coding: width, cut-off and figures from held-out rows.

A coding of width k keeps the projections of a row on the k directions along which the training
rows vary most; the error is the squared length of what is left. One aggregate gives the moments
of every part of the rows (training, validation, test). The directions come from those of the
training part, and the mean errors of every width on every part from the same moments, without
another pass. Linear, unlike a network autoencoder, so its numbers differ from one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.operators.quantiles import exact_quantiles
from flowlens.session import materialized

_MOMENTS = "part string, n bigint, mean array<double>, spread array<double>"
#: Tasks whose moments are merged by one task, in the first of two steps.
FAN_IN = 16


@dataclass
class Moments:
    """Number of rows, their mean, and the sum of the outer products of what they differ from it."""

    n: int
    mean: np.ndarray
    spread: np.ndarray

    def merged(self, other: Moments) -> Moments:
        if len(self.mean) != len(other.mean):
            raise ValueError(f"vectors of {len(self.mean)} and of {len(other.mean)} numbers")
        n, apart = self.n + other.n, other.mean - self.mean
        spread = self.spread + other.spread + np.outer(apart, apart) * (self.n * other.n / n)
        return Moments(n, self.mean + apart * (other.n / n), spread)

    def about(self, point: np.ndarray) -> np.ndarray:
        """Mean outer product of the rows' differences from a point."""
        apart = self.mean - point
        return self.spread / self.n + np.outer(apart, apart)


def _matrix(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of a matrix, and which rows of the batch they are.

    Vectors that are null, empty or hold a null or non-finite number are left out.
    """
    sizes = values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes)
    if not len(rows):
        return np.empty((0, 0)), rows
    if len(set(sizes[rows])) > 1:
        raise ValueError(f"vectors of {sizes[rows].min()} to {sizes[rows].max()} numbers")
    flat = values.drop_null().flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    matrix = flat.reshape(len(rows), -1)
    whole = np.isfinite(matrix).all(axis=1)  # a null number has become NaN
    return matrix[whole], rows[whole]


def _merge(batches: Iterator[pa.RecordBatch]) -> dict[str | None, Moments]:
    found: dict[str | None, Moments] = {}
    for batch in batches:
        for row in batch.to_pylist():
            mean = np.array(row["mean"])
            one = Moments(row["n"], mean, np.array(row["spread"]).reshape(len(mean), -1))
            found[row["part"]] = found[row["part"]].merged(one) if row["part"] in found else one
    return found


def _batch(found: dict[str | None, Moments]) -> pa.RecordBatch:
    fields = {
        "part": pa.array(list(found), pa.string()),
        "n": pa.array([m.n for m in found.values()], pa.int64()),
        "mean": pa.array([m.mean for m in found.values()], pa.list_(pa.float64())),
        "spread": pa.array([m.spread.ravel() for m in found.values()], pa.list_(pa.float64())),
    }
    return pa.RecordBatch.from_pydict(fields)


def _moments_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[str | None, Moments] = {}
    for batch in batches:
        matrix, rows = _matrix(batch.column("x"))
        parts = np.array(batch.column("part").to_pylist(), dtype=object)[rows]
        for part in set(parts):
            some = matrix[parts == part]
            mean = some.mean(axis=0)
            one = Moments(len(some), mean, (some - mean).T @ (some - mean))
            found[part] = found[part].merged(one) if part in found else one
    if found:
        yield _batch(found)


def _merged_group(table: pa.Table) -> pa.Table:
    return pa.Table.from_batches([_batch(_merge(iter(table.to_batches())))])


def _array(df: DataFrame, features: str) -> Column:
    is_vector = isinstance(df.schema[features].dataType, VectorUDT)
    return vector_to_array(F.col(features)) if is_vector else F.col(features).cast("array<double>")


def moments(df: DataFrame, features: str = "features", part: Column | None = None) -> dict[str | None, Moments]:
    """The moments of the vectors of each part, in one pass.

    Each task sums its rows into one matrix per part, and tasks merge those of others in two
    steps, so the driver gets one matrix a part whatever the number of rows. There should be a
    handful of parts. Vectors that are null, empty or hold a null or non-finite number
    take no part; vectors of several lengths are an error.
    """
    part = F.lit("all") if part is None else part
    rows = df.select(part.cast("string").alias("part"), _array(df, features).alias("x"))
    partial = rows.mapInArrow(_moments_of_task, _MOMENTS)
    for group in (F.floor(F.spark_partition_id() / FAN_IN), F.lit(0)):
        partial = partial.withColumn("_group", group).groupBy("_group").applyInArrow(_merged_group, _MOMENTS)
    found = {}
    for row in partial.collect():  # one a part
        mean = np.array(row["mean"])
        found[row["part"]] = Moments(row["n"], mean, np.array(row["spread"]).reshape(len(mean), -1))
    return found


@dataclass
class Coding:
    """Directions of the training rows, most spread first, with the chosen width and cut-off."""

    mean: np.ndarray
    #: One direction a row.
    directions: np.ndarray
    variances: np.ndarray
    width: int
    cutoff: float | None = None

    @classmethod
    def of(cls, train: Moments, width: int | None = None) -> Coding:
        """Directions from moments; the full width unless one is given."""
        variances, columns = np.linalg.eigh(train.spread / train.n)
        return cls(train.mean, columns.T[::-1].copy(), variances[::-1].copy(), len(variances) if width is None else width)

    def mean_errors(self, rows: Moments) -> np.ndarray:
        """The mean error on these rows of each width from 0 to all directions."""
        along = np.einsum("ij,jk,ik->i", self.directions, rows.about(self.mean), self.directions)
        return np.append(np.cumsum(np.maximum(along, 0)[::-1])[::-1], 0.0)

    def error(self, x: Column, width: int | None = None) -> Column:
        """The error of an array of doubles; null where the vector took no part in the fit."""
        mean, left = self.mean, self.directions[self.width if width is None else width :]

        @F.pandas_udf("double")
        def squared(vectors: pd.Series) -> pd.Series:
            found = np.full(len(vectors), np.nan)
            matrix, rows = _matrix(pa.array(vectors, pa.list_(pa.float64()), from_pandas=True))
            if len(rows):
                found[rows] = (((matrix - mean) @ left.T) ** 2).sum(axis=1)
            return pd.Series(found).where(~np.isnan(found), None)

        return squared(x)

    def score(self, df: DataFrame, features: str = "features") -> DataFrame:
        """Add ``error`` and, with a cut-off, ``is_anomaly``: false where there is no error."""
        scored = df.withColumn("error", self.error(_array(df, features)))
        if self.cutoff is None:
            return scored
        return scored.withColumn("is_anomaly", F.coalesce(F.col("error") > self.cutoff, F.lit(False)))

    def save(self, spark: SparkSession, path: str) -> None:
        """As a table with one row per direction."""
        rows = [
            (i, v.tolist(), float(s), self.mean.tolist(), self.width, self.cutoff)
            for i, (v, s) in enumerate(zip(self.directions, self.variances, strict=True))
        ]
        spark.createDataFrame(rows, _STORED).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Coding:
        rows = spark.read.schema(_STORED).parquet(path).orderBy("place").collect()  # one a direction
        first = rows[0]
        directions = np.array([r["direction"] for r in rows])
        return cls(np.array(first["mean"]), directions, np.array([r["variance"] for r in rows]), first["width"], first["cutoff"])


_STORED = "place int, direction array<double>, variance double, mean array<double>, width int, cutoff double"


def choose_width(errors: Sequence[float], left: float | None = 0.05, widths: Sequence[int] | None = None) -> int:
    """The width to use, by the mean errors of all widths on validation rows.

    With ``left`` the smallest of ``widths`` whose error is at most that share of the error
    of width 0, or the one of least error where none is. Errors fall with the width, so
    without ``left`` the widest wins, as by the highest negative error.
    """
    widths = sorted(set(range(len(errors)) if widths is None else [min(w, len(errors) - 1) for w in widths]))
    enough = [w for w in widths if left is not None and errors[w] <= left * errors[0]]
    return enough[0] if enough else min(widths, key=lambda w: (errors[w], w))


@dataclass
class Fitted:
    coding: Coding
    #: Mean error per part and width, ``(part, width, n, mean_error, chosen)``.
    errors: DataFrame
    #: The rows with their error and flag.
    scored: DataFrame
    #: ``(part, n, mean_error, flagged)`` at the chosen width.
    figures: DataFrame


def fit(
    rows: DataFrame, features: str = "features", split: str = "split", quantile: float = 0.99,
    left: float | None = 0.05, widths: Sequence[int] | None = None,
) -> Fitted:
    """Fit on ``train`` rows, choose the width on ``validation`` rows, give figures for every part.

    The cut-off is the exact quantile of the training errors; a row above it is an anomaly.
    Two passes over the vectors: the moments of all parts, and the errors of all rows, which are
    kept as a table. Without validation rows the training rows choose; without training rows
    there is nothing to fit, which is an error.
    """
    spark = rows.sparkSession
    found = moments(rows, features, F.col(split))
    if "train" not in found:
        raise ValueError("no training rows with whole vectors")
    coding = Coding.of(found["train"])
    per_part = {part: coding.mean_errors(m) for part, m in found.items()}
    coding.width = choose_width(per_part.get("validation", per_part["train"]), left, widths)
    table = [
        (part, k, found[part].n, float(e), k == coding.width)
        for part, errors in per_part.items() for k, e in enumerate(errors)
    ]
    scored = materialized(coding.score(rows, features), "anomaly-errors")
    train = scored.where(F.col(split) == "train")
    coding.cutoff = exact_quantiles(train, {"error": [quantile]})["error"][0]
    scored = scored.withColumn("is_anomaly", F.coalesce(F.col("error") > coding.cutoff, F.lit(False)))
    figures = scored.groupBy(F.col(split).alias("part")).agg(
        F.count("error").alias("n"), F.avg("error").alias("mean_error"), F.count_if("is_anomaly").alias("flagged")
    )
    errors = spark.createDataFrame(table, "part string, width int, n bigint, mean_error double, chosen boolean")
    return Fitted(coding, errors, scored, figures)
