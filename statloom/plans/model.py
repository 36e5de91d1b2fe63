"""Ridge-blended ratings."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType


def ridge_column(df: DataFrame, features: list[str], label: str, alpha: float) -> Column:
    """The regression of :func:`ridge_fit` as a scalar subquery: an array of the intercept and the coefficients.

    Counts, means and covariances are one pass of one aggregation, and the k x k system is solved in a task, so
    building the plan runs no job. Null where no complete row is there to fit.
    """
    names = [*features, label]
    k = len(features)
    rows = df.select(*[F.col(c).cast("double") for c in names]).dropna()
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    sums = rows.agg(F.count("*").cast("double").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(names)], *[F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i, j in pairs])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                if not r["n"]:
                    out.append(None)
                    continue
                cov = np.zeros((k + 1, k + 1))
                for i, j in pairs:
                    cov[i, j] = cov[j, i] = r["n"] * r[f"c{i}_{j}"]
                beta = np.linalg.solve(cov[:k, :k] + alpha * np.eye(k), cov[:k, k])
                out.append([r[f"m{k}"] - float(beta @ [r[f"m{i}"] for i in range(k)]), *map(float, beta)])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.float64()))], names=["fit"])

    return sums.mapInArrow(solve, "fit array<double>").scalar()


def ridge_fits(df: DataFrame, by: list[str], models: dict[str, tuple[list[str], str]], alpha: float) -> DataFrame:
    """``by`` and, for each model (features, label), the regression of :func:`ridge_fit` over the rows of each group.

    All groups and models are one aggregation, whose state is each group's counts, means and covariances; the small
    systems are solved where that aggregation ends. A model without complete rows in a group is null there.
    """
    sums, parts = [], {}
    for m, (features, label) in models.items():
        names = [*features, label]
        complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in names])
        x = [F.when(complete, F.col(c).cast("double")) for c in names]
        pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
        sums += [F.count(x[0]).cast("double").alias(f"{m}_n"), F.array(*map(F.avg, x)).alias(f"{m}_mean"), F.array(*[F.covar_pop(x[i], x[j]) for i, j in pairs]).alias(f"{m}_cov")]
        parts[m] = (len(features), pairs)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = {c: b.column(c).to_pylist() for c in b.schema.names if c not in by}
            fits = []
            for m, (k, pairs) in parts.items():
                out = []
                for n, mean, covs in zip(columns[f"{m}_n"], columns[f"{m}_mean"], columns[f"{m}_cov"]):
                    if not n:
                        out.append(None)
                        continue
                    cov = np.zeros((k + 1, k + 1))
                    for (i, j), c in zip(pairs, covs):
                        cov[i, j] = cov[j, i] = n * c
                    beta = np.linalg.solve(cov[:k, :k] + alpha * np.eye(k), cov[:k, k])
                    out.append([mean[k] - float(beta @ mean[:k]), *map(float, beta)])
                fits.append(pa.array(out, pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in by), *fits], names=[*by, *parts])

    groups = df.groupBy(*by).agg(*sums)
    return groups.mapInArrow(solve, StructType([groups.schema[c] for c in by] + [StructField(m, ArrayType(DoubleType())) for m in models]))


def ratings_by_group(df: DataFrame, by: list[str], offence: tuple[list[str], str], defence: tuple[list[str], str], minutes: str, alpha: float = 0.5, least: float = 10.0, full: float = 20.0) -> DataFrame:
    """:func:`estimated_ratings` with regressions of each group's own; groups without rows to fit keep the raw share alone."""
    fits = ridge_fits(df.where(F.col(minutes) >= least), by, {"_off": offence, "_def": defence}, alpha)
    weight = F.least(F.coalesce(F.col(minutes), F.lit(0.0)) / full, F.lit(1.0))
    blended = lambda m, model: weight * F.coalesce(F.col(model[1]), F.lit(0.0)) + (1 - weight) * F.coalesce(predict(F.col(m), model[0]), F.lit(0.0))
    out = df.join(fits, by, "left").withColumn("e_off", blended("_off", offence)).withColumn("e_def", blended("_def", defence))
    return out.withColumn("e_net", F.col("e_off") - F.col("e_def")).drop("_off", "_def")


def ridge_fit(df: DataFrame, features: list[str], label: str, alpha: float) -> tuple[float, dict[str, float]]:
    """Intercept and coefficients of a ridge regression (squared error plus alpha times squared coefficients), as numbers.

    Rows with a null feature or label are left out.
    """
    fit = df.sparkSession.range(1).select(ridge_column(df, features, label, alpha)).first()[0]
    if fit is None:
        raise ValueError("no complete rows to fit")
    return fit[0], dict(zip(features, fit[1:]))


def predict(fit: Column, features: list[str]) -> Column:
    """The regression (intercept and coefficients in an array) as a column; null features count as 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * F.get(fit, F.lit(i + 1)) for i, c in enumerate(features)], F.get(fit, F.lit(0)))


def ridge_blend(df: DataFrame, features: list[str], label: str, minutes: str, out: str, alpha: float = 0.5, least: float = 10.0, full: float = 20.0) -> DataFrame:
    """Add ``out``: the raw rating by minutes / ``full`` (at most 1), and the prediction for the rest.

    The regression is fitted on rows with at least ``least`` minutes and no missing features.
    """
    fit = ridge_column(df.where(F.col(minutes) >= least), features, label, alpha)
    weight = F.least(F.coalesce(F.col(minutes), F.lit(0.0)) / full, F.lit(1.0))
    fitted = df.withColumn("_fit", fit)
    return fitted.withColumn(out, weight * F.coalesce(F.col(label), F.lit(0.0)) + (1 - weight) * predict(F.col("_fit"), features)).drop("_fit")


def estimated_ratings(df: DataFrame, offence: tuple[list[str], str], defence: tuple[list[str], str], minutes: str, **options: float) -> DataFrame:
    """Add e_off, e_def and e_net: two blended ratings, each from its own features and raw rating, and their difference."""
    both = ridge_blend(ridge_blend(df, *offence, minutes, "e_off", **options), *defence, minutes, "e_def", **options)
    return both.withColumn("e_net", F.col("e_off") - F.col("e_def"))
