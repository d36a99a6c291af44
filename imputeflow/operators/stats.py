"""Column statistics: profiles, correlations, scaling, frequencies, missing rates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imputeflow.operators.orderstat import exact_quantiles
from imputeflow.session import small_table

NO_SPREAD = 1e-13  # share of the whole spread below which a column counts as constant


def column_profile(df: DataFrame, cols) -> DataFrame:
    """One row per column: count, mean, sample and population std, min, max, range."""
    wide = df.agg(F.array(*[
        F.struct(F.lit(i).alias("col_idx"), F.lit(c).alias("col"), F.count(c).alias("n"),
                 F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
                 F.stddev_pop(c).alias("std0"), F.min(c).alias("min"), F.max(c).alias("max"),
                 (F.max(c) - F.min(c)).alias("range"))
        for i, c in enumerate(cols)]).alias("cells"))
    return wide.select(F.inline("cells"))


def profile_values(df: DataFrame, cols) -> dict[str, dict]:
    return {r["col"]: r.asDict() for r in column_profile(df, cols).collect()}


def quantile_table(df: DataFrame, cols, probs) -> DataFrame:
    values = exact_quantiles(df, list(cols), list(probs))
    rows = [(c, float(p), v) for (c, p), v in values.items()]
    return small_table(df.sparkSession, rows, "col string, p double, value double", 64)


def _pair_moments(df: DataFrame, cols) -> tuple[np.ndarray, np.ndarray]:
    """For every column pair, over the rows that know both: count, sums, square sums and product sum.

    One scan of Arrow batches with a few matrix products each; columns are centred first. Only
    these matrices are shuffled, one set per task.
    """
    head = df.agg(*[F.avg(c).alias(f"a{i}") for i, c in enumerate(cols)],
                  *[(F.min(c) < F.max(c)).alias(f"v{i}") for i, c in enumerate(cols)]).first()
    mid = np.array([head[f"a{i}"] if head[f"a{i}"] is not None else 0.0 for i in range(len(cols))])
    varies = np.array([bool(head[f"v{i}"]) for i in range(len(cols))])

    def partial(batches):
        sums = np.zeros((4, len(cols), len(cols)))
        for pdf in batches:
            x = pdf.to_numpy(float) - mid
            known = ~np.isnan(x)
            x[~known] = 0.0
            k = known.astype(float)
            sums += np.stack([k.T @ k, x.T @ k, (x * x).T @ k, x.T @ x])
        yield pd.DataFrame({"m": [sums.ravel().tolist()]})

    values = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"x{i}") for i, c in enumerate(cols)])
    flat = (values.mapInPandas(partial, "m array<double>").select(F.posexplode("m").alias("at", "v"))
            .groupBy("at").agg(F.sum("v").alias("v")).collect())
    out = np.zeros(4 * len(cols) ** 2)
    for r in flat:
        out[r["at"]] = r["v"]
    return out.reshape(4, len(cols), len(cols)), varies


def correlation_long(df: DataFrame, cols) -> DataFrame:
    """Pearson coefficients ``(i, j, r)`` of all ordered column pairs.

    A pair is worked out over the rows that know both columns, at any number of columns. A column
    without spread among these rows gives null.
    """
    cols = list(cols)
    (n, sums, squares, products), varies = _pair_moments(df, cols)
    left = n * squares - sums ** 2  # n^2 variance of i over the rows that know j too
    spread = n * np.diag(squares)[:, None]
    fine = varies[:, None] & varies[None, :] & (left > NO_SPREAD * spread) & (left.T > NO_SPREAD * spread.T)
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.clip((n * products - sums * sums.T) / np.sqrt(left * left.T), -1.0, 1.0)
    np.fill_diagonal(r, 1.0)
    rows = [(i, j, float(r[i, j]) if fine[i, j] else None) for i in range(len(cols)) for j in range(len(cols))]
    return small_table(df.sparkSession, rows, "i int, j int, r double", 24)


def off_diagonal_correlation(df: DataFrame, cols) -> DataFrame:
    """Largest and mean absolute correlation of each column with the others."""
    return (correlation_long(df, cols).where(F.col("i") != F.col("j"))
            .groupBy(F.col("i").alias("col_idx"))
            .agg(F.max(F.abs("r")).alias("max_corr"), F.avg(F.abs("r")).alias("mean_corr")))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("n"))


def missing_counts(df: DataFrame, cols, by: str | None = None) -> DataFrame:
    """Rows, missing cells and missing rate of each column, over all rows or per group."""
    cells = F.array(*[
        F.struct(F.lit(i).alias("col_idx"), F.lit(c).alias("col"), F.count("*").alias("n"),
                 F.count_if(F.col(c).isNull()).alias("n_miss"),
                 F.avg(F.col(c).isNull().cast("double")).alias("rate"))
        for i, c in enumerate(cols)]).alias("cells")
    grouped = df.groupBy(by).agg(cells) if by else df.agg(cells)
    return grouped.select(*([by] if by else []), F.inline("cells"))


def global_missing_rate(df: DataFrame, cols) -> float:
    rates = [r.rate for r in missing_counts(df, cols).collect()]
    return sum(rates) / len(rates)


class ZScaler:
    """Population z-score; a constant column is only centred."""

    def __init__(self, cols):
        self.cols = list(cols)

    def fit(self, df: DataFrame) -> "ZScalerModel":
        stats = profile_values(df, self.cols)
        return ZScalerModel({c: (s["mean"], s["std0"] or 1.0) for c, s in stats.items()})


class ZScalerModel:
    def __init__(self, params: dict[str, tuple[float, float]]):
        self.params = params

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s)
                               for c, (m, s) in self.params.items() if m is not None})


def z_score(df: DataFrame, cols) -> DataFrame:
    return ZScaler(cols).fit(df).transform(df)


def assemble(df: DataFrame, cols, out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep").transform(df)


__all__ = ["ZScaler", "ZScalerModel", "assemble", "column_profile", "correlation_long",
           "global_missing_rate", "missing_counts", "off_diagonal_correlation",
           "profile_values", "quantile_table", "value_counts", "vector_to_array", "z_score"]
