"""Plain fills: mean, median, most frequent value, constant."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imputeflow.operators.orderstat import exact_medians, stack_columns
from imputeflow.operators.stats import missing_counts
from imputeflow.spec import TableSpec


class Imputer:
    """``fit(df)`` learns from a masked table and returns a model with ``transform(df)``."""

    def fit(self, df: DataFrame):
        raise NotImplementedError

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


def most_frequent(df: DataFrame, cols) -> dict[str, float]:
    """Per column the commonest value, the lowest on a tie; counted before any shuffle."""
    counted = stack_columns(df, [F.col(c) for c in cols]).groupBy("grp", "val").count()
    best = counted.groupBy("grp").agg(F.min_by("val", F.struct(-F.col("count"), F.col("val"))).alias("v"))
    found = {r.grp: r.v for r in best.collect()}
    return {c: found.get(i) for i, c in enumerate(cols)}


def fill_values(df: DataFrame, cols, strategy: str = "mean", fill_value: float | None = None) -> dict:
    cols = list(cols)
    if strategy == "mean":
        row = df.agg(*[F.avg(c).alias(c) for c in cols]).first()
        return {c: row[c] for c in cols}
    if strategy == "median":
        return exact_medians(df, cols)
    if strategy == "most_frequent":
        return most_frequent(df, cols)
    if strategy == "constant":
        return {c: 0.0 if fill_value is None else float(fill_value) for c in cols}
    raise ValueError(f"unknown strategy {strategy!r}")


class SimpleImputer(Imputer):
    def __init__(self, spec: TableSpec, strategy: str = "mean", fill_value: float | None = None):
        self.spec, self.strategy, self.fill_value = spec, strategy, fill_value

    def fit(self, df: DataFrame) -> "SimpleImputerModel":
        fills = fill_values(df, self.spec.feats, self.strategy, self.fill_value)
        empty = [c for c, v in fills.items() if v is None]
        if empty:
            warnings.warn(f"columns without any value stay null: {empty}", stacklevel=2)
        return SimpleImputerModel(fills)


class SimpleImputerModel:
    """Keeps the values learnt in fit and reuses them on other tables, streams included."""

    def __init__(self, fills: dict[str, float | None]):
        self.fills = fills

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(float(v)))
                               for c, v in self.fills.items() if v is not None})


def complete_cases(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Rows without a missing feature; an empty result is an error."""
    rows = df.dropna(subset=list(spec.feats))
    if rows.isEmpty():
        raise ValueError("no complete row")
    return rows


def columns_by_missing(df: DataFrame, cols, order: str = "ascending") -> list[str]:
    """The columns with missing cells, fewest first, or left to right (``roman``)."""
    found = [r for r in missing_counts(df, cols).orderBy("col_idx").collect() if 0 < r.n_miss < r.n]
    if order == "ascending":
        found.sort(key=lambda r: (r.n_miss, r.col_idx))
    elif order != "roman":
        raise ValueError(f"unknown order {order!r}")
    return [r["col"] for r in found]
