"""Second moments by missing pattern: all a linear imputer needs to know of the table.

Whatever rounds a linear method runs, an imputed cell stays a fixed linear function of its
row's known cells, one function per pattern of missing columns. So one scan that sums the
moments of every pattern serves all rounds, and the fitted method is one small table of
weights per pattern that is joined to the rows. The size of both is bounded by the number
of patterns, never by the number of rows; past ``MAX_PATTERN_COLS`` columns with missing
cells the callers go round by round instead.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from imputeflow.functions.scalars import total
from imputeflow.operators.linear import moments
from imputeflow.session import small_table

MAX_PATTERN_COLS = 10


def pattern_column(cols) -> Column:
    """Bit i is set where column i is missing."""
    return total([F.when(F.col(c).isNull(), 1 << i).otherwise(0) for i, c in enumerate(cols)]) \
        if cols else F.lit(0)


class PatternMoments:
    """Moments of ``[1, x - mean]`` with zeros for missing cells, per group and pattern."""

    def __init__(self, cols, holes, means, sums):
        self.cols, self.holes, self.means, self.sums = list(cols), list(holes), means, sums

    @classmethod
    def of(cls, df: DataFrame, cols, holes, by: str | None = None,
           weight: Column | None = None) -> "PatternMoments":
        means = df.agg(*[F.avg(c).alias(c) for c in cols]).first().asDict()
        exprs = [F.coalesce(F.col(c) - F.lit(means[c]), F.lit(0.0)) for c in cols]
        src = df.withColumn("__pattern", pattern_column(holes))
        return cls(cols, holes, means, 
                   moments(src, exprs, ([by] if by else []) + ["__pattern"], weight))

    @property
    def q(self) -> int:
        return len(self.cols) + 1

    def hole_index(self) -> list[int]:
        return [self.cols.index(h) + 1 for h in self.holes]

    def start_maps(self, patterns, fills: dict | None = None) -> np.ndarray:
        """Per pattern the map from the known cells to the filled row, in centred units."""
        maps = np.repeat(np.eye(self.q)[None], len(patterns), axis=0)
        for i, h in enumerate(self.hole_index()):
            gone = (np.asarray(patterns, int) >> i & 1).astype(bool)
            maps[gone, h, :] = 0.0
            if fills:
                name = self.cols[h - 1]
                maps[gone, h, 0] = fills[name] - self.means[name]
        return maps


def filled_moments(sums: np.ndarray, maps: np.ndarray) -> np.ndarray:
    return np.einsum("mab,mbc,mdc->ad", maps, sums, maps, optimize=True)


def pattern_transform(df: DataFrame, cols, holes, means: dict, maps_for) -> DataFrame:
    """Fill the holes of every row by its pattern's weights.

    ``maps_for(patterns)`` gives the maps; all 2^d patterns are tabled, so that rows with a
    pattern unseen in fit (a test set, a stream) are filled as well.
    """
    q = len(cols) + 1
    patterns = np.arange(1 << len(holes))
    at = [cols.index(h) + 1 for h in holes]
    maps = maps_for(patterns)[:, at, :]
    rows = [(int(p), maps[i].ravel().tolist()) for i, p in enumerate(patterns)]
    weights = small_table(df.sparkSession, rows, "__pattern int, __w array<double>", 8 * q * len(holes))
    known = [F.lit(1.0)] + [F.coalesce(F.col(c) - F.lit(means[c]), F.lit(0.0)) for c in cols]
    filled = {c: F.coalesce(F.col(c), F.lit(means[c])) for c in cols}
    for i, h in enumerate(holes):
        value = total([F.col("__w")[i * q + j] * known[j] for j in range(q)])
        filled[h] = F.coalesce(F.col(h), F.lit(means[h]) + value)
    return (df.withColumn("__pattern", pattern_column(holes)).join(weights, "__pattern", "left")
            .withColumns(filled).select(*df.columns))


def round_changes(df: DataFrame, cols, holes, means, patterns, maps_by_round) -> list[float]:
    """Largest row sum of absolute changes for each round, from one scan."""
    q = len(cols) + 1
    at = [cols.index(h) + 1 for h in holes]
    steps = {int(p): np.stack([b[i][at] - a[i][at] for a, b in zip(maps_by_round, maps_by_round[1:])])
             for i, p in enumerate(patterns)}
    n_rounds, n_holes = len(maps_by_round) - 1, len(holes)

    def partial(batches):
        for pdf in batches:
            x = np.asarray(pdf["x"].tolist(), float).reshape(-1, q)
            top = np.zeros(n_rounds)
            for p, where in pdf.groupby("pattern").indices.items():
                moved = x[where] @ steps[int(p)].reshape(-1, q).T
                moved = np.abs(moved.reshape(-1, n_rounds, n_holes)).sum(axis=2)
                top = np.maximum(top, moved.max(axis=0))
            yield pd.DataFrame({"top": [top.tolist()]})

    known = [F.lit(1.0)] + [F.coalesce(F.col(c) - F.lit(means[c]), F.lit(0.0)) for c in cols]
    tops = (df.select(F.array(*known).alias("x"), pattern_column(holes).alias("pattern"))
            .mapInPandas(partial, "top array<double>"))
    row = tops.agg(F.array(*[F.max(F.col("top")[r]) for r in range(n_rounds)]).alias("t")).first()
    return [t or 0.0 for t in row.t]


def largest_known(df: DataFrame, cols) -> float:
    row = df.agg(*[F.max(F.abs(c)).alias(c) for c in cols]).first()
    return max((v for v in row if v is not None), default=0.0)


__all__ = ["MAX_PATTERN_COLS", "PatternMoments", "filled_moments", "largest_known",
           "pattern_column", "pattern_transform", "round_changes"]
