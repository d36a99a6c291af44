"""The regressor families a chained or adaptive imputer can pick from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imputeflow.operators.forests import Forest, Growth, ModelSpec, bin_edges, fit_models, forest_rows, predicted
from imputeflow.operators.linear import LINEAR_FITS, moments

# Fixed value: tree families are tried from this missing rate on.
TREES_FROM_RATE = 0.20
LINEAR = ("LR", "BR")
TREES = ("RF", "ET", "GB")


@dataclass(frozen=True)
class TreeSizes:
    """Work of the tree families. The defaults are the studied ones."""

    rf_trees: int = 300
    et_trees: int = 300
    gb_rounds: int = 200
    gb_step: float = 0.05
    gb_depth: int = 3
    max_depth: int = 10
    min_leaf: int = 1


def families_for_rate(rate: float) -> tuple[str, ...]:
    """Linear families at every rate, tree families only where much is missing."""
    return LINEAR + (TREES if rate >= TREES_FROM_RATE else ())


class LinearRegressor:
    def __init__(self, name: str):
        self.name = name

    def fit(self, df: DataFrame, xs: list[str], y: str, **known) -> "LinearModel":
        shift = df.agg(*[F.avg(c).alias(c) for c in [*xs, y]]).first().asDict()
        m = moments(df, [F.col(c) - F.lit(shift[c]) for c in [*xs, y]])[()]
        fit = LINEAR_FITS[self.name](m, len(xs) + 1, list(range(1, len(xs) + 1)))
        return LinearModel(fit, xs, shift, shift[y])


class LinearModel:
    def __init__(self, fit, xs, shift, shift_y):
        self.fit, self.xs, self.shift, self.shift_y = fit, list(xs), shift, shift_y

    def _centred(self):
        return [F.col(x) - F.lit(self.shift[x]) for x in self.xs]

    def value(self):
        return F.lit(self.shift_y) + self.fit.predict(self._centred())

    def std(self):
        return self.fit.spread(self._centred())

    def add_prediction(self, df: DataFrame, out: str, where=None) -> DataFrame:
        return df.withColumn(out, self.value())


def growth_for(name: str, sizes: TreeSizes, seed: int, members: int = 1) -> Growth:
    """How a family's trees grow; an ensemble's members are shares of one forest (boosted members are all alike)."""
    if name == "GB":
        return Growth("GB", sizes.gb_rounds, sizes.gb_depth, sizes.min_leaf, sizes.gb_step, seed)
    trees = sizes.et_trees if name == "ET" else sizes.rf_trees
    return Growth(name, trees * members, sizes.max_depth, sizes.min_leaf, seed=seed)


class TreeRegressor:
    """A tree family on one target; ``edges`` and ``size`` (rows, largest target) can be given where they are known."""

    def __init__(self, name: str, sizes: TreeSizes, seed: int):
        self.name, self.sizes, self.seed = name, sizes, seed

    def fit(self, df: DataFrame, xs: list[str], y: str, key: str | None = None, edges=None, size=None) -> "TreeModel":
        cols = [*xs, y]
        edges = bin_edges(df, cols) if edges is None else edges
        spec = ModelSpec(0, tuple(range(len(xs))), len(xs))
        found = fit_models(forest_rows(df, cols, key), [spec], growth_for(self.name, self.sizes, self.seed), edges,
                           size and {0: size})
        return TreeModel(found[0], xs)


class TreeModel:
    def __init__(self, forest: Forest, xs):
        self.forest, self.xs = forest, list(xs)

    def add_prediction(self, df: DataFrame, out: str, where=None) -> DataFrame:
        """The prediction for the rows in ``where`` (all rows without it), null for others."""
        said = predicted(df.sparkSession, {0: self.forest}, self.xs, F.lit(0), F.lit(True) if where is None else where)
        return df.withColumn(out, said["mean"])


def make_regressor(name: str, sizes: TreeSizes = TreeSizes(), seed: int = 0):
    if name in LINEAR:
        return LinearRegressor(name)
    if name in TREES:
        return TreeRegressor(name, sizes, seed)
    raise ValueError(f"unknown regressor family {name!r}")
