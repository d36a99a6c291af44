"""Chained-equation imputation with any regressor family."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imputeflow.functions.scalars import rounds_for_rate_value, total
from imputeflow.operators.families import LINEAR, TreeSizes, families_for_rate, make_regressor
from imputeflow.operators.forests import bin_edges
from imputeflow.operators.linear import LINEAR_FITS
from imputeflow.operators.patterns import (
    MAX_PATTERN_COLS, PatternMoments, filled_moments, largest_known, pattern_transform, round_changes,
)
from imputeflow.operators.simple import Imputer, columns_by_missing, fill_values
from imputeflow.session import RollingCut
from imputeflow.spec import TableSpec

TOL = 1e-3  # fixed value: a round that changes less, relative to the largest known value, is the last


class ChainedImputer(Imputer):
    """Start from the mean; per round and column regress the known cells on the other columns
    and refill the missing ones; stop when a round changes little or after ``max_iter``.

    ``extra`` are complete predictor columns (class label, cluster features). Linear families
    settle all rounds from one scan of pattern moments; others fit round by round.
    """

    def __init__(self, spec: TableSpec, family: str = "LR", max_iter: int = 5, tol: float | None = TOL,
                 order: str = "ascending", extra=(), sizes: TreeSizes = TreeSizes(), seed: int = 0,
                 stepwise: bool = False):
        self.spec, self.family, self.max_iter, self.tol = spec, family, max_iter, tol
        self.order, self.extra, self.sizes, self.seed = order, list(extra), sizes, seed
        self.stepwise = stepwise

    def _plan(self, df):
        """Columns in use, those to fill in order, their means, and whether patterns will do."""
        cols = [*self.spec.feats, *self.extra]
        known = fill_values(df, cols, "mean")
        cols = [c for c in cols if known[c] is not None]
        holes = columns_by_missing(df, cols, self.order)
        by_pattern = self.family in LINEAR and len(holes) <= MAX_PATTERN_COLS and not self.stepwise
        return cols, holes, known, by_pattern

    def fit(self, df: DataFrame):
        cols, holes, known, by_pattern = self._plan(df)
        if by_pattern:
            return self._fit_patterns(df, cols, holes)
        return self._fit_stepwise(df, cols, holes, known)[0]

    def fit_transform(self, df: DataFrame) -> DataFrame:
        cols, holes, known, by_pattern = self._plan(df)
        if by_pattern:
            return self._fit_patterns(df, cols, holes).transform(df)
        return self._fit_stepwise(df, cols, holes, known, keep=False)[1]

    # ---- linear families: one scan ----

    def _fit_patterns(self, df, cols, holes) -> "PatternChainModel":
        pm = PatternMoments.of(df, cols, holes)
        patterns = [g[0] for g in pm.sums]
        sums = np.stack([pm.sums[p,] for p in patterns]) if patterns else np.zeros((0, pm.q, pm.q))
        maps = pm.start_maps(patterns)
        fit = LINEAR_FITS[self.family]
        chain, by_round = [], [maps.copy()]
        for _ in range(self.max_iter if holes else 0):
            for i, h in enumerate(holes):
                t = cols.index(h) + 1
                others = [a for a in range(1, pm.q) if a != t]
                gone = (np.asarray(patterns) >> i & 1).astype(bool)
                f = fit(filled_moments(sums[~gone], maps[~gone]), t, others)
                chain.append((i, t, others, f))
                maps[gone, t, :] = np.einsum("a,mab->mb", f.coef, maps[gone][:, others, :])
                maps[gone, t, 0] += f.intercept
            by_round.append(maps.copy())
        done = len(by_round) - 1
        if self.tol and holes:
            limit = self.tol * largest_known(df, cols)
            changes = round_changes(df, cols, holes, pm.means, patterns, by_round)
            done = next((r + 1 for r, c in enumerate(changes) if c < limit), done)
        return PatternChainModel(pm, chain[:done * len(holes)], done)

    # ---- any family: one fit per round and column ----

    def _fit_stepwise(self, df, cols, holes, known, keep=True):
        """The chain's models (none of them unless ``keep``) and the filled table. Trees share the bins of the known cells."""
        key = self.spec.key
        edges, sizes = None, {}
        if self.family not in LINEAR and holes:
            edges = bin_edges(df, cols)
            row = df.agg(*[F.count(h).alias(f"n_{h}") for h in holes],
                         *[F.max(F.abs(F.col(h))).cast("double").alias(f"m_{h}") for h in holes]).first()
            sizes = {h: (row[f"n_{h}"], row[f"m_{h}"]) for h in holes}
        state = df.withColumns({f"__gone_{h}": F.col(h).isNull() for h in holes})
        state = state.withColumns({c: F.coalesce(F.col(c), F.lit(known[c])) for c in cols})
        limit = self.tol * largest_known(df, cols) if self.tol and holes else None
        chain, done, rolling = [], 0, RollingCut()
        for r in range(self.max_iter if holes else 0):
            state = state.withColumns({f"__was_{h}": F.col(h) for h in holes})
            for h in holes:
                xs = [c for c in cols if c != h]
                own = None if edges is None else edges[[cols.index(c) for c in [*xs, h]]]
                model = make_regressor(self.family, self.sizes, self.seed).fit(
                    state.where(~F.col(f"__gone_{h}")), xs, h, key=key, edges=own, size=sizes.get(h))
                if keep:
                    chain.append((h, model))
                state = model.add_prediction(state, "__pred", F.col(f"__gone_{h}"))
                state = state.withColumn(h, F.when(F.col(f"__gone_{h}"), F.col("__pred"))
                                         .otherwise(F.col(h))).drop("__pred")
                if self.family not in LINEAR:
                    state = rolling.cut(state)
            if self.family in LINEAR:
                state = rolling.cut(state)
            done = r + 1
            if limit is not None:
                moved = total([F.abs(F.col(h) - F.col(f"__was_{h}")) for h in holes])
                if state.agg(F.max(moved)).first()[0] < limit:
                    break
        names = [*df.columns]
        return StepChainModel(key, cols, known, chain, done), state.select(*names)


class PatternChainModel:
    def __init__(self, pm: PatternMoments, chain, rounds: int):
        self.cols, self.holes, self.means = pm.cols, pm.holes, pm.means
        self.chain, self.rounds = chain, rounds

    def maps_for(self, patterns) -> np.ndarray:
        maps = PatternMoments(self.cols, self.holes, self.means, {}).start_maps(patterns)
        for i, t, others, f in self.chain:
            gone = (np.asarray(patterns) >> i & 1).astype(bool)
            maps[gone, t, :] = np.einsum("a,mab->mb", f.coef, maps[gone][:, others, :])
            maps[gone, t, 0] += f.intercept
        return maps

    def transform(self, df: DataFrame) -> DataFrame:
        return pattern_transform(df, self.cols, self.holes, self.means, self.maps_for)


class StepChainModel:
    """Replays the fitted chain on other rows."""

    def __init__(self, key, cols, known, chain, rounds):
        self.key, self.cols, self.known, self.chain, self.rounds = key, cols, known, chain, rounds

    def transform(self, df: DataFrame) -> DataFrame:
        holes = list(dict.fromkeys(h for h, _ in self.chain))
        state = df.withColumns({f"__gone_{h}": F.col(h).isNull() for h in holes})
        state = state.withColumns({c: F.coalesce(F.col(c), F.lit(self.known[c])) for c in self.cols})
        rolling = RollingCut()
        for n, (h, model) in enumerate(self.chain):
            if n and n % len(holes) == 0 and not df.isStreaming:
                state = rolling.cut(state)
            state = model.add_prediction(state, "__pred", F.col(f"__gone_{h}"))
            state = state.withColumn(h, F.when(F.col(f"__gone_{h}"), F.col("__pred"))
                                     .otherwise(F.col(h))).drop("__pred")
        return state.select(*df.columns)


def chained_imputers_for_rate(spec: TableSpec, rate: float, sizes: TreeSizes = TreeSizes(),
                              seed: int = 0, tol: float = TOL) -> dict[str, ChainedImputer]:
    """Every family that is tried at this rate, with the rounds the rate calls for."""
    return {name: ChainedImputer(spec, name, rounds_for_rate_value(rate), tol, sizes=sizes, seed=seed)
            for name in families_for_rate(rate)}


# The three classic chained imputers (family, seed), left to right, five rounds.
CLASSIC_SEEDS = {"LR": 0, "RF": 2, "GB": 3}
# Their tree sizes, the libraries' own defaults.
CLASSIC_SIZES = TreeSizes(rf_trees=100, gb_rounds=100, gb_step=0.1, gb_depth=3)


def classic_imputer(spec: TableSpec, family: str, extra=(), sizes: TreeSizes = CLASSIC_SIZES,
                    rounds: int = 5) -> ChainedImputer:
    return ChainedImputer(spec, family, rounds, TOL, "roman", extra, sizes, CLASSIC_SEEDS[family])


def baseline_forest(spec: TableSpec, sizes: TreeSizes = TreeSizes(), rounds: int = 20) -> ChainedImputer:
    """The yardstick of the comparison: a forest chain of up to twenty rounds."""
    return ChainedImputer(spec, "RF", rounds, TOL, sizes=sizes)
