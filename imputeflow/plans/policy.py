"""Learning which regressor family suits which missing rate and column."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imputeflow.functions.scalars import MISSING_RATES, closest_rate_value
from imputeflow.operators.classify import label_index
from imputeflow.operators.families import TreeSizes
from imputeflow.operators.metrics import add_rmse_std, carries, cell_rmse, repeated_keys, scores_frame
from imputeflow.operators.mice import chained_imputers_for_rate
from imputeflow.operators.split import stratified_folds
from imputeflow.operators.stats import assemble, column_profile, off_diagonal_correlation
from imputeflow.session import cut_lineage, side_by_side
from imputeflow.spec import TableSpec

META_FEATURES = ("rate", "col_idx", "col_mean", "col_std", "col_range", "max_corr", "mean_corr")


def score_imputers(truth: DataFrame, scenarios: dict, spec: TableSpec, imputers_for) -> DataFrame:
    """RMSE per mechanism, rate, imputer and column; one frame for all of them.

    ``imputers_for(rate)`` names the imputers to try. Each is a chain of Spark jobs; only
    its few scores come back. Scenarios that carry the truth are scored without moving rows, but those of repeated keys.
    """
    repeated = repeated_keys(truth, spec.key) if any(carries(t, spec) for t in scenarios.values()) else None

    def score(task):
        mech, rate, masked, name, imputer = task
        imputed = imputer.fit_transform(masked)
        return [(float(rate), name, r["col"], r.rmse, mech) for r in cell_rmse(truth, masked, imputed, spec, repeated).collect()]

    tasks = [(mech, rate, masked, name, imputer) for (mech, rate), masked in scenarios.items()
             for name, imputer in imputers_for(rate).items()]
    return scores_frame(truth.sparkSession, [row for rows in side_by_side(score, tasks) for row in rows])


def score_families(truth: DataFrame, scenarios: dict, spec: TableSpec, sizes: TreeSizes = TreeSizes(),
                   only=None) -> DataFrame:
    """Scores of every family tried at each rate, with the RMSE in column stds as well."""
    def imputers(rate):
        chain = chained_imputers_for_rate(spec, rate, sizes)
        return {n: c for n, c in chain.items() if only is None or n in only}

    scores = score_imputers(truth, scenarios, spec, imputers)
    return add_rmse_std(scores, column_profile(truth, spec.feats))


def best_by(scores: DataFrame, keys: list[str], value: str = "rmse") -> DataFrame:
    """The imputer of least mean score for each key; the first name wins a tie."""
    mean = scores.groupBy(*keys, "imp").agg(F.avg(value).alias("score"))
    return mean.groupBy(*keys).agg(F.min_by("imp", F.struct("score", "imp")).alias("imp"),
                                   F.min("score").alias("score"))


def best_by_rate(scores: DataFrame) -> DataFrame:
    return best_by(scores, ["rate"], "rmse")


def best_by_rate_col(scores: DataFrame, value: str = "rmse_std") -> DataFrame:
    return best_by(scores, ["rate", "col"], value)


def policy_values(by_rate: DataFrame, by_rate_col: DataFrame) -> tuple[dict, dict]:
    """The two tables as the mappings the imputers take; a row per rate, or rate and column."""
    return ({r.rate: r.imp for r in by_rate.collect()},
            {(r.rate, r["col"]): r.imp for r in by_rate_col.collect()})


def look_up_policy(asked: DataFrame, by_rate_col: DataFrame, by_rate: DataFrame | None = None) -> DataFrame:
    """Adds the family for each ``(rate_bin, col_idx)``: column table, rate table, else LR."""
    fine = by_rate_col.select(F.col("rate").alias("rate_bin"), F.col("col").alias("col_idx"),
                              F.col("imp").alias("__fine"))
    out = asked.join(F.broadcast(fine), ["rate_bin", "col_idx"], "left")
    if by_rate is not None:
        coarse = by_rate.select(F.col("rate").alias("rate_bin"), F.col("imp").alias("__coarse"))
        out = out.join(F.broadcast(coarse), "rate_bin", "left")
    else:
        out = out.withColumn("__coarse", F.lit(None).cast("string"))
    return out.withColumn("imp", F.coalesce("__fine", "__coarse", F.lit("LR"))).drop("__fine", "__coarse")


def column_features(truth: DataFrame, spec: TableSpec) -> DataFrame:
    profile = column_profile(truth, spec.feats).select(
        "col_idx", F.col("mean").alias("col_mean"), F.col("std").alias("col_std"),
        F.col("range").alias("col_range"))
    return profile.join(F.broadcast(off_diagonal_correlation(truth, spec.feats)), "col_idx")


def meta_table(truth: DataFrame, spec: TableSpec, by_rate_col: DataFrame) -> DataFrame:
    """One training row per rate and column: the column's statistics and its best family."""
    best = by_rate_col.select("rate", F.col("col").alias("col_idx"), F.col("imp").alias("best_imp"))
    return best.join(F.broadcast(column_features(truth, spec)), "col_idx").select(*META_FEATURES, "best_imp")


class MetaSelector:
    """A forest that names a family from missing rate and column statistics."""

    def __init__(self, bins=MISSING_RATES, num_trees: int = 200, max_depth: int = 10, seed: int = 0):
        self.bins, self.num_trees, self.max_depth, self.seed = bins, num_trees, max_depth, seed

    def _forest(self):
        return RandomForestClassifier(numTrees=self.num_trees, maxDepth=self.max_depth, seed=self.seed,
                                      labelCol="__y", featuresCol="features")

    def fit(self, truth: DataFrame, spec: TableSpec, by_rate_col: DataFrame) -> "MetaSelector":
        table = cut_lineage(meta_table(truth, spec, by_rate_col))
        self.classes_ = sorted(r[0] for r in table.select("best_imp").distinct().collect())
        self.columns_ = {r.col_idx: r.asDict() for r in column_features(truth, spec).collect()}
        self.table_ = assemble(label_index(table, "best_imp", self.classes_), META_FEATURES)
        self.model_ = self._forest().fit(self.table_) if len(self.classes_) > 1 else None
        return self

    def cross_validate(self, folds: int = 3) -> tuple[float, float]:
        """Mean and population std of the accuracy over stratified folds."""
        if self.model_ is None:
            return 1.0, 0.0
        keyed = self.table_.withColumn("k", F.concat_ws("|", F.col("rate").cast("string"), F.col("col_idx").cast("string")))
        parts = cut_lineage(stratified_folds(keyed, TableSpec("k", META_FEATURES, "best_imp"), folds, self.seed))
        found = []
        for f in range(1, folds + 1):
            test = parts.where(F.col("fold") == f)
            if test.isEmpty():
                continue
            scored = self._forest().fit(parts.where(F.col("fold") != f)).transform(test)
            found.append(scored.agg(F.avg((F.col("prediction") == F.col("__y")).cast("double"))).first()[0])
        mean = sum(found) / len(found)
        return mean, (sum((a - mean) ** 2 for a in found) / len(found)) ** 0.5

    def predict_frame(self, asked: DataFrame) -> DataFrame:
        """Adds ``imp`` to rows that hold the meta features."""
        if self.model_ is None:
            return asked.withColumn("imp", F.lit(self.classes_[0]))
        scored = self.model_.transform(assemble(asked, META_FEATURES))
        names = F.array(*[F.lit(c) for c in self.classes_])
        return scored.withColumn("imp", names[F.col("prediction").cast("int")]).select(*asked.columns, "imp")

    def predict_many(self, asked: list[tuple[int, float]]) -> list[str]:
        """Families for (column number, missing rate) pairs, all in one job."""
        if not asked:
            return []
        spark = self.table_.sparkSession
        rows = [(i, closest_rate_value(rate, self.bins), int(j), *[float(self.columns_[j][f]) for f in META_FEATURES[2:]])
                for i, (j, rate) in enumerate(asked)]
        fields = "i int, rate double, col_idx int, " + ", ".join(f"{f} double" for f in META_FEATURES[2:])
        found = self.predict_frame(spark.createDataFrame(rows, fields)).collect()
        return [r.imp for r in sorted(found, key=lambda r: r.i)]

    def predict_imp(self, col_idx: int, miss_rate: float) -> str:
        return self.predict_many([(col_idx, miss_rate)])[0]
