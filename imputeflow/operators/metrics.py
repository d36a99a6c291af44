"""Scores: the three RMSEs, accuracy, one-vs-one AUC, and their summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from imputeflow.functions.scalars import total
from imputeflow.operators.amputate import GAP, TRUTH
from imputeflow.session import BROADCAST_LIMIT_BYTES, cut_lineage, small_table
from imputeflow.spec import TableSpec

ROWS_PER_BIN = 100_000
MAX_SCORE_BINS = 512


@dataclass(frozen=True)
class RepeatedKeys:
    """Hashes of the keys that more than one row has, and a few others: only rows with these meet others than themselves by key."""

    key: str
    hashes: DataFrame
    n: int

    def _meet(self, df: DataFrame, how: str) -> DataFrame:
        hashes = F.broadcast(self.hashes) if self.n * 16 <= BROADCAST_LIMIT_BYTES else self.hashes
        return df.join(hashes, F.xxhash64(self.key) == F.col("__hash"), how)

    def without(self, df: DataFrame) -> DataFrame:
        """Rows whose key is their own."""
        keyed = df.where(F.col(self.key).isNotNull())
        return self._meet(keyed, "left_anti") if self.n else keyed

    def only(self, df: DataFrame) -> DataFrame:
        return self._meet(df, "left_semi")


def repeated_keys(df: DataFrame, key: str) -> RepeatedKeys:
    hashes = (df.where(F.col(key).isNotNull()).groupBy(F.xxhash64(key).alias("__hash")).agg(F.count("*").alias("n"))
              .where("n > 1").select("__hash"))
    hashes = cut_lineage(hashes)
    return RepeatedKeys(key, hashes, hashes.count())


def carries(df: DataFrame, spec: TableSpec) -> bool:
    """Whether a table has the complete values and masks of all features beside them."""
    return {f"{at}{f}" for at in (TRUTH, GAP) for f in spec.feats} <= set(df.columns)


def paired_cells(truth: DataFrame, masked: DataFrame, imputed: DataFrame, spec: TableSpec,
                 repeated: RepeatedKeys | None = None) -> DataFrame:
    """Squared error of every originally missing cell, one struct per row and column.

    The three tables meet on the row key while they are still wide, so one row moves once
    and not once per column. With ``repeated``, the truth's, rows of an imputed table that carries the truth are
    moved only where their key repeats.
    """
    feats = spec.feats
    if repeated is not None and carries(imputed, spec):
        own = repeated.without(imputed).select(spec.key, *[
            F.when(F.col(f"{GAP}{f}"), F.pow(F.col(f"{TRUTH}{f}") - F.col(f), 2)).alias(f) for f in feats])
        if not repeated.n:
            return own
        plain = [repeated.only(t).select(spec.key, *feats) for t in (truth, masked, imputed)]
        return own.unionByName(paired_cells(*plain, spec))
    t = truth.select(spec.key, *[F.col(f).alias(f"t_{f}") for f in feats])
    m = masked.select(spec.key, *[F.col(f).isNull().alias(f"m_{f}") for f in feats])
    i = imputed.select(spec.key, *[F.col(f).alias(f"i_{f}") for f in feats])
    both = i.join(m, spec.key).join(t, spec.key)
    return both.select(spec.key, *[
        F.when(F.col(f"m_{f}"), F.pow(F.col(f"t_{f}") - F.col(f"i_{f}"), 2)).alias(f) for f in feats])


def cell_rmse(truth, masked, imputed, spec: TableSpec, repeated: RepeatedKeys | None = None) -> DataFrame:
    """RMSE of each column over its missing cells; a column without any drops out."""
    sq = paired_cells(truth, masked, imputed, spec, repeated)
    cells = F.array(*[F.struct(F.lit(j).alias("col"), F.sqrt(F.avg(f)).alias("rmse"))
                      for j, f in enumerate(spec.feats)])
    return sq.agg(cells.alias("c")).select(F.inline("c")).where(F.col("rmse").isNotNull())


def pooled_rmse(truth, masked, imputed, spec: TableSpec) -> DataFrame:
    """One RMSE over all missing cells of all columns; null if there is none."""
    sq = paired_cells(truth, masked, imputed, spec)
    s = total([F.coalesce(F.sum(f), F.lit(0.0)) for f in spec.feats])
    n = total([F.count(f) for f in spec.feats])
    return sq.agg(F.sqrt(F.try_divide(s, n)).alias("rmse"))


def table_rmse(truth: DataFrame, imputed: DataFrame, spec: TableSpec) -> DataFrame:
    """Mean over the columns (a numeric label included) of the RMSE over all rows."""
    cols = [*spec.feats] + ([spec.label] if spec.label else [])
    t = truth.select(spec.key, *[F.col(c).cast("double").alias(f"t_{c}") for c in cols])
    both = imputed.select(spec.key, *[F.col(c).cast("double").alias(c) for c in cols]).join(t, spec.key)
    parts = [F.sqrt(F.avg(F.pow(F.col(c) - F.col(f"t_{c}"), 2))) for c in cols]
    return both.agg((total(parts) / F.lit(float(len(cols)))).alias("rmse"))


def add_rmse_std(scores: DataFrame, profile: DataFrame) -> DataFrame:
    """The RMSE in units of the complete column's population std."""
    std = F.broadcast(profile.select(F.col("col_idx").alias("col"), "std0"))
    return scores.join(std, "col").withColumn("rmse_std", F.col("rmse") / F.col("std0")).drop("std0")


def column_difficulty(scores: DataFrame, value: str = "rmse") -> DataFrame:
    """Mean, std and maximum of the score per column, hardest first."""
    return (scores.groupBy("col")
            .agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.max(value).alias("max"))
            .orderBy(F.desc("mean"), "col"))


def score_pivot(scores: DataFrame, rates, imps) -> DataFrame:
    """One row per column, one field per rate and method."""
    keys = [f"{r}_{i}" for r in rates for i in imps]
    named = scores.withColumn("rate_imp", F.concat_ws("_", F.col("rate").cast("string"), "imp"))
    return named.groupBy("col").pivot("rate_imp", keys).agg(F.avg("rmse"))


def accuracy(scored: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    hit = (F.col(label).cast("double") == F.col(prediction).cast("double")).cast("double")
    return scored.agg(F.avg(hit).alias("accuracy"))


def ovo_auc(scored: DataFrame, label: str, prob: str, classes: list) -> DataFrame:
    """Macro one-vs-one AUC; ``prob`` is an array in the order of ``classes``.

    Each ordered pair (a, b) ranks the rows of both classes by the score of a. Equal scores
    are merged first; the ranking is then a running count inside score bins of about equal
    size plus the totals of the bins below, so no task sees a whole pair. A pair of which a class has no row
    is left out of the mean.
    """
    pairs = [(i, j) for i in range(len(classes)) for j in range(len(classes)) if i != j]
    cells = F.array(*[
        F.struct(F.lit(i * len(classes) + j).alias("pair"), F.col(prob)[i].alias("score"),
                 (F.col(label) == F.lit(classes[i])).cast("long").alias("pos"),
                 (F.col(label) == F.lit(classes[j])).cast("long").alias("neg")) for i, j in pairs])
    points = (scored.select(F.inline(cells)).where((F.col("pos") + F.col("neg")) > 0)
              .groupBy("pair", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    bins = min(MAX_SCORE_BINS, max(64, points.count() // ROWS_PER_BIN))
    # edges of each pair's own scores, so that pairs with scores close together are split too
    edges = points.groupBy("pair").agg(F.percentile_approx("score", [i / bins for i in range(1, bins)]).alias("edges"))
    place = F.size(F.filter("edges", lambda e: F.col("score") > e))
    binned = points.join(edges, "pair").withColumn("bin", place).drop("edges")
    sums = binned.groupBy("pair", "bin").agg(F.sum("neg").alias("bin_neg"))
    below = Window.partitionBy("pair").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("pair", "bin", F.coalesce(F.sum("bin_neg").over(below), F.lit(0)).alias("before"))
    inside = Window.partitionBy("pair", "bin").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    placed = (binned.withColumn("lower", F.coalesce(F.sum("neg").over(inside), F.lit(0)))
              .join(offsets, ["pair", "bin"]))
    won = F.col("pos") * (F.col("before") + F.col("lower") + F.col("neg") / 2)
    aucs = placed.groupBy("pair").agg(F.try_divide(F.sum(won), F.sum("pos") * F.sum("neg")).alias("auc"))
    return aucs.agg(F.avg("auc").alias("auc"))


def fold_summary(scores: DataFrame, value: str = "score") -> DataFrame:
    return scores.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def scores_frame(spark, rows) -> DataFrame:
    return small_table(spark, rows, "rate double, imp string, col int, rmse double, mech string", 64)
