"""Stratified folds, and writing and reading them by partition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imputeflow.functions.hashing import hash_uniform
from imputeflow.functions.scalars import total
from imputeflow.operators.orderstat import draw_cuts
from imputeflow.spec import TableSpec


def stratified_folds(df: DataFrame, spec: TableSpec, k: int = 5, seed: int = 7,
                     out: str = "fold") -> DataFrame:
    """Adds a fold number 1..k; per class the fold sizes differ by at most one.

    The rows of a class are ordered by a seeded draw and cut into k runs, the longer runs
    first. Only the k-1 cut values per class are looked up, so no row is moved or ranked.
    """
    classes = sorted(r[0] for r in df.select(spec.label).distinct().collect())
    draw = hash_uniform(seed, "fold", spec.key)
    number = None
    for g, c in enumerate(classes):
        is_class = F.col(spec.label) == F.lit(c)
        number = F.when(is_class, g) if number is None else number.when(is_class, g)

    def run_ends(n):
        base, extra = divmod(n, k)
        return [base * i + min(i, extra) for i in range(1, k)]

    groups = list(range(len(classes)))
    cuts, counts = draw_cuts(df, spec.key, [(draw, number)], groups,
                             lambda n: {g: run_ends(n[g]) for g in groups})
    fold = None
    for g, c in enumerate(classes):
        later = [F.when(cuts[g, s].holds(F.col("__draw"), F.col(spec.key)), 0).otherwise(1)
                 for s in run_ends(counts[g])]
        run = total([F.lit(1), *later])
        is_class = F.col(spec.label) == F.lit(c)
        fold = F.when(is_class, run) if fold is None else fold.when(is_class, run)
    return df.withColumn("__draw", draw).withColumn(out, fold.cast("int")).drop("__draw")


def write_folds(df: DataFrame, path: str, fold: str = "fold", fmt: str = "parquet") -> None:
    """One partition per fold; an existing set is replaced."""
    df.write.mode("overwrite").partitionBy(fold).option("header", True).format(fmt).save(path)


def read_fold(spark, path: str, number: int, train: bool, fmt: str = "parquet", schema=None,
              fold: str = "fold") -> DataFrame:
    """Train rows (every other fold) or test rows (this fold); whole partitions are pruned."""
    reader = spark.read.option("header", True).format(fmt)
    df = (reader.schema(schema) if schema is not None else reader).load(path)
    return df.where(F.col(fold) != number) if train else df.where(F.col(fold) == number)
