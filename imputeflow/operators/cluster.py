"""Clustering and the features made of it."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from imputeflow.functions.hashing import hash_uniform
from imputeflow.functions.scalars import total
from imputeflow.operators.knn import PAIR_BUDGET, PairDistances, list_rows
from imputeflow.operators.stats import assemble
from imputeflow.session import cut_lineage, small_table

# Fuzzifier, rounds and tolerance of fuzzy c-means.
FUZZIFIER = 2.0
FCM_ROUNDS = 150
FCM_TOL = 1e-5
LEAST_SQ_DISTANCE = 1e-12
BLOCK_BYTES = 32 << 20  # of rows that all others meet at a time
TASK_ROWS = 32768
CLOSE = 1e7  # times the rounding of a matrix product; squared distances up to there are summed up column by column


def squared_distance(cols, center) -> Column:
    return total([(F.col(c) - F.lit(float(v))) * (F.col(c) - F.lit(float(v))) for c, v in zip(cols, center)])


class CentroidClusterer:
    """Assigns the nearest centre, the lower number on a tie; a plain expression per row."""

    def __init__(self, cols, centers):
        self.cols, self.centers = list(cols), [[float(v) for v in c] for c in centers]

    @property
    def k(self) -> int:
        return len(self.centers)

    def assign(self, df: DataFrame, out: str = "cluster", cols=None) -> DataFrame:
        cols = cols or self.cols
        ranked = F.array(*[F.struct(squared_distance(cols, c).alias("d"), F.lit(i).alias("i"))
                           for i, c in enumerate(self.centers)])
        return df.withColumn(out, F.array_min(ranked).getField("i"))

    def membership(self, df: DataFrame, out: str = "u") -> DataFrame:
        return df.withColumn(out, F.array(*memberships(self.cols, self.centers)))


def fit_kmeans(df: DataFrame, cols, k: int = 3, seed: int = 0) -> CentroidClusterer:
    model = KMeans(k=k, seed=seed, featuresCol="__x").fit(assemble(df.select(*cols), cols, "__x"))
    return CentroidClusterer(cols, [c.tolist() for c in model.clusterCenters()])


def memberships(cols, centers, m: float = FUZZIFIER) -> list[Column]:
    d = [F.greatest(squared_distance(cols, c), F.lit(LEAST_SQ_DISTANCE)) for c in centers]
    return [F.lit(1.0) / total([F.pow(dj / dl, F.lit(1.0 / (m - 1))) for dl in d]) for dj in d]


def fuzzy_step(df: DataFrame, cols, centers, m: float = FUZZIFIER) -> DataFrame:
    """The next centres: one row per cluster, from one aggregate without a shuffle of rows."""
    cols = list(cols)
    named = df.select(*cols, F.array(*memberships(cols, centers, m)).alias("u"))
    cells = []
    for j in range(len(centers)):
        w = F.pow(F.col("u")[j], F.lit(m))
        cells.append(F.struct(F.lit(j).alias("cluster"), F.sum(w).alias("weight"),
                              *[(F.sum(w * F.col(c)) / F.sum(w)).alias(c) for c in cols]))
    return named.agg(F.array(*cells).alias("c")).select(F.inline("c"))


def fit_fuzzy_cmeans(df: DataFrame, cols, key: str, k: int = 3, seed: int = 0,
                     rounds: int = FCM_ROUNDS, tol: float = FCM_TOL) -> CentroidClusterer:
    """Fuzzy c-means from the k distinct points of lowest draw; stops when no centre moves by ``tol``."""
    cols = list(cols)
    drawn = df.select(*cols, F.struct(hash_uniform(seed, "fcm", key).alias("u"), F.col(key).alias("k")).alias("__d"))
    start = drawn.groupBy(*cols).agg(F.min("__d").alias("__d")).orderBy("__d").limit(k).collect()
    if len(start) < k:
        raise ValueError(f"{k} clusters need as many distinct rows; the table has {len(start)}")
    centers = np.array([[r[c] for c in cols] for r in start])
    for _ in range(rounds):
        found = fuzzy_step(df, cols, centers.tolist()).orderBy("cluster").collect()
        moved = np.array([[r[c] for c in cols] for r in found])
        shift = np.abs(moved - centers).max()
        centers = moved
        if shift < tol:
            break
    return CentroidClusterer(cols, centers.tolist())


# ---- features ------------------------------------------------------------------------

def one_hot(df: DataFrame, cluster: str = "cluster", k: int = 3, prefix: str = "c") -> DataFrame:
    return df.withColumns({f"{prefix}{i}": (F.col(cluster) == i).cast("double") for i in range(k)})


def centroid_norms(df: DataFrame, cols, cluster: str = "cluster") -> DataFrame:
    """Per cluster the squared norm of its mean row."""
    means = df.groupBy(cluster).agg(*[F.avg(c).alias(c) for c in cols])
    return means.select(cluster, total([F.col(c) * F.col(c) for c in cols]).alias("mcmv"))


def attach(df: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """Columns of another table by row key; a row without a partner gets nulls."""
    return df.join(side, key, "left")


AUGMENTATIONS = ("label", "onehot", "mcmv")


def cluster_features(complete: DataFrame, cols, key: str, clusterer: CentroidClusterer,
                     how: str = "label") -> tuple[DataFrame, list[str]]:
    """``(key, features)`` of the cluster each complete row lies in, and the features' names."""
    tagged = clusterer.assign(complete.select(key, *cols), "cluster")
    if how == "label":
        return tagged.select(key, F.col("cluster").cast("double").alias("cluster")), ["cluster"]
    if how == "onehot":
        names = [f"c{i}" for i in range(clusterer.k)]
        return one_hot(tagged, k=clusterer.k).select(key, *names), names
    if how == "mcmv":
        norms = {r["cluster"]: r.mcmv for r in centroid_norms(tagged, cols).collect()}
        table = small_table(complete.sparkSession, list(norms.items()), "cluster int, mcmv double", 16)
        return tagged.join(table, "cluster").select(key, "mcmv"), ["mcmv"]
    raise ValueError(f"unknown cluster feature {how!r}")


# ---- silhouette ----------------------------------------------------------------------

def silhouette_squared(df: DataFrame, cols, cluster: str = "cluster") -> float:
    """Mean silhouette on squared distances: linear in the rows."""
    vec = assemble(df.select(*cols, F.col(cluster).cast("int").alias("prediction")), cols)
    return ClusteringEvaluator().evaluate(vec)


def distance_sums(qx: np.ndarray, dx: np.ndarray, member: np.ndarray) -> np.ndarray:
    """Per row of ``qx`` the sum of its distances to the rows of each cluster (``member``: rows x clusters of 0 and 1)."""
    pairs = PairDistances(qx, dx) if np.isfinite(qx).all() and np.isfinite(dx).all() else None
    step = max(1, PAIR_BUDGET // max(1, len(dx)))
    sums = [np.zeros((0, member.shape[1]))]
    for at in range(0, len(qx), step):
        rows = slice(at, min(at + step, len(qx)))
        if pairs is None:  # what isn't known or infinite spoils the sums it belongs to
            with np.errstate(all="ignore"):
                sq = sum((qx[rows, j][:, None] - dx[:, j][None, :]) ** 2 for j in range(qx.shape[1]))
        else:
            sq, slack = pairs.all_pairs(rows)
            i, j = np.nonzero(sq <= (CLOSE * slack)[:, None])  # a product's rounding counts between close rows
            sq[i, j] = pairs.exact(i + at, j)
            sq *= qx.shape[1]
        sums.append(np.sqrt(sq) @ member)
    return np.vstack(sums)


def silhouette_rows(df: DataFrame, cols, key: str, cluster: str = "cluster",
                    block_rows: int | None = None) -> DataFrame:
    """``(key, silhouette)`` on plain distances, exact.

    Every row has to meet every other, which is quadratic by definition. All rows meet one block of bounded size after the
    other, which is broadcast and dropped again; only a row's sums per cluster are kept of each.
    """
    cols = list(cols)
    sizes = {r[cluster]: r["count"] for r in df.groupBy(cluster).count().collect()}
    names = sorted(sizes)
    n = sum(sizes.values())
    nb = max(1, math.ceil(n / (block_rows or max(1, BLOCK_BYTES // (8 * len(cols))))))
    where = {c: i for i, c in enumerate(names)}
    rows = df.select(F.col(key).alias("k"), F.col(cluster).cast("int").alias("c"),
                     F.array(*cols).alias("x"), F.pmod(F.xxhash64(key, *cols), F.lit(nb)).cast("int").alias("b"))
    context = df.sparkSession.sparkContext
    rows = cut_lineage(rows.repartition(max(2 * context.defaultParallelism, math.ceil(n / TASK_ROWS))))
    key_type = rows.schema["k"].dataType.simpleString()

    def sums_to(block: int) -> DataFrame:
        held = rows.where(F.col("b") == block).select("c", "x").toArrow()
        dx, member = list_rows(held.column("x"), len(cols)), np.zeros((len(held), len(names)))
        member[np.arange(len(held)), [where[c] for c in held.column("c").to_pylist()]] = 1.0
        shared = context.broadcast((dx, member))

        def meet(batches):
            for q in batches:
                found = distance_sums(np.array(q["x"].tolist(), float).reshape(-1, len(cols)), *shared.value)
                yield pd.DataFrame({"k": q["k"], "c": q["c"], "s": found.tolist()})

        done = cut_lineage(rows.select("k", "c", "x").mapInPandas(meet, f"k {key_type}, c int, s array<double>"))
        shared.destroy()
        return done

    parts = reduce(DataFrame.unionByName, [sums_to(b) for b in range(nb)])
    sums = parts.groupBy("k", "c").agg(F.array(*[F.sum(F.col("s")[i]) for i in range(len(names))]).alias("s"))
    own = a = None
    for i, c in enumerate(names):
        here = F.col("c") == F.lit(c)
        mean = F.col("s")[i] / F.lit(float(max(sizes[c] - 1, 1)))
        size = F.lit(sizes[c])
        a = F.when(here, mean) if a is None else a.when(here, mean)
        own = F.when(here, size) if own is None else own.when(here, size)
    b = F.array_min(F.array(*[F.when(F.col("c") == F.lit(c), F.lit(float("inf")))
                              .otherwise(F.col("s")[i] / F.lit(float(sizes[c]))) for i, c in enumerate(names)]))
    placed = sums.select(F.col("k").alias(key), a.alias("a"), b.alias("b"), own.alias("own"))
    # a row at no distance from its own and from another cluster lies between them: 0
    inner = F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    score = F.when(F.col("own") == 1, 0.0).otherwise(inner)
    return placed.select(key, score.alias("silhouette"))


def silhouette(df: DataFrame, cols, key: str, cluster: str = "cluster", **blocks) -> DataFrame:
    return silhouette_rows(df, cols, key, cluster, **blocks).agg(F.avg("silhouette").alias("silhouette"))
