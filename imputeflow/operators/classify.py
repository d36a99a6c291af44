"""Random-forest classification: grid search, nested and hold-out evaluation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imputeflow.operators.forests import Forest, Growth, ModelSpec, bin_edges, fit_models, forest_rows, model_sizes
from imputeflow.operators.metrics import accuracy, ovo_auc
from imputeflow.operators.resample import adasyn
from imputeflow.operators.split import stratified_folds
from imputeflow.session import cut_lineage
from imputeflow.spec import TableSpec

# The grids of the two evaluations (trees, depths).
NESTED_GRID = (tuple(range(50, 151, 10)), tuple(range(1, 16)))
HOLDOUT_GRID = NESTED_GRID
RESAMPLED_GRID = (tuple(range(50, 201, 10)), tuple(range(10, 26)))
FOLDS = 5
FOREST_BYTES = 256 << 20  # of forests on the driver at a time
NODE_BYTES = 32  # of a node besides its values


def class_list(df: DataFrame, label: str) -> list:
    return sorted(r[0] for r in df.select(label).distinct().collect())


def label_index(df: DataFrame, label: str, classes: list, out: str = "__y") -> DataFrame:
    """Position of the label in the sorted classes."""
    table = F.array(*[F.lit(c) for c in classes])
    return df.withColumn(out, (F.array_position(table, F.col(label)) - 1).cast("double"))


def label_from_index(df: DataFrame, index: str, classes: list, out: str) -> DataFrame:
    return df.withColumn(out, F.array(*[F.lit(c) for c in classes])[F.col(index).cast("int")])


@dataclass
class ForestSearch:
    """The best grid point: the first ``trees`` trees of a forest grown on all rows, cut at ``depth``."""

    grow: Callable[[], Forest]
    trees: int
    depth: int
    cv_accuracy: float
    classes: list
    feats: list

    @cached_property
    def forest(self) -> Forest:
        return self.grow()

    def score(self, df: DataFrame, spec: TableSpec) -> tuple[float, float]:
        """Accuracy and one-vs-one AUC on a table."""
        shared = df.sparkSession.sparkContext.broadcast(self.forest)
        trees, depth = self.trees, self.depth

        @F.pandas_udf("array<double>")
        def vote(x: pd.Series) -> pd.Series:
            return pd.Series(list(shared.value.predict(np.asarray(x.tolist(), float), trees, depth)))

        rows = label_index(df, spec.label, self.classes)
        p = vote(F.array(*[F.col(f).cast("double") for f in self.feats]))
        scored = cut_lineage(rows.select("__y", p.alias("p")))
        shared.destroy()
        best = F.array_position("p", F.array_max("p")).cast("double") - 1
        scored = scored.withColumn("prediction", best)
        acc = accuracy(scored, "__y").first()[0]
        auc = ovo_auc(scored, "__y", "p", [float(i) for i in range(len(self.classes))]).first()[0]
        return acc, auc


def _grid_hits(rows: DataFrame, forests: dict, held_out, trees, depths) -> dict:
    """{model: (rows, hits (trees, depths))} over the rows that a model's ``held_out`` array names, in one scan."""
    shared = rows.sparkSession.sparkContext.broadcast(forests)

    def judge(batches):
        found = {}
        for pdf in batches:
            x, c = np.asarray(pdf["x"].tolist(), float), pdf["c"].to_numpy()
            owner = np.repeat(np.arange(len(pdf)), [len(o) for o in pdf["out"]])
            number = np.concatenate([*pdf["out"], []]).astype(int)
            for m in np.intersect1d(number, list(shared.value)):
                at = owner[number == m]
                said = shared.value[int(m)].votes(x[at], trees, depths).argmax(3)
                n, hits = found.get(m, (0, 0))
                found[m] = (n + len(at), hits + (said == c[at]).sum(2))
        for m, (n, hits) in found.items():
            yield pd.DataFrame({"m": [int(m)], "n": [n], "hits": [hits.ravel().tolist()]})

    got: dict = {}
    for r in rows.select("x", "c", held_out.alias("out")).mapInPandas(judge, "m int, n long, hits array<long>").collect():
        n, hits = got.get(r.m, (0, 0))
        got[r.m] = (n + r.n, hits + np.array(r.hits).reshape(len(trees), len(depths)))
    shared.destroy()
    return got


def _batches(models: list[int], sizes: dict, growth: Growth, classes: int) -> list[list[int]]:
    """The models that have rows, in runs whose forests have ``FOREST_BYTES`` at most, or one model."""
    out, room = [], 0
    for m in models:
        if m not in sizes:
            continue
        need = growth.trees * min(2 ** (growth.depth + 1), 2 * sizes[m][0]) * (NODE_BYTES + 8 * classes)
        if need > room:
            out.append([])
            room = FOREST_BYTES
        out[-1].append(m)
        room -= need
    return out


def search_forests(df: DataFrame, spec: TableSpec, parts: dict, trees, depths, folds: int = FOLDS,
                   seed: int = 0) -> dict[int, ForestSearch]:
    """A grid search for each of ``parts`` (number: condition that its rows meet), in lock-step as far as the driver holds the forests.

    A node's split depends on its rows and a draw of tree and node alone, so the forest of the most trees and the
    greatest depth holds every grid point. One such forest is grown per part and fold; the votes of every
    grid point are read off while a row goes down. On all rows of a part, the best point's trees are grown when they are asked for. Of equal points the first wins (depths first, then trees).
    """
    classes, feats = class_list(df, spec.label), list(spec.feats)
    trees, depths = sorted(trees), sorted(depths)
    data = label_index(df, spec.label, classes)
    for number, inside in parts.items():
        own = stratified_folds(data.where(inside).select(spec.key, spec.label), spec.with_feats(()), folds, seed, f"__f{number}")
        data = data.join(own.select(spec.key, f"__f{number}"), spec.key, "left")
    data = cut_lineage(data.select(spec.key, *feats, F.col("__y").cast("int").alias("__y"), *[f"__f{n}" for n in parts]))
    at = {(n, f): i * (folds + 1) + f for i, n in enumerate(parts) for f in range(folds + 1)}  # fold 0: all rows
    member = F.array_compact(F.array(*[F.when(F.col(f"__f{n}").isNotNull() & (F.col(f"__f{n}") != f), m)
                                       for (n, f), m in at.items()]))
    held_out = F.array_compact(F.array(*[F.when(F.col(f"__f{n}") == f, m) for (n, f), m in at.items() if f]))
    rows = forest_rows(data, feats, spec.key, member, "__y")
    growth = Growth("RF", max(trees), max(depths), seed=seed, subset=max(1, round(len(feats) ** 0.5)))
    specs = {m: ModelSpec(m, tuple(range(len(feats))), classes=len(classes)) for m in at.values()}
    sizes, edges = model_sizes(rows, list(specs.values())), bin_edges(data, feats)
    judged = data.select(F.array(*[F.col(c).cast("double") for c in feats]).alias("x"), F.col("__y").alias("c"),
                         *[f"__f{n}" for n in parts])
    hits, grown = {}, set()
    for some in _batches([m for (_, f), m in at.items() if f], sizes, growth, len(classes)):
        forests = fit_models(rows, [specs[m] for m in some], growth, edges, sizes)
        grown |= set(forests)
        hits |= _grid_hits(judged, forests, held_out, trees, depths)
        del forests

    def final(m, best):
        return lambda: fit_models(rows, [specs[m]], replace(growth, trees=trees[best[1]], depth=depths[best[0]]), edges, sizes)[m]

    out = {}
    for n in parts:
        shares = [hits[at[n, f]][1] / hits[at[n, f]][0] for f in range(1, folds + 1) if at[n, f] in hits and at[n, f] in grown]
        mean = np.mean(shares, axis=0)
        best = max(((d, t) for d in range(len(depths)) for t in range(len(trees))), key=lambda p: (mean[p[1], p[0]], -p[0], -p[1]))
        out[n] = ForestSearch(final(at[n, 0], best), trees[best[1]], depths[best[0]], float(mean[best[1], best[0]]), classes, feats)
    return out


def search_forest(df: DataFrame, spec: TableSpec, trees, depths, folds: int = FOLDS, seed: int = 0) -> ForestSearch:
    """Every grid point over stratified folds, the best by accuracy on all rows. Only the features are used."""
    return search_forests(df, spec, {0: F.lit(True)}, trees, depths, folds, seed)[0]


def nested_cv(df: DataFrame, spec: TableSpec, trees=NESTED_GRID[0], depths=NESTED_GRID[1],
              outer: int = FOLDS, inner: int = FOLDS, seed: int = 0) -> dict:
    """Grid search inside each outer train part, scored on the part left out, averaged; the searches share scans, and one best forest is held at a time."""
    folded = cut_lineage(stratified_folds(df, spec, outer, seed, "__outer"))
    parts = {f: F.col("__outer") != f for f in range(1, outer + 1)}
    accs, aucs = [], []
    searches = search_forests(folded, spec, parts, trees, depths, inner, seed)
    for f in parts:
        acc, auc = searches.pop(f).score(folded.where(F.col("__outer") == f), spec)
        accs.append(acc)
        aucs.append(auc)
    return {"accuracy": sum(accs) / outer, "auc": sum(aucs) / outer}


def holdout_cv(train: DataFrame, test: DataFrame, spec: TableSpec, trees=HOLDOUT_GRID[0],
               depths=HOLDOUT_GRID[1], folds: int = FOLDS, seed: int = 0, resample: bool = False) -> dict:
    """Grid search on the imputed train table, scored on the held-out fold.

    ``resample`` balances the classes of the train table first.
    """
    data = train.select(*spec.columns)
    if resample:
        data = cut_lineage(adasyn(data, spec, seed=seed))
    found = search_forest(data, spec, trees, depths, folds, seed)
    acc, auc = found.score(test, spec)
    return {"accuracy": acc, "auc": auc, "trees": found.trees, "depth": found.depth,
            "cv_accuracy": found.cv_accuracy}
