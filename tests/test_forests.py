"""The forest engine: the same trees however they are grown, and forests that hold their smaller ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from imputeflow.operators import classify, forests
from imputeflow.operators.families import TreeSizes, make_regressor
from imputeflow.operators.forests import BINS, Forest, Growth, ModelSpec, bin_edges, fit_models, forest_rows
from imputeflow.spec import TableSpec

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    g = np.random.default_rng(1)
    x = g.normal(size=(900, 2))
    c = np.where(x[:, 0] > 0.3, 2.0, 0.0) + x[:, 1] ** 2 + g.normal(scale=0.1, size=900)
    rows = [(i, float(a), float(b), float(y), int(a > 0.3) + int(b > 1)) for i, (a, b, y) in enumerate(zip(*x.T, c))]
    return spark.createDataFrame(rows, "k long, a double, b double, c double, y int").repartition(3).persist()


def same(one: Forest, two: Forest) -> bool:
    if (one.feat != two.feat).any():
        return False
    inner = one.feat >= 0
    return (one.cut[inner] == two.cut[inner]).all() and (one.left[inner] == two.left[inner]).all() and np.allclose(one.value, two.value)


@pytest.mark.parametrize("kind,trees,depth", [("RF", 3, 6), ("ET", 3, 6), ("GB", 4, 3)])
def test_trees_are_the_same_however_grown(table, kind, trees, depth, monkeypatch):
    edges, spec = bin_edges(table, COLS), ModelSpec(0, (0, 1), 2)
    growth = Growth(kind, trees, depth, step=0.5, seed=7)
    rows = forest_rows(table, COLS, "k")
    whole = fit_models(rows, [spec], growth, edges)[0]
    monkeypatch.setattr(forests, "SLOT_BYTES", 5 * 2 * BINS * 16)  # a few nodes a scan
    for limit in (200, 0):
        assert same(whole, fit_models(rows.repartition(7), [spec], growth, edges, local_rows=limit)[0])


def test_features_tried_and_classes_by_scans(table):
    edges = bin_edges(table, COLS)
    growth = Growth("RF", 3, 8, seed=2, subset=1)
    spec = ModelSpec(0, (0, 1, 2), classes=3)
    rows = forest_rows(table, COLS, "k", label="y")
    one, two = (fit_models(rows, [spec], growth, edges, local_rows=n)[0] for n in (10**6, 300))
    assert same(one, two) and np.allclose(one.value.sum(1), 1)


def test_models_grown_together_are_those_grown_alone(table):
    edges = bin_edges(table, COLS)
    specs = [ModelSpec(i, tuple(j for j in range(3) if j != i), i) for i in range(3)]
    member = F.array_compact(F.array(*[F.when(F.col("k") % 3 != i, i) for i in range(3)]))
    growth = Growth("RF", 4, 5, seed=3)
    together = fit_models(forest_rows(table, COLS, "k", member), specs, growth, edges)
    for s in specs:
        alone = fit_models(forest_rows(table.where(F.col("k") % 3 != s.model), COLS, "k", F.array(F.lit(s.model))), [s], growth, edges)
        assert same(together[s.model], alone[s.model])


def test_a_forest_holds_every_smaller_one(table):
    edges, spec = bin_edges(table, COLS), ModelSpec(0, (0, 1), 2)
    rows = forest_rows(table, COLS, "k")
    big = fit_models(rows, [spec], Growth("RF", 9, 7, seed=5), edges)[0]
    x = np.asarray(table.select("a", "b").toPandas())
    votes = big.votes(x, [2, 9], [1, 4, 7])
    for i, t in enumerate((2, 9)):
        for j, d in enumerate((1, 4, 7)):
            small = fit_models(rows, [spec], Growth("RF", t, d, seed=5), edges)[0]
            assert np.allclose(small.predict(x), big.predict(x, t, d)) and np.allclose(votes[i, j], small.predict(x))


@pytest.mark.parametrize("family,limit", [("RF", 0.15), ("ET", 0.3), ("GB", 0.15)])
def test_families_learn_the_signal(table, family, limit):
    sizes = TreeSizes(rf_trees=20, et_trees=20, gb_rounds=80, gb_step=0.2, gb_depth=3, max_depth=8)
    model = make_regressor(family, sizes).fit(table, ["a", "b"], "c", key="k")
    got = model.add_prediction(table, "p", F.col("k") < 500).toPandas()
    asked = got.k < 500
    assert got.p[~asked].isna().all()
    assert ((got.p - got.c)[asked] ** 2).mean() < limit * got.c.var()


def test_constant_targets_single_rows_and_unused_models(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 2.0, 5.0)], "k long, a double, c double")
    for family in ("RF", "ET", "GB"):
        model = make_regressor(family, TreeSizes(rf_trees=3, et_trees=3, gb_rounds=3)).fit(df, ["a"], "c", key="k")
        assert np.allclose([r.p for r in model.add_prediction(df.limit(1), "p").collect()], 5.0, atol=1e-5) or family == "RF"
    edges = bin_edges(df, ["a", "c"])
    none = fit_models(forest_rows(df, ["a", "c"], "k"), [ModelSpec(0, (0,), 1), ModelSpec(4, (0,), 1)], Growth("ET", 2, 2), edges)
    assert set(none) == {0}


def test_grid_search_equals_separate_fits(table):
    spec = TableSpec("k", ("a", "b", "c"), "y")
    trees, depths = (2, 5), (1, 3, 6)
    found = classify.search_forest(table, spec, trees, depths, 3, 4)
    classes = classify.class_list(table, "y")
    data = classify.label_index(table, "y", classes)
    parts = classify.stratified_folds(data.select("k", "y"), spec.with_feats(()), 3, 4, "f")
    data = data.join(parts.select("k", "f"), "k").persist()
    edges, feats = bin_edges(data, spec.feats), list(spec.feats)
    best = None
    for d in depths:
        for t in trees:
            right = []
            for f in (1, 2, 3):
                rows = forest_rows(data.where(F.col("f") != f), feats, "k", label="__y")
                forest = fit_models(rows, [ModelSpec(0, (0, 1, 2), classes=3)], Growth("RF", t, d, seed=4, subset=2), edges)[0]
                held = data.where(F.col("f") == f).toPandas()
                right.append((forest.predict(held[feats].to_numpy()).argmax(1) == held["__y"]).mean())
            if best is None or np.mean(right) > best[0] + 1e-12:
                best = (np.mean(right), t, d)
    assert (found.trees, found.depth) == best[1:] and found.cv_accuracy == pytest.approx(best[0])


def test_searches_hold_few_forests_at_a_time(table, monkeypatch):
    """With little room, models are grown one by one; what is found stays the same."""
    spec, grid = TableSpec("k", ("a", "b", "c"), "y"), ((2, 5), (1, 3, 6))
    whole = classify.nested_cv(table, spec, *grid, 2, 2, 4)
    calls = []

    def watched(rows, specs, *rest):
        calls.append(len(specs))
        return fit_models(rows, specs, *rest)

    monkeypatch.setattr(classify, "fit_models", watched)
    monkeypatch.setattr(classify, "FOREST_BYTES", 1)
    assert classify.nested_cv(table, spec, *grid, 2, 2, 4) == pytest.approx(whole)
    assert calls == [1] * 6
