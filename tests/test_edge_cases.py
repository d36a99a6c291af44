"""Edge cases with a defined result: infinities, null masks, constant columns, tiny classes, repeated rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from imputeflow.operators import amputate as amp
from imputeflow.operators import cluster, metrics, orderstat, resample, stats
from imputeflow.operators.adaptive import UncertaintyAwareColumnAdaptiveImputer
from imputeflow.sources.tables import with_row_key
from imputeflow.spec import TableSpec

SPEC = TableSpec("k", ("a", "b"), "y")


def frame(spark, rows, schema="k long, a double, b double, y int"):
    return spark.createDataFrame(rows, schema)


def test_correlation_is_the_same_at_any_width(spark):
    g = np.random.default_rng(3)
    x = g.normal(size=(300, 30))
    x[g.random(x.shape) < 0.2] = np.nan
    cols = [f"c{i}" for i in range(30)]
    df = spark.createDataFrame([tuple(None if math.isnan(v) else float(v) for v in row) for row in x],
                               ", ".join(f"{c} double" for c in cols))
    wide = {(r.i, r.j): r.r for r in stats.correlation_long(df, cols).collect()}
    for r in stats.correlation_long(df, cols[:5]).collect():
        assert wide[r.i, r.j] == pytest.approx(r.r, abs=1e-12)
        both = ~np.isnan(x[:, r.i]) & ~np.isnan(x[:, r.j])
        assert r.r == pytest.approx(np.corrcoef(x[both, r.i], x[both, r.j])[0, 1], abs=1e-9)


def test_correlation_of_a_constant_column_is_null(spark):
    df = frame(spark, [(i, float(i), 2.5, 0) for i in range(6)])
    got = {(r.i, r.j): r.r for r in stats.correlation_long(df, ["a", "b"]).collect()}
    assert got == {(0, 0): 1.0, (0, 1): None, (1, 0): None, (1, 1): None}


@pytest.mark.parametrize("finish", [5, 20_000])
def test_quantiles_with_infinities_and_nan(spark, monkeypatch, finish):
    monkeypatch.setattr(orderstat, "FINISH_ROWS", finish)
    vals = [-math.inf] * 3 + [float(v) for v in range(40)] + [1e308, -1e308] + [math.inf] * 4 + [math.nan, None]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = orderstat.exact_quantiles(df, ["v"], [0.0, 0.5, 1.0])
    known = sorted(v for v in vals if v is not None and not math.isnan(v))
    assert got["v", 0.0] == -math.inf and got["v", 1.0] == math.inf
    assert got["v", 0.5] == np.median(known)


def test_null_mask_keeps_the_cell(spark):
    df = frame(spark, [(i, float(i), None if i % 2 else float(i), 0) for i in range(20)])
    assert amp.apply_masks(df, {"a": F.col("b") > 100}).where("a is null").count() == 0
    masked = amp.create_mar_tail(df, SPEC, 0.2)
    assert masked.where("b is null and a is null").where("k % 2 = 1").count() == 0


def test_scores_without_cells_or_classes(spark):
    df = frame(spark, [(i, float(i), float(i), i % 2) for i in range(6)])
    assert metrics.pooled_rmse(df, df, df, SPEC).first().rmse is None
    scored = spark.createDataFrame([(i % 2, [0.2 + 0.1 * (i % 2), 0.5, 0.3]) for i in range(6)], "y int, p array<double>")
    assert metrics.ovo_auc(scored, "y", "p", [0, 1, 2]).first().auc is not None


def test_auc_of_close_scores(spark):
    g = np.random.default_rng(5)
    y, s = g.integers(0, 2, 400), np.round(g.random(400) * 1e-6, 8)
    rows = [(int(a), [float(1 - b), float(b)]) for a, b in zip(y, s, strict=True)]
    scored = spark.createDataFrame(rows, "y int, p array<double>")
    pos, neg = s[y == 1], s[y == 0]
    want = np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :]))
    assert metrics.ovo_auc(scored, "y", "p", [0, 1]).first().auc == pytest.approx(want)


def test_silhouette_of_equal_points_is_zero(spark):
    df = frame(spark, [(i, 1.0, 1.0, i % 2) for i in range(6)])
    assert cluster.silhouette(df.withColumnRenamed("y", "cluster"), ["a", "b"], "k").first().silhouette == 0.0


def test_fuzzy_start_is_made_of_distinct_rows(spark):
    g = np.random.default_rng(1)
    rows = [(i, 0.0, 0.0, 0) for i in range(160)] + [
        (160 + i, float(c * 10 + g.normal() / 10), float(c * 10), 0) for i, c in enumerate([1, 2] * 20)]
    fit = cluster.fit_fuzzy_cmeans(frame(spark, rows), ["a", "b"], "k")
    assert len({tuple(np.round(c)) for c in fit.centers}) == 3
    with pytest.raises(ValueError, match="distinct"):
        cluster.fit_fuzzy_cmeans(frame(spark, rows[:160]), ["a", "b"], "k")


def test_tiny_classes(spark):
    def table(sizes):
        return frame(spark, [(100 * c + i, float(c + i / 10), float(i), c) for c, n in enumerate(sizes) for i in range(n)])
    with pytest.raises(ValueError, match="class 2 has 1 row"):
        resample.smote(table([20, 19, 1]), SPEC)
    with pytest.warns(UserWarning, match="class 1 has 3 rows"):
        made = resample.smote(table([20, 3]), SPEC)
    assert {r.y: r["count"] for r in made.groupBy("y").count().collect()} == {0: 20, 1: 20}
    far = frame(spark, [(i, float(i), 0.0, 0) for i in range(20)] + [(50 + i, 1e6 + i, 0.0, 1) for i in range(8)])
    with pytest.raises(ValueError, match="neighbour of another class"):
        resample.adasyn(far, SPEC)


def test_seeds_of_many_rows_are_spread(spark, monkeypatch):
    df = frame(spark, [(i, float(i), 0.0, 0) for i in range(60)] + [(90 + i, float(i), 1.0, 1) for i in range(3)])
    with pytest.warns(UserWarning):
        want = {tuple(r) for r in resample.smote(df, SPEC).collect()}
        monkeypatch.setattr(resample, "SPLIT_SEED_ROWS", 4)
        assert {tuple(r) for r in resample.smote(df, SPEC).collect()} == want


def test_bootstrap_of_few_rows_has_finite_fills(spark):
    rows = [(i, float(i) if i < 5 else None, float(i * 2), 0) for i in range(40)]
    for seed in range(4):
        out = UncertaintyAwareColumnAdaptiveImputer(SPEC, {}, ensemble="bootstrap", seed=seed).fit_transform(
            frame(spark, rows))
        assert out.where("a is null or isnan(a)").count() == 0


def test_rows_without_a_key_get_one(spark):
    rows = [(1.0, "x"), (1.0, "x"), (None, "x"), (2.0, None)]
    df = spark.createDataFrame(rows, "v double, t string")
    keys = [sorted(r.row_id for r in with_row_key(df.repartition(n)).collect()) for n in (1, 3)]
    assert keys[0] == keys[1] and len(set(keys[0])) == 4


@pytest.mark.parametrize("stepwise", [False, True])
def test_low_rank_models_fill_as_fit_transform_does(spark, stepwise):
    from imputeflow.operators.lowrank import FactorImputer, SvdImputer

    g = np.random.default_rng(4)
    spec = TableSpec("k", ("a", "b", "c", "d"))
    x = g.normal(size=(120, 2)) @ g.normal(size=(2, 4))
    gone = g.random(x.shape) < 0.2
    gone[gone.all(1)] = False
    rows = [(i, *(None if m else float(v) for v, m in zip(r, mask, strict=True)))
            for i, (r, mask) in enumerate(zip(x, gone, strict=True))]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double, d double")
    for imputer in (SvdImputer(spec, 2, rounds=30, stepwise=stepwise), FactorImputer(spec, 2, stepwise=stepwise)):
        want = {r.k: tuple(r)[1:] for r in imputer.fit_transform(df).collect()}
        for r in imputer.fit(df).transform(df).collect():
            assert tuple(r)[1:] == pytest.approx(want[r.k], abs=1e-8)


def test_rounds_leave_two_tables_at_most(spark, tmp_path, monkeypatch):
    from imputeflow import session
    from imputeflow.operators.families import TreeSizes
    from imputeflow.operators.mice import ChainedImputer

    monkeypatch.setattr(session, "ensure_checkpoint_dir", lambda spark: str(tmp_path))
    g = np.random.default_rng(2)
    rows = [(i, float(g.normal()) if i % 5 else None, float(g.normal()) if i % 7 else None, 0) for i in range(80)]
    model = ChainedImputer(SPEC, "RF", 2, tol=None, sizes=TreeSizes(rf_trees=2, max_depth=2)).fit(frame(spark, rows))
    assert len(list(tmp_path.glob("round-*"))) <= 1
    assert model.transform(frame(spark, rows)).where("a is null or b is null").count() == 0
    assert len(list(tmp_path.glob("round-*"))) <= 2


def test_equal_rows_are_numbered_in_parts(spark):
    """A row that repeats very often is no single task's work, and rows that only look alike stay apart."""
    rows = [(1.5, "a", None)] * 50 + [(1.5, "a", "-")] * 3 + [(-0.0, "", "x")] * 2 + [(0.0, "", "x"), (None, None, None)]
    df = spark.createDataFrame(rows, "v double, s string, t string").repartition(5)
    got = with_row_key(df, copies=8)
    assert got.columns == ["row_id", "v", "s", "t"]
    found = got.collect()
    assert len({r.row_id for r in found}) == len(rows)
    assert sorted(map(repr, (tuple(r)[1:] for r in found))) == sorted(map(repr, rows))
    assert {r.row_id for r in found} == {r.row_id for r in with_row_key(df.repartition(2)).collect()}
    assert with_row_key(df.limit(0)).count() == 0


def test_a_missing_requirement_is_not_hidden(monkeypatch):
    """Only the absence of the pipeline itself is passed over."""
    import builtins
    import importlib
    import sys

    import __spark_entry__ as entry

    def importing(missing):
        real = builtins.__import__

        def fake(name, *args, **named):
            if name == "corpus_pipeline":
                raise ModuleNotFoundError(f"No module named {missing!r}", name=missing)
            return real(name, *args, **named)

        monkeypatch.delitem(sys.modules, "corpus_pipeline", raising=False)
        monkeypatch.setattr(builtins, "__import__", fake)
        try:
            return importlib.reload(entry)
        finally:
            monkeypatch.setattr(builtins, "__import__", real)

    with pytest.raises(ModuleNotFoundError):
        importing("zstandard")
    assert "flagship" in importing("corpus_pipeline").queries()
    importlib.reload(entry)


def test_silhouette_meets_one_block_at_a_time(spark):
    """Close rows far from the origin, copies and blocks of some rows; nothing is copied per block or sorted for a cogroup."""
    g = np.random.default_rng(2)
    x = np.vstack([1e4 + 1e-5 * g.normal(size=(20, 2)), g.normal(size=(30, 2)), np.repeat([[5.0, 5.0]], 10, axis=0)])
    c = np.arange(60) % 3
    df = spark.createDataFrame([(i, float(a), float(b), int(k)) for i, ((a, b), k) in enumerate(zip(x, c))], "k int, a double, b double, cluster int")
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = {}
    for i in range(60):
        mean = [dist[i, c == j].sum() / max((c == j).sum() - (j == c[i]), 1) for j in range(3)]
        near = min(mean[j] for j in range(3) if j != c[i])
        top = max(mean[c[i]], near)
        want[i] = (near - mean[c[i]]) / top if top else 0.0
    for block in (None, 7):
        found = cluster.silhouette_rows(df, ["a", "b"], "k", block_rows=block)
        assert "CoGroup" not in found._jdf.queryExecution().toString()
        assert {r.k: r.silhouette for r in found.collect()} == pytest.approx(want, abs=1e-6)
