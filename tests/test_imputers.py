import numpy as np
import pytest
from pyspark.sql import functions as F

from imputeflow.operators import amputate as amp
from imputeflow.operators.adaptive import (
    ClusteredImputer, ClusterMetaColumnAdaptiveImputer, ColumnAdaptiveImputer, PolicyChoice,
)
from imputeflow.operators.cluster import CentroidClusterer, fit_fuzzy_cmeans, silhouette, silhouette_squared
from imputeflow.operators.families import TreeSizes, families_for_rate
from imputeflow.operators.linear import fit_br, fit_lr, moments
from imputeflow.operators.lowrank import FactorImputer, SvdImputer
from imputeflow.operators.metrics import pooled_rmse
from imputeflow.operators.mice import ChainedImputer
from imputeflow.operators.simple import SimpleImputer
from imputeflow.spec import TableSpec
from imputeflow.streaming.apply import impute_stream

SPEC = TableSpec("k", ("a", "b", "c", "d"))


@pytest.fixture(scope="module")
def truth(spark):
    g = np.random.default_rng(5)
    base = g.normal(size=(600, 2))
    x = np.column_stack([base[:, 0], base[:, 1], 2 * base[:, 0] - base[:, 1], base.sum(1)]) + g.normal(scale=0.1, size=(600, 4))
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)],
                                 "k long, a double, b double, c double, d double").persist()


@pytest.fixture(scope="module")
def gaps(truth):
    return amp.create_mcar(truth, SPEC, list(SPEC.feats), 0.2).persist()


def frame(df):
    return df.orderBy("k").toPandas()


def rmse(truth, gaps, imputed):
    return pooled_rmse(truth, gaps, imputed, SPEC).first()[0]


def test_moments_sql_and_arrow_agree(spark, truth, monkeypatch):
    from imputeflow.operators import linear

    df = truth.withColumn("g", (F.col("k") % 2).cast("int"))
    one = moments(df, [F.col("a"), F.col("c")], ["g"])
    monkeypatch.setattr(linear, "WIDE_MOMENTS", 0)
    two = moments(df, [F.col("a"), F.col("c")], ["g"])
    assert one.keys() == two.keys()
    assert all(np.allclose(one[g], two[g]) for g in one)


def test_exact_line_is_recovered():
    g = np.random.default_rng(0)
    a, b = g.normal(size=50), g.normal(size=50)
    z = np.column_stack([np.ones(50), a, b, 2 * a - 3 * b + 1])
    for fit in (fit_lr, fit_br):
        got = fit(z.T @ z, 3, [1, 2])
        assert np.allclose(got.coef, [2, -3], atol=1e-3) and got.intercept == pytest.approx(1, abs=1e-3)


def test_pattern_chain_equals_step_chain(truth, gaps):
    one = frame(ChainedImputer(SPEC, "LR", 3, tol=None).fit_transform(gaps))
    two = frame(ChainedImputer(SPEC, "LR", 3, tol=None, stepwise=True).fit_transform(gaps))
    assert np.allclose(one, two)


def test_chain_beats_mean_and_keeps_known_cells(truth, gaps):
    full, masked = frame(truth), frame(gaps)
    for family in ("LR", "BR"):
        got = ChainedImputer(SPEC, family, 10).fit_transform(gaps)
        assert rmse(truth, gaps, got) < 0.6 * rmse(truth, gaps, SimpleImputer(SPEC).fit_transform(gaps))
        pdf = frame(got)
        assert not pdf.isna().any().any()
        for f in SPEC.feats:
            known = masked[f].notna()
            assert (pdf[f][known] == full[f][known]).all()


def test_chain_stops_by_tolerance(gaps):
    loose = ChainedImputer(SPEC, "LR", 20, tol=0.5).fit(gaps)
    assert loose.rounds < 20
    assert ChainedImputer(SPEC, "LR", 4, tol=None).fit(gaps).rounds == 4


def test_chain_with_complete_extra_column(spark, truth, gaps):
    wide = gaps.join(truth.select("k", (F.col("a") * 5).alias("e")), "k")
    got = ChainedImputer(SPEC, "LR", 5, extra=["e"]).fit_transform(wide)
    pdf, full = frame(got), frame(truth)
    assert np.allclose(pdf.a, full.a, atol=1e-6)


@pytest.mark.parametrize("family", ["RF", "GB", "ET"])
def test_tree_chains(truth, gaps, family):
    sizes = TreeSizes(rf_trees=5, et_trees=5, gb_rounds=10, gb_step=0.3, max_depth=5)
    got = ChainedImputer(SPEC, family, 1, sizes=sizes).fit_transform(gaps)
    assert rmse(truth, gaps, got) < rmse(truth, gaps, SimpleImputer(SPEC).fit_transform(gaps))


@pytest.mark.parametrize("family", ["RF", "GB", "ET"])
def test_adaptive_imputer_with_tree_members_to_the_end(truth, gaps, family):
    """Policy, forests per cluster and column, filled cells and their std."""
    sizes = TreeSizes(rf_trees=6, et_trees=6, gb_rounds=15, gb_step=0.3, max_depth=5)
    clusters = CentroidClusterer(SPEC.feats, [[-1, -1, 0, 0], [1, 1, 0, 0]])
    policy = {(0.2, j): family if j != 2 else "LR" for j in range(4)}
    got = ClusteredImputer(SPEC, clusters, None, policy, sizes=sizes, n_ensemble=3).fit_transform(gaps)
    pdf, masked, full = frame(got), frame(gaps), frame(truth)
    assert rmse(truth, gaps, got) < 0.7 * rmse(truth, gaps, SimpleImputer(SPEC).fit_transform(gaps))
    for j, f in enumerate(SPEC.feats):
        known = masked[f].notna()
        assert (pdf[f][known] == full[f][known]).all() and not pdf[f].isna().any()
        spread = pdf[f"{f}_std"]
        assert (spread[known] == 0).all() and ((spread[~known] > 0).any() == (family != "GB" and j != 2))


def test_low_rank_paths_agree(truth, gaps):
    for make in (lambda s: SvdImputer(SPEC, 2, rounds=8, stepwise=s), lambda s: FactorImputer(SPEC, 2, rounds=4, stepwise=s)):
        assert np.allclose(frame(make(False).fit_transform(gaps)), frame(make(True).fit_transform(gaps)))
    assert rmse(truth, gaps, SvdImputer(SPEC, 2).fit_transform(gaps)) < rmse(truth, gaps, SimpleImputer(SPEC).fit_transform(gaps))


def test_column_adaptive_against_brute_force(gaps):
    got = frame(ColumnAdaptiveImputer(SPEC, {}).fit_transform(gaps))
    x = frame(gaps)[list(SPEC.feats)].to_numpy()
    gone = np.isnan(x)
    start = np.where(gone, np.nanmean(x, axis=0), x)
    out = start.copy()
    fits = []
    for j in range(4):
        others = np.delete(start, j, 1)[~gone[:, j]]
        fits.append(np.linalg.lstsq(np.column_stack([np.ones(len(others)), others]), x[~gone[:, j], j], rcond=None)[0])
    for j in range(4):
        others = np.delete(out, j, 1)
        pred = np.column_stack([np.ones(len(out)), others]) @ fits[j]
        out[gone[:, j], j] = pred[gone[:, j]]
    assert np.allclose(got[list(SPEC.feats)], out)


def test_policy_chain_falls_back():
    choice = PolicyChoice({(0.3, 0): "BR", (0.1, 1): "RF"}, {0.3: "GB"})
    asked = [(0, 0.3, 0.3), (1, 0.3, 0.3), (1, 0.1, 0.1), (2, 0.05, 0.05)]
    assert choice.choose(asked) == ["BR", "GB", "LR", "LR"]
    assert families_for_rate(0.1) == ("LR", "BR") and len(families_for_rate(0.2)) == 5


def test_small_clusters_keep_the_plain_fill(spark):
    rows = [(i, 0.0 if i < 29 else 10.0, float(i), None if i % 5 == 0 else float(2 * i)) for i in range(59)]
    df = spark.createDataFrame(rows, "k int, a double, b double, c double")
    spec = TableSpec("k", ("a", "b", "c"))
    clusterer = CentroidClusterer(["a"], [[0.0], [10.0]])
    model = ClusteredImputer(spec, clusterer).fit(df)
    assert {c for c, _ in model.models} == {1}
    got = model.transform(df).orderBy("k").toPandas()
    mean = np.mean([r[3] for r in rows if r[3] is not None])
    assert got.c[0] == pytest.approx(mean) and got.c_std[0] == 0.0
    assert got.c[30] == pytest.approx(60.0)


def test_cluster_meta_uses_the_clusters_own_means(truth, gaps):
    class Always:
        def predict_many(self, asked):
            return ["LR"] * len(asked)

    clusterer = CentroidClusterer(["a"], [[-1.0], [1.0]])
    got = ClusterMetaColumnAdaptiveImputer(SPEC, clusterer, Always()).fit(gaps)
    assert set(got.fills) == {0, 1} and got.fills[0]["a"] < got.fills[1]["a"]
    assert not frame(got.transform(gaps)).isna().any().any()


def test_bayes_spread_covers_and_bootstrap_varies(truth, gaps):
    policy = {(0.2, j): "BR" for j in range(4)}
    got = frame(ClusteredImputer(SPEC, best_by_rate_col=policy).fit_transform(gaps))
    full, masked = frame(truth), frame(gaps)
    z = np.concatenate([((got[f] - full[f]) / got[f"{f}_std"])[masked[f].isna()] for f in SPEC.feats])
    assert 0.4 < (np.abs(z) < 1).mean() < 0.95
    assert all((got[f"{f}_std"][masked[f].notna()] == 0).all() for f in SPEC.feats)
    same = frame(ClusteredImputer(SPEC).fit_transform(gaps))
    boot = frame(ClusteredImputer(SPEC, ensemble="bootstrap").fit_transform(gaps))
    assert (same.a_std == 0).all() and (boot.a_std[masked.a.isna()] > 0).all()


def test_fuzzy_centres_and_silhouettes(spark):
    g = np.random.default_rng(2)
    pts = np.vstack([g.normal(c, 0.1, size=(40, 2)) for c in (0, 3, 6)])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "k int, x double, y double")
    model = fit_fuzzy_cmeans(df, ["x", "y"], "k", 3)
    assert sorted(round(c[0]) for c in model.centers) == [0, 3, 6]
    tagged = model.assign(df)
    one, many = silhouette(tagged, ["x", "y"], "k").first()[0], silhouette(tagged, ["x", "y"], "k", block_rows=17).first()[0]
    assert one == pytest.approx(many) and one > 0.9
    assert silhouette_squared(tagged, ["x", "y"]) > 0.95


def test_fitted_model_runs_on_a_stream(spark, gaps, tmp_path):
    gaps.write.parquet(str(tmp_path / "in"))
    model = ChainedImputer(SPEC, "LR", 3).fit(gaps)
    stream = spark.readStream.schema(gaps.schema).parquet(str(tmp_path / "in"))
    query = (impute_stream(model, stream).writeStream.format("memory").queryName("filled")
             .trigger(availableNow=True).start())
    query.awaitTermination(120)
    assert np.allclose(frame(spark.table("filled")), frame(model.transform(gaps)))
