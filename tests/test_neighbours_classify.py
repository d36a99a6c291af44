import numpy as np
import pytest
from pyspark.sql import functions as F

from imputeflow.operators import knn, resample
from imputeflow.operators.classify import holdout_cv, label_from_index, label_index, nested_cv
from imputeflow.operators.knn import NeighbourJoin, best_in_block, grow_forest
from imputeflow.operators.knn_impute import KnnImputer
from imputeflow.operators.metrics import ovo_auc
from imputeflow.plans import policy
from imputeflow.spec import TableSpec

SPEC = TableSpec("k", ("a", "b", "c"), "y")


def points(spark, n=240, copies=True, holes=0.0, seed=3):
    g = np.random.default_rng(seed)
    x = g.normal(size=(n, 3))
    if copies:
        x[: n // 3] = x[0]
    x[g.random(x.shape) < holes] = np.nan
    y = np.where(np.arange(n) % 4 == 0, 1, 0)
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "k long, a double, b double, c double, y int").repartition(3)


def brute(df, k, per_column=False, group=False):
    pdf = df.toPandas().sort_values("k")
    x, keys, y = pdf[["a", "b", "c"]].to_numpy(float), pdf.k.to_numpy(), pdf.y.to_numpy()
    out = set()
    for i in range(len(x)):
        both = ~np.isnan(x[i]) & ~np.isnan(x)
        n = both.sum(1)
        with np.errstate(invalid="ignore"):
            d = np.where(n > 0, np.nansum(np.where(both, (x[i] - x) ** 2, 0), 1) / np.maximum(n, 1), np.inf)
        d[i] = np.inf
        for t in range(3) if per_column else (-1,):
            if t >= 0 and not np.isnan(x[i, t]):
                continue
            ok = np.isfinite(d) & (~np.isnan(x[:, t]) if t >= 0 else True)
            if group:
                ok &= y == y[i]
            at = np.flatnonzero(ok)
            at = at[np.lexsort((keys[at], d[at]))][:k]
            out |= {(int(keys[i]), t, int(keys[j]), r + 1) for r, j in enumerate(at)}
    return out


@pytest.mark.parametrize("blocks", [{}, {"block_rows": 20, "query_rows": 16}])
@pytest.mark.parametrize("holes,per_column,group", [(0.0, False, False), (0.0, False, True), (0.35, True, False)])
def test_neighbours_equal_brute_force(spark, blocks, holes, per_column, group):
    """A third of the rows are copies of one row, and cells are small."""
    df = points(spark, holes=holes).persist()
    join = NeighbourJoin("k", SPEC.feats, 3, "y" if group else None, per_column, **blocks)
    got = {(r.k, r.target, r.dk, r["rank"]) for r in join.join(df, df).collect()}
    assert got == brute(df, 3, per_column, group)


def test_plan_has_no_cross_join(spark):
    df = points(spark)
    plan = NeighbourJoin("k", SPEC.feats, 2).join(df, df)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_knn_impute_falls_back_to_the_mean(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, 3.0, None), (3, None, 5.0)], "k int, a double, b double")
    got = {r.k: (r.a, r.b) for r in KnnImputer(TableSpec("k", ("a", "b")), 2).fit_transform(df).collect()}
    assert got == {1: (1.0, 5.0), 2: (3.0, 5.0), 3: (2.0, 5.0)}


def line(spark):
    rows = [("a", 0.0, 0), ("b", 1.0, 0), ("c", 1.4, 1), ("d", 5.0, 1), ("e", 6.0, 1), ("f", 6.5, 1)]
    return spark.createDataFrame(rows, "k string, x double, y int")


def test_tomek_and_edited_neighbours(spark):
    spec = TableSpec("k", ("x",), "y")
    links = resample.tomek_links(line(spark), spec).collect()
    assert [(r.key_a, r.key_b) for r in links] == [("b", "c")]
    kept = {r.k for r in resample.edited_neighbours(line(spark), spec, 1).collect()}
    assert kept == {"a", "d", "e", "f"}


@pytest.mark.parametrize("name", list(resample.RESAMPLERS))
def test_resamplers(spark, name):
    df = points(spark, copies=False).persist()
    got = resample.RESAMPLERS[name](df, SPEC).toPandas()
    made = got[got.k.str.contains("#")]
    assert not got[["a", "b", "c"]].isna().any().any() and got.k.is_unique
    if name in ("smote", "borderline_smote"):
        assert got.y.value_counts().to_dict() == {0: 180, 1: 180}
    if name in ("smote", "adasyn"):
        full = df.toPandas().set_index("k")
        minority = full[full.y == 1][["a", "b", "c"]].to_numpy()
        assert (made.y == 1).all()
        lo, hi = minority.min(0), minority.max(0)
        assert ((made[["a", "b", "c"]] >= lo - 1e-9) & (made[["a", "b", "c"]] <= hi + 1e-9)).all().all()


def test_auc_with_ties_against_ranks(spark):
    g = np.random.default_rng(1)
    y = g.integers(0, 3, 200)
    p = np.round(g.dirichlet([1, 1, 1], 200), 1)
    df = spark.createDataFrame([(int(a), [float(v) for v in b]) for a, b in zip(y, p)], "y int, p array<double>")
    want = []
    for a in range(3):
        for b in range(3):
            if a != b:
                pos, neg = p[y == a, a], p[y == b, a]
                want.append((pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean())
    assert ovo_auc(df, "y", "p", [0, 1, 2]).first()[0] == pytest.approx(np.mean(want))


def test_label_index_and_back(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",)], "y string")
    got = label_from_index(label_index(df, "y", ["a", "b", "c"], "i"), "i", ["a", "b", "c"], "z").collect()
    assert {r.y: r.i for r in got} == {"a": 0.0, "b": 1.0, "c": 2.0} and all(r.y == r.z for r in got)


def test_best_method_takes_the_first_name_on_a_tie(spark):
    rows = [(0.1, "RF", 0, 1.0, "mcar"), (0.1, "BR", 0, 1.0, "mcar"), (0.2, "LR", 0, 2.0, "mcar"), (0.2, "BR", 0, 1.5, "mcar")]
    scores = spark.createDataFrame(rows, "rate double, imp string, col int, rmse double, mech string")
    assert {r.rate: r.imp for r in policy.best_by_rate(scores).collect()} == {0.1: "BR", 0.2: "BR"}


def test_selector_learns_and_predicts(spark):
    df = points(spark, copies=False)
    best = spark.createDataFrame([(r, c, "RF" if r > 0.3 else "LR") for r in (0.05, 0.1, 0.3, 0.5, 0.7, 0.8) for c in range(3)],
                                 "rate double, col int, imp string")
    selector = policy.MetaSelector(num_trees=10).fit(df, SPEC, best)
    assert selector.predict_many([(0, 0.06), (1, 0.78)]) == ["LR", "RF"]
    assert 0.5 <= selector.cross_validate()[0] <= 1.0


def test_grid_search_and_nested(spark):
    g = np.random.default_rng(4)
    rows = [(i, float(g.normal(3 * (i % 3), 1)), float(g.normal()), 0.0, i % 3) for i in range(150)]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double, y int")
    got = holdout_cv(df, df, SPEC, (3, 5), (2,), folds=3)
    assert got["accuracy"] > 0.7 and got["auc"] > 0.85 and got["depth"] == 2
    assert nested_cv(df, SPEC, (3,), (2,), outer=2, inner=2)["auc"] > 0.8


@pytest.mark.parametrize("per_column", [False, True])
@pytest.mark.parametrize("kind", ["plain", "grid", "far", "huge", "infinite"])
def test_block_equals_all_pairs_in_order(per_column, kind):
    """Matrix products choose the pairs; what comes out are the distances summed up column by column, ties by key."""
    g = np.random.default_rng(5)
    make = {"plain": lambda n: g.normal(size=(n, 4)), "grid": lambda n: g.integers(0, 3, (n, 4)).astype(float),
            "far": lambda n: 1e6 + 1e-3 * g.normal(size=(n, 4)), "huge": lambda n: 1e160 * g.normal(size=(n, 4)),
            "infinite": lambda n: np.where(g.random((n, 4)) < 0.02, np.inf, g.normal(size=(n, 4)))}[kind]
    qx, dx, k = make(40), make(150), 3
    if per_column:
        qx[g.random(qx.shape) < 0.4], dx[g.random(dx.shape) < 0.4] = np.nan, np.nan
    qk, dk = np.arange(40) * 3, np.arange(150)
    bound = g.choice([0.0, 0.3, 2.0, np.inf], (40, 4 if per_column else 1))
    want, within = [], []
    for i in range(40):
        dist, shared = np.zeros(150), np.zeros(150)
        with np.errstate(all="ignore"):
            for c in range(4):
                both = ~np.isnan(qx[i, c]) & ~np.isnan(dx[:, c])
                dist, shared = dist + np.where(both, (qx[i, c] - dx[:, c]) ** 2, 0.0), shared + both
            dist = np.where((shared > 0) & (dk != qk[i]), dist / shared, np.inf)
        for t in range(4) if per_column else (-1,):
            if t >= 0 and not np.isnan(qx[i, t]):
                continue
            able = np.flatnonzero(np.isfinite(dist) & (~np.isnan(dx[:, t]) if t >= 0 else True))
            best = [(int(qk[i]), t, int(j), float(dist[j])) for j in able[np.lexsort((able, dist[able]))][:k]]
            want += best
            within += [b for b in best if b[3] <= bound[i, max(t, 0)]]
    rows = lambda found: sorted(zip(found.k, found.target, found.dk, found.dist))
    assert rows(best_in_block(qx, qk, dx, dk, k, per_column)) == sorted(want)
    assert rows(best_in_block(qx, qk, dx, dk, k, per_column, bound)) == sorted(within)


def test_rows_with_patterns_of_their_own_share_cells(spark):
    """600 rows with some 500 patterns of gaps don't make a cell each."""
    g = np.random.default_rng(1)
    x = np.where(g.random((600, 12)) < 0.4, np.nan, g.normal(size=(600, 12)))
    rows = [(i, [None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "k long, x array<double>").selectExpr("k", *[f"x[{i}] AS c{i}" for i in range(12)])
    join = NeighbourJoin("k", [f"c{i}" for i in range(12)], 3, per_column=True, block_rows=100, query_rows=100)
    _, cells = join._cells(join._distinct_donors(join._packed(df)).withColumn("s", join._strata()))
    assert len(cells.ids) <= 100 and cells.n.sum() == 600


def test_synthesis_meets_rows_of_the_seeds_classes_only(spark, monkeypatch):
    met = []

    class Watched(NeighbourJoin):
        def join(self, queries, donors):
            met.append({r.y for r in donors.select("y").distinct().collect()})
            return super().join(queries, donors)

    monkeypatch.setattr(resample, "NeighbourJoin", Watched)
    resample.smote(points(spark, copies=False), SPEC).collect()
    assert met == [{1}]


def test_sample_of_borders_is_bounded_in_bytes(spark, monkeypatch):
    df = points(spark, n=400, copies=False).persist()
    seen = []

    def watched(strata, sample, target):
        seen.append(sum(x.nbytes for x in sample.values()))
        return grow_forest(strata, sample, target)

    monkeypatch.setattr(knn, "grow_forest", watched)
    monkeypatch.setattr(knn, "SPLIT_BYTES", 100 * 24)
    got = {(r.k, r.target, r.dk, r["rank"]) for r in NeighbourJoin("k", SPEC.feats, 3, block_rows=20, query_rows=16).join(df, df).collect()}
    assert got == brute(df, 3) and 0 < seen[0] < 200 * 24
