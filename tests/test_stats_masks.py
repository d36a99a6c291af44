import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from imputeflow.functions import scalars
from imputeflow.functions.hashing import hash_uniform
from imputeflow.operators import amputate as amp
from imputeflow.operators import orderstat, stats
from imputeflow.operators.orderstat import draw_cuts, exact_quantiles
from imputeflow.operators.simple import SimpleImputer, complete_cases
from imputeflow.operators.split import read_fold, stratified_folds, write_folds
from imputeflow.spec import TableSpec

SPEC = TableSpec("k", ("a", "b", "c"), "y")


def table(spark, n=400, seed=1, parts=3):
    g = np.random.default_rng(seed)
    a, b = g.normal(size=n), g.normal(size=n)
    rows = [(i, float(a[i]), float(b[i]), float(2 * a[i] - 3 * b[i] + 1), int(i % 3)) for i in range(n)]
    return spark.createDataFrame(rows, "k long, a double, b double, c double, y int").repartition(parts)


def test_quantiles_equal_numpy_with_ties_and_nulls(spark):
    vals = [1.0, 2.0, 2.0, 2.0, 7.5, None, 9.0, 2.0]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = exact_quantiles(df, ["v"], [0.0, 0.1, 0.5, 0.77, 1.0])
    known = [v for v in vals if v is not None]
    for p in (0.0, 0.1, 0.5, 0.77, 1.0):
        assert got["v", p] == pytest.approx(np.quantile(known, p))


def test_quantiles_refine_over_passes(spark, monkeypatch):
    monkeypatch.setattr(orderstat, "FINISH_ROWS", 5)
    monkeypatch.setattr(orderstat, "BIN_BUDGET", 64)
    df = table(spark)
    got = orderstat.exact_quantiles(df, ["a", "b"], [0.05, 0.5, 0.95])
    pdf = df.toPandas()
    for (c, p), v in got.items():
        assert v == pytest.approx(np.quantile(pdf[c], p), abs=1e-12)


def test_equal_draws_are_settled_by_key(spark):
    df = spark.createDataFrame([(i, 0.25 if i < 6 else 0.75) for i in range(10)], "k long, u double")
    cuts, counts = draw_cuts(df, "k", [(F.col("u"), F.lit(0))], [0], lambda n: {0: [4, 7]})
    assert counts == {0: 10}
    for size in (4, 7):
        kept = df.where(cuts[0, size].holds(F.col("u"), F.col("k")))
        assert sorted(r.k for r in kept.collect()) == list(range(size))


def test_draws_are_uniform_and_free_of_partitioning(spark):
    df = spark.range(4000).withColumnRenamed("id", "k")
    one = df.select("k", hash_uniform(3, "x", "k").alias("u")).toPandas().sort_values("k")
    two = df.repartition(7).select("k", hash_uniform(3, "x", "k").alias("u")).toPandas().sort_values("k")
    assert (one.u.to_numpy() == two.u.to_numpy()).all()
    assert abs(one.u.mean() - 0.5) < 0.02 and 0 <= one.u.min() and one.u.max() < 1


def test_half_even_counts():
    assert scalars.half_even_count(0.05, 10) == 0
    assert scalars.half_even_count(0.25, 10) == 2
    assert scalars.half_even_count(0.35, 10) == 4


def test_rate_bins_and_rounds(spark):
    df = spark.createDataFrame([(0.075,), (0.15,), (0.9,), (0.31,)], "r double")
    got = [x.b for x in df.select(scalars.closest_rate(F.col("r")).alias("b")).collect()]
    assert got == [scalars.closest_rate_value(r) for r in (0.075, 0.15, 0.9, 0.31)]
    assert [scalars.rounds_for_rate_value(r) for r in (0.1, 0.3, 0.5, 0.8)] == [5, 10, 15, 20]
    assert scalars.closest_rate_value(0.37, ()) == 0.37


@pytest.mark.parametrize("make", [
    lambda df: amp.create_mcar(df, SPEC, ["a", "b", "c"], 0.3),
    lambda df: amp.create_mnar(df, SPEC, ["a", "b", "c"], 0.3),
    lambda df: amp.create_mar(df, SPEC, ["a", "b", "c"], 0.3, model="LR"),
    lambda df: amp.create_mar(df, SPEC, [0, 1], 0.3, num_trees=5),
])
def test_exact_counts_and_untouched_values(spark, make):
    df = table(spark)
    masked = make(df).toPandas().sort_values("k").reset_index(drop=True)
    full = df.toPandas().sort_values("k").reset_index(drop=True)
    for c in ("a", "b"):
        assert masked[c].isna().sum() == 120
        kept = masked[c].notna()
        assert (masked[c][kept] == full[c][kept]).all()


def test_masks_do_not_depend_on_partitions(spark):
    one = amp.create_mnar(table(spark, parts=2), SPEC, ["a"], 0.2).toPandas().sort_values("k")
    two = amp.create_mnar(table(spark, parts=5), SPEC, ["a"], 0.2).toPandas().sort_values("k")
    assert (one.a.isna().to_numpy() == two.a.isna().to_numpy()).all()


def test_logistic_blanks_the_high_values(spark):
    df = table(spark)
    masked = amp.create_mnar(df, SPEC, "a", 0.3)
    both = masked.select("k", F.col("a").alias("m")).join(df, "k").toPandas()
    assert both.a[both.m.isna()].mean() > both.a[both.m.notna()].mean() + 0.5


def test_tail_masks_are_strict(spark):
    df = spark.createDataFrame([(i, float(i), float(i)) for i in range(1, 6)], "k int, a double, b double")
    spec = TableSpec("k", ("a", "b"))
    got = amp.create_mnar_tail(df, spec, 0.5).orderBy("k").toPandas()
    assert got.a.isna().tolist() == [True, False, False, False, True]


def test_mar_tail_ignores_the_column_itself(spark):
    rows = [(i, float(i), 0.0) for i in range(100)]
    df = spark.createDataFrame(rows, "k int, a double, b double")
    got = amp.create_mar_tail(df, TableSpec("k", ("a", "b")), 0.4).toPandas()
    assert got.a.notna().all() and got.b.isna().sum() > 0


def test_wrong_column_argument(spark):
    with pytest.raises(TypeError):
        amp.create_mcar(table(spark), SPEC, 3.5, 0.1)


def test_scenario_grid_is_prunable(spark):
    grid = amp.scenario_grid(table(spark), SPEC, rates=(0.1, 0.2), mechs=("mcar", "mnar"))
    assert grid.groupBy("mech", "rate").count().count() == 4
    assert grid.where("mech = 'mcar' and rate = 0.1").count() == 400


def test_folds_are_balanced_and_round_trip(spark, tmp_path):
    df = stratified_folds(table(spark, 101), SPEC, 5)
    counts = df.groupBy("y", "fold").count().toPandas()
    for _, part in counts.groupby("y"):
        assert len(part) == 5 and part["count"].max() - part["count"].min() <= 1
    write_folds(df, str(tmp_path / "f"))
    write_folds(df, str(tmp_path / "f"))
    train = read_fold(spark, str(tmp_path / "f"), 1, train=True)
    test = read_fold(spark, str(tmp_path / "f"), 1, train=False)
    assert train.count() + test.count() == 101
    assert "PartitionFilters: [isnotnull(fold" in train._jdf.queryExecution().toString()


def test_zscore_leaves_a_constant_centred(spark):
    df = spark.createDataFrame([(1, 2.0, 1.0), (2, 2.0, 3.0)], "k int, a double, b double")
    got = stats.z_score(df, ["a", "b"]).orderBy("k").collect()
    assert [(r.a, r.b) for r in got] == [(0.0, -1.0), (0.0, 1.0)]


def test_correlation_equals_pairwise_aggregates(spark):
    df = table(spark)
    got = {(r.i, r.j): r.r for r in stats.correlation_long(df, SPEC.feats).collect()}
    assert len(got) == 9
    for (i, j), r in got.items():
        assert r == pytest.approx(df.agg(F.corr(SPEC.feats[i], SPEC.feats[j])).first()[0])


def test_simple_fills(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, None, 4.0), (3, 1.0, 2.0), (4, 7.0, 2.0), (5, 7.0, None)],
                               "k int, a double, b double")
    spec = TableSpec("k", ("a", "b"))
    fill = {s: SimpleImputer(spec, s).fit(df).fills for s in ("mean", "median", "most_frequent", "constant")}
    assert fill["mean"]["a"] == 4.0 and fill["median"]["b"] == 2.0
    assert fill["most_frequent"]["a"] == 1.0 and fill["constant"]["a"] == 0.0
    assert [r.k for r in complete_cases(df, spec).orderBy("k").collect()] == [3, 4]


def test_all_null_column_stays_null(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, None, None)], "k int, a double, b double")
    with pytest.warns(UserWarning):
        got = SimpleImputer(TableSpec("k", ("a", "b"))).fit_transform(df).collect()
    assert [r.a for r in got] == [1.0, 1.0] and all(r.b is None for r in got)


def test_order_statistics_of_values_of_very_different_size(spark, monkeypatch):
    monkeypatch.setattr(orderstat, "FINISH_ROWS", 50)
    g = np.random.default_rng(5)
    x = np.concatenate([10.0 ** g.uniform(-300, 300, 6000) * g.choice([-1.0, 1.0], 6000), np.repeat(1e-280, 500)])
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    passes, plain = [], orderstat.small_table
    monkeypatch.setattr(orderstat, "small_table", lambda *a: passes.append(1) or plain(*a))
    probs = [0.0, 0.1, 0.5, 0.51, 0.9, 1.0]
    got = exact_quantiles(df, ["x"], probs)
    ordered = np.sort(x)
    for p in probs:
        spot = p * (len(x) - 1)
        lo, hi = ordered[int(np.floor(spot))], ordered[int(np.ceil(spot))]
        assert got["x", p] == (lo if lo == hi else lo + (hi - lo) * (spot - np.floor(spot)))
    assert len(passes) <= 8
