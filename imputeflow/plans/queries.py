"""Every operator as a query over the given tables: ``name -> f(spark, sf_dir)``."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imputeflow.functions.scalars import MISSING_RATES, closest_rate, rounds_for_rate, sentinel_to_null, total
from imputeflow.operators import amputate as amp
from imputeflow.operators import classify, cluster, metrics, resample, stats
from imputeflow.operators.adaptive import (
    ClusteredImputer, ClusterMetaColumnAdaptiveImputer, ColumnAdaptiveImputer,
    MetaColumnAdaptiveImputer, RateAdaptiveImputer, UncertaintyAwareColumnAdaptiveImputer,
)
from imputeflow.operators.families import TREES_FROM_RATE
from imputeflow.operators.knn import NeighbourJoin
from imputeflow.operators.knn_impute import KnnImputer
from imputeflow.operators.lowrank import FactorImputer, SvdImputer
from imputeflow.operators.mice import ChainedImputer, chained_imputers_for_rate, classic_imputer
from imputeflow.operators.orderstat import exact_quantiles
from imputeflow.operators.simple import SimpleImputer, complete_cases
from imputeflow.operators.split import read_fold, stratified_folds, write_folds
from imputeflow.operators.stages import ImputerStage, ImputerStageModel
from imputeflow.plans import classic, compare, policy
from imputeflow.session import ensure_checkpoint_dir, side_by_side, small_table
from imputeflow.spec import TableSpec
from imputeflow.sources.tables import (
    EMB, EVENTS, WIDE8, append_metrics, emb, events, read_features_csv, wide8, with_row_key, write_report)

RATES = MISSING_RATES
# A policy as input of the adaptive queries: it names every family, trees from the rate on at which they are tried.
BY_RATE = dict(zip(MISSING_RATES, ("LR", "BR", "BR", "ET", "RF", "RF", "GB", "GB", "ET"), strict=True))
BY_RATE_COL = {(rate, j): (("LR", "BR", "RF", "ET", "GB") if rate >= TREES_FROM_RATE else ("LR", "BR"))[
    (j + i) % (5 if rate >= TREES_FROM_RATE else 2)] for i, rate in enumerate(MISSING_RATES) for j in range(len(WIDE8.feats))}
_shared: dict = {}


def _once(name: str, spark, sf_dir: str, make):
    """Tables several queries start from are made once per session and folder."""
    at = (name, spark.sparkContext.applicationId, sf_dir)
    if at not in _shared:
        _shared[at] = make()
    return _shared[at]


def _wide(spark, sf):
    return _once("wide", spark, sf, lambda: wide8(spark, sf).persist())


def _wide_z(spark, sf):
    return _once("wide_z", spark, sf, lambda: stats.z_score(_wide(spark, sf), WIDE8.feats))


def _emb(spark, sf):
    return _once("emb", spark, sf, lambda: emb(spark, sf).persist())


def _emb3(spark, sf):
    return _once("emb3", spark, sf, lambda: emb(spark, sf, merge_from=2).persist())


def _wide_gaps(spark, sf):
    return _once("wide_gaps", spark, sf,
                 lambda: amp.create_mcar(_wide_z(spark, sf), WIDE8, list(WIDE8.feats), 0.2).persist())


def _numbered(df: DataFrame) -> DataFrame:
    """The wide table with its class as a number, where the class is a predictor."""
    classes = F.array(*[F.lit(c) for c in "ANR"])
    return df.withColumn("label", (F.array_position(classes, F.col("label")) - 1).cast("double"))


def _r(c, digits: int = 4):
    """Rounded for comparison; adding zero turns -0.0 into 0.0."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def _rounded(df: DataFrame, spec, digits: int = 4) -> DataFrame:
    return df.select(spec.key, spec.label, *[_r(f, digits).alias(f) for f in spec.feats])


def _round_cols(df: DataFrame, cols, digits: int = 6) -> DataFrame:
    return df.withColumns({c: _r(c, digits) for c in cols})


def _class_centers(df: DataFrame, spec) -> cluster.CentroidClusterer:
    """Class means as given centres, in the order of the labels."""
    rows = df.groupBy(spec.label).agg(*[F.avg(f).alias(f) for f in spec.feats]).orderBy(spec.label).collect()
    return cluster.CentroidClusterer(spec.feats, [[r[f] for f in spec.feats] for r in rows])


# ---- tables and statistics -----------------------------------------------------------

def label_index(spark, sf):
    w = _wide(spark, sf)
    classes = classify.class_list(w, "label")
    tagged = classify.label_index(w, "label", classes, "y")
    back = classify.label_from_index(tagged, "y", classes, "label")
    return back.groupBy("label", F.col("y").cast("bigint").alias("label_idx")).agg(F.count("*").alias("n"))


def profile(spark, sf):
    return _round_cols(stats.column_profile(_wide(spark, sf), WIDE8.feats), ["mean", "std", "std0", "range"], 4)


def medians(spark, sf):
    q = exact_quantiles(_wide(spark, sf), list(WIDE8.feats), [0.5])
    return _round_cols(small_table(spark, [(c, v) for (c, _), v in q.items()], "col string, value double", 32), ["value"])


def quantiles(spark, sf):
    return _round_cols(stats.quantile_table(_wide(spark, sf), WIDE8.feats, [0.1, 0.25, 0.9]), ["value"])


def text_sentinel(spark, sf):
    text = F.when(F.col("label") == "N", "?").otherwise(F.col("l_quantity").cast("bigint").cast("string"))
    df = _wide(spark, sf).select("label", sentinel_to_null(text).alias("v"))
    return df.groupBy("label").agg(F.count("*").alias("n"), F.count("v").alias("n_known"), _r(F.avg("v")).alias("mean"))


def tail_rows(spark, sf):
    w = _wide(spark, sf)
    q = exact_quantiles(w, list(WIDE8.feats), [0.05, 0.95])
    hit = F.lit(False)
    for f in WIDE8.feats:
        hit = hit | (F.col(f) < q[f, 0.05]) | (F.col(f) > q[f, 0.95])
    return w.where(hit).select("row_id").distinct()


# ---- folds ---------------------------------------------------------------------------

def folds(spark, sf):
    return stratified_folds(_wide(spark, sf), WIDE8, 5, 7).select("row_id", "label", "fold")


def fold_write_read(spark, sf):
    path = f"{ensure_checkpoint_dir(spark)}/folds-{uuid.uuid4().hex}"
    write_folds(stratified_folds(_wide(spark, sf), WIDE8, 5, 7), path)
    train = read_fold(spark, path, 1, train=True).withColumn("part", F.lit("train"))
    test = read_fold(spark, path, 1, train=False).withColumn("part", F.lit("test"))
    return train.unionByName(test).groupBy("part", "label").agg(F.count("*").alias("n"))


# ---- masks ---------------------------------------------------------------------------

def _masked(make):
    def run(spark, sf):
        return make(_wide(spark, sf), WIDE8).select("row_id", "label", *WIDE8.feats)
    return run


def mcar_check(spark, sf):
    masked = amp.create_mcar(_wide(spark, sf), WIDE8, list(WIDE8.feats), 0.05)
    return amp.check_missing_counts(masked, WIDE8.feats, 0.05)


def mar_linear(spark, sf):
    z = _wide_z(spark, sf)
    return _rounded(amp.create_mar(z, WIDE8, list(WIDE8.feats), 0.3, model="LR"), WIDE8)


def mar_forest(spark, sf):
    z = _wide_z(spark, sf)
    return _rounded(amp.create_mar(z, WIDE8, list(WIDE8.feats), 0.3), WIDE8)


def scenario_grid(spark, sf):
    out = None
    for (mech, rate), t in amp.scenario_tables(_wide(spark, sf), WIDE8).items():
        counts = stats.missing_counts(t, WIDE8.feats).select(
            F.lit(mech).alias("mech"), F.lit(rate).alias("rate"), "col", "n_miss")
        out = counts if out is None else out.unionByName(counts)
    return out


def _mar_missing(spark, sf, by=None):
    masked = amp.create_mar_tail(_wide(spark, sf), WIDE8, 0.2)
    return _round_cols(stats.missing_counts(masked, WIDE8.feats, by), ["rate"])


# ---- fills and scores ----------------------------------------------------------------

def _fill(strategy):
    def run(spark, sf):
        return _rounded(SimpleImputer(WIDE8, strategy).fit_transform(_wide_gaps(spark, sf)), WIDE8)
    return run


def _raw_fill(strategy):
    def run(spark, sf):
        masked = amp.create_mcar(_wide(spark, sf), WIDE8, list(WIDE8.feats), 0.2)
        return SimpleImputer(WIDE8, strategy).fit_transform(masked).select(*WIDE8.columns)
    return run


def _tail_mean(spark, sf):
    z = _wide_z(spark, sf)
    masked = _once("tail_gaps", spark, sf, lambda: amp.create_mnar_tail(z, WIDE8, 0.2))
    return z, masked, SimpleImputer(WIDE8, "mean").fit_transform(masked)


def rmse_cells(spark, sf):
    """z-score → blank the tails → mean fill → RMSE per column over the blanked cells."""
    return _round_cols(metrics.cell_rmse(*_tail_mean(spark, sf), WIDE8), ["rmse"])


def rmse_table(spark, sf):
    """The label counts as a ninth column, as its class number."""
    truth, _, imputed = _tail_mean(spark, sf)
    classes = classify.class_list(truth, "label")
    numbered = [classify.label_index(t, "label", classes, "y") for t in (truth, imputed)]
    return _round_cols(metrics.table_rmse(*numbered, TableSpec("row_id", WIDE8.feats, "y")), ["rmse"])


def report_write(spark, sf):
    path = f"{ensure_checkpoint_dir(spark)}/report-{uuid.uuid4().hex}"
    write_report(rmse_cells(spark, sf), path)
    return spark.read.option("header", True).schema("col int, rmse double").csv(path)


def csv_round_trip(spark, sf):
    path = f"{ensure_checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}"
    _emb(spark, sf).select(*EMB.columns).write.option("header", True).csv(path)
    return _rounded(read_features_csv(spark, path, EMB), EMB, 6)


def keyless_ingest(spark, sf):
    keyed = with_row_key(_wide(spark, sf).drop("row_id"))
    return keyed.groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("row_id").alias("n_keys"))


def leak_free_scale(spark, sf):
    """Scaler and cluster centres from the training rows alone, applied to the rows held out."""
    parts = stratified_folds(_wide(spark, sf), WIDE8, 5, 7)
    train, test = parts.where(F.col("fold") != 1), parts.where(F.col("fold") == 1)
    scaler = stats.ZScaler(WIDE8.feats).fit(train)
    centers = _class_centers(scaler.transform(train), WIDE8)
    return _rounded(centers.assign(scaler.transform(test)), WIDE8).join(
        centers.assign(scaler.transform(test)).select("row_id", "cluster"), "row_id")


def _scores(spark, sf):
    def make():
        z = _wide_z(spark, sf)
        scenarios = amp.scenario_tables(z, WIDE8, RATES, carry=True)
        fills = {"mean": SimpleImputer(WIDE8, "mean"), "median": SimpleImputer(WIDE8, "median")}
        plain = policy.score_imputers(z, scenarios, WIDE8, lambda rate: fills)
        return metrics.add_rmse_std(plain, stats.column_profile(z, WIDE8.feats)).persist()
    return _once("scores", spark, sf, make)


def _difficulty(value):
    def run(spark, sf):
        return _round_cols(metrics.column_difficulty(_scores(spark, sf), value), ["mean", "std", "max"])
    return run


def rmse_pivot(spark, sf):
    table = metrics.score_pivot(_scores(spark, sf), RATES, ["mean", "median"])
    return table.select("col", *[_r(F.col(f"`{c}`"), 6).alias(c) for c in table.columns if c != "col"])


def rmse_at_rate(spark, sf):
    at = _scores(spark, sf).where(F.col("rate") == 0.1)
    return _round_cols(at.groupBy("imp", "col").agg(F.avg("rmse").alias("rmse")), ["rmse"])


def appended_metrics(spark, sf):
    path = f"{ensure_checkpoint_dir(spark)}/metrics-{uuid.uuid4().hex}"
    for mech in ("mcar", "mar", "mnar"):
        append_metrics(_scores(spark, sf).where(F.col("mech") == mech), path)
    back = spark.read.parquet(path)
    return back.groupBy("mech", "imp").agg(F.count("*").alias("n"), _r(F.avg("rmse"), 6).alias("rmse"))


def policy_lookup(spark, sf):
    masked = amp.create_mar_tail(_wide_z(spark, sf), WIDE8, 0.2)
    asked = _round_cols(stats.missing_counts(masked, WIDE8.feats, "label"), ["rate"]).select(
        "label", "col_idx", closest_rate(F.col("rate")).alias("rate_bin"))
    scores = _scores(spark, sf)
    return policy.look_up_policy(asked, policy.best_by_rate_col(scores), policy.best_by_rate(scores)) \
        .select("label", "col_idx", "rate_bin", "imp")


def meta_features(spark, sf):
    table = policy.meta_table(_wide_z(spark, sf), WIDE8, policy.best_by_rate_col(_scores(spark, sf)))
    return _round_cols(table, ["col_mean", "col_std", "col_range", "max_corr", "mean_corr"])


# ---- chained and adaptive imputers ---------------------------------------------------

def _chain(rounds):
    def run(spark, sf):
        chained = ChainedImputer(WIDE8, "LR", rounds, tol=None, order="roman")
        return _rounded(chained.fit_transform(_wide_gaps(spark, sf)), WIDE8)
    return run


def saved_model(spark, sf):
    """A fitted chain, saved to the shared folder, read again and applied."""
    path = f"{ensure_checkpoint_dir(spark)}/model-{uuid.uuid4().hex}"
    gaps = _wide_gaps(spark, sf)
    ImputerStage(ChainedImputer(WIDE8, "LR", 3, tol=None, order="roman")).fit(gaps).save(path)
    return _rounded(ImputerStageModel.load(path).transform(gaps), WIDE8)


def lr_impute(spark, sf):
    return _rounded(ColumnAdaptiveImputer(WIDE8, {}).fit_transform(_wide_gaps(spark, sf)), WIDE8)


def _on_wide(make):
    def run(spark, sf):
        return make(spark, sf).fit_transform(_wide_gaps(spark, sf)).drop("label")
    return run


# Error of an imputer in mean fills' errors, at most; 1.01 for those not named. The columns of the wide table are nearly
# independent, so nothing beats the mean by much: low-rank methods fill noise with noise (1.75 and 1.61 at 60,000 rows), and a
# cluster's models see fewer rows, whose cluster was told from filled cells (1.06).
LIMITS = {"svd": 1.8, "mf": 1.7, "cluster": 1.1}


def _facts(imputers):
    """Per imputer what must hold on every row: known cells stay, no gap is left, the error is at most its limit times a mean fill's.

    The mean fill's own error is computed in the SQL, too.
    """
    def run(spark, sf):
        z, gaps = _wide_z(spark, sf), _wide_gaps(spark, sf)
        plain = metrics.pooled_rmse(z, gaps, SimpleImputer(WIDE8).fit_transform(gaps), WIDE8).first().rmse
        rows = []
        for name, make in imputers.items():
            done = make(spark, sf).fit_transform(gaps).persist()
            both = gaps.join(done.select("row_id", *[F.col(f).alias(f"i_{f}") for f in WIDE8.feats]), "row_id", "left")
            moved = total([F.count_if(F.abs(F.col(f) - F.col(f"i_{f}")) > 1e-9) for f in WIDE8.feats])
            left = total([F.count_if(F.col(f"i_{f}").isNull() | F.isnan(f"i_{f}")) for f in WIDE8.feats])
            empty = total([F.count_if(F.col(f).isNull()) for f in WIDE8.feats])
            found = both.agg(F.count("*").alias("n"), empty.alias("n_gaps"), moved.alias("n_moved"), left.alias("n_left")).first()
            rmse = metrics.pooled_rmse(z, gaps, done, WIDE8).first().rmse
            rows.append((name, *found, round(plain, 6), bool(rmse <= LIMITS.get(name, 1.01) * plain)))
            done.unpersist()
        return small_table(spark, rows, "imp string, n long, n_gaps long, n_moved long, n_left long, mean_rmse double, near boolean", 72)
    return run


LINEAR_FACTS = {
    "lr": lambda s, d: ChainedImputer(WIDE8, "LR", 5, order="roman"), "br": lambda s, d: ChainedImputer(WIDE8, "BR", 10),
    "svd": lambda s, d: SvdImputer(WIDE8, 4), "mf": lambda s, d: FactorImputer(WIDE8),
    "column": lambda s, d: ColumnAdaptiveImputer(WIDE8, {(0.2, j): "BR" for j in (1, 3)}),
    "cluster": lambda s, d: ClusteredImputer(WIDE8, _kmeans(s, d), *_linear_policy(s, d)),
    "uncertain": lambda s, d: UncertaintyAwareColumnAdaptiveImputer(
        WIDE8, {(0.2, j): "BR" for j in range(0, 8, 2)}, ensemble="bootstrap"),
}
# one round of the studied trees; the adaptive ones fit every family once
TREE_FACTS = {"rf": lambda s, d: ChainedImputer(WIDE8, "RF", 1), "gb": lambda s, d: ChainedImputer(WIDE8, "GB", 1),
              "et": lambda s, d: ChainedImputer(WIDE8, "ET", 1),
              "column": lambda s, d: ColumnAdaptiveImputer(WIDE8, BY_RATE_COL)}


def _scenarios(spark, sf):
    """Every mechanism at every studied rate."""
    return _once("scenarios", spark, sf, lambda: {
        k: t.persist() for k, t in amp.scenario_tables(_wide_z(spark, sf), WIDE8).items()})


def _family_scores(spark, sf):
    return _once("family_scores", spark, sf, lambda: policy.score_families(
        _wide_z(spark, sf), _scenarios(spark, sf), WIDE8).persist())


def _linear_policy(spark, sf):
    """A policy of linear families alone, for the facts of the linear imputers."""
    def make():
        z = _wide_z(spark, sf)
        scenarios = amp.scenario_tables(z, WIDE8, (0.1, 0.3), ("mcar", "mnar"))
        scores = policy.score_families(z, scenarios, WIDE8, only=("LR", "BR"))
        return policy.policy_values(policy.best_by_rate(scores), policy.best_by_rate_col(scores))
    return _once("linear_policy", spark, sf, make)


def _given_best(spark) -> DataFrame:
    """The given policy by rate and column as the table that the selector learns from."""
    rows = [(rate, j, imp) for (rate, j), imp in BY_RATE_COL.items()]
    return small_table(spark, rows, "rate double, col int, imp string", 32)


def _selector(spark, sf):
    return _once("selector", spark, sf, lambda: policy.MetaSelector(MISSING_RATES).fit(
        _wide_z(spark, sf), WIDE8, _given_best(spark)))


def _kmeans(spark, sf):
    return _once("kmeans", spark, sf, lambda: cluster.fit_kmeans(_wide_z(spark, sf), list(WIDE8.feats)))


def _fuzzy(spark, sf):
    return _once("fuzzy", spark, sf, lambda: cluster.fit_fuzzy_cmeans(
        _wide_z(spark, sf), WIDE8.feats, WIDE8.key))


def meta_select(spark, sf):
    table = policy.meta_table(_wide_z(spark, sf), WIDE8, _given_best(spark))
    return _selector(spark, sf).predict_frame(table).select("rate", "col_idx", "best_imp", "imp")


def meta_cv(spark, sf):
    mean, std = _selector(spark, sf).cross_validate()
    return small_table(spark, [(mean, std)], "mean double, std double", 16)


def _augmented(how, family="LR"):
    def run(spark, sf):
        return classic.impute_with_clusters(_numbered(_wide_gaps(spark, sf)), _wide_z(spark, sf), WIDE8, family, how,
                                            _fuzzy(spark, sf)).drop("label")
    return run


def classic_scores(spark, sf):
    gaps = {k: _numbered(t) for k, t in _scenarios(spark, sf).items()}
    return classic.score_tables(_numbered(_wide_z(spark, sf)), gaps, WIDE8, classic.classic_imputers(WIDE8))


def _comparison(spark, sf):
    return _once("comparison", spark, sf, lambda: compare.compare_methods(
        _wide_z(spark, sf), _scenarios(spark, sf), WIDE8, _family_scores(spark, sf), _kmeans(spark, sf)))


def method_report(spark, sf):
    found = _comparison(spark, sf)
    tables = [compare.report(found, m).select(F.lit(m).alias("mech"), "*") for m in ("mcar", "mar", "mnar")]
    return reduce(DataFrame.unionByName, tables)


# ---- neighbours and rebalancing ------------------------------------------------------

def _neighbours(spec, base, k, group=None):
    def run(spark, sf):
        df = base(spark, sf)
        near = NeighbourJoin(spec.key, spec.feats, k, group).join(df, df)
        return near.select(F.col("k").alias("row_id"), "dk", "rank", _r("dist", 6).alias("dist"))
    return run


def knn_impute(spark, sf):
    df = _emb(spark, sf)
    masked = amp.create_mcar(df, EMB, list(EMB.feats), 0.3)
    return _rounded(KnnImputer(EMB, 3, ["label"]).fit_transform(masked), EMB)


def _resampled(name):
    def run(spark, sf):
        return _rounded(resample.RESAMPLERS[name](_emb3(spark, sf), EMB), EMB, 6)
    return run


# ---- clusters ------------------------------------------------------------------------

def _assigned(spark, sf):
    df = _emb3(spark, sf)
    return _class_centers(df, EMB).assign(df)


def kmeans_assign(spark, sf):
    z = _wide_z(spark, sf)
    return _class_centers(z, WIDE8).assign(z).select("row_id", "cluster")


def fcm_step(spark, sf):
    df = _emb3(spark, sf)
    found = cluster.fuzzy_step(df, EMB.feats, _class_centers(df, EMB).centers)
    return _round_cols(found, ["weight", *EMB.feats])


def mcmv(spark, sf):
    return _round_cols(cluster.centroid_norms(_assigned(spark, sf), EMB.feats), ["mcmv"])


def _feature(how, names):
    def run(spark, sf):
        df = _emb3(spark, sf)
        side, _ = cluster.cluster_features(df, EMB.feats, "row_id", _class_centers(df, EMB), how)
        return _round_cols(cluster.attach(df.select("row_id"), side, "row_id"), names)
    return run


def silhouette(spark, sf):
    return _round_cols(cluster.silhouette(_assigned(spark, sf), EMB.feats, "row_id"), ["silhouette"])


def silhouette_squared(spark, sf):
    value = cluster.silhouette_squared(_assigned(spark, sf), EMB.feats)
    return small_table(spark, [(round(value, 6),)], "silhouette double", 8)


# ---- classification ------------------------------------------------------------------

def _centroid_scores(spark, sf) -> DataFrame:
    """Closeness to each class mean as a score, rounded so that ties occur."""
    df = _emb3(spark, sf)
    closeness = [F.lit(1.0) / (F.lit(1.0) + cluster.squared_distance(EMB.feats, c))
                 for c in _class_centers(df, EMB).centers]
    named = df.select("row_id", "label", *[c.alias(f"s{i}") for i, c in enumerate(closeness)])
    sums = total([F.col(f"s{i}") for i in range(len(closeness))])
    scored = named.withColumn("score", F.array(*[F.round(F.col(f"s{i}") / sums, 3) for i in range(len(closeness))]))
    best = F.array_position("score", F.array_max("score")) - 1
    return scored.select("row_id", "label", "score", best.cast("int").alias("prediction"))


def ovo_auc(spark, sf):
    return _round_cols(metrics.ovo_auc(_centroid_scores(spark, sf), "label", "score", [0, 1, 2]), ["auc"])


def cv_summary(spark, sf):
    parts = stratified_folds(_centroid_scores(spark, sf), EMB.with_feats(()), 5, 0)
    hit = (F.col("label") == F.col("prediction")).cast("double")
    per_fold = parts.groupBy("fold").agg(F.avg(hit).alias("score"))
    return _round_cols(metrics.fold_summary(per_fold), ["mean", "std"])


def _metrics_frame(spark, values: dict) -> DataFrame:
    return small_table(spark, [(k, float(v)) for k, v in values.items()], "metric string, value double", 32)


def grid_search(spark, sf):
    found = classify.search_forest(_emb3(spark, sf), EMB, *classify.HOLDOUT_GRID)
    return _metrics_frame(spark, {"trees": found.trees, "depth": found.depth, "cv_accuracy": found.cv_accuracy})


def nested_cv(spark, sf):
    return _metrics_frame(spark, classify.nested_cv(_emb3(spark, sf), EMB))


def _holdout(resampled: bool):
    """Mean fill of a train part with gaps, grid search on it, scores on the fold left out."""
    def run(spark, sf):
        parts = stratified_folds(_emb3(spark, sf), EMB, 5, 7).persist()
        train, test = parts.where(F.col("fold") != 1).drop("fold"), parts.where(F.col("fold") == 1)
        masked = amp.create_mcar(train, EMB, list(EMB.feats), 0.2)
        grid = classify.RESAMPLED_GRID if resampled else classify.HOLDOUT_GRID
        return _metrics_frame(spark, classify.holdout_cv(
            SimpleImputer(EMB).fit_transform(masked), test, EMB, *grid, resample=resampled))
    return run


def resample_then_classify(spark, sf):
    parts = stratified_folds(_emb3(spark, sf), EMB, 5, 7).persist()
    train, test = parts.where(F.col("fold") != 1).drop("fold"), parts.where(F.col("fold") == 1)
    scenarios = {k: t.persist() for k, t in amp.scenario_tables(train, EMB).items()}

    def classify_list(task):  # the tables of all rates, of one mechanism and imputer
        mech, name, imputer = task
        tables = {f"{name} {mech} {rate}": imputer.fit_transform(t) for (m, rate), t in scenarios.items() if m == mech}
        return classic.classify_imputed(tables, test, EMB)

    lists = [(mech, name, imputer) for mech in ("mcar", "mar", "mnar")
             for name, imputer in classic.classic_imputers(EMB).items()]
    return reduce(DataFrame.unionByName, side_by_side(classify_list, lists))


def queries() -> dict:
    feats8 = list(WIDE8.feats)
    return {
        "flagship": rmse_cells,
        # tables and statistics
        "wide_features": lambda s, d: wide8(s, d),
        "label_index": label_index,
        "zscore": lambda s, d: _rounded(_wide_z(s, d), WIDE8),
        "profile": profile, "medians": medians, "quantiles": quantiles,
        "corr_long": lambda s, d: _round_cols(stats.correlation_long(_wide(s, d), feats8), ["r"]),
        "corr_offdiag": lambda s, d: _round_cols(
            stats.off_diagonal_correlation(_wide(s, d), feats8), ["max_corr", "mean_corr"]),
        "class_counts": lambda s, d: stats.value_counts(_wide(s, d), "label"),
        "head_rows": lambda s, d: _wide_z(s, d).orderBy("row_id").limit(5).select("row_id", _r("l_quantity").alias("l_quantity")),
        "sentinel_to_null": text_sentinel,
        "complete_cases": lambda s, d: complete_cases(
            amp.create_mcar(_wide(s, d), WIDE8, feats8, 0.2), WIDE8).select(*WIDE8.columns),
        "tail_rows": tail_rows,
        # folds
        "stratified_folds": folds,
        "fold_class_counts": lambda s, d: folds(s, d).groupBy("fold", "label").agg(F.count("*").alias("n")),
        "fold_write_read": fold_write_read,
        # masks
        "mcar_mask": _masked(lambda w, spec: amp.create_mcar(w, spec, feats8, 0.2)),
        "mcar_check": mcar_check,
        "mnar_tail": _masked(lambda w, spec: amp.create_mnar_tail(w, spec, 0.2)),
        "mar_tail": _masked(lambda w, spec: amp.create_mar_tail(w, spec, 0.2)),
        "mnar_logistic": _masked(lambda w, spec: amp.create_mnar(w, spec, feats8, 0.2)),
        "mnar_logistic_events": lambda s, d: amp.create_mnar(events(s, d), EVENTS, "value", 0.2).select("row_id", "label", "value"),
        "mar_linear": mar_linear, "mar_forest": mar_forest, "scenario_grid": scenario_grid,
        "missing_rate": lambda s, d: _mar_missing(s, d),
        "missing_rate_by_cluster": lambda s, d: _mar_missing(s, d, "label"),
        "rate_bin": lambda s, d: _mar_missing(s, d, "label").select("label", "col_idx", closest_rate(F.col("rate")).alias("rate_bin")),
        "max_iter": lambda s, d: _mar_missing(s, d, "label").select("label", "col_idx", rounds_for_rate(F.col("rate")).alias("max_iter")),
        # fills and scores
        "mean_fill": _fill("mean"), "median_fill": _fill("median"),
        "mode_fill": _raw_fill("most_frequent"), "constant_fill": _raw_fill("constant"),
        "rmse_cells": rmse_cells,
        "rmse_pooled": lambda s, d: _round_cols(metrics.pooled_rmse(*_tail_mean(s, d), WIDE8), ["rmse"]),
        "rmse_table": rmse_table, "report_write": report_write, "csv_round_trip": csv_round_trip,
        "keyless_ingest": keyless_ingest, "leak_free_scale": leak_free_scale,
        "union_scores": lambda s, d: _round_cols(_scores(s, d).select("mech", "rate", "imp", "col", "rmse"), ["rmse"]),
        "rmse_std": lambda s, d: _round_cols(_scores(s, d).select("mech", "rate", "imp", "col", "rmse_std"), ["rmse_std"]),
        "col_difficulty": _difficulty("rmse"), "col_difficulty_std": _difficulty("rmse_std"),
        "rmse_pivot": rmse_pivot, "rmse_at_rate": rmse_at_rate, "append_metrics": appended_metrics,
        "best_by_rate": lambda s, d: _round_cols(policy.best_by_rate(_scores(s, d)), ["score"]),
        "best_by_rate_col": lambda s, d: _round_cols(policy.best_by_rate_col(_scores(s, d)), ["score"]),
        "policy_lookup": policy_lookup, "meta_features": meta_features,
        # chained and adaptive imputers
        "lr_impute": lr_impute, "mice_lr_1round": _chain(1), "mice_lr_rounds": _chain(3), "saved_model": saved_model,
        "mice_lr": _on_wide(lambda s, d: ChainedImputer(WIDE8, "LR", 5, order="roman")),
        "mice_br": _on_wide(lambda s, d: ChainedImputer(WIDE8, "BR", 10)),
        "mice_rf": _on_wide(lambda s, d: classic_imputer(WIDE8, "RF")),
        "mice_gb": _on_wide(lambda s, d: classic_imputer(WIDE8, "GB")),
        "mice_et": _on_wide(lambda s, d: chained_imputers_for_rate(WIDE8, 0.2)["ET"]),
        "svd_impute": _on_wide(lambda s, d: SvdImputer(WIDE8, 4)),
        "mf_impute": _on_wide(lambda s, d: FactorImputer(WIDE8)),
        "rate_adaptive": _on_wide(lambda s, d: RateAdaptiveImputer(WIDE8, BY_RATE)),
        "column_adaptive": _on_wide(lambda s, d: ColumnAdaptiveImputer(WIDE8, BY_RATE_COL)),
        "meta_column_adaptive": _on_wide(lambda s, d: MetaColumnAdaptiveImputer(WIDE8, _selector(s, d))),
        "cluster_meta_adaptive": _on_wide(lambda s, d: ClusterMetaColumnAdaptiveImputer(WIDE8, _kmeans(s, d), _selector(s, d))),
        "cluster_adaptive": _on_wide(lambda s, d: ClusteredImputer(WIDE8, _kmeans(s, d), BY_RATE, BY_RATE_COL)),
        "uncertainty": _on_wide(lambda s, d: UncertaintyAwareColumnAdaptiveImputer(WIDE8, {(0.2, j): "BR" for j in range(0, 8, 2)}, ensemble="bootstrap")),
        "cluster_label_mice": _augmented("label"), "cluster_onehot_mice": _augmented("onehot"),
        "cluster_mcmv_mice": _augmented("mcmv"),
        "linear_facts": _facts(LINEAR_FACTS), "tree_facts": _facts(TREE_FACTS),
        "meta_select": meta_select, "meta_cv": meta_cv,
        "classic_scores": classic_scores, "family_scores": _family_scores,
        "method_comparison": _comparison,
        "method_report": method_report,
        # neighbours and rebalancing
        "knn_join": _neighbours(EMB, _emb, 3), "knn_join_in_class": _neighbours(EMB, _emb3, 5, "label"),
        "knn_impute": knn_impute,
        "tomek_links": lambda s, d: resample.tomek_links(_emb3(s, d), EMB),
        "enn": lambda s, d: resample.edited_neighbours(_emb3(s, d), EMB).select("row_id", "label"),
        **{name: _resampled(name) for name in resample.RESAMPLERS},
        # clusters
        "kmeans_assign": kmeans_assign,
        "kmeans_fit": lambda s, d: _kmeans(s, d).assign(_wide_z(s, d)).select("row_id", "cluster"),
        "fcm_fit": lambda s, d: _fuzzy(s, d).assign(_wide_z(s, d)).select("row_id", "cluster"),
        "cluster_sizes": lambda s, d: kmeans_assign(s, d).groupBy("cluster").agg(F.count("*").alias("n")),
        "fcm_step": fcm_step, "mcmv": mcmv, "mcmv_feature": _feature("mcmv", ["mcmv"]),
        "onehot_cluster": _feature("onehot", ["c0", "c1", "c2"]),
        "silhouette": silhouette, "silhouette_squared": silhouette_squared,
        # classification
        "accuracy": lambda s, d: _round_cols(metrics.accuracy(_centroid_scores(s, d), "label"), ["accuracy"]),
        "ovo_auc": ovo_auc, "cv_summary": cv_summary, "grid_search_rf": grid_search,
        "nested_cv": nested_cv, "holdout_cv": _holdout(False), "holdout_cv_resampled": _holdout(True), "resample_then_classify": resample_then_classify,
    }
