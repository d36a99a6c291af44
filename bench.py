"""Times the headline operators and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from imputeflow.operators import amputate as amp  # noqa: E402
from imputeflow.operators import forests, metrics, resample, stats  # noqa: E402
from imputeflow.operators.adaptive import ClusteredImputer, ColumnAdaptiveImputer  # noqa: E402
from imputeflow.operators.cluster import CentroidClusterer, silhouette_squared, squared_distance  # noqa: E402
from imputeflow.operators.families import TreeSizes  # noqa: E402
from imputeflow.operators.knn_impute import KnnImputer  # noqa: E402
from imputeflow.operators.lowrank import SvdImputer  # noqa: E402
from imputeflow.operators.mice import ChainedImputer  # noqa: E402
from imputeflow.operators.simple import SimpleImputer  # noqa: E402
from imputeflow.session import ship_package  # noqa: E402
from imputeflow.operators.split import stratified_folds  # noqa: E402
from imputeflow.sources.tables import EMB, WIDE8, emb, wide8  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("imputeflow-bench")
             .config("spark.sql.shuffle.partitions", str(cpus)).config("spark.driver.memory", "6g")
             .config("spark.sql.files.maxPartitionBytes", str(8 << 20))
             .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    feats = list(WIDE8.feats)
    spent: dict[str, float] = {}

    def timed(name, run):
        start = time.time()
        out = run()
        spent[name] = round(time.time() - start, 3)
        return out

    def force(df):
        df.write.format("noop").mode("overwrite").save()
        return df

    raw = wide8(spark, sf_dir).repartition(cpus).persist()
    timed("wide_join", lambda: force(raw))
    timed("profile", lambda: stats.column_profile(raw, feats).collect())
    timed("correlation", lambda: stats.correlation_long(raw, feats).collect())
    z = timed("zscore", lambda: stats.z_score(raw, feats)).persist()
    timed("zscore_rows", lambda: force(z))
    timed("stratified_folds", lambda: force(stratified_folds(z, WIDE8)))
    timed("mcar_mask", lambda: force(amp.create_mcar(z, WIDE8, feats, 0.2)))
    timed("mnar_tail_mask", lambda: force(amp.create_mnar_tail(z, WIDE8, 0.2)))
    gaps = timed("mnar_logistic_mask", lambda: force(amp.create_mnar(z, WIDE8, feats, 0.2).persist()))
    timed("mean_fill_pooled_rmse", lambda: metrics.pooled_rmse(
        z, gaps, SimpleImputer(WIDE8).fit_transform(gaps), WIDE8).collect())
    timed("median_fill", lambda: force(SimpleImputer(WIDE8, "median").fit_transform(gaps)))
    timed("lr_mice_5_rounds", lambda: force(ChainedImputer(WIDE8, "LR", 5).fit_transform(gaps)))
    timed("br_mice_10_rounds", lambda: force(ChainedImputer(WIDE8, "BR", 10).fit_transform(gaps)))
    timed("column_adaptive", lambda: force(ColumnAdaptiveImputer(WIDE8, {}).fit_transform(gaps)))
    centers = [[r[f] for f in feats] for r in z.groupBy("label").agg(*[F.avg(f).alias(f) for f in feats]).collect()]
    timed("cluster_adaptive_std", lambda: force(ClusteredImputer(
        WIDE8, CentroidClusterer(feats, centers), best_by_rate_col={(0.2, j): "BR" for j in range(8)}).fit_transform(gaps)))
    timed("svd_impute", lambda: force(SvdImputer(WIDE8, 4).fit_transform(gaps)))
    timed("rf_mice_1_round", lambda: force(ChainedImputer(
        WIDE8, "RF", 1, sizes=TreeSizes(rf_trees=10, max_depth=5)).fit_transform(gaps)))
    timed("forest_40_trees", lambda: forests.fit_models(
        forests.forest_rows(z, feats, "row_id"), [forests.ModelSpec(0, tuple(range(7)), 7)],
        forests.Growth("RF", 40, 8), forests.bin_edges(z, feats)))
    tagged = CentroidClusterer(feats, centers).assign(z).persist()
    timed("silhouette_squared", lambda: silhouette_squared(tagged, feats))
    closeness = F.array(*[1 / (1 + squared_distance(feats, c)) for c in centers])
    classes = sorted(r["label"] for r in z.select("label").distinct().collect())
    timed("ovo_auc", lambda: metrics.ovo_auc(z.select("label", closeness.alias("p")), "label", "p", classes).collect())
    e = emb(spark, sf_dir).persist()
    timed("knn_impute", lambda: force(KnnImputer(EMB).fit_transform(amp.create_mcar(e, EMB, list(EMB.feats), 0.2))))
    timed("smote_enn", lambda: force(resample.smote_enn(emb(spark, sf_dir, 2).persist(), EMB)))
    print(json.dumps({"metric": "imputation_suite_seconds", "value": round(sum(spent.values()), 3),
                      "unit": "sec", "queries": spent, "sf": sf_dir.rstrip("/").split("sf")[-1]}))


if __name__ == "__main__":
    main()
