"""Fitted imputers as pipeline stages, saved and read again: the same cells, on tables and in a Pipeline."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel

from imputeflow.operators import amputate as amp
from imputeflow.operators.adaptive import ClusteredImputer, ClusterMetaColumnAdaptiveImputer, ColumnAdaptiveImputer
from imputeflow.operators.cluster import CentroidClusterer
from imputeflow.operators.families import TreeSizes
from imputeflow.operators.lowrank import SvdImputer
from imputeflow.operators.mice import ChainedImputer
from imputeflow.operators.simple import SimpleImputer
from imputeflow.operators.stages import ImputerStage, ImputerStageModel
from imputeflow.spec import TableSpec

SPEC = TableSpec("k", ("a", "b", "c"))
SIZES = TreeSizes(rf_trees=4, et_trees=4, gb_rounds=6, max_depth=4)


class Always:
    """A selector that names one family per column."""

    def predict_many(self, asked):
        return [("RF", "BR", "GB")[j] for j, _ in asked]


@pytest.fixture(scope="module")
def gaps(spark):
    g = np.random.default_rng(6)
    a, b = g.normal(size=(2, 400))
    rows = [(i, *map(float, r)) for i, r in enumerate(np.column_stack([a, b, a + b]))]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double")
    return amp.create_mcar(df, SPEC, list(SPEC.feats), 0.3).persist()


CENTERS = CentroidClusterer(SPEC.feats, [[-1, 0, 0], [1, 0, 0]])
POLICY = {(0.3, 0): "RF", (0.3, 1): "ET", (0.3, 2): "GB"}
IMPUTERS = {
    "mean": SimpleImputer(SPEC), "lr": ChainedImputer(SPEC, "LR", 3), "br": ChainedImputer(SPEC, "BR", 2, stepwise=True),
    "rf": ChainedImputer(SPEC, "RF", 1, sizes=SIZES), "gb": ChainedImputer(SPEC, "GB", 1, sizes=SIZES),
    "column": ColumnAdaptiveImputer(SPEC, POLICY, sizes=SIZES),
    "cluster": ClusteredImputer(SPEC, CENTERS, None, POLICY | {(0.3, 1): "BR"}, sizes=SIZES, n_ensemble=2),
    "meta": ClusterMetaColumnAdaptiveImputer(SPEC, CENTERS, Always(), sizes=SIZES),
}


def values(df):
    pdf = df.orderBy("k").toPandas()
    return pdf[sorted(pdf.columns)].to_numpy(float)


@pytest.mark.parametrize("name", IMPUTERS)
def test_a_read_model_fills_the_same_cells(gaps, tmp_path, name):
    fitted = ImputerStage(IMPUTERS[name]).fit(gaps)
    path = str(tmp_path / "model")
    fitted.save(path)
    again = ImputerStageModel.load(path)
    want = values(fitted.transform(gaps))
    assert not np.isnan(want).any() and np.array_equal(want, values(again.transform(gaps))) and again.uid == fitted.uid
    with pytest.raises(Exception):
        fitted.save(path)  # a saved model isn't overwritten unless asked to
    fitted.write().overwrite().save(path)


def test_inside_a_pipeline(gaps, tmp_path):
    fitted = Pipeline(stages=[ImputerStage(IMPUTERS["lr"]), ImputerStage(SimpleImputer(SPEC))]).fit(gaps)
    path = str(tmp_path / "pipeline")
    fitted.save(path)
    assert np.array_equal(values(fitted.transform(gaps)), values(PipelineModel.load(path).transform(gaps)))


def test_what_cannot_be_saved_says_so(gaps, tmp_path):
    with pytest.raises(TypeError, match="can't be saved"):
        ImputerStage(SvdImputer(SPEC, 2)).fit(gaps).save(str(tmp_path / "svd"))
