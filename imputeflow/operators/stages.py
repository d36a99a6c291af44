"""Imputers as stages of a ``pyspark.ml`` Pipeline, and fitted imputers that can be saved and read again.

A saved model is a folder: the usual stage metadata, ``state`` (one row: a JSON tree of names and numbers) and ``arrays`` (a row
per weight vector, covariance matrix or forest: number, type, shape, bytes), both parquet. Nothing in it is code. Low-rank
and nearest-neighbour models can't be saved: the first rebuild rows by functions, the second are their donor table.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame

from imputeflow.operators.adaptive import ClusteredImputerModel, ClusterMetaModel, ColumnModel
from imputeflow.operators.cluster import CentroidClusterer
from imputeflow.operators.families import LinearModel, TreeModel
from imputeflow.operators.forests import Forest, Growth, ModelSpec
from imputeflow.operators.linear import LinearFit
from imputeflow.operators.mice import PatternChainModel, StepChainModel
from imputeflow.operators.simple import SimpleImputerModel
from imputeflow.spec import TableSpec

KNOWN = {c.__name__: c for c in (
    SimpleImputerModel, PatternChainModel, StepChainModel, ClusteredImputerModel, ClusterMetaModel, ColumnModel, CentroidClusterer,
    LinearModel, LinearFit, TreeModel, Forest, Growth, ModelSpec, TableSpec)}
ARRAY_SCHEMA = "number int, dtype string, shape array<int>, data binary"


def _packed(value, arrays: list):
    """The value as JSON; arrays are put aside and named by number."""
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, np.ndarray):
        arrays.append((len(arrays), value.dtype.str, list(value.shape), np.ascontiguousarray(value).tobytes()))
        return {"array": arrays[-1][0]}
    if isinstance(value, (int, np.integer)):
        return int(value)
    if isinstance(value, (float, np.floating)):
        return {"real": float(value).hex()}
    if isinstance(value, (list, tuple)):
        return {type(value).__name__: [_packed(v, arrays) for v in value]}
    if isinstance(value, dict):
        return {"dict": [[_packed(k, arrays), _packed(v, arrays)] for k, v in value.items()]}
    name = type(value).__name__
    if KNOWN.get(name) is not type(value):
        raise TypeError(f"a model with a {name} can't be saved")
    return {"object": name, "fields": {k: _packed(v, arrays) for k, v in vars(value).items()}}


def _unpacked(value, arrays: dict):
    if not isinstance(value, dict):
        return value
    if "array" in value:
        return arrays[value["array"]]
    if "real" in value:
        return float.fromhex(value["real"])
    if "list" in value:
        return [_unpacked(v, arrays) for v in value["list"]]
    if "tuple" in value:
        return tuple(_unpacked(v, arrays) for v in value["tuple"])
    if "dict" in value:
        return {_unpacked(k, arrays): _unpacked(v, arrays) for k, v in value["dict"]}
    made = object.__new__(KNOWN[value["object"]])
    made.__dict__.update({k: _unpacked(v, arrays) for k, v in value["fields"].items()})
    return made


class ImputerStage(Estimator):
    """Any imputer of the library as an estimator: ``fit`` gives an :class:`ImputerStageModel`."""

    def __init__(self, imputer=None):
        super().__init__()
        self.imputer = imputer

    def _fit(self, dataset: DataFrame) -> "ImputerStageModel":
        return ImputerStageModel(self.imputer.fit(dataset))


class ImputerStageModel(Model, MLWritable, MLReadable):
    """A fitted imputer as a transformer, for tables and streams."""

    def __init__(self, model=None):
        super().__init__()
        self.model = model

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.model.transform(dataset)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, stage: ImputerStageModel):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        spark, arrays = self.sparkSession, []
        state = json.dumps(_packed(self.stage.model, arrays))
        DefaultParamsWriter.saveMetadata(self.stage, path, spark)
        spark.createDataFrame([(state,)], "state string").write.parquet(f"{path}/state")
        spark.createDataFrame(arrays, ARRAY_SCHEMA).write.parquet(f"{path}/arrays")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> ImputerStageModel:
        spark = self.sparkSession
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        arrays = {r.number: np.frombuffer(r.data, np.dtype(r.dtype)).reshape(r.shape)
                  for r in spark.read.parquet(f"{path}/arrays").collect()}
        stage = self.cls(_unpacked(json.loads(spark.read.parquet(f"{path}/state").first().state), arrays))
        stage._resetUid(metadata["uid"])
        return stage
