"""Session-level helpers: lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_LIMIT_BYTES = 64 << 20


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder the cluster names; make a folder only for a local master."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="imputeflow-ckpt-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder, so that a lost executor costs no replay."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def side_by_side(work, items, workers: int = 4) -> list:
    """Results of independent chains of Spark jobs, in the order of the items; at most ``workers`` run at a time."""
    with ThreadPoolExecutor(workers) as pool:
        return list(pool.map(work, items))


class RollingCut:
    """Lineage cuts of a loop: each writes the table anew and then deletes the one before, so two are alive at most."""

    def __init__(self):
        self.path = None

    def cut(self, df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/round-{uuid.uuid4().hex}"
        df.write.parquet(path)
        if self.path:
            old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
        self.path = path
        return spark.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, rows: list, schema: str, row_bytes: int) -> DataFrame:
    """A table made of model parameters; hinted for broadcast only while it is really small."""
    df = spark.createDataFrame(rows, schema)
    if len(rows) * row_bytes <= BROADCAST_LIMIT_BYTES:
        return F.broadcast(df)
    return df


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    base = os.path.join(tempfile.mkdtemp(prefix="imputeflow-"), "imputeflow")
    spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", root, "imputeflow"))
    _shipped.add(app)
