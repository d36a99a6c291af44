"""Readers and writers, and the three feature views over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from imputeflow.functions.scalars import nan_to_null, sentinel_to_null
from imputeflow.spec import TableSpec

WIDE8 = TableSpec("row_id", ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "p_size",
                             "p_retailprice", "o_totalprice", "s_acctbal"), "label")
EMB = TableSpec("row_id", tuple(f"f{i}" for i in range(64)), "label")
EVENTS = TableSpec("row_id", ("value",), "label")


def read_features_csv(spark: SparkSession, path: str, spec: TableSpec, label_type: str = "int",
                      sentinel: str = "?") -> DataFrame:
    """CSV with a header; sentinel and NaN become null, features double, the label an integer."""
    fields = ", ".join(f"`{c}` string" for c in spec.columns)
    raw = spark.read.option("header", True).option("enforceSchema", False).schema(fields).csv(path)
    feats = [nan_to_null(sentinel_to_null(c, sentinel)).alias(c) for c in spec.feats]
    label = [F.col(spec.label).cast("double").cast(label_type).alias(spec.label)] if spec.label else []
    return raw.select(spec.key, *feats, *label)


def read_features_parquet(spark: SparkSession, path: str, spec: TableSpec) -> DataFrame:
    df = spark.read.parquet(path)
    feats = [nan_to_null(F.col(c).cast("double")).alias(c) for c in spec.feats]
    return df.select(spec.key, *feats, *([spec.label] if spec.label else []))


COPIES_PER_TASK = 1 << 20


def with_row_key(df: DataFrame, key: str = "row_id", copies: int = COPIES_PER_TASK) -> DataFrame:
    """Give rows of a table without a key one: a digest of the row and a number among equal rows.

    The same rows get the same keys however the table is partitioned. Equal rows are alike in everything, so they are
    counted (each task sends one of them) and made again with their numbers, ``copies`` of them in a task at most.
    """
    nested = ("array", "map", "struct")
    texts = [F.to_json(F.struct(F.col(f"`{c}`"))) if kind.startswith(nested) else F.col(f"`{c}`").cast("string")
             for c, kind in df.dtypes]
    # with its length in front of each text, only equal rows have equal texts
    marked = [F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    named = df.select(F.md5(F.concat(*marked)).alias("digest"),
                      F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    counted = named.groupBy("digest").agg(F.first("row").alias("row"), F.count("*").alias("n"))
    few = counted.where(F.col("n") <= copies).select("digest", "row", F.lit(0).cast("long").alias("part"), "n")
    many = counted.where(F.col("n") > copies).select(
        "digest", "row", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {copies}"))).alias("part"), "n")
    parts = few.unionByName(many.repartition("digest", "part"))
    first = F.col("part") * copies + 1
    made = parts.select("digest", "row", F.explode(F.sequence(first, F.least(first + copies - 1, F.col("n")))).alias("number"))
    return made.select(F.concat_ws("#", "digest", F.col("number").cast("string")).alias(key), "row.*")


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Add rows to a long metrics table; earlier runs stay."""
    metrics.write.mode("append").parquet(path)


def write_report(table: DataFrame, path: str) -> None:
    """A report as CSV with a header, in plain UTF-8."""
    table.write.mode("overwrite").option("header", True).csv(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the numbers of their part, order and supplier; join sides left to Spark."""
    li = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"),
                                               "p_retailprice")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    whole = [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"),
             F.col("l_quantity").cast("bigint"), F.round(F.col("l_extendedprice") * 100).cast("bigint")]
    return (li.join(part, li.l_partkey == part.p_partkey)
            .join(orders, li.l_orderkey == orders.o_orderkey)
            .join(supplier, li.l_suppkey == supplier.s_suppkey)
            .select(F.concat_ws("|", *whole).alias("row_id"), *WIDE8.feats,
                    F.col("l_returnflag").alias("label")))


def emb(spark: SparkSession, sf_dir: str, merge_from: int | None = None) -> DataFrame:
    """All components of the vectors as columns; ``merge_from`` joins the classes from there on."""
    label = F.col("label") if merge_from is None else F.least(F.col("label"), F.lit(merge_from))
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(len(EMB.feats))],
        label.cast("int").alias("label"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"), F.col("value").cast("double").alias("value"),
        F.col("event_type").alias("label"))
