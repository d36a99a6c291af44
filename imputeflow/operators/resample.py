"""Class rebalancing: the SMOTE family, Tomek links, edited neighbours, ADASYN.

Which rows seed how many new rows is settled by seeded draws and exact-count cuts, so new
rows arise where their seeds are; nothing is drawn in a loop. New rows carry the key of
their seed plus a number.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imputeflow.functions.hashing import hash_uniform
from imputeflow.operators.knn import NeighbourJoin
from imputeflow.operators.orderstat import draw_cuts
from imputeflow.session import cut_lineage, small_table
from imputeflow.spec import TableSpec

# Neighbours used by each method.
SMOTE_NEIGHBOURS = 5
BORDERLINE_NEIGHBOURS = 10
ENN_NEIGHBOURS = 3
ADASYN_NEIGHBOURS = 5
SPLIT_SEED_ROWS = 1000  # new rows of one seed that stay in one task


def class_sizes(df: DataFrame, spec: TableSpec) -> dict:
    return {r[spec.label]: r["count"] for r in df.groupBy(spec.label).count().collect()}


def _text_keys(df: DataFrame, spec: TableSpec) -> DataFrame:
    return df.withColumn(spec.key, F.col(spec.key).cast("string")).select(*spec.columns)


def foreign_neighbours(df: DataFrame, spec: TableSpec, k: int, of: DataFrame | None = None) -> DataFrame:
    """``(key, n_near, n_foreign)``: among the k nearest rows, how many are of another class."""
    of = df if of is None else of
    near = NeighbourJoin(spec.key, spec.feats, k, tag=spec.label).join(of, df)
    tags = near.groupBy("k").agg(F.collect_list("dt").alias("tags"))  # at most k entries
    own = of.select(F.col(spec.key).alias("k"), F.col(spec.label).cast("string").alias("own"))
    return tags.join(own, "k").select(
        F.col("k").alias(spec.key), F.size("tags").alias("n_near"),
        F.size(F.filter("tags", lambda t: t != F.col("own"))).alias("n_foreign"))


def tomek_links(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Pairs of rows of different classes that are each other's nearest row."""
    near = NeighbourJoin(spec.key, spec.feats, 1, tag=spec.label).join(df, df)
    # both ends of a link name the same pair, each with the other end's class
    pair = near.select(F.least("k", "dk").alias("key_a"), F.greatest("k", "dk").alias("key_b"), "dt")
    return (pair.groupBy("key_a", "key_b").agg(F.count("*").alias("n"), F.min("dt").alias("lo"),
                                               F.max("dt").alias("hi"))
            .where((F.col("n") == 2) & (F.col("lo") != F.col("hi"))).select("key_a", "key_b"))


def remove_tomek(df: DataFrame, spec: TableSpec) -> DataFrame:
    links = tomek_links(df, spec)
    gone = links.select(F.explode(F.array("key_a", "key_b")).alias(spec.key))
    return df.join(gone, spec.key, "left_anti")


def edited_neighbours(df: DataFrame, spec: TableSpec, k: int = ENN_NEIGHBOURS) -> DataFrame:
    """Keep the rows whose k nearest rows are all of their own class."""
    gone = foreign_neighbours(df, spec, k).where(F.col("n_foreign") > 0)
    return df.join(gone, spec.key, "left_anti")


def _wanted(sizes: dict, k: int) -> dict:
    """New rows each smaller class needs; a class needs two rows at least to have a segment between any."""
    top = max(sizes.values(), default=0)
    wanted = {c: top - n for c, n in sizes.items() if n < top}
    for c in wanted:
        if sizes[c] < 2:
            raise ValueError(f"class {c!r} has {sizes[c]} row; new rows lie between two rows of a class")
        if sizes[c] <= k:
            warnings.warn(f"class {c!r} has {sizes[c]} rows, fewer than {k} neighbours each; all of them are used",
                          stacklevel=3)
    return wanted


def _numbered(seeds: DataFrame, key: str) -> DataFrame:
    """A row per seed and number ``__i`` up to ``__n``; a seed of very many new rows is spread over tasks first."""
    most = seeds.agg(F.max("__n")).first()[0] or 0
    if most <= SPLIT_SEED_ROWS:
        return seeds.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    parts = seeds.withColumn("__from", F.explode(F.sequence(F.lit(1), F.col("__n"), F.lit(SPLIT_SEED_ROWS))))
    return (parts.repartition(F.col(key), F.col("__from"))
            .withColumn("__i", F.explode(F.sequence("__from", F.least("__n", F.col("__from") + SPLIT_SEED_ROWS - 1))))
            .drop("__from"))


def _synthesise(seeds: DataFrame, df: DataFrame, spec: TableSpec, k: int, seed: int) -> DataFrame:
    """New rows between a seed and one of its k nearest rows of the same class.

    ``seeds`` has the table's columns and ``__n``, the number of new rows. Per new row one
    draw picks the neighbour and one the place on the segment.
    """
    own = seeds.select(spec.label).distinct().collect()  # one row per class; rows of other classes have no part in it
    mates_of = df.where(F.col(spec.label).isin(*[r[0] for r in own]))
    near = NeighbourJoin(spec.key, spec.feats, k, group=spec.label, carry=True).join(seeds, mates_of)
    mates = near.groupBy(F.col("k").alias(spec.key)).agg(
        F.array_sort(F.collect_list(F.struct("rank", "dx"))).alias("__near"))  # at most k entries
    plan = _numbered(seeds.join(mates, spec.key), spec.key)
    new_key = F.concat(F.col(spec.key), F.lit("#"), F.col("__i").cast("string"))
    plan = (plan.withColumn("__new", new_key)
            .withColumn("__pick", F.floor(hash_uniform(seed, "pick", "__new") * F.size("__near")).cast("int"))
            .withColumn("__gap", hash_uniform(seed, "gap", "__new"))
            .withColumn("__o", F.col("__near")[F.col("__pick")]["dx"]))
    return plan.select(F.col("__new").alias(spec.key),
                       *[(F.col(f) + F.col("__gap") * (F.col("__o")[i] - F.col(f))).alias(f)
                         for i, f in enumerate(spec.feats)], spec.label)


def _spread_over(seeds: DataFrame, spec: TableSpec, wanted: dict, seed: int) -> DataFrame:
    """Give each class's seeds their share ``__n`` of the wanted new rows, exactly in sum.

    Every seed gets the whole part; the rest goes one by one to the seeds of lowest draw.
    """
    classes = sorted(wanted)
    number = None
    for g, c in enumerate(classes):
        here = F.col(spec.label) == F.lit(c)
        number = F.when(here, g) if number is None else number.when(here, g)
    draw = hash_uniform(seed, "seed", spec.key)
    cuts, counts = draw_cuts(seeds, spec.key, [(draw, number)], list(range(len(classes))),
                             lambda n: {g: [wanted[c] % n[g]] for g, c in enumerate(classes) if n[g]})
    share = None
    for g, c in enumerate(classes):
        if not counts[g]:
            continue
        whole, rest = divmod(wanted[c], counts[g])
        here = F.col(spec.label) == F.lit(c)
        n = F.lit(whole) + F.when(cuts[g, rest].holds(F.col("__draw"), F.col(spec.key)), 1).otherwise(0)
        share = F.when(here, n) if share is None else share.when(here, n)
    if share is None:
        return seeds.withColumn("__n", F.lit(0)).where(F.lit(False))
    return (seeds.withColumn("__draw", draw).withColumn("__n", share).drop("__draw")
            .where(F.col("__n") > 0))


def smote(df: DataFrame, spec: TableSpec, k: int = SMOTE_NEIGHBOURS, seed: int = 0) -> DataFrame:
    """Bring every class up to the size of the largest."""
    df = _text_keys(df, spec)
    wanted = _wanted(class_sizes(df, spec), k)
    if not wanted:
        return df
    seeds = _spread_over(df.where(F.col(spec.label).isin(*wanted)), spec, wanted, seed)
    return df.unionByName(_synthesise(seeds, df, spec, k, seed))


def smote_tomek(df: DataFrame, spec: TableSpec, seed: int = 0) -> DataFrame:
    return remove_tomek(cut_lineage(smote(df, spec, seed=seed)), spec)


def smote_enn(df: DataFrame, spec: TableSpec, seed: int = 1) -> DataFrame:
    return edited_neighbours(cut_lineage(smote(df, spec, seed=seed)), spec)


def borderline_smote(df: DataFrame, spec: TableSpec, k: int = SMOTE_NEIGHBOURS,
                     m: int = BORDERLINE_NEIGHBOURS, seed: int = 2) -> DataFrame:
    """As SMOTE, seeded only by rows with at least half but not all neighbours foreign."""
    df = _text_keys(df, spec)
    wanted = _wanted(class_sizes(df, spec), k)
    if not wanted:
        return df
    minority = df.where(F.col(spec.label).isin(*wanted))
    danger = foreign_neighbours(df, spec, m, of=minority).where(
        (F.col("n_foreign") >= m / 2) & (F.col("n_foreign") < m)).select(spec.key)
    seeds = cut_lineage(minority.join(danger, spec.key, "left_semi"))
    seeds = _spread_over(seeds, spec, wanted, seed)
    return df.unionByName(_synthesise(seeds, df, spec, k, seed))


def adasyn(df: DataFrame, spec: TableSpec, k: int = ADASYN_NEIGHBOURS, seed: int = 3) -> DataFrame:
    """Rows with more foreign neighbours seed more new rows, in proportion."""
    df = _text_keys(df, spec)
    wanted = _wanted(class_sizes(df, spec), k)
    if not wanted:
        return df
    minority = df.where(F.col(spec.label).isin(*wanted))
    ratio = cut_lineage(foreign_neighbours(df, spec, k, of=minority)
                        .withColumn("__r", F.col("n_foreign") / F.lit(float(k)))
                        .join(minority, spec.key))
    # one row per class
    total = ratio.groupBy(spec.label).agg(F.sum("__r").alias("__sum"))
    alone = sorted(str(r[spec.label]) for r in total.where("__sum = 0").collect())
    if alone:
        raise ValueError(f"no row of class {', '.join(alone)} has a neighbour of another class; use SMOTE there")
    goal = small_table(df.sparkSession, list(wanted.items()),
                       f"{spec.label} {df.schema[spec.label].dataType.simpleString()}, __want long", 32)
    shares = ratio.join(F.broadcast(total), spec.label).join(goal, spec.label)
    n = F.bround(F.col("__r") / F.col("__sum") * F.col("__want")).cast("int")
    seeds = shares.withColumn("__n", n).where(F.col("__n") > 0).select(*spec.columns, "__n")
    return df.unionByName(_synthesise(seeds, df, spec, k, seed))


RESAMPLERS = {"smote": smote, "smote_tomek": smote_tomek, "smote_enn": smote_enn,
              "borderline_smote": borderline_smote, "adasyn": adasyn}
