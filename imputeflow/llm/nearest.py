"""Approximate nearest neighbours by an adaptive dimension scan inside probed lists (operator 6).

Vectors are dealt to lists by their nearest centre. A query visits the lists whose centres are nearest to it. There
the vectors, turned by one random rotation, are read in blocks of columns: after each block the distance so far, scaled up to
all columns, is tested against the query's bound, and a candidate is given up where the hypothesis that it lies within the
bound is rejected (threshold (1 + EPSILON / sqrt(d))^2). What survives all blocks is scored by the exact cosine of the
original vectors in double precision. The bound of a query is its (k+1)-th best score in the sample that the centres were
fitted on; these sample rows are results themselves, so a query never comes back short.

Bounded parts: centres and bounds come from a sample of ``SAMPLE_ROWS`` rows (lowest hash), the number of lists to probe
from ``TRIAL_QUERIES`` queries whose true neighbours one exact scan finds: the fewest lists that give ``RECALL`` of
them. Every row is indexed. Of equal vectors a result can hold the k+1 smallest ids at most, so only these enter the lists,
and equal queries are searched once; lists are split into blocks of bounded size. So a very common vector costs no more
than a rare one.

Null, zero, non-finite or wrongly sized vectors (other than the usual length) take no part; null ids neither; rows that
repeat an id and its vector count once; rows of a query's own id are never its neighbours; ties go to the smaller id. An
empty table gives an empty result. Only the id and vector columns are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from imputeflow.llm.shared import write_table

SAMPLE_ROWS = 16_000
TRIAL_QUERIES = 64
RECALL = 0.96
MAX_LISTS = 8192
BLOCK_ROWS = 4096
COLUMNS = 16
EPSILON = 2.1
PAIRS = 1 << 20
ROUNDS = 6
SEED = 6


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of the pairs of rows."""
    return np.clip((q * x).sum(1) / (np.sqrt((q * q).sum(1)) * np.sqrt((x * x).sum(1))), -1.0, 1.0)


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.zeros((0, width))


def fit_centres(sample: np.ndarray, n: int, random) -> np.ndarray:
    """Spherical k-means on unit vectors."""
    centres = sample[random.choice(len(sample), n, replace=False)]
    for _ in range(ROUNDS):
        own = np.argmax(sample @ centres.T, 1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)
    return centres


def adaptive_scan(queries: np.ndarray, bounds: np.ndarray, vectors: np.ndarray,
                  turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, vector) that no test gave up. ``bounds``: squared distances of unit vectors."""
    q, x, width = _unit(queries) @ turn, _unit(vectors) @ turn, turn.shape[0]
    found = []
    step = max(1, PAIRS // max(1, len(x)))
    for a in range(0, len(q), step):
        part = q[a:a + step]
        head = slice(0, COLUMNS)
        far = ((part[:, head] ** 2).sum(1)[:, None] + (x[:, head] ** 2).sum(1)[None, :]
               - 2 * part[:, head] @ x[:, head].T)
        done = min(COLUMNS, width)
        i, j = np.nonzero(far * (width / done) <= bounds[a:a + step, None] * (1 + EPSILON / np.sqrt(done)) ** 2)
        so_far = far[i, j]
        while done < width and len(i):
            block = slice(done, done + COLUMNS)
            so_far = so_far + ((part[i, block] - x[j, block]) ** 2).sum(1)
            done = min(done + COLUMNS, width)
            slack = (1 + EPSILON / np.sqrt(done)) ** 2 if done < width else 1 + 1e-9
            keep = so_far * (width / done) <= bounds[a + i] * slack + 1e-12
            i, j, so_far = i[keep], j[keep], so_far[keep]
        found.append((i + a, j))
    return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (
        np.zeros(0, int), np.zeros(0, int))


def valid_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, vec (doubles) and the content hashes a, b of usable vectors; repeated rows once."""
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vec"))
    fine = rows.where("id is not null and vec is not null and forall(vec, x -> x is not null and not isnan(x) and "
                      "abs(x) < double('infinity')) and exists(vec, x -> x != 0)")
    return (fine.withColumn("a", F.xxhash64("vec")).withColumn("b", F.xxhash64(F.lit(1), F.col("vec")))
            .groupBy("id", "a", "b").agg(F.first("vec").alias("vec")))


def nearest(table: DataFrame, k: int = 5, query_when: str = "id % 50 = 0", id_col: str = "vec_id",
            vector_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query row."""
    spark = table.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    vectors, _ = write_table(valid_vectors(table, id_col, vector_col), "vectors")
    usual = vectors.groupBy(F.size("vec").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if usual is None:
        return spark.createDataFrame([], schema)
    width, n = usual["width"], usual["count"]
    vectors = vectors.where(F.size("vec") == width)
    copies = Window.partitionBy("a", "b").orderBy("id")
    held = vectors.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).drop("copy")
    asked = vectors.where(query_when)
    distinct = asked.withColumn("copy", F.row_number().over(copies)).where("copy = 1").drop("copy")

    random = np.random.default_rng(SEED)
    turn = np.linalg.qr(random.standard_normal((width, width)))[0]
    sample = held.orderBy(F.xxhash64("id", "a"), "id").limit(SAMPLE_ROWS).select("id", "vec").toPandas()
    s_ids, s_vecs = sample["id"].to_numpy(), _matrix(sample["vec"], width)
    s_unit = _unit(s_vecs)
    n_lists = int(min(MAX_LISTS, max(1, round(np.sqrt(n))), len(s_ids)))
    centres = fit_centres(s_unit, n_lists, random)

    def assign(frames):
        for pdf in frames:
            if len(pdf):
                unit = _unit(_matrix(pdf["vec"], width))
                yield pdf.assign(list=np.argmax(unit @ centres.T, 1).astype(np.int32))

    listed, _ = write_table(held.mapInPandas(assign, "id long, a long, b long, vec array<double>, list int"), "listed")
    sizes = {r["list"]: r["count"] for r in listed.groupBy("list").count().collect()}  # a row per list, MAX_LISTS at most
    blocks = np.array([-(-sizes.get(i, 0) // BLOCK_ROWS) for i in range(n_lists)])
    n_probe = _lists_to_probe(listed, distinct, centres, s_ids, k, recall, width)

    def probe(frames):
        for pdf in frames:
            if not len(pdf):
                continue
            vecs, ids = _matrix(pdf["vec"], width), pdf["id"].to_numpy()
            unit = _unit(vecs)
            order = np.argsort(-(unit @ centres.T), 1, kind="stable")[:, :n_probe]
            near = unit @ s_unit.T
            top = min(k + 1, len(s_ids))
            best = np.argpartition(-near, top - 1, axis=1)[:, :top]
            scores = _cosines(np.repeat(vecs, top, 0), s_vecs[best.ravel()]).reshape(-1, top)
            bound = 2 - 2 * scores.min(1) if top == k + 1 else np.full(len(ids), np.inf)
            yield pd.DataFrame({
                "qa": pdf["a"], "qb": pdf["b"], "vec": pdf["vec"], "bound": bound,
                "place": [[{"list": int(c), "block": j} for c in row for j in range(blocks[c])] for row in order],
                "seed": [[{"id": int(s_ids[c]), "score": float(s)} for c, s in zip(cs, ss, strict=True)]
                         for cs, ss in zip(best, scores, strict=True)]})

    probes, _ = write_table(distinct.mapInPandas(
        probe, "qa long, qb long, vec array<double>, bound double, place array<struct<list:int,block:int>>, "
               "seed array<struct<id:long,score:double>>"), "probes")
    visits = probes.select("qa", "qb", "vec", "bound", F.explode("place").alias("p")).select(
        "qa", "qb", "vec", "bound", "p.list", "p.block")
    n_blocks = F.element_at(F.lit(blocks.tolist()), F.col("list") + 1)
    dealt = listed.withColumn("block", F.pmod(F.xxhash64("id"), n_blocks).cast("int"))

    def scan(left, right):
        if not len(left) or not len(right):
            return pd.DataFrame({"qa": [], "qb": [], "id": [], "score": []})
        q, x = _matrix(left["vec"], width), _matrix(right["vec"], width)
        i, j = adaptive_scan(q, left["bound"].to_numpy(), x, turn)
        out = pd.DataFrame({"qa": left["qa"].to_numpy()[i], "qb": left["qb"].to_numpy()[i],
                            "id": right["id"].to_numpy()[j], "score": _cosines(q[i], x[j])})
        if len(out):
            out = (out.sort_values(["qa", "qb", "score", "id"], ascending=[True, True, False, True])
                   .groupby(["qa", "qb"], sort=False).head(k + 1))
        return out

    found = visits.groupBy("list", "block").cogroup(dealt.groupBy("list", "block")).applyInPandas(
        scan, "qa long, qb long, id long, score double")
    seeds = probes.select("qa", "qb", F.explode("seed").alias("s")).select("qa", "qb", "s.id", "s.score")
    best = Window.partitionBy("qa", "qb").orderBy(F.desc("score"), "id")
    results = (found.unionByName(seeds).groupBy("qa", "qb", "id").agg(F.max("score").alias("score"))
               .withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1).drop("place"))
    own = asked.select(F.col("id").alias("query_id"), F.col("a").alias("qa"), F.col("b").alias("qb"))
    ranked = Window.partitionBy("query_id", "qa", "qb").orderBy(F.desc("score"), "id")
    return (own.join(results, ["qa", "qb"]).where("id != query_id")
            .withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
            .select("query_id", "rank", F.col("id").alias("vec_id"), "score"))


def _lists_to_probe(listed: DataFrame, queries: DataFrame, centres: np.ndarray, sample_ids: np.ndarray, k: int,
                    recall: float, width: int) -> int:
    """Fewest lists that hold the wanted share of true neighbours of some trial queries; one exact scan."""
    trial = queries.orderBy(F.xxhash64("a", "id"), "id").limit(TRIAL_QUERIES).select("id", "vec").toPandas()
    if not len(trial):
        return 1
    ids, vecs = trial["id"].to_numpy(), _matrix(trial["vec"], width)
    unit = _unit(vecs)

    def exact(frames):
        for pdf in frames:
            if not len(pdf):
                continue
            near = unit @ _unit(_matrix(pdf["vec"], width)).T
            near[ids[:, None] == pdf["id"].to_numpy()[None, :]] = -np.inf
            top = min(k, near.shape[1])
            best = np.argpartition(-near, top - 1, axis=1)[:, :top]
            yield pd.DataFrame({"q": np.repeat(np.arange(len(ids)), top), "id": pdf["id"].to_numpy()[best.ravel()],
                                "list": pdf["list"].to_numpy()[best.ravel()],
                                "score": np.take_along_axis(near, best, 1).ravel()})

    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    truth = (listed.mapInPandas(exact, "q int, id long, list int, score double")
             .withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
             .where("score > double('-infinity')").toPandas())  # k rows per trial query
    if not len(truth):
        return 1
    places = np.argsort(np.argsort(-(unit @ centres.T), 1, kind="stable"), 1)
    rank = places[truth["q"].to_numpy(), truth["list"].to_numpy()]
    rank[np.isin(truth["id"].to_numpy(), sample_ids)] = 0
    return int(np.sort(rank)[max(0, int(np.ceil(recall * len(rank))) - 1)]) + 1
