"""Similarity join of texts on word shingles by chosen paths (operator 4).

Every distinct text is a set of shingles, kept as ``SIGNATURE`` sampled tokens: for each of as many hash functions the
shingle it hashes lowest. A run starts with all sets in one node. At a node one or two of the sampled tokens are chosen by a
hash of the node alone (1 / ``SIMILARITY`` of them on average, so that a similar pair keeps meeting), and the sets go to a
child node for each value. A node with one set ends. A small node is compared by brute force on the sampled
tokens. A larger one is measured: it is dense if members drawn from it agree with each other, on average, in ``DENSE`` of the
sampled tokens that were not chosen on the way to it. Splitting a dense node by two tokens would not lower the number of its
pairs that meet (two children, each keeping half of them at least), so it is taken whole. A node that isn't dense (texts that
share a part only) is split on, from the split after the ``LEVELS``-th on by two tokens and ``STEP`` times at once, until it is
small; one that is still large after ``DEEP`` more splits is taken whole. Runs are repeated until a pair at the threshold is
missed with a probability of at most 1 - ``RECALL`` through all these splits.

Plausible pairs of small nodes, and dense nodes, are joined where they overlap into blocks (connected components), so that a
pair found in several runs is tested and counted once. Tokens chosen on the way to a node agree in all its sets and don't make a
pair plausible. In the blocks, the exact similarity of each pair is computed from whole texts, in tiles bounded in sets and
in bytes: a product of two incidence matrices per tile, from which only the number of links of each text
and its group inside the tile leave. Copies of a text are one set with a weight, so they cost nothing.

Null texts and texts without words have no shingles and form no links; a text with fewer words than a shingle is one
shingle. A text longer than a tile's bytes is read whole, beside few others. Repeated rows are copies. Ties have no part in the
result. An empty table gives an empty result. Only the id and text columns are read; null ids are kept and stand behind all
others as class ids.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from imputeflow.llm.components import components
from imputeflow.llm.shared import drop_table, slices, write_table
from imputeflow.llm.shingles import WORDS, distinct_runs, shingle_hashes

SIMILARITY = 0.8
SIGNATURE = 64
RECALL = 0.9999
SMALL = 16
LEVELS = 3
DEEP = 21
STEP = 3
DENSE = 0.5
WITNESSES = 8
TILE = 512
TILE_BYTES = 16 << 20
PLAUSIBLE = 0.5625
SEED = 4


def runs_for(recall: float, similarity: float) -> int:
    """Runs until a pair at the threshold has been in one node with the wanted probability, LEVELS + DEEP splits deep.

    With one token, or with two at 1 / similarity - 1, a pair keeps meeting in a critical branching process: the chance
    to survive a split follows q -> 1 - (1 - s q) ((1 - p) + p (1 - s q)), with p = 1 below LEVELS. All runs choose from the
    same sample, so s is the part of the sampled tokens that agrees: the miss is averaged over its binomial distribution,
    and a sample that agrees in less than PLAUSIBLE counts as missed.
    """
    p, kinds = 1 / similarity - 1, []
    for agree in range(SIGNATURE + 1):
        s, q = agree / SIGNATURE, 1.0
        for second in [1.0] * DEEP + [p] * LEVELS:
            miss = 1 - s * q
            q = 1 - miss * ((1 - second) + second * miss)
        chance = math.comb(SIGNATURE, agree) * similarity ** agree * (1 - similarity) ** (SIGNATURE - agree)
        kinds.append((chance, q if s >= PLAUSIBLE else 0.0))
    if sum(chance for chance, q in kinds if not q) >= 1 - recall:
        raise ValueError(f"{SIGNATURE} sampled tokens are too few for a recall of {recall} at {similarity}")
    runs = 1
    while sum(chance * (1 - q) ** runs for chance, q in kinds) > 1 - recall:
        runs += 1
    return runs


def _children(path, second_chance: float):
    """Places of the sampled tokens that a node chooses: one, and a second one with the given chance."""
    first = F.pmod(F.xxhash64(path, F.lit(1)), F.lit(SIGNATURE)).cast("int")
    second = F.pmod(first + 1 + F.pmod(F.xxhash64(path, F.lit(2)), F.lit(SIGNATURE - 1)), F.lit(SIGNATURE)).cast("int")
    both = F.pmod(F.xxhash64(path, F.lit(3)), F.lit(1 << 20)) < int(second_chance * (1 << 20))
    return F.when(both, F.array(first, second)).otherwise(F.array(first))


def _split(nodes: DataFrame, second_chance: float) -> DataFrame:
    """(path, id, sig, used) of the children of all nodes; used has a bit for each place chosen on the way."""
    at = nodes.select("path", "id", "sig", "used", F.explode(_children(F.col("path"), second_chance)).alias("place"))
    return at.select(F.xxhash64("path", "place", F.element_at("sig", F.col("place") + 1)).alias("path"), "id", "sig",
                     F.expr("used | shiftleft(1L, place)").alias("used"))


@F.pandas_udf(DoubleType())
def _mean_agreement(sigs: pd.Series, used: pd.Series) -> pd.Series:
    """Mean part of the sampled tokens, less those chosen on the way, in which two of the witnesses agree."""
    out = []
    for rows, bits in zip(sigs, used, strict=True):
        sig = np.stack(rows)[:, (bits >> np.arange(SIGNATURE)) & 1 == 0]
        m = len(sig)
        alike = (sig[:, None] == sig[None]).sum() - m * sig.shape[1]
        out.append(alike / max(m * (m - 1) * sig.shape[1], 1))
    return pd.Series(out, dtype=float)


def _density(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(path, head, agreement) of the nodes of ``nodes``: smallest id, and how far drawn members agree with each other.

    Up to ``WITNESSES`` members are drawn by nearness of their ids to random ids, so a node is read once, whatever its pairs.
    """
    masks = np.random.default_rng(SEED).integers(0, 1 << 62, WITNESSES).tolist()
    drawn = nodes.groupBy("path").agg(
        F.min("id").alias("head"), F.max("used").alias("used"),
        *[F.min(F.col("id").bitwiseXOR(F.lit(m))).alias(f"w{k}") for k, m in enumerate(masks)])
    ids = F.array_distinct(F.array(*[F.col(f"w{k}").bitwiseXOR(F.lit(m)) for k, m in enumerate(masks)]))
    met = drawn.select("path", "head", "used", F.explode(ids).alias("id")).join(sets, "id")
    return met.groupBy("path").agg(
        F.first("head").alias("head"), F.first("used").alias("used"), F.collect_list("sig").alias("sigs")).select(
        "path", "head", _mean_agreement("sigs", "used").alias("agreement"))


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, text hash, bytes, and the sampled tokens (null without a word) of each row; one pass over the texts."""
    rows = docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("key"),
                       F.octet_length("text").cast("long").alias("n_bytes"), "text")
    random = np.random.default_rng(SEED)
    factors = random.integers(0, 1 << 63, SIGNATURE, np.uint64) * np.uint64(2) + np.uint64(1)

    def sign(batches):
        for batch in slices(batches):
            h, offsets = shingle_hashes(batch.column("text"), words)
            n = np.diff(offsets)
            full = np.flatnonzero(n)
            out = np.zeros((len(full), SIGNATURE), np.int32)
            if len(full):
                starts = offsets[:-1][full]
                for k, f in enumerate(factors):
                    out[:, k] = (np.minimum.reduceat(h * f ^ (h >> np.uint64(31)), starts) >> np.uint64(20)).astype(
                        np.uint32).view(np.int32)
            sig = np.full(len(n), None, object)
            sig[full] = list(out)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), batch.column("n_bytes"), pa.array(sig, pa.list_(pa.int32()))],
                ["doc_id", "key", "n_bytes", "sig"])

    return rows.mapInArrow(sign, "doc_id long, key string, n_bytes long, sig array<int>")


def _leaf_edges(nodes: DataFrame, groups: int) -> DataFrame:
    """Plausible pairs (a, b) inside small nodes, compared on the sampled tokens."""
    def compare(pdf):
        pdf = pdf.sort_values(["path", "id"], kind="stable")
        path, ids = pdf["path"].to_numpy(), pdf["id"].to_numpy()
        sig = np.stack(pdf["sig"].to_numpy())
        free = (pdf["used"].to_numpy()[:, None] >> np.arange(SIGNATURE)) & 1 == 0
        places = np.maximum(free.sum(1), 1)
        found = []
        for gap in range(1, SMALL):  # each set with the one `gap` places on in its node
            a = np.flatnonzero(path[gap:] == path[:-gap])
            if not len(a):
                break
            agree = ((sig[a] == sig[a + gap]) & free[a]).sum(1) >= PLAUSIBLE * places[a]
            found.append(np.stack([ids[a[agree]], ids[a[agree] + gap]], 1))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        return pd.DataFrame({"a": pairs[:, 1], "b": pairs[:, 0]})

    dealt = nodes.withColumn("grp", F.pmod(F.xxhash64("path"), F.lit(groups)))
    return dealt.groupBy("grp").applyInPandas(compare, "a long, b long")


def candidate_edges(sets: DataFrame, similarity: float, recall: float, name: str = "paths") -> DataFrame:
    """Edges (a, b) between ids whose sets met in a node and look similar.

    Only ids move between nodes; sampled tokens are joined to them where a node is split, measured or compared.
    """
    spark = sets.sparkSession
    n = sets.count()
    groups = max(16, n // 4000)
    runs = runs_for(recall, similarity)
    nodes = sets.select("id", "sig", F.lit(0).cast("long").alias("used"),
                        F.explode(F.array(*[F.xxhash64(F.lit(SEED), F.lit(r)) for r in range(runs)])).alias("path"))
    paths = []  # edges are written level by level: one plan of all levels would fill the driver
    done = []  # tables of the level before

    def keep(df, tables):
        table, path = write_table(df, name)
        tables.append(path)
        return table

    rounds = [*range(1, LEVELS + 1), *range(LEVELS + STEP, LEVELS + DEEP + 1, STEP)]
    for level in rounds:
        used_up, done = done, []
        rows = nodes
        for _ in range(1 if level <= LEVELS else STEP):
            rows = _split(rows, 1 / similarity - 1 if level <= LEVELS else 1.0)
        rows = rows.select("path", "id", "used")
        if level > 1:  # the first split's rows, mostly alone in their nodes, are made twice instead
            rows = keep(rows, used_up)
        met = keep(rows.join(rows.groupBy("path").count().where("count > 1"), "path"), done)
        for path in used_up:
            drop_table(spark, path)
        keep(_leaf_edges(met.where(F.col("count") <= SMALL).select("path", "id", "used").join(sets, "id"), groups), paths)
        large = met.where(F.col("count") > SMALL).select("path", "id", "used")
        told = keep(_density(large, sets), done)
        whole = F.col("agreement") >= (DENSE if level < rounds[-1] else -1.0)
        keep(large.join(told.where(whole), "path").select(F.col("id").alias("a"), F.col("head").alias("b")), paths)
        open_nodes = told.where(~whole).select("path")
        if open_nodes.isEmpty():
            break
        # written, so that the planner knows the size of what it joins to the sets
        nodes = keep(large.join(open_nodes, "path"), done).join(sets, "id")
    for path in done:
        drop_table(spark, path)
    return spark.read.schema("a long, b long").parquet(*paths)


def tile_links(ids: np.ndarray, weights: np.ndarray, values: np.ndarray, offsets: np.ndarray, left: np.ndarray,
               right: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Weighted links and smallest linked group member of each set of a tile.

    ``left`` and ``right`` mark the two sides; a set on both sides meets each other set of the tile once.
    """
    n = len(ids)
    sizes = np.diff(offsets)
    _, code, times = np.unique(values, return_inverse=True, return_counts=True)
    shared = times[code] > 1  # a shingle of one set alone joins nothing
    owner = np.repeat(np.arange(n), sizes)[shared]
    _, code = np.unique(code[shared], return_inverse=True)
    common = np.zeros((n, n), np.float32)
    width = 4096
    for a in range(0, int(code.max()) + 1 if len(code) else 0, width):
        part = (code >= a) & (code < a + width)
        table = np.zeros((n, width), np.float32)
        table[owner[part], code[part] - a] = 1
        common += table @ table.T
    union = sizes[:, None] + sizes[None, :] - common
    linked = (common >= similarity * union - 1e-6) & (union > 0)
    linked &= (left[:, None] & right[None, :]) | (right[:, None] & left[None, :])
    np.fill_diagonal(linked, False)
    links = linked.astype(np.float64) @ weights
    root = np.arange(n)
    while True:
        best = np.minimum(root, np.where(linked, root[None, :], n).min(1)) if n else root
        best = best[best]
        if (best == root).all():
            return links.astype(np.int64), ids[root] if n else ids
        root = best


def _blocks(docs: DataFrame, members: DataFrame, blocks: DataFrame, words: int, similarity: float) -> DataFrame:
    """(id, links, root) per tile: exact comparison inside the blocks."""
    place = blocks.join(members.select("id", "doc_id", "key", "weight", "n_bytes"), F.col("node") == F.col("id"))
    # tile numbers: sets of a block are dealt by a hash, so no block is numbered through in one task
    sizes = place.groupBy("root").agg(F.count("*").alias("count"), F.sum("n_bytes").alias("bytes"))
    tiles = F.greatest(F.ceil(F.col("count") / TILE), F.least("count", F.ceil(F.col("bytes") / TILE_BYTES))).cast("int")
    place = (place.join(sizes, "root").withColumn("tiles", tiles)
             .withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")))
    text = docs.select(F.col("doc_id").alias("d"), F.md5(F.coalesce("text", F.lit(""))).alias("k"), "text")
    full = text.join(place, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("key"))).select(
        "id", "root", "weight", "tiles", "tile", "text")
    n, n_bytes = place.agg(F.count("*"), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    groups = max(1, n // (2 * TILE), n_bytes // (2 * TILE_BYTES))
    # a pair of tiles (i, j) is a task; small blocks share tasks
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1),
                        lambda j: F.struct(F.least("tile", j).alias("i"), F.greatest("tile", j).alias("j")))
    spread = full.withColumn("pair", F.explode(pairs)).withColumn(
        "grp", F.when(F.col("tiles") == 1, F.pmod(F.xxhash64("root"), F.lit(groups)))
        .otherwise(F.xxhash64("root", "pair")))

    def compare(pdf):
        out = []
        pdf = pdf.drop_duplicates(["id", "root"]).sort_values(["root", "id"], kind="stable") if (
            pdf["tiles"].iloc[0] == 1) else pdf.drop_duplicates("id").sort_values("id", kind="stable")
        cuts = np.flatnonzero(np.diff(pdf["root"].to_numpy())) + 1
        h, offsets = shingle_hashes(pa.array(pdf["text"], pa.large_string()), words)
        values, offsets = distinct_runs(h, offsets)
        ids, weights, tile = pdf["id"].to_numpy(), pdf["weight"].to_numpy(), pdf["tile"].to_numpy()
        i = np.array([p["i"] for p in pdf["pair"]])
        j = np.array([p["j"] for p in pdf["pair"]])
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(pdf)], strict=True):
            part = slice(a, b)
            links, roots = tile_links(ids[part], weights[part], values[offsets[a]:offsets[b]],
                                      offsets[a:b + 1] - offsets[a], tile[part] == i[part], tile[part] == j[part],
                                      similarity)
            out.append(pd.DataFrame({"id": ids[part], "links": links, "root": roots}))
        return pd.concat(out)

    return spread.groupBy("grp").applyInPandas(compare, "id long, links long, root long")


def similarity_join(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id of its group of linked texts), n_links, text_key, class_key.

    n_links counts the other documents whose similarity is at least the threshold, copies included. class_key is the
    text_key of the group's first document by (doc_id, text_key).
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed, _ = write_table(signatures(docs, words), "signed")
    classes = signed.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("weight"),
                                        F.first("n_bytes").alias("n_bytes"), F.first("sig").alias("sig"))
    classes, _ = write_table(classes.where("sig is not null").withColumn("id", F.monotonically_increasing_id()), "classes")
    members = classes.select("id", "doc_id", "key", "weight", "n_bytes")
    edges, _ = write_table(candidate_edges(classes.select("id", "sig"), similarity, recall).distinct(), "candidates")
    blocks, _ = write_table(components(edges), "blocks")
    tested, _ = write_table(_blocks(docs, members, blocks, words, similarity), "tested")
    groups, _ = write_table(components(tested.select(F.col("id").alias("a"), F.col("root").alias("b"))), "groups")
    links = tested.groupBy("id").agg(F.sum("links").alias("links"))
    named = (members.join(groups, F.col("id") == F.col("node"), "left")
             .withColumn("root", F.coalesce("root", "id")).join(links, "id", "left"))
    head = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("class_id"), head["key"].alias("class_key"))
    per_class = named.join(smallest, "root").select(
        F.col("key").alias("k"), "class_id", "class_key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    return signed.select("doc_id", "key").join(per_class, F.col("key") == F.col("k"), "left").select(
        "doc_id", F.when(F.col("k").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("key").alias("text_key"),
        F.coalesce("class_key", "key").alias("class_key"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with one of each group of linked texts (its smallest id, then text hash), all columns kept.

    Of rows that repeat id and text, the one stays whose columns, written as JSON, come first.
    """
    found, _ = write_table(similarity_join(docs, id_col=id_col, text_col=text_col, **options), "joined")
    lone = found.where("n_links = 0")
    first = found.where("n_links > 0 and class_id <=> doc_id and class_key = text_key")
    keep = lone.unionByName(first).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    own = docs.withColumn("__own", F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    kept = own.join(keep, F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__key")),
                    "left_semi")
    repeated = first.groupBy("doc_id", "text_key").count().where("count > 1").limit(1).count()
    if repeated:  # rows that repeat id and text: one of them stays
        place = Window.partitionBy(id_col, "__own").orderBy(
            F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col] or [F.lit(0)])))
        linked = first.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
        twice = F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__key"))
        marked = kept.withColumn("__place", F.row_number().over(place))
        kept = marked.join(linked, twice, "left_anti").unionByName(
            marked.join(linked, twice, "left_semi").where("__place = 1")).drop("__place")
    return kept.drop("__own")
