"""Ranked lexical search with a limited number of accumulators (operator 11).

The texts are read once for each block of queries (a block's vocabulary is bounded by ``BLOCK_TERMS``) and leave one row per
document: its number of terms, and the query terms it holds with their counts. Terms are weighted by their document frequency, and the
largest contribution of any document bounds each term.

Every query goes through its terms from the rarest on, in rounds of 1, 1, 2, 4, 8 ... terms. A round adds the contributions of its terms'
postings to the accumulators (query, document) and makes new ones. As soon as the bounds of the terms that are left can't lift a
new document to the query's k-th partial score, the query makes no more accumulators; those that can't reach that score either are
left out. The survivors meet their documents' rows and take in what is left of their terms exactly. So the long posting lists
of common words only meet the few documents that can still win. A document without an accumulator can't be among the best k.

All numbers are 64-bit integers, apart from the logarithm in a weight. Ties go to the smaller doc_id, then (repeated doc_ids are documents
of their own) to the row that was read first; null doc_ids come last. Null and empty texts have no terms and are never found. Queries without terms
have no results; rows that repeat an item_id and text are queries of their own only if their item_ids differ: the terms of rows
with one item_id are taken together. Texts are read whole, in slices of Arrow batches. Empty tables give empty results. Other columns
are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from imputeflow.llm.shared import drop_table, slices, words_of, write_table
from imputeflow.session import BROADCAST_LIMIT_BYTES

BLOCK_TERMS = 1 << 20
# Weights of the score.
SCALE, PART_SCALE, TF_FACTOR, M_FACTOR, LENGTH_BASE, LENGTH_SHARE = 1000, 1000000000, 1000, 12, 100, 25


def _folded() -> np.ndarray:
    """For each byte: A-Z in lower case, other ASCII letters, digits and non-ASCII bytes as they are, a space for the rest."""
    table = np.full(256, ord(" "), np.uint8)
    for byte in range(256):
        if byte >= 0x80 or chr(byte).isalnum():
            table[byte] = ord(chr(byte).lower()) if byte < 0x80 else byte
    return table


FOLDED = _folded()


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts in order, and the offset of each text's first one."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    folded = FOLDED[flat]
    plain = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(offsets - offsets[0]), pa.py_buffer(folded)])
    return words_of(plain)


def query_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, qtf) of all queries."""
    def split(batches):
        for batch in slices(batches):
            terms, offsets = terms_of(batch.column("text"))
            owner = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(owner)), terms.cast(pa.string())],
                                             ["item_id", "term"])

    return items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        split, "item_id long, term string").groupBy("item_id", "term").agg(F.count("*").alias("qtf"))


def query_blocks(asked: DataFrame, limit: int = BLOCK_TERMS) -> list[DataFrame]:
    """The queries in blocks of about ``limit`` different terms at most (a longer query is a block of its own)."""
    per_item = asked.groupBy("item_id").agg(F.count("*").alias("n"))
    total = per_item.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_blocks = max(1, math.ceil(2 * total / limit))
    if n_blocks == 1:
        return [asked]
    return [asked.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == b) for b in range(n_blocks)]


def forward_rows(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(doc_id, n, terms, tfs) of every text: its number of terms, and the numbers and counts of those in the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def read(batches):
        known = pa.array(shared.value, pa.large_string())
        width = len(known)
        for batch in slices(batches):
            terms, offsets = terms_of(batch.column("text"))
            d = terms.cast(pa.large_string()).dictionary_encode()
            number = pc.fill_null(pc.index_in(d.dictionary, value_set=known), -1).to_numpy(zero_copy_only=False)
            term = number[d.indices.to_numpy(zero_copy_only=False)].astype(np.int64) if len(d) else np.zeros(0, np.int64)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            held = term >= 0
            pair, tf = np.unique(owner[held] * width + term[held], return_counts=True)
            starts = np.searchsorted(pair // max(width, 1), np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(np.diff(offsets).astype(np.int64)),
                pa.ListArray.from_arrays(pa.array(starts), pa.array((pair % max(width, 1)).astype(np.int32))),
                pa.ListArray.from_arrays(pa.array(starts), pa.array(tf.astype(np.int64)))], ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        read, "doc_id long, n long, terms array<int>, tfs array<long>")


def _best(acc: DataFrame, k: int) -> DataFrame:
    """(item_id, kth) where at least k accumulators exist: the k-th largest partial score."""
    order = Window.partitionBy("item_id").orderBy(F.desc("score"))
    top = acc.select("item_id", "score", F.row_number().over(order).alias("place")).where(F.col("place") <= k)
    return top.groupBy("item_id").agg(F.min("score").alias("kth"), F.count("*").alias("n")).where(F.col("n") == k).drop("n")


def _search_block(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = sorted(r[0] for r in asked.select("term").distinct().collect())
    numbers = spark.createDataFrame(list(enumerate(vocabulary)), "t int, term string")
    index, index_path = write_table(forward_rows(docs, vocabulary).withColumn("row", F.monotonically_increasing_id()), "forward")
    n_docs, n_terms = index.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(1))).first()
    length = F.lit(LENGTH_BASE - LENGTH_SHARE) + F.expr(f"(bigint({LENGTH_SHARE}) * n * bigint({n_docs})) div bigint({n_terms})")
    posting = index.select("row", length.alias("m"), F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select(
        "row", F.col("p.terms").alias("t"),
        F.expr(f"(bigint({PART_SCALE}) * p.tfs) div (bigint({TF_FACTOR}) * p.tfs + bigint({M_FACTOR}) * m)").alias("part"))

    stats = posting.groupBy("t").agg(F.count("*").alias("df"), F.max("part").alias("most"))
    weight = F.floor(SCALE * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
    rarest = Window.partitionBy("item_id").orderBy("df", "t")
    plan = (asked.join(numbers, "term").join(stats, "t")
            .withColumn("gain", (F.col("qtf") * weight).cast("long"))
            .withColumn("round", F.ceil(F.log2(F.row_number().over(rarest).cast("double"))).cast("int"))
            .select("item_id", "t", "gain", "round", (F.col("gain") * F.col("most")).alias("bound")))
    plan, plan_path = write_table(plan, "plan")
    n_plan, rounds = plan.agg(F.count("*"), F.coalesce(F.max("round"), F.lit(-1))).first()
    hint = F.broadcast if n_plan * 64 <= BROADCAST_LIMIT_BYTES else lambda df: df
    left = plan.groupBy("item_id", "round").agg(F.sum("bound").alias("own"))
    behind = Window.partitionBy("item_id").orderBy(F.desc("round")).rowsBetween(Window.unboundedPreceding, -1)
    left = left.select("item_id", "round", F.coalesce(F.sum("own").over(behind), F.lit(0)).alias("rest"))

    empty = "item_id long, row long, score long, round int"
    acc, done, stopped, paths = None, spark.createDataFrame([], empty), None, [plan_path]
    for r in range(rounds + 1):
        now = plan.where(F.col("round") == r)
        if stopped is not None:
            now = now.join(hint(stopped), "item_id", "left_anti")
        new = posting.join(hint(now.select("item_id", "t", "gain")), "t").select(
            "item_id", "row", (F.col("gain") * F.col("part")).alias("score"))
        if acc is not None:
            new = acc.unionByName(new)
        made, path = write_table(new.groupBy("item_id", "row").agg(F.sum("score").alias("score")), "accumulators")
        paths.append(path)
        # queries whose terms are used up have no bound left for this round or the next ones
        rest = left.where(F.col("round") == r).select("item_id", "rest")
        judged = made.join(hint(rest), "item_id", "left").withColumn("rest", F.coalesce("rest", F.lit(0))).join(
            hint(_best(made, k)), "item_id", "left")
        judged = judged.withColumn("over", F.coalesce(F.col("rest") < F.col("kth"), F.lit(False)) | (F.col("rest") == 0))
        can_win = F.col("kth").isNull() | (F.col("score") + F.col("rest") >= F.col("kth"))
        judged, path = write_table(judged.where(can_win).select("item_id", "row", "score", "over"), "judged")
        paths.append(path)
        done = done.unionByName(judged.where("over").select("item_id", "row", "score", F.lit(r).alias("round")))
        ended = judged.where("over").select("item_id").distinct()
        stopped = ended if stopped is None else stopped.union(ended)
        acc = judged.where("not over").select("item_id", "row", "score")
        if acc.isEmpty() and not plan.where(F.col("round") > r).join(stopped, "item_id", "left_anti").limit(1).count():
            break
    # the survivors take in the terms that were left when their query stopped
    later = hint(plan.select(F.col("item_id").alias("i"), "t", "gain", F.col("round").alias("at")))
    survivors = done.join(index.select("row", "doc_id", length.alias("m"), "terms", "tfs"), "row")
    parts = survivors.select("item_id", "row", "doc_id", "score", "round", "m",
                             F.explode_outer(F.arrays_zip("terms", "tfs")).alias("p")).join(
        later, (F.col("item_id") == F.col("i")) & (F.col("p.terms") == F.col("t")) & (F.col("at") > F.col("round")), "left")
    more = F.col("gain") * F.expr(
        f"(bigint({PART_SCALE}) * p.tfs) div (bigint({TF_FACTOR}) * p.tfs + bigint({M_FACTOR}) * m)")
    total = parts.groupBy("item_id", "row", "doc_id").agg(
        (F.first("score") + F.coalesce(F.sum(more), F.lit(0))).alias("score")).where("score > 0")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "row")
    found, _ = write_table(total.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "item_id", "rank", "doc_id", "score"), "found")
    for path in [*paths, index_path]:
        drop_table(spark, path)
    return found


def search(docs: DataFrame, items: DataFrame, k: int = 20, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The k documents of highest score above 0 for each item: item_id, rank (from 1), doc_id, score."""
    asked, path = write_table(query_terms(items), "asked")
    found = None
    for block in query_blocks(asked, block_terms):
        got = _search_block(docs, block, k)
        found = got if found is None else found.union(got)
    drop_table(docs.sparkSession, path)
    return found
