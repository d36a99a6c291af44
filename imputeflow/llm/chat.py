"""Chat logs without their snapshots, rendered (operator 5).

Chat systems log a conversation again with every turn, so the log holds many conversations that are the beginning of longer ones.
Turns are numbered by their order, and two 64-bit hashes of (number, role, text) are summed up over the turns as exact
decimals: the sums after turn k stand for the first k turns. A conversation whose sums equal the sums after the same number of turns
of a longer one is dropped by an anti-join; of equal conversations the smallest conv_id stays. What stays is rendered, one
text per turn with its offset, so that no conversation, however long, has to fit into one row; the texts of a
conversation in order of its turns are its rendering.

Only DataFrame functions run. Prefixes and full conversations are reduced to distinct keys before the joins, so a
very common first turn or conversation is one row. Null text or role counts as empty (and unlike a missing turn); rows without a
conv_id are left out; null turns come first; equal turns are ordered by role and text; rows that repeat conversation,
turn, role and text count once; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from imputeflow.llm.shared import write_table

# Fixed values of the ChatML rendering.
START, END = "<|im_start|>", "<|im_end|>\n"


def rolling(turns: DataFrame) -> DataFrame:
    """conv_id, role, text, number of the turn (from 1), sums a and b up to it, and the conversation's length."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                        F.coalesce("text", F.lit("")).alias("text")).where("conv_id is not null").distinct()
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    numbered = rows.withColumn("number", F.row_number().over(order))
    hashes = [F.xxhash64(F.lit(k), "number", "role", "text").cast("decimal(20,0)") for k in range(2)]
    so_far = Window.partitionBy("conv_id").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    return numbered.select("conv_id", "role", "text", "number",
                           *[F.sum(h).over(so_far).alias(c) for h, c in zip(hashes, "ab", strict=True)])


def maximal(rolled: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that are no snapshot, with the number of equal ones."""
    last = rolled.groupBy("conv_id").agg(F.max(F.struct("number", "a", "b")).alias("m")).select(
        "conv_id", F.col("m.number").alias("n_turns"), "m.a", "m.b")
    whole = last.groupBy("n_turns", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_equal"))
    ends = last.select(F.col("conv_id").alias("c"), "n_turns")
    # a turn that is not its conversation's last ends a proper prefix
    inner = (rolled.select("conv_id", "number", "a", "b").join(ends, F.col("conv_id") == F.col("c"))
             .where("number < n_turns").select(F.col("number").alias("n_turns"), "a", "b").distinct())
    return whole.join(inner, ["n_turns", "a", "b"], "left_anti").select("conv_id", "n_turns", "n_equal")


def render(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_equal, turn_no, role, rendered, start: the turns of maximal conversations."""
    rolled, _ = write_table(rolling(turns), "turns")
    kept = maximal(rolled)
    text = F.concat(F.lit(START), "role", F.lit("\n"), "text", F.lit(END))
    before = Window.partitionBy("conv_id").orderBy("turn_no").rowsBetween(Window.unboundedPreceding, -1)
    return (rolled.join(kept, "conv_id").select("conv_id", "n_turns", "n_equal", F.col("number").alias("turn_no"), "role",
                                                text.alias("rendered"))
            .withColumn("start", F.coalesce(F.sum(F.length("rendered")).over(before), F.lit(0)).cast("long")))
