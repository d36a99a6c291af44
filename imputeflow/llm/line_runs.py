"""Lines that other documents hold already, removed (operator 12).

Lines are known by 128 bits of hashes of their keys: the line without white space at its ends, A-Z lower-cased. What has been seen is kept as
runs: tables of (hash, first document), bucketed and sorted by the hash. A batch of documents reduces its lines to distinct hashes,
meets the runs in a merge join by the bucketed hash (the runs are not moved), and becomes a run of its own, in which
only hashes that no older run holds count. Runs have levels: as soon as a level holds ``FANOUT`` runs they are merged into one of the next
level, so the number of runs grows with the logarithm of the number of batches. Only DataFrame functions run.

Batches come in ascending order of doc_id, so the first holder of a line is the smallest doc_id. A hash that a ``1 / HOT``-th or more
of a batch's lines share is answered by a broadcast table, which so has ``HOT`` rows at most; all other lines go by their hash.
A document's dropped lines come back as a list of places, and its text is put together from the stretches between them.

Null or empty text is one empty line. Null doc_ids count as one document behind all others. Rows that repeat a doc_id are one document:
what one of them holds, the others hold too. Equal lines inside a document stay together or go together. Texts are split as a whole,
whatever their length (a text and its lines have to fit into one row). An empty table gives an empty result. Other columns are
kept by ``drop_repeated_lines`` and are not looked at; columns may have any names but those that it adds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from imputeflow.llm.shared import drop_table, shared_path, write_table

MIN_CHARS = 10
BATCHES = 6
FANOUT = 3
HOT = 1024
# The white space that is stripped, and the letters that are lower-cased.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _hash(column, part: int):
    return F.xxhash64(F.lit(part), column)


def lines_of(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(batch, doc_id, own, place, h1, h2) of the lines with long enough keys; ``own`` tells texts of one doc_id apart."""
    text = F.coalesce("text", F.lit(""))
    split = docs.select("batch", "doc_id", F.xxhash64("text").alias("own"), F.posexplode(F.split(text, "\n", -1)))
    key = F.translate(F.btrim("col", F.lit(BLANKS)), UPPER, LOWER)
    keyed = split.select("batch", "doc_id", "own", F.col("pos").alias("place"), key.alias("key"))
    return keyed.where(F.length("key") >= min_chars).select(
        "batch", "doc_id", "own", "place", _hash("key", 1).alias("h1"), _hash("key", 2).alias("h2"))


class LineRuns:
    """The levelled runs of all batches so far."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                           2 * spark.sparkContext.defaultParallelism)
        self.levels: list[list[tuple[str, str]]] = []

    def _write(self, rows: DataFrame) -> tuple[str, str]:
        path = shared_path(self.spark, "run")
        table = path.rsplit("/", 1)[1].replace("-", "_")
        (rows.repartition(self.buckets, "h1", "h2").write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
         .option("path", path).saveAsTable(table))
        return table, path

    def _run(self, table: str) -> DataFrame:
        """The hashes that are first held in this run."""
        return self.spark.table(table).where("not known").select("h1", "h2", "first")

    def _delete(self, run: tuple[str, str]) -> None:
        self.spark.sql(f"DROP TABLE {run[0]}")
        drop_table(self.spark, run[1])

    def _push(self, run: tuple[str, str], level: int = 0) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) < self.fanout:
            return
        full = self.levels[level]
        rows = self._run(full[0][0])
        for table, _ in full[1:]:
            rows = rows.union(self._run(table))
        merged = self._write(rows.withColumn("known", F.lit(False)))
        self.levels[level] = []
        for old in full:
            self._delete(old)
        self._push(merged, level + 1)

    def add(self, lines: DataFrame) -> DataFrame:
        """(doc_id, own, place) of the batch's lines that an earlier document holds; the batch becomes a run."""
        first = F.min("doc_id")
        found = lines.groupBy("h1", "h2").agg(
            first.alias("own_first"), F.count("*").alias("n"),
            ((F.max("doc_id") > first) | ((F.count("doc_id") < F.count("*")) & first.isNotNull())).alias("spread"))
        known = F.lit(False)
        holder = F.lit(None).cast("long")
        for i, (table, _) in enumerate(run for level in self.levels for run in level):
            old = self._run(table).select("h1", "h2", F.col("first").alias(f"f{i}"), F.lit(True).alias(f"in{i}"))
            found = found.join(old.hint("merge"), ["h1", "h2"], "left")
            known, holder = known | F.coalesce(f"in{i}", F.lit(False)), F.coalesce(holder, f"f{i}")
        met = found.select("h1", "h2", F.when(known, holder).otherwise(F.col("own_first")).alias("first"), "n",
                           F.coalesce("spread", F.lit(False)).alias("spread"), known.alias("known"))
        run = self._write(met)
        shared = self.spark.table(run[0]).where("known or spread").select("h1", "h2", "first", "n")
        total = self.spark.table(run[0]).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        hot = shared.where(F.col("n") * HOT >= total)
        rest = shared.where(F.col("n") * HOT < total)
        asked = lines.join(F.broadcast(hot.select("h1", "h2", F.col("first").alias("hot_first"), F.lit(True).alias("hot"))),
                           ["h1", "h2"], "left")
        at_once = asked.where("hot and not (doc_id <=> hot_first)").select("doc_id", "own", "place")
        by_hash = asked.where("hot is null").join(rest, ["h1", "h2"]).where("not (doc_id <=> first)").select(
            "doc_id", "own", "place")
        dropped, self.last_path = write_table(at_once.union(by_hash), "dropped")
        self._push(run)
        return dropped

    def close(self) -> None:
        """Delete the runs; what ``add`` returned stays."""
        for level in self.levels:
            for run in level:
                self._delete(run)
        self.levels = []


def _batched(docs: DataFrame, batches: int) -> DataFrame:
    """Adds ``batch``: ranges of doc_id of about equal numbers of rows, null ids in the last one."""
    cuts = docs.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000)).first()[0] or []
    above = [(F.col("doc_id") > F.lit(c)).cast("int") for c in sorted(set(cuts))]
    place = sum(above[1:], above[0]) if above else F.lit(0)
    return docs.withColumn("batch", F.coalesce(place, F.lit(len(above))))


def dropped_places(docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, own, dropped): for each text that loses lines, their places in order."""
    spark = docs.sparkSession
    lines = lines_of(_batched(docs.select("doc_id", "text"), max(2, batches)), min_chars)
    path = shared_path(spark, "lines")
    lines.write.partitionBy("batch").parquet(path)
    runs, found = LineRuns(spark, fanout), None
    table = spark.read.schema(lines.schema).parquet(path)
    for b in range(max(2, batches)):
        new = runs.add(table.where(F.col("batch") == b).drop("batch"))
        found = new if found is None else found.union(new)
    runs.close()
    drop_table(spark, path)
    return found.groupBy("doc_id", "own").agg(F.sort_array(F.collect_set("place")).alias("dropped"))


def drop_repeated_lines(docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT, min_chars: int = MIN_CHARS,
                        id_col: str = "doc_id", text_col: str = "text", kept_col: str = "kept_text") -> DataFrame:
    """All columns of the rows, with the kept text, n_lines (before) and n_dropped."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    places = dropped_places(own, batches, fanout, min_chars).select(
        F.col("doc_id").alias("__id"), F.col("own").alias("__text"), F.col("dropped").alias("__dropped"))
    met = docs.join(places, F.col(id_col).cast("long").eqNullSafe(F.col("__id"))
                    & (F.xxhash64(F.col(text_col).cast("string")) == F.col("__text")), "left")
    lines = F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\n", -1)
    gone = F.col("__dropped")
    # the stretches between dropped lines: from behind the one before to this one
    stops = F.concat(gone, F.array(F.size("__lines")))
    starts = F.concat(F.array(F.lit(0)), F.transform(gone, lambda p: p + 1))
    stretches = F.flatten(F.zip_with(starts, stops, lambda a, z: F.slice("__lines", a + 1, z - a)))
    kept = F.when(gone.isNull(), F.coalesce(F.col(text_col).cast("string"), F.lit(""))).otherwise(
        F.array_join(stretches, "\n"))
    return (met.withColumn("__lines", lines)
            .withColumns({kept_col: kept, "n_lines": F.size("__lines").cast("long"),
                          "n_dropped": F.coalesce(F.size("__dropped"), F.lit(0)).cast("long")})
            .drop("__id", "__text", "__dropped", "__lines"))
