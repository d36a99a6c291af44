"""Quality rules: statistics of each text, and an isolation forest on them (operator 7).

The statistics of a text come from one pass over its words, lines and bytes. The forest isolates points by random
splits: a tree is grown on a small random sample, and the expected length of a document's path over all trees tells how
easily it is set apart. The trees are fitted on a bounded sample of labelled rows (``SAMPLE_ROWS``, chosen by a
hash of the row), once for each set of rates; the set whose scores tell most of the sample's bad rows from the good ones
is used. The threshold comes from the scores of all labelled rows: among the cuts that reject at most
``GOOD_LOSS`` of the rows labelled good, the one that rejects most rows labelled bad beyond the good ones; without
labels of either kind, or where no cut rejects a larger share of bad than of good, nothing but the base rules rejects.

Null text has no words and fails the base rules. Repeated rows give repeated results; equal statistics get equal
verdicts; null or unmatched labels are not used; an empty table gives an empty result; only the id and text columns (and
doc_id and quality of the labels) are read.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imputeflow.llm.shared import list_offsets, run_sums, slices, words_of, write_table

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
TREES = 100
TREE_ROWS = 256
SAMPLE_ROWS = 8_000
GOOD_LOSS = 0.002
SCORE_BINS = 10_000
SLICE = 3 << 20  # bytes of text whose words are worked on at once
SEED = 7
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"


def repeated_in_group(groups: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the same key stands elsewhere in the same group."""
    order = np.lexsort((keys, groups))
    same = (groups[order][1:] == groups[order][:-1]) & (keys[order][1:] == keys[order][:-1])
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """The base counts of each text."""
    texts = pc.fill_null(texts, "")
    words, offsets = words_of(texts)
    codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.uint64)
    n_words = np.diff(offsets)
    owner = np.repeat(np.arange(len(n_words)), n_words)
    repeat = np.zeros(len(codes), bool)
    if len(codes) > 2:
        inside = owner[2:] == owner[:-2]  # windows of three words of one text
        at = np.flatnonzero(inside)
        # exact keys: name the pairs, then the pair and the third word
        _, pair = np.unique(codes[:-1] << np.uint64(32) | codes[1:], return_inverse=True)
        key = pair[at].astype(np.uint64) << np.uint64(32) | codes[at + 2]
        twice = at[repeated_in_group(owner[at], key)]
        for k in range(3):
            repeat[twice + k] = True
    raw = np.frombuffer(b"".join(pc.cast(texts, pa.binary()).to_pylist()), np.uint8)
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)])
    starts_point = (np.arange(256) & 0xC0) != 0x80
    starts_point[list(SPACES)] = False
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True

    lists = pc.split_pattern(texts, "\n")
    lines = lists.flatten().dictionary_encode()
    has_word = pc.match_substring_regex(lines.dictionary, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    line_codes, line_offsets = lines.indices.to_numpy(zero_copy_only=False), list_offsets(lists)
    line_owner = np.repeat(np.arange(len(lists)), np.diff(line_offsets))
    real = has_word[line_codes]
    distinct = np.unique(line_owner[real] << np.int64(32) | line_codes[real])
    n_lines = np.bincount(line_owner[real], minlength=len(lists))
    return {"n_words": n_words, "word_chars": run_sums(starts_point[raw], ends), "n_symbols": run_sums(symbol[raw], ends),
            "n_dup_lines": n_lines - np.bincount(distinct >> 32, minlength=len(lists)),
            "n_repeat_words": run_sums(repeat, offsets)}


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """Points of the forest: rates that don't depend on a text's length."""
    words = np.maximum(s["n_words"], 1)
    return np.stack([s["word_chars"] / words, s["n_symbols"] / np.maximum(s["word_chars"], 1),
                     s["n_dup_lines"] / words, s["n_repeat_words"] / words], 1).astype(float)


class IsolationForest:
    """Trees as arrays: column and value of each split, and the path length where a leaf ends."""

    def __init__(self, points: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = SEED):
        random = np.random.default_rng(seed)
        rows = min(rows, len(points))
        self.depth = max(1, int(np.ceil(np.log2(max(rows, 2)))))
        size = 2 ** (self.depth + 1)
        self.column = np.zeros((trees, size), np.int8)
        self.value = np.full((trees, size), np.inf)
        self.length = np.zeros((trees, size))
        self.usual = self.mean_path(rows)
        for t in range(trees):
            self._grow(t, 1, points[random.choice(len(points), rows, replace=False)], 0, random)

    @staticmethod
    def mean_path(n: int) -> float:
        """Mean path of an unsuccessful search in a random tree of n points."""
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n

    def _grow(self, tree: int, node: int, points: np.ndarray, depth: int, random) -> None:
        spread = np.flatnonzero(np.ptp(points, 0) > 0) if len(points) > 1 else []
        if depth == self.depth or not len(spread):
            # a leaf: everything goes left from here on, carrying this length
            while node < self.column.shape[1]:
                self.length[tree, node] = depth + self.mean_path(len(points))
                node *= 2
            return
        c = random.choice(spread)
        cut = random.uniform(points[:, c].min(), points[:, c].max())
        self.column[tree, node], self.value[tree, node] = c, cut
        left = points[:, c] <= cut
        self._grow(tree, 2 * node, points[left], depth + 1, random)
        self._grow(tree, 2 * node + 1, points[~left], depth + 1, random)

    def scores(self, points: np.ndarray) -> np.ndarray:
        """Anomaly score in (0, 1]: near 1 where few splits set a point apart."""
        total = np.zeros(len(points))
        lines = np.arange(len(points))
        for column, value, length in zip(self.column, self.value, self.length, strict=True):
            node = np.ones(len(points), np.int64)
            for _ in range(self.depth):
                node = 2 * node + (points[lines, column[node]] > value[node])
            total += length[node]
        return 2.0 ** (-total / len(self.column) / max(self.usual, 1e-9))


class QualityModel:
    """Base rules, forest and threshold; small, and sent to the tasks with the function that uses it."""

    def __init__(self, forest: IsolationForest | None = None, rates: tuple[int, ...] = (), threshold: float = np.inf):
        self.forest, self.rates, self.threshold = forest, list(rates), threshold

    def score(self, s: dict[str, np.ndarray]) -> np.ndarray:
        return self.forest.scores(features(s)[:, self.rates]) if self.forest else np.zeros(len(s["n_words"]))

    def kept(self, s: dict[str, np.ndarray]) -> np.ndarray:
        return ~base_failed(s) & ~(self.score(s) >= self.threshold)


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the base counts of each row; one pass over the texts, no shuffle."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in slices(batches, limit=SLICE):
            s = statistics(batch.column("text"))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"),
                                              **{c: pa.array(s[c], pa.int64()) for c in COUNTS}})

    return rows.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


def fit(stats: DataFrame, labels: DataFrame) -> QualityModel:
    """Forest from a bounded sample of labelled rows that pass the base rules, threshold from all of them."""
    good = labels.select(F.col("doc_id").alias("label_id"), F.col("quality").cast("int").alias("quality")).where(
        "label_id is not null and quality in (0, 1)").groupBy("label_id").agg(F.max("quality").alias("quality"))
    passed = f"n_words >= {MIN_WORDS} and 100 * n_repeat_words <= {MAX_REPEAT_PERCENT} * n_words"
    labelled = stats.where(passed).join(good, F.col("doc_id") == F.col("label_id")).select("quality", *COUNTS)
    order = F.xxhash64(*[F.col(c) for c in COUNTS], "quality")
    sample = labelled.orderBy(order, *COUNTS).limit(SAMPLE_ROWS).toPandas()
    if sample["quality"].nunique() < 2:
        return QualityModel()
    points, bad = features({c: sample[c].to_numpy() for c in COUNTS}), sample["quality"].to_numpy() == 0
    best = (0.0, QualityModel())
    for size in range(1, points.shape[1] + 1):
        for rates in itertools.combinations(range(points.shape[1]), size):
            model = QualityModel(IsolationForest(points[:, rates]), rates)
            bins = _bins(model.forest.scores(points[:, rates]))
            gain, _ = _best_cut(np.stack([np.bincount(bins[m], minlength=SCORE_BINS) for m in (bad, ~bad)]))
            best = max(best, (gain, model), key=lambda x: x[0])
    model = best[1]
    if model.forest is None:
        return model

    def score(batches):
        for batch in batches:
            s = {c: batch.column(c).to_numpy() for c in COUNTS}
            yield pa.RecordBatch.from_pydict({"bin": pa.array(_bins(model.score(s))),
                                              "quality": batch.column("quality")})

    table = np.zeros((2, SCORE_BINS), np.int64)
    for r in labelled.mapInArrow(score, "bin long, quality int").groupBy("bin", "quality").count().collect():
        table[r["quality"], r["bin"]] += r["count"]
    gain, cut = _best_cut(table)
    model.threshold = cut / SCORE_BINS if gain > 0 else np.inf
    return model


def _bins(scores: np.ndarray) -> np.ndarray:
    return np.minimum((scores * SCORE_BINS).astype(np.int64), SCORE_BINS - 1)


def _best_cut(table: np.ndarray) -> tuple[float, int]:
    """Rows of (bad, good) by bin of the score: share of bad beyond good from the best bin on, and that bin."""
    above = np.cumsum(table[:, ::-1], 1)[:, ::-1] / np.maximum(table.sum(1, keepdims=True), 1)
    gain = np.where(above[1] <= GOOD_LOSS, above[0] - above[1], 0.0)
    cut = len(gain) - 1 - int(np.argmax(gain[::-1]))
    return float(gain[cut]), cut


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts, base_failed, score and kept for each row."""
    stats, _ = write_table(with_statistics(docs, id_col, text_col), "quality")
    model = fit(stats, labels)

    def run(batches):
        for batch in batches:
            s = {c: batch.column(c).to_numpy() for c in COUNTS}
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(base_failed(s)), pa.array(model.score(s)),
                                              pa.array(model.kept(s))],
                                             [*batch.schema.names, "base_failed", "score", "kept"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stats.schema)
    return stats.mapInArrow(run, f"{schema}, base_failed boolean, score double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of the documents that the rules and the forest keep, with all their columns."""
    stats, _ = write_table(with_statistics(docs, id_col, text_col), "quality")
    model = fit(stats, labels)

    rows = docs.withColumn(text_col, F.col(text_col).cast("string"))

    def keep(batches):
        for batch in slices(batches, text_col, SLICE):
            yield batch.filter(pa.array(model.kept(statistics(batch.column(text_col)))))

    return rows.mapInArrow(keep, rows.schema)
