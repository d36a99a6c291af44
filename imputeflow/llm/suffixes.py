"""Repeated passages by sparse suffix arrays (operator 9).

Of the suffixes of all texts only those at content-selected places are kept: each window of ``LENGTH`` words picks, among its
first LENGTH - PREFIX + 1 places, the one whose GRAM words hash lowest, so equal windows pick equal places and suffixes
picked by equal windows agree for at least PREFIX words. A suffix travels as the names (hashes) of three successive runs:
its first PREFIX words, the words after them up to LENGTH, and the LENGTH - PREFIX words before it. Sorted by these
names, equal beginnings are neighbours. A suffix whose neighbour agrees in all three names is matched to the
full reach of every window that picked it. One that only agrees in its first words is not extended word for word: the
windows around it are regrouped by 128 bits of hashes in the exchange of operator 2, so every repeated window is found and no other.

The result has a row for each document with words inside a window that starts at another place too (same document
included): its number of words, how many are covered, and the covered spans. Null text has no words; texts
shorter than a window have no passage; repeated rows repeat every window; an empty table gives an empty result; columns
other than id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imputeflow.llm.exchange import FOUND, each_block, make_blocks, send, shared_places, window_hashes
from imputeflow.llm.shared import mix, run_sums, write_table
from imputeflow.llm.shingles import word_hashes

LENGTH = 50
PREFIX = 30
GRAM = 8
BLOCKS_IN_GROUP = 4
SUFFIXES = "block long, grp long, keys binary, places binary"


def picks(h: np.ndarray, offsets: np.ndarray, length: int, prefix: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of each window and the place it picks."""
    inside = np.arange(len(h)) + length <= np.repeat(offsets[1:], np.diff(offsets))
    starts = np.flatnonzero(inside)
    if not len(starts):
        return starts, starts
    places = np.arange(len(h) - gram + 1)
    order = np.argsort(mix(window_hashes(h, places, gram)[:, 0]), kind="stable")
    rank = np.empty(len(places), np.int64)
    rank[order] = places
    # least rank of the first length - prefix + 1 places of a window, from two overlapping ranges of a power of two
    span, width, table = length - prefix + 1, 1, rank
    while 2 * width <= span:
        table = np.minimum(table[:-width], table[width:])
        width *= 2
    return starts, order[np.minimum(table[starts], table[starts + span - width])]


def _names(h: np.ndarray, offsets: np.ndarray, places: np.ndarray, length: int, prefix: int,
           block: int) -> np.ndarray:
    """Names of the suffixes: the first words, the words after them, the words before; unique where a text ends."""
    doc = np.searchsorted(offsets, places, "right") - 1
    first = window_hashes(h, places, prefix)
    reach = length - prefix
    lone = mix(mix(np.full(len(places), block, np.uint64)) + places.astype(np.uint64))
    out = np.stack([mix(first[:, 0]) ^ first[:, 1], lone, lone ^ np.uint64(1)], 1)
    after = places + length <= offsets[1:][doc]
    before = places - reach >= offsets[:-1][doc]
    x = window_hashes(h, places[after] + prefix, reach)
    out[after, 1] = mix(x[:, 0]) ^ x[:, 1]
    x = window_hashes(h, places[before] - reach, reach)
    out[before, 2] = mix(x[:, 0]) ^ x[:, 1]
    return out


def _neighbours(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which suffixes begin like a neighbour in suffix order, and what is known of them.

    Bit 1: a neighbour agrees in all three names. Bit 0: windows have to be compared, because a suffix with
    the same beginning (perhaps this one) has no such neighbour.
    """
    order = np.lexsort(keys.T[::-1])
    ordered = keys[order]
    alike = np.zeros((2, len(keys)), bool)
    for row, same in ((0, ordered[1:, 0] == ordered[:-1, 0]), (1, (ordered[1:] == ordered[:-1]).all(1))):
        alike[row, 1:] |= same
        alike[row, :-1] |= same
    run = np.concatenate([[0], np.cumsum(ordered[1:, 0] != ordered[:-1, 0])]) if len(keys) else order
    open_run = np.bincount(run, weights=~alike[1]) > 0 if len(keys) else alike[0]
    begins, state = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    begins[order], state[order] = alike[0], 2 * alike[1] + open_run[run]
    return begins, state


def _match_suffixes(sent: DataFrame) -> DataFrame:
    """(block, places): 4 * place + state for each suffix that begins like another one."""
    def match(table: pa.Table) -> pa.Table:
        if table["grp"][0].as_py() < 0:
            return table.select(["block", "places"])
        blocks = table["block"].to_numpy()
        places = [np.frombuffer(x, np.int32) for x in table["places"].to_pylist()]
        keys = np.frombuffer(b"".join(table["keys"].to_pylist()), np.uint64).reshape(-1, 3)
        owner = np.repeat(np.arange(len(places)), [len(x) for x in places])
        begins, state = _neighbours(keys)
        coded = (4 * np.concatenate(places) + state)[begins].astype(np.int32)
        owner = owner[begins]
        cuts = np.flatnonzero(np.diff(owner)) + 1
        parts = np.split(coded, cuts) if len(coded) else []
        return pa.table({"block": pa.array([blocks[owner[c]] for c in [0, *cuts.tolist()]] if parts else [], pa.int64()),
                         "places": pa.array([p.tobytes() for p in parts], pa.binary())})

    return write_table(sent.groupBy("grp").applyInArrow(match, FOUND), "suffixes")[0]


def repeated_passages(docs: DataFrame, length: int = LENGTH, prefix: int = PREFIX, gram: int = GRAM,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_repeated, spans (word ranges [from, to)) of each document with repeated passages."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = make_blocks(rows, "text", "blocks")
    groups = max(16, -(-blocks.count() // BLOCKS_IN_GROUP))

    def suffixes(number, batch, _):
        h, offsets = word_hashes(batch.column("text"))
        place = np.unique(picks(h, offsets, length, prefix, gram)[1])
        if not len(place):
            return
        keys = _names(h, offsets, place, length, prefix, number)
        begins, state = _neighbours(keys)
        # matched inside the block: known at once. Equal suffixes go on as one; of those that only begin alike all go on
        own = (4 * place + state)[begins].astype(np.int32)
        _, first = np.unique(keys, axis=0, return_index=True)
        keys, place = keys[first], place[first]
        group = (keys[:, 0] % np.uint64(groups)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        cuts = np.flatnonzero(np.diff(group[order])) + 1
        parts = np.split(order, cuts)
        yield pa.RecordBatch.from_pydict({
            "block": pa.array([number] * (len(parts) + 1), pa.int64()),
            "grp": pa.array([-1 - number, *[int(group[x[0]]) for x in parts]], pa.int64()),
            "keys": pa.array([b"", *[keys[x].tobytes() for x in parts]], pa.binary()),
            "places": pa.array([own.tobytes(), *[place[x].astype(np.int32).tobytes() for x in parts]], pa.binary())})

    matched = _match_suffixes(each_block(blocks, suffixes, SUFFIXES))

    def known(h, offsets, answers):
        """Starts of windows, which of them are matched in full, and which take part in the comparison."""
        starts, place = picks(h, offsets, length, prefix, gram)
        state = np.zeros(len(h) + 1, np.int8)
        for coded in answers:
            np.bitwise_or.at(state, coded >> 2, (coded & 3).astype(np.int8))
        return starts, (state[place] & 2) > 0, (state[place] & 1) > 0

    def extend(number, batch, answers):
        h, offsets = word_hashes(batch.column("text"))
        starts, _, compared = known(h, offsets, answers)
        at = starts[compared]
        yield send(number, window_hashes(h, at, length), at, 4 * groups)

    windows = shared_places(each_block(blocks, extend, SUFFIXES, matched), 2, "windows")

    both = matched.withColumn("kind", F.lit(0)).unionByName(windows.withColumn("kind", F.lit(1))).select(
        "block", F.concat(F.when(F.col("kind") == 0, F.unhex(F.lit("00000000"))).otherwise(F.unhex(F.lit("01000000"))),
                          "places").alias("places"))

    def cover(number, batch, answers):
        h, offsets = word_hashes(batch.column("text"))
        starts, full, _ = known(h, offsets, [x[1:] for x in answers if x[0] == 0])
        change = np.zeros(len(h) + 1, np.int64)
        for at in [starts[full], *[x[1:] for x in answers if x[0] == 1]]:
            np.add.at(change, at, 1)
            np.add.at(change, at + length, -1)
        covered = np.cumsum(change[:-1]) > 0
        n = run_sums(covered, offsets)
        # spans: where cover begins and ends, cut at the ends of texts
        edge = np.zeros(len(h) + 1, bool)
        edge[offsets] = True
        begin = np.flatnonzero(covered & (edge[:-1] | ~np.append([False], covered[:-1])))
        end = np.flatnonzero(covered & (edge[1:] | ~np.append(covered[1:], [False]))) + 1
        doc = np.searchsorted(offsets, begin, "right") - 1
        base = offsets[:-1][doc]
        spans = pa.StructArray.from_arrays([pa.array(begin - base, pa.int64()), pa.array(end - base, pa.int64())],
                                           ["from", "to"])
        per_doc = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(n)))])
        out = pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"), "n_words": pa.array(np.diff(offsets)), "n_repeated": pa.array(n),
            "spans": pa.ListArray.from_arrays(pa.array(per_doc, pa.int32()), spans)})
        yield out.filter(pa.array(n > 0))

    return each_block(blocks, cover, "doc_id long, n_words long, n_repeated long, "
                                     "spans array<struct<from:long,to:long>>", both)
