"""Best-fit packing of token sequences with certified numbers of bins (operator 1).

A text is encoded, an end id is added, and only what is longer than a sequence is cut. Pieces are dealt to groups of
bounded size and packed by best-fit decreasing in each (the fullest sequence that still has room). Dual-feasible
functions give a lower bound on the number of sequences of the same pieces: a function f with "sum of sizes <= 1 implies
sum of f <= 1" bounds it by the sum of f. A group whose number equals its bound is certified. Whatever the verdict,
sequences that are full stay. The pieces of the others go to the next round: there the groups with a gap exchange
pieces, and the certified ones pass on only their emptiest sequence, so that what each group leaves over meets what
others leave over. A round gets fewer groups than the one before as the number of open pieces falls; the rounds end when
one group held all open pieces, when no round saves a sequence any more, or after ``MAX_ROUNDS``.

Pieces travel as short rows, never texts or ids. Null text is empty (its one piece is the end id alone). Repeated rows
are packed each by itself; equal lengths are taken in the order of their digest; an empty table gives an empty result;
columns other than id and text are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imputeflow.llm.encoding import WordEncoder, encoder_for
from imputeflow.llm.shared import ranges, slices, write_table

GROUP_PIECES = 20_000
MAX_ROUNDS = 8
DUAL_STEPS = 40
PACKED = ["sequence_id", "offset"]


def pieces_of(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of each text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        encoder = encoder_for(vocabulary, WordEncoder)
        try:
            for batch in slices(batches):
                ids, counts = encoder.encode(batch.column("text"))
                ends = np.cumsum(counts)
                all_ids = np.insert(ids, ends, end_id).astype("<u4")
                counts = counts + 1
                n = -(-counts // capacity)
                piece = ranges(np.zeros(len(n), np.int64), n)
                owner = np.repeat(np.arange(len(n)), n)
                start = piece * capacity
                length = np.minimum(capacity, counts[owner] - start)
                a = (np.cumsum(counts) - counts)[owner] + start
                crc = [zlib.crc32(all_ids[i:j]) for i, j in zip(a.tolist(), (a + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").take(pa.array(owner)), "piece": pa.array(piece, pa.int32()),
                    "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array(crc, pa.int64())})
        finally:
            encoder.forget()

    return rows.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Bins that the sizes need at least: the best of three families of dual-feasible functions, in whole numbers."""
    if not len(sizes):
        return 0
    sizes, times = np.unique(sizes, return_counts=True)
    best = -(-int((sizes * times).sum()) // capacity)
    for k in range(1, DUAL_STEPS + 1):  # rounds (k + 1) x down to steps of 1 / k, but keeps whole multiples
        scaled = (k + 1) * sizes
        value = np.where(scaled % capacity == 0, sizes * k, scaled // capacity * capacity)  # in 1 / (k capacity)
        best = max(best, -(-int((value * times).sum()) // (k * capacity)))
    half = sizes[2 * sizes <= capacity]
    for e in np.unique(np.concatenate([half, [0]])).tolist():
        large, middle = sizes > capacity - e, (sizes >= e) & (sizes <= capacity - e)
        total = int(times[large].sum()) * capacity + int((sizes * times)[middle].sum())
        best = max(best, -(-total // capacity))
        if e:  # counts how many pieces of size e fit beside a large one
            room = capacity // e
            f = np.where(2 * sizes > capacity, 2 * (room - (capacity - sizes) // e),
                         np.where(2 * sizes == capacity, room, np.where(sizes >= e, 2 * (sizes // e), 0)))
            best = max(best, -(-int((f * times).sum()) // (2 * room)))
    return best


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each size, taken in the given order; the number of bins.

    ``open_rooms`` has bit r set where a bin with room r is open: its lowest bit from the size on is the best fit.
    """
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    by_room: dict[int, list[int]] = {}
    open_rooms, count = 0, 0
    for i, size in enumerate(sizes.tolist()):
        fits = open_rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            stack = by_room[room]
            b = stack.pop()
            if not stack:
                open_rooms ^= 1 << room
        else:
            b, room, count = count, capacity, count + 1
        bins[i], offsets[i] = b, capacity - room
        left = room - size
        if left:
            stack = by_room.setdefault(left, [])
            if not stack:
                open_rooms |= 1 << left
            stack.append(b)
    return bins, offsets, count


def pack_group(pdf: pd.DataFrame, capacity: int, round_no: int) -> pd.DataFrame:
    """Pack one group; ``open`` marks the pieces that go on to the next round."""
    pdf = pdf.sort_values(["length", "ids_crc32", "item"], ascending=[False, True, True], kind="stable")
    sizes = pdf["length"].to_numpy()
    bins, offsets, count = best_fit(sizes, capacity)
    fill = np.bincount(bins, weights=sizes, minlength=count).astype(np.int64)
    certified = count == lower_bound(sizes, capacity)
    passed_on = fill < capacity
    if certified:  # nothing to gain inside: only the emptiest sequence may still be saved with others'
        emptiest = int(np.argmin(fill))
        passed_on &= np.arange(count) == emptiest
    group = int(pdf["grp"].iloc[0])
    return pdf.assign(sequence_id=(np.int64(round_no) << 56) + (np.int64(group) << 24) + bins, offset=offsets,
                      open=passed_on[bins])


def _packer(capacity: int, round_no: int):
    return lambda pdf: pack_group(pdf, capacity, round_no)


def _group(n: int, seed: int):
    return F.pmod(F.xxhash64(F.col("item"), F.lit(seed)), F.lit(n)).cast("long")


def pack_pieces(pieces: DataFrame, capacity: int, group_pieces: int = GROUP_PIECES,
                max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Add sequence_id and offset to a table with lengths from 1 to ``capacity``."""
    names = pieces.columns
    held, _ = write_table(pieces.withColumn("item", F.monotonically_increasing_id()), "pieces")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema)
    schema = f"{kinds}, grp long, sequence_id long, offset long, open boolean"
    closed, before = [], None
    for round_no in range(max_rounds):
        n_open = held.count()
        groups = max(1, -(-n_open // group_pieces))
        last = round_no == max_rounds - 1

        packed, _ = write_table(held.withColumn("grp", _group(groups, round_no)).groupBy("grp")
                                          .applyInPandas(_packer(capacity, round_no), schema), "packed")
        bins = packed.where("open").agg(F.countDistinct("sequence_id")).first()[0]
        if last or groups == 1 or not bins or (before is not None and bins >= before):
            closed.append(packed.select(*names, *PACKED))
            break
        before = bins if groups > 1 else None
        closed.append(packed.where("not open").select(*names, *PACKED))
        held = packed.where("open").select(*names, "item")
    out = closed[0]
    for part in closed[1:]:
        out = out.unionByName(part)
    return out


def pack(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", capacity: int = 2048, end_id: int = 0,
         id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece."""
    return pack_pieces(pieces_of(docs, vocabulary, capacity, end_id, id_col, text_col), capacity, **limits)
