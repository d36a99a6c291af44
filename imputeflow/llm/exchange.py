"""Blocks of documents, and an exchange of keys between them.

A block is a run of rows as a compressed Arrow stream: it is joined and read again as one row of bounded size, from a
table bucketed by block, so joins by block don't move it. An exchange asks, for keys at places of blocks, which keys stand at more than one place. Inside a block equal keys are found
at once, and only one of them travels; keys are packed by group of a hash, so a very common key is one entry per block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imputeflow.llm.shared import slices, write_buckets, write_table

BLOCK_BYTES = 4 << 20
PACKED = "block long, grp long, keys binary, places binary"  # a negative group needs no answer
FOUND = "block long, places binary"


def pack_rows(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack_rows(content: bytes) -> pa.RecordBatch:
    table = pa.ipc.open_stream(content).read_all().combine_chunks()
    return table.to_batches()[0]


def make_blocks(docs: DataFrame, text_col: str, name: str, limit: int = BLOCK_BYTES) -> DataFrame:
    """(block, content): all rows and columns of the documents, in the shared folder."""
    def make(batches):
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 32
        waiting, size = [], 0

        def flush():
            nonlocal number, waiting, size
            rows = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            row = pa.RecordBatch.from_pydict({"block": pa.array([number], pa.int64()),
                                              "content": pa.array([pack_rows(rows)], pa.binary())})
            number, waiting, size = number + 1, [], 0
            return row

        for batch in slices(batches, text_col, limit):
            waiting.append(batch)
            size += batch.column(text_col).nbytes
            if size >= limit:
                yield flush()
        if waiting:
            yield flush()

    return write_buckets(docs.mapInArrow(make, "block long, content binary"), "block", name)


def each_block(blocks: DataFrame, work: Callable[[int, pa.RecordBatch, list[np.ndarray]], Iterator[pa.RecordBatch]],
               schema: str, answers: DataFrame | None = None) -> DataFrame:
    """Call ``work(number, rows, [answered places])`` for each block; ``answers`` has places by block."""
    if answers is None:
        rows = blocks.withColumn("places", F.array().cast("array<binary>"))
    else:
        rows = blocks.join(answers.groupBy("block").agg(F.collect_list("places").alias("places")), "block", "left")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                found = batch.column("places")[i].as_py() or []
                yield from work(batch.column("block")[i].as_py(), unpack_rows(batch.column("content")[i].as_buffer()),
                                [np.frombuffer(x, np.int32) for x in found])

    return rows.select("block", "content", "places").mapInArrow(run, schema)


def send(block: int, keys: np.ndarray, places: np.ndarray, groups: int) -> pa.RecordBatch:
    """Rows that leave a block. ``keys``: one or two columns of unsigned 64-bit integers.

    Places whose key repeats inside the block go out in a negative group; one place of each key goes on.
    """
    order = np.lexsort(keys.T[::-1])
    keys, places = keys[order], places[order]
    same = (keys[1:] == keys[:-1]).all(1)
    again = np.zeros(len(keys), bool)
    again[1:] |= same
    again[:-1] |= same
    first = np.ones(len(keys), bool)
    first[1:] = ~same
    own = places[again].astype(np.int32)
    keys, places = keys[first], places[first].astype(np.int32)
    group = (keys[:, 0] % np.uint64(groups)).astype(np.int64)
    by_group = np.argsort(group, kind="stable")
    keys, places, group = keys[by_group], places[by_group], group[by_group]
    cuts = np.flatnonzero(np.diff(group)) + 1
    starts = np.concatenate([[0], cuts]).astype(int) if len(group) else np.zeros(0, int)
    ends = np.concatenate([cuts, [len(group)]]).astype(int) if len(group) else starts
    numbers = group[starts].tolist()
    packed_keys = [keys[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    packed_places = [places[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    if len(own):
        numbers, packed_keys, packed_places = [-1 - block, *numbers], [b"", *packed_keys], [own.tobytes(), *packed_places]
    return pa.RecordBatch.from_pydict({
        "block": pa.array([block] * len(numbers), pa.int64()), "grp": pa.array(numbers, pa.int64()),
        "keys": pa.array(packed_keys, pa.binary()), "places": pa.array(packed_places, pa.binary())})


def shared_places(sent: DataFrame, width: int, name: str) -> DataFrame:
    """(block, places): all places whose key stands at more than one place of the whole table."""
    def match(table: pa.Table) -> pa.Table:
        if table["grp"][0].as_py() < 0:
            return table.select(["block", "places"])
        blocks = table["block"].to_numpy()
        places = [np.frombuffer(x, np.int32) for x in table["places"].to_pylist()]
        keys = np.frombuffer(b"".join(table["keys"].to_pylist()), np.uint64).reshape(-1, width)
        owner = np.repeat(np.arange(len(places)), [len(x) for x in places])
        order = np.lexsort(keys.T[::-1])
        ordered = keys[order]
        same = (ordered[1:] == ordered[:-1]).all(1)
        hit = np.zeros(len(keys), bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        place, owner = np.concatenate(places)[hit], owner[hit]
        cuts = np.flatnonzero(np.diff(owner)) + 1
        parts = np.split(place, cuts) if len(place) else []
        return pa.table({"block": pa.array([blocks[owner[c]] for c in [0, *cuts.tolist()]] if parts else [], pa.int64()),
                         "places": pa.array([p.tobytes() for p in parts], pa.binary())})

    return write_table(sent.groupBy("grp").applyInArrow(match, FOUND), name)[0]


def window_hashes(h: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """Two independent 64-bit hashes of the words h[place:place + size]: polynomials with odd bases modulo 2^64."""
    out = np.empty((len(places), 2), np.uint64)
    one = np.uint64(1)
    for k, base in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
        inverse = pow(base, -1, 1 << 64)
        power = np.multiply.accumulate(np.concatenate([[one], np.full(len(h), base, np.uint64)]), dtype=np.uint64)
        back = np.multiply.accumulate(np.concatenate([[one], np.full(len(h), inverse, np.uint64)]), dtype=np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((h ^ (h >> np.uint64(29 + k))) * power[:-1],
                                                                 dtype=np.uint64)])
        out[:, k] = (sums[places + size] - sums[places]) * back[places]
    return out
