"""Removal of repeated passages by recompression (operator 2).

Words are named by hashes, and so are, in rounds, runs of equal symbols and pairs of neighbours: a coin from the symbol's name
and the round puts each symbol left or right, and a left symbol followed by a right one becomes a new symbol named by the
two. Names depend on content alone, so they are the same wherever a passage stands, and inside a repeated window all symbols
agree but those whose making looked beyond it. What the making looked at is tracked as a span of words. Each window
picks, among the high-level symbols whose span lies inside it, the one with the least name; equal windows pick equal
symbols. Spark counts the picked symbols over the corpus. A window whose symbol stands nowhere else is unique; the others
(and the few without such a symbol) are verified by 128 bits of hashes of the words themselves. Words covered by a
window that starts at another place too are removed, all occurrences alike.

Null text has no words and stays null; texts without a full window stay whole (words joined by single spaces); repeated rows
repeat every window and lose it; an empty table gives an empty result. All columns of the rows are kept; those of the
result (n_words, n_removed and the kept text) replace columns of the same names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imputeflow.llm.exchange import PACKED, each_block, make_blocks, send, shared_places, window_hashes
from imputeflow.llm.shared import mix, run_sums, words_of
from imputeflow.llm.shingles import word_hashes

WINDOW = 35
ROUNDS = 5
BLOCKS_IN_GROUP = 4


def symbols(h: np.ndarray, offsets: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Name of each symbol after the rounds, and the span of words its making looked at, [from, to).

    Both ends of the spans never fall from one symbol to the next. A span that looked at a text's end goes beyond it.
    """
    sizes = np.diff(offsets)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    starts, ends = offsets[:-1][doc], offsets[1:][doc]  # of the text of each word
    # runs of one word: whether a word begins or ends a run depends on the words beside it
    joined = np.zeros(len(h), bool)
    joined[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    at = np.flatnonzero(~joined)
    to = np.append(at[1:], len(h)) - 1
    length = (to - at + 1).astype(np.uint64)
    name = np.where(length > 1, mix(h[at] + length * np.uint64(0x9E3779B97F4A7C15)), h[at])
    low, high = at - 1, to + 2
    doc, starts, ends = doc[at], starts[at], ends[at]
    for r in range(1, rounds + 1):
        right = (mix(name + np.uint64(r)) >> np.uint64(63)).astype(bool)
        follows = np.zeros(len(name), bool)  # the next symbol is of the same text
        follows[:-1] = doc[1:] == doc[:-1]
        pair = np.zeros(len(name), bool)
        pair[:-1] = ~right[:-1] & right[1:] & follows[:-1]
        second = np.zeros(len(name), bool)
        second[1:] = pair[:-1]
        next_high = np.append(high[1:], 0)
        before_low = np.append([0], low[:-1]).astype(low.dtype)
        led = np.zeros(len(name), bool)
        led[1:] = follows[:-1]
        new_high = np.where(pair | ~right & follows, next_high, np.where(right, high, ends + 1))
        new_low = np.where(right & ~second, np.where(led, before_low, starts - 1), low)
        new_name = name.copy()
        i = np.flatnonzero(pair)
        new_name[i] = mix(mix(name[i] + np.uint64(r << 8)) ^ name[i + 1] * np.uint64(0xC2B2AE3D27D4EB4F))
        keep = ~second
        name, low, high = new_name[keep], new_low[keep], new_high[keep]
        doc, starts, ends = doc[keep], starts[keep], ends[keep]
    return name, low, high


def picked(h: np.ndarray, offsets: np.ndarray, window: int, rounds: int):
    """Start of each window, the symbol it picks (-1: none), and the symbols' names."""
    sizes = np.diff(offsets)
    inside = np.arange(len(h)) + window <= np.repeat(offsets[1:], sizes)
    starts = np.flatnonzero(inside)
    if not len(starts):
        return starts, starts, h[:0]
    name, low, high = symbols(h, offsets, rounds)
    a = np.searchsorted(low, starts, "left")
    b = np.searchsorted(high, starts + window, "right") - 1
    rank = np.empty(len(name), np.int64)
    by_rank = np.argsort(mix(name ^ np.uint64(0x94D049BB133111EB)), kind="stable")
    rank[by_rank] = np.arange(len(name))
    size = b - a + 1
    choice = np.full(len(starts), -1)
    table, width = rank, 1
    while True:  # least rank in [a, b] from two overlapping ranges of a power of two
        use = np.flatnonzero((size >= width) & (size < 2 * width))
        if len(use):
            choice[use] = by_rank[np.minimum(table[a[use]], table[b[use] - width + 1])]
        if size.max() < 2 * width:
            return starts, choice, name
        table = np.minimum(table[:-width], table[width:]) if len(table) > width else table
        width *= 2


def remove_repeats(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS, text_col: str = "text",
                   kept_col: str | None = None, counts: bool = True) -> DataFrame:
    """The rows with their kept words in ``kept_col`` (the text column itself unless named), and n_words, n_removed."""
    kept_col = kept_col or text_col
    docs = docs.withColumn(text_col, F.col(text_col).cast("string"))
    blocks = make_blocks(docs, text_col, "blocks")
    groups = max(16, -(-blocks.count() // BLOCKS_IN_GROUP))

    def ask(number, rows, _):
        h, offsets = word_hashes(rows.column(text_col))
        _, choice, name = picked(h, offsets, window, rounds)
        chosen = np.unique(choice[choice >= 0])
        yield send(number, mix(name[chosen])[:, None], chosen, groups)

    symbols_shared = shared_places(each_block(blocks, ask, PACKED), 1, "symbols")

    def verify(number, rows, answers):
        h, offsets = word_hashes(rows.column(text_col))
        starts, choice, name = picked(h, offsets, window, rounds)
        shared = np.zeros(len(name) + 1, bool)
        for places in answers:
            shared[places] = True
        shared[-1] = True  # no symbol picked: always verified
        starts = starts[shared[choice]]
        yield send(number, window_hashes(h, starts, window), starts, 4 * groups)

    windows = shared_places(each_block(blocks, verify, PACKED, symbols_shared), 2, "windows")
    extra = [c for c in docs.columns if c not in ((kept_col, "n_words", "n_removed") if counts else (kept_col,))]

    def cut(number, rows, answers):
        texts = rows.column(text_col)
        words, offsets = words_of(texts)
        change = np.zeros(len(words) + 1, np.int64)
        for places in answers:
            np.add.at(change, places, 1)
            np.add.at(change, places + window, -1)
        gone = np.cumsum(change[:-1]) > 0
        removed = run_sums(gone, offsets)
        kept_words = words.filter(pa.array(~gone))
        kept_offsets = offsets - np.concatenate([[0], np.cumsum(removed)])
        kept = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(kept_offsets), kept_words), " ")
        kept = pc.if_else(texts.is_valid(), kept.cast(pa.string()), pa.scalar(None, pa.string()))
        out = {c: rows.column(c) for c in extra} | {kept_col: kept}
        if counts:
            out |= {"n_words": pa.array(np.diff(offsets)), "n_removed": pa.array(removed)}
        yield pa.RecordBatch.from_pydict(out)

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    names = [*extra, kept_col] if not counts else [*extra, kept_col, "n_words", "n_removed"]
    kinds |= {kept_col: "string"} | ({"n_words": "long", "n_removed": "long"} if counts else {})
    out = each_block(blocks, cut, ", ".join(f"`{c}` {kinds[c]}" for c in names), windows)
    order = [c for c in docs.columns if c in names] + [c for c in names if c not in docs.columns]
    return out.select(*[F.col(f"`{c}`") for c in order])
