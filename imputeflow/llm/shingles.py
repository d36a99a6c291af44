"""Word shingles of whole texts as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from imputeflow.llm.shared import mix, words_of

WORDS = 5


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of the texts, and the offset of each text's first word."""
    words, offsets = words_of(texts)
    d = words.dictionary_encode()
    table = np.fromiter(map(xxhash.xxh3_64_intdigest, d.dictionary.cast(pa.binary()).to_pylist()), np.uint64,
                        len(d.dictionary))
    return table[d.indices.to_numpy(zero_copy_only=False)], offsets


def shingle_hashes(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``words`` words, text by text, and the offsets; a shorter text with words is one shingle."""
    h, offsets = word_hashes(texts)
    n = np.diff(offsets)
    counts = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    value = np.zeros(len(h), np.uint64)
    size = np.minimum(n, words)
    for k in range(words):  # a position's value takes in word k where its shingle has one
        shifted = np.roll(h, -k)
        value = mix(value + np.uint64(0x9E3779B97F4A7C15)) ^ shifted if k == 0 else np.where(
            np.repeat(size, n) > k, mix(value) ^ shifted, value)
    out_offsets = np.concatenate([[0], np.cumsum(counts)])
    within = np.arange(len(h)) - np.repeat(offsets[:-1], n)
    return mix(value[within < np.repeat(counts, n)]), out_offsets


def distinct_runs(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each run, sorted, and their offsets."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    first = np.ones(len(values), bool)
    first[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[first], np.concatenate([[0], np.cumsum(np.bincount(owner[first], minlength=len(offsets) - 1))])
