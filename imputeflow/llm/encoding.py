"""Token ids of whole texts from public vocabularies, through the ids of the distinct words of a batch.

A text is cut only where the tokenizer itself always cuts: the library encodes each distinct piece once per batch
(recent pieces are remembered, within a bound), and the ids of a text are the pieces' ids in order. A text in which
such a cut isn't certain is encoded whole by the library.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

from imputeflow.llm.shared import RecentValues, list_offsets, run_sums, take_runs, words_of

REMEMBERED = 400_000
PUNCTUATION = ".,;:!?"
SIMPLE = "İ"  # below it, lower case is a rule for each character alone


def vocabulary(name: str) -> str:
    """Path of a vocabulary file: ``name`` itself if it is a path, else the installed public file of that name."""
    return name if os.sep in name else public_tokenizers.path(name)


def byte_alphabet() -> list[str]:
    """The usual printable character for each byte: itself where printable in Latin-1, else one from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)]


BYTE_LETTERS = str.maketrans({b: c for b, c in enumerate(byte_alphabet())})


def _packed(ids) -> bytes:
    return array("I", ids).tobytes()


def split_end(word: str) -> tuple[str, ...]:
    """A word and the punctuation behind it, where a letter or digit stands before that punctuation."""
    base = word.rstrip(PUNCTUATION)
    if len(base) < len(word) and base and base[-1] < SIMPLE and base[-1].isalnum():
        return base, word[len(base):]
    return (word,)


class LibraryEncoder:
    """ids by the tokenizers library, without added special tokens.

    ``plain`` is a pattern of pieces that the tokenizer's own splitting leaves whole and unchanged: they go to its model
    directly, in the byte alphabet. A few words are encoded both ways first; if they differ, no piece counts as plain.
    """

    def __init__(self, path: str, plain: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.is_plain = re.compile(plain).fullmatch
        tried = [w for w in (" the", "the", " of", "street", "größe", " élève", " Über", "niño", "xqzjk") if self.is_plain(w)]
        if [self._of_model(w) for w in tried] != self._whole(tried):
            self.is_plain = lambda text: None

    def _of_model(self, text: str) -> bytes:
        mapped = text.encode().decode("latin-1").translate(BYTE_LETTERS)
        return _packed([t.id for t in self.model.tokenize(mapped)])

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [_packed(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, texts: list[str]) -> list[bytes]:
        plain = [self.is_plain(t) is not None for t in texts]
        rest = iter(self._whole([t for t, p in zip(texts, plain, strict=True) if not p]))
        return [self._of_model(t) if p else next(rest) for t, p in zip(texts, plain, strict=True)]


class TextEncoder:
    """Flat ids and their number per text for an Arrow array of texts; null counts as empty."""

    def __init__(self, encoder):
        self.encoder, self.recent = encoder, RecentValues(REMEMBERED)

    def forget(self) -> None:
        """Let go of the remembered pieces: a Python worker goes on to other stages with what it holds."""
        self.recent = RecentValues(REMEMBERED)

    def _unit_ids(self, parts: list[tuple[str, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pool of ids, and start and length of each unit's ids in it."""
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        found = self.recent.get_all([p for unit in parts for p in unit], self.encoder.pieces)
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        lengths = run_sums(size, np.concatenate([[0], np.cumsum(n)]))
        return np.frombuffer(b"".join(found), np.uint32), np.cumsum(lengths) - lengths, lengths

    def units(self, texts: pa.Array):
        """Distinct units as parts, unit of each place, offsets of the texts, and which texts go to the library."""
        raise NotImplementedError

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parts, codes, offsets, odd = self.units(texts)
        pool, starts, lengths = self._unit_ids(parts)
        each = lengths[codes]
        ids, counts = take_runs(pool, starts[codes], each), run_sums(each, offsets)
        if odd.any():
            ends = np.cumsum(counts)
            rows = np.split(ids, ends[:-1])
            for i in np.flatnonzero(odd).tolist():
                rows[i] = np.frombuffer(self.encoder.pieces([texts[i].as_py() or ""])[0], np.uint32)
            ids, counts = np.concatenate(rows), np.fromiter(map(len, rows), np.int64, len(rows))
        return ids, counts


class WordEncoder(TextEncoder):
    """For a vocabulary that folds case and drops white space: units are the words between ASCII white space."""

    plain = "[a-zß-öø-ÿ]+"

    @staticmethod
    def parts(word: str) -> tuple[str, ...]:
        if "<|" in word:
            return (word,)
        if max(word) < SIMPLE:
            word = word.lower()
        return split_end(word)

    def units(self, texts):
        words, offsets = words_of(texts)
        d = words.dictionary_encode()
        return ([self.parts(w) for w in d.dictionary.to_pylist()],
                d.indices.to_numpy(zero_copy_only=False), offsets, np.zeros(len(texts), bool))


class SpacedEncoder(TextEncoder):
    """For byte-level vocabularies whose pattern binds one space to the word behind it.

    A cut stands before each single space between two characters that are no white space, and around each single
    line end between such characters. Texts with other white space go to the library whole.
    """

    plain = " ?[A-Za-zÀ-ÖØ-öø-ÿ]+"

    @staticmethod
    def parts(word: str, lead: str) -> tuple[str, ...]:
        if "\n" not in word:
            return split_end(lead + word)
        lines = word.split("\n")
        if any(not x or x[0].isspace() or x[-1].isspace() for x in lines):
            return (lead + word,)
        out = list(split_end(lead + lines[0]))
        for x in lines[1:]:
            out.append("\n")
            out += split_end(x)
        return tuple(out)

    def units(self, texts):
        lists = pc.split_pattern(pc.fill_null(texts, ""), " ")
        offsets = list_offsets(lists)
        d = lists.flatten().dictionary_encode()
        words = d.dictionary.to_pylist()
        codes = d.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        odd = np.fromiter((not w or w[0].isspace() or w[-1].isspace() for w in words), bool, len(words))
        odd_text = run_sums(odd[codes], offsets) > 0
        parts = [self.parts(w, " ") for w in words]
        first, at = np.unique(codes[offsets[:-1]], return_inverse=True)
        parts += [self.parts(words[c], "") for c in first.tolist()]
        codes[offsets[:-1]] = len(words) + at
        if odd_text.any():  # their units hold no ids
            parts.append(())
            codes[np.repeat(odd_text, np.diff(offsets))] = len(parts) - 1
        return parts, codes, offsets, odd_text


@cache
def encoder_for(name: str, kind: type, library: type | None = None) -> TextEncoder:
    """One encoder per Python worker, vocabulary and kind."""
    path = vocabulary(name)
    return kind(library(path) if library else LibraryEncoder(path, kind.plain))
