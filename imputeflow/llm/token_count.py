"""Token counts by a compiled finite-state transducer (operator 3).

The vocabulary of a byte-pair model with scores is read as a deterministic transducer over characters. Its state is
what later steps can depend on: the longest end of the text that some longer piece begins with, and for every prefix
that ends within it the last token and the number of tokens (relative to now). Reading a character finds the last token
of the longer prefix: the one piece that ends there and follows the last token before it (two tokens follow each
other if the model gives just these two for their joined text). A transition carries the change of the number of
tokens; the sum over a text is its count. Transitions are compiled from the vocabulary when first met, into a table of
bounded size; a full table is emptied and filled anew, which changes no result.

Characters that are in no longer piece (among them all that fall back to bytes), and a space behind another
character, lead to one known state from every state. Texts are cut into chunks of equal length, and all chunks of a
slice run in step as arrays. The map of a chunk (state before -> state after, count) is constant behind its first
such character; a prefix scan over the chunk maps finds the state before each chunk's head, and a second run
in step adds the heads.

One pass over the texts, no shuffle. Null text is empty and counts 0; repeated rows give repeated results; an empty
table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from imputeflow.llm.encoding import vocabulary
from imputeflow.llm.shared import run_sums, slices

SPACE = "▁"
CHUNK = 256
MAX_STATES = 1 << 17
MAX_PAIRS = 1 << 18
LONE = 4  # classes 0..3: a character in no longer piece that is 1..4 tokens


class Transducer:
    """The transducer of one sentencepiece BPE model."""

    def __init__(self, path: str, max_states: int = MAX_STATES):
        proto = model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec, kinds = proto.normalizer_spec, model_pb2.ModelProto.SentencePiece
        if (proto.trainer_spec.model_type != model_pb2.TrainerSpec.BPE or spec.precompiled_charsmap
                or spec.remove_extra_whitespaces or not spec.escape_whitespaces
                or proto.trainer_spec.treat_whitespace_as_suffix
                or not any(p.type == kinds.BYTE for p in proto.pieces)
                or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces)):
            raise ValueError("only BPE models with byte fallback, no normalisation and plain pieces are compiled")
        pieces = {p.piece for p in proto.pieces if p.type == kinds.NORMAL}
        self.longer = {p for p in pieces if len(p) > 1}
        if any(SPACE in p.lstrip(SPACE) for p in self.longer):
            raise ValueError("a piece holds a space behind another character")
        self.starts = {p[:k] for p in self.longer for k in range(1, len(p))}
        self.letters = sorted({c for p in self.longer for c in p} | {SPACE})
        self.width = LONE + len(self.letters)
        self.classes = np.zeros(0x110000, np.int16)
        for size, first in enumerate((0x80, 0x800, 0x10000), 1):  # bytes of a character in UTF-8
            self.classes[first:] = size
        for c in pieces:
            if len(c) == 1:
                self.classes[ord(c)] = 0
        for k, c in enumerate(self.letters, LONE):
            self.classes[ord(c)] = k
        self.space = int(self.classes[ord(SPACE)])
        self.classes[ord(" ")] = self.space
        self.prefix = bool(spec.add_dummy_prefix)
        spec.add_dummy_prefix = False
        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.pairs: dict[tuple[str, str], bool] = {}
        self.shapes: dict[str, tuple[list[int], list[int]]] = {}
        self.columns = np.arange(self.width)  # a letter's column: letters get theirs when first met
        self.columns[LONE:] = -1
        self.met = list(range(LONE))
        self.max_states = max_states
        self._clear()

    def _clear(self) -> None:
        self.keys: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        self.table = np.full((1024, len(self.met)), -1, np.int32)  # state << 8 | change + 128
        self.reset = self._state(("", ("",), (0,)))
        self.after_space = self._state((SPACE, ("", SPACE), (-1, 0)))

    def _state(self, key: tuple) -> int:
        """key: known end of the text; last token and relative count at each prefix behind which a longer piece may have begun."""
        n = self.numbers.get(key)
        if n is None:
            n = self.numbers[key] = len(self.keys)
            self.keys.append(key)
            if n == len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
        return n

    def _follows(self, a: str, b: str) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > MAX_PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self.model.encode(a + b, out_type=str) == ([a, b] if a else [b])
        return known

    def _shape(self, grown: str, size: int) -> tuple[list[int], list[int]]:
        """Where the last piece of a grown end may begin, longest first, and where longer pieces may have begun."""
        shape = self.shapes.get(grown)
        if shape is None:
            n = len(grown)
            shape = self.shapes[grown] = ([d for d in range(n) if d == size or grown[d:] in self.longer],
                                          [d for d in range(n + 1) if d == n or grown[d:] in self.starts])
        return shape

    def _compile(self, at: int, letter: int) -> None:
        """Fill in one transition."""
        end, last, count = self.keys[at]
        if letter < LONE:
            to, change = self.reset, letter + 1
        elif letter == self.space and not end.endswith(SPACE):
            to, change = self.after_space, 1
        else:
            grown = end + self.letters[letter - LONE]
            depths, opens = self._shape(grown, len(end))
            depth = next(d for d in depths if self._follows(last[d], grown[d:]))
            change = count[depth] + 1
            last, count = (*last, grown[depth:]), (*count, change)
            cut = opens[0]
            key_last, key_count = [""] * (len(grown) + 1 - cut), [0] * (len(grown) + 1 - cut)
            for d in opens:
                key_last[d - cut], key_count[d - cut] = last[d], count[d] - change
            to = self._state((grown[cut:], tuple(key_last), tuple(key_count)))
        self.table[at, self.columns[letter]] = to << 8 | change + 128

    def _meet(self, classes: np.ndarray) -> np.ndarray:
        """Columns of the characters; the table gets wider for letters not met before."""
        new = np.unique(classes[self.columns[classes] < 0])
        if len(new):
            self.columns[new] = np.arange(len(self.met), len(self.met) + len(new))
            self.met += new.tolist()
            self.table = np.pad(self.table, ((0, 0), (0, len(new))), constant_values=-1)
        return self.columns[classes]

    def _run(self, columns: np.ndarray, starts: np.ndarray, lengths: np.ndarray,
             states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """End state and count of each lane. All lanes go in step, longest first, so those that end drop off."""
        order = np.argsort(-lengths, kind="stable")
        at, place, ends = states[order], starts[order], lengths[order]
        total = np.zeros(len(order), np.int64)
        live = np.searchsorted(-ends, -np.arange(int(ends[0]) if len(ends) else 0), "left")
        for k, n in enumerate(live.tolist()):
            letter = columns[place[:n] + k]
            found = self.table[at[:n], letter]
            if found.min() < 0:
                if len(self.keys) > self.max_states:
                    held, back = np.unique(at, return_inverse=True)
                    keys = [self.keys[i] for i in held.tolist()]
                    self._clear()
                    at = np.array([self._state(key) for key in keys])[back]
                    found = self.table[at[:n], letter]
                new = found < 0
                for x in np.unique(at[:n][new] * len(self.met) + letter[new]).tolist():
                    state, column = divmod(x, len(self.met))
                    self._compile(state, self.met[column])
                found = self.table[at[:n], letter]
            total[:n] += (found & 255) - 128
            at[:n] = found >> 8
        out, counts = np.empty_like(at), np.empty_like(total)
        out[order], counts[order] = at, total
        return out, counts

    def counts(self, texts: pa.Array, chunk: int = CHUNK) -> np.ndarray:
        """Number of tokens of each text."""
        texts = pc.fill_null(texts, "")
        sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        if not sizes.sum():
            return np.zeros(len(sizes), np.int64)
        points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
        classes = self.classes[points]
        space = classes == self.space
        columns = self._meet(classes)
        known = classes < LONE
        known[1:] |= space[1:] & ~space[:-1]
        text_ends = np.cumsum(sizes)
        text_starts = text_ends - sizes
        known[text_starts[sizes > 0]] = False  # a text's first chunk starts from its own state
        spots = np.append(np.flatnonzero(known), len(points))

        n = -(-sizes // chunk)
        before = np.cumsum(n) - n
        owner = np.repeat(np.arange(len(sizes)), n)
        nth = np.arange(len(owner)) - before[owner]
        a = text_starts[owner] + nth * chunk
        b = np.minimum(a + chunk, text_ends[owner])
        first, final = nth == 0, nth == n[owner] - 1
        head = np.where(first, a, np.minimum(spots[np.searchsorted(spots, a)], b))  # where the map gets constant
        fixed = first | (head < b)
        states = np.where(first & self.prefix, self.after_space, self.reset)
        total, end = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        end[fixed], total[fixed] = self._run(columns, head[fixed], (b - head)[fixed], states[fixed])

        source = np.maximum.accumulate(np.where(fixed, np.arange(len(a)), 0))  # last chunk with a known end
        heads = np.flatnonzero(~first & (fixed | final))
        prior = source[heads - 1]
        total[heads] += self._run(columns, b[prior], head[heads] - b[prior], end[prior])[1]
        return run_sums(total, np.append(before, len(owner))) + ((sizes > 0) & self.prefix)


@cache
def _transducer(path: str) -> Transducer:
    return Transducer(path)


def count_tokens(docs: DataFrame, vocabulary_name: str = "piece_bpe_32k.model", limit: int = 4096,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def count(batches):
        transducer = _transducer(vocabulary(vocabulary_name))
        for batch in slices(batches):
            texts = batch.column("text")
            n = transducer.counts(texts)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "n_bytes": pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()),
                "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array(n > limit)})

    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
