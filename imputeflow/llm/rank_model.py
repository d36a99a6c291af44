"""Byte-level BPE through a sentencepiece model made from the rank file (operator 10).

Every byte is mapped to a printable character (the usual byte alphabet: printable Latin-1 characters stand for
themselves, the rest for characters from 256 on). Each vocabulary entry becomes a piece of such characters whose score
is its negative rank, after one piece for unknown; normalisation is the identity without a dummy prefix and without
escaped spaces. sentencepiece then merges the adjacent pair whose joined piece has the lowest rank, leftmost first, which is
how rank files are read. A text is split by the public pattern, each match is encoded separately (distinct
matches once per batch), and a piece number less one is the rank. Decoding maps ids back to bytes.

One pass, no shuffle. Null text is empty; an empty text has no ids; repeated rows give repeated results; an empty table
gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from imputeflow.llm.encoding import BYTE_LETTERS, SpacedEncoder, byte_alphabet, encoder_for, vocabulary
from imputeflow.llm.shared import slices, take_runs

UNKNOWN = "<unk>"


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file in the order of their ranks, which must be 0, 1, 2, ..."""
    with open(path, "rb") as f:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, filter(bytes.strip, f))}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks have gaps")
    return [ranks[i] for i in range(len(ranks))]


def serialise(tokens: list[bytes]) -> bytes:
    """The sentencepiece model of a vocabulary: piece 0 is unknown, piece r + 1 is the token of rank r."""
    alphabet, kinds = byte_alphabet(), model_pb2.ModelProto.SentencePiece
    model = model_pb2.ModelProto()
    model.pieces.add(piece=UNKNOWN, score=0.0, type=kinds.UNKNOWN)
    for rank, token in enumerate(tokens):
        model.pieces.add(piece="".join(alphabet[b] for b in token), score=-float(rank), type=kinds.NORMAL)
    model.trainer_spec.model_type = model_pb2.TrainerSpec.BPE
    model.trainer_spec.vocab_size = len(model.pieces)
    model.trainer_spec.unk_piece = UNKNOWN
    model.trainer_spec.bos_id = model.trainer_spec.eos_id = model.trainer_spec.pad_id = -1
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix = False
    model.normalizer_spec.remove_extra_whitespaces = False
    model.normalizer_spec.escape_whitespaces = False
    return model.SerializeToString()


class RankCodec:
    """Encode pieces of text, decode ids."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        tokens = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(tokens))
        self.matches = regex.compile(pattern).findall
        self.pool = np.frombuffer(b"".join(tokens), np.uint8)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def pieces(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text; every match of the pattern is encoded by itself."""
        found = [self.matches(t) for t in texts]
        mapped = [m.encode("utf-8", "surrogatepass").decode("latin-1").translate(BYTE_LETTERS)
                  for ms in found for m in ms]
        ids = iter(self.model.encode(mapped, out_type=int, num_threads=1) if mapped else ())
        return [(np.array([i for _ in ms for i in next(ids)], np.int64) - 1).astype(np.uint32).tobytes()
                for ms in found]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the ids, as an array."""
        return take_runs(self.pool, self.starts[ids], self.lengths[ids])


@cache
def codec(path: str) -> RankCodec:
    return RankCodec(path)


def encode_decode(docs: DataFrame, vocabulary_name: str = "byte_bpe_multi_50k.tiktoken", id_col: str = "doc_id",
                  text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, digests of the decimal ids and of the decoded bytes; the ids themselves on request."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        path = vocabulary(vocabulary_name)
        encoder, tokens = encoder_for(path, SpacedEncoder, codec), codec(path)
        decimals = np.array([str(i) for i in range(len(tokens.lengths))], object)
        for batch in slices(batches):
            ids, counts = encoder.encode(batch.column("text"))
            ends = np.cumsum(counts)
            decoded = tokens.decode(ids)
            byte_ends = np.concatenate([[0], np.cumsum(tokens.lengths[ids])])[np.concatenate([[0], ends])]
            written = decimals[ids]
            out = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(counts, pa.int64()),
                   "ids_sha256": [hashlib.sha256(",".join(written[e - n:e].tolist()).encode()).hexdigest()
                                  for e, n in zip(ends.tolist(), counts.tolist(), strict=True)],
                   "decoded_sha256": [hashlib.sha256(decoded[a:b]).hexdigest()
                                      for a, b in zip(byte_ends[:-1].tolist(), byte_ends[1:].tolist(), strict=True)]}
            if keep_ids:
                out["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()),
                                                      pa.array(ids, pa.uint32()).cast(pa.int32()))
            yield pa.RecordBatch.from_pydict(out)

    more = ", ids array<int>" if keep_ids else ""
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
