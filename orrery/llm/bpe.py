"""Byte-level BPE through a sentencepiece model that is written straight from the ranks.

Each byte maps to one letter, each vocabulary entry to the string of its letters, with
minus its rank as score and its rank as id; normalisation is the identity. The merges
that sentencepiece then makes are those of the ranks. Pre-tokens are encoded one by one
and the decoder maps ids back to bytes. A pre-token that is itself an entry is that
entry, merges or no merges, as in the library that the ranks come from.

Edge cases: null and empty texts have no ids and decode to the empty string; a text of
any length is one row; other columns are not looked at; repeated rows give repeated rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Remembered, parts

FIRST_LETTER = 0x100
REMEMBERED = 200_000
SCHEMA = "doc_id long, n_tokens long, ids binary, decoded binary"


def letters(data: bytes) -> str:
    return "".join(chr(FIRST_LETTER + b) for b in data)


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialised(vocabulary: list[bytes]) -> bytes:
    """A sentencepiece BPE model, as protobuf bytes, whose id of an entry is its place in the list."""
    normal, unknown, bpe = 1, 2, 2
    pieces = [_field(1, letters(v).encode()) + _field(2, -float(rank)) + _field(3, normal) for rank, v in enumerate(vocabulary)]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown))
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(vocabulary)) + b"".join(_field(n, -1) for n in (41, 42, 43))
    identity = _field(1, b"identity") + b"".join(_field(n, 0) for n in (3, 4, 5))
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, identity)


class Codec:
    """Encoder and decoder over one vocabulary; ids travel as little-endian unsigned 32-bit integers."""

    def __init__(self, vocabulary: list[bytes], pattern: str):
        self.vocabulary = vocabulary
        self.split = regex.compile(pattern).findall
        self.whole = {v: i for i, v in enumerate(vocabulary)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialised(vocabulary))
        self.known = Remembered(self.piece, REMEMBERED)

    def piece(self, token: str) -> bytes:
        data = token.encode("utf-8", "surrogatepass")
        whole = self.whole.get(data)
        ids = self.model.encode(letters(data)) if whole is None else [whole]
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def codec(ranks_path: str, pattern: str) -> Codec:
    """One codec for each worker process."""
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    vocabulary = sorted(ranks, key=ranks.get)
    if [ranks[v] for v in vocabulary] != list(range(len(vocabulary))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    return Codec(vocabulary, pattern)


def _tokens(ranks_path: str, pattern: str, digests: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = codec(ranks_path, pattern)
        sha = (lambda x: hashlib.sha256(x).hexdigest()) if digests else (lambda x: x)
        for batch in parts(batches):
            counts, ids, decoded = [], [], []
            for text in batch["text"]:
                coded = made.encode(text or "")
                counts.append(len(coded) // 4)
                ids.append(sha(coded))
                decoded.append(sha(made.decode(coded)))
            yield pd.DataFrame({"doc_id": batch["doc_id"].array, "n_tokens": counts, "ids": ids, "decoded": decoded})

    return run


def bpe_round_trip(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False
) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` for each row; with ``digests`` the last two as SHA-256 in hex.

    ``ranks_path`` must name a file that every worker has, as an installed package does.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    schema = SCHEMA.replace("binary", "string") if digests else SCHEMA
    return rows.mapInPandas(_tokens(ranks_path, pattern, digests), schema)
