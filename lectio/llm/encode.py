"""Encoding of a corpus with a public byte-level BPE tokenizer (problem 8).

The vocabulary file (``token in base64`` and ``rank`` per line) is turned into a sentencepiece BPE model: each byte is
mapped to one character, each token to a piece whose score is its negative rank, and normalisation is the identity. Text
is split by the tokenizer's own pattern, each pre-token is encoded, and decoding is the inverse mapping.

Null and empty texts give an empty list; whitespace is encoded like any text; a lone surrogate cannot occur in Spark
strings. Repeated rows are encoded each; an empty table gives an empty table; other columns pass through, but one that is
already named like the result is replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: First code point of the 256 characters that stand for bytes: a block without case, white space or decomposition.
BYTE_BASE = 0x4E00
#: Pre-tokens a worker keeps; the memory is emptied when it is full, so it bounds memory and not results.
MEMORY = 400_000


def default_vocabulary() -> str:
    """Path of byte_bpe_50k of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_vocabulary(path: str) -> list[bytes]:
    """Tokens by id."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * (max(int(r) for _, r in pairs) + 1)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def _chars(data: bytes) -> str:
    return "".join(chr(BYTE_BASE + b) for b in data)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float | bool) -> bytes:
    """One protobuf field: length-delimited, 32-bit float or varint."""
    import struct

    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(int(value))


def build_model(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model with the ids of ``tokens``; the unknown piece comes after them and is never
    met, as all 256 bytes are tokens."""
    pieces = b"".join(
        _field(1, _field(1, _chars(t).encode()) + _field(2, float(-i)) + _field(3, 1)) for i, t in enumerate(tokens)
    )
    pieces += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    n = len(tokens)
    none = (1 << 64) - 1
    # trainer: BPE, vocabulary size, ids of unk, bos, eos, pad
    trainer = _field(3, 2) + _field(4, n + 1) + _field(40, n) + _field(41, none) + _field(42, none) + _field(43, none)
    # normalizer: identity, no dummy prefix, white space kept and not escaped
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return pieces + _field(2, trainer) + _field(3, normalizer)


class Encoder:
    """Encodes texts with a model of :func:`build_model`."""

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.split = regex.compile(pattern).findall
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.known: dict[str, list[int]] = {}

    def _miss(self, word: str) -> list[int]:
        ids = self.sp.encode(_chars(word.encode()))
        if len(word) <= 64:
            if len(self.known) >= MEMORY:
                self.known.clear()
            self.known[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if text:
            get, miss, extend = self.known.get, self._miss, out.extend
            for word in self.split(text):
                extend(get(word) or miss(word))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``; ids of a whole text give it back exactly."""
        chars = "".join(self.sp.id_to_piece(int(i)) for i in ids)
        return bytes(ord(c) - BYTE_BASE for c in chars).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _encoder(model: bytes, pattern: str) -> Encoder:
    return Encoder(model, pattern)


def encode_corpus(df: DataFrame, text: str = "text", ids: str = "ids", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """``df`` without ``text`` and with ``ids``. One map over the rows: no shuffle. The broadcast model has the fixed
    size of its vocabulary (about 1 MB)."""
    spark = df.sparkSession
    model = spark.sparkContext.broadcast(build_model(read_vocabulary(vocabulary or default_vocabulary())))
    pattern = pattern or default_pattern()
    rest = [c for c in df.columns if c not in (text, ids)]
    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField(ids, T.ArrayType(T.IntegerType()), True)])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        coder = _encoder(model.value, pattern)
        for batch in batches:
            coded = [coder.encode(t) for t in batch.column(text).to_pylist()]
            offsets = np.zeros(len(coded) + 1, np.int32)
            np.cumsum([len(c) for c in coded], out=offsets[1:])
            flat = np.fromiter((i for c in coded for i in c), np.int32, int(offsets[-1]))
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), lists], [*rest, ids])

    return df.select(*rest, text).mapInArrow(run, schema)
