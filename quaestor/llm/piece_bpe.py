"""Byte-level BPE encoding and decoding with a sentencepiece model made from the ranks of a vocabulary.

Every byte is written as one printable character, every token as its characters; a piece scores the negative of its rank,
so the library merges in rank order.  The text is cut by the vocabulary's pattern first; a cut that is itself a token is
that token, as the reference encoders have it.

Nulls: a null text is empty and has no ids; a null document id is kept.  Empty tables give no rows; repeated rows stay.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quaestor.llm.common import texts
from quaestor.llm.subword import Remembered

_coders: dict[str, "Coder"] = {}


def byte_alphabet() -> list[str]:
    """A printable character for each byte: itself where printable, else the next free one from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece model: piece number i is the token of rank i, the unknown piece comes last."""
    alphabet = byte_alphabet()
    by_rank = sorted(ranks.items(), key=lambda x: x[1])
    if [r for _, r in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must run from 0 without gaps")
    normal, unknown, bpe = 1, 2, 2
    pieces = [
        _field(1, "".join(alphabet[b] for b in token).encode()) + _field(2, float(-rank)) + _field(3, normal)
        for token, rank in by_rank
    ]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown))
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(by_rank)) + b"".join(_field(k, (1 << 64) - 1) for k in (41, 42, 43))
    # identity: no map, no dummy prefix, white space neither removed nor escaped
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Coder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        self.ranks = ranks
        self.tokens = [t for t, _ in sorted(ranks.items(), key=lambda x: x[1])]
        self.alphabet = byte_alphabet()
        self.to_alphabet = {b: ord(c) for b, c in enumerate(self.alphabet)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))
        # the pattern's white space is Unicode's property, which leaves out the separators U+001C to U+001F
        self.pattern = regex.compile(
            pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        )
        self.encode = Remembered(self.encode_texts)

    def encode_pieces(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of pre-tokens."""
        raw = [p.encode() for p in pieces]
        out = [self.ranks.get(b) for b in raw]
        rest = [k for k, rank in enumerate(out) if rank is None]
        mapped = [raw[k].decode("latin-1").translate(self.to_alphabet) for k in rest]
        for k, ids in zip(rest, self.model.encode(mapped, out_type=int, num_threads=1) if rest else []):
            out[k] = ids
        return [np.array([x] if isinstance(x, int) else x, "<u4") for x in out]

    def encode_texts(self, strings: list[str]) -> list[np.ndarray]:
        cut = [self.pattern.findall(w) for w in strings]
        distinct = dict.fromkeys([p for c in cut for p in c])
        ids = dict(zip(distinct, self.encode_pieces(list(distinct))))
        return [ids[c[0]] if len(c) == 1 else np.concatenate([ids[p] for p in c]) for c in cut]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def coder(ranks: dict[bytes, int], pattern: str, key: str) -> Coder:
    if key not in _coders:
        _coders[key] = Coder(ranks, pattern)
    return _coders[key]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit) and decoded (binary) of every whole text."""
    ranks = read_ranks(ranks_path)
    sent = docs.sparkSession.sparkContext.broadcast(ranks)  # the vocabulary only, whatever the corpus
    key = hashlib.sha256(repr((pattern, len(ranks), ranks_path)).encode()).hexdigest()

    def run(batches):
        own = coder(sent.value, pattern, key)
        for batch in batches:
            for first, ids, at in own.encode(batch.column("text")):
                rows = [ids[a:b] for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(first, len(rows)),
                        pa.array([x.tobytes() for x in rows], pa.binary()),
                        pa.array(map(own.decode, rows), pa.binary()),
                    ],
                    ["doc_id", "ids", "decoded"],
                )

    return texts(docs).mapInArrow(run, "doc_id long, ids binary, decoded binary")
