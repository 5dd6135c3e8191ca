"""Byte-level BPE through a sentencepiece model that is serialised here from a rank file.

Every byte becomes one code point (``chr(256 + byte)``), every token of the rank file a piece of those, scored by its
negative rank; normalisation is the identity. Sentencepiece then merges the best-scored neighbours first, which is the
merge order of the ranks. Texts are cut into pre-tokens first and each is encoded separately; a pre-token that is a
token itself is that token. Decoding maps ids back to pieces and pieces to bytes.

Null texts count as empty; an empty text has no ids and decodes to no bytes. Rows are independent of each other, so
repeated rows, ties and empty tables need no rule. Special-token strings in a text are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import lru_cache

import regex
from pyspark.sql import DataFrame

from .common import Memo, with_columns

UNKNOWN = "⁇"
TO_POINT = {b: 256 + b for b in range(256)}


def read_ranks(path: str) -> list[bytes]:
    """Tokens in rank order of a rank file (base64 token, blank, rank)."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = sorted((int(rank), base64.b64decode(token)) for token, rank in pairs)
    if [r for r, _ in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must run from 0 without gaps")
    return [t for _, t in tokens]


def to_piece(token: bytes) -> str:
    return token.decode("latin-1").translate(TO_POINT)


def from_piece(piece: str) -> bytes:
    return bytes(ord(c) - 256 for c in piece)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def model_proto(tokens: list[bytes]) -> bytes:
    """The model file: piece 0 is the unknown one, piece ``rank + 1`` is the token of that rank."""
    def piece(text: str, score: float, kind: int) -> bytes:
        return _bytes(1, _bytes(1, text.encode()) + b"\x15" + struct.pack("<f", score) + _number(3, kind))

    trainer = _number(3, 2) + _number(4, len(tokens) + 1) + _number(40, 0)  # BPE, vocabulary size, unknown id
    none = (1 << 64) - 1  # -1: no begin, end and padding pieces
    trainer += b"".join(_number(f, none) for f in (41, 42, 43)) + _bytes(45, UNKNOWN.encode())
    normal = _bytes(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)  # no prefix, no blank removal or escape
    return b"".join([piece(UNKNOWN, 0.0, 2), *(piece(to_piece(t), -float(r), 1) for r, t in enumerate(tokens)), _bytes(2, trainer), _bytes(3, normal)])


class Codec:
    """Encoder and decoder over one rank file."""

    def __init__(self, path: str, pattern: str) -> None:
        import sentencepiece

        tokens = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(tokens))
        self.whole = {t: r for r, t in enumerate(tokens)}
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        # a chunk begins at a blank or where a run of white space ends; no pre-token crosses such a border
        self.chunk = regex.compile(r" ?\P{White_Space}+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
        self.doubled = regex.compile(r" \p{White_Space}|\p{White_Space} ")
        self.pieces = [from_piece(self.model.id_to_piece(r + 1)) for r in range(len(tokens))]

    def chunks(self, text: str) -> list[str]:
        """Cuts a text where no pre-token can cross. Single blanks between words are the usual, quick case."""
        if self.doubled.search(text):
            return self.chunk.findall(text)
        first, *rest = text.split(" ")
        return [*([first] if first else []), *[" " + x for x in rest]]

    def encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        pre = [[t.encode() for t in self.pattern.findall(c)] for c in chunks]
        flat = [t for ts in pre for t in ts]
        odd = [t for t in dict.fromkeys(flat) if t not in self.whole]
        found = dict(zip(odd, self.model.encode([to_piece(t) for t in odd], out_type=int, num_threads=1))) if odd else {}
        out = []
        for ts in pre:
            ids: list[int] = []
            for t in ts:
                if (r := self.whole.get(t)) is not None:
                    ids.append(r)
                else:
                    ids.extend(i - 1 for i in found[t])
            out.append(ids)
        return out

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.encode_chunks(self.chunks(text)) for i in ids]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


@lru_cache(2)
def _digits(path: str, pattern: str) -> tuple[Memo, dict[bytes, bytes]]:
    """Chunk -> its ids in decimal, joined by blanks; decimal id -> bytes."""
    c = codec(path, pattern)
    memo = Memo(lambda new: [" ".join(map(str, ids)).encode() for ids in c.encode_chunks(new)])
    return memo, {str(i).encode(): p for i, p in enumerate(c.pieces)}


def encode_decode(docs: DataFrame, path: str, pattern: str, text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Adds ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``, and with ``keep_ids`` also ``ids`` and ``decoded``."""
    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * keep_ids

    def make():
        c, (memo, back) = codec(path, pattern), _digits(path, pattern)

        def run(texts: list) -> list:
            cut = [c.chunks(t.decode("utf-8", "replace")) if t else [] for t in texts]
            memo.know(x for xs in cut for x in xs)
            joined = [b" ".join(map(memo.known.__getitem__, xs)) for xs in cut]
            split = [j.split() for j in joined]
            plain = [b"".join(map(back.__getitem__, s)) for s in split]
            out = [[len(s) for s in split], [hashlib.sha256(j).hexdigest() for j in joined], [hashlib.sha256(p).hexdigest() for p in plain]]
            return out + ([[list(map(int, s)) for s in split], plain] if keep_ids else [])

        return run

    return with_columns(docs, [text], make, fields)
