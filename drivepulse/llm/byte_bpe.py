"""Byte-level BPE through a sentencepiece model that is written straight from a rank file.

Every token of the rank file becomes a piece: its bytes are mapped to printable characters one to
one, and its score is the negative rank, so that sentencepiece merges in rank order. There is no
training and no normalisation. A text is cut by the pattern of the vocabulary, each match is mapped
and encoded by itself, and decoding maps the characters of the pieces back to bytes.

Null text counts as empty and has no ids. Rows are independent of one another: repeated rows give
repeated results, an empty table an empty result, null ids stay null. A text of any length is read
in runs of matches, so that only its ids are held whole.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drivepulse.llm.common import PieceCache, slices, texts_of
from drivepulse.session import bounded_batches

# Matches that are looked up at once, encoded matches that a process keeps, and bytes of text per batch of results.
RUN = 200_000
CACHED = 100_000
BATCH = 1 << 20


@cache
def byte_characters() -> str:
    """A printable character for each of the 256 bytes: itself where it is printable, else one from U+0100 on."""
    kept = set(range(33, 127)) | set(range(161, 173)) | set(range(174, 256))
    others = iter(range(256, 512))
    return "".join(chr(b if b in kept else next(others)) for b in range(256))


def _field(number: int, wire: int, payload: bytes) -> bytes:
    return _varint(number << 3 | wire) + payload


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _sized(number: int, payload: bytes) -> bytes:
    return _field(number, 2, _varint(len(payload)) + payload)


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file in rank order."""
    with open(path, "rb") as lines:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must run from 0 without gaps")
    return [token for _, token in pairs]


def write_model(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model: piece 0 is unknown, piece r + 1 is the token of rank r."""
    characters = byte_characters()
    unknown = "\N{REPLACEMENT CHARACTER}unknown"
    # Field numbers of the public model format: piece 1 (text 1, score 2, kind 3), trainer 2, normaliser 3.
    out = [_sized(1, _sized(1, unknown.encode()) + _field(2, 5, struct.pack("<f", 0)) + _field(3, 0, _varint(2)))]
    for rank, token in enumerate(tokens):
        piece = "".join(characters[b] for b in token).encode()
        out.append(_sized(1, _sized(1, piece) + _field(2, 5, struct.pack("<f", -rank)) + _field(3, 0, _varint(1))))
    trainer = _field(3, 0, _varint(2)) + _field(4, 0, _varint(len(tokens) + 1)) + _sized(45, unknown.encode())
    normaliser = _sized(1, b"identity") + b"".join(_field(k, 0, _varint(0)) for k in (3, 4, 5))
    return b"".join(out) + _sized(2, trainer) + _sized(3, normaliser)


class Codec:
    """Encoder and decoder of one vocabulary; ids are packed as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.tokens = read_ranks(path)
        self.whole = {token: struct.pack("<I", rank) for rank, token in enumerate(self.tokens)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=write_model(self.tokens))
        self.pattern = regex.compile(pattern)
        self.map = {b: c for b, c in enumerate(byte_characters())}
        back = {c: b for b, c in self.map.items()}
        ids = range(1, len(self.tokens) + 1)
        self.bytes_of = [bytes(back[c] for c in piece) for piece in self.model.IdToPiece(list(ids))]
        self.known = PieceCache(self._pieces, CACHED)

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        raw = [p.encode() for p in pieces]
        out = [self.whole.get(b) for b in raw]
        open_ = [i for i, ids in enumerate(out) if ids is None]
        mapped = [raw[i].decode("latin-1").translate(self.map) for i in open_]
        for i, ids in zip(open_, self.model.encode(mapped, num_threads=1) if mapped else [], strict=True):
            out[i] = (np.asarray(ids, "<u4") - np.uint32(1)).tobytes()
        return out

    def encode(self, text: str) -> bytes:
        if len(text) < 10 * RUN:
            return self._join(self.pattern.findall(text))
        found, parts = (m.group() for m in self.pattern.finditer(text)), []
        while run := list(islice(found, RUN)):
            parts.append(self._join(run))
        return b"".join(parts)

    def _join(self, pieces: list[str]) -> bytes:
        try:
            return b"".join(map(self.known.__getitem__, pieces))
        except KeyError:
            self.known.learn(set(pieces))
            return b"".join(map(self.known.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@cache
def codec(path: str, pattern: str) -> Codec:
    """One per process and vocabulary."""
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, decoded: bool = False) -> DataFrame:
    """Rows ``doc_id, ids`` with the packed ids of every whole text, and ``decoded`` bytes on request.

    ``path`` is a rank file present on every worker.
    """
    bounded_batches(docs.sparkSession)
    schema = "doc_id bigint, ids binary" + (", decoded binary" if decoded else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path, pattern)
        for batch in slices(batches, size=BATCH):
            ids = [tool.encode(t) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array(ids, pa.binary())]
            if decoded:
                columns.append(pa.array(map(tool.decode, ids), pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in schema.split(", ")])

    return texts_of(docs).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Rows ``doc_id, text`` back from ``doc_id, ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path, pattern)
        for batch in batches:
            texts = [tool.decode(i or b"").decode() for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def digests(docs: DataFrame, path: str, pattern: str, ids: bool = False) -> DataFrame:
    """Token count and digests of the ids and of the bytes decoded from them, one row per document; on request the packed ids too."""
    return encode(docs, path, pattern, decoded=True).select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *(["ids"] if ids else []),
    )
