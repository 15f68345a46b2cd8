"""Byte-level BPE through a sentencepiece model that is written straight from the rank file."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import chain, islice
from sys import getsizeof

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidloom.llm.common import giving_back, text_of
from evidloom.llm.pretokens import Cutter, byte_alphabet
from evidloom.llm.token_counts import slices

NORMAL, UNKNOWN, BPE = 1, 2, 2
#: Texts and bytes encoded at a time (one text at least), chunks looked up at a time, pre-tokens in a call of the library.
TEXTS, SLICE_BYTES, RUN, CALL = 256, 1 << 20, 4096, 1 << 15
#: Bytes that a task remembers of chunks and their ids, and what a chunk takes besides; above, it starts anew.
KNOWN_BYTES, ENTRY = 64 << 20, 110
#: Ids decoded at a time, in bytes.
DECODED = 1 << 20


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank; ranks are 0, 1, 2 ..."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks have gaps")
    return tokens


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, value: int | float | bytes) -> bytes:
    """One field of a protocol buffer message: an integer, a 32-bit float, or bytes."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    return _varint(number << 3) + _varint(value)


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A serialised model whose ids are the ranks.

    Pieces are the tokens with each byte mapped to a character, scored by negative rank, so that the best score is
    the lowest rank; one unknown piece, never reached, follows them. Normalisation is the identity, without a
    space put first, white space removed or escaped.
    """
    letter = byte_alphabet()
    pieces = [_field(1, "".join(letter[b] for b in t).encode()) + _field(2, float(-rank)) + _field(3, NORMAL) for rank, t in enumerate(tokens)]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, UNKNOWN))
    off = (1 << 64) - 1  # -1: no such piece
    trainer = _field(3, BPE) + _field(4, len(pieces)) + _field(40, len(tokens)) + _field(41, off) + _field(42, off) + _field(43, off)
    normalizer = _field(1, b"identity") + _field(2, b"") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Text to ids and back, with ids as little-endian unsigned 32-bit integers."""

    def __init__(self, model: bytes, pattern: str):
        from sentencepiece import SentencePieceProcessor

        self.sp = SentencePieceProcessor(model_proto=model)
        letters = byte_alphabet()
        byte = {c: b for b, c in enumerate(letters)}
        n = self.sp.get_piece_size() - 1
        self.token = [bytes(byte[c] for c in self.sp.id_to_piece(i)) for i in range(n)]
        self.letters = {b: c for b, c in enumerate(letters)}
        self.cutter, self.known, self.held = Cutter(pattern), {}, 0

    def _encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; the library is called for many pre-tokens at a time, of several texts or of part of one."""
        out = [[] for _ in texts]
        waiting: list[str] = []
        owners: list[tuple[int, int]] = []

        def call() -> None:
            pieces = [p.encode().decode("latin-1").translate(self.letters) for p in waiting]
            found = iter(self.sp.encode(pieces, out_type=int, num_threads=1) if pieces else [])
            for i, n in owners:
                out[i].append(np.fromiter(chain.from_iterable(islice(found, n)), "<u4").tobytes())
            waiting.clear()
            owners.clear()

        for i, t in enumerate(texts):
            cut = iter(self.cutter.cut(t)) if len(t) < CALL else self.cutter.each(t)
            while piece := list(islice(cut, CALL)):
                waiting += piece
                owners.append((i, len(piece)))
                if len(waiting) >= CALL:
                    call()
        call()
        return [b"".join(x) for x in out]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; each chunk that the task remembers is not encoded again."""
        parts = [self.cutter.chunks(t) for t in texts]
        alone = iter(self._encode([a for first, _ in parts for a in first]))
        out = [bytearray(b"".join(next(alone) for _ in first)) for first, _ in parts]
        run: list[tuple[int, list[str]]] = []
        many = 0
        for i, (_, chunks) in enumerate(parts):
            for lo in range(0, len(chunks), RUN):
                piece = chunks[lo : lo + RUN]
                if many + len(piece) > RUN:
                    self._look_up(run, out)
                    run, many = [], 0
                run.append((i, piece))
                many += len(piece)
        self._look_up(run, out)
        return list(map(bytes, out))

    def _look_up(self, run: list[tuple[int, list[str]]], out: list[bytearray]) -> None:
        """Adds the ids of each text's chunks to its own."""
        known = self.known
        if self.held > KNOWN_BYTES:
            self.forget()
        new = list({c for _, piece in run for c in piece if c not in known})
        ids = self._encode([" " + c for c in new])
        known.update(zip(new, ids, strict=True))
        self.held += sum(map(getsizeof, new)) + sum(map(getsizeof, ids)) + ENTRY * len(new)
        for i, piece in run:
            out[i] += b"".join(map(known.__getitem__, piece))

    def forget(self) -> None:
        self.known.clear()
        self.held = 0

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def decoded_sha256(self, ids: bytes) -> str:
        """The hash of the decoded bytes, decoded part by part."""
        seen = hashlib.sha256()
        for lo in range(0, len(ids), DECODED):
            seen.update(self.decode(ids[lo : lo + DECODED]))
        return seen.hexdigest()


#: A worker's codec, kept from task to task without what a task remembers.
_CODEC: dict[tuple[int, str], Codec] = {}


def _codec(model: bytes, pattern: str) -> Codec:
    key = hash(model), pattern
    if key not in _CODEC:
        _CODEC.clear()
        _CODEC[key] = Codec(model, pattern)
    return _CODEC[key]


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pattern: str | None = None, ids: bool = True) -> DataFrame:
    """Each row's id, ``ids`` (array of int, unless left out), ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``.

    One pass without a shuffle. Null texts are empty: no ids, and the hashes of nothing. Null and repeated ids give
    a row for each row. Special tokens are never made; strings that look like one are ordinary text. Other columns
    are left out. Long texts are cut and encoded part by part; only one pre-token has to be in the library at once, and
    what a task remembers is bounded in bytes. ``vocabulary`` is a rank file (default: the public byte-level one of 50,256 tokens); the model
    made from it, about a megabyte whatever the data, is what tasks get.
    """
    model = docs.sparkSession.sparkContext.broadcast(sentencepiece_model(read_ranks(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"))))
    pattern = pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model.value, pattern)
        for batch in batches:
            for part in slices(batch, TEXTS, SLICE_BYTES):  # little text at a time: ids take more room
                got = codec.encode([t or "" for t in part.column(1).to_pylist()])
                columns = [
                    part.column(0),
                    pa.array([len(x) // 4 for x in got], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in got]),
                    pa.array([codec.decoded_sha256(x) for x in got]),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in got], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
        codec.forget()

    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    return own.mapInArrow(giving_back(run), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids)
