"""Byte-level BPE encoding and decoding (operator 10).

A rank file (one base64 token and its rank a line) becomes a `tokenizers` BPE model over the
256 printable stand-ins of bytes. Every match of the split pattern is encoded on its own.
Encoding and decoding run over Arrow batches; the stand-in table turned around gives bytes back.

Defined cases: null text is the empty text (no ids, empty bytes); a repeated row gives a repeated
result; an empty table an empty result; other columns of the input play no part; special-token
strings in a text are ordinary text.
"""

from __future__ import annotations

import base64
import codecs
import functools
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, ids_and_texts

#: Pieces whose ids a task remembers; it starts anew when full, so memory is bounded and ids don't change.
MEMO_PIECES = 200_000
#: Longer pieces are never remembered.
MEMO_CHARS = 64


@functools.cache
def byte_chars() -> tuple[str, ...]:
    """The stand-in of each byte: itself where it prints in Latin-1, else the next free character from 256 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return tuple(chr(b) if b in prints else chr(next(rest)) for b in range(256))


@functools.cache
def char_bytes() -> dict[str, int]:
    """byte_chars() the other way round."""
    return {c: b for b, c in enumerate(byte_chars())}


def parse_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


@dataclass
class Codec:
    """One vocabulary: encoder, decoder and the split pattern."""

    ranks: dict[bytes, int]
    pattern: str

    def __post_init__(self) -> None:
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        stand_in = "".join(byte_chars())
        spell = lambda b: "".join(map(stand_in.__getitem__, b))
        merges = [
            (spell(token[:cut]), spell(token[cut:]))
            for token, _ in sorted(self.ranks.items(), key=lambda x: x[1])
            for cut in range(1, len(token))
            if token[:cut] in self.ranks and token[cut:] in self.ranks
        ]
        self.model = Tokenizer(BPE(vocab={spell(b): i for b, i in self.ranks.items()}, merges=merges))
        self.split = regex.compile(self.pattern)
        # the decoder goes back from the model's own spelling of each id
        table = char_bytes()
        self.token_bytes = {i: bytes(map(table.__getitem__, s)) for s, i in self.model.get_vocab(with_added_tokens=False).items()}
        self.spelling = str.maketrans(dict(enumerate(byte_chars())))
        self.memo: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        return self.split.findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        found = [self.pieces(t) for t in texts]
        memo = self.memo
        if len(memo) > MEMO_PIECES:
            memo.clear()
        fresh = list({p for pieces in found for p in pieces if p not in memo})
        spelled = [p.encode("utf-8").decode("latin-1").translate(self.spelling) for p in fresh]
        once = {}
        for piece, got in zip(fresh, self.model.encode_batch_fast(spelled, add_special_tokens=False), strict=True):
            ids = np.asarray(got.ids, "<u4").tobytes()
            if len(piece) <= MEMO_CHARS:
                memo[piece] = ids
            else:
                once[piece] = ids
        if once:
            return [b"".join([memo[p] if p in memo else once[p] for p in pieces]) for pieces in found]
        return [b"".join(map(memo.__getitem__, pieces)) for pieces in found]

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(packed, "<u4").tolist()))

    def decode_text(self, packed: bytes) -> list[str]:
        """The text that each id completes: a character split over ids appears with the id that ends it."""
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        out = [decoder.decode(self.token_bytes[i]) for i in np.frombuffer(packed, "<u4").tolist()]
        if out:
            out[-1] += decoder.decode(b"", final=True)
        return out

    def offsets(self, text: str, packed: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First and end code point of each id; an id that holds part of a character spans that character."""
        raw = np.frombuffer(text.encode("utf-8"), np.uint8)
        char_of = np.cumsum((raw & 0xC0) != 0x80) - 1
        ends = np.cumsum([len(self.token_bytes[i]) for i in np.frombuffer(packed, "<u4").tolist()], dtype=np.int64)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        return (char_of[starts], char_of[ends - 1] + 1) if len(ends) else (starts, ends)


_codecs: dict[tuple[str, str], Codec] = {}


def codec_for(path: str, pattern: str) -> Codec:
    """The codec of a rank file that every machine has installed; built once a process."""
    if (path, pattern) not in _codecs:
        with open(path, "rb") as lines:
            _codecs[path, pattern] = Codec(parse_ranks(lines), pattern)
    return _codecs[path, pattern]


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def _task_codec(path: str | None, pattern: str | None) -> Codec:
    """path None: the installed default of the machine that runs the task."""
    own = default_vocabulary()
    return codec_for(path or own[0], pattern or own[1])


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None, offsets: bool = False) -> DataFrame:
    """(id, ids binary: little-endian unsigned 32-bit[, starts, ends: code points]) for every row of docs."""
    schema = [pa.field("key", pa.int64()), pa.field("ids", pa.binary())]
    if offsets:
        schema += [pa.field("starts", pa.list_(pa.int64())), pa.field("ends", pa.list_(pa.int64()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _task_codec(path, pattern)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                pairs = []
                size = 0
                for pair in ids_and_texts(batch):
                    pairs.append(pair)
                    size += len(pair[1])
                    if size > 1 << 20:
                        yield from done(pairs)
                        pairs, size = [], 0
                yield from done(pairs)

        def done(pairs: list[tuple[object, str]]) -> Iterator[tuple]:
            for (key, text), ids in zip(pairs, codec.encode([t for _, t in pairs]), strict=True):
                yield (key, ids, *map(np.ndarray.tolist, codec.offsets(text, ids))) if offsets else (key, ids)

        yield from bounded(rows(), pa.schema(schema))

    more = ", starts array<bigint>, ends array<bigint>" if offsets else ""
    out = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"key bigint, ids binary{more}")
    return out.withColumnRenamed("key", id_col)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id, ids, decoded binary): the bytes of the ids, which are UTF-8 again when the ids are a whole text."""
    schema = pa.schema([("key", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _task_codec(path, pattern)
        rows = (
            (key, ids or b"", codec.decode(ids or b""))
            for batch in batches
            for at in range(0, batch.num_rows, 512)
            for key, ids in zip(*(c.to_pylist() for c in batch.slice(at, 512).columns), strict=True)
        )
        yield from bounded(rows, schema)

    out = encoded.select(F.col(id_col).alias("key"), F.col(ids_col).alias("ids")).mapInArrow(run, "key bigint, ids binary, decoded binary")
    return out.withColumnRenamed("key", id_col).withColumnRenamed("ids", ids_col)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None, as_list: bool = False) -> DataFrame:
    """(id, ids, decoded): each text encoded, and the ids that came out decoded, in one pass.

    ids are packed, or an array<int> with as_list. One pass needs one Python worker a core with one
    vocabulary; encode() and decode() in a row would hold two of each.
    """
    schema = pa.schema([("key", pa.int64()), ("ids", pa.list_(pa.int32()) if as_list else pa.binary()), ("decoded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _task_codec(path, pattern)

        def done(keys: list, texts: list[str]) -> pa.RecordBatch:
            packed = codec.encode(texts)
            ids = pa.array(packed, pa.binary())
            if as_list:
                ends = np.cumsum([0, *(len(p) // 4 for p in packed)], dtype=np.int32)
                ids = pa.ListArray.from_arrays(ends, np.frombuffer(b"".join(packed), "<u4").astype(np.int32))
            return pa.record_batch([pa.array(keys, pa.int64()), ids, pa.array([codec.decode(p) for p in packed], pa.binary())], schema=schema)

        for batch in batches:
            keys, texts, size = [], [], 0
            for key, text in ids_and_texts(batch):
                keys.append(key)
                texts.append(text)
                size += len(text)
                if size > 1 << 20:
                    yield done(keys, texts)
                    keys, texts, size = [], [], 0
            if keys:
                yield done(keys, texts)

    ddl = f"key bigint, ids {'array<int>' if as_list else 'binary'}, decoded binary"
    out = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, ddl)
    return out.withColumnRenamed("key", id_col)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", step: Callable[..., DataFrame] = round_trip) -> DataFrame:
    """The contract's columns from a round trip over all of docs."""
    return step(docs, id_col, text_col).select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
