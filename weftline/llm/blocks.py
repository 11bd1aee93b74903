"""Blocks of documents and exact corpus-wide totals for their hashed features.

Some operators need, for every feature of every document (an n-gram, a window), its total over the
corpus. Shuffling a row for each feature would cost many times the text. Here documents are packed
into blocks of bounded size, and a block sends, for each stretch of the hash range, one compressed
list of its distinct features in ascending order; the totals come back in the same order, without the
features. A feature is sent once a block however often it occurs, and hash stretches are equally full and
as many as bound a group to about GROUP_ENTRIES entries at any size, besides those of its commonest
feature, one a block; blocks grow with the corpus so that there are a few million of them at 100 TB.

Blocks are written to the shared folder once: their bounds are data then, the same for every later
pass and retry.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Entries that one group of `totals` may expect.
GROUP_ENTRIES = 2_000_000
BLOCK_DDL = "block bigint, n_words bigint, payload binary"
REPLY_DDL = "block bigint, part int, payload binary, n_distinct bigint, n_all bigint"

_DOCS = pa.schema([("doc_id", pa.int64()), ("text", pa.binary())])


def pack(docs: DataFrame, id_col: str, text_col: str, least_bytes: int) -> DataFrame:
    """(block, n_words, payload): documents in order of their input split, about block_bytes_for(all text) a block."""
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    block_bytes = block_bytes_for(total, least_bytes)
    schema = pa.schema([("block", pa.int64()), ("n_words", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        made, ids, texts, size = 0, [], [], 0

        def done() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, _DOCS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(pa.record_batch([pa.array(ids, pa.int64()), pa.array(texts, pa.binary())], schema=_DOCS))
            words = sum(len(t.split()) for t in texts)
            return pa.record_batch([pa.array([first + made]), pa.array([words]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for key, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    ids.append(key)
                    texts.append(text or b"")
                    size += len(texts[-1])
                    if size >= block_bytes:
                        yield done()
                        made, ids, texts, size = made + 1, [], [], 0
        if ids:
            yield done()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return written(rows.mapInArrow(run, BLOCK_DDL))


def unpack(payload: bytes) -> tuple[list[int | None], list[bytes]]:
    """Ids and texts of a block."""
    table = pa.ipc.open_stream(payload).read_all()
    return table.column("doc_id").to_pylist(), table.column("text").to_pylist()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def multipliers(n: int, seed: int) -> np.ndarray:
    """Fixed odd numbers for sums of hashes modulo 2^64."""
    return np.array([xxhash.xxh3_64_intdigest(b"%d" % k, seed) | 1 for k in range(n)], np.uint64)


def scrambled(x: np.ndarray) -> np.ndarray:
    """A one-to-one mix, so that the high bits are even."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# --- lists on the wire ---------------------------------------------------------------------------


def squeeze(x: np.ndarray) -> bytes:
    """Numbers as byte planes, compressed: planes of zeros cost nothing."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), codec="zstd", asbytes=True)


def unsqueeze(data: bytes, n: int, dtype: type) -> np.ndarray:
    item = np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.decompress(data, n * item, codec="zstd", asbytes=True), np.uint8).reshape(item, n)
    return np.ascontiguousarray(planes.T).view(dtype).reshape(n)


def send(high: np.ndarray, low: np.ndarray | None, counts: np.ndarray) -> bytes:
    """An ascending list of keys (one or two words each) with their counts."""
    steps = np.diff(high, prepend=np.uint64(0))
    parts = [squeeze(steps), squeeze(low) if low is not None else b"", squeeze(counts.astype(np.uint32))]
    return b"".join([np.array([len(high), *map(len, parts)], "<u8").tobytes(), *parts])


def receive(data: bytes) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    n, a, b, c = np.frombuffer(data[:32], "<u8").tolist()
    high = np.cumsum(unsqueeze(data[32 : 32 + a], n, np.uint64), dtype=np.uint64)
    low = unsqueeze(data[32 + a : 32 + a + b], n, np.uint64) if b else None
    return high, low, unsqueeze(data[32 + a + b : 32 + a + b + c], n, np.uint32)


def distinct(high: np.ndarray, low: np.ndarray | None = None, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]:
    """(keys ascending, their second words, summed weights, place of each input among them)."""
    order = np.argsort(high, kind="stable") if low is None else np.lexsort((low, high))
    h = high[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    if low is not None:
        lw = low[order]
        new[1:] |= lw[1:] != lw[:-1]
    place = np.empty(len(h), np.int64)
    place[order] = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    sums = (np.add.reduceat(weight[order], at) if len(at) else np.empty(0, np.int64)) if weight is not None else np.diff(np.append(at, len(h)))
    return h[at], None if low is None else lw[at], sums, place


def parts_for(entries: int) -> int:
    """Stretches of the hash range for so many entries of a kind, a power of two."""
    parts = 1
    while parts * GROUP_ENTRIES < entries:
        parts *= 2
    return parts


def block_bytes_for(total: int, least: int, most: int = 32 << 20) -> int:
    """Text in a block: `least`, with a large corpus as much as makes a million blocks, but no more than `most`.

    A key has one entry a block at most, so fewer blocks bound what the commonest key adds to its stretch, and
    larger ones leave more entries to a list where there are many stretches.
    """
    return max(least, min(most, total >> 20))


Extract = Callable[[list[int | None], list[bytes], list[bytes]], list[tuple[np.ndarray, np.ndarray | None, np.ndarray]]]


def totals(blocks: DataFrame, extract: Extract, entries: int, kinds: int, recurs: bool, replies: DataFrame | None = None) -> DataFrame:
    """(block, part, payload, n_distinct, n_all): what came back for each block and stretch of the hash range.

    extract(ids, texts, earlier payloads) gives, for each kind, the block's ascending distinct keys and
    counts. entries: how many to expect of a kind over all blocks. recurs: the payload says whether a
    key's total is two or more (one bit each), else it holds the totals. A row with a null block gives a
    part's number of distinct keys whose total isn't zero, and the sum of all totals. replies: earlier answers that extract needs.
    """
    parts = parts_for(entries)
    shift = np.uint64(64 - (parts.bit_length() - 1)) if parts > 1 else None
    sent = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("payload", pa.binary())])
    back = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("payload", pa.binary()), ("n_distinct", pa.int64()), ("n_all", pa.int64())])

    def lists(block: int, payload: bytes, earlier: list[bytes]) -> pa.Table:
        rows = []
        for kind, (high, low, counts) in enumerate(extract(*unpack(payload), earlier)):
            stretch = (high >> shift).astype(np.int64) if shift is not None else np.zeros(len(high), np.int64)
            cuts = np.append(np.flatnonzero(np.diff(stretch, prepend=-1)), len(high))  # only stretches that the block has
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                rows.append((block, kind * parts + int(stretch[a]), send(high[a:b], None if low is None else low[a:b], counts[a:b])))
        columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, sent, strict=True)], schema=sent)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from lists(block, payload.as_py(), []).to_batches()

    def answered(block_rows: pa.Table, reply_rows: pa.Table) -> pa.Table:
        if not block_rows.num_rows:
            return pa.Table.from_arrays([pa.array([], f.type) for f in sent], schema=sent)
        return lists(block_rows.column("block")[0].as_py(), block_rows.column("payload")[0].as_py(), ordered(reply_rows))

    def summed(rows: pa.Table) -> pa.Table:
        got = [receive(x.as_py()) for x in rows.column("payload")]
        sizes = [len(g[0]) for g in got]
        low = None if got[0][1] is None else np.concatenate([g[1] for g in got])
        _, _, sums, place = distinct(np.concatenate([g[0] for g in got]), low, np.concatenate([g[2] for g in got]).astype(np.int64))
        said = (sums > 1)[place] if recurs else np.minimum(sums, 0xFFFFFFFF).astype(np.uint32)[place]
        ends = np.cumsum(sizes)
        payloads = [pack_reply(said[e - n : e]) for n, e in zip(sizes, ends, strict=True)]
        part = rows.column("part")[0].as_py()
        return pa.Table.from_arrays([
            pa.array([*rows.column("block").to_pylist(), None], pa.int64()), pa.array([part] * (len(sizes) + 1), pa.int32()),
            pa.array([*payloads, None], pa.binary()), pa.array([None] * len(sizes) + [int((sums > 0).sum())], pa.int64()),
            pa.array([None] * len(sizes) + [int(sums.sum())], pa.int64()),
        ], schema=back)

    if replies is None:
        lists_of = blocks.select("block", "payload").mapInArrow(alone, "block bigint, part int, payload binary")
    else:
        lists_of = with_replies(blocks, replies, answered, "block bigint, part int, payload binary")
    return written(lists_of.groupBy("part").applyInArrow(summed, REPLY_DDL))


def pack_reply(said: np.ndarray) -> bytes:
    kind = b"b" if said.dtype == bool else b"n"
    body = pa.compress(np.packbits(said).tobytes(), codec="zstd", asbytes=True) if said.dtype == bool else squeeze(said)
    return kind + np.array([len(said)], "<u8").tobytes() + body


def open_reply(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data[1:9], "<u8")[0])
    if data[:1] == b"b":
        return np.unpackbits(np.frombuffer(pa.decompress(data[9:], (n + 7) // 8, codec="zstd", asbytes=True), np.uint8), count=n).astype(bool)
    return unsqueeze(data[9:], n, np.uint32)


def ordered(reply_rows: pa.Table) -> list[bytes]:
    """Payloads in the order of their stage and part, which is that of the keys they answer."""
    keys = reply_rows.column("part").to_pylist()
    payloads = reply_rows.column("payload")
    return [payloads[i].as_py() for i in sorted(range(len(keys)), key=keys.__getitem__)]


def with_replies(blocks: DataFrame, replies: DataFrame, fn: Callable[[pa.Table, pa.Table], pa.Table], ddl: str) -> DataFrame:
    """fn over each block and its replies; blocks are single rows, so every group is of bounded size."""
    answers = replies.where(F.col("block").isNotNull()).select("block", "part", "payload")
    return blocks.select("block", "payload").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(fn, ddl)
