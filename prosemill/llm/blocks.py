"""Which values does a document share with others? Asked and answered by blocks of documents.

A scan task cuts its documents into blocks of about ``BLOCK`` bytes of text. Each block sends
its distinct values, sorted, to buckets by value: one entry a block, however many of its
documents have the value, so a value in a third of all documents is one entry a block. A
bucket answers each block in the order of its entries, and the answer meets the block's texts
again by block number. Nothing of this passes through the driver.

Blocks are numbered by task and order. Both scans must cut alike: documents that do not come
straight from files are written first (``stable``), and every answer carries its block's
checksum, so that a difference raises.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosemill.llm.common import blocks_for, forget, materialize, trim

BLOCK = 1 << 22
MOST_DOCS = 60_000
ASKED = "bucket int, block long, crc long, payload binary"
ANSWERED = "block long, bucket int, crc long, payload binary"
TEXTS = "block long, payload binary"


class Block:
    """Documents of one block: ids (with a mask of those not null) and texts; a null text has no words."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, texts: list[bytes]):
        self.ids, self.known, self.texts = ids, known, texts
        self.raw = b" ".join(texts)
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))

    @property
    def crc(self) -> int:
        return zlib.crc32(self.raw, zlib.crc32(self.ids.tobytes()))

    def words(self, hasher) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and the number of the first word of each document (and of the end)."""
        h, start, _ = hasher(self.raw)
        at = np.cumsum(self.sizes + 1) - (self.sizes + 1)
        return h, np.concatenate([np.searchsorted(start, at), [len(h)]]).astype(np.int64)

    def pack(self) -> bytes:
        head = np.uint32(len(self.ids)).tobytes() + self.ids.astype("<i8").tobytes() + self.known.astype("u1").tobytes() + self.sizes.astype("<u4").tobytes()
        return head + zstandard.ZstdCompressor(level=1).compress(self.raw)

    @classmethod
    def unpack(cls, payload: bytes) -> Block:
        n = int(np.frombuffer(payload, "<u4", 1)[0])
        ids = np.frombuffer(payload, "<i8", n, 4)
        known = np.frombuffer(payload, "u1", n, 4 + 8 * n).astype(bool)
        sizes = np.frombuffer(payload, "<u4", n, 4 + 9 * n).astype(np.int64)
        raw = zstandard.ZstdDecompressor().decompress(payload[4 + 13 * n :])
        at = np.cumsum(sizes + 1) - (sizes + 1)
        return cls(ids, known, [raw[a : a + s] for a, s in zip(at.tolist(), sizes.tolist(), strict=True)])


def blocks_of(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[tuple[int, Block]]:
    """Cuts (doc_id, text) rows into blocks; a block ends with the row that fills it, whatever the batches."""
    forget()
    first, number = TaskContext.get().partitionId() << 32, 0
    ids: list[np.ndarray] = []
    known: list[np.ndarray] = []
    texts: list[bytes] = []
    held = 0

    def close() -> tuple[int, Block]:
        nonlocal ids, known, texts, held, number
        out = first + number, Block(np.concatenate(ids), np.concatenate(known), texts)
        ids, known, texts, held, number = [], [], [], 0, number + 1
        return out

    for batch in batches:
        column = batch.column(1).cast(pa.binary())
        sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        lo, n = 0, len(column)
        while lo < n:
            gone = int(sizes[lo - 1]) if lo else 0
            hi = min(int(np.searchsorted(sizes, gone + size - held)) + 1, n, lo + MOST_DOCS - len(texts))
            part = batch.column(0).slice(lo, hi - lo)
            known.append(pc.is_valid(part).to_numpy(zero_copy_only=False))
            ids.append(pc.fill_null(part, 0).to_numpy(zero_copy_only=False).astype(np.int64))
            texts += [t or b"" for t in column.slice(lo, hi - lo).to_pylist()]
            held += int(sizes[hi - 1]) - gone
            if held >= size or len(texts) >= MOST_DOCS:
                yield close()
            lo = hi
    if texts:
        yield close()
    trim()


def stable(docs: DataFrame) -> DataFrame:
    """doc_id and text, from files: the same rows in the same tasks whenever they are read."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    if docs.inputFiles() and not re.search(r"Join|Aggregate|Repartition|Sort|Sample|Limit|Window|Distinct|Union|Python|Pandas|Arrow|Generate", plan):
        return docs
    return materialize(docs, "documents")


def buckets_for(docs: DataFrame) -> int:
    return blocks_for(docs)


def dealt(values: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's values begin among these ascending ones (and the end)."""
    edges = [-(-(b << 32) // buckets) << 32 for b in range(buckets)]
    return np.concatenate([np.searchsorted(values, np.array(edges, np.uint64)), [len(values)]])


def asked(number: int, crc: int, values: np.ndarray, buckets: int, entry: Callable[[slice], bytes]) -> pa.RecordBatch:
    """A block's message to each bucket that it has values for; ``entry`` packs a range of its ascending values."""
    cut = dealt(values, buckets)
    to = np.flatnonzero(np.diff(cut))
    return pa.record_batch(
        [pa.array(to, pa.int32()), pa.array(np.full(len(to), number)), pa.array(np.full(len(to), crc)), pa.array([entry(slice(cut[b], cut[b + 1])) for b in to.tolist()], pa.binary())],
        names=["bucket", "block", "crc", "payload"],
    )


def questions(docs: DataFrame, ask: Callable[[int, Block], pa.RecordBatch], size: int = BLOCK) -> DataFrame:
    """What all blocks ask."""
    return docs.mapInArrow(lambda batches: (ask(n, b) for n, b in blocks_of(batches, size)), ASKED)


def answers(asked_rows: DataFrame, answer: Callable[[list[bytes]], list[bytes]], tag: str) -> DataFrame:
    """Each bucket sees all its messages at once and answers each; written, since answers are small and read more than once."""

    def run(table: pa.Table) -> pa.Table:
        out = answer(table.column("payload").to_pylist())
        trim()
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "crc": table.column("crc"), "payload": pa.array(out, pa.binary())})

    return materialize(asked_rows.groupBy("bucket").applyInArrow(run, ANSWERED), tag)


def texts_of(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """The blocks themselves, their texts compressed."""

    def run(batches):
        for n, b in blocks_of(batches, size):
            yield pa.record_batch([pa.array([n]), pa.array([b.pack()], pa.binary())], names=["block", "payload"])

    return docs.mapInArrow(run, TEXTS)


def met(texts: DataFrame, answered: DataFrame, work: Callable[[int, Block, dict[str, list[bytes]]], pa.Table], schema: str) -> DataFrame:
    """``work`` gets each block with the answers to it, in the order of the buckets, by the column ``kind``."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows != 1:
            raise RuntimeError("a block was cut differently when read again")
        number, block = left.column("block")[0].as_py(), Block.unpack(left.column("payload")[0].as_py())
        if right.num_rows and pc.unique(right.column("crc")).to_pylist() != [block.crc]:
            raise RuntimeError("a block holds other texts when read again")
        own: dict[str, list[bytes]] = {}
        for row in right.select(["kind", "payload"]).take(pc.sort_indices(right.column("bucket"))).to_pylist():
            own.setdefault(row["kind"], []).append(row["payload"])
        out = work(number, block, own)
        trim()
        return out

    return texts.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(run, schema)
