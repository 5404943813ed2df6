"""Substring dedup by difference-cover anchors.

A window is ``WINDOW`` = 13 consecutive words. Positions modulo 7 in {0, 1, 3} form a
difference cover: for any two positions some shift below 7 brings both into it. So two equal
13-word windows, wherever they start, share an equal 7-word anchor that lies at a cover
position in both documents and at the same place in both windows. Only these three in seven
positions are hashed.

1. Blocks of documents ask buckets whether another document has each of their anchors
   (``blocks.py``), one entry a block.
2. A shared anchor is extended by word hashes to both sides, to the windows that hold it:
   six words to the left, five and one, ..., six to the right. The extended windows meet in
   buckets again, one entry a block, and the smallest doc_id with the same words answers.
   An anchor that stands in the same place of both windows is all that two documents need
   to meet, so all windows that any of their shared anchors reaches are compared, and no
   others.
3. A window that a smaller doc_id has, in another block or in its own, is a repeat; words
   under repeats are removed from the text, which is read once more for it.

Windows are judged on the input. They are compared by 64-bit hashes of their words, so that
over 10^13 windows a few collisions in 10^6 are to be expected.

Defined cases: null text has no words; texts of fewer than 13 words lose none; repeated rows
with one doc_id do not repeat each other (no doc_id is smaller); a null doc_id neither loses
words nor takes any from others; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosemill.llm.blocks import ASKED, Block, answers, asked, buckets_for, met, questions, stable, texts_of

from prosemill.llm.words import WordHasher, run_hashes

WINDOW, PERIOD, COVER = 13, 7, (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


class Anchors:
    """The anchors of a block: word hashes, first words of documents, positions and hashes of anchors, and their distinct values."""

    def __init__(self, block: Block):
        self.h, self.first = block.words(WordHasher())
        size = np.diff(self.first)
        self.who = np.repeat(np.arange(len(size)), size)
        self.stop = self.first[1:][self.who] if len(self.h) else np.zeros(0, np.int64)
        own = np.arange(len(self.h)) - self.first[self.who] if len(self.h) else np.zeros(0, np.int64)
        # A text shorter than a window, or a document without a name, takes no part.
        part = ((size >= WINDOW) & block.known)[self.who]
        at = np.arange(len(self.h))
        self.at = np.flatnonzero(part & np.isin(own % PERIOD, COVER) & (at + ANCHOR <= self.stop))
        value = run_hashes(self.h, self.at, ANCHOR)
        order = np.argsort(value)
        line = value[order]
        head = np.concatenate([np.ones(min(1, len(line)), bool), line[1:] != line[:-1]])
        self.values = line[head]
        self.which = np.empty(len(line), np.int64)
        self.which[order] = np.cumsum(head) - 1
        doc, begin = block.ids[self.who[self.at[order]]], np.flatnonzero(head)
        #: Do two documents of this block have it?
        self.many = np.minimum.reduceat(doc, begin) != np.maximum.reduceat(doc, begin) if len(begin) else np.zeros(0, bool)

    def extended(self, block: Block, answer: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, documents and numbers of the windows around shared anchors; the distinct windows, ascending, with their smallest doc_id here."""
        shared = self.many | _bits(answer, self.values)
        start = self.at[shared[self.which]]
        reach = np.zeros(len(self.h) + 1, bool)
        for left in range(PERIOD):
            p = start - left
            p = p[(p >= 0) & (start + ANCHOR + (PERIOD - 1 - left) <= self.stop[start])]
            reach[p] = True
        at = np.flatnonzero(reach)
        at = at[at + WINDOW <= self.stop[at]]
        value = run_hashes(self.h, at, WINDOW)
        order = np.argsort(value)
        line = value[order]
        head = np.concatenate([np.ones(min(1, len(line)), bool), line[1:] != line[:-1]])
        which = np.empty(len(line), np.int64)
        which[order] = np.cumsum(head) - 1
        doc = block.ids[self.who[at]]
        least = np.minimum.reduceat(doc[order], np.flatnonzero(head)) if len(line) else np.zeros(0, np.int64)
        return at, doc, which, line[head], least


def _bits(answer: list[bytes], values: np.ndarray) -> np.ndarray:
    """Answers of one bit an entry, bucket after bucket; each message begins with its number of entries."""
    parts = [np.unpackbits(np.frombuffer(x, "u1", -1, 4), count=int(np.frombuffer(x, "<u4", 1)[0])) for x in answer]
    out = np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)
    if len(out) != len(values):
        raise RuntimeError("answers do not fit their block")
    return out


def _packed(flags: np.ndarray) -> bytes:
    return np.uint32(len(flags)).tobytes() + np.packbits(flags).tobytes()


def ask_anchors(docs: DataFrame, buckets: int) -> DataFrame:
    def ask(number: int, block: Block) -> pa.RecordBatch:
        a = Anchors(block)
        cut = (a.values & np.uint64(0xFFFFFFFF)).astype("<u4")
        return asked(number, block.crc, a.values, buckets, lambda s: np.uint32(s.stop - s.start).tobytes() + cut[s].tobytes() + np.packbits(a.many[s]).tobytes())

    return questions(docs, ask)


def shared_anchors(messages: list[bytes]) -> list[bytes]:
    """Anchors that two blocks have. Entries are cut to 32 bits within their bucket: a collision extends an anchor for nothing."""
    sizes = [int(np.frombuffer(m, "<u4", 1)[0]) for m in messages]
    cut = np.concatenate([np.frombuffer(m, "<u4", n, 4) for m, n in zip(messages, sizes, strict=True)])
    order = np.argsort(cut, kind="stable")
    line = cut[order]
    same = line[1:] == line[:-1]
    out = np.zeros(len(cut), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    stop = np.cumsum(sizes).tolist()
    return [_packed(out[b - n : b]) for b, n in zip(stop, sizes, strict=True)]


def _window_entry(values: np.ndarray, least: np.ndarray) -> bytes:
    """Windows by document, the document's number stored once: windows of a document mostly come together."""
    order = np.argsort(least, kind="stable")
    doc, n = np.unique(least, return_counts=True)
    return b"".join([np.uint32(len(values)).tobytes(), np.uint32(len(doc)).tobytes(), doc.astype("<i8").tobytes(), n.astype("<u4").tobytes(), values[order].astype("<u8").tobytes()])


def _window_rows(message: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, docs = np.frombuffer(message, "<u4", 2).tolist()
    doc = np.frombuffer(message, "<i8", docs, 8)
    times = np.frombuffer(message, "<u4", docs, 8 + 8 * docs)
    return np.frombuffer(message, "<u8", n, 8 + 12 * docs), np.repeat(doc, times)


def earlier_windows(messages: list[bytes]) -> list[bytes]:
    """Windows that a smaller doc_id of another block has, in ascending order of each message's windows."""
    rows = [_window_rows(m) for m in messages]
    value, doc = (np.concatenate(x) for x in zip(*rows, strict=True))
    order = np.argsort(value)
    line = value[order]
    head = np.concatenate([[True], line[1:] != line[:-1]])
    least = np.minimum.reduceat(doc[order], np.flatnonzero(head))
    late = np.empty(len(value), bool)
    late[order] = doc[order] > least[np.cumsum(head) - 1]
    out, lo = [], 0
    for v, _ in rows:
        out.append(_packed(late[lo : lo + len(v)][np.argsort(v)]))
        lo += len(v)
    return out


def ask_windows(texts: DataFrame, anchors: DataFrame, buckets: int) -> DataFrame:
    def ask(number: int, block: Block, own: dict[str, list[bytes]]) -> pa.Table:
        _, _, _, values, least = Anchors(block).extended(block, own.get("anchors", []))
        return pa.Table.from_batches([asked(number, block.crc, values, buckets, lambda s: _window_entry(values[s], least[s]))])

    return met(texts, anchors, ask, ASKED)


def _cut(_: int, block: Block, own: dict[str, list[bytes]]) -> pa.Table:
    a = Anchors(block)
    at, doc, which, values, least = a.extended(block, own.get("anchors", []))
    late = _bits(own.get("windows", []), values)
    start = at[late[which] | (doc > least[which])]
    edge = np.zeros(len(a.h) + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + WINDOW, -1)
    gone = np.cumsum(edge)[:-1] > 0
    total = np.diff(a.first)
    lost = np.add.reduceat(np.append(gone, False).astype(np.int64), a.first[:-1]) * (total > 0)
    sha, kept = [], []
    for i, text in enumerate(block.texts):
        words = text.split()
        if lost[i]:
            stay = np.flatnonzero(~gone[a.first[i] : a.first[i + 1]])
            left = b" ".join([words[k] for k in stay.tolist()])
            kept.append(left)
        else:
            left = b" ".join(words)
            kept.append(None)
        sha.append(hashlib.sha256(left).hexdigest())
    return pa.table(
        {
            "doc_id": pa.array(block.ids, mask=~block.known), "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(lost, pa.int64()),
            "kept_sha256": pa.array(sha, pa.string()), "kept": pa.array(kept, pa.binary()).cast(pa.string()),
        }
    )


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the text left, null where nothing was removed)."""
    docs = stable(docs)
    buckets = buckets_for(docs)
    anchors = answers(ask_anchors(docs, buckets), shared_anchors, "anchors").withColumn("kind", F.lit("anchors"))
    windows = answers(ask_windows(texts_of(docs), anchors, buckets), earlier_windows, "windows").withColumn("kind", F.lit("windows"))
    return met(texts_of(docs), anchors.unionByName(windows), _cut, RESULT)
