"""Token ids in a binary file format: Re-Pair grammar compression by shard.

Documents are dealt by ranges of doc_id and sorted; each task encodes whole texts, ends
every document with ``end_id`` and closes a shard at about ``SHARD_TOKENS`` ids. A shard is
compressed on its own by Re-Pair in rounds: count all pairs of neighbours inside documents,
replace the most frequent ones (left to right, where occurrences overlap) by new
nonterminals, and again until no pair occurs ``LEAST`` times. It stores

    magic, number of documents, rules and symbols, first nonterminal
    doc_ids            int64 x documents (nulls marked in a byte each)
    n_tokens           uint32 x documents
    symbol ends        uint32 x documents   -> one document decodes without the others
    rules              uint32 x 2 x rules, in order of creation
    expansion lengths  uint32 x rules
    symbols            uint16 or uint32

The files are Parquet rows (part, shard, first_token is derived, payload), written by Spark
so that any store will do; ``decode`` needs one payload only.

Defined cases: null text is empty, so its ids are the end id alone; repeated rows are
documents of their own; equal doc_ids are ordered by a hash of the text; a null doc_id sorts first; an
empty table writes no shard; further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prosemill.llm.common import blocks_for, fresh_path
from prosemill.llm.wordpieces import default_path, in_blocks, pieces_for

SHARD_TOKENS = 1 << 20
#: A pair is replaced as long as it occurs so often in its shard: a rule takes as much room as six to twelve symbols.
LEAST = 8
#: Characters of text encoded at once: new words are merged together, the more the cheaper.
PART = 1 << 21
MAGIC = b"RPG1"
_BINS = 20
FILES = "part int, shard int, n_docs long, n_tokens long, payload binary"


def frequent_pairs(key: np.ndarray, near: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of these are pairs that occur about ``least`` times or more, or an eighth as often as the most frequent; and these pairs, ascending.

    ``near`` counts each pair's bin.
    """
    most = int(near.max()) if len(near) else 0
    while most >= least:
        # Bins only sift: a bin may be frequent by several pairs, so that none may be left.
        where = np.flatnonzero(near >= max(least, most >> 3))
        line = np.sort(key[where])
        head = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
        count = np.diff(np.concatenate([head, [len(line)]]))
        best = np.flatnonzero(count >= max(least, most >> 3))
        if len(best):
            return where, line[head[best]]
        most >>= 3
    return np.zeros(0, np.int64), np.zeros(0, np.uint64)


def _bins(key: np.ndarray) -> np.ndarray:
    return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BINS)).view(np.int64)


def compress(ids: np.ndarray, ends: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Symbols, their ends by document, rules, first nonterminal.

    Repeats until no pair occurs ``least`` times: each round replaces all pairs that occur
    at least an eighth as often as the most frequent one. A pair of symbols only gets rarer
    after it has come up, so a place whose pair is too rare is not looked at again until one
    of its two symbols changes.
    """
    seq = ids.astype(np.uint32)
    base = int(seq.max()) + 1 if len(seq) else 1
    last = np.zeros(len(seq), bool)
    last[ends - 1] = True
    last[-1:] = True
    rules: list[np.ndarray] = []
    made = 0
    number = np.zeros(1 << _BINS, np.int32)
    open_ = np.flatnonzero(~last)
    while len(open_):
        key = (seq[open_].astype(np.uint64) << np.uint64(32)) | seq[open_ + 1]
        bins = _bins(key)
        near = np.bincount(bins, minlength=1 << _BINS)[bins]
        keep = near >= least
        open_, key, bins, near = open_[keep], key[keep], bins[keep], near[keep]
        where, chosen = frequent_pairs(key, near, least)
        if not len(chosen):
            break
        own = key[where]
        number[_bins(chosen)] = np.arange(len(chosen))
        which = np.minimum(number[bins[where]], len(chosen) - 1)
        # Another pair of the bin: it is looked up, if it was chosen at all.
        other = np.flatnonzero(chosen[which] != own)
        which[other] = np.minimum(np.searchsorted(chosen, own[other]), len(chosen) - 1)
        hit = chosen[which] == own
        where, which = open_[where[hit]], which[hit]
        # In a run of neighbouring occurrences every second one is taken, from the left.
        head = np.concatenate([[True], np.diff(where) != 1])
        start = np.maximum.accumulate(np.where(head, np.arange(len(where)), 0))
        take = (np.arange(len(where)) - start) % 2 == 0
        where, which = where[take], which[take]
        # A pair that its neighbours have used up gets no rule.
        used = np.bincount(which, minlength=len(chosen)) > 0
        which = (np.cumsum(used) - 1)[which]
        seq[where] = (base + made + which).astype(np.uint32)
        last[where] = last[where + 1]
        live = np.zeros(len(seq), bool)
        live[open_] = True
        live[where] = True
        live[where[where > 0] - 1] = True
        live &= ~last
        stays = np.ones(len(seq), bool)
        stays[where + 1] = False
        seq, last = seq[stays], last[stays]
        open_ = np.flatnonzero(live[stays])
        chosen = chosen[used]
        rules.append(np.stack([(chosen >> np.uint64(32)).astype(np.uint32), (chosen & np.uint64(0xFFFFFFFF)).astype(np.uint32)], 1))
        made += len(chosen)
    table = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    return seq, np.flatnonzero(last) + 1, table, base


def unfolded(rules: np.ndarray, base: int, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids below each nonterminal, one after the other, and where each begins; a rule refers to earlier ones only."""
    at = np.cumsum(lengths) - lengths
    flat = np.zeros(int(lengths.sum()), np.uint32)
    depth: list[int] = []
    for a, b in rules.tolist():
        depth.append(1 + max(depth[a - base] if a >= base else 0, depth[b - base] if b >= base else 0))
    depth, rules = np.array(depth, np.int64), rules.astype(np.int64)
    for d in range(1, int(depth.max()) + 1 if len(depth) else 0):
        own = np.flatnonzero(depth == d)
        to = at[own]
        for side in rules[own].T:
            deep = side >= base
            flat[to[~deep]] = side[~deep]
            child = side[deep] - base
            n = lengths[child]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            flat[np.repeat(to[deep], n) + step] = flat[np.repeat(at[child], n) + step]
            to = to + np.where(deep, lengths[np.where(deep, side - base, 0)], 1)
    return flat, at


def expanded_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    long: list[int] = []
    for a, b in rules.tolist():
        long.append((long[a - base] if a >= base else 1) + (long[b - base] if b >= base else 1))
    return np.array(long, np.int64)


def expansions(rules: np.ndarray, base: int) -> list[np.ndarray]:
    """The ids below each nonterminal."""
    flat, at = unfolded(rules, base, expanded_lengths(rules, base))
    return np.split(flat, at[1:]) if len(at) else []


def pack_shard(doc_ids: list, ids: list[np.ndarray], **options) -> bytes:
    sizes = np.array([len(x) for x in ids], np.int64)
    seq, ends, rules, base = compress(np.concatenate(ids), np.cumsum(sizes), **options)
    long = expanded_lengths(rules, base)
    wide = len(rules) + base > 1 << 16
    null = np.array([d is None or d != d for d in doc_ids])
    return b"".join(
        [
            MAGIC, struct.pack("<IIIIB", len(ids), len(rules), len(seq), base, wide), null.astype(np.uint8).tobytes(),
            np.array([0 if z else d for d, z in zip(doc_ids, null, strict=True)], "<i8").tobytes(), sizes.astype("<u4").tobytes(), ends.astype("<u4").tobytes(),
            rules.astype("<u4").tobytes(), long.astype("<u4").tobytes(), seq.astype("<u4" if wide else "<u2").tobytes(),
        ]
    )


class Shard:
    """Random access to the documents of one payload."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a token shard")
        docs, rules, symbols, self.base, wide = struct.unpack_from("<IIIIB", payload, 4)
        at = 4 + 17

        def read(kind: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(payload, kind, n, at)
            at += got.nbytes
            return got

        null, ids = read("u1", docs), read("<i8", docs)
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, null, strict=True)]
        self.n_tokens, self.ends = read("<u4", docs), read("<u4", docs).astype(np.int64)
        rule = read("<u4", 2 * rules).reshape(rules, 2)
        self.lengths = read("<u4", rules).astype(np.int64)
        self.symbols = read("<u4" if wide else "<u2", symbols)
        self.flat, self.at = unfolded(rule, self.base, self.lengths)

    def decode_all(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all documents, one after the other, and where each ends."""
        s = self.symbols.astype(np.int64)
        deep = s >= self.base
        size = np.where(deep, self.lengths[np.where(deep, s - self.base, 0)], 1) if len(self.lengths) else np.ones(len(s), np.int64)
        stop = np.cumsum(size)
        # Ids of plain symbols stand behind the expansions, so that one look-up serves both.
        both = np.concatenate([self.flat, np.arange(self.base, dtype=np.uint32)])
        at = np.where(deep, self.at[np.where(deep, s - self.base, 0)], len(self.flat) + s) if len(self.at) else len(self.flat) + s
        return both[np.repeat(at - (stop - size), size) + np.arange(int(stop[-1]))], np.cumsum(self.n_tokens, dtype=np.int64)

    def decode(self, k: int) -> np.ndarray:
        """The ids of document k of the shard, from its own symbols."""
        s = self.symbols[self.ends[k - 1] if k else 0 : self.ends[k]].astype(np.int64)
        deep = s >= self.base
        if not deep.any():
            return s.astype(np.uint32)
        r = np.where(deep, s - self.base, 0)
        size = np.where(deep, self.lengths[r], 1)
        stop = np.cumsum(size)
        out = np.empty(int(stop[-1]), np.uint32)
        out[(stop - size)[~deep]] = s[~deep]
        r, n, to = r[deep], size[deep], (stop - size)[deep]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(to, n) + step] = self.flat[np.repeat(self.at[r], n) + step]
        return out


def write_shards(docs: DataFrame, out_dir: str, tokenizer: str | None = None, end_id: int = 2, spaced: bool = False, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encodes all documents in ascending doc_id order and writes the shards under ``out_dir``."""
    path = tokenizer or default_path("word_bpe_49k.json")

    def encode(frames):
        pieces, part, shard = pieces_for(path, spaced), TaskContext.get().partitionId(), 0
        names: list = []
        ids: list[np.ndarray] = []
        size = 0
        end = np.array([end_id], np.uint32)

        def close():
            nonlocal names, ids, size, shard
            row = pd.DataFrame({"part": [part], "shard": [shard], "n_docs": [len(names)], "n_tokens": [size], "payload": [pack_shard(names, ids)]})
            names, ids, size, shard = [], [], 0, shard + 1
            return row

        for pdf in frames:
            texts = pdf["text"].tolist()
            known = [None if pd.isna(d) else int(d) for d in pdf["doc_id"]]
            for lo, hi in in_blocks(texts, PART):
                for d, x in zip(known[lo:hi], pieces.encode(texts[lo:hi]), strict=True):
                    names.append(d)
                    ids.append(np.concatenate([x, end]))
                    size += len(x) + 1
                    if size >= shard_tokens:
                        yield close()
        if names:
            yield close()

    # The hash parts rows that share a doc_id, or have none, among tasks.
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange(blocks_for(docs, 1), "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    rows.mapInPandas(encode, FILES).write.parquet(out_dir)


def read_digests(spark, out_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    files = spark.read.schema(FILES).parquet(out_dir)

    def decode(frames):
        for pdf in frames:
            for part, number, payload in zip(pdf["part"], pdf["shard"], pdf["payload"], strict=True):
                shard = Shard(payload)
                n = shard.n_tokens.astype(np.int64)
                flat, stop = shard.decode_all()
                raw = memoryview(flat.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (b - k) : 4 * b]) for b, k in zip(stop.tolist(), n.tolist(), strict=True)]
                yield pd.DataFrame(
                    {"part": part, "shard": number, "doc_id": pd.array(shard.doc_ids, "Int64"), "own": np.cumsum(n) - n, "n_tokens": n, "ids_crc32": np.array(crc, np.int64)}
                )

    # One row a shard: a table of sums, not of documents.
    before = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    base = files.select("part", "shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    rows = files.select("part", "shard", "payload").mapInPandas(decode, "part int, shard int, doc_id long, own long, n_tokens long, ids_crc32 long")
    return rows.join(base, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Writes the shards to the shared folder and returns the digests read back."""
    spark = docs.sparkSession
    out = fresh_path(spark, "tokens")
    write_shards(docs, out, **options)
    return read_digests(spark, out)
