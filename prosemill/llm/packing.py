"""Packing documents into sequences of at most ``capacity`` tokens by column generation.

Each document is cut into whole sequences and one remainder. Remainders are put into length
classes of ``width`` tokens, and the cutting-stock problem over the histogram of classes is
solved on the driver (its size is a parameter, not the data's): a linear program whose
columns are patterns, priced by an unbounded-knapsack dynamic program over the duals. The
rounded-down patterns are dealt to documents by their rank within the class. What rounding
leaves over is at most one pattern's worth for each pattern, so a bounded number of
documents; these are laid end to end and cut wherever a sequence is full.

Ranks, prefix sums and offsets come from aggregates over (class, bucket), so no window holds
a class as a whole. Sequence ids: whole sequences first, then patterns, then the rest.

Defined cases: null text is empty, its ids are the end id alone; repeated rows are packed
each; a null doc_id is packed like any other; an empty table gives no pieces; further
columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prosemill.llm.common import in_parts, materialize
from prosemill.llm.wordpieces import default_path, pieces_for

CAPACITY = 2048
WIDTH = 8
BUCKETS = 512
PIVOTS = 3000
MEASURED = "doc_id long, h long, n_tokens long, rem long, rem_crc long, crcs array<long>"
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def knapsack(value: np.ndarray, size: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of items of these sizes (ascending) within the capacity."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1, np.int64)
    upto = np.searchsorted(size, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := upto[c]:
            v = best[c - size[:k]] + value[:k]
            i = int(v.argmax())
            if v[i] > best[c] + 1e-12:
                best[c], took[c] = v[i], i
    pattern, c = np.zeros(len(size), np.int64), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            pattern[took[c]] += 1
            c -= size[took[c]]
    return float(best[capacity]), pattern


def cutting_patterns(sizes: list[int], demand: list[int], capacity: int, pivots: int = PIVOTS) -> list[tuple[np.ndarray, int]]:
    """Patterns (items of each size) and how often each is used, rounded down; never more items than demanded.

    Revised simplex on min sum(x), A x = d; a surplus column enters where a dual is negative.
    Rounding errors or an early stop cost sequences, never correctness: uses are clamped to the demand.
    """
    size, d = np.array(sizes, np.int64), np.array(demand, np.float64)
    m = len(size)
    if not m:
        return []
    cols = [np.where(np.arange(m) == i, capacity // size[i], 0).astype(np.float64) for i in range(m)]
    cost = np.ones(m)
    basis = [c.copy() for c in cols]
    inverse = np.diag([1.0 / cols[i][i] for i in range(m)])
    x = d * np.diag(inverse)
    for _ in range(pivots):
        dual = np.einsum("i,ij->j", cost, inverse)
        low = int(dual.argmin())
        if dual[low] < -1e-9:
            enter, price = -np.eye(m)[low], 0.0
        else:
            worth, pattern = knapsack(np.maximum(dual, 0), size, capacity)
            if worth <= 1 + 1e-7:
                break
            enter, price = pattern.astype(np.float64), 1.0
        move = np.einsum("ij,j->i", inverse, enter)
        ratio = np.where(move > 1e-9, np.maximum(x, 0) / np.where(move > 1e-9, move, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        t = ratio[out]
        x = x - t * move
        x[out] = t
        basis[out], cost[out] = enter, price
        row = inverse[out] / move[out]
        inverse -= np.outer(move, row)
        inverse[out] = row
    left, found = np.array(demand, np.int64), []
    for column, amount, price in zip(basis, x, cost, strict=True):
        pattern = np.rint(column).astype(np.int64)
        if price == 0 or not pattern.any():
            continue
        times = int(np.floor(amount + 1e-6))
        times = min([times, *(left[pattern > 0] // pattern[pattern > 0])])
        if times > 0:
            left -= times * pattern
            found.append((pattern, int(times)))
    return found


def measure(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, spaced: bool = True) -> DataFrame:
    """One row a document: its token count and the crc32 of each whole piece and of the remainder."""

    def run(batches):
        pieces, end = pieces_for(tokenizer, spaced), np.array([end_id], np.uint32)
        for part, texts in in_parts(batches, 2):
            n, rem_crc, crcs = [], [], []
            for x in pieces.encode(texts):
                raw = np.concatenate([x, end]).astype("<u4")
                full = len(raw) // capacity * capacity
                n.append(len(raw))
                crcs.append([zlib.crc32(raw[i : i + capacity].tobytes()) for i in range(0, full, capacity)])
                rem_crc.append(zlib.crc32(raw[full:].tobytes()))
            n = np.array(n, np.int64)
            own = [part.column(0).cast(pa.int64()), part.column(1), pa.array(n), pa.array(n % capacity), pa.array(rem_crc, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))]
            yield pa.record_batch(own, names=["doc_id", "h", "n_tokens", "rem", "rem_crc", "crcs"])

    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("h"), text.alias("text")).mapInArrow(run, MEASURED)


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, capacity: int = CAPACITY, width: int = WIDTH, spaced: bool = True) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    tokenizer = tokenizer or default_path("byte_bpe_50k.json")
    size_class = F.ceil(F.col("rem") / width).cast("int")
    measured = materialize(measure(docs, tokenizer, end_id, capacity, spaced), "measured").withColumn("c", size_class)
    measured = measured.withColumn("b", F.pmod(F.xxhash64("doc_id", "h"), F.lit(BUCKETS)).cast("int")).withColumn("whole", F.size("crcs").cast("long"))

    # The histogram: at most capacity / width + 1 rows.
    cells = materialize(measured.groupBy("c", "b").agg(F.count("*").alias("n"), F.sum("whole").alias("w")), "cells")
    histogram = sorted((r["c"], r["n"], r["w"]) for r in cells.groupBy("c").agg(F.sum("n").alias("n"), F.sum("w").alias("w")).collect())
    demand = {c: n for c, n, _ in histogram if c > 0}
    sizes = sorted(demand)
    plan = cutting_patterns(sizes, [demand[c] for c in sizes], capacity // width)
    whole_base, total_whole = [], 0
    for c, _, w in histogram:
        whole_base.append((c, total_whole))
        total_whole += w
    ranges, used, sequence = [], dict.fromkeys(sizes, 0), total_whole
    for pattern, times in plan:
        for i in np.flatnonzero(pattern):
            c, k = sizes[i], int(pattern[i])
            ranges.append((c, used[c], used[c] + times * k, k, sequence, int(i)))
            used[c] += times * k
        sequence += times
    for c in sizes:
        if used[c] < demand[c]:
            ranges.append((c, used[c], demand[c], 0, -1, 0))

    before = Window.partitionBy("c").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("c", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w0"))
    bases = spark.createDataFrame(whole_base or [(-1, 0)], "c int, wc long")
    within = Window.partitionBy("c", "b").orderBy("doc_id", "h")
    ranked = measured.withColumns(
        {"r": F.row_number().over(within) - 1, "wr": F.coalesce(F.sum("whole").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))}
    )
    # Both small tables are bounded by capacity / width: the classes, and the classes of each pattern.
    ranked = ranked.join(cells, ["c", "b"]).join(F.broadcast(bases), "c")
    ranked = ranked.withColumns({"rank": F.col("n0") + F.col("r"), "first": F.col("wc") + F.col("w0") + F.col("wr")})
    ranked = materialize(ranked.select("doc_id", "h", "n_tokens", "rem", "rem_crc", "crcs", "whole", "c", "rank", "first"), "ranked")

    fulls = ranked.where("whole > 0").select(
        "doc_id", "n_tokens", F.posexplode("crcs").alias("i", "ids_crc32"), "first"
    ).select(
        "doc_id", (F.col("i").cast("long") * capacity).alias("start"), F.lit(capacity).cast("long").alias("length"), "ids_crc32",
        F.col("n_tokens").alias("doc_tokens"), (F.col("first") + F.col("i")).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    spans = F.broadcast(spark.createDataFrame(ranges or [(-1, 0, 0, 0, -1, 0)], "c int, lo long, hi long, k long, seq long, slot long"))
    placed = ranked.where("rem > 0").join(spans, "c").where("rank >= lo and rank < hi")
    kept = placed.where("k > 0").select(
        "doc_id", "n_tokens", "rem", "rem_crc", (F.col("seq") + F.floor((F.col("rank") - F.col("lo")) / F.col("k"))).cast("long").alias("sequence_id"),
        (F.col("slot") * capacity + (F.col("rank") - F.col("lo")) % F.col("k")).alias("o"),
    )
    inside = Window.partitionBy("sequence_id").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    pieces = kept.select(
        "doc_id", (F.col("n_tokens") - F.col("rem")).alias("start"), F.col("rem").alias("length"), F.col("rem_crc").alias("ids_crc32"),
        F.col("n_tokens").alias("doc_tokens"), "sequence_id", F.coalesce(F.sum("rem").over(inside), F.lit(0)).cast("long").alias("offset"),
    )

    # What rounding left: bounded by patterns x items of a pattern, whatever the input's size.
    rest = placed.where("k = 0").select("doc_id", "h", "n_tokens", "rem", "rem_crc").collect()
    rest.sort(key=lambda r: (-r["rem"], r["doc_id"] is None, r["doc_id"] or 0, r["h"]))
    rows, cuts, room, seq = [], [], capacity, sequence
    for r in rest:
        at, left = r["n_tokens"] - r["rem"], r["rem"]
        while left:
            part = min(left, room)
            row = (r["doc_id"], at, part, r["rem_crc"], r["n_tokens"], seq, capacity - room)
            (rows if part == r["rem"] else cuts).append(row if part == r["rem"] else (*row, r["h"]))
            at, left, room = at + part, left - part, room - part
            if not room:
                seq, room = seq + 1, capacity
    out = fulls.unionByName(pieces).unionByName(spark.createDataFrame(rows, PIECE))
    return out.unionByName(_cut(docs, cuts, tokenizer, end_id, spaced)) if cuts else out


def _cut(docs: DataFrame, cuts: list[tuple], tokenizer: str, end_id: int, spaced: bool) -> DataFrame:
    """The pieces that lie across a sequence's end: their documents are encoded once more for the checksums."""
    spark = docs.sparkSession
    plan = spark.createDataFrame(cuts, PIECE + ", h long")
    names = F.broadcast(plan.select(F.col("doc_id").alias("_d"), F.col("h").alias("_h")).distinct())
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    text = text.join(names, text["doc_id"].eqNullSafe(names["_d"]) & (text["h"] == names["_h"]), "left_semi").dropDuplicates(["doc_id", "h"])
    plan = plan.withColumnRenamed("doc_id", "_d").withColumnRenamed("h", "_h")
    rows = text.join(F.broadcast(plan), text["doc_id"].eqNullSafe(plan["_d"]) & (text["h"] == plan["_h"]))

    def run(frames):
        pieces, end = pieces_for(tokenizer, spaced), np.array([end_id], np.uint32)
        for pdf in frames:
            texts = pdf.pop("text").tolist()
            crc = []
            for i, t in enumerate(texts):
                raw = np.concatenate([pieces.encode([t])[0], end]).astype("<u4")
                s, n = int(pdf["start"].iat[i]), int(pdf["length"].iat[i])
                crc.append(zlib.crc32(raw[s : s + n].tobytes()))
            yield pdf.assign(ids_crc32=np.array(crc, np.int64), doc_id=pdf["doc_id"].astype("Int64"))

    names = [x.split()[0] for x in PIECE.split(", ")]
    return rows.select("doc_id", "text", *names[1:]).mapInPandas(lambda it: (x[names] for x in run(it)), PIECE)
