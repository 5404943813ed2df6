"""N-gram Jaccard join with prefix filters under several global token orders.

A document is the set of its word shingles. For similarity t, two sets of sizes a <= b can
only link if a >= t b, and then, under ANY global order of tokens, the first
|x| - ceil(t |x|) + 1 tokens of each must share one.

1. Blocks of documents ask buckets of tokens how many blocks and documents have each token
   (``blocks.py``). All orders put tokens that no other document has first, then rarer before
   more frequent ones (by power of two), and differ by hash among these. A token that no
   other document has can't meet, so most documents have no prefix left and are done.
2. Equal sets are one class. Classes meet in the posting lists of the first order's
   prefixes; pairs whose sizes and numbers of shared tokens leave a link possible are
   candidates, those whose prefixes meet under every other order too are verified on the
   whole sets.
3. Lists of at most ``LONG`` classes give their pairs. Longer ones (large groups of near
   copies) never do: each first links its members to one of them, in chunks; what that ties
   is contracted, and classes still apart are compared tile by tile, each pair of tiles once
   whatever lists it has in common, and a task returns a spanning forest of its links.

Tokens are 64-bit hashes of whole shingles, and a class is known by 128 bits and its size.
The work in a long list whose members do not link grows with the square of its tiles; all
else is in proportion to the tokens.

Defined cases: null, empty or blank text has an empty set and links with nothing; with
fewer words than a shingle has, the whole sequence is one token; every row is a document of
its own, also where rows share a doc_id; a null doc_id links with nothing and its component
is null; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosemill.llm.blocks import Block, answers, asked, buckets_for, met, questions, stable, texts_of
from prosemill.llm.common import components, discard, materialize
from prosemill.llm.words import A, WordHasher, mix, run_hashes

WORDS = 5
THRESHOLD = (80, 100)
ORDERS = 3
LONG = 64
TILE = 256
CHUNK = 1024
_COLUMNS = 1 << 15


def shingles(block: Block, hasher: WordHasher, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, token) of all shingles of a block, repeats included."""
    h, first = block.words(hasher)
    size = np.diff(first)
    who = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(h))
    fits = at + n <= first[who + 1] if len(h) else np.zeros(0, bool)
    docs, tokens = [who[fits]], [run_hashes(h, at[fits], n)]
    for m in range(1, n):
        short = np.flatnonzero(size == m)
        docs.append(short)
        tokens.append(run_hashes(h, first[short], m))
    return np.concatenate(docs), np.concatenate(tokens)


def _sorted_tokens(block: Block, hasher: WordHasher, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows by token: document, token, and where a new token begins."""
    doc, token = shingles(block, hasher, n)
    order = np.argsort(token)
    token, doc = token[order], doc[order].astype(np.uint16)
    return doc, token, np.concatenate([np.ones(min(1, len(token)), bool), token[1:] != token[:-1]])


def ask_tokens(docs: DataFrame, words: int, lower: bool, buckets: int) -> DataFrame:
    hasher = WordHasher(lower)

    def ask(number: int, block: Block) -> pa.RecordBatch:
        doc, token, head = _sorted_tokens(block, hasher, words)
        at = np.flatnonzero(head)
        many = np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at) if len(at) else np.zeros(0, bool)
        token = token[at]
        cut = (token & np.uint64(0xFFFFFFFF)).astype("<u4")
        return asked(number, block.crc, token, buckets, lambda s: np.uint32(s.stop - s.start).tobytes() + cut[s].tobytes() + np.packbits(many[s]).tobytes())

    return questions(docs, ask)


def token_classes(messages: list[bytes]) -> list[bytes]:
    """For each entry 0 if no other document has its token, else about the binary logarithm of its frequency.

    Entries are cut to 32 bits within their bucket: a collision makes a token seem shared,
    which costs time only.
    """
    sizes = [int(np.frombuffer(m, "<u4", 1)[0]) for m in messages]
    cut = np.concatenate([np.frombuffer(m, "<u4", n, 4) for m, n in zip(messages, sizes, strict=True)])
    many = np.concatenate([np.unpackbits(np.frombuffer(m, "u1", -1, 4 + 4 * n), count=n) for m, n in zip(messages, sizes, strict=True)])
    order = np.argsort(cut, kind="stable")
    line = cut[order]
    head = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    count = np.add.reduceat(many[order].astype(np.int64) + 1, head)
    own = np.where(count > 1, 1 + np.log2(count), 0).astype(np.uint8)
    out = np.empty(len(cut), np.uint8)
    out[order] = np.repeat(own, np.diff(np.concatenate([head, [len(cut)]])))
    stop = np.cumsum(sizes).tolist()
    return [out[b - n : b].tobytes() for b, n in zip(stop, sizes, strict=True)]


def prefix_size(n: int, t: tuple[int, int]) -> int:
    return n - -(-n * t[0] // t[1]) + 1


def _rank(tokens: np.ndarray, k: int) -> np.ndarray:
    """Ranks of the k-th global order among tokens of one class of frequency."""
    return mix(tokens ^ np.uint64((k + 1) * int(A) % (1 << 64)))


SKETCH = "doc_id long, n long, fp long, fp2 long, sh long, prefix array<long>, others array<binary>, shared binary"


def sketch(docs: DataFrame, words: int, t: tuple[int, int], orders: int, lower: bool) -> DataFrame:
    """A row a document: set size; where a prefix of shared tokens is left also two hashes of the set, its shared tokens and its prefixes."""
    docs = stable(docs)
    buckets = buckets_for(docs)
    replies = answers(ask_tokens(docs, words, lower, buckets), token_classes, "token-classes")
    hasher = WordHasher(lower)

    def draw(_: int, block: Block, own: dict[str, list[bytes]]) -> pa.Table:
        doc, token, head = _sorted_tokens(block, hasher, words)
        known = np.frombuffer(b"".join(own.get("tokens", [])), np.uint8)
        if len(known) != head.sum():
            raise RuntimeError("answers do not fit their block")
        rare = known[np.cumsum(head) - 1] if len(head) else known
        order = np.argsort(doc, kind="stable")
        doc, token, rare = doc[order], token[order], rare[order]
        keep = np.concatenate([np.ones(min(1, len(doc)), bool), (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])])
        doc, token, rare = doc[keep], token[keep], rare[keep]
        n = np.bincount(doc, minlength=len(block.ids))
        sh = np.bincount(doc[rare > 0], minlength=len(block.ids))
        stop = np.cumsum(n)
        columns: dict[str, list] = {c: [None] * len(n) for c in ("fp", "fp2", "sh", "prefix", "others", "shared")}
        for i in np.flatnonzero((sh > 0) & block.known).tolist():
            m = prefix_size(int(n[i]), t) - int(n[i] - sh[i])
            if m <= 0:
                continue
            span = slice(stop[i] - n[i], stop[i])
            x, c = token[span], rare[span]
            columns["fp"][i], columns["fp2"][i] = (int(mix(x ^ salt).sum().view(np.int64)) for salt in (A, ~A))
            x, c = x[c > 0], c[c > 0]
            first, *rest = (x[np.lexsort((_rank(x, k), c))[:m]] for k in range(orders))
            columns["sh"][i], columns["prefix"][i], columns["shared"][i] = len(x), first.view(np.int64), x.tobytes()
            columns["others"][i] = [np.sort(y).tobytes() for y in rest]
        kinds = {"fp": pa.int64(), "fp2": pa.int64(), "sh": pa.int64(), "prefix": pa.list_(pa.int64()), "others": pa.list_(pa.binary()), "shared": pa.binary()}
        ids = pa.array(block.ids, mask=~block.known)
        return pa.table({"doc_id": ids, "n": pa.array(n, pa.int64())} | {c: pa.array(v, kinds[c]) for c, v in columns.items()})

    out = materialize(met(texts_of(docs), replies.withColumn("kind", F.lit("tokens")), draw, SKETCH), "sketch")
    discard(replies)
    return out


def _possible(t: tuple[int, int], nx: Column, ny: Column, sx: Column, sy: Column) -> Column:
    """The smaller set is at least t times the larger, and the shared tokens suffice: only these can be common."""
    most = F.least(sx, sy)
    return (F.least(nx, ny) * t[1] >= F.greatest(nx, ny) * t[0]) & (most * t[1] >= (nx + ny - most) * t[0])


def short_pairs(member: DataFrame, t: tuple[int, int]) -> DataFrame:
    """(a, b) of all possible pairs within lists of bounded length; each task shifts its sorted rows against themselves."""

    def run(batches):
        held = None

        def pairs(token, fp, n, sh):
            for shift in range(1, LONG):
                if shift >= len(token):
                    break
                i = np.flatnonzero(token[shift:] == token[:-shift])
                if not len(i):
                    break
                j = i + shift
                most = np.minimum(sh[i], sh[j])
                fits = (np.minimum(n[i], n[j]) * t[1] >= np.maximum(n[i], n[j]) * t[0]) & (most * t[1] >= (n[i] + n[j] - most) * t[0])
                a, b = np.minimum(fp[i], fp[j])[fits], np.maximum(fp[i], fp[j])[fits]
                if len(a):
                    own = np.unique(np.stack([a, b], 1), axis=0)
                    yield pa.record_batch([pa.array(own[:, 0]), pa.array(own[:, 1])], names=["a", "b"])

        for batch in batches:
            rows = [c.to_numpy() for c in batch.columns]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            # The last list may go on in the next batch.
            cut = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0
            held = [x[cut:] for x in rows]
            yield from pairs(*(x[:cut] for x in rows))
        if held is not None:
            yield from pairs(*held)

    rows = member.where(F.col("df") <= LONG).select("token", "fp", "n", "sh")
    return rows.repartition("token").sortWithinPartitions("token").mapInArrow(run, "a long, b long").distinct()


def _meet(x: list[bytes], y: list[bytes]) -> bool:
    """Do the prefixes meet under every further order?"""
    for p, q in zip(x, y, strict=True):
        both = np.concatenate([np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)])
        both.sort()
        if not (both[1:] == both[:-1]).any():
            return False
    return True


def verified(pairs: DataFrame, heads: DataFrame, t: tuple[int, int]) -> DataFrame:
    """(a, b) of the pairs (a, part, b) that link; a task holds the set of one a, those of its b's pass by."""

    def run(batches):
        key, own = None, None
        for batch in batches:
            a, b = [], []
            for r in zip(*(batch.column(c).to_pylist() for c in ("a", "part", "b", "n", "others", "shared")), strict=True):
                if r[2] is None:
                    key, own = r[:2], (r[3], r[4], np.frombuffer(r[5], np.uint64))
                elif key != r[:2]:
                    raise RuntimeError("a pair without its first set")
                elif _meet(own[1], r[4]):
                    x = np.frombuffer(r[5], np.uint64)
                    common = len(np.intersect1d(own[2], x, assume_unique=True))
                    if common * t[1] >= (own[0] + r[3] - common) * t[0]:
                        a.append(r[0])
                        b.append(r[2])
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    one = heads.select("fp", "n", "others", "shared")
    left = pairs.select("a", "part").distinct().join(one.withColumnRenamed("fp", "a"), "a").withColumn("b", F.lit(None).cast("long"))
    right = pairs.select("a", "part", F.col("b").alias("fp")).join(one, "fp").withColumnRenamed("fp", "b")
    columns = ["a", "part", "b", "n", "others", "shared"]
    rows = left.select(*columns).unionByName(right.select(*columns)).repartition("a", "part")
    return rows.sortWithinPartitions("a", "part", F.col("b").asc_nulls_first()).mapInArrow(run, "a long, b long")


def _forest(a: np.ndarray, b: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Enough of these links to tie what all of them tie."""
    root, out = list(range(size)), []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        u, v = x, y
        while root[u] != u:
            root[u] = root[root[u]]
            u = root[u]
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        if u != v:
            root[max(u, v)] = min(u, v)
            out.append((x, y))
    return out


def tile_links(n: np.ndarray, sets: list[np.ndarray], side: np.ndarray, part: np.ndarray, t: tuple[int, int]) -> list[tuple[int, int]]:
    """A spanning forest of the links between rows of side 0 and side 1 (or within the one side there is) that lie in different parts."""
    token = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column = np.unique(token, return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    x = np.flatnonzero(side == 0)
    y = np.flatnonzero(side == 1) if (side == 1).any() else x
    common = np.zeros((len(x), len(y)), np.float32)
    for lo in range(0, int(column[-1]) + 1, _COLUMNS):
        span = slice(*np.searchsorted(column, [lo, lo + _COLUMNS]))
        dense = np.zeros((len(sets), _COLUMNS), np.float32)
        dense[row[span], column[span] - lo] = 1
        common += dense[x] @ dense[y].T
    c = np.rint(common).astype(np.int64)
    linked = (c * t[1] >= (n[x][:, None] + n[y][None, :] - c) * t[0]) & (part[x][:, None] != part[y][None, :])
    i, j = np.nonzero(linked)
    return _forest(x[i], y[j], len(sets))


def long_lists(member: DataFrame, heads: DataFrame, found: DataFrame, t: tuple[int, int]) -> DataFrame:
    """(a, b): what ties classes of long lists that are still apart."""
    m = member.where(F.col("df") > LONG)
    part = found.select(F.col("node").alias("fp"), "component")
    own = m.groupBy("fp").agg(F.max(F.struct("df", "token")).alias("main"), F.first("n").alias("n"))
    own = own.join(part, "fp", "left")
    band = F.floor(F.log("n") / math.log(t[1] / t[0])).cast("long")
    own = own.select("fp", F.coalesce("component", F.col("main.token")).alias("group"), band.alias("band"), F.coalesce("component", "fp").alias("part"), F.col("component").isNotNull().alias("tied"))
    own = materialize(own, "long-members")
    crowd = own.groupBy("group", "tied", "band").agg(F.ceil(F.count("*") / TILE).alias("k"))
    tiles = own.join(crowd, ["group", "tied", "band"])
    tile = F.xxhash64("group", "tied", "band", F.pmod(F.xxhash64("fp"), F.col("k")))
    tiles = materialize(tiles.select("fp", tile.alias("tile"), "band", "part", F.when(F.col("tied"), F.col("part")).alias("whole")), "tiles")
    spread = materialize(m.select("token", "fp").join(tiles, "fp").select("token", "tile", "band", "whole").distinct(), "spread")
    x, y = (spread.select("token", *[F.col(c).alias(f"{c}{k}") for c in ("tile", "band", "whole")]) for k in "xy")
    apart = F.col("wholex").isNull() | F.col("wholey").isNull() | (F.col("wholex") != F.col("wholey"))
    units = x.join(y, "token").where((F.col("tilex") <= F.col("tiley")) & (F.abs(F.col("bandx") - F.col("bandy")) <= 1) & apart).select("tilex", "tiley").distinct()
    units = materialize(units, "units")
    sides = units.select("tilex", "tiley", F.col("tilex").alias("tile"), F.lit(0).alias("side")).unionByName(
        units.where("tilex <> tiley").select("tilex", "tiley", F.col("tiley").alias("tile"), F.lit(1).alias("side"))
    )
    full = tiles.join(heads.select("fp", "n", "shared"), "fp").select("tile", "fp", "part", "n", "shared")

    def run(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in table.column("shared").to_pylist()]
        links = tile_links(table.column("n").to_numpy(), sets, table.column("side").to_numpy(), table.column("part").to_numpy(), t)
        return pa.table({"a": pa.array([int(fp[i]) for i, _ in links], pa.int64()), "b": pa.array([int(fp[j]) for _, j in links], pa.int64())})

    out = materialize(sides.join(full, "tile").groupBy("tilex", "tiley").applyInArrow(run, "a long, b long"), "long-links")
    discard(own, tiles, spread, units)
    return out


def join(docs: DataFrame, words: int = WORDS, threshold: tuple[int, int] = THRESHOLD, orders: int = ORDERS, lower: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id: documents linked at similarity >= threshold, directly or through others."""
    t = threshold
    drawn = sketch(docs, words, t, orders, lower)
    same = ["fp", "fp2", "n"]
    heads = drawn.where("sh is not null").groupBy(*same).agg(F.min("doc_id").alias("doc"), F.first(F.struct("sh", "prefix", "others", "shared")).alias("x"))
    heads = materialize(heads.select(*same, "doc", "x.*"), "heads")
    postings = heads.select(F.explode("prefix").alias("token"), "fp", "n", "sh")
    lists = postings.groupBy("token").agg(F.count("*").alias("df"), F.min(F.struct(F.xxhash64("fp").alias("h"), F.col("fp").alias("p"), F.col("n").alias("pn"), F.col("sh").alias("ps"))).alias("pivot")).where("df > 1")
    member = materialize(postings.join(lists, "token").select("token", "fp", "n", "sh", "df", "pivot.p", "pivot.pn", "pivot.ps"), "postings")

    pairs = short_pairs(member, t).withColumn("part", F.lit(0).cast("long"))
    far = member.where((F.col("df") > LONG) & (F.col("fp") != F.col("p")) & _possible(t, F.col("n"), F.col("pn"), F.col("sh"), F.col("ps")))
    far = far.select(F.col("p").alias("a"), F.col("fp").alias("b"), (1 + F.pmod(F.xxhash64("fp"), F.ceil(F.col("df") / CHUNK))).cast("long").alias("part")).dropDuplicates(["a", "b"])
    links = materialize(verified(pairs.unionByName(far), heads, t), "links")
    found = materialize(components(links), "found")
    if not member.where(F.col("df") > LONG).isEmpty():
        more = long_lists(member, heads, found, t)
        if not more.isEmpty():
            found = materialize(components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)), "found")

    named = heads.select(*same, "doc").join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("c", F.coalesce("component", "fp"))
    named = materialize(named.select(*same, "doc", "c"), "named")
    least = named.groupBy("c").agg(F.min("doc").alias("component_id"))
    named = materialize(named.join(least, "c").select(*same, "component_id"), "components")
    out = drawn.select("doc_id", "n", "fp", "fp2")
    lone = out.where("fp is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return lone.unionByName(out.where("fp is not null").join(named, same).select("doc_id", F.col("n").alias("n_shingles"), "component_id"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The first document of every group, rows as they came.

    Of rows that repeat doc_id and text one stays; rows with a null doc_id link with nothing and stay.
    """
    kept = join(docs, **options).where("doc_id = component_id").groupBy(F.col("doc_id").alias("kept")).agg(F.count("*").alias("rows"))
    kept = materialize(kept, "kept")
    out = docs.where("doc_id is null").unionByName(docs.join(kept.where("rows = 1"), docs["doc_id"] == kept["kept"], "left_semi"))
    again = docs.join(kept.where("rows > 1"), docs["doc_id"] == kept["kept"], "left_semi")
    return out.unionByName(again.dropDuplicates(["doc_id", "text"]))
