"""Language identification by prediction by partial matching.

For each language a byte context tree of orders 0 to 3 is counted over a bounded sample of
labelled documents and then frozen. A document's code length under a language is the sum
over all its bytes of -log2 p(byte | longest context that any language knows), escapes
weighing d / (n + d) (method C, without exclusion) and falling to the next shorter
context, at last to a uniform choice among all symbols. The shortest code wins; ties go to
the language that comes first by code point.

The trees of all languages are compiled to one table, context row x symbol x language, so
that scoring is two array look-ups a byte; every byte of every text is scored.

Bytes are folded first: A-Z to a-z, digits to 0, ASCII white space to a space. Each folded
byte that the sample holds is a symbol, and one more stands for any other.

``identified`` is the filter: it drops documents that no language codes in fewer bits than a
code that knows no language, the adaptive code of order 0 (Laplace's rule over 256 bytes),
which random characters favour and text does not.

Bound of the sample: ``SAMPLE_DOCS`` documents a language in expectation, chosen by the
hash of their doc_id, whole texts.

Defined cases: text that is null or has no letter gives ``und`` and score 0; without any
labelled document everything is ``und``, and the filter keeps what has a letter; a null
doc_id is never learned from and has held_out null; a null label is not learned from but
gets a prediction; repeated rows each get their own; an empty table gives no rows; further
columns are ignored by ``identify`` and kept by ``identified``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosemill.llm.common import forget, in_parts, trim

SAMPLE_DOCS = 1500
SLICE = 1 << 17
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double"


def folding() -> np.ndarray:
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    fold[48:58] = 48
    fold[9:14] = 32
    return fold


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def _grams(frames):
    """Counts of folded 4-byte strings by language, each text led by three spaces."""
    forget()
    fold = folding()
    for pdf in frames:
        rows = []
        for lang, part in pdf.groupby("lang"):
            raw = np.frombuffer(b"".join(b"   " + t.encode("utf-8", "replace") for t in part["text"]), np.uint8)
            first = np.zeros(len(raw), bool)
            at = 0
            for t in part["text"]:
                first[at : at + 3] = True
                at += 3 + len(t.encode("utf-8", "replace"))
            b = fold[raw].astype(np.int64)
            if len(b) < 4:
                continue
            key = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
            keys, n = np.unique(key[~first[3:]], return_counts=True)
            rows.append(pd.DataFrame({"lang": lang, "key": keys, "n": n}))
        if rows:
            yield pd.concat(rows)
    trim()


class Model:
    """Frozen trees of all languages: ``rows[context] -> row``, ``bits[row, symbol, language]``."""

    def __init__(self, counts: pd.DataFrame):
        self.langs = sorted(counts["lang"].unique())
        fold = folding()
        used = np.unique(counts["key"].to_numpy() & 255)
        # The last symbol is any byte that the sample does not hold.
        s = len(used) + 1
        sym = np.full(256, s - 1, np.int64)
        sym[used] = np.arange(len(used))
        if 32 not in used:
            sym[32] = s - 1
        self.symbol, self.symbols = sym[fold].astype(np.int32), s
        per = []
        for lang in self.langs:
            c = counts[counts["lang"] == lang]
            k, n = c["key"].to_numpy(), c["n"].to_numpy().astype(np.float64)
            per.append(([sym[(k >> x) & 255] for x in (24, 16, 8, 0)], n))

        def context(a: list[np.ndarray], order: int) -> np.ndarray:
            return sum(a[3 - j] * s ** (j - 1) for j in range(1, order + 1))

        known = [np.unique(np.concatenate([context(a, order) for a, _ in per])) for order in (1, 2, 3)]
        at = np.cumsum([0, 1] + [len(x) for x in known])
        # context -> row of the longest context that any language knows
        rows = np.zeros(s**3, np.int32)
        for order, ks in enumerate(known, 1):
            wide = rows.reshape(-1, s**order)
            wide[:, ks] = at[order] + np.arange(len(ks))
        self.rows = rows
        bits = np.zeros((at[-1], s, len(self.langs)), np.float32)
        for li, (a, n) in enumerate(per):
            p0 = np.bincount(a[3], n, s)
            d0, t0 = (p0 > 0).sum(), p0.sum()
            low = np.where(p0 > 0, p0 / (t0 + d0), d0 / (t0 + d0) / s)
            bits[0, :, li] = -np.log2(low)
            prob = {0: low[None, :]}
            where = {0: np.zeros(1, np.int64)}
            for order, ks in enumerate(known, 1):
                c = context(a, order)
                i = np.searchsorted(ks, c)
                ok = (i < len(ks)) & (ks[np.minimum(i, max(len(ks) - 1, 0))] == c) if len(ks) else np.zeros(len(c), bool)
                cnt = np.bincount(i[ok] * s + a[3][ok], n[ok], len(ks) * s).reshape(len(ks), s)
                tot, d = cnt.sum(1, keepdims=True), (cnt > 0).sum(1, keepdims=True)
                # a shorter context of a known one is known
                parent = ks % s ** (order - 1)
                up = prob[order - 1][np.searchsorted(where[order - 1], parent)] if order > 1 else np.repeat(prob[0], len(ks), 0)
                with np.errstate(invalid="ignore", divide="ignore"):
                    own = np.where(cnt > 0, cnt / (tot + d), d / (tot + d) * up)
                p = np.where(tot > 0, own, up)
                prob[order], where[order] = p, ks
                bits[at[order] : at[order + 1], :, li] = -np.log2(p)
        self.bits = bits

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits by text and language over every byte; memory follows ``SLICE``, however long a text is."""
        out = np.zeros((len(texts), len(self.langs)))
        raw = np.frombuffer(b"".join(x for t in texts for x in (b"   ", t)), np.uint8)
        edge = np.cumsum([0] + [3 + len(t) for t in texts])
        for lo in range(3, len(raw), SLICE):
            hi = min(lo + SLICE, len(raw))
            first, last = np.searchsorted(edge, [lo, hi - 1], "right") - 1
            b = self.symbol[raw[lo - 3 : hi]]
            here = np.diff(np.clip(edge[first : last + 2], lo, hi))
            live = np.arange(lo, hi) - np.repeat(edge[first : last + 1], here) >= 3
            context = ((b[:-3] * self.symbols + b[1:-2]) * self.symbols + b[2:-1])[live]
            v, who = self.bits[self.rows[context], b[3:][live]], np.repeat(np.arange(len(here)), here)[live]
            for k in range(len(self.langs)):
                out[first : last + 1, k] += np.bincount(who, v[:, k], len(here))
        return out


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """Counts over the sample are summed by Spark; the driver gets the summed n-grams of the bounded sample."""
    fit = docs.select("doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in fit.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    keep = F.lit(False)
    spread = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.lit(1 << 20))
    for lang, n in sizes.items():
        keep |= (F.col("lang") == lang) & (spread <= int((1 << 20) * min(1.0, sample_docs / n)))
    counts = fit.where(keep).select("lang", "text").mapInPandas(_grams, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    counts = counts.toPandas().sort_values(["lang", "key"])
    return Model(counts) if len(counts) else None


def _model_of(shared) -> Model:
    m = Model.__new__(Model)
    m.langs, m.symbol, m.symbols, m.rows, m.bits = shared.value
    return m


def plain_bits(texts: list[bytes]) -> np.ndarray:
    """The adaptive code of order 0 over folded bytes: what a text costs without knowledge of any language."""
    fold, out = folding(), np.zeros(len(texts))
    for i, t in enumerate(texts):
        n = np.bincount(fold[np.frombuffer(t, np.uint8)], minlength=256)
        n = n[n > 0]
        out[i] = (math.lgamma(256 + len(t)) - math.lgamma(256) - sum(math.lgamma(k + 1) for k in n.tolist())) / math.log(2)
    return out


def identified(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """The documents that are text of a learned language, rows as they came, their ``lang`` set to it.

    Those without a letter go, and those that no language codes shorter than ``plain_bits``.
    """
    lettered = docs.where(F.col("text").rlike(r"\p{L}"))
    model = train(docs, sample_docs)
    if model is None:
        return lettered
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.symbol, model.symbols, model.rows, model.bits))

    column = docs.columns.index("text")

    def keep(batches):
        forget()
        m = _model_of(shared)
        for batch, texts in in_parts(batches, column):
            lang = batch.schema.get_field_index("lang")
            bits = m.code_lengths(texts)
            best = pa.array([m.langs[i] for i in bits.argmin(1).tolist()], batch.schema.field(lang).type)
            columns = [best if i == lang else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(bits.min(1, initial=np.inf) < plain_bits(texts)))

    return lettered.mapInArrow(keep, docs.schema)


def identify(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """One row for each document: doc_id, held_out, lang_pred, score (share of the best code in all), bits_per_byte."""
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("text"))
    model = train(docs, sample_docs)
    if model is None:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits_per_byte"))
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.symbol, model.symbols, model.rows, model.bits))

    def score(batches):
        forget()
        m = _model_of(shared)
        names = np.array([*m.langs, "und"], object)
        for part, texts in in_parts(batches, 2):
            bits = m.code_lengths(texts)
            best = bits.argmin(1)
            low = bits.min(1)
            share = 1.0 / np.exp2(np.maximum(low[:, None] - bits, -1000)).sum(1)
            und = part.column(2).is_null().to_numpy(zero_copy_only=False)
            size = np.maximum(1, np.array([len(t) for t in texts]))
            own = [pa.array(names[np.where(und, len(m.langs), best)], pa.string()), pa.array(np.where(und, 0.0, share)), pa.array(np.where(und, 0.0, low / size))]
            yield pa.record_batch([part.column(0).cast(pa.int64()), part.column(1), *own], names=["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"])

    return rows.mapInArrow(score, SCHEMA)
