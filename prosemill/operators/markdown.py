"""Markdown structure and protected spans of lines.

Fences and paragraphs are running window aggregates over a document's lines; code spans are
paired per paragraph, only where a paragraph holds a backtick; link destinations, bare URLs
and kana quotations claim their spans in one Arrow batch function, because nested quotation
is not a regular language. All ranges are code points within the line, half open.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosemill.functions.text import RANGES, WS, matches, none_of

_SINGLE = rf"#{{1,6}}(?:[{WS}]|\z)|\||(?:[-*_][{WS}]*){{3,}}\z"
SINGLE = rf"^ {{0,3}}(?:{_SINGLE})"
BLOCK = rf"^ {{0,3}}(?:{_SINGLE}|[-*+][{WS}]|\p{{Nd}}{{1,9}}[.)][{WS}]|>)"
QUOTE = r"^ {0,3}>"
FENCE = rf"^[{WS}]*(?:```|~~~)"
BLANK = rf"^[{WS}]*\z"
PROSE = r"[「『《]|\]\(|https?://"
_CLOSER = {"「": "」", "『": "』", "《": "》"}
_URL = re.compile(r"https?://[A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;=%]*")
_LINK = re.compile(r"\]\(([^)]*)\)")


def explode_lines(docs: DataFrame, lines: Column, *keep: str) -> DataFrame:
    """doc_id, kept columns, line_no from 1, line."""
    return docs.select("doc_id", *keep, F.posexplode(lines).alias("_p", "line")).select("doc_id", *keep, (F.col("_p") + 1).alias("line_no"), "line")


def structure(lines: DataFrame) -> DataFrame:
    """Adds fence, verbatim, blank, para (the paragraph's number, null outside) to lines."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    d = lines.withColumn("fence", F.col("line").rlike(FENCE))
    inside = F.coalesce(F.sum(F.col("fence").cast("int")).over(past), F.lit(0)) % 2 == 1
    d = d.withColumn("verbatim", F.col("fence") | inside)
    d = d.withColumn("blank", ~F.col("verbatim") & F.col("line").rlike(BLANK))
    d = d.withColumns({"_text": ~F.col("verbatim") & ~F.col("blank"), "_quote": F.col("line").rlike(QUOTE), "_single": F.col("line").rlike(SINGLE)})
    # A quote goes on while the line before is an open paragraph's quote.
    goes_on = F.col("_quote") & F.lag(F.col("_text") & F.col("_quote"), 1, False).over(w)
    starts = F.col("_text") & ((F.col("line").rlike(BLOCK) & ~goes_on) | ~F.lag("_text", 1, False).over(w) | F.lag("_single", 1, False).over(w))
    d = d.withColumn("_starts", starts)
    number = F.sum(F.col("_starts").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("para", F.when(F.col("_text"), number)).drop("_text", "_quote", "_single", "_starts")


def pair_runs(runs: Column) -> Column:
    """Of backtick runs (s, e, m): struct of spans (interiors of paired runs) and unpaired (some run has no partner)."""
    sizes = F.transform(runs, lambda r: F.length(r["m"]))

    def step(a, i):
        rest = F.slice(sizes, i + 2, F.greatest(F.size(runs), F.lit(1)))
        j = F.array_position(rest, F.element_at(sizes, i + 1)).cast("int")
        span = F.struct(F.element_at(runs, i + 1)["e"].alias("a"), F.element_at(runs, F.least(i + 1 + j, F.size(runs)))["s"].alias("b"))
        return F.when(i < a["nxt"], a).otherwise(
            F.struct(
                F.when(j > 0, i + 1 + j).otherwise(i + 1).alias("nxt"),
                F.when(j > 0, F.array_append(a["spans"], span)).otherwise(a["spans"]).alias("spans"),
                (a["unpaired"] | (j == 0)).alias("unpaired"),
            )
        )

    start = F.struct(F.lit(0).alias("nxt"), none_of(RANGES).alias("spans"), F.lit(False).alias("unpaired"))
    empty = F.struct(none_of(RANGES).alias("spans"), F.lit(False).alias("unpaired"))
    folded = F.aggregate(F.sequence(F.lit(0), F.size(runs) - 1), start, step, lambda a: F.struct(a["spans"].alias("spans"), a["unpaired"].alias("unpaired")))
    return F.when(F.size(runs) > 0, folded).otherwise(empty)


def _paragraph_code(d: DataFrame) -> DataFrame:
    """(doc_id, para, spans over the joined paragraph, unpaired, last) of paragraphs with a backtick."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    p = d.where("para is not null").groupBy("doc_id", "para").agg(text.alias("joined")).where(F.contains("joined", F.lit("`")))
    return p.withColumn("runs", matches(F.col("joined"), "`+")).select("doc_id", "para", pair_runs(F.col("runs")).alias("pairs"))


def claim_prose(line: str, code: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Quotations with kana, link destinations and bare URLs of one line; a span that overlaps a claimed one is dropped."""
    taken: list[tuple[int, int]] = []

    def claim(a: int, b: int) -> None:
        if a < b and not any(a < y and b > x for x, y in (*code, *taken)):
            taken.append((a, b))

    chars = [i for i in range(len(line)) if not any(a <= i < b for a, b in code)]
    k = 0
    while k < len(chars):
        opener = line[chars[k]]
        close = _CLOSER.get(opener)
        after = k + 1
        if close:
            depth = 1
            for z in range(k + 1, len(chars)):
                depth += (line[chars[z]] == opener) - (line[chars[z]] == close)
                if depth == 0:
                    a, b = chars[k] + 1, chars[z]
                    if re.search("[぀-ヿ]", line[a:b]):
                        # Code nested in a quotation keeps its own span.
                        at = a
                        for x, y in code:
                            if at <= x and y <= b:
                                claim(at, x)
                                at = y
                        claim(at, b)
                    after = z + 1
                    break
        k = after
    for m in _LINK.finditer(line):
        claim(*m.span(1))
    at = 0
    while m := _URL.search(line, at):
        if m.start() and line[m.start() - 1].isascii() and line[m.start() - 1].isalnum():
            at = m.start() + 1
            continue
        claim(m.start(), m.start() + len(m[0].rstrip(")]}>,.;:!?")))
        at = m.end()
    return sorted(taken)


def _prose(line: pd.Series, code: pd.Series) -> pd.Series:
    return pd.Series([[] if t is None else [{"a": a, "b": b} for a, b in claim_prose(t, [(x["a"], x["b"]) for x in c])] for t, c in zip(line, code, strict=True)])


def protect(lines: DataFrame) -> DataFrame:
    """Adds verbatim, code and prose (ranges) to lines (doc_id, line_no, line, ...); keeps fence, blank and para."""
    d = structure(lines)
    w = Window.partitionBy("doc_id", "para").orderBy("line_no")
    d = d.withColumn("_from", F.when(F.col("para").isNotNull(), F.coalesce(F.sum(F.length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")))
    d = d.join(_paragraph_code(d), ["doc_id", "para"], "left")
    end = F.col("_from") + F.length("line")
    hit = F.filter("pairs.spans", lambda s: (s["a"] <= end) & (s["b"] >= F.col("_from")))
    cut = F.transform(hit, lambda s: F.struct((F.greatest(s["a"], F.col("_from")) - F.col("_from")).alias("a"), (F.least(s["b"], end) - F.col("_from")).alias("b")))
    d = d.withColumn("code", F.coalesce(cut, none_of(RANGES)))
    # Lines without a trigger reach the function as nulls.
    d = d.withColumn("prose", F.pandas_udf(_prose, RANGES)(F.when(~F.col("verbatim") & F.col("line").rlike(PROSE), F.col("line")), F.col("code")))
    return d.withColumn("unpaired", F.coalesce(F.col("pairs.unpaired"), F.lit(False))).drop("_from", "pairs")


def unclosed(docs: DataFrame) -> DataFrame:
    """doc_id, unclosed: may the last paragraph still be inside a code span that a later line closes?"""
    text = F.regexp_replace("text", "\n\\z", "")
    d = structure(explode_lines(docs.withColumn("_t", text), F.split("_t", "\n", -1)))
    last = d.groupBy("doc_id").agg(F.max(F.struct("line_no", "para", F.col("line").rlike(SINGLE).alias("closed"))).alias("x"))
    opened = last.where("x.para is not null and not x.closed").select("doc_id", F.col("x.para").alias("para"))
    found = _paragraph_code(d.join(opened, ["doc_id", "para"], "left_semi")).where("pairs.unpaired").select("doc_id", F.lit(True).alias("_u"))
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("_u", F.lit(False)).alias("unclosed"))


def shape(docs: DataFrame) -> DataFrame:
    """doc_id, headings, fences, items: counts of structure outside fences."""
    d = structure(explode_lines(docs, F.split(F.coalesce("text", F.lit("")), "\n", -1)))
    count = lambda c: F.count_if(c).cast("long")
    heading = F.col("line").rlike(rf"^ {{0,3}}#{{1,6}}(?:[{WS}]|\z)")
    item = F.col("line").rlike(rf"^[{WS}]*(?:[-*+]|\p{{Nd}}{{1,9}}[.)])(?:[{WS}]|\z)")
    return d.groupBy("doc_id").agg(count(~F.col("verbatim") & heading).alias("headings"), count(F.col("fence")).alias("fences"), count(~F.col("verbatim") & ~heading & item).alias("items"))


def shape_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Documents whose shape differs: doc_id, part, before, after."""
    a, b = shape(before).alias("a"), shape(after).alias("b")
    parts = F.array(*[F.struct(F.lit(p).alias("part"), F.col(f"a.{p}").alias("before"), F.col(f"b.{p}").alias("after")) for p in ("headings", "fences", "items")])
    return a.join(b, "doc_id").select("doc_id", F.explode(parts).alias("x")).select("doc_id", "x.*").where("before <> after")
