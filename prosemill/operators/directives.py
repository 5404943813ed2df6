"""Inline directives: comments that switch rules off and on.

``<!-- NAME-disable[ ids] -->``, ``enable`` and ``disable-next-line``, alone on a line outside
fences. No list means all rules; a list of separators only means none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosemill.functions.text import WS
from prosemill.plans.config import IDS

ALL = (1 << len(IDS)) - 1


class DirectiveError(ValueError):
    """A directive names a rule that does not exist."""


def pattern(prefix: str) -> str:
    return rf"^[{WS}]*<!--[{WS}]*{prefix}-(disable-next-line|disable|enable)(?:([{WS}][^>]*)?-->)[{WS}]*\z"


def parsed(line: Column, prefix: str) -> tuple[Column, Column, Column]:
    """(kind or '', mask of its rules, names that are no rules)."""
    kind = F.regexp_extract(line, pattern(prefix), 1)
    listed = F.regexp_replace(F.regexp_extract(line, pattern(prefix), 2), rf"^[{WS}]+|[{WS}]+\z", "")
    names = F.filter(F.split(listed, rf"[,{WS}]", -1), lambda n: n != "")
    bits = F.create_map(*[F.lit(x) for i, r in enumerate(IDS) for x in (r, 1 << i)])
    mask = F.aggregate(names, F.lit(0), lambda a, n: a.bitwiseOR(F.coalesce(F.try_element_at(bits, n), F.lit(0))))
    unknown = F.filter(names, lambda n: ~n.isin(*IDS))
    return kind, F.when(listed == "", ALL).otherwise(mask), unknown


def masks(protected: DataFrame, prefix: str) -> DataFrame:
    """Adds ``mask``, the bits of the rules that are off on each line, and ``unknown`` names of directives.

    Each line folds the directives before it; there are few in a document.
    """
    w = Window.partitionBy("doc_id").orderBy("line_no")
    kind, ids, unknown = parsed(F.col("line"), prefix)
    live = ~F.col("verbatim") & F.contains("line", F.lit("<!--"))
    d = protected.withColumn("_d", F.when(live & (kind != ""), F.struct(kind.alias("kind"), ids.alias("ids"), unknown.alias("unknown"))))
    earlier = F.collect_list(F.when(F.col("_d.kind").isin("disable", "enable"), F.col("_d"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumns({"_past": earlier, "_prev": F.lag("_d").over(w)})
    off = F.aggregate("_past", F.lit(0), lambda a, x: F.when(x["kind"] == "disable", a.bitwiseOR(x["ids"])).otherwise(a.bitwiseAND(F.bitwise_not(x["ids"]))))
    nxt = F.when(F.col("_prev.kind") == "disable-next-line", F.col("_prev.ids")).otherwise(0)
    mask = F.when(F.col("_d").isNotNull(), ALL).otherwise(off.bitwiseOR(nxt))
    return d.withColumns({"mask": mask, "unknown": F.col("_d.unknown")}).drop("_d", "_past", "_prev")


def errors(masked: DataFrame) -> DataFrame:
    """doc_id, line, unknown: directives that name no rule."""
    return masked.where(F.size("unknown") > 0).select("doc_id", F.col("line_no").alias("line"), F.array_join("unknown", ", ").alias("unknown"))
