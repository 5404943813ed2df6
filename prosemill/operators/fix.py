"""Fix: an ordered chain of rewrites on the unprotected fragments of each line, until nothing changes.

A line is cut at its protected ranges, each fragment goes through the chain by itself, and
the pieces are joined again; the number of lines never changes. Only documents that a pass
changed go into the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosemill.functions.text import CJK, DIGITS, WIDE_DIGITS, WORD, WS, fix_lines
from prosemill.operators import directives, markdown
from prosemill.operators.rules import FULL, HAN, NEAR, covered_guard, period_pattern, unit_pattern  # noqa: F401
from prosemill.plans.config import ORDER, Config
from prosemill.plans.steps import written
from prosemill.resources.lists import TERMS

NEVER = "(?!)"
#: Passes after which a fix that still changes is an error.
PASSES = 50


def chain(config: Config) -> list[tuple[str, str, str]]:
    """(rule, pattern, replacement) in order, from width to spacing to structure; terms and code edges are apart."""
    letter, near = "[A-Za-z]", rf"[^{WS}—⸺]"
    steps = [("zh-typography-1", rf"(?<={HAN}){h}|{h}(?={HAN})", f) for h, f in ((",", "，"), (";", "；"), (":", "："), (r"\?", "？"), ("!", "！"))]
    steps.append(("zh-typography-1", period_pattern(), "。"))
    steps += [
        ("zh-typography-3", rf"(?<={HAN}|\*\*|`|\))(?=\()|(?<=[A-Za-z0-9])(?=\((?![A-Za-z0-9]))", " "),
        ("zh-typography-3", rf"(?<=\))(?=[{WORD}]|\*\*[{WORD}]|`)", " "),
        ("zh-typography-4", f"(?<={HAN})(?={letter})|(?<={letter})(?={HAN})", " "),
        ("zh-typography-5", _digit_gap(config.skip_zh_units), " "),
        ("zh-typography-6", unit_pattern(), "$1 $2"),
        ("code", "", ""),
        ("zh-typography-8", rf"(?<={near})(?=(?<!—)——(?!—)|⸺)", " "),
        ("zh-typography-8", rf"(?<=(?<!—)——|⸺)(?={near})", " "),
        ("zh-typography-9", rf"(?<={HAN})(?=\[[^\]]*\]\()", " "),
        ("zh-typography-11", f"(?<=[{FULL}]) +(?={NEAR})|(?<={NEAR}) +(?=[{FULL}])", ""),
    ]
    return [s for s in steps if s[0] == "code" and config.on("zh-typography-7") or config.on(s[0] if s[0] != "code" else "zh-typography-7")]


def _digit_gap(units: str) -> str:
    skip = rf"(?!(?>[0-9]+(?:[.,][0-9]+)*)[{units}])" if units else ""
    return rf"(?<={HAN})(?=[0-9]){skip}|(?<=[0-9])(?={HAN}){f'(?![{units}])' if units else ''}"


def fix_fragment(x: Column, config: Config, mask: Column | None, terms: Column | None = None, opens: Column | None = None, closes: Column | None = None) -> Column:
    """The chain on one fragment. A masked rule gets a pattern that never matches, so the text appears once in the expression."""

    def unless(rule: str, pattern: str) -> Column:
        off = mask.bitwiseAND(F.lit(1 << ORDER[rule])) != 0 if mask is not None else None
        return F.lit(pattern) if off is None else F.when(off, NEVER).otherwise(pattern)

    if config.on("zh-word-1") and terms is not None:
        for i, (wrong, right, _) in enumerate(TERMS):
            x = F.regexp_replace(x, F.when(F.element_at(terms, i + 1), unless("zh-word-1", wrong)).otherwise(NEVER), F.lit(right))
    if config.on("zh-typography-10"):
        off = (mask.bitwiseAND(F.lit(1 << ORDER["zh-typography-10"])) != 0) if mask is not None else F.lit(False)
        x = F.call_function("translate", x, F.when(off, "").otherwise(WIDE_DIGITS), F.lit(DIGITS)) if mask is not None else F.translate(x, WIDE_DIGITS, DIGITS)
    if config.on("zh-typography-2"):
        off = (mask.bitwiseAND(F.lit(1 << ORDER["zh-typography-2"])) != 0) if mask is not None else F.lit(False)
        x = F.call_function("translate", x, F.when(off, "").otherwise("（）"), F.lit("()")) if mask is not None else F.translate(x, "（）", "()")
    for rule, pattern, by in chain(config):
        if rule == "code":
            if opens is not None:
                x = F.regexp_replace(x, F.when(closes, unless("zh-typography-7", f"^(`+)(?={HAN})")).otherwise(NEVER), F.lit("$1 "))
                x = F.regexp_replace(x, F.when(opens, unless("zh-typography-7", f"(?<={HAN})(`+)\\z")).otherwise(NEVER), F.lit(" $1"))
        else:
            x = F.regexp_replace(x, unless(rule, pattern), F.lit(by))
    return x


def fixed_line(config: Config, masked: bool) -> Column:
    """The fixed form of column ``line`` with ``code``, ``prose`` and ``mask``."""
    line, mask = F.col("line"), F.col("mask") if masked else None
    low = F.lower(line)

    def near(anchors):
        out = F.lit(False)
        for a in anchors:
            out |= F.contains(low, F.lit(a))
        return out

    terms = F.array(*[near(a) for _, _, a in TERMS])
    plain = fix_fragment(line, config, mask, terms)
    kind = lambda code: lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), F.lit(code).alias("code"))
    spans = F.array_sort(F.concat(F.transform("code", kind(True)), F.transform("prose", kind(False))))

    def fragment(p, i):
        # The part before span i; after the last span, p is the line's end.
        before = F.when(i > 0, F.element_at(F.col("_spans"), F.greatest(i, F.lit(1))))
        start = F.coalesce(before["b"], F.lit(0))
        text = F.substring(line, start + 1, p["a"] - start)
        opens = p["code"] & (p["a"] > start) & (F.substring(line, p["a"], F.lit(1)) == "`")
        closes = F.coalesce(before["code"] & (F.substring(line, before["b"] + 1, F.lit(1)) == "`"), F.lit(False))
        return F.concat(fix_fragment(text, config, mask, terms, opens, closes), F.substring(line, p["a"] + 1, p["b"] - p["a"]))

    end = F.struct(F.length(line).alias("a"), F.length(line).alias("b"), F.lit(False).alias("code"))
    cut = F.array_join(F.transform(F.array_append(F.col("_spans"), end), fragment), "")
    return spans, F.when(F.col("verbatim"), line).when(F.size("_spans") > 0, cut).otherwise(plain)


def fix_pass(docs: DataFrame, config: Config) -> DataFrame:
    """doc_id, text, fixed after one pass."""
    d = markdown.explode_lines(docs, fix_lines(F.col("text")))
    d = directives.masks(markdown.protect(d), config.directive_prefix)
    spans, plain = fixed_line(config, False)
    _, masked = fixed_line(config, True)
    d = d.withColumn("_spans", spans).withColumn("out", F.when(F.col("mask") == 0, plain).otherwise(masked))
    both = d.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line", "out"))).alias("x"))
    join = lambda c: F.array_join(F.transform("x", lambda r: r[c]), "\n")
    return both.select("doc_id", join("line").alias("text"), join("out").alias("fixed"))


def fix(docs: DataFrame, config: Config | None = None, passes: int = PASSES) -> DataFrame:
    """doc_id, fixed: the fixpoint. Null text stays null. doc_id names a document."""
    config = config or Config()
    todo = written(docs.where("text is not null").select("doc_id", "text"), "fix")
    done: DataFrame | None = None
    for _ in range(passes):
        step = written(fix_pass(todo, config), "fix")
        settled = step.where(F.col("text").eqNullSafe(F.col("fixed"))).select("doc_id", "fixed")
        done = settled if done is None else done.unionByName(settled)
        todo = step.where(~F.col("text").eqNullSafe(F.col("fixed"))).select("doc_id", F.col("fixed").alias("text"))
        if todo.isEmpty():
            blank = docs.where("text is null").select("doc_id", F.lit(None).cast("string").alias("fixed"))
            return done.unionByName(blank)
    raise RuntimeError(f"fixing did not settle within {passes} passes")
