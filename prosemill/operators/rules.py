"""The rules of a check: each adds its matches on a line as (ord, pat, name, s, e), in code points."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from prosemill.functions.text import CJK, WORD, WS, matches, none_of
from prosemill.plans.config import ORDER, Config
from prosemill.resources.lists import ABBREVIATIONS, PHRASES, SECRET_ALLOWED, TERMS, UNITS, ZERO_ALLOWED

MATCH = "array<struct<ord:int,pat:int,name:string,s:int,e:int>>"
#: Letters that keep an English phrase from starting or ending: case folding gives some of them an ASCII letter.
EN = "A-Za-z0-9_\u0130\u0131\u017F\u212A"
FULL = "，。、；：？！"
NEAR = rf"[^{WS}—⸺|]"
SPACE = rf"[{WS}]"
HAN = f"[{CJK}]"


def quoted(s: str) -> str:
    """A literal for a Java pattern."""
    return re.sub(r"([\\.\[\]{}()*+?^$|\-])", r"\\\1", s)


def period_pattern() -> str:
    """A full stop beside CJK that ends neither an abbreviation nor a number, name or ellipsis."""
    ends = "|".join(quoted(a[:-1]) for a in ABBREVIATIONS)
    inner = "|".join(f"(?<=(?<![A-Za-z]){quoted(a[:k])}\\.)(?={quoted(a[k + 1 :])})" for a in ABBREVIATIONS for k in [i for i, c in enumerate(a) if c == "." and i + 1 < len(a)])
    return rf"(?:(?<={HAN})\.|(?<!\.)\.(?={HAN}))(?<!\.\.)(?<!(?<![A-Za-z])(?:{ends})\.)(?!{inner})(?![A-Za-z0-9.])"


def unit_pattern() -> str:
    return rf"(?<![A-Za-z0-9])([0-9]+)({'|'.join(UNITS)})(?![A-Za-z0-9])"


def digit_boundary(units: str) -> str:
    """A character before a CJK-digit boundary; both ends of a number run that one of ``units`` follows are exempt."""
    if not units:
        return rf"{HAN}(?=[0-9])|[0-9](?={HAN})"
    return rf"{HAN}(?=[0-9])(?!(?>[0-9]+(?:[.,][0-9]+)*)[{units}])|[0-9](?={HAN})(?![{units}])"


def covered_guard(word: str, allowed: list[str]) -> str:
    """Guards against a hit that an allowed phrase covers at its first character."""
    out = []
    for phrase in allowed:
        for k in [i for i, c in enumerate(phrase) if c == word[0]]:
            before, after = phrase[:k], phrase[k:]
            out.append((f"(?<={before})" if before else "") + after)
    return f"(?!{'|'.join(out)})" if out else ""


def phrase_pattern(rule: str) -> str:
    listed = sorted(PHRASES[rule], key=len, reverse=True)
    if rule.startswith("en"):
        return rf"(?<![{EN}])(?iu:{'|'.join(re.sub('[iI]', '[iIİı]', quoted(p)) for p in listed)})(?![{EN}])"
    return "|".join(quoted(p) for p in listed)


def english_parallels() -> list[str]:
    it, iz, ap = "(?:[iİı]t|that)", "[iİı]s", "['’]"
    opened = [rf"not{SPACE}+just", rf"(?:{it}{ap}s|they{ap}re|{iz}|are|was|were){SPACE}+not|(?:{iz}|are|was|were)n{ap}t"]
    closed = ["but", rf"{it}{ap}s|they{ap}re|{it}{SPACE}+{iz}|they{SPACE}+are"]
    return [rf"(?s)(?<![{EN}])(?>(?iu:{a}))(?![{EN}]).{{0,40}}?(?<![{EN}])(?iu:{b})(?![{EN}])" for a, b in zip(opened, closed, strict=True)]


def _found(rule: str, pat: int, name: str, text: Column, pattern: str, at=None) -> Column:
    """Matches of one pattern; ``at`` maps a match to its (s, e)."""
    place = at or (lambda x: (x["s"], x["e"]))

    def row(x):
        s, e = place(x)
        return F.struct(F.lit(ORDER[rule]).alias("ord"), F.lit(pat).alias("pat"), F.lit(name).alias("name"), s.cast("int").alias("s"), e.cast("int").alias("e"))

    return F.transform(matches(text, pattern), row)


def _after(x):
    """The boundary behind a one-character match."""
    return x["e"], x["e"]


def _code_edges(line: Column) -> Column:
    """CJK touching the delimiters of a paired code span."""
    rule = "zh-typography-7"

    def edges(c):
        before, after = F.substring(line, F.lit(1), c["a"]), F.substring(line, c["b"] + 1, F.length(line))
        opened, closed = F.length(F.regexp_extract(before, f"(?<={HAN})(`+)\\z", 1)), F.length(F.regexp_extract(after, f"^(`+)(?={HAN})", 1))

        def row(pat, side, s, e):
            return F.struct(F.lit(ORDER[rule]).alias("ord"), F.lit(pat).alias("pat"), F.lit(f"{rule} no space {side} inline code").alias("name"), s.cast("int").alias("s"), e.cast("int").alias("e"))

        both = F.array(F.when(opened > 0, row(0, "before", c["a"] - opened, c["a"])), F.when(closed > 0, row(0, "after", c["b"], c["b"] + closed)))
        return F.filter(both, lambda x: x.isNotNull())

    return F.flatten(F.transform("code", edges))


def exempt(x: Column) -> Column:
    """Does a protected span meet this match? Both ends count for a match without width."""
    spans = F.concat("code", "prose")
    return F.exists(spans, lambda p: F.when(x["s"] == x["e"], (p["a"] <= x["s"]) & (x["s"] <= p["b"])).otherwise((x["s"] < p["b"]) & (x["e"] > p["a"])))


def line_matches(config: Config) -> Column:
    """All unprotected matches of the enabled rules on column ``line`` with ``code`` and ``prose``, unsorted."""
    line, found = F.col("line"), []

    def add(rule: str, *rows: Column, first: bool = False, protect: bool = True) -> None:
        if config.on(rule):
            free = F.concat(*rows) if len(rows) > 1 else rows[0]
            free = F.filter(free, lambda x: ~exempt(x)) if protect else free
            found.append(F.slice(free, 1, 1) if first else free)

    r = "zh-typography-1"
    add(r, _found(r, 0, f"{r} halfwidth punct next to CJK", line, f"{HAN}[,;:?!]|[,;:?!]{HAN}"), _found(r, 1, f"{r} halfwidth period next to CJK", line, period_pattern()))
    r = "zh-typography-2"
    add(r, _found(r, 0, f"{r} fullwidth paren", line, "[（）]"))
    r = "zh-typography-3"
    add(
        r,
        _found(r, 0, f"{r} no space before (", line, rf"(?:{HAN}|\*\*|`|\))\(|[A-Za-z0-9]\((?![A-Za-z0-9])"),
        _found(r, 1, f"{r} no space after )", line, rf"\)(?:[{WORD}]|\*\*[{WORD}]|`)"),
    )
    r = "zh-typography-4"
    add(r, _found(r, 0, f"{r} no space between CJK and Latin", line, f"{HAN}(?=[A-Za-z])|[A-Za-z](?={HAN})", _after))
    r = "zh-typography-5"
    add(r, _found(r, 0, f"{r} no space between CJK and digit", line, digit_boundary(config.skip_zh_units), _after))
    r = "zh-typography-6"
    add(r, _found(r, 0, f"{r} no space between number and unit", line, unit_pattern()))
    add("zh-typography-7", _code_edges(line))
    r = "zh-typography-8"
    edge = rf"[^{WS}—⸺]"
    dash = "(?:(?<!—)——(?!—)|⸺)"
    add(
        r,
        _found(r, 0, f"{r} no space before dash", line, f"(?<={edge}){dash}"),
        _found(r, 1, f"{r} no space after dash", line, f"{dash}(?={edge})"),
    )
    r = "zh-typography-9"
    add(r, _found(r, 0, f"{r} no space between CJK and link", line, rf"(?<={HAN})\[[^\]]*\]\("))
    r = "zh-typography-10"
    add(r, _found(r, 0, f"{r} fullwidth digit", line, "[０-９]"))
    r = "zh-typography-11"
    add(r, _found(r, 0, f"{r} space before fullwidth punct", line, f"{NEAR} +[{FULL}]"), _found(r, 1, f"{r} space after fullwidth punct", line, f"[{FULL}] +{NEAR}"))
    names = {"zh-tell-1": "formulaic phrase", "zh-tell-3": "corporate buzzword", "zh-tell-4": "chat residue", "en-tell-1": "AI vocabulary", "en-tell-3": "coding-agent register"}
    for r, what in names.items():
        add(r, _found(r, 0, f"{r} {what}", line, phrase_pattern(r)), first=True)
    r = "zh-tell-2"
    add(r, _found(r, 0, f"{r} negative parallelism", line, "(?s)不是.{0,20}?而是"))
    r = "en-tell-2"
    add(r, *[_found(r, i, f"{r} English negative parallelism", line, p) for i, p in enumerate(english_parallels())])
    r = "zh-tell-5"
    add(r, _found(r, 0, f"{r} zero-noun coinage", line, covered_guard("零", ZERO_ALLOWED) + f"零(?={HAN}{{1,4}}(?!{HAN}))"))
    r = "zh-word-1"
    low = F.lower(line)
    terms = []
    for i, (wrong, right, anchors) in enumerate(TERMS):
        near = F.lit(False)
        for a in anchors:
            near |= F.contains(low, F.lit(a))
        terms.append(F.when(near, _found(r, i, f"{r} term {wrong} -> {right}", line, wrong)).otherwise(none_of(MATCH)))
    add(r, *terms)
    r = "zh-word-2"
    add(r, _found(r, 0, f"{r} misused 秘密", line, covered_guard("秘密", SECRET_ALLOWED) + "秘密"))
    return F.concat(*found) if found else none_of(MATCH)
