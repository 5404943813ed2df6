"""The fix of one text in plain Python, for a text that a single worker holds: a message of the stream.

Patterns, order and replacements are those of ``fix.chain`` and ``markdown``, compiled for
``regex``; only the walk over lines is written here. ``fix_text`` gives what ``fix`` gives for
a document of that text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import regex

from prosemill.functions.text import DIGITS, WIDE_DIGITS, WS
from prosemill.operators import directives, markdown
from prosemill.operators.fix import PASSES, chain
from prosemill.operators.rules import HAN
from prosemill.plans.config import IDS, ORDER, Config
from prosemill.resources.lists import TERMS

Range = tuple[int, int]
_BITS = {r: 1 << i for i, r in enumerate(IDS)}


@lru_cache(maxsize=None)
def compiled(pattern: str) -> regex.Pattern:
    """A pattern of the library for ``regex``, which spells two things otherwise."""
    return regex.compile(pattern.replace(r"\p{IsWhite_Space}", r"\p{White_Space}").replace(r"\z", r"\Z"))


@dataclass
class Line:
    """One line: ``para`` is None outside paragraphs; ranges are code points, half open."""

    text: str
    verbatim: bool = False
    single: bool = False
    para: int | None = None
    code: list[Range] = field(default_factory=list)
    unpaired: bool = False
    mask: int = 0


def pair(sizes: list[int]) -> tuple[list[Range], bool]:
    """Pairs (i, j) of backtick runs of equal size, from the left, and whether some run has no partner."""
    later: dict[int, list[int]] = {}
    for i in range(len(sizes) - 1, -1, -1):
        later.setdefault(sizes[i], []).append(i)
    pairs, alone, i = [], False, 0
    while i < len(sizes):
        same = later[sizes[i]]
        while same and same[-1] <= i:
            same.pop()
        if same:
            pairs.append((i, same[-1]))
            i = same[-1] + 1
        else:
            alone, i = True, i + 1
    return pairs, alone


def _pair_code(paragraph: list[Line]) -> None:
    joined = "\n".join(x.text for x in paragraph)
    runs = [m.span() for m in compiled("`+").finditer(joined)]
    pairs, alone = pair([e - s for s, e in runs])
    spans = [(runs[i][1], runs[j][0]) for i, j in pairs]
    at = first = 0
    for x in paragraph:
        end = at + len(x.text)
        while first < len(spans) and spans[first][1] < at:
            first += 1
        for a, b in spans[first:]:
            if a > end:
                break
            x.code.append((max(a, at) - at, min(b, end) - at))
        x.unpaired = alone
        at = end + 1


def structure(lines: list[str]) -> list[Line]:
    """Lines with fences, paragraphs and paired code spans."""
    fence, block, blank = compiled(markdown.FENCE), compiled(markdown.BLOCK), compiled(markdown.BLANK)
    single, quote = compiled(markdown.SINGLE), compiled(markdown.QUOTE)
    out: list[Line] = []
    inside, paras, before_text, before_quote, before_single = False, 0, False, False, False
    for t in lines:
        x = Line(t, single=bool(single.search(t)))
        here = bool(fence.search(t))
        x.verbatim = here or inside
        inside ^= here
        text = not x.verbatim and not blank.search(t)
        quoted = text and bool(quote.search(t))
        if text:
            if (block.search(t) and not (quoted and before_quote)) or not before_text or before_single:
                paras += 1
            x.para = paras
        before_text, before_quote, before_single = text, quoted, x.single
        out.append(x)
    paragraph: list[Line] = []
    for x in [*out, Line("")]:
        if paragraph and x.para != paragraph[-1].para:
            if any("`" in y.text for y in paragraph):
                _pair_code(paragraph)
            paragraph = []
        if x.para is not None:
            paragraph.append(x)
    return out


def _masks(lines: list[Line], prefix: str) -> None:
    form, trim = compiled(directives.pattern(prefix)), compiled(rf"[,{WS}]+")
    off = once = 0
    for x in lines:
        m = form.search(x.text) if not x.verbatim and "<!--" in x.text else None
        x.mask, once = off | once, 0
        if not m:
            continue
        x.mask = directives.ALL
        given = compiled(rf"^[{WS}]+|[{WS}]+\z").sub("", m[2] or "")
        ids = directives.ALL if not given else 0
        for name in trim.split(given):
            ids |= _BITS.get(name, 0)
        if m[1] == "disable":
            off |= ids
        elif m[1] == "enable":
            off &= ~ids
        else:
            once = ids


def _steps(config: Config, mask: int) -> Callable[[str, list[bool], bool, bool], str]:
    """The chain for lines under one mask."""

    def on(rule: str) -> bool:
        return config.on(rule) and not mask & (1 << ORDER[rule])

    swap = str.maketrans((WIDE_DIGITS if on("zh-typography-10") else "") + ("（）" if on("zh-typography-2") else ""), (DIGITS if on("zh-typography-10") else "") + ("()" if on("zh-typography-2") else ""))
    steps = [(r, compiled(p), by.replace("$", "\\")) for r, p, by in chain(config) if on("zh-typography-7" if r == "code" else r)]
    closing, opening = compiled(f"^(`+)(?={HAN})"), compiled(f"(?<={HAN})(`+)\\z")

    def run(x: str, near: list[bool], opens: bool, closes: bool) -> str:
        if on("zh-word-1"):
            for (wrong, right, _), good in zip(TERMS, near, strict=True):
                x = x.replace(wrong, right) if good else x
        x = x.translate(swap)
        for rule, pattern, by in steps:
            if rule != "code":
                x = pattern.sub(by, x)
                continue
            x = closing.sub(r"\1 ", x) if closes else x
            x = opening.sub(r" \1", x) if opens else x
        return x

    return run


def _pieces(x: Line) -> Iterator[tuple[str, str, bool, bool]]:
    """(fragment, protected span after it, does code open after it, does code close before it)."""
    line, prose = x.text, compiled(markdown.PROSE)
    quoted = markdown.claim_prose(line, x.code) if prose.search(line) else []
    spans = sorted([(a, b, True) for a, b in x.code] + [(a, b, False) for a, b in quoted])
    start, closes = 0, False
    for a, b, code in [*spans, (len(line), len(line), False)]:
        yield line[start:a], line[a:b], code and a > start and line[a - 1 : a] == "`", closes
        start, closes = b, code and line[b : b + 1] == "`"


def fix_once(text: str, config: Config) -> str:
    lines = structure(text.split("\n"))
    _masks(lines, config.directive_prefix)
    chains: dict[int, Callable] = {}
    out = []
    for x in lines:
        if x.verbatim:
            out.append(x.text)
            continue
        if x.mask not in chains:
            chains[x.mask] = _steps(config, x.mask)
        low = x.text.lower()
        near = [any(a in low for a in anchors) for _, _, anchors in TERMS]
        out.append("".join(chains[x.mask](part, near, opens, closes) + kept for part, kept, opens, closes in _pieces(x)))
    return "\n".join(out)


def fix_text(text: str, config: Config | None = None, passes: int = PASSES) -> str:
    """The fixpoint for one text."""
    config = config or Config()
    for _ in range(passes):
        fixed = fix_once(text, config)
        if fixed == text:
            return fixed
        text = fixed
    raise RuntimeError(f"fixing did not settle within {passes} passes")


def unclosed_run(text: str) -> bool:
    """Does the last paragraph, still open, hold a backtick run without partner?"""
    last = structure(text.removesuffix("\n").split("\n"))[-1]
    return last.para is not None and not last.single and last.unpaired
