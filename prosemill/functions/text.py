"""Character classes and position helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "一-鿿"
#: Unicode white space and the four ASCII separators, for use inside a Java character class.
WS = r"\p{IsWhite_Space}\x1c-\x1f"
WORD = f"A-Za-z0-9{CJK}"
KANA = "぀-ヿ"
WIDE_DIGITS, DIGITS = "０１２３４５６７８９", "0123456789"
#: Ends of the lines that a check sees.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
RADIUS = 12

SPAN = "array<struct<s:int,e:int,m:string>>"
RANGES = "array<struct<a:int,b:int>>"


def none_of(kind: str) -> Column:
    return F.array().cast(kind)


def matches(text: Column, pattern: str) -> Column:
    """Leftmost, non-overlapping, non-empty matches of a Java pattern: array of (s, e, m) in code points.

    Spark has no function for positions; they follow from the gaps that ``split`` leaves. Texts
    without a match do not pay for that.
    """
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("g"), m.alias("m")))

    def step(a, x):
        s = a["at"] + x["g"]
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), F.array_append(a["out"], F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m"))).alias("out"))

    placed = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none_of(SPAN).alias("out")), step, lambda a: a["out"])
    return F.when(text.rlike(pattern), placed).otherwise(none_of(SPAN))


def check_lines(text: Column) -> Column:
    """The lines of a check: ten separators, no empty last line."""
    parts = F.split(text, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def fix_lines(text: Column) -> Column:
    """The lines of a fix: LF only, an empty last line stays."""
    return F.split(text, "\n", -1)


def byte_at(line: Column, position: Column) -> Column:
    """UTF-8 bytes before a code-point position."""
    return F.octet_length(F.substring(line, F.lit(1), position))


def snippet(line: Column, s: Column, e: Column) -> Column:
    first = F.greatest(s - RADIUS, F.lit(0))
    return F.substring(line, first + 1, e + RADIUS - first)


def halfwidth_digits(text: Column) -> Column:
    return F.translate(text, WIDE_DIGITS, DIGITS)


def universal_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{WS}]+|[{WS}]+\\z", "")


def identifier(name: Column) -> Column:
    """Letters, digits and hyphens stay, every other byte becomes _XX; longer than 120 gives ''."""
    raw = F.regexp_extract_all(F.hex(F.encode(name, "utf-8")), F.lit("(..)"), F.lit(1))
    one = F.transform(raw, lambda h: F.when(F.decode(F.unhex(h), "iso-8859-1").rlike("^[A-Za-z0-9-]$"), F.decode(F.unhex(h), "iso-8859-1")).otherwise(F.concat(F.lit("_"), h)))
    joined = F.array_join(one, "")
    return F.when(F.length(joined) > 120, "").otherwise(joined)


def iso_timestamp(t: Column) -> Column:
    """UTC with +00:00; microseconds only if there are some. The session's time zone is UTC."""
    whole = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(t, "SSSSSS")
    return F.concat(whole, F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)), F.lit("+00:00"))


def normal_answer(text: Column) -> Column:
    """LF line ends, no outer white space, exactly one final LF; null where nothing is left."""
    body = trimmed(universal_newlines(text))
    return F.when(body != "", F.concat(body, F.lit("\n")))
