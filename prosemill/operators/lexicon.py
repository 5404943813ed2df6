"""Check of lexicon files: each prose field is a document, findings come back at lines of the file."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.operators.check import check
from prosemill.plans.config import EXPERIMENTAL, ORDER, resolve

# Prose fields of a file, of an entry and of an example.
HEAD, ENTRY, EXAMPLE = ("title", "subtitle", "preface", "standard", "threshold"), ("plain", "gloss", "fault"), ("before", "after")
_TOKEN = re.compile(
    r"""(?P<comment>\#[^\n]*)|(?P<long>\"{3}(?:[^\\]|\\.)*?\"{3,5}|'{3}.*?'{3,5})|(?P<short>"(?:[^"\\\n]|\\.)*"|'[^'\n]*')|(?P<key>[A-Za-z0-9_-]+)[ \t]*=""",
    re.S | re.X,
)


def _starts(source: str) -> dict[str, list[int]]:
    """Where the contents of each key's strings begin, in the order of the file."""
    out: dict[str, list[int]] = {}
    key = ""
    for m in _TOKEN.finditer(source):
        if m["key"]:
            key = m["key"]
        elif m["long"]:
            at = m.start() + 3
            out.setdefault(key, []).append(at + (2 if source.startswith("\r\n", at) else source.startswith("\n", at)))
        elif m["short"]:
            out.setdefault(key, []).append(m.start() + 1)
    return out


def prose(source: str) -> list[tuple[str, list[int]]]:
    """(field, line of the file for each of its lines), in document order.

    A line of a field is that line of the file only if both read alike; where an escape makes
    them differ, the field's first line stands for it.
    """
    table = tomllib.loads(source)
    starts = {k: iter(v) for k, v in _starts(source).items()}
    lines = [x.removesuffix("\r") for x in source.split("\n")]
    fields: list[tuple[str, str]] = []
    for key in HEAD:
        value = table.get(key, [])
        fields += [(key, v) for v in (value if isinstance(value, list) else [value])]
    for entry in table.get("entry", table.get("entries", [])):
        fields += [(k, entry[k]) for k in ENTRY]
        fields += [(k, x[k]) for x in entry.get("examples", []) for k in EXAMPLE]
    out = []
    for key, value in fields:
        first = source.count("\n", 0, next(starts[key])) + 1
        own = enumerate(value.split("\n"), first)
        out.append((value, [n if n <= len(lines) and lines[n - 1] == x.removesuffix("\r") else first for n, x in own]))
    return out


def lint(spark: SparkSession, paths: Iterable[str], cwd: str = ".") -> DataFrame:
    """Findings (path, line of the file, name, snippet, severity, ...) by all rules that are not experimental; ``summary`` counts them."""
    rows = [(path, *field) for path in paths for field in prose(Path(cwd, path).read_text("utf-8"))]
    fields = spark.createDataFrame([(i, p, t, at) for i, (p, t, at) in enumerate(rows)], "doc_id long, path string, text string, at array<int>")
    found = check(fields.select("doc_id", "text"), resolve(cwd, disable=sorted(EXPERIMENTAL, key=ORDER.get)), strict=True)
    at = F.coalesce(F.get("at", (F.col("line") - 1).cast("int")), F.get("at", F.lit(0))).cast("long")
    return found.drop("path").join(fields.select("doc_id", "path", "at"), "doc_id").withColumn("line", at).drop("at")
