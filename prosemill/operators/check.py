"""Check: documents in, findings out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosemill.functions.text import byte_at, check_lines, snippet
from prosemill.operators import directives, markdown
from prosemill.operators.rules import line_matches
from prosemill.plans.config import IDS, ORDER, Config

FRONT = "yaml-frontmatter-1"
FINDING = ["doc_id", "path", "line", "rule_ord", "rule", "name", "start", "end", "snippet", "severity"]


def with_path(docs: DataFrame) -> DataFrame:
    return docs if "path" in docs.columns else docs.withColumn("path", F.lit(None).cast("string"))


def protected_lines(docs: DataFrame, config: Config, lines: Column | None = None) -> DataFrame:
    """doc_id, path, line_no, line with verbatim, code, prose and mask."""
    d = markdown.explode_lines(with_path(docs), check_lines(F.col("text")) if lines is None else lines, "path")
    return directives.masks(markdown.protect(d), config.directive_prefix)


def front_matter_error(lines: list[str]) -> tuple[int, int, int, str] | None:
    """(line index, start, end, name) of the one finding in a document's front matter."""
    import yaml

    fence = [i for i, t in enumerate(lines) if t.rstrip() == "---"]
    if not fence or fence[0] != 0:
        return None
    if len(fence) < 2:
        return 0, 0, len(lines[0]), f"{FRONT} front matter has no closing ---"
    close = fence[1]
    try:
        for _ in yaml.parse("\n".join(lines[1:close])):
            pass
    except yaml.YAMLError as e:
        mark = getattr(e, "problem_mark", None)
        at = min(max((mark.line if mark else 0) + 1, 1), close)
        col = min(mark.column if mark else 0, len(lines[at]))
        return at, col, col, f"{FRONT} invalid YAML front matter: {getattr(e, 'problem', None) or e}"
    return None


def _front_matter(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, ord, pat, name, s, e for documents named SKILL.md; only they reach Python."""
    skill = with_path(docs).where(F.regexp_extract("path", r"[^/]+\z", 0) == "SKILL.md").select("doc_id", check_lines(F.col("text")).alias("lines"))

    def run(frames):
        for pdf in frames:
            rows = [(d, *hit) for d, lines in zip(pdf["doc_id"], pdf["lines"], strict=True) if (hit := front_matter_error(list(lines)))]
            yield pd.DataFrame([(d, i + 1, s, e, n) for d, i, s, e, n in rows], columns=["doc_id", "line_no", "s", "e", "name"])

    found = skill.mapInPandas(run, "doc_id long, line_no int, s int, e int, name string")
    return found.select("doc_id", "line_no", F.struct(F.lit(ORDER[FRONT]).alias("ord"), F.lit(0).alias("pat"), "name", "s", "e").alias("m"))


def check(docs: DataFrame, config: Config | None = None, strict: bool = False) -> DataFrame:
    """Findings of ``docs`` (doc_id, text, optionally path), unsorted; see ``ordered``.

    Null text has no lines. ``strict`` raises on directives that name unknown rules, at the
    price of one job; otherwise those names are ignored (see ``directives.errors``).
    """
    config = config or Config()
    lines = protected_lines(docs, config)
    if strict and (bad := directives.errors(lines).orderBy("doc_id", "line").first()):
        raise directives.DirectiveError(f"document {bad['doc_id']}, line {bad['line']}: unknown rules {bad['unknown']}")
    hits = lines.where("not verbatim").select("doc_id", "path", "line_no", "line", "mask", F.explode(line_matches(config)).alias("m"))
    if config.on(FRONT):
        front = lines.select("doc_id", "path", "line_no", "line", "mask").join(_front_matter(docs), ["doc_id", "line_no"])
        hits = hits.unionByName(front)
    hits = hits.where(F.shiftright(F.col("mask"), 0).bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(len(IDS))]), F.col("m.ord") + 1)) == 0)
    ids, levels = F.array(*map(F.lit, IDS)), F.array(*[F.lit(config.severity_of(r)) for r in IDS])
    return hits.select(
        "doc_id", "path", F.col("line_no").cast("long").alias("line"), F.col("m.ord").cast("long").alias("rule_ord"), F.element_at(ids, F.col("m.ord") + 1).alias("rule"), F.col("m.name").alias("name"),
        byte_at(F.col("line"), F.col("m.s")).cast("long").alias("start"), byte_at(F.col("line"), F.col("m.e")).cast("long").alias("end"),
        snippet(F.col("line"), F.col("m.s"), F.col("m.e")).alias("snippet"), F.element_at(levels, F.col("m.ord") + 1).alias("severity"), F.col("m.pat").alias("pat_ord"),
    )


def ordered(findings: DataFrame) -> DataFrame:
    """Report order: document, line, rule, start, pattern."""
    return findings.orderBy("doc_id", "line", "rule_ord", "start", "pat_ord")


def report(findings: DataFrame) -> DataFrame:
    """One message a finding."""
    where = F.coalesce("path", F.col("doc_id").cast("string"))
    return findings.withColumn("message", F.format_string("%s:%d: %s: [%s] …%s…", where, "line", "severity", "name", "snippet"))


def summary(findings: DataFrame) -> DataFrame:
    """errors, warnings, exit_code."""
    errors = F.count_if(F.col("severity") == "error")
    return findings.agg(errors.cast("long").alias("errors"), (F.count("*") - errors).cast("long").alias("warnings"), F.when(errors > 0, 1).otherwise(0).cast("long").alias("exit_code"))


def clean_documents(docs: DataFrame, findings: DataFrame) -> DataFrame:
    return docs.join(findings.select("doc_id").distinct(), "doc_id", "left_anti")
