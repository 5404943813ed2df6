"""Command line: check and fix files, rewrite standard input, check lexicon files.

Exit codes: 0 clean or warnings only; 1 an error was found, or reading or writing failed;
2 the call, the configuration or a directive cannot be used.
"""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Callable, Mapping
from pathlib import Path
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.functions import engines as E
from prosemill.operators import lexicon
from prosemill.operators.check import check, ordered, report
from prosemill.operators.directives import DirectiveError
from prosemill.operators.fix import fix
from prosemill.plans.config import TOOL, ConfigError, resolve
from prosemill.sources.files import IgnoreError, not_ignored, read_files, walk_markdown, write_fixed

# Exit codes.
SUCCESS, FINDINGS, USAGE = 0, 1, 2


class Failed(Exception):
    """A file that cannot be read."""


def _session() -> SparkSession:
    return SparkSession.builder.appName(TOOL).config("spark.ui.enabled", "false").getOrCreate()


def _names(values: list[str] | None) -> list[str] | None:
    return None if values is None else [n.strip() for v in values for n in v.split(",") if n.strip()]


def _told(findings: DataFrame, tail: str, clean: str, out: TextIO) -> int:
    """Prints one message a finding, streamed, and the counts."""
    errors = total = 0
    for r in findings.select("message", "severity").toLocalIterator():
        print(r["message"], file=out)
        total += 1
        errors += r["severity"] == "error"
    print(f"\n{errors} error(s), {total - errors} warning(s){tail}" if total else clean, file=out)
    return FINDINGS if errors else SUCCESS


def _read(spark: SparkSession, paths: list[str], cwd: str) -> DataFrame:
    """doc_id, path as given, text; raises on the first file that is missing or no UTF-8."""
    for p in paths:
        if not Path(cwd, p).is_file():
            raise Failed(f"cannot read {p}")
    given = spark.createDataFrame(list(enumerate(paths)), "doc_id long, given string")
    docs = read_files(spark, [os.path.join(cwd, p) for p in paths]).join(given, "doc_id")
    if bad := docs.where("not valid").orderBy("doc_id").first():
        raise Failed(f"{bad['given']} is not valid UTF-8")
    return docs


def _check(args: argparse.Namespace, cwd: str, out: TextIO, session: Callable[[], SparkSession]) -> int:
    config = resolve(cwd, _names(args.disable), _names(args.enable))
    selected = walk_markdown(cwd) if args.all else args.files
    if not selected:
        raise E.Refused("no files given (use --all or list files)")
    paths = not_ignored(selected, cwd)
    if not paths:
        print("OK: 0 file(s) clean", file=out)
        return SUCCESS
    spark = session()
    docs = _read(spark, paths, cwd)
    named = docs.select("doc_id", "text", F.col("given").alias("path"))
    if args.fix:
        check(named, config, strict=True)  # an unknown rule in a directive stops the run before anything is written
        fixed = docs.join(fix(docs.select("doc_id", "text"), config), "doc_id").where("not (text <=> fixed)").persist()
        changed = [r["given"] for r in fixed.select("doc_id", "given").orderBy("doc_id").collect()]  # names only
        write_fixed(fixed)
        fixed.unpersist()
        for path in dict.fromkeys(changed):
            print(f"fixed: {path}", file=out)
        named = _read(spark, paths, cwd).select("doc_id", "text", F.col("given").alias("path"))
    return _told(report(ordered(check(named, config, strict=True))), ". --fix auto-fixes most.", f"OK: {len(paths)} file(s) clean", out)


def _lexicon(args: argparse.Namespace, cwd: str, out: TextIO, session: Callable[[], SparkSession]) -> int:
    found = report(lexicon.lint(session(), args.files, cwd))
    return _told(found.orderBy("path", "line", "doc_id", "rule_ord", "start"), " in the lexicon prose.", f"OK: {len(args.files)} lexicon file(s) clean", out)


def _rewrite(args: argparse.Namespace, cwd: str, env: Mapping[str, str], text: TextIO, out: TextIO) -> int:
    """Standard input, rewritten on standard output."""
    presets = E.read_engines(Path(cwd, args.engines).read_text("utf-8")) if args.engines else []
    own = E.settings(cwd, [e.name for e in presets])
    given = text.read()
    if not given.strip():
        raise E.Refused("nothing on standard input to rewrite")
    name = E.wanted(args.engine, env, own)
    if name == E.AUTO:
        import time

        engine, _ = E.select(presets, env, {}, time.time())
    elif name == E.CUSTOM:
        if not own.command:
            raise ConfigError("engine 'custom' needs rewrite.command")
        engine = E.custom_engine(own.command)
    else:
        engine = next((e for e in presets if e.name == name), None)
        if engine is None:
            raise ConfigError(f"unknown engine '{name}'; pick one of {', '.join([E.AUTO, *(e.name for e in presets), E.CUSTOM])}")
    out.write(E.ask(engine, Path(cwd, args.spec).read_text("utf-8"), given, env, args.model or own.model, cwd=cwd))
    return SUCCESS


def main(argv: list[str] | None = None, cwd: str = ".", env: Mapping[str, str] = os.environ, text: TextIO | None = None, out: TextIO | None = None, err: TextIO | None = None, session: Callable[[], SparkSession] = _session) -> int:
    out, err, argv = out or sys.stdout, err or sys.stderr, list(sys.argv[1:] if argv is None else argv)
    parser = argparse.ArgumentParser(prog=TOOL)
    what = argv.pop(0) if argv[:1] and argv[0] in ("rewrite", "lint-lexicon") else "check"
    if what == "rewrite":
        parser.add_argument("input", choices=["-"], help="standard input")
        parser.add_argument("--spec", required=True, metavar="FILE", help="what the engine is to do")
        parser.add_argument("--engines", metavar="FILE", help="engines, a TOML table each")
        parser.add_argument("--engine")
        parser.add_argument("--model")
    elif what == "lint-lexicon":
        parser.add_argument("files", nargs="+", metavar="FILE")
    else:
        parser.add_argument("--all", action="store_true", help="every Markdown file below the current directory")
        parser.add_argument("--fix", action="store_true", help="fix what can be fixed, then check")
        parser.add_argument("--disable", action="append", metavar="RULE", help="rules, repeated or by commas; overrides the configuration file")
        parser.add_argument("--enable", action="append", metavar="RULE", help="rules that are off by default, likewise")
        parser.add_argument("files", nargs="*", metavar="FILE")
    try:
        args = parser.parse_args(argv)
        if what == "rewrite":
            return _rewrite(args, cwd, env, text or sys.stdin, out)
        return (_lexicon if what == "lint-lexicon" else _check)(args, cwd, out, session)
    except SystemExit as e:
        return SUCCESS if e.code in (0, None) else USAGE
    except (E.Refused, ConfigError, DirectiveError) as e:
        print(f"error: {e}", file=err)
        return USAGE
    except (Failed, IgnoreError, E.EngineError, OSError, UnicodeDecodeError, KeyError) as e:
        print(f"error: {e}", file=err)
        return FINDINGS
    except ValueError as e:  # a file that is not the TOML it should be
        print(f"error: {e}", file=err)
        return FINDINGS
