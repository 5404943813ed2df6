"""Markdown files as a source and sink: walking, ignore patterns, strict reading, careful writing.

Listing runs on the driver (it is metadata); contents are read by executors as ``binaryFile``
where the store allows it. The reading side rejects invalid UTF-8 instead of replacing it.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.functions.text import universal_newlines
from prosemill.plans.config import TOOL

_ENDS = re.compile("\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")


class IgnoreError(ValueError):
    """An ignore pattern that cannot be used."""


def _segment(glob: str) -> str | None:
    """One path segment as a regular expression; None if a character class stays open."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "\\" and i + 1 < len(glob):
            out, i = out + re.escape(glob[i + 1]), i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[":
            start = i + 1 + (glob[i + 1 : i + 2] in ("!", "^"))
            end = glob.find("]", start + 1)
            if end < 0:
                return None
            body = glob[start:end].replace("\\", "\\\\").replace("[", "\\[")
            out, i = out + ("[^/" if start > i + 1 else "[") + body + "]", end + 1
        else:
            out, i = out + re.escape(c), i + 1
    return out


@dataclass(frozen=True)
class Pattern:
    """One line: its number, a regular expression over paths relative to the file's folder, and what it says."""

    number: int
    regex: re.Pattern
    keeps: bool
    folders_only: bool


def compile_patterns(text: str, name: str = "ignore file") -> list[Pattern]:
    """Gitignore syntax; braces are literal, a class must close within its segment (else the line matches nothing)."""
    out = []
    for number, line in enumerate(_ENDS.split(text), 1):
        if line.rstrip() == "!":
            raise IgnoreError(f"{name}:{number}: negation requires a pattern")
        body = line if line.endswith("\\ ") else line.rstrip()
        if not body or body.startswith("#"):
            continue
        keeps = body.startswith("!")
        body = body[1:] if keeps else body
        folders = body.endswith("/")
        body = body.rstrip("/") if folders else body
        anchored = "/" in body
        parts = []
        for part in body.lstrip("/").split("/"):
            one = ".*" if part == "**" else _segment(part)
            if one is None:
                break
            parts.append(one)
        else:
            regex = "/".join(parts).replace("/.*/", "/(?:.*/)?")
            regex = re.sub(r"^\.\*/", "(?:.*/)?", regex)
            out.append(Pattern(number, re.compile(regex if anchored else f"(?:.*/)?{regex}", re.S), keeps, folders))
    return out


def ignores(patterns: list[Pattern], path: str) -> bool:
    """Is a file, by its path relative to the patterns' folder, ignored? A match of the file itself outranks its folders'."""
    own = [p for p in patterns if not p.folders_only and p.regex.fullmatch(path)]
    if own:
        return not own[-1].keeps
    above, best = path.split("/")[:-1], None
    for k in range(len(above), 0, -1):
        hit = [p for p in patterns if p.regex.fullmatch("/".join(above[:k]))]
        if hit and (best is None or hit[-1].number > best.number):
            best = hit[-1]
    return best is not None and not best.keeps


def find_ignore(start: str | os.PathLike, tool: str = TOOL) -> Path | None:
    """The nearest ignore file upward, no further than the repository's root."""
    at = Path(start).resolve()
    for folder in (at, *at.parents):
        if (found := folder / f".{tool}-ignore").is_file():
            return found
        if (folder / ".git").exists():
            return None
    return None


def not_ignored(paths: list[str], cwd: str | os.PathLike = ".", tool: str = TOOL) -> list[str]:
    """The paths that no pattern ignores: order, repeats and spelling stay."""
    found = find_ignore(cwd, tool)
    if found is None:
        return list(paths)
    patterns, root = compile_patterns(found.read_text("utf-8"), str(found)), found.parent

    def inside(p: str) -> str | None:
        full = Path(os.path.abspath(os.path.join(cwd, p)))
        return full.relative_to(root).as_posix() if full.is_relative_to(root) else None

    return [p for p in paths if (r := inside(p)) is None or not ignores(patterns, r)]


def _user_excludes() -> Path | None:
    """The file that the user's git configuration names, or git's default place."""
    home = Path(os.environ.get("HOME") or "/")
    config = Path(os.environ.get("XDG_CONFIG_HOME") or home / ".config") / "git"
    for own in (home / ".gitconfig", config / "config"):
        if own.is_file():
            core = re.findall(r"(?ims)^[ \t]*\[core\][^\n]*\n(.*?)(?=^[ \t]*\[|\Z)", own.read_text("utf-8", "replace"))
            named = [m for part in core for m in re.findall(r'(?im)^[ \t]*excludesfile[ \t]*=[ \t]*"?([^"\n]+?)"?[ \t]*$', part)]
            if named:
                return Path(re.sub(r"^~(?=/)", str(home), named[-1]))
    return config / "ignore"


class GitIgnores:
    """What ignore files say of a path: ``.ignore`` of every folder above it, nearest first; inside a repository also
    ``.gitignore`` up to its root, its ``info/exclude`` and the user's excludes. The first that says anything decides."""

    def __init__(self, user: Path | None = None):
        self._read: dict[Path, list[Pattern]] = {}
        self._user = user or _user_excludes()

    def _says(self, file: Path, base: Path, path: Path) -> bool | None:
        if file not in self._read:
            self._read[file] = compile_patterns(file.read_text("utf-8", "replace"), str(file)) if file.is_file() else []
        local = path.relative_to(base).as_posix()
        hit = [p for p in self._read[file] if p.regex.fullmatch(local) and (not p.folders_only or path.is_dir())]
        return None if not hit else not hit[-1].keeps

    def hides(self, path: Path) -> bool:
        above = list(path.parents)
        files = [(f / ".ignore", f) for f in above]
        root = next((i for i, f in enumerate(above) if (f / ".git").exists()), None)
        if root is not None:
            files += [(f / ".gitignore", f) for f in above[: root + 1]]
            files += [(above[root] / ".git" / "info" / "exclude", above[root]), (self._user, above[root])]
        return next((x for file, base in files if (x := self._says(file, base, path)) is not None), False)


def walk_markdown(cwd: str | os.PathLike, user_excludes: Path | None = None) -> list[str]:
    """All ``*.md`` below cwd, sorted: hidden ones too, ``.git`` left out, folder links not followed, git's ignore files heeded."""
    root, out = Path(cwd).absolute(), []
    ignores = GitIgnores(user_excludes)

    def failed(error: OSError):
        raise error

    for folder, folders, names in os.walk(root, onerror=failed):
        here = Path(folder)
        folders[:] = sorted(f for f in folders if f != ".git" and not (here / f).is_symlink() and not ignores.hides(here / f))
        out += [(here / n).relative_to(root).as_posix() for n in names if n.endswith(".md") and not (here / n).is_dir() and not ignores.hides(here / n)]
    return sorted(out)


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """doc_id (order of the paths), path, text, valid: strict UTF-8 with LF line ends; text is null where bytes are invalid."""
    if not paths:
        return spark.createDataFrame([], "doc_id long, path string, text string, valid boolean")
    # Spark's readers leave out names that start with a dot or an underscore; the driver reads those few.
    skipped = [p for p in paths if Path(p).name.startswith((".", "_"))]
    order = spark.createDataFrame([(i, p, os.path.abspath(p)) for i, p in enumerate(paths)], "doc_id long, path string, at string")
    raw = spark.createDataFrame([(os.path.abspath(p), bytearray(Path(p).read_bytes())) for p in dict.fromkeys(skipped)], "at string, content binary")
    if plain := sorted({Path(os.path.abspath(p)).as_uri() for p in paths if p not in skipped}):
        found = spark.read.format("binaryFile").load(plain)
        raw = raw.unionByName(found.select(F.url_decode(F.regexp_replace("path", "^file:/+", "/")).alias("at"), "content"))
    joined = order.join(raw, "at", "left")
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), universal_newlines(F.col("content").cast("string")))
    return joined.select("doc_id", "path", text.alias("text"), text.isNotNull().alias("valid"))


def write_fixed(fixed: DataFrame) -> int:
    """Writes rows (path, text, fixed) that changed, through the existing file, LF only. Unchanged files keep bytes and time."""
    n = 0
    for r in fixed.where("fixed is not null and not (text <=> fixed)").select("path", "fixed").toLocalIterator():
        with open(r["path"], "r+", encoding="utf-8", newline="\n") as f:
            f.seek(0)
            f.write(r["fixed"])
            f.truncate()
        n += 1
    return n


def write_if_unchanged(path: str, before: bytes, text: str) -> bool:
    """Compare and write: False, and nothing written, if the file's bytes are no longer those read."""
    with open(path, "rb+") as f:
        if f.read() != before:
            return False
        f.seek(0)
        f.write(text.encode("utf-8"))
        f.truncate()
    return True


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) of two snapshots (path, length, hash): added, removed or changed."""
    a, b = before.alias("a"), after.alias("b")
    change = F.when(F.col("a.path").isNull(), "added").when(F.col("b.path").isNull(), "removed").when(~(F.col("a.length").eqNullSafe(F.col("b.length")) & F.col("a.hash").eqNullSafe(F.col("b.hash"))), "changed")
    return a.join(b, F.col("a.path") == F.col("b.path"), "full_outer").select(F.coalesce("a.path", "b.path").alias("path"), change.alias("change")).where("change is not null")


def snapshot(docs: DataFrame) -> DataFrame:
    """path, length, hash of documents (path, text)."""
    return docs.select("path", F.octet_length("text").cast("long").alias("length"), F.sha2("text", 256).alias("hash"))
