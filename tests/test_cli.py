"""The command line: exit codes, messages, fixing, standard input, lexicon files; and the ignore files of a walk."""

import io
import sys

from prosemill import cli
from prosemill.operators import lexicon
from prosemill.sources import files

LEXICON = '''title = "词表"
subtitle = "s"
preface = ["好。", "甲A"]
# title = "不算"
standard = """
一行。
第1个。
"""
threshold = "甲B\\n乙C"

[[entry]]
term = "甲X"
pinyin = ["jiǎ"]
plain = "甲。"
gloss = \'乙D\'
fault = "病。"
examples = [{ before = "前。", after = "后E" }]
'''


def run(spark, cwd, *argv, text="", env=None):
    out, err = io.StringIO(), io.StringIO()
    code = cli.main(list(argv), str(cwd), env or {}, io.StringIO(text), out, err, lambda: spark)
    return code, out.getvalue(), err.getvalue()


def test_check_and_fix(spark, tmp_path):
    (tmp_path / ".git").mkdir()
    (tmp_path / "b.md").write_text("好。\n甲A\n")
    (tmp_path / "a.md").write_text("好。\n")
    code, out, _ = run(spark, tmp_path, "--all")
    lines = out.split("\n")
    assert code == 1 and lines[0].startswith("b.md:2: error: [zh-typography-4") and lines[1:] == ["", "1 error(s), 0 warning(s). --fix auto-fixes most.", ""]
    assert run(spark, tmp_path, "b.md", "--disable", "zh-typography-4,zh-typography-5")[:2] == (0, "OK: 1 file(s) clean\n")
    assert run(spark, tmp_path, "--fix", "b.md", "a.md")[:2] == (0, "fixed: b.md\nOK: 2 file(s) clean\n")
    assert (tmp_path / "b.md").read_text() == "好。\n甲 A\n"


def test_exit_codes(spark, tmp_path):
    (tmp_path / ".git").mkdir()
    (tmp_path / "x.md").write_bytes(b"\xff")
    (tmp_path / "d.md").write_text("<!-- prosemill-disable no-such-rule -->\n甲A\n")
    (tmp_path / ".prosemill-ignore").write_text("v.md\n")
    for argv, want in (((), 2), (("--no-such",), 2), (("a.md", "--disable", "no-such"), 2), (("x.md",), 1), (("none.md",), 1), (("--help",), 0), (("v.md",), 0), (("d.md",), 2), (("d.md", "--fix"), 2)):
        assert run(spark, tmp_path, *argv)[0] == want, argv
    assert (tmp_path / "d.md").read_text().endswith("甲A\n")


def test_rewrite_standard_input(spark, tmp_path):
    (tmp_path / ".git").mkdir()
    (tmp_path / "s.md").write_text("spec")
    (tmp_path / "prosemill.toml").write_text(f'[rewrite]\nengine = "custom"\ncommand = [{sys.executable!r}, "-c", "import sys; print(sys.stdin.read().upper())"]\n')
    call = ("rewrite", "-", "--spec", "s.md")
    assert run(spark, tmp_path, *call, text="a甲")[:2] == (0, "A甲\n")
    assert run(spark, tmp_path, *call, text=" \n")[0] == 2
    assert run(spark, tmp_path, *call, "--engine", "other", text="a")[0] == 2
    assert run(spark, tmp_path, *call, "--engine", "auto", text="a")[0] == 1


def test_lexicon(spark, tmp_path):
    (tmp_path / ".git").mkdir()
    (tmp_path / "l.toml").write_text(LEXICON)
    assert lexicon.prose(LEXICON)[2:5] == [("好。", [3]), ("甲A", [3]), ("一行。\n第1个。\n", [6, 7, 6])]
    found = lexicon.lint(spark, ["l.toml"], str(tmp_path))
    # The line of a string that shares its line with its key reads otherwise: the field's first line stands for it.
    assert sorted({r["line"] for r in found.collect()}) == [3, 7, 9, 15, 17]
    code, out, _ = run(spark, tmp_path, "lint-lexicon", "l.toml")
    assert code == 1 and out.split("\n")[0].startswith("l.toml:3: error: [zh-typography-4") and out.endswith(" warning(s) in the lexicon prose.\n")
    (tmp_path / "l.toml").write_text('title = "好。"\n')
    assert run(spark, tmp_path, "lint-lexicon", "l.toml")[:2] == (0, "OK: 1 lexicon file(s) clean\n")
    (tmp_path / "l.toml").write_text("title = \n")
    assert run(spark, tmp_path, "lint-lexicon", "l.toml")[0] == 1


def test_ignore_files_of_a_walk(tmp_path, monkeypatch):
    here = tmp_path / "r" / "in"
    for name in ("a.md", "e.md", "p.md", "u.md", "k.md", "sub/n.md", "nest/p.md", "o.md"):
        (here / name).parent.mkdir(parents=True, exist_ok=True)
        (here / name).write_text("x")
    (tmp_path / ".gitignore").write_text("a.md\n")
    (tmp_path / ".ignore").write_text("o.md\n")
    (tmp_path / "r" / ".git" / "info").mkdir(parents=True)
    (tmp_path / "r" / ".git" / "info" / "exclude").write_text("e.md\n")
    (tmp_path / "r" / ".gitignore").write_text("/in/p.md\nk.md\nsub/\n")
    (here / ".ignore").write_text("!k.md\n")
    home = tmp_path / "home"
    home.mkdir()
    (home / ".gitconfig").write_text("[user]\n\tname = x\n[core]\n\texcludesFile = ~/mine\n")
    (home / "mine").write_text("u.md\n")
    monkeypatch.setenv("HOME", str(home))
    assert files.walk_markdown(here) == ["a.md", "k.md", "nest/p.md"]
    (tmp_path / "r" / ".git").rename(tmp_path / "r" / "git")
    assert files.walk_markdown(here) == ["a.md", "e.md", "k.md", "nest/p.md", "p.md", "sub/n.md", "u.md"]
