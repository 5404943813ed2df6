"""Engines around small commands of our own: templates, frames, environment, limits, failures, choice, file mode."""

import os
import subprocess
import sys
import time
from pathlib import Path

import pytest

from prosemill.functions import engines as E
from prosemill.plans.config import ConfigError

ECHO = E.Engine("echo", (sys.executable, "-c", "import sys; sys.stdout.write(sys.stdin.read().split(chr(10), 1)[1].upper())"), "{payload}", credential_env=("ECHO_KEY",))


def script(code, **options):
    return E.Engine("x", (sys.executable, "-c", code), **options)


def test_settings_and_precedence(tmp_path):
    (tmp_path / ".git").mkdir()
    write = (tmp_path / "prosemill.toml").write_text
    assert E.settings(tmp_path, ["a"]) == E.Settings()
    write('[rewrite]\nengine = "a"\nmodel = "m"\n')
    own = E.settings(tmp_path, ["a"])
    assert own == E.Settings("a", "m")
    assert [E.wanted(f, {E.ENGINE_VARIABLE: v}, own) for f, v in (("f", "v"), ("", "v"), (None, ""))] == ["f", "v", "a"]
    for bad in ('engine = "b"', "engine = 1", 'command = ["c"]', 'engine = "custom"', 'engine = "custom"\ncommand = "c"'):
        write(f"[rewrite]\n{bad}\n")
        with pytest.raises(ConfigError):
            E.settings(tmp_path, ["a"])


def test_templates(tmp_path):
    e = E.Engine("a", ("a", "{spec_file}", "-m", "{model}", "{view}", "-o", "{answer_file}"), "{spec}|{payload}", "m", view_argv=("--ro", "x"))
    call = E.expand(e, "S", "T {model}", tmp_path, view=str(tmp_path))
    assert call.argv == ["a", str(tmp_path / "spec.md"), "-m", "m", "--ro", "x", "-o", str(tmp_path / "answer.txt")]
    spec, payload = call.stdin.decode().split("|")
    line, text = payload.split("\n", 1)
    assert text == "T {model}" and line in spec and spec == (tmp_path / "spec.md").read_text()
    assert E.expand(e, "S", "T", tmp_path).stdin != call.stdin and "--ro" not in E.expand(e, "S", "T", tmp_path).argv
    own = E.custom_engine(["c", "{spec_file}", "-{text}-"])
    assert E.expand(own, "S", "{spec_file}", tmp_path).argv[2] == "-{spec_file}-" and own.stdin == "" and E.custom_engine(["c"]).stdin == "{text}"
    with pytest.raises(E.EngineError, match="empty command"):
        E.expand(E.custom_engine([]), "S", "T", tmp_path)


def test_environment():
    env = {"PATH": "p", "LC_ALL": "C", "OTHER": "o", "ECHO_KEY": "k", E.HOOK_DISABLE: "1", "PWD": "/old"}
    assert E.child_env(ECHO, env, "/w") == {"PATH": "p", "LC_ALL": "C", "ECHO_KEY": "k", E.HOOK_DISABLE: "1", "PWD": "/w", "OLDPWD": "/w"}
    assert E.child_env(E.custom_engine(["c"]), env, "/w") == env


def test_answers_and_failures(tmp_path):
    env = dict(os.environ)
    assert E.ask(ECHO, "S", "甲a\r\n" * 30000, env) == "甲A\n" * 30000
    to_file = E.Engine("f", (sys.executable, "-c", "import sys; open(sys.argv[1], 'w').write(' ok ')", "{answer_file}"))
    assert E.ask(to_file, "S", "t", env) == "ok\n"
    for code, reason, state in (
        ("raise SystemExit('HTTP 401')", "rejected", "unauthorized"), ("raise SystemExit('ECONNREFUSED')", "unreachable", "unreachable"), ("raise SystemExit('x')", "nonzero exit", "failed"),
        ("", "empty answer", "failed"), ("import sys; sys.stdout.buffer.write(b'\\xff')", "unreadable answer", "failed"), ("print('x' * 3000000)", "other", "failed"),
    ):
        with pytest.raises(E.EngineError) as e:
            E.ask(script(code), "S", "t", env)
        assert (e.value.reason, e.value.state) == (reason, state)
    with pytest.raises(E.EngineError) as e:
        E.ask(E.Engine("n", ("no-such-command",)), "S", "t", env)
    assert (e.value.reason, e.value.state) == ("not installed", "missing")


def test_deadline_ends_the_whole_group(tmp_path):
    mark = tmp_path / "late"
    child = f"import time; time.sleep(2); open({str(mark)!r}, 'w')"
    began = time.monotonic()
    with pytest.raises(E.EngineError) as e:
        E.ask(script(f"import subprocess, sys; subprocess.run([sys.executable, '-c', {child!r}])"), "S", "t", dict(os.environ), seconds=0.8)
    assert e.value.reason == "timed out" and time.monotonic() - began < 1.9
    time.sleep(2)
    assert not mark.exists()


def test_order_probe_and_choice(tmp_path):
    for name, body in {"good": f"echo {E.PROBE_MARKER}", "bad": "exit 1", "far": "echo offline; exit 1"}.items():
        (tmp_path / name).write_text(f"#!/bin/sh\n{body}\n")
        (tmp_path / name).chmod(0o755)
    (tmp_path / "login.json").write_text('{"account": 1}')
    bad, far, gone = E.Engine("bad", ("bad",)), E.Engine("far", ("far",), auth_file="login.json", auth_key="account"), E.Engine("gone", ("gone",))
    good = E.Engine("good", ("good",), host_env=("IN_GOOD",))
    env = {"PATH": f"{tmp_path}:/usr/bin:/bin", "HOME": str(tmp_path)}
    every = [bad, far, gone, good]
    assert [e.name for e in E.order(every, env)] == ["far", "bad", "good"]
    assert [e.name for e in E.order(every, env | {"IN_GOOD": "1"})] == ["good", "far", "bad"]
    assert [E.probe(e, env) for e in (bad, far, good)] == ["no credentials", "unreachable", "ok"]
    chosen, states = E.select(every, env, {}, 100.0)
    assert chosen is good and states == {"far": ("unreachable", 100.0), "bad": ("no credentials", 100.0), "good": ("ok", 100.0)}
    with pytest.raises(E.EngineError) as e:
        E.select([good, gone], env, {"good": ("failed", 50.0)}, 100.0)
    assert str(e.value).split("\n")[1:] == ["  good: failed (50 s ago)", "  gone: missing"] and e.value.reason == "no engine"
    assert E.select([good], env, {"good": ("failed", 50.0)}, 1000.0)[0] is good


def test_file_mode(tmp_path):
    repo = tmp_path / "r"
    (repo / "sub" / ".own").mkdir(parents=True)
    for name in ("a.md", "sub/b.md", "sub/.own/c.md", "gone.md", ".mcp.json", "new.md"):
        (repo / name).write_text("x")
    (repo / "l.md").symlink_to("a.md")
    git = lambda *w: subprocess.run(["git", "-C", str(repo), *w], check=True, capture_output=True)
    git("init", "-q")
    git("add", "a.md", "sub", "gone.md", ".mcp.json", "l.md")
    (repo / "gone.md").unlink()
    assert E.tracked(repo) == ["a.md", "sub/.own/c.md", "sub/b.md"]
    assert E.export_view(repo, tmp_path / "v", [E.Engine("e", ("e",), own_files=(".own",))]) == ["a.md", "sub/b.md"]
    assert sorted(p.name for p in Path(tmp_path / "v").rglob("*.md")) == ["a.md", "b.md"]
    assert E.file_targets(["b.md"], repo / "sub", "e", True) == [("b.md", "sub/b.md")]
    assert E.file_targets(["a.md", "l.md"], repo, "e", True, walked=True) == [("a.md", "a.md")]
    (tmp_path / "out.md").write_text("x")
    for files, engine, consent in ((["a.md"], "e", False), (["a.md"], E.CUSTOM, True), (["l.md"], "e", True), (["../out.md"], "e", True)):
        with pytest.raises(E.Refused):
            E.file_targets(files, repo, engine, consent)
    with pytest.raises(E.Refused):
        E.file_targets(["out.md"], tmp_path, "e", True)
