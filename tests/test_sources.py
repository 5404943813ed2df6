"""Files, ignore patterns, snapshots, rewriting around a fake engine, views, and the stream."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from prosemill.functions import rewrite
from prosemill.operators import views
from prosemill.operators.fix import fix
from prosemill.plans.config import resolve
from prosemill.sources import files
from prosemill.streaming import hook


@pytest.mark.parametrize(
    ("patterns", "path", "want"),
    [
        ("vendor/", "vendor/a.md", True), ("vendor/", "vendor", False), ("*.md", "a/b.md", True), ("/a.md", "b/a.md", False), ("a/*.md\n!a/i.md", "a/i.md", False),
        ("docs/**/x.md", "docs/x.md", True), ("docs/**/x.md", "docs/a/b/x.md", True), ("[ab].md", "b.md", True), ("[!a].md", "a.md", False), ("[ab.md", "[ab.md", False),
        ("[a/]b.md", "a/b.md", False), ("{a}.md", "{a}.md", True), ("#x", "#x", False), ("\\#x", "#x", True), ("a\n!a/b.md", "a/b.md", False), ("!a\na", "a/b.md", True),
    ],
)
def test_ignore(patterns, path, want):
    assert files.ignores(files.compile_patterns(patterns), path) is want


def test_bare_negation_is_an_error():
    with pytest.raises(files.IgnoreError):
        files.compile_patterns("a\n! ")


def test_files_round_trip(spark, tmp_path):
    for name, raw in {"a.md": "第1个CLI\r\n".encode(), ".h.md": b"fine\n", "sub/b.md": b"\xff", "sub/c.txt": b"x", ".git/d.md": b"x", "out/e.md": b"x", "v/f.md": b"x"}.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(raw)
    (tmp_path / ".gitignore").write_text("out/\n")
    (tmp_path / ".prosemill-ignore").write_text("v/\n")
    walked = files.walk_markdown(tmp_path)
    assert walked == [".h.md", "a.md", "sub/b.md", "v/f.md"]
    kept = files.not_ignored(walked, tmp_path)
    assert kept == [".h.md", "a.md", "sub/b.md"]
    docs = files.read_files(spark, [str(tmp_path / p) for p in kept])
    assert [(r["valid"], r["text"]) for r in docs.orderBy("doc_id").collect()] == [(True, "fine\n"), (True, "第1个CLI\n"), (False, None)]
    before = os.stat(tmp_path / ".h.md").st_mtime_ns
    assert files.write_fixed(docs.join(fix(docs), "doc_id")) == 1
    assert (tmp_path / "a.md").read_text("utf-8") == "第 1 个 CLI\n" and os.stat(tmp_path / ".h.md").st_mtime_ns == before
    assert not files.write_if_unchanged(str(tmp_path / "a.md"), b"other", "x")


def test_snapshot_diff(spark):
    a = files.snapshot(spark.createDataFrame([("p", "x"), ("q", "y"), ("r", "z")], "path string, text string"))
    b = files.snapshot(spark.createDataFrame([("p", "x"), ("q", "Y"), ("s", "z")], "path string, text string"))
    assert sorted(map(tuple, files.snapshot_diff(a, b).collect())) == [("q", "changed"), ("r", "removed"), ("s", "added")]


def test_rewrite(spark):
    docs = spark.createDataFrame([(1, "# a\n- b\n"), (2, "甲\n"), (3, "boom")], "doc_id long, text string")

    def engine(prompt, text):
        if text == "boom":
            raise RuntimeError
        return "  " + text.replace("- b", "b") + "\r\n" + ("" if prompt == "G" else "乙")

    done = rewrite.rewrite(docs, engine, rewrite.prompt(F.col("text"), "G", "C", "L"))
    good, bad = rewrite.accepted(done)
    assert [tuple(r) for r in good.select("doc_id", "answer").collect()] == [(2, "甲\n\n乙\n")]
    assert sorted(r["doc_id"] for r in bad.collect()) == [1, 3]


def test_states_and_classes(spark):
    states = spark.createDataFrame([("a", "ok", 0.0), ("a", "failed", 90.0), ("b", "ok", 50.0), ("c", "failed", -400.0)], "engine string, state string, at double")
    assert sorted((r["engine"], r["state"]) for r in rewrite.remembered(states, 100.0).collect()) == [("a", "failed"), ("b", "ok")]
    out = spark.createDataFrame([("HTTP 401 timeout",), ("ETIMEDOUT",), ("x",)], "o string").select(rewrite.classify(F.col("o")).alias("c"))
    assert [r["c"] for r in out.collect()] == ["unauthorized", "unreachable", "failed"]


def test_lexicon(spark):
    toml = 'title = "T"\nstandard = "S"\n[[entries]]\nterm = "甲"\npinyin = ["jiǎ"]\nplain = "p"\ngloss = "g"\nfault = "f"\nexamples = [{before = "x", after = "y"}]\n'
    title, standard, entries = rewrite.read_lexicon(spark, toml)
    assert rewrite.render_lexicon(title, standard, entries, full=False).first()["text"] == "# T\n\n## 甲\n\n- 白：p\n- 病：f\n"
    assert "- 原：x\n  改：y\n" in rewrite.render_lexicon(title, standard, entries).first()["text"]
    assert entries.select(rewrite.fold_pinyin(F.col("pinyin")).alias("x")).first()["x"] == "jia"


def test_views(spark):
    spark.createDataFrame([(1, "甲A")], "doc_id long, text string").createOrReplaceTempView("docs_v")
    views.register(spark, "docs_v")
    assert spark.sql("select rule from docs_v_findings").first()["rule"] == "zh-typography-4"
    assert spark.sql("select fixed from docs_v_fixed").first()["fixed"] == "甲 A"


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    row = '{"hook_event_name": "MessageDisplay", "session_id": "s", "message_id": "m", "turn_id": "t", "index": %s, "delta": "%s", "final": false}\n'
    (src / "a.json").write_text(row % (1, "甲A\\n") + "[1]\n" + row % ('"x"', "z\\n") + row % (0, "x\\n") + row % (2, ""))
    events = hook.events(spark.readStream.format("text").load(str(src)))
    out = hook.display(events, lambda t: t.replace("甲A", "甲 A"))
    query = out.writeStream.format("memory").queryName("shown").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for _ in range(120):  # timeouts keep such a query busy, so it is polled rather than drained
            if spark.sql("select * from shown").count():
                break
            time.sleep(0.5)
    finally:
        query.stop()
    assert [(r["index"], r["shown"], r["kind"]) for r in spark.sql("select * from shown").collect()] == [(1, "甲 A\n", None)]


def test_started_stream_fixes_by_itself(spark, tmp_path):
    src, quiet = tmp_path / "in", tmp_path / "quiet"
    src.mkdir()
    quiet.mkdir()
    (quiet / "pyproject.toml").write_text('[tool.prosemill]\ndisable = ["zh-typography-4"]\n')
    deltas = ["第1个CLI\n\n", "`a`中（甲）\n", "末B"]
    rows = []
    for cwd in (str(quiet), "/elsewhere"):
        for i, d in enumerate(deltas):
            rows.append({"hook_event_name": "MessageDisplay", "session_id": "s", "message_id": cwd, "turn_id": "t", "index": i, "delta": d, "final": i == 2, "cwd": cwd})
    rows += [rows[0] | {"message_id": "torn", "delta": d} for d in ("x\n", "y\n")]
    (src / "a.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
    raw = spark.readStream.format("text").load(str(src))
    shown, log = tmp_path / "shown", tmp_path / "log"
    assert hook.start(raw, str(shown), str(log), str(tmp_path / "c"), env={hook.DISABLE: "1"}) is None
    query = hook.start(raw, str(shown), str(log), str(tmp_path / "c"), hook.configs_of([str(quiet)]), env={})
    try:
        for _ in range(120):
            if list(log.glob("*.json")):
                break
            time.sleep(0.5)
    finally:
        query.stop()
    lines = [json.loads(x)["hookSpecificOutput"] for p in shown.glob("*.txt") for x in p.read_text("utf-8").splitlines()]
    got = sorted(x["displayContent"] for x in lines)
    docs = spark.createDataFrame([(1, "".join(deltas))], "doc_id long, text string")
    want = []
    for config in (resolve(str(quiet)), None):
        f = fix(docs, config).first()["fixed"].split("\n")
        want += [x for x, d in zip(["\n".join(f[:2]) + "\n", f[2] + "\n", f[3]], deltas, strict=True) if x != d]
    assert got == sorted(want) and {x["hookEventName"] for x in lines} == {"MessageDisplay"}
    noted = [json.loads(x) for p in log.glob("*.json") for x in p.read_text("utf-8").splitlines()]
    assert [(n["message_id"], n["step"], n["kind"]) for n in noted] == [("torn", "siblings", "conflict")] and set(noted[0]) == {"at", "message_id", "step", "kind"}


def test_replay_equals_whole_fix(spark):
    parts = [(m, i, d) for m in ("m1", "m2") for i, d in enumerate(["第1个CLI\n`a\n", "b`中\n", "（甲）x\n末B"])]
    got = {(r["message_id"], r["index"]): r["shown"] for r in hook.replay_batches(spark.createDataFrame(parts, "message_id string, `index` long, delta string")).collect()}
    whole = "".join(d for m, _, d in parts if m == "m1")
    fixed = fix(spark.createDataFrame([(1, whole)], "doc_id long, text string")).first()["fixed"]
    assert "".join(got["m1", i] for i in range(3)) == fixed == "".join(got["m2", i] for i in range(3))
