"""Small cases of the text, Markdown, directive, configuration and streaming operators."""

import pytest
from pyspark.sql import functions as F

from prosemill.functions.text import check_lines, fix_lines, identifier, matches, normal_answer
from prosemill.operators import markdown
from prosemill.operators.check import check, front_matter_error, ordered, summary
from prosemill.operators.directives import DirectiveError
from prosemill.operators.fix import fix
from prosemill.plans.config import Config, ConfigError, from_table, resolve
from prosemill.streaming.hook import Message, unclosed_run


def one(spark, text, column):
    return spark.createDataFrame([(1, text)], "doc_id long, text string").select(column(F.col("text")).alias("x")).first()["x"]


@pytest.mark.parametrize("text", ["", "\n", "\r\n\r", "a\x0bb\x0cc", "甲\u2028", "a\x1cb\x85c"])
def test_check_lines(spark, text):
    assert one(spark, text, check_lines) == text.splitlines()


def test_line_views_differ(spark):
    assert one(spark, "甲B\u2028乙C", check_lines) == ["甲B", "乙C"]
    assert one(spark, "甲B\u2028乙C\n", fix_lines) == ["甲B\u2028乙C", ""]


def test_positions_are_code_points(spark):
    got = one(spark, "😀é,甲,x", lambda c: matches(c, "[,甲]"))
    assert [(m["s"], m["e"], m["m"]) for m in got] == [(2, 3, ","), (3, 4, "甲"), (4, 5, ",")]


def test_identifier_and_answer(spark):
    assert one(spark, "a-1_é", identifier) == "a-1_5F_C3_A9"
    assert one(spark, "x" * 121, identifier) == ""
    assert one(spark, "  a\r\nb \n\n", normal_answer) == "a\nb\n"
    assert one(spark, " \n", normal_answer) is None


def findings(spark, text, config=None, path=None):
    docs = spark.createDataFrame([(1, path, text)], "doc_id long, path string, text string")
    return [(r["line"], r["rule"], r["start"], r["end"]) for r in ordered(check(docs, config)).collect()]


def test_byte_ranges_and_consuming_matches(spark):
    assert findings(spark, "😀,甲,") == [(1, "zh-typography-1", 4, 8)]
    assert findings(spark, None) == []
    assert findings(spark, "") == []


def test_protection(spark):
    assert findings(spark, "见`甲A`和[x](甲A)") == [(1, "zh-typography-7", 3, 4), (1, "zh-typography-7", 8, 9)]
    assert findings(spark, "```\n甲A\n~~~\n甲A") == [(4, "zh-typography-4", 3, 3)]
    assert findings(spark, "「サンプル,甲A」") == []


def test_claims():
    assert markdown.claim_prose("a](b)c", []) == [(3, 4)]
    assert markdown.claim_prose("xhttps://a.b https://c.d,", []) == [(13, 24)]
    assert markdown.claim_prose("「あ「い」う」", []) == [(1, 6)]
    assert markdown.claim_prose("「a」", []) == []


def test_directives(spark):
    text = "<!-- prosemill-disable-next-line -->\n甲A\n甲A\n<!-- prosemill-disable zh-typography-4 -->\n甲A1"
    assert [(r[0], r[1]) for r in findings(spark, text)] == [(3, "zh-typography-4")]
    docs = spark.createDataFrame([(1, "x\n<!-- prosemill-disable nope -->")], "doc_id long, text string")
    with pytest.raises(DirectiveError, match="line 2"):
        check(docs, strict=True)


def test_fix_keeps_lines_and_settles(spark):
    rows = [(1, "第3个CLI工具,支持`x`中\n\n（１２MB）\n"), (2, None), (3, ""), (4, "一" * 3000 + "A"), (5, "<!-- prosemill-disable zh-typography-4 -->\n甲A1甲")]
    got = {r["doc_id"]: r["fixed"] for r in fix(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == "第 3 个 CLI 工具，支持 `x` 中\n\n(12 MB)\n"
    assert got[2] is None and got[3] == "" and got[4].endswith("一 A")
    assert got[5].split("\n")[1] == "甲A1 甲"


def test_summary_and_shape(spark):
    docs = spark.createDataFrame([(1, "（甲A"), (2, "# a\n- b\n```\n# c\n```\n1) d")], "doc_id long, text string")
    assert tuple(summary(check(docs, Config(severity={"zh-typography-4": "warning"}))).first()) == (1, 1, 1)
    assert [tuple(r) for r in markdown.shape(docs).orderBy("doc_id").collect()] == [(1, 0, 0, 0), (2, 1, 2, 2)]


def test_front_matter():
    assert front_matter_error(["x"]) is None
    assert front_matter_error(["---", "a: 1", "---"]) is None
    assert front_matter_error(["---", "a: 1"])[0] == 0
    assert front_matter_error(["---", "a: [1", "---"])[0] in (1, 2)


@pytest.mark.parametrize(
    "table",
    [{"disable": "x"}, {"disable": ["x"]}, {"enable": ["zh-tell-1"]}, {"enable_experimental": 1}, {"skip_zh_units": "x"}, {"severity": {"zh-tell-1": "bad"}}, {"severity": []}, {"enable": ["zh-typography-1"], "disable": ["zh-typography-1"]}],
)
def test_config_errors(table):
    with pytest.raises(ConfigError):
        from_table(table)


def test_config_resolution(tmp_path):
    (tmp_path / "pyproject.toml").write_text('[tool.prosemill]\ndisable = ["zh-typography-1"]\n')
    inner = tmp_path / "a"
    inner.mkdir()
    assert not resolve(inner).on("zh-typography-1")
    assert resolve(inner, enable=[]).on("zh-typography-1")
    (inner / ".git").mkdir()
    assert resolve(inner).on("zh-typography-1")


def test_message_state():
    m, fixer = Message(), lambda t: t.replace("甲A", "甲 A")
    assert m.arrive(1, "甲A\n", False, 0.0, fixer) == []
    assert m.arrive(0, "x\n", False, 0.5, fixer) == [(1, "甲 A\n", None, None)]
    assert m.arrive(0, "x\n", False, 0.6, fixer) == []
    assert m.arrive(2, "甲A", False, 0.7, fixer) == [(2, None, "fix", "partial")]
    assert m.arrive(1, "other\n", False, 0.8, fixer) == [(1, None, "siblings", "conflict")]
    assert m.arrive(3, "z\n", False, 0.9, fixer) == [(3, None, "siblings", "void")]
    late = Message()
    assert late.arrive(1, "甲A\n", True, 0.0, fixer) == [] and late.expire(1.0) == []
    assert late.expire(2.5) == [(1, None, "siblings", "incomplete")]


def test_unclosed_run():
    assert unclosed_run("a `b\n") and not unclosed_run("a `b`\n") and not unclosed_run("a `b\n\nc\n")
    assert not unclosed_run("```\n`\n") and unclosed_run("- a\n- `b")
