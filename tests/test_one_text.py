"""The fix of one text against the fix of a table of documents; the stream that uses it."""

import random

from prosemill.operators.fix import fix
from prosemill.operators.one_text import fix_text, pair, unclosed_run
from prosemill.plans.config import Config
from prosemill.queries import WHOLE

PIECES = (
    "甲 乙丙 A b1 2 12MB 3.5 ms ， 。 , . ; : ? ! ( ) （ ） １ ` `` `x` **粗** —— ⸺ — [文](a甲A) https://a.b/c甲 「あ,A」 『a』 《ア甲B》 零 秘钥 token 快取 cdn e.g. etc. .. # - > | ``` ~~~ 1. "
    "<!--prosemill-disable--> <!--prosemill-enable--> <!--prosemill-disable-next-line,zh-typography-4-->"
).split()


def texts(n: int) -> list[str]:
    rng = random.Random(7)
    return ["".join(rng.choice(PIECES) + rng.choice(["", "", " ", "\n", "\n\n"]) for _ in range(rng.randrange(1, 40))).replace("--pros", "-- pros").replace("line,", "line ").replace("-->", " -->") for _ in range(n)]


def test_one_text_equals_the_table(spark):
    given = [*texts(500), "", "\n", "　甲A", "<!-- prosemill-disable , -->\n甲A", "> `甲\n> 乙`A\n`", "- `a\n- b`甲"]
    docs = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    for config in (Config.all_rules(), Config(skip_zh_units="年月日", enabled=frozenset(["zh-typography-5", "zh-word-1"]))):
        want = {r["doc_id"]: r["fixed"] for r in fix(docs, config).collect()}
        wrong = [(t, fix_text(t, config), want[i]) for i, t in enumerate(given) if fix_text(t, config) != want[i]]
        assert not wrong, (len(wrong), wrong[:3])


def test_seeded_documents(spark):
    docs = spark.createDataFrame([(i, f"s{i % 3}", "zh") for i in range(40)], "doc_id long, source string, lang string")
    rows = docs.selectExpr("doc_id", f"{WHOLE.replace('varchar(20)', 'string')} as text").collect()
    want = {r["doc_id"]: r["fixed"] for r in fix(spark.createDataFrame(rows), Config.all_rules()).collect()}
    assert {r["doc_id"]: fix_text(r["text"], Config.all_rules()) for r in rows} == want


def test_pairs():
    assert pair([1, 2, 1, 2]) == ([(0, 2)], True)
    assert pair([1, 1, 1]) == ([(0, 1)], True)
    assert pair([2, 1, 1, 2]) == ([(0, 3)], False)
    assert pair([]) == ([], False)


def test_unclosed():
    assert unclosed_run("a `b") and unclosed_run("a `b\n") and not unclosed_run("# a `b") and not unclosed_run("")
