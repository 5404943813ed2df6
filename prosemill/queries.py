"""Registered queries over the driver's tables, and independent DuckDB SQL for those that SQL can express.

The tables hold no text that a rule fires on, so most queries run over a seeded line: one SQL
expression over ``documents``, valid in both engines. The oracles scan characters or use plain
regular expressions; they share no code with the rules.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.functions.text import check_lines, fix_lines
from prosemill.operators import check as checks
from prosemill.operators import markdown
from prosemill.operators.check import check
from prosemill.operators.fix import fix
from prosemill.plans.config import EXPERIMENTAL, Config, rules_table
from prosemill.streaming import hook

_SRC, _LANG, _ID = "coalesce(source, '')", "coalesce(lang, '')", "cast(doc_id as varchar(20))"
#: Seeded lines by family.
SEEDS = {
    "adjacency": f"concat('第', {_ID}, '个CLI工具支持', {_ID}, '个job', case doc_id % 3 when 0 then '与缓存' when 1 then ' 与 缓存x' else '' end)",
    "unit": f"concat('约', {_ID}, 'MB与', {_ID}, ' ms和v', {_ID}, 'MB及', {_ID}, 'GHz', case doc_id % 2 when 0 then '，' else 's' end)",
    "width": f"concat('编号（', {_ID}, '），共１２项', case doc_id % 4 when 0 then '（三）０' else '' end)",
    "punctuation": f"concat('来源', {_SRC}, ',语言,', {_LANG}, '后.中文;版本v', {_ID}, '.1', case doc_id % 3 when 0 then '好,好,好' when 1 then '等..好.' else 'a.b' end)",
    "brackets": f"concat('函数f(x)与参数(', {_LANG}, ')说明(', {_ID}, ') ok', case doc_id % 2 when 0 then '（甲）)乙' else ' ( 甲)' end)",
    "dash": "case doc_id % 4 when 0 then '甲——乙' when 1 then '甲———乙' when 2 then '甲 —— 乙——' else '——丙 ——丁' end",
    "space": f"concat('甲 ，乙 ； 丙，—— 丁， ', {_LANG}, case doc_id % 3 when 0 then '，  ，' when 1 then '：|' else ' 。' end)",
    "tells": "case doc_id % 7 when 0 then '综上所述，综上所述' when 1 then '这不是口号，而是方法，不是A，而是B' when 2 then '赋能与抓手' when 3 then '随时告诉我，希望对你有帮助' when 4 then 'A Pivotal testament; pivotally' when 5 then 'The load-bearing wall is load-bearing' else '平常的一句话' end",
    "parallels": "case doc_id % 4 when 0 then 'It is not just fast but simple' when 1 then 'This isn''t magic, it''s work' when 2 then 'not just fast and simple' else 'They are not here, but they are there' end",
    "zero": "case doc_id % 4 when 0 then '做到零秘密，零重复' when 1 then '零成本与零秘密' when 2 then '零' else '从零开始，零零零零零零' end",
    "terms": "case doc_id % 3 when 0 then '轮换token时更新秘钥和秘钥' when 1 then '更新秘钥' else 'CDN的快取与代币' end",
    "secret": "case doc_id % 3 when 0 then '仓库里没有秘密' when 1 then '保守秘密' else '商业秘密和秘密，秘密' end",
    "link": "case doc_id % 3 when 0 then '见[文档](a)与[b](c)' when 1 then '见 [文档](a)' else '见[未完' end",
    "code": f"concat('运行`', {_SRC}, '`后看`x', case doc_id % 2 when 0 then '`中' else '中' end)",
}
#: Seeded documents: fences, directives, protection and rules side by side.
_NL = "chr(10)"
FENCED = f"concat('文a', {_NL}, case doc_id % 3 when 0 then '```' when 1 then '  ~~~ x' else '' end, {_NL}, '码b', {_NL}, case doc_id % 2 when 0 then '~~~' else '正c' end, {_NL}, '尾d', {_NL})"
DIRECTED = f"concat('文a', {_NL}, case doc_id % 4 when 0 then '<!-- prosemill-disable zh-typography-4 -->' when 1 then '<!-- prosemill-disable -->' when 2 then '<!-- prosemill-disable-next-line zh-typography-4,zh-typography-5 -->' else '<!-- prosemill-disable , -->' end, {_NL}, '文b1', {_NL}, '文c', {_NL}, case doc_id % 3 when 0 then '<!-- prosemill-enable zh-typography-4 -->' else '说' end, {_NL}, '文d')"
UNITED = f"concat('共', {_ID}, '年又', {_ID}, '个', case doc_id % 3 when 0 then '在3.5月与7月' when 1 then ' 2日' else '第12,345年' end)"
FRONT = f"concat('---', {_NL}, 'name: ', case doc_id % 3 when 0 then 'a' when 1 then '[a' else '[a]' end, {_NL}, case doc_id % 4 when 0 then '' else '---' end, {_NL}, '文')"
GUARDED = f"concat('甲A', case doc_id % 5 when 0 then '`乙B`' when 1 then '[丙](丁D)' when 2 then ' https://a.b/c' when 3 then '「あ戊E」' else '『己F』' end, ' 庚', {_LANG}, '辛G')"
SHAPED = f"concat('# ', {_LANG}, chr(10), '- a', chr(10), '1. b', chr(10), {FENCED}, '#x')"
BEFORE = "concat('# a', chr(10), '- b')"
AFTER = "case doc_id % 2 when 0 then concat('# a', chr(10), 'b') else concat('# a', chr(10), '- b') end"
WHOLE = "concat(" + f", {_NL}, ".join([SEEDS[s] for s in SEEDS] + [FENCED, DIRECTED, "concat('见https://example.com/', cast(doc_id as varchar(20)), 'a,再看「サンプル,a」(https://example.com/b)')"]) + ")"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def seeded(spark: SparkSession, sf_dir: str, seed: str) -> DataFrame:
    """doc_id, lang and the seeded text."""
    return _docs(spark, sf_dir).select("doc_id", "lang", F.expr(seed.replace("varchar(20)", "string")).alias("text"))


def _count(rule: str, family: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = check(seeded(spark, sf_dir, SEEDS[family]), Config(enabled=frozenset([rule])))
        return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("start").cast("long").alias("starts"))

    return run


def _scan(family: str, sizes: str) -> str:
    """SQL over seeded characters: ``sizes`` is a list of (match list) SQL giving 1-based code-point starts."""
    return f"with s as (select doc_id, {SEEDS[family]} as t from documents), h as (select doc_id, t, unnest({sizes}) as p from s) select doc_id, count(*)::bigint as n, sum(strlen(t[1:p-1]))::bigint as starts from h group by doc_id"


def _at(condition: str) -> str:
    """Positions i where a condition on t holds."""
    return f"list_filter(range(1, len(t) + 2), lambda i: {condition})"


def _cjk(i: str) -> str:
    return f"(t[{i}:{i}] >= '一' and t[{i}:{i}] <= '鿿' and len(t[{i}:{i}]) = 1)"


def _in(i: str, chars: str) -> str:
    return f"regexp_full_match(t[{i}:{i}], '[{chars}]')"


_B = "(i-1)"
_TWO = "(t[i:i+1] = '——' and t[i-1:i-1] <> '—' and t[i+2:i+2] <> '—')"
RULE_QUERIES: dict[str, tuple[str, str, str | None]] = {
    # name: rule, family, positions in SQL (None: rows only)
    "check_zh_typography_2": ("zh-typography-2", "width", _at(_in("i", "（）"))),
    "check_zh_typography_3": ("zh-typography-3", "brackets", f"list_concat({_at('t[i:i] = chr(41) and ' + _in('(i+1)', 'A-Za-z0-9一-鿿'))}, list_transform({_at('t[i:i] = chr(40) and i > 1 and ' + _in(_B, 'A-Za-z0-9一-鿿)') + ' and not (' + _in(_B, 'A-Za-z0-9') + ' and ' + _in('(i+1)', 'A-Za-z0-9') + ')')}, lambda i: i - 1))"),
    "check_zh_typography_4": ("zh-typography-4", "adjacency", _at(f"i > 1 and (({_cjk(_B)} and {_in('i', 'A-Za-z')}) or ({_in(_B, 'A-Za-z')} and {_cjk('i')}))")),
    "check_zh_typography_5": ("zh-typography-5", "adjacency", _at(f"i > 1 and (({_cjk(_B)} and {_in('i', '0-9')}) or ({_in(_B, '0-9')} and {_cjk('i')}))")),
    "check_zh_typography_8": ("zh-typography-8", "dash", f"list_concat({_at(_TWO + ' and i > 1 and ' + _in(_B, '^ —'))}, {_at(_TWO + ' and ' + _in('(i+2)', '^ —'))})"),
    "check_zh_typography_10": ("zh-typography-10", "width", _at(_in("i", "０-９"))),
    "check_zh_typography_1": ("zh-typography-1", "punctuation", None),
    "check_zh_typography_6": ("zh-typography-6", "unit", None),
    "check_zh_typography_7": ("zh-typography-7", "code", None),
    "check_zh_typography_9": ("zh-typography-9", "link", None),
    "check_zh_typography_11": ("zh-typography-11", "space", None),
    "check_zh_tell_1": ("zh-tell-1", "tells", "case when contains(t, '综上所述') then [strpos(t, '综上所述')] else [] end"),
    "check_zh_tell_3": ("zh-tell-3", "tells", "case when contains(t, '赋能') then [strpos(t, '赋能')] else [] end"),
    "check_zh_tell_4": ("zh-tell-4", "tells", "case when contains(t, '随时告诉我') then [strpos(t, '随时告诉我')] else [] end"),
    "check_zh_tell_2": ("zh-tell-2", "tells", _at("t[i:i+1] = '不是'")),
    "check_zh_tell_5": ("zh-tell-5", "zero", _at(f"t[i:i] = '零' and t[i:i+2] <> '零成本' and t[i-1:i-1] <> '从' and {_cjk('(i+1)')} and not ({_cjk('(i+1)')} and {_cjk('(i+2)')} and {_cjk('(i+3)')} and {_cjk('(i+4)')} and {_cjk('(i+5)')})")),
    "check_en_tell_1": ("en-tell-1", "tells", "case when regexp_matches(t, '(?i)\\bpivotal\\b') then [strpos(t, 'Pivotal')] else [] end"),
    "check_en_tell_3": ("en-tell-3", "tells", "case when contains(t, 'load-bearing') then [strpos(t, 'load-bearing')] else [] end"),
    "check_en_tell_2": ("en-tell-2", "parallels", "case when t like '%not just%but%' then [strpos(t, 'not just')] when t like '%isn''t%it''s%' then [strpos(t, 'isn')] when t like '%are not%they are%' then [strpos(t, 'are not')] else [] end"),
    "check_zh_word_1": ("zh-word-1", "terms", _at("(t[i:i+1] = '秘钥' and contains(t, 'token')) or (t[i:i+1] = '快取' and contains(t, 'CDN'))")),
    "check_zh_word_2": ("zh-word-2", "secret", _at("t[i:i+1] = '秘密' and t[i-2:i-1] not in ('保守', '商业')")),
}
_EXTRACT = {
    "check_zh_typography_1": ("punctuation", f"len(regexp_extract_all(t, '[一-鿿][,;:?!]|[,;:?!][一-鿿]')) + len({_at('t[i:i] = chr(46) and (' + _cjk(_B) + ' or ' + _cjk('(i+1)') + ') and i > 1 and t[i-1:i-1] <> chr(46) and not ' + _in('(i+1)', 'A-Za-z0-9.'))})"),
    "check_zh_typography_6": ("unit", "len(regexp_extract_all(concat(' ', replace(t, '与', '  '), ' '), '[^A-Za-z0-9][0-9]+(?:MB|ms|GHz)[^A-Za-z0-9]'))"),
    "check_zh_typography_9": ("link", "len(regexp_extract_all(t, '[一-鿿]\\[[^\\]]*\\]\\('))"),
    "check_zh_typography_11": ("space", "len(regexp_extract_all(t, '[^ —⸺|] +[，。、；：？！]')) + len(regexp_extract_all(t, '[，。、；：？！] +[^ —⸺|]'))"),
    # The spans are every second piece between backticks; an odd last backtick opens none.
    "check_zh_typography_7": ("code", "list_sum(list_transform(range(1, (len(t) - len(replace(t, '`', ''))) // 2 + 1), lambda k: regexp_matches(string_split(t, '`')[2 * k - 1], '[一-鿿]$')::int + regexp_matches(string_split(t, '`')[2 * k + 1], '^[一-鿿]')::int))"),
}


def _put(condition: str) -> str:
    """SQL: t with a space before every position i where the condition holds."""
    return f"array_to_string(list_transform(range(1, len(t) + 1), lambda i: concat(case when i > 1 and ({condition}) then ' ' else '' end, t[i:i])), '')"


_N = "(i+1)"
_TICKS = "(i - 1 - len(replace(t[1:i-1], '`', '')))"
_DOT = f"t[i:i] = chr(46) and ({_cjk(_B)} or {_cjk(_N)}) and i > 1 and t[i-1:i-1] <> chr(46) and not {_in(_N, 'A-Za-z0-9.')}"
#: Fixes by one family of rules: name: rules, seed, fixed text in SQL over t.
FIX_QUERIES: dict[str, tuple[list[str], str, str]] = {
    "fix_punctuation": (["zh-typography-1"], "punctuation", f"array_to_string(list_transform(range(1, len(t) + 1), lambda i: case when {_in('i', ',;:?!')} and ((i > 1 and {_cjk(_B)}) or {_cjk(_N)}) then translate(t[i:i], ',;:?!', '，；：？！') when {_DOT} then '。' else t[i:i] end), '')"),
    "fix_brackets": (["zh-typography-3"], "brackets", _put(f"(t[i:i] = chr(40) and ({_cjk(_B)} or t[i-1:i-1] = chr(41) or ({_in(_B, 'A-Za-z0-9')} and not {_in(_N, 'A-Za-z0-9')}))) or (t[i-1:i-1] = chr(41) and {_in('i', 'A-Za-z0-9一-鿿')})")),
    "fix_spacing": (["zh-typography-4", "zh-typography-5"], "adjacency", _put(f"({_cjk(_B)} and {_in('i', 'A-Za-z0-9')}) or ({_in(_B, 'A-Za-z0-9')} and {_cjk('i')})")),
    "fix_units": (["zh-typography-6"], "unit", "regexp_replace(t, '([^A-Za-z0-9])([0-9]+)(MB|ms|GHz)([^A-Za-z0-9]|$)', '\\1\\2 \\3\\4', 'g')"),
    "fix_code_edges": (["zh-typography-7"], "code", _put(f"{_TICKS} % 2 = 0 and ((t[i:i] = '`' and contains(t[i+1:], '`') and {_cjk(_B)}) or (t[i-1:i-1] = '`' and {_cjk('i')}))")),
    "fix_dash": (["zh-typography-8"], "dash", _put(f"({_TWO} and {_in(_B, '^ —')}) or (i > 2 and t[i-2:i-1] = '——' and t[i-3:i-3] <> '—' and {_in('i', '^ —')})")),
    "fix_link": (["zh-typography-9"], "link", "regexp_replace(t, '([一-鿿])(\\[[^\\]]*\\]\\()', '\\1 \\2', 'g')"),
    "fix_space_runs": (["zh-typography-11"], "space", "regexp_replace(regexp_replace(t, '([^ —⸺|]) +([，。、；：？！])', '\\1\\2', 'g'), '([，。、；：？！]) +([^ —⸺|])', '\\1\\2', 'g')"),
}


def _fixed(rules: list[str], family: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fix(seeded(spark, sf_dir, SEEDS[family]), Config(enabled=frozenset(rules)))

    return run


def check_skip_units(spark, sf_dir):
    """Rule 5 with units that may follow a number closely."""
    found = check(seeded(spark, sf_dir, UNITED), Config(enabled=frozenset(["zh-typography-5"]), skip_zh_units="年月"))
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("start").cast("long").alias("starts"))


def check_front_matter(spark, sf_dir):
    docs = seeded(spark, sf_dir, FRONT).withColumn("path", F.when(F.col("doc_id") % 5 == 0, "a/b.md").otherwise("a/SKILL.md"))
    return check(docs, Config(enabled=frozenset(["yaml-frontmatter-1"]))).select("doc_id", "rule").distinct()


def check_protected(spark, sf_dir):
    """Rule 4 beside code, link destinations, bare URLs and quotations with kana."""
    found = check(seeded(spark, sf_dir, GUARDED), Config(enabled=frozenset(["zh-typography-4"])))
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("start").cast("long").alias("starts"))


def _number(rule: str, family: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return check(seeded(spark, sf_dir, SEEDS[family]), Config(enabled=frozenset([rule]))).groupBy("doc_id").agg(F.count("*").alias("n"))

    return run


def _shape(seed: str) -> str:
    """SQL: headings, fences and items of seeded documents, outside fences."""
    lines = f"select doc_id, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as n from (select doc_id, {seed} as t from documents)"
    marked = f"select *, ltrim(line)[1:3] in ('```', '~~~') as f from ({lines})"
    inside = f"select *, f or coalesce(sum(f::int) over (partition by doc_id order by n rows between unbounded preceding and 1 preceding), 0) % 2 = 1 as v from ({marked})"
    return f"select doc_id, count(*) filter (not v and regexp_matches(line, '^#+( |$)'))::bigint as headings, count(*) filter (f)::bigint as fences, count(*) filter (not v and regexp_matches(line, '^([-*+]|[0-9]+[.)])( |$)'))::bigint as items from ({inside}) group by doc_id"


def lines_check_view(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", check_lines(F.coalesce("text", F.lit(""))).alias("l"))
    return d.select("doc_id", F.size("l").cast("long").alias("n_lines"), F.length(F.array_join("l", "")).cast("long").alias("n_chars"))


def lines_fix_view(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", fix_lines(F.coalesce("text", F.lit(""))).alias("l"))
    return d.select("doc_id", F.size("l").cast("long").alias("n_lines"), F.length(F.array_join("l", "")).cast("long").alias("n_chars"))


def fence_verbatim(spark, sf_dir):
    lines = markdown.explode_lines(seeded(spark, sf_dir, FENCED), fix_lines(F.col("text")))
    return markdown.structure(lines).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "verbatim")


def directive_masks(spark, sf_dir):
    docs = seeded(spark, sf_dir, DIRECTED)
    found = check(docs, Config(enabled=frozenset(["zh-typography-4"])))
    return found.select("doc_id", "line", "start")


def findings_by_rule(spark, sf_dir):
    return check(seeded(spark, sf_dir, WHOLE), Config.all_rules()).groupBy("rule").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


def findings_by_lang(spark, sf_dir):
    docs = seeded(spark, sf_dir, WHOLE)
    found = check(docs).groupBy("doc_id").agg(F.count("*").alias("n"))
    per = docs.join(found, "doc_id", "left").groupBy("lang")
    return per.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.round(F.coalesce(F.sum("n"), F.lit(0)) * 1000 / F.sum(F.length("text")), 6).alias("per_1000_chars"))


def severity_summary(spark, sf_dir):
    docs = seeded(spark, sf_dir, SEEDS["width"])
    return checks.summary(check(docs, Config(enabled=frozenset(["zh-typography-2", "zh-typography-10"]), severity={"zh-typography-10": "warning"})))


def clean_documents(spark, sf_dir):
    docs = seeded(spark, sf_dir, SEEDS["tells"])
    return checks.clean_documents(docs, check(docs, Config(enabled=EXPERIMENTAL))).select("doc_id")


def report(spark, sf_dir):
    return checks.report(check(seeded(spark, sf_dir, SEEDS["brackets"]))).select("doc_id", "message")


def fix_width(spark, sf_dir):
    return fix(seeded(spark, sf_dir, SEEDS["width"]), Config(enabled=frozenset(["zh-typography-2", "zh-typography-10"])))


def fix_terms(spark, sf_dir):
    return fix(seeded(spark, sf_dir, SEEDS["terms"]), Config(enabled=frozenset(["zh-word-1"])))


def fix_full(spark, sf_dir):
    return fix(seeded(spark, sf_dir, WHOLE), Config.all_rules())


def shape_counts(spark, sf_dir):
    return markdown.shape(seeded(spark, sf_dir, SHAPED))


def shape_drift(spark, sf_dir):
    return markdown.shape_drift(seeded(spark, sf_dir, BEFORE), seeded(spark, sf_dir, AFTER))


def rule_table(spark, sf_dir):
    return rules_table(spark).select("rule_ord", "rule", "default_enabled", "default_severity", "maturity", "fixable")


def unclosed_spans(spark, sf_dir):
    return markdown.unclosed(seeded(spark, sf_dir, SEEDS["code"]))


def prefix_replay_batch(spark, sf_dir):
    """Conversations as messages, turns as batches: what each batch adds to the fixed whole."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("text is not null")
    part = F.concat(F.lit("第"), F.col("turn").cast("string"), F.lit("轮role:"), F.coalesce("role", F.lit("")), F.lit("\n"))
    return hook.replay_batches(turns.select(F.col("conv_id").cast("string").alias("message_id"), F.col("turn").alias("index"), part.alias("delta")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = [
        lines_check_view, lines_fix_view, fence_verbatim, directive_masks, findings_by_rule, findings_by_lang, severity_summary, clean_documents, report,
        fix_width, fix_terms, fix_full, check_skip_units, check_front_matter, check_protected, shape_counts, shape_drift, rule_table, unclosed_spans, prefix_replay_batch,
    ]
    out = {f.__name__: f for f in plain}
    for name, (rule, family, sql) in RULE_QUERIES.items():
        out[name] = _count(rule, family) if sql else _number(rule, family)
    for name, (rules, family, _) in FIX_QUERIES.items():
        out[name] = _fixed(rules, family)
    return out


def oracle_sql() -> dict[str, str]:
    out = {name: _scan(family, sql) for name, (_, family, sql) in RULE_QUERIES.items() if sql}
    for name, (family, sql) in _EXTRACT.items():
        out[name] = f"select doc_id, n::bigint as n from (select doc_id, {sql} as n from (select doc_id, {SEEDS[family]} as t from documents)) where n > 0"
    for name, (_, family, sql) in FIX_QUERIES.items():
        out[name] = f"select doc_id, {sql} as fixed from (select doc_id, {SEEDS[family]} as t from documents)"
    digits = "regexp_extract(t[i:], '^[0-9]+([.,][0-9]+)*')"
    bare = _at(f"i > 1 and (({_cjk(_B)} and {_in('i', '0-9')} and not {_in(f'(i+len({digits}))', '年月')}) or ({_in(_B, '0-9')} and {_cjk('i')} and not {_in('i', '年月')}))")
    out["check_skip_units"] = f"with s as (select doc_id, {UNITED} as t from documents), h as (select doc_id, t, unnest({bare}) as p from s) select doc_id, count(*)::bigint as n, sum(strlen(t[1:p-1]))::bigint as starts from h group by doc_id"
    # Masked text keeps its length in bytes: what is protected becomes as many spaces.
    spans = "regexp_extract(t, '`([^`]*)`', 1), regexp_extract(t, '\\]\\(([^)]*)\\)', 1), regexp_extract(t, 'https?://[^ ]*'), regexp_extract(t, '「([^」]*[ぁ-ヿ][^」]*)」', 1), regexp_extract(t, '『([^』]*[ぁ-ヿ][^』]*)』', 1)"
    blanked = f"select doc_id, list_reduce(list_prepend(t, list_filter([{spans}], lambda x: x <> '')), lambda a, x: replace(a, x, repeat(' ', strlen(x)))) as t from (select doc_id, {GUARDED} as t from documents)"
    touch = _at(f"i > 1 and (({_cjk(_B)} and {_in('i', 'A-Za-z')}) or ({_in(_B, 'A-Za-z')} and {_cjk('i')}))")
    out["check_protected"] = f"with s as ({blanked}), h as (select doc_id, t, unnest({touch}) as p from s) select doc_id, count(*)::bigint as n, sum(strlen(t[1:p-1]))::bigint as starts from h group by doc_id"
    out["check_front_matter"] = f"select doc_id, 'yaml-frontmatter-1' as rule from (select doc_id, {FRONT} as t from documents) where doc_id % 5 <> 0 and (not regexp_matches(t, '\\n---\\n') or regexp_matches(t, 'name: \\[[^\\]\\n]*\\n'))"
    ends = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
    out["lines_check_view"] = f"select doc_id, (len(p) - case when p[-1] = '' then 1 else 0 end)::bigint as n_lines, len(array_to_string(p, ''))::bigint as n_chars from (select doc_id, regexp_split_to_array(coalesce(text, ''), '{ends}') as p from documents)"
    out["lines_fix_view"] = "select doc_id, (len(text) - len(replace(text, chr(10), '')) + 1)::bigint as n_lines, len(replace(text, chr(10), ''))::bigint as n_chars from (select doc_id, coalesce(text, '') as text from documents)"
    fenced = f"select doc_id, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as line_no from (select doc_id, {FENCED} as t from documents)"
    out["fence_verbatim"] = f"select doc_id, line_no::bigint as line_no, f or coalesce(before, 0) % 2 = 1 as verbatim from (select *, sum(f::int) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding) as before from (select *, ltrim(line)[1:3] in ('```', '~~~') as f from ({fenced})))"
    rule = "zh-typography-4"
    directed = f"select doc_id, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as line_no from (select doc_id, {DIRECTED} as t from documents)"
    ours = f"(regexp_matches(line, '-(disable|enable|disable-next-line) -->') or regexp_matches(line, '[ ,]{rule}[ ,]'))"
    acts = f"select *, case when not starts_with(line, '<!-- prosemill-') or not {ours} then null when contains(line, '-next-line') then 2 when contains(line, '-disable') then 1 else 0 end as act from ({directed})"
    past = "select *, last_value(case when act < 2 then act end ignore nulls) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding) as off, lag(act) over (partition by doc_id order by line_no) as prev, list_filter(range(2, len(line) + 1), lambda i: regexp_full_match(line[i-1:i], '[一-鿿][A-Za-z]|[A-Za-z][一-鿿]')) as hits from (" + acts + ")"
    out["directive_masks"] = f"select doc_id, line_no::bigint as line, strlen(line[1:p-1])::bigint as start from (select *, unnest(hits) as p from ({past}) where coalesce(off, 0) = 0 and coalesce(prev, 0) <> 2)"
    out["severity_summary"] = f"select sum(p)::bigint as errors, sum(d)::bigint as warnings, 1::bigint as exit_code from (select len(regexp_extract_all(t, '[（）]')) as p, len(regexp_extract_all(t, '[０-９]')) as d from (select {SEEDS['width']} as t from documents))"
    tells = "综上所述|赋能|抓手|随时告诉我|希望对你有帮助|不是.*而是|(?i:\\b(?:pivotal|testament|load-bearing)\\b)"
    out["clean_documents"] = f"select doc_id from (select doc_id, {SEEDS['tells']} as t from documents) where not regexp_matches(t, '{tells}')"
    out["fix_width"] = f"select doc_id, translate({SEEDS['width']}, '（）０１２３４５６７８９', '()0123456789') as fixed from documents"
    terms = "t"
    for wrong, right, near in (("秘钥", "密钥", "secret|key|token|credential|凭证|加密"), ("代币", "令牌", "token|oauth|jwt|鉴权|认证"), ("快取", "缓存", "cache|cdn|命中率")):
        terms = f"case when regexp_matches(lower(t), '{near}') then replace({terms}, '{wrong}', '{right}') else {terms} end"
    out["fix_terms"] = f"select doc_id, {terms} as fixed from (select doc_id, {SEEDS['terms']} as t from documents)"
    out["shape_counts"] = _shape(SHAPED)
    pairs = " union all ".join(f"select doc_id, '{p}' as part, a.{p} as before, b.{p} as after from a join b using (doc_id)" for p in ("headings", "fences", "items"))
    out["shape_drift"] = f"with a as ({_shape(BEFORE)}), b as ({_shape(AFTER)}) select * from ({pairs}) where before <> after"
    out["unclosed_spans"] = f"select doc_id, (len(t) - len(replace(t, '`', ''))) % 2 = 1 as unclosed from (select doc_id, {SEEDS['code']} as t from documents)"
    kinds = "zh-typography-1 zh-typography-2 zh-typography-3 zh-typography-4 zh-typography-5 zh-typography-6 zh-typography-7 zh-typography-8 zh-typography-9 zh-typography-10 zh-typography-11 zh-tell-1 zh-tell-2 zh-tell-3 zh-tell-4 en-tell-1 en-tell-2 en-tell-3 zh-tell-5 zh-word-1 zh-word-2 yaml-frontmatter-1"
    trial = "(contains(rule, 'tell') or contains(rule, 'word'))"
    numbered = f"select unnest(string_split('{kinds}', ' ')) as rule, generate_subscripts(string_split('{kinds}', ' '), 1) - 1 as rule_ord"
    out["rule_table"] = f"select rule_ord::int as rule_ord, rule, not {trial} and rule <> 'zh-typography-9' as default_enabled, case when {trial} then 'warning' else 'error' end as default_severity, case when {trial} then 'experimental' else 'stable' end as maturity, contains(rule, 'typography') or rule = 'zh-word-1' as fixable from ({numbered})"
    gap = "regexp_replace(regexp_replace(t, '([一-鿿])([A-Za-z0-9])', '\\1 \\2', 'g'), '([A-Za-z0-9])([一-鿿])', '\\1 \\2', 'g')"
    out["prefix_replay_batch"] = f"select message_id, index, {gap} as shown from (select conv_id::varchar as message_id, turn as index, concat('第', turn, '轮role:', coalesce(role, ''), chr(10)) as t from conversations where text is not null)"
    return out


