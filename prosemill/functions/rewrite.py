"""Around an external rewriter: prompt layers, failure classes, remembered engine states, guards (calls: ``engines.py``).

The rewriter itself is a callable that the caller injects; nothing here opens a network
connection. Prompt texts and the lexicon are files that the caller supplies.
"""

from __future__ import annotations

import tomllib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.functions.text import CJK, normal_answer
from prosemill.operators.markdown import shape

# Signs of failure in an engine's output, the first class that fits wins.
UNAUTHORIZED = r"(?i)401|403|unauthori[sz]ed|forbidden|invalid[ _-]?(api[ _-]?)?key|not logged[ _-]?in|please log[ _-]?in|re-?authenticate"
UNREACHABLE = r"(?i)getaddrinfo|enotfound|econnrefused|econnreset|etimedout|ehostunreach|network|dns|unreachable|timed out|timeout|proxy|offline"
# Seconds for which a good and a failed state are trusted.
TTL_OK, TTL_FAILED = 3600, 300
# Tone marks by plain letter.
TONES = {"a": "āáǎà", "e": "ēéěèê", "i": "īíǐì", "o": "ōóǒò", "u": "ūúǔùüǖǘǚǜ", "n": "ńňǹ", "m": "ḿ"}
LEXICON = "term string, pinyin array<string>, plain string, gloss string, fault string, examples array<struct<before:string,after:string>>, ord int"


def classify(output: Column) -> Column:
    return F.when(output.rlike(UNAUTHORIZED), "unauthorized").when(output.rlike(UNREACHABLE), "unreachable").otherwise("failed")


def prompt(text: Column, general: str, chinese: str, lexicon: str, file_mode: str | None = None, path: Column | None = None) -> Column:
    """The general layer; for text with CJK also the Chinese one and the brief lexicon; in file mode a layer that names the file ({path})."""
    spec = F.when(text.rlike(f"[{CJK}]"), f"{general}\n{chinese}\n{lexicon}").otherwise(general)
    return spec if file_mode is None else F.concat(spec, F.lit("\n"), F.replace(F.lit(file_mode), F.lit("{path}"), path))


def remembered(states: DataFrame, now: float) -> DataFrame:
    """The latest state of each engine (engine, state, at) that is not too old, with its age."""
    last = states.groupBy("engine").agg(F.max_by(F.struct("state", "at"), "at").alias("x")).select("engine", "x.state", (F.lit(now) - F.col("x.at")).alias("age"))
    return last.where((F.col("age") >= 0) & (F.col("age") <= F.when(F.col("state") == "ok", TTL_OK).otherwise(TTL_FAILED)))


def merge_states(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row an engine, the newest."""
    return old.unionByName(new).groupBy("engine").agg(F.max_by("state", "at").alias("state"), F.max("at").alias("at"))


def engine_order(engines: DataFrame) -> DataFrame:
    """Installed engines (name, ord, installed, host, credentials): the host's own first, then those with credentials."""
    group = F.when(F.col("host"), 0).when(F.col("credentials"), 1).otherwise(2)
    return engines.where("installed").orderBy(group, "ord")


def fold_pinyin(pinyin: Column) -> Column:
    """Syllables joined, tone marks stripped; another letter is an error."""
    joined = F.regexp_replace(F.array_join(pinyin, ""), "[̀-ͯ]", "")
    plain = F.translate(joined, "".join(TONES.values()), "".join(k * len(v) for k, v in TONES.items()))
    return F.when(plain.rlike(r"^\p{ASCII}*\z"), plain).otherwise(F.raise_error(F.concat(F.lit("unknown pinyin letter in "), plain)))


def read_lexicon(spark: SparkSession, toml: str) -> tuple[str, str, DataFrame]:
    """Title, standard and entries of a lexicon file."""
    t = tomllib.loads(toml)
    rows = [(e["term"], e["pinyin"], e["plain"], e["gloss"], e["fault"], [(x["before"], x["after"]) for x in e.get("examples", [])], i) for i, e in enumerate(t["entries"])]
    return t["title"], t["standard"], spark.createDataFrame(rows, LEXICON)


def render_lexicon(title: str, standard: str, entries: DataFrame, full: bool = True) -> DataFrame:
    """One row ``text``: the lexicon as Markdown, in source order, with or without glosses and examples."""
    pairs = F.array_join(F.transform("examples", lambda e: F.concat(F.lit("- 原："), e["before"], F.lit("\n  改："), e["after"], F.lit("\n"))), "")
    gloss = F.concat(F.lit("- 解："), F.col("gloss"), F.lit("\n")) if full else F.lit("")
    one = F.concat(F.lit("\n## "), "term", F.lit("\n\n- 白："), "plain", F.lit("\n"), gloss, F.lit("- 病："), "fault", F.lit("\n"), pairs if full else F.lit(""))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", one.alias("t")))), lambda x: x["t"]), "")
    return entries.agg(F.concat(F.lit(f"# {title}\n" + (f"\n{standard}\n" if full else "")), body).alias("text"))


def rewrite(docs: DataFrame, engine: Callable[[str, str], str], prompts: Column) -> DataFrame:
    """doc_id, text, answer: the engine's answer, normalised; null where it is blank or the engine raises."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for p, t in zip(pdf["prompt"], pdf["text"], strict=True):
                try:
                    out.append(engine(p, t))
                except Exception:  # one document's failure is its own
                    out.append(None)
            yield pdf.assign(answer=out).drop(columns="prompt")

    rows = docs.where("text is not null").select("doc_id", "text", prompts.alias("prompt"))
    return rows.mapInPandas(run, "doc_id long, text string, answer string").withColumn("answer", normal_answer(F.col("answer")))


def accepted(rewritten: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answers that keep the shape of their document, and those that do not (or are none)."""
    before, after = shape(rewritten.select("doc_id", "text")), shape(rewritten.select("doc_id", F.col("answer").alias("text")))
    same = before.join(after, ["doc_id", "headings", "fences", "items"], "left_semi").select("doc_id")
    good = rewritten.where("answer is not null").join(same, "doc_id", "left_semi")
    return good, rewritten.join(good.select("doc_id"), "doc_id", "left_anti")
