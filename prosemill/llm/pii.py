"""Personal data by weak supervision, in DataFrame expressions only.

Four base kinds (email, ip, card, phone) are found by fixed patterns and checks and always
stay. Further candidates (secrets, social-security numbers, IBANs, local phone numbers) are
proposed widely. On every candidate four labelers vote for, against or abstain: a strict
form, a gazetteer, the words before it, and its borders. Votes are counted by pattern over
the whole corpus, an aggregate of bounded size; expectation maximisation on these counts
estimates each labeler's reliability for each kind and the share of true spans, and the
posteriors train a log-linear span classifier on votes and length, whose weights become
literals. Candidates of the further kinds with positive log odds that touch no base span
are added.

Positions are code points, end exclusive. Patterns use possessive repeats, so that long
texts neither backtrack nor overflow the stack.

Defined cases: null text is empty and has no spans; repeated rows each get their own; an
empty table gives no rows; further columns are kept by ``redact`` and ignored by ``find``.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "ssn", "iban", "local")
#: Patterns by kind. A look-behind or \G starts a match only where a longer one could not.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{24,}+={0,2}",
    "ssn": r"(?<![0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "local": r"\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])",
}
#: What a text must hold before its kind is searched for.
GATES = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
    "secret": lambda t: t.rlike(r"[A-Za-z0-9+/_-]{24}"),
    "ssn": lambda t: t.rlike(r"[0-9]-[0-9]{2}-[0-9]{4}"),
    "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11}"),
    "local": lambda t: t.rlike(r"\([0-9]{3}\) ?[0-9]"),
}
#: Words that speak for a kind when they stand shortly before it.
CONTEXT = {
    "email": r"(?i)\b(e-?mail|mail|contact|write|address)\b",
    "ip": r"(?i)\b(ip|host|server|address|from|client)\b",
    "card": r"(?i)\b(card|visa|mastercard|amex|credit|debit|pay)\b",
    "phone": r"(?i)\b(phone|tel|call|mobile|fax)\b",
    "secret": r"(?i)\b(token|secret|key|password|passwd|pwd|api|auth|bearer)\b",
    "ssn": r"(?i)\b(ssn|social|security)\b",
    "iban": r"(?i)\b(iban|account|bank|konto)\b",
    "local": r"(?i)\b(phone|tel|call|mobile|fax)\b",
}
#: Forms stricter than the pattern.
STRICT = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,24}$",
    "ip": r"^(?:(?:0|[1-9][0-9]{0,2})(?:\.|$)){4}",
    "card": r"^(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2,3}[ -]?[0-9]{1,4})$",
    "phone": r"^\+[0-9]{1,3}[ (.-].*[0-9]{3}",
    "secret": r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9+/_-]+=*$",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "iban": r"^[A-Z]{2}[0-9]{13,32}$",
    "local": r"^\([2-9][0-9]{2}\) ?[2-9][0-9]{2}-[0-9]{4}$",
}
#: Gazetteers, as patterns over the span.
GAZETTEER = {
    "email": r"(?i)\.(com|org|net|edu|gov|io|de|fr|es|uk|eu|info)$",
    "ip": r"^(?!0|127\.|255\.)",
    "card": r"^(4|5[1-5]|2[2-7]|3[47]|6011|65)",
    "phone": r"^\+(1|3[0-9]|4[0-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])",
    "secret": r"^(ghp_|sk-|AKIA|xox|eyJ|[0-9a-f]{32,64}$)",
    "ssn": r"^(?!123-45-6789|078-05-1120)",
    "iban": r"^(AT|BE|CH|CZ|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)",
    "local": r"^\((?!555)",
}
LABELERS = ("form", "gazetteer", "context", "border")
BEFORE = 40
ROUNDS = 60


def _spans(text: Column, pattern: str) -> Column:
    """All leftmost, non-overlapping matches: array of (s, e, m)."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("g"), m.alias("m")))
    none = F.array().cast("array<struct<s:int,e:int,m:string>>")

    def step(a, x):
        s = a["at"] + x["g"]
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), F.array_append(a["out"], F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m"))).alias("out"))

    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda a: a["out"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(a, i):
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return a + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    m = x["m"]
    if kind == "ip":
        small = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(m, r"\."), small)
    if kind == "card":
        return F.length(_digits(m)).between(13, 19) & _luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _votes(text: Column, kind: str, x: Column) -> Column:
    """A vote of 1, 0 or -1 from each labeler."""
    before = F.substring(text, F.greatest(x["s"] - BEFORE, F.lit(0)) + 1, F.least(x["s"], F.lit(BEFORE)))
    sides = F.concat(F.substring(text, F.greatest(x["s"], F.lit(1)), F.when(x["s"] > 0, 1).otherwise(0)), F.lit(" "), F.substring(text, x["e"] + 1, F.lit(1)))
    return F.array(
        F.when(x["m"].rlike(STRICT[kind]), 1).otherwise(-1),
        F.when(x["m"].rlike(GAZETTEER[kind]), 1).otherwise(0),
        F.when(before.rlike(CONTEXT[kind]), 1).otherwise(0),
        F.when(sides.rlike(r"[\p{L}\p{N}]"), -1).otherwise(1),
    )


def candidates(text: Column) -> Column:
    """All base spans and further candidates: array of (kind, s, e, votes, long)."""
    def of(kind: str) -> Column:
        def row(x):
            long = (F.length(x["m"]) >= 32).cast("int")
            return F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), _votes(text, kind, x).alias("votes"), long.alias("long"))

        return F.when(GATES[kind](text), F.transform(F.filter(_spans(text, PATTERNS[kind]), lambda x: _valid(kind, x)), row))

    kinds = [of(kind) for kind in (*BASE, *ADDED)]
    none = F.array().cast("array<struct<kind:string,s:int,e:int,votes:array<int>,long:int>>")
    return F.concat(*[F.coalesce(k, none) for k in kinds])


def expectation_maximisation(counts: dict[tuple, int], rounds: int = ROUNDS) -> dict[tuple, float]:
    """P(true span) of each vote pattern of one kind; counts: (votes..., long) -> n. Votes are independent given the truth.

    Starts from the majority vote; every probability is smoothed, so no labeler is ever taken as certain.
    """
    post = {p: 1 / (1 + math.exp(-2 * sum(p[:-1]))) for p in counts}
    total = sum(counts.values())
    for _ in range(rounds):
        share = (1 + sum(n * post[p] for p, n in counts.items())) / (2 + total)
        tables = []
        for i in range(len(LABELERS)):
            t: dict[tuple, float] = defaultdict(lambda: 1.0)
            mass = {True: 3.0, False: 3.0}
            for p, n in counts.items():
                for true, w in ((True, post[p]), (False, 1 - post[p])):
                    t[true, p[i]] += n * w
                    mass[true] += n * w
            # A vote for may not count against: reliabilities stay on the labeler's own side.
            tables.append({(v): max(0.0, math.log(t[True, v] / mass[True]) - math.log(t[False, v] / mass[False])) if v > 0 else (min(0.0, math.log(t[True, v] / mass[True]) - math.log(t[False, v] / mass[False])) if v < 0 else 0.0) for v in (-1, 0, 1)})
        prior = math.log(share / (1 - share))
        post = {p: 1 / (1 + math.exp(-max(-30, min(30, prior + sum(tables[i][p[i]] for i in range(len(LABELERS))))))) for p in counts}
    return post


def train(docs: DataFrame) -> dict[str, dict[tuple, float]]:
    """Weights of the span classifier by kind: (feature, value) -> log odds, ('prior',) -> log odds."""
    c = docs.select(F.explode(candidates(F.coalesce("text", F.lit("")))).alias("c"))
    rows = c.groupBy("c.kind", "c.votes", "c.long").agg(F.count("*").alias("n")).collect()  # at most kinds x 3^labelers x 2
    by: dict[str, dict[tuple, int]] = defaultdict(dict)
    for r in sorted(rows, key=lambda r: (r["kind"], r["votes"], r["long"])):
        by[r["kind"]][(*r["votes"], r["long"])] = r["n"]
    weights = {}
    for kind, counts in by.items():
        post = expectation_maximisation(counts)
        yes = sum(n * post[p] for p, n in counts.items())
        no = sum(counts.values()) - yes
        w = {("prior",): math.log((1 + yes) / (1 + no))}
        for i in range(len(LABELERS) + 1):
            for v in {p[i] for p in counts}:
                a = sum(n * post[p] for p, n in counts.items() if p[i] == v)
                w[i, v] = math.log((1 + a) / (3 + yes)) - math.log((1 + sum(n for p, n in counts.items() if p[i] == v) - a) / (3 + no))
        weights[kind] = w
    return weights


def _accepted(cands: Column, weights: dict[str, dict[tuple, float]]) -> Column:
    """Base spans, and further ones that the classifier takes and that touch no base span."""
    base = F.filter(cands, lambda x: x["kind"].isin(*BASE))

    def odds(x):
        out = F.lit(-1.0)
        for kind in ADDED:
            if w := weights.get(kind):
                score = F.lit(w[("prior",)])
                for key, value in sorted((k, v) for k, v in w.items() if len(k) == 2):
                    seen = F.element_at(x["votes"], key[0] + 1) if key[0] < len(LABELERS) else x["long"]
                    score = score + F.when(seen == key[1], value).otherwise(0.0)
                out = F.when(x["kind"] == kind, score).otherwise(out)
        return out

    extra = F.filter(cands, lambda x: ~x["kind"].isin(*BASE) & (odds(x) > 0) & ~F.exists(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    return F.concat(base, extra)


def _line(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    weights = train(docs)
    d = docs.select("doc_id", _accepted(candidates(F.coalesce("text", F.lit(""))), weights).alias("found"))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda x: x["kind"].isin(*BASE))
    return d.select("doc_id", *[count(k) for k in BASE], F.sha2(_line(base), 256).alias("base_sha256"), _line(F.col("found")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets; overlapping spans become one."""
    weights = train(docs)
    text = F.coalesce("text", F.lit(""))
    order = F.array_sort(F.transform(_accepted(candidates(text), weights), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
    none = F.array().cast("array<string>")

    def step(a, x):
        gap = F.substring(text, a["at"] + 1, x["s"] - a["at"])
        fresh = F.array_append(F.array_append(a["out"], gap), F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">")))
        return F.struct(F.greatest(a["at"], x["e"]).alias("at"), F.when(x["s"] >= a["at"], fresh).otherwise(a["out"]).alias("out"))

    whole = F.aggregate(order, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))
    return docs.select(*[F.when(F.col("text").isNotNull(), whole).alias("text") if c == "text" else docs[c] for c in docs.columns])
