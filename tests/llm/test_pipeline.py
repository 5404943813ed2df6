"""The pipeline against a brute-force version of its stages on a small table."""

import random
import re
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from prosemill.llm import language_id
from prosemill.llm.wordpieces import default_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(t):
    w = t.encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_pipeline(spark, tmp_path):
    rnd = random.Random(3)
    vocab = [f"wo{c}{d}" for c in "abcdefgh" for d in "klmnop"]
    texts = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(20, 60))) for _ in range(30)]
    texts += [texts[0], texts[1] + " tail", "12 34 !!", None, "", "mail a@b.com or +1 (415) 555-2671 " + texts[2][:40]]
    rows = [(i, t, "en" if i % 2 else "de", f"s{i % 4}" if i % 9 else None, len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / f"{k}"))
        docs = spark.read.parquet(str(tmp_path / f"{k}"))
        kept.append(docs)
    for d in kept[:-1]:
        assert d.columns == [c.split()[0] for c in SCHEMA.split(", ")]

    lettered = [r for r in rows if r[1] and re.search("[a-z]", r[1])]
    first = kept[0].collect()
    assert sorted((r["doc_id"], r["text"], r["source"]) for r in first) == [(i, t, s) for i, t, _, s, _ in lettered]
    lang = {r["doc_id"]: r["lang"] for r in first}
    told = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(spark.read.parquet(str(tmp_path / "documents.parquet"))).collect()}
    assert lang == {i: told[i] for i in lang}
    lettered = [(i, t, lang[i], s, n) for i, t, _, s, n in lettered]

    root = {r[0]: r[0] for r in lettered}
    for a in lettered:
        for b in lettered:
            x, y = shingles(a[1]), shingles(b[1])
            if a[0] < b[0] and len(x & y) * 100 >= 80 * len(x | y):
                root[b[0]] = min(root[b[0]], root[a[0]])
    firsts = [r for r in lettered if root[r[0]] == r[0]]
    assert len(firsts) == len(lettered) - 2
    assert sorted(tuple(r) for r in kept[1].collect()) == firsts

    masked = {r["doc_id"]: r["text"] for r in kept[2].collect()}
    assert masked[35].startswith("mail <EMAIL> or <PHONE> ")
    assert all(masked[r[0]] == r[1] for r in firsts if r[0] != 35)

    size = {}
    for r in firsts:
        size[r[3]] = size.get(r[3], 0) + len(masked[r[0]].split())
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    target, free = {}, dict(weight)
    while True:
        rate = (sum(size.values()) - sum(target.values())) / sum(free.values())
        over = [s for s in free if rate * free[s] > 3 * size[s]]
        if not over:
            break
        target |= {s: 3 * size[s] for s in over}
        free = {s: w for s, w in free.items() if s not in over}
    target |= {s: rate * w for s, w in free.items()}
    mixed = kept[3].collect()
    for s, want in target.items():
        assert abs(sum(len(r["text"].split()) for r in mixed if r["source"] == s) - want) <= 1

    t = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    want = sorted((r["doc_id"], len(t.encode(r["text"], add_special_tokens=False).ids) + 1) for r in mixed)
    pieces = kept[4].collect()
    assert sum(p["length"] for p in pieces) == sum(n for _, n in want)
    ids = {}
    for r in mixed:
        x = np.array([*t.encode(r["text"], add_special_tokens=False).ids, 1], "<u4")
        ids.setdefault(r["doc_id"], []).append(x)
    for p in pieces:
        cuts = [x[p["start"] : p["start"] + p["length"]] for x in ids[p["doc_id"]] if len(x) == p["doc_tokens"]]
        assert p["ids_crc32"] in [zlib.crc32(c.tobytes()) for c in cuts]
    fill = {}
    for p in pieces:
        fill[p["sequence_id"]] = fill.get(p["sequence_id"], 0) + p["length"]
    assert max(fill.values()) <= 2048


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
