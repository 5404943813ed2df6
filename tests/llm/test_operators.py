"""The ten operators against brute force on small tables with nulls, ties, repeats, odd texts and further columns."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from prosemill.llm import embedding_dedup, language_id, license_scan, mixing, ngram_join, packing, pii, substring_dedup, token_output, topk
from prosemill.llm.common import components, release, shared_dir
from prosemill.llm.wordpieces import Pieces, default_path

DOC = "doc_id long, text string, lang string, source string, n_chars long, a string, b string, h long, token string"


def table(spark, rows):
    """Documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "x", "y", 1, "z") for i, t, lang, s in rows], DOC).repartition(3)


def words(t):
    return (t or "").encode().split()


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(300)]
    base = [[rnd.choice(vocab) for _ in range(rnd.randint(15, 70))] for _ in range(8)]
    out = []
    for i in range(150):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 1, 2, 6])):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        out.append((i, " ".join(w), rnd.choice(["en", "de", None]), rnd.choice(["s1", "s2", "s3", "s4", None])))
    out += [(200, None, "en", "s1"), (201, "", "de", "s2"), (202, " \n\t", None, None), (203, "a", "en", "s1"), (204, "A", "en", "s1")]
    return [*out, (205, " ".join(base[0]) + " \x1c\xa0 x" * 300, "en", "s2"), (206, "é" * 5000, "de", "s5")]


def test_components(spark):
    edges = [(1, 2), (3, 2), (5, 4), (7, 7), (None, 1), (9, 8), (8, 10), (10, 9), *[(100, i) for i in range(101, 160)], *[(i, i + 1) for i in range(200, 230)]]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 8: 8, 9: 8, 10: 8} | dict.fromkeys(range(100, 160), 100) | dict.fromkeys(range(200, 231), 200)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_join(rows, n, t):
    sets = {}
    for i, text, *_ in rows:
        w = [x.lower() for x in words(text)]
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    root = {i: i for i in sets}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    ids = [i for i in sets if sets[i]]
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            c = len(sets[a] & sets[b])
            if c * t[1] >= (len(sets[a]) + len(sets[b]) - c) * t[0]:
                u, v = find(a), find(b)
                root[max(u, v)] = min(u, v)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("n", "t", "long"), [(3, (90, 100), 64), (5, (80, 100), 4)])
def test_ngram_join(spark, rows, monkeypatch, n, t, long):
    monkeypatch.setattr(ngram_join, "LONG", long)
    monkeypatch.setattr(ngram_join, "TILE", 8 * long)
    docs = table(spark, [*rows, rows[3]])
    got = ngram_join.join(docs, words=n, threshold=t).collect()
    assert len(got) == len(rows) + 1
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_join(rows, n, t)


def test_substring_dedup(spark, rows):
    first = {}
    for i, text, *_ in rows:
        w = words(text)
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    want = {}
    for i, text, *_ in rows:
        w = words(text)
        gone = {p for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for p in range(k, k + 13)}
        want[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for p, x in enumerate(w) if p not in gone)).hexdigest())
    for _ in range(1):
        got = substring_dedup.dedup(table(spark, [*rows, rows[5]])).collect()
        assert len(got) == len(rows) + 1
        assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == want


def brute_pii(t):
    def good(kind, m):
        d = re.sub(r"[^0-9]", "", m)
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            twice = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(d))]
            return 13 <= len(d) <= 19 and sum(v - 9 if v > 9 else v for v in twice) % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    found = []
    for kind, p in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        found += [(kind, m.start(), m.end()) for m in re.finditer(p, t or "") if good(kind, m[0])]
    return found


def test_pii(spark):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("0123456789 .-+()@ab._%é\U0001f600") for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    texts += [None, "", "a" * 50000, "1" * 30000, "a@b" + ".c" * 20000, "4111 1111 1111 1111", "a@b.c_d@e.f", '😀 token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" x']
    docs = table(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    got = {r["doc_id"]: r for r in pii.find(docs).collect()}
    for i, t in enumerate(texts):
        b = brute_pii(t)
        assert [got[i][f"n_{k}"] for k in pii.BASE] == [sum(x[0] == k for x in b) for k in pii.BASE], t
        line = ",".join(f"{k}:{s}:{e}" for k, s, e in b)
        assert got[i]["base_sha256"] == hashlib.sha256(line.encode()).hexdigest(), t
        assert got[i]["spans"].startswith(line)
    out = {r["doc_id"]: r["text"] for r in pii.redact(table(spark, [(1, "😀 a@b.c, 4111111111111111.", None, None), (2, None, None, None)])).collect()}
    assert out == {1: "😀 <EMAIL>, <CARD>.", 2: None}


def test_pii_model_prefers_supported_votes():
    post = pii.expectation_maximisation({(1, 1, 1, 1, 0): 500, (1, 0, 0, 1, 0): 300, (-1, 0, 0, -1, 0): 900})
    assert post[1, 1, 1, 1, 0] > 0.9 > 0.1 > post[-1, 0, 0, -1, 0]


def test_topk(spark):
    rnd = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in rnd.normal(size=8)]) for i in range(330)] + [(400, None), (500, [float("nan")] * 8), (600, [1.0, None] + [0.0] * 6), (700, [1.0])]
    vectors += [(331, vectors[0][1]), (332, vectors[100][1])]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in vectors], "vec_id long, embedding array<float>, label int, v string")
    fine = {i: np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int) for i, v in vectors if v and None not in v and np.isfinite(v).all()}
    want = []
    for q in sorted(fine):
        if q % 100 == 0:
            order = sorted((-int(fine[q] @ v), i) for i, v in fine.items() if i != q and len(v) == len(fine[q]))[:10]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(order)]
    for shard in (32768, 50):
        assert sorted(tuple(r) for r in topk.top_k(df, shard_rows=shard).collect()) == want


def test_token_output(spark, rows):
    t = Tokenizer.from_file(default_path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    docs = sorted([*rows, rows[7]], key=lambda r: r[0])
    ids = [[*e.ids, 2] for e in t.encode_batch([r[1] or "" for r in docs], add_special_tokens=False)]
    starts = np.cumsum([0, *map(len, ids)])
    want = [(r[0], int(s), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for r, s, x in zip(docs, starts, ids, strict=False)]
    got = token_output.round_trip(table(spark, docs), shard_tokens=700)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert token_output.round_trip(table(spark, docs).limit(0)).count() == 0


def test_repair_round_trip():
    rnd = np.random.default_rng(0)
    docs = [rnd.integers(0, 5, n).astype(np.uint32) for n in (1, 2, 3000, 1, 900)] + [np.full(1001, 7, np.uint32)]
    shard = token_output.Shard(token_output.pack_shard([3, None, 5, 6, 7, 8], docs, least=2))
    assert shard.doc_ids == [3, None, 5, 6, 7, 8]
    for k in (5, 2, 0, 4, 1, 3):
        assert shard.decode(k).tolist() == docs[k].tolist()
    flat, stop = shard.decode_all()
    assert flat.tolist() == np.concatenate(docs).tolist() and stop.tolist() == np.cumsum([len(d) for d in docs]).tolist()
    assert len(shard.symbols) < sum(map(len, docs)) / 2


def test_repair_goes_on_until_no_pair_is_frequent():
    rnd = np.random.default_rng(1)
    ids = np.concatenate([rnd.choice([3, 3, 3, 5, 8, 9], 15000), np.tile(rnd.integers(10, 900, 50), 100)]).astype(np.uint32)
    seq, ends, rules, base = token_output.compress(ids, np.array([9000, 20000]), least=6)
    pairs = {}
    for a, b in zip([0, ends[0]], ends, strict=True):
        own, k = seq[a:b].tolist(), 0
        for k in range(len(own) - 1):
            pairs[own[k], own[k + 1]] = pairs.get((own[k], own[k + 1]), 0) + 1
    assert max(pairs.values()) < 6 and max(len(x) for x in token_output.expansions(rules, base)) > 16


def test_re_pair_looks_at_changed_places_only(monkeypatch):
    # Rare pairs and, at the end, pairs that need several rounds: the rare ones are looked at once.
    ids = np.concatenate([np.random.default_rng(4).permutation(20000), np.tile(np.arange(64), 40)]).astype(np.uint32)
    seen, find = [], token_output.frequent_pairs

    def spy(key, *rest):
        seen.append(len(key))
        return find(key, *rest)

    monkeypatch.setattr(token_output, "frequent_pairs", spy)
    payload = token_output.pack_shard([1], [ids])
    assert np.array_equal(token_output.Shard(payload).decode(0), ids) and len(seen) > 3
    assert sum(seen) < len(ids)


def test_marks_behind_letters_are_pieces_of_their_own():
    rnd = random.Random(6)
    marks = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
    odd = [*marks, *"!#$%&*;:?" * 3, *"abSTzé1 \n", "'s", "'ll", "\u0301", "\u0338", "İ", "\u037e"]
    texts = [a + b + c for a in "ab\u00e9İ1 " for b in marks for c in [*marks, "s", " ", "\u0301", ""]]
    texts += ["".join(rnd.choice(odd) for _ in range(rnd.randint(0, 12))) for _ in range(6000)]
    t, p = Tokenizer.from_file(default_path("word_bpe_49k.json")), Pieces(default_path("word_bpe_49k.json"), False)
    t.encode_special_tokens = True
    for lo in range(0, len(texts), 500):
        own = texts[lo : lo + 500]
        assert [x.tolist() for x in p.encode(own)] == [e.ids for e in t.encode_batch(own, add_special_tokens=False)]
    start, end = p._cut(np.frombuffer(b"word$$$ next!", np.uint8))
    assert list(zip(start.tolist(), end.tolist(), strict=True)) == [(0, 4), (4, 7), (8, 12), (12, 13)]


def test_piece_table_grows():
    from prosemill.llm import wordpieces

    keys = wordpieces.mix(np.arange(1, 200, dtype=np.uint64))
    table = wordpieces.Table(bits=4)
    for new in np.split(keys[:190], [3, 12, 13, 150]):
        assert (table.find(new) < 0).all()
        table.add(new)
    assert table.find(keys).tolist() == [*range(190), *[-1] * 9]


@pytest.mark.parametrize(("name", "spaced"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_pieces_equal_the_library(name, spaced):
    """Odd characters side by side, all of U+0000 to U+024F and marks, and many plain words."""
    rnd = random.Random(2)
    odd = [*"ab Zé._,/ \n\t'sß1２\xa0\r\0中́ΣÀ-İ\x1c\x1f\x85\u2028", "<|endoftext|>", "  ", " ", "\n\n", " the", "word", "x" * 70]
    low = [chr(c) for c in [*range(0x250), 0x300, 0x301, 0x307, 0x345, 0x4E2D, 0x2014]]
    texts = ["İ,", "a\x1f.b", "x\x1c, y", *["a" + c + "." + c + " " + c + "b," + c for c in low]]
    texts += ["".join(rnd.choice(odd) for _ in range(rnd.randint(0, 40))) for _ in range(6000)]
    texts += ["".join(rnd.choice(low) if rnd.random() < 0.3 else rnd.choice("abc ,.") for _ in range(rnd.randint(0, 12))) for _ in range(9000)]
    texts += [" ".join("".join(rnd.choice("etaoinshrdluéüñßABCÄ") for _ in range(rnd.randint(1, 20))) for _ in range(20)) for _ in range(3000)]
    t, p = Tokenizer.from_file(default_path(name)), Pieces(default_path(name), spaced)
    t.encode_special_tokens = True
    for lo in range(0, len(texts), 1500):
        got = p.encode(texts[lo : lo + 1500])
        assert [g.tolist() for g in got] == [e.ids for e in t.encode_batch(texts[lo : lo + 1500], add_special_tokens=False)]


def test_pieces_after_the_table_was_emptied(monkeypatch):
    from prosemill.llm import wordpieces

    monkeypatch.setattr(wordpieces, "MEMO", 50)
    t, p = Tokenizer.from_file(default_path("byte_bpe_50k.json")), Pieces(default_path("byte_bpe_50k.json"), True)
    for k in range(6):
        texts = [f"alpha{k} beta {chr(97 + (i * k) % 26) * 3} gam{i}" for i in range(40)]
        assert [g.tolist() for g in p.encode(texts)] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


MIT = """Copyright (c) 2019 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
BSD2 = """Copyright (c) 2001, The Example Project. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_ASIS = """
THIS SOFTWARE IS PROVIDED BY THE REGENTS AND CONTRIBUTORS "AS IS" AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE REGENTS BE LIABLE."""
BSD3 = """3. Neither the name of the University nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.
"""
APACHE = """/*
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 */"""
GPL3 = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT"""
MPL = """# This Source Code Form is subject to the terms of the Mozilla Public
# License, v. 2.0. If a copy of the MPL was not distributed with this
# file, You can obtain one at http://mozilla.org/MPL/2.0/."""


def test_license_scan(spark):
    texts = {
        1: ("x. Released under the MIT License.\nAll rights reserved.", "MIT"),
        2: ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
        3: ("a line without an end\nLicensed under CC BY-NC 4.0.\nand more", "CC-BY-NC-4.0"),
        4: ("You may obtain a copy of the License at: nothing. You may not use this file except in compliance with the License.", ""),
        5: (None, ""), 6: ("", ""), 7: ("a licence " * 5000, ""), 8: ("All rights reserved.", ""),
        9: (MIT, "MIT"), 10: (BSD2 + BSD_ASIS, "BSD-2-Clause"), 11: (BSD2 + BSD3 + BSD_ASIS, "BSD-3-Clause"), 12: (APACHE, "Apache-2.0"),
        13: (GPL3, "GPL-3.0"), 14: (ISC, "ISC"), 15: (MPL, "MPL-2.0"), 16: ("\n".join("// " + x for x in MIT.split("\n")), "MIT"),
        17: (MIT.replace("\n", "\r\n") + ISC, "ISC,MIT"), 18: (BSD2, ""),
    }
    docs = table(spark, [(i, t, None, None) for i, (t, _) in texts.items()] + [(1, texts[1][0], None, None)])
    got = license_scan.scan(docs).collect()
    assert len(got) == len(texts) + 1
    assert {r["doc_id"]: r["licenses"] for r in got} == {i: x for i, (_, x) in texts.items()}
    assert {r["doc_id"]: r["n_known"] for r in got}[8] == 1
    assert license_scan.scan(docs.limit(0)).count() == 0


def test_embeddings_are_compared_in_double_precision(spark):
    def at(cosine, k):
        v = [0.0] * 12
        v[0], v[1 + k] = cosine, float(np.sqrt(1 - cosine * cosine))
        return v

    rows = [(0, at(1.0, 0)), (1, at(0.9 + 1e-9, 0)), (2, at(0.9 - 1e-9, 3)), (3, at(0.9 + 1e-9, 6)), (4, at(0.9 - 1e-9, 8))]
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {0: 2, 1: 1, 2: 0, 3: 1, 4: 0}
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


@pytest.mark.parametrize("chunk", [4096, 20])
def test_embedding_dedup(spark, chunk):
    rnd = np.random.default_rng(5)
    centres = rnd.normal(size=(12, 16))
    v = [(centres[i % 12] + rnd.normal(size=16) * (0.05 + 0.5 * (i % 5) / 4)).astype(np.float32) for i in range(180)]
    vectors = [(i, [float(x) for x in a]) for i, a in enumerate(v)] + [(300, None), (301, [0.0] * 16), (302, [float("inf")] * 16), (303, [1.0, None]), (304, []), (305, [2.0]), (306, [3.0])]
    vectors += [(307, vectors[0][1]), (308, vectors[0][1])]
    fine = {i: np.array(a, np.float64) for i, a in vectors if a and None not in a and np.isfinite(a).all() and np.any(a)}
    link = {i: {j for j in fine if j != i and len(fine[i]) == len(fine[j]) and fine[i] @ fine[j] / np.linalg.norm(fine[i]) / np.linalg.norm(fine[j]) >= 0.9} for i in fine}
    comp = {}
    for i in sorted(i for i, _ in vectors):
        if i not in comp:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in comp:
                    comp[x] = i
                    todo += link.get(x, ())
    got = embedding_dedup.near_duplicates(spark.createDataFrame([(i, a, 1, 2) for i, a in vectors], "vec_id long, embedding array<float>, rep int, n int"), chunk=chunk)
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got.collect()} == {i: (len(link.get(i, ())), comp[i], comp[i] == i) for i, _ in vectors}


def test_embeddings_are_not_copied_for_comparisons(spark, tmp_path):
    # On disk: shuffles of the session and written steps, together in proportion to the input at any number of chunks.
    def held():
        blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
        steps = [os.path.join(at, f) for at, _, names in os.walk(f"{shared_dir(spark)}/prosemill") for f in names]
        return sum(os.path.getsize(f) for f in [*blocks, *steps] if f and os.path.exists(f))

    release(spark)
    rnd = np.random.default_rng(7)
    v = rnd.normal(size=(6000, 48)).astype(np.float32)
    v[5000:] = v[:1000] + rnd.normal(size=(1000, 48)).astype(np.float32) * 0.1
    rows = pa.table({"vec_id": np.arange(len(v)), "embedding": pa.array(list(v), pa.list_(pa.float32()))})
    pq.write_table(rows, tmp_path / "v.parquet")
    before = held()
    found = embedding_dedup.near_duplicates(spark.read.parquet(str(tmp_path / "v.parquet")), chunk=128)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found.collect()}
    after = held() - before
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = u.astype(np.float64) @ u.T >= 0.9
    assert {i: n for i, (n, _) in got.items()} == dict(enumerate((near.sum(1) - 1).tolist()))
    assert all(got[i] == (1, i - 5000) for i in range(5000, 6000))
    assert after <= 4 * v.nbytes, (after, v.nbytes)


def test_packing(spark, rows):
    t = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    docs = [*rows, (900, "word " * 6000, None, None), rows[2]]
    ids = {r[0]: np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4") for r in docs}
    got = packing.pack(table(spark, docs), capacity=256, width=4).collect()
    seen, seqs = {}, {}
    for r in got:
        x = ids[r["doc_id"]]
        assert zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(x)
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + r["length"]
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert seen == {d: len(x) * (2 if d == rows[2][0] else 1) for d, x in ids.items()}
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 256
    total = sum(n for s in seqs.values() for _, n in s)
    assert len(seqs) * 256 <= 1.05 * total + 256
    assert packing.pack(table(spark, docs).limit(0)).count() == 0


def test_language_id(spark):
    rnd = random.Random(8)
    syllables = {"de": ["sch", "ung", "ein", "ver", "heit", "ü"], "fr": ["eau", "oux", "ment", "é", "qui", "le"]}
    rows = [(i, " ".join("".join(rnd.choice(syllables[x]) for _ in range(3)) for _ in range(30)), x, "s") for i in range(300) for x in [rnd.choice(["de", "fr"])]]
    rows += [(400, None, "de", "s"), (401, "123 !", "fr", "s"), (402, "schung", None, "s")]
    got = {r["doc_id"]: r for r in language_id.identify(table(spark, rows)).collect()}
    assert [got[i]["lang_pred"] for i in (400, 401, 402)] == ["und", "und", "de"]
    held = [r for r in rows[:300] if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert {i for i in got if got[i]["held_out"]} == {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0}
    assert sum(got[r[0]]["lang_pred"] == r[2] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in language_id.identify(table(spark, [(5, "abc", None, None)])).collect()} == {"und"}


def brute_code_length(train, text):
    """PPM by dictionaries: escapes of method C, no exclusion, from the longest context that any language knows."""
    fold = {**{b: b for b in range(256)}, **{b: b + 32 for b in range(65, 91)}, **{b: 48 for b in range(48, 58)}, **{b: 32 for b in range(9, 14)}}
    rows = {x: [[fold[b] for b in b"   " + t.encode()] for t in ts] for x, ts in train.items()}
    alphabet = {r[i] for rs in rows.values() for r in rs for i in range(3, len(r))}
    alphabet |= {b for rs in rows.values() for r in rs for b in r if b in alphabet}
    count = {x: {} for x in train}
    for x, rs in rows.items():
        for r in rs:
            for i in range(3, len(r)):
                for o in range(4):
                    count[x].setdefault(tuple(r[i - o : i]), {}).setdefault(r[i], 0)
                    count[x][tuple(r[i - o : i])][r[i]] += 1

    def p(x, ctx, b):
        own = count[x].get(ctx)
        low = 1 / (len(alphabet) + 1) if not ctx else None
        if own is None:
            return p(x, ctx[1:], b) if ctx else low
        n, d = sum(own.values()), len(own)
        if b in own:
            return own[b] / (n + d)
        return d / (n + d) * (low if not ctx else p(x, ctx[1:], b))

    out = {}
    raw = [fold[b] for b in b"   " + text.encode()]
    for x in train:
        out[x] = 0
        for i in range(3, len(raw)):
            ctx = tuple(raw[i - 3 : i])
            while ctx and not any(ctx in count[y] for y in train):
                ctx = ctx[1:]
            out[x] -= np.log2(p(x, ctx, raw[i]))
    return out


def test_code_lengths_against_brute_force():
    train = {"x": ["abracadabra, Bar 12", "a barn"], "y": ["ciónes de  la acción", "nación\n9"]}
    frame = pd.DataFrame([(x, t) for x, ts in train.items() for t in ts], columns=["lang", "text"])
    counts = pd.concat(language_id._grams(iter([frame]))).groupby(["lang", "key"], as_index=False)["n"].sum()
    m = language_id.Model(counts)
    texts = ["abra", "la barca", "\xff zzz 中", "Nación 123", ""]
    got = m.code_lengths([t.encode() for t in texts])
    for t, row in zip(texts, got, strict=True):
        want = brute_code_length(train, t)
        assert np.allclose(row, [want[x] for x in m.langs], rtol=1e-5), t


def test_language_filter(spark):
    rnd = random.Random(3)
    syllables = {"de": ["sch", "ung", "ein", "ver", "heit", "ü"], "fr": ["eau", "oux", "ment", "é", "qui", "le"]}
    rows = [(i, " ".join("".join(rnd.choice(syllables[x]) for _ in range(3)) for _ in range(30)), x, "s") for i in range(200) for x in [rnd.choice(["de", "fr"])]]
    odd = [(300, "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz0123456789+/ ") for _ in range(3000)), None, "s"), (301, "77 !", "fr", "s"), (302, None, "fr", "s"), (303, "schung einheit", None, "s")]
    docs = table(spark, [*rows, *odd, rows[0]])
    out = language_id.identified(docs)
    assert out.columns == docs.columns
    got = sorted((r["doc_id"], r["text"], r["lang"]) for r in out.collect())
    assert got == sorted([(i, t, x) for i, t, x, _ in [*rows, rows[0]]] + [(303, "schung einheit", "de")])
    assert sorted(r["doc_id"] for r in language_id.identified(docs.withColumn("lang", F.lit(None).cast("string"))).collect()) == sorted([r[0] for r in [*rows, *odd, rows[0]] if r[0] not in (301, 302)])


def test_mixing(spark, rows):
    docs = table(spark, [*rows, rows[0]])
    got = mixing.mix(docs).collect()
    by = {}
    for r in got:
        assert r["size"] == len(words(next(x[1] for x in rows if x[0] == r["doc_id"]))) and 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault(r["source"], []).append(r)
    total = sum(r["size"] for r in got)
    target = {s: g[0]["target"] for s, g in by.items()}
    for s, g in by.items():
        assert g[0]["source_size"] == sum(r["size"] for r in g)
        assert abs(sum(r["taken"] for r in g) - target[s]) <= 1 and target[s] <= 3 * g[0]["source_size"]
    assert abs(sum(target.values()) - total) < 1e-6 * total
    order = sorted(by, key=lambda s: (s is None, s or ""))
    free = {s: target[s] / (i % 3 + 1) for i, s in enumerate(order) if target[s] < 3 * by[s][0]["source_size"]}
    assert max(free.values()) - min(free.values()) < 1e-6 * total
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, got))
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and abs(sum(len(words(r["text"])) for r in out.collect()) - total) <= len(by)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixed_documents_keep_rows_and_columns(spark):
    """Names that the operator might use inside, and rows that agree in doc_id, source and text only."""
    rows = [(i // 2, f"one two three {i // 2}", "s", f"row {i}", i) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, k1 string, whole long")
    docs = docs.withColumns({"_k1": F.col("k1"), "cut": F.col("whole"), "row": F.col("k1")})
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, docs.collect()))
