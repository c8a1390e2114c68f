"""Benchmark overlap, languages, licenses, toxicity, tokens."""

import random
import zlib

import llm_cases as cases
import numpy as np
import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from staygrid.llm import attribution, chunks, decontaminate, language, licenses, sentencepieces, toxicity, wavelet
from staygrid.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def small(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]


def found(df):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in df.collect()}


def test_contamination_query(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert found(QUERIES["op3_benchmark_decontamination"](spark, FOLDER)) == cases.contamination(small(spark), items)


@pytest.mark.parametrize("seed", [1, 2])
def test_contamination_of_few_words(spark, seed):
    rng = random.Random(seed)

    def text(n):
        return rng.choice([" ", "-", ", "]).join(rng.choice(["a", "B", "c", "é", "7"]) for _ in range(n))

    items = [(i, text(rng.choice([0, 1, 3, 9, 10, 11, 14]))) for i in range(8)] + [(8, None), (9, "zz"), (10, "zz")]
    docs = [(i, text(rng.randrange(60))) for i in range(60)] + [(90, "zz " * 12), (91, None), (92, items[4][1])]
    # Windows of four keep hits rare among so few words.
    for window, gram in ((4, 2), (4, 4), (4, 1)):
        got = found(decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), cases.benchmark(spark, items), window, gram))
        assert got == cases.contamination(docs, items, window)


def test_contamination_odd_rows(spark):
    items = cases.benchmark(spark, [(1, "brown fox jumps over the LAZY dog and runs away"), (2, None), (None, "a"), (1, "ipsum")])
    got = decontaminate.contamination(cases.odd(spark), items).collect()
    assert len(got) == len(cases.TEXTS)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].n_hit == by[3][0].n_hit == 10 and by[10][0].n_hit == 1 and not by[5][0].contaminated
    assert [r.n_hit for r in by[8]] == [20000, 20000]
    assert sorted(r.n_hit for r in by[None]) == [0, 1]  # "a" of "a row without an id"; null
    assert decontaminate.contamination(cases.none(spark), items).count() == 0
    assert decontaminate.contamination(cases.odd(spark), items.limit(0)).filter("contaminated").count() == 0


def test_phrases_against_plain_search():
    samples = {"x": "the cat sat on the mat and the dog", "y": "le chat est sur la table et le chien"}
    parser = language.Parser(samples)
    rng = random.Random(1)

    def plain(text, sample):
        n = i = 0
        while i < len(text):
            size = 0
            while i + size < len(text) and text[i:i + size + 1] in sample:
                size += 1
            i, n = i + max(size, 1), n + 1
        return n

    texts = ["", *("".join(rng.choice("thecatslrqu é") for _ in range(rng.randrange(1, 900))) for _ in range(20))]
    texts = [language.folded(t) for t in texts]
    s, bounds, _ = parser.fold(texts)
    got = parser.phrases(s, bounds)
    assert got.tolist() == [[plain(t, samples[n]) for t in texts] for n in parser.names]


def test_language_query(spark):
    got = QUERIES["op10_language_id"](spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/documents.parquet"), "doc_id").collect()
    assert len(got) == 200 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    unseen = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in unseen) >= 0.95 * len(unseen)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_odd_rows(spark):
    docs = cases.odd(spark)
    got = language.identify(docs).collect()
    assert len(got) == len(cases.TEXTS)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert [by[i].lang_pred for i in (4, 5, 6, 7)] == ["und"] * 4 and by[1].lang_pred == "en" and by[1].score == 1.0
    assert language.identify(cases.none(spark)).count() == 0
    unlabelled = language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}


def test_license_notices(spark):
    texts = [
        (1, "Some code.\nLicensed under the Apache License, Version 2.0.\nAll rights reserved."),
        (2, "licensed UNDER cc by-nc 4.0"), (3, "Licensed under CC BY 4.0"),
        (4, "This work is kindly licensed under the GNU General Public License, version 3."), (5, "rights reserved all"),
        (6, "This work is licensed by the GNU General Public License, version 3"), (7, None), (8, ""), (9, "all rights"),
        (10, "word " * 50000 + "Released under the MIT License " + "word " * 10),
        (11, "All rights reserved. All rights reserved."),
        (12, "Permission is hereby granted, free of charge, to any person obtaining a copy of this nice software and documentation files"),
    ]
    got = {}
    for r in licenses.scan(cases.odd(spark, texts)).collect():
        got.setdefault(r.doc_id, []).append((r.license_id, round(r.coverage, 2), texts[r.doc_id - 1][1][r.start:r.end]))
    assert sorted(got[1]) == [("Apache-2.0", 1.0, "Licensed under the Apache License, Version 2.0"), ("all-rights-reserved", 1.0, "All rights reserved")]
    assert got[2] == [("CC-BY-NC-4.0", 1.0, "licensed UNDER cc by-nc 4.0")] and got[3] == [("CC-BY-4.0", 1.0, "Licensed under CC BY 4.0")]
    assert got[4][0][:2] == ("GPL-3.0", 1.0) and got[6][0][0] == "GPL-3.0" and 0.8 <= got[6][0][1] < 1
    assert got[10] == [("MIT", 1.0, "Released under the MIT License")] and len(got[11]) == 2
    assert got[12][0][0] == "MIT-style" and got[12][0][1] >= 0.8  # the opening alone does not make it MIT
    assert not {5, 7, 8, 9} & set(got)
    assert licenses.scan(cases.none(spark)).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(cases.odd(spark), (("short", "two words"),))


def _texts(name):
    return max((t.replace("{", "").replace("}", "") for n, t in licenses.TEMPLATES if n == name), key=len)


def test_license_neighbours(spark):
    """Whole texts with their coverage; neighbours are told apart, other conditions are not taken for the license."""
    whole = ["MIT", "MIT-0", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Zlib", "BSL-1.0", "Unlicense", "GPL-2.0", "GPL-3.0", "AGPL-3.0", "LGPL-2.1", "LGPL-3.0", "Apache-2.0"]
    named = {
        "This work is licensed under the GNU Affero General Public License, version 3": "AGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 2.1": "LGPL-2.1",
        "This work is licensed under the GNU Lesser General Public License, version 3": "LGPL-3.0", "Licensed under the GNU General Public License v2": "GPL-2.0",
        "Licensed under CC BY-ND 4.0": "CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": "CC-BY-NC-4.0",
        "// SPDX-License-Identifier: MIT": "MIT", "# SPDX-License-Identifier: BSD-2-Clause": "BSD-2-Clause", "SPDX-License-Identifier: LGPL-2.1": "LGPL-2.1"}
    unknown = ["This work is licensed under the GNU Simpler General Public License, version 3", "Licensed under CC BY-XY 4.0", "Licensed under the Apache License, Version 1.1"]
    changed = _texts("MIT").replace("subject to the following conditions", "for evaluation only and subject to other conditions")
    texts = [f"Copyright 2020 someone\n\n{_texts(n)}\n\nint main;" for n in whole] + list(named) + unknown + [changed]
    got = {}
    for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append((r.license_id, r.coverage))
    want = {k: [(n, 1.0)] for k, n in enumerate(whole + list(named.values()))}
    assert {k: v for k, v in got.items() if k < len(want)} == want
    assert not {len(want) + k for k in range(len(unknown))} & set(got)
    assert "MIT" not in {n for n, _ in got.get(len(texts) - 1, [])} and "MIT-style" in {n for n, _ in got[len(texts) - 1]}
    worn = _texts("BSD-3-Clause").lower().replace("warranties", "guarantees").replace("holder", "owner")
    (r,) = licenses.scan(spark.createDataFrame([(1, worn)], "doc_id long, text string")).collect()
    assert r.license_id == "BSD-3-Clause" and r.n_matched == r.n_words - sum(w in ("guarantees", "owner", "owners") for w in licenses.words(worn))


def _plain_score(template, required, follows, ids, begin):
    """Best score over all chains of equal words within the band, looked at pair by pair."""
    spots = [(i, j) for i in range(len(template)) for j in range(len(ids)) if template[i] == ids[j] and abs(j - begin - i) <= licenses.BAND]
    first_needed = required.index(True) if True in required else len(template)
    last_needed = max((i for i, r in enumerate(required) if r), default=-1)
    chains = {}
    for i, j in sorted(spots):
        options = [1 - i] if i <= first_needed else []
        for (a, b), score in chains.items():
            if a < i and b < j and not any(required[a + 1:i]) and not (follows[i] and (a, b) != (i - 1, j - 1)):
                options.append(score + 1 - (i - a - 1) - (j - b - 1))
        if options:
            chains[i, j] = max(options)
    return max((s - (len(template) - 1 - i) for (i, j), s in chains.items() if i >= last_needed), default=None)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=3, max_size=14), st.lists(st.integers(0, 5), max_size=24), st.integers(-3, 8), st.integers(0, 13), st.integers(0, 3))
def test_license_alignment_against_all_chains(template, ids, begin, at, size):
    names = "abcde"
    text = [names[t] for t in template]
    if size and at + size <= len(text):
        text[at] = "{" + text[at]
        text[at + size - 1] += "}"
    tool = licenses.Scanner((("x", " ".join(text)),))
    codes = np.array([tool.vocabulary.get(names[v], -1) if v < 5 else -1 for v in ids], np.int64)
    got = tool.align(0, codes, begin)
    want = _plain_score(tool.templates[0].tolist(), tool.required[0], tool.follows[0], codes.tolist(), begin)
    assert (got and got[0]) == want


def test_license_query_finds_the_lines(spark):
    lines = {"Apache-2.0": "licensed under the apache license, version 2.0", "MIT": "released under the mit license", "all-rights-reserved": "all rights reserved",
             "GPL-3.0": "licensed under the gnu general public license, version 3", "CC-BY-NC-4.0": "licensed under cc by-nc 4.0"}
    want = {(k, n) for k, t in small(spark) for n, line in lines.items() if line in t.lower()}
    assert {(r.doc_id, r.license_id) for r in QUERIES["op8_license_scan"](spark, FOLDER).collect()} == want


def test_toxicity_on_unseen_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    chain = {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}
    got = toxicity.score(docs, labels.filter("doc_id % 3 > 0"), chain).withColumnRenamed("toxic", "found").join(labels.filter("doc_id % 3 = 0"), "doc_id").collect()
    assert len(got) > 100 and sum(r.found == (r.toxic == 1) for r in got) >= 0.9 * len(got)  # from some 270 labels
    assert not [r for r in got if r.found and not r.toxic]


def test_chain_uses_earlier_categories(spark):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        a = rng.random() < 0.5
        rows.append((" ".join([rng.choice(["red", "blue"]) if a else "green", rng.choice(["x", "y"])]), i % 3, int(a), int(a)))
    train = spark.createDataFrame(rows, "text string, fold int, y0 int, y1 int")
    weights, accuracy = toxicity.train_chain(train, ["blue", "green", "red"], [["green"], ["red"]], 3)
    assert len(weights[0]) == 4 and len(weights[1]) == 5 and weights[1][3] > 0 and min(accuracy) == 1.0
    assert not weights[0][[0, 2]].any() and not weights[1][[0, 1]].any()  # each model has its own features


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (None, 1), (5, 1), (77, None), (10, 0)], "doc_id long, toxic int")
    chain = {"toxic": F.col("toxic") == 1}
    assert len(toxicity.score(cases.odd(spark), labels, chain).collect()) == len(cases.TEXTS)
    assert toxicity.score(cases.none(spark), labels, chain).count() == 0
    unlabelled = toxicity.score(cases.odd(spark), labels.limit(0), chain).collect()
    assert len(unlabelled) == len(cases.TEXTS) and not any(r.toxic for r in unlabelled)


def test_allocation_rules():
    rng = random.Random(7)
    for _ in range(200):
        cuts = np.cumsum([rng.randrange(1, 6) for _ in range(rng.randrange(1, 12))])
        edges = sorted(rng.sample(range(int(cuts[-1]) + 1), min(int(cuts[-1]) + 1, 2 * rng.randrange(1, 5))) )
        edges = edges[:len(edges) // 2 * 2]
        starts, ends = np.array(edges[::2], np.int64), np.array(edges[1::2], np.int64)
        if not len(starts):
            continue
        for rule in attribution.RULES:
            want, begin = [0.0] * len(starts), 0
            for end in cuts.tolist():
                own = [-1] * (end - begin)
                for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
                    for p in range(max(a, begin), min(b, end)):
                        own[p - begin] = k
                # Gaps are sections of their own, told apart by the section before them.
                marks = [k if k >= 0 else -2 - sum(e <= begin + i for e in ends.tolist()) for i, k in enumerate(own)]
                if rule == "share":
                    for k in own:
                        if k >= 0:
                            want[k] += 1 / len(own)
                else:
                    k = marks[0] if rule == "start" else max(dict.fromkeys(marks), key=lambda m: (marks.count(m), -marks.index(m)))
                    if k >= 0:
                        want[k] += 1
                begin = end
            got, _ = attribution.allocate(cuts, starts, ends, rule)
            assert np.allclose(got, want), (rule, cuts, starts, ends)


def test_page_tokens_add_up(spark):
    coder, _ = attribution.tokenizer(attribution.ranks_path(None))
    want = {k: len(coder.encode_ordinary(t)) for k, t in small(spark)}
    for df in (QUERIES["op1_token_attribution"](spark, FOLDER), attribution.page_tokens(spark.read.parquet(f"{FOLDER}/documents.parquet"), 7, "share"),
               attribution.line_tokens(spark.read.parquet(f"{FOLDER}/documents.parquet"))):
        got = {r.doc_id: r.n for r in df.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_given_sections(spark):
    sections = spark.createDataFrame(
        [(9, 1, "head", 0, 6), (9, 2, "tail", 7, 10_000), (9, 3, "empty", 7, 7), (4, 1, "none", 0, 5), (None, 1, "x", 0, 3), (50, 1, "lost", 0, 3), (8, 1, "all", 0, 540000)],
        "doc_id long, section int, kind string, start int, end int")
    got = {(r.doc_id, r.kind): r for r in attribution.section_tokens(cases.odd(spark), sections).collect()}
    text = dict(cases.TEXTS)[9]
    assert got[9, "head"].end == 6 and got[9, "tail"].end == len(text) and (9, "empty") not in got and (4, "none") not in got
    coder, _ = attribution.tokenizer(attribution.ranks_path(None))
    assert got[8, "all"].n_tokens == len(coder.encode_ordinary(cases.LONG))
    assert attribution.page_tokens(cases.none(spark)).count() == 0
    assert {r.doc_id for r in attribution.page_tokens(cases.odd(spark)).select("doc_id").distinct().collect()} == {1, 2, 3, 6, 7, 8, 9, 10, 11, None}


def test_shared_prefix_viterbi():
    model = sentencepieces.load(sentencepieces.model_path(None))
    rng = random.Random(3)
    words = sorted({"▁" + "".join(rng.choice("theanringoué漢\U0001f600") for _ in range(rng.randrange(12))) for _ in range(400)})
    pieces = {}

    def collect(node, text):
        for c, x in node.items():
            if c == "":
                pieces[text] = x
            else:
                collect(x, text + c)

    collect(model.root, "")
    for word, ids in model.walk(words):
        best = [(0.0, [])]
        for end in range(1, len(word) + 1):
            options = []
            for start in range(max(0, end - 16), end):
                piece = pieces.get(word[start:end])
                if piece is not None:
                    options.append((best[start][0] + model.score[piece], best[start][1] + [piece]))
                elif end - start == 1:
                    options.append((best[start][0] + model.missing, best[start][1] + model.unknown_ids(word[start:end])))
            top = max(o[0] for o in options)
            best.append(next(o for o in options if o[0] == top))  # of equal sums the longest last piece
        assert ids == best[-1][1], word


def test_pieces_spell_the_text(spark):
    got = sentencepieces.decode(sentencepieces.encode(cases.odd(spark))).collect()
    assert len(got) == len(cases.TEXTS)
    for r in got:
        assert r.decoded == (r.text or "").replace("▁", " ") and (len(r.ids) > 0) == bool(r.text)
    tried = sentencepieces.round_trip(cases.odd(spark)).collect()
    assert sorted((r.n_tokens, r.exact) for r in tried) == sorted((len(r.ids), "▁" not in (r.text or "")) for r in got)
    assert sentencepieces.round_trip(cases.none(spark)).count() == 0
    assert all(r.exact for r in QUERIES["op5_sentencepiece"](spark, FOLDER).select("exact").collect())


def plain_tokens(docs):
    lib = tokenizers.Tokenizer.from_file(wavelet.tokenizer_path(None))
    out, start = {}, 0
    for k, t in docs:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        out[k] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    return out


def test_token_shards_query(spark):
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op9_token_shards"](spark, FOLDER).collect()}
    assert got == plain_tokens(sorted(small(spark)))


def test_chunks_are_what_the_library_makes(monkeypatch):
    lib = tokenizers.Tokenizer.from_file(wavelet.tokenizer_path(None))
    rng = random.Random(8)
    pool = ["The", "end.", "<|endoftext|>", "<|ENDOFTEXT|>", "I'll", "a.b,c", "é.", "É,", "5,000.00", "\x1c", "\xa0", " ", "\n\n", "漢字。", "İ.", "ΑΣ.", "...", "x" * 50, ".A", "'s."]
    texts = ["".join(rng.choice(pool) + rng.choice(["", " "]) for _ in range(rng.randrange(30))) for _ in range(200)]
    want = [[*lib.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    for stretch, remembered in ((chunks.STRETCH, wavelet.REMEMBERED), (64, 50)):
        monkeypatch.setattr(chunks, "STRETCH", stretch)
        monkeypatch.setattr(wavelet, "REMEMBERED", remembered)
        ids, counts = wavelet.Words(wavelet.tokenizer_path(None)).encode(texts)
        ends = np.cumsum(counts)
        assert [ids[e - n:e].tolist() for e, n in zip(ends, counts)] == want


@pytest.mark.parametrize("size, distinct", [(0, 1), (1, 1), (700, 1), (700, 2), (1500, 5), (3000, 700)])
def test_wavelet_matrix(size, distinct):
    rng = np.random.default_rng(size + distinct)
    ids = rng.integers(0, distinct, size).astype(np.uint32) * 7 + 3
    m = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids).to_bytes())
    assert (m.unpack() == ids).all() and len(m.unpack()) == size
    for at in rng.integers(0, max(size, 1), 30 if size else 0).tolist():
        c = int(ids[at])
        assert m.access(at) == c and m.rank(c, at) == int((ids[:at] == c).sum()) and m.rank(c + 1, at) == 0
        assert m.select(c, m.rank(c, at)) == at


def test_token_files(spark, tmp_path):
    docs = cases.odd(spark)
    target = str(tmp_path / "shards")
    wavelet.write_shards(docs, target, segment=50)
    got = wavelet.read_documents(spark, target).collect()
    assert len(got) == len(cases.TEXTS)
    # Null ids first, then ascending; null and empty texts are their end alone.
    ordered = sorted(cases.TEXTS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want = plain_tokens(list(enumerate(t for _, t in ordered)))
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in sorted(got, key=lambda r: r.start)] == [(ordered[k][0], *want[k]) for k in range(len(ordered))]
    total = sum(r.n_tokens for r in got)
    ends = {r.place for r in wavelet.find_token(spark, target, 2).collect()}
    assert {r.start + r.n_tokens - 1 for r in got} <= ends
    assert wavelet.count_token(spark, target, 2).agg(F.sum("n")).first()[0] == len(ends)
    assert {(r.place, r.id) for r in wavelet.read_tokens(spark, target, [min(ends), total - 1, total + 5]).collect()} == {(min(ends), 2), (total - 1, 2)}
    wavelet.write_shards(cases.none(spark), target + "-none")
    assert wavelet.read_documents(spark, target + "-none").count() == 0


def test_many_scripts():
    rng = random.Random(3)
    alphabets = {"ar": range(0x627, 0x64B), "de": range(0x61, 0x7B), "el": range(0x3B1, 0x3CA), "he": range(0x5D0, 0x5EB), "hi": range(0x915, 0x93A),
                 "ja": range(0x3041, 0x3097), "ko": range(0xAC00, 0xAE00), "ru": range(0x430, 0x450), "th": range(0xE01, 0xE2F), "zh": range(0x4E00, 0x5200)}
    lexicon = {n: ["".join(chr(rng.choice(a)) for _ in range(rng.randrange(1, 6))) for _ in range(300)] for n, a in alphabets.items()}

    def text(name, size):
        return " ".join(rng.choice(lexicon[name]) for _ in range(size))

    # The rarer a script in the samples, the less of it would have a symbol.
    samples = {n: language.folded(text(n, 200 + 150 * i)) for i, n in enumerate(sorted(alphabets))}
    parser = language.Parser(samples)
    texts = [(n, text(n, 30)) for n in alphabets for _ in range(5)]
    assert parser.predict([t for _, t in texts])[0] == [n for n, _ in texts]

    def plain(text, sample):
        n = i = 0
        while i < len(text):
            size = 0
            while i + size < len(text) and text[i:i + size + 1] in sample:
                size += 1
            i, n = i + max(size, 1), n + 1
        return n

    mixed = [language.folded(text("zh", 9) + text("de", 9) + text("ko", 9) + "ǂᨀ" + text("ar", 5)), language.folded(text("ko", 60))]
    s, bounds, _ = parser.fold(mixed)
    assert parser.phrases(s, bounds).tolist() == [[plain(t, samples[n]) for t in mixed] for n in parser.names]


def test_small_sample_takes_no_other_texts(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang")
    one = next(i for i in range(10 ** 6, 2 * 10 ** 6) if language.remainder(i) != 2)
    odd = spark.createDataFrame([(one, "ok", "aa")], "doc_id long, text string, lang string")
    # Rows of German without a letter, more than are learned from.
    empty = spark.range(2 * 10 ** 6, 2 * 10 ** 6 + 20000).selectExpr("id as doc_id", "if(id % 2 = 0, null, '12 !') as text", "'de' as lang")
    got = language.identify(docs.union(odd).union(empty)).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.95 * len(got)
    assert {r.lang_pred for r in language.identify(docs.union(odd)).filter(F.col("doc_id") == one).collect()} == {"aa"}


def test_long_texts_are_cut_like_short_ones():
    """A text that is encoded by itself has the ids it has in a batch."""
    model = sentencepieces.load(sentencepieces.model_path(None))
    texts = ["", "a", "one  two\nthree \n\n four", "x\u2581y \u2581\u2581 z", " \u2581 a", "\n", "  ", "\u2581", "tab\tand\rmore", "漢字 x\U0001f600"]
    rng = random.Random(8)
    texts += ["".join(rng.choice("ab \n\u2581é ") for _ in range(rng.randrange(60))) for _ in range(200)]
    assert [model._alone(t) for t in texts] == model.encode(texts)


def test_labels_that_differ(spark):
    """Contradicting and repeated labels give one result for any partitioning."""
    docs = spark.createDataFrame([(i, ("bad awful words " if i % 2 else "kind fine words ") + f"n{i % 7}") for i in range(400)], "doc_id long, text string")
    docs = docs.unionByName(docs.limit(50)).unionByName(spark.createDataFrame([(1, f"other text {i}") for i in range(300)], "doc_id long, text string"))
    rows = [(i, i % 2, i % 2) for i in range(400)] + [(i, 1 - i % 2, 1 - i % 2) for i in range(0, 400, 5)] + [(i, i % 2, i % 2) for i in range(1, 50)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    chain = {"low": F.col("quality") == 1, "toxic": F.col("toxic") == 1}
    results = []
    for n in (1, 7):
        got = toxicity.score(docs.repartition(n), labels.repartition(n), chain).collect()
        results.append(sorted((r.doc_id, round(r.p_toxic, 6)) for r in got))
    assert results[0] == results[1] and len(results[0]) == 750
    by = dict(results[0])
    assert by[3] > 0.9 and by[2] < 0.1


def test_sample_of_a_hot_id(spark):
    """A doc_id that many rows share brings a bounded number of them to the driver, and languages with few rows stay."""
    rows = [(1, f"hello world number {i}", "en") for i in range(3000)] + [(i, f"bonjour le monde {i}", "fr") for i in range(2, 40)] + [(7, "bonjour", "fr")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = language.learn(docs, 400, 8)
    assert set(learned) <= {"en", "fr"} and "fr" in learned and all(len(v) <= 400 for v in learned.values())
    assert language.learn(docs.repartition(5), 400, 8) == learned
    if not any(language.remainder(1) == 2 for _ in (0,)):
        assert len(learned["en"].split("hello")) - 1 <= 8
