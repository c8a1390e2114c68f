"""Exact and near duplicates, repeated spans."""

import random

import llm_cases as cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from staygrid.llm import exact, graph, repeats, simhash
from staygrid.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def small(spark, table="documents"):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{FOLDER}/{table}.parquet").select("doc_id" if table == "documents" else "item_id", "text").collect()]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_exact_query(spark):
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in QUERIES["op6_exact_dedup"](spark, FOLDER).collect()}
    assert got == cases.exact(small(spark))


def test_polynomial_is_composable():
    rng = random.Random(1)
    table = exact.powers(exact.MODULI)
    for n in (0, 1, 4095, 4096, 4097, 20000):
        data = bytes(rng.randrange(256) for _ in range(n))
        cut = rng.randrange(n + 1)
        (a, _), (b, s), (whole, _) = (exact.polynomial(x, exact.MODULI, table) for x in (data[:cut], data[cut:], data))
        assert [(x * y + z) % p for x, y, z, p in zip(a, s, b, exact.MODULI)] == whole
        plain = 0
        for c in data:
            plain = (plain * exact.BASES[0] + c) % exact.MODULI[0]
        assert plain == whole[0]


def test_exact_pieces_and_collisions(spark):
    rows = [(i, random.Random(i // 2).choice("abc") * (50 + i // 2) + " " * (i % 3)) for i in range(40)] + [(90, None), (91, "")]
    want = cases.exact(rows)
    docs = frame(spark, rows)
    whole = {(r.doc_id, bytes(r["print"])) for r in exact.fingerprints(docs).collect()}
    assert whole == {(r.doc_id, bytes(r["print"])) for r in exact.fingerprints(docs, huge=10, piece=7).collect()}
    for moduli in (exact.MODULI, (2, 3, 5)):  # the small moduli make different texts share a fingerprint
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact.duplicates(docs, moduli, 60, 16).collect()}
        assert got == want
    same_length = frame(spark, [(i, format(i, "08b")) for i in range(64)])
    assert exact.collisions(same_length, exact.fingerprints(same_length, (2, 3, 5))).count() > 0
    assert exact.duplicates(same_length, (2, 3, 5)).filter("group_size = 1").count() == 64


def test_exact_odd_rows(spark):
    got = exact.duplicates(cases.odd(spark)).collect()
    assert len(got) == len(cases.TEXTS)
    by = {}
    for r in got:
        by.setdefault(r.text_sha256, []).append(r)
    assert all(sum(r.kept for r in rs) == 1 and rs[0].group_size == len(rs) for rs in by.values())
    # 3 has more code points than 1 and 2; null, empty and blank texts are one group, where the blank one is longest.
    keep = {r.doc_id: r.keep_id for r in got if r.doc_id is not None}
    assert keep[1] == keep[2] == keep[3] == 3 and keep[4] == keep[5] == 6 and keep[11] == 10
    assert exact.duplicates(cases.none(spark)).count() == 0


def test_simhash_query(spark):
    docs = small(spark)
    prints = [(k, cases.simhash(t)) for k, t in docs]
    want = cases.groups(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op4_simhash_near_dedup"](spark, FOLDER).collect()}
    assert got == {k: (format(p, "016x"), want[k]) for k, p in prints}


@pytest.mark.parametrize("limit", [3, 40, 5000])
def test_vantage_point_search(spark, limit):
    rng = random.Random(limit)
    centres = [rng.getrandbits(64) for _ in range(12)]
    prints = {0, (1 << 64) - 1}
    for _ in range(400):
        p = rng.choice(centres)
        for _ in range(rng.randrange(7)):
            p ^= 1 << rng.randrange(64)
        prints.add(p)
    pairs = [(p, p) for p in sorted(prints)]
    want = cases.groups(pairs)
    signed = [(int(np.uint64(p).view(np.int64)),) for p in prints]
    links = simhash.links(spark.createDataFrame(signed, "fp long"), 4, limit).collect()
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 4 for r in links)
    up = {p: p for p in prints}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for r in links:
        a, b = find(r.a % (1 << 64)), find(r.b % (1 << 64))
        up[max(a, b)] = min(a, b)
    assert {p: find(p) for p in prints} == want


def test_components_of_a_chain(spark):
    n = 60
    chain = list(range(n))
    random.Random(5).shuffle(chain)
    links = spark.createDataFrame([*zip(chain, chain[1:]), (100, 101), (101, 101), (100, 101)], "a long, b long")
    got = {r.node: r.root for r in graph.components(links).collect()}
    assert got == {**{i: 0 for i in range(1, n)}, 101: 100}
    assert graph.components(links.limit(0)).count() == 0


def test_crowded_cells_of_far_fingerprints(spark):
    """Rows per fingerprint do not grow with the number of fingerprints, once cells are crowded."""
    each = []
    for n in (20_000, 40_000, 80_000):
        fps = spark.range(n).select(F.xxhash64("id").alias("fp"))
        each.append(simhash.cells(fps, 4, 2).count() / n)
    assert max(each) <= 25 and each[2] < 1.5 * each[1] < 3 * each[0]


@pytest.mark.parametrize("bits", [0, 1, 3])
def test_dense_cells_against_all_pairs(spark, bits):
    """Fingerprints that differ in few bits only, which blocks do not part, among far ones."""
    rng = random.Random(bits)
    fps = {sum(1 << 5 * k for k in range(9) if rng.random() < 0.5) for _ in range(300)} | {rng.getrandbits(64) for _ in range(200)}
    fps |= {f ^ 1 << rng.randrange(64) for f in list(fps)[:80]}
    prints = [(f, f) for f in fps]
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    roots = {}

    def find(x):
        while roots.get(x, x) != x:
            x = roots[x]
        return x

    for r in simhash.links(spark.createDataFrame(signed, "fp long"), bits, 8).collect():
        roots[find(r.a)] = find(r.b)
    want = cases.groups(prints, bits)
    got = {}
    for f, (v,) in zip(fps, signed):
        got.setdefault(find(v), set()).add(f)
    expected = {}
    for f, least in want.items():
        expected.setdefault(least, set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))


def test_simhash_odd_rows(spark):
    got = simhash.near_duplicates(cases.odd(spark)).collect()
    assert len(got) == len(cases.TEXTS)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert {by[i][0].fingerprint for i in (4, 5, 6)} == {"0" * 16} and {by[i][0].component_id for i in (4, 5, 6)} == {4}
    assert by[2][0].component_id == 1 and by[8][0].component_id == 8 and len(by[8]) == 2
    assert simhash.near_duplicates(cases.none(spark)).count() == 0


def test_repeats_query(spark):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op7_repeated_spans"](spark, FOLDER).collect()}
    assert got == cases.repeats(sorted(small(spark)))


@pytest.mark.parametrize("seed, limit, per", [(1, 2, 5), (2, 3, 1000), (3, 1000, 7), (4, 1000, 1000)])
def test_repeats_of_small_windows(spark, seed, limit, per):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abé ") for _ in range(rng.randrange(5, 40))) for _ in range(6)]
    rows = [(i, "".join(rng.choice([*passages, "x", "yy", "abababab", rng.choice("klmn")]) for _ in range(rng.randrange(12)))) for i in range(60)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(frame(spark, rows), 12, 4, per, limit).collect()}
    assert got == cases.repeats(rows, 12)


def test_transform_and_common_prefixes():
    rng = random.Random(3)
    for _ in range(60):
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(15))) for _ in range(rng.randrange(1, 8))]
        bwt, lcp = repeats.build(texts, 5)
        suffixes = sorted(t[j:] for t in texts for j in range(len(t) + 1))
        common = [0, *(next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y))) for x, y in zip(suffixes, suffixes[1:]))]
        assert lcp.tolist() == [min(c, 5) for c in common]
        assert sorted(bwt.tolist()) == sorted([c + 1 for t in texts for c in t] + [0] * len(texts))


def test_reads_cover_all_windows():
    rng = random.Random(4)
    for n in (99, 100, 101, 500, 5000):
        a = np.frombuffer(bytes(rng.choice(b"abc") for _ in range(n)), np.uint8)
        first, last, at, _ = repeats.reads(a)
        assert [w for f, e in zip(first, last) for w in range(f, e + 1)] == list(range(max(0, n - 99)))
        assert all(e <= p <= f + 64 for f, e, p in zip(first, last, at))


def test_reads_across_stretches(monkeypatch):
    rng = random.Random(6)
    a = np.frombuffer(bytes(rng.choice(b"abcd") for _ in range(3000)), np.uint8)
    whole = repeats.reads(a)
    monkeypatch.setattr(repeats, "STRETCH", 700)
    assert all((x == y).all() for x, y in zip(whole, repeats.reads(a)))


def test_repeats_odd_rows(spark):
    rows = [(i, t) for i, t in cases.TEXTS if i != 8] + [(8, "lorem ipsum dolor " * 40), (8, "lorem ipsum dolor " * 40), (12, "lorem ipsum dolor " * 30)]
    got = repeats.remove_repeats(cases.odd(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = sorted((r.n_bytes, r.n_removed) for r in got if r.doc_id == 8)
    # Of the repeated row one is a copy of the other, and the other repeats itself after its first period.
    assert sizes == [(720, 702), (720, 720)]
    assert [r.n_removed for r in got if r.doc_id == 12] == [540]
    assert repeats.remove_repeats(cases.none(spark)).count() == 0
    text_ids = cases.odd(spark, rows).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert repeats.remove_repeats(text_ids).count() == len(rows)
