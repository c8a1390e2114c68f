"""Order-dependent and merging operators against plain Python on small data."""

import random

import pytest

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from staygrid.operators import changes, ordered, records, similarity


def greedy(rows, fields):
    """Reference behaviour on one block of (ord, values, areas, src)."""
    out = []
    for ord_, values, areas, src in sorted(rows, key=lambda r: r[0]):
        values = [None if v == "null" else v for v in values]
        for item in out:
            if all(a is None or b is None or a == b for a, b in zip(item[1], values)):
                item[1] = [b if b is not None else a for a, b in zip(item[1], values)]
                item[2] += [x for x in areas if x not in item[2]]
                item[3] |= {src}
                break
        else:
            out.append([ord_, values, list(areas), {src}])
    return {(tuple(v), tuple(sorted(a)), tuple(sorted(s))) for _, v, a, s in out}


def test_merge_matches_greedy(spark):
    rng = random.Random(5)
    rows = []
    for i in range(900):
        rows.append((rng.choice("ab"), i, rng.choice([None, "null", "e1", "e2"]), rng.choice([None, "t1", "t2"]), rng.choice([None, 1, 2]),
                     [rng.choice("xyz")], rng.choice(["u1", "u2", "u3"])))
    # A hot block: a third of all rows are equal copies, many others complete.
    rows += [("hot", 1000 + i, "e1", "t1", 1, ["x"], "u1") for i in range(400)]
    rows += [("hot", 2000 + i, f"e{i % 50}", "t9", 7, ["x"], "u2") for i in range(200)] + [("hot", 3000, None, "t9", None, ["y"], "u3")]
    df = spark.createDataFrame(rows, "name string, ord int, email string, title string, phone int, areas array<string>, src string")
    got = records.merge_records(df, ["name"], "ord", ["email", "title", "phone"], ["areas"], "src").collect()
    for name in ("a", "b", "hot"):
        want = greedy([(r[1], r[2:5], r[5], r[6]) for r in rows if r[0] == name], 3)
        have = {((r.email, r.title, r.phone), tuple(sorted(r.areas)), tuple(r.sources)) for r in got if r.name == name}
        assert have == want, name


@pytest.mark.parametrize("at", [0, 37, 5000])
def test_record_without_values_brings_no_others(spark, at):
    rng = random.Random(at)
    rows = [("hot", 10 + i, f"e{i}", "t", i, [rng.choice("xyz")], rng.choice(["u1", "u2"])) for i in range(60)]
    rows += [("hot", at, None, "null", None, ["q"], "u3"), ("hot", at + 1, None, None, None, ["r"], "u4"), ("hot", 90, "e7", None, None, ["s"], "u5")]
    rows += [("none", 1, None, None, None, ["a"], "u1"), ("none", 2, None, "null", None, ["b"], "u2")]
    df = spark.createDataFrame(rows, "name string, ord int, email string, title string, phone int, areas array<string>, src string")
    got = records.merge_records(df, ["name"], "ord", ["email", "title", "phone"], ["areas"], "src").collect()
    for name in ("hot", "none"):
        want = greedy([(r[1], r[2:5], r[5], r[6]) for r in rows if r[0] == name], 3)
        assert {((r.email, r.title, r.phone), tuple(sorted(r.areas)), tuple(r.sources)) for r in got if r.name == name} == want


def test_merge_of_many_fields(spark):
    rng = random.Random(9)
    fields = [f"f{i}" for i in range(12)]
    rows = [("b", i, *[rng.choice([None, "1", "1"]) if i % 3 else str(i % 2) for _ in fields]) for i in range(40)]
    df = spark.createDataFrame(rows, "name string, ord int, " + ", ".join(f"{f} string" for f in fields))
    got = {tuple(r[f] for f in fields) for r in records.merge_records(df, ["name"], "ord", fields).collect()}
    assert got == {v for v, _, _ in greedy([(r[1], r[2:], [], "") for r in rows], fields)}


def test_merge_examples(spark):
    df = spark.createDataFrame([("n", 0, "1", None), ("n", 1, "1", "2"), ("n", 2, "1", "3"), (None, 3, "1", None)], "k string, ord int, a string, b string")
    got = {(r.k, r.a, r.b) for r in records.merge_records(df, ["k"], "ord", ["a", "b"]).collect()}
    assert got == {("n", "1", "2"), ("n", "1", "3"), (None, "1", None)}


def _skewed(spark, n=4000):
    """A third of the rows under one key."""
    rng = random.Random(1)
    rows = [("hot" if i % 3 == 0 else f"k{rng.randrange(50)}", rng.randrange(1000), i, rng.randrange(100)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, t int, id int, v int")


def test_row_number_in_order(spark):
    rows, df = _skewed(spark)
    got = ordered.row_number_in_order(df, ["k"], ["t", "id"], F.floor(F.col("t") / 100), "rn").collect()
    want, seen = {}, {}
    for k, t, i, _ in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        seen[k] = seen.get(k, 0) + 1
        want[i] = seen[k]
    assert {r.id: r.rn for r in got} == want


def test_running_sum_in_order(spark):
    rows, df = _skewed(spark)
    got = ordered.running_sum_in_order(df, ["k"], ["t", "id"], F.floor(F.col("t") / 100), F.col("v"), "s").collect()
    want, total = {}, {}
    for k, t, i, v in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        total[k] = total.get(k, 0) + v
        want[i] = total[k]
    assert {r.id: r.s for r in got} == want


def test_previous_in_order(spark):
    rows, df = _skewed(spark)
    got = ordered.previous_in_order(df, ["k"], ["t", "id"], F.floor(F.col("t") / 100), ["id", "v"]).collect()
    want, last = {}, {}
    for k, t, i, v in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        want[i] = last.get(k, (None, None))
        last[k] = (i, v)
    assert {r.id: (r.prev_id, r.prev_v) for r in got} == want


def test_null_keys_are_a_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "k string, t int")
    got = ordered.row_number_in_order(df, ["k"], ["t"], F.col("t"), "rn").collect()
    assert {(r.k, r.t): r.rn for r in got} == {(None, 1): 1, (None, 2): 2, ("a", 1): 1}


def test_even_buckets_split_a_hot_key(spark):
    rows, df = _skewed(spark)
    even = ordered.Even(F.col("t"), 500, rows=100)
    sizes = ordered._bucketed(df, ["k"], even).groupBy("k", "_b").count()
    assert sizes.agg(F.max("count")).first()[0] < 200
    assert sizes.filter("k = 'k1'").count() <= 2
    got = ordered.row_number_in_order(df, ["k"], ["t", "id"], even, "rn").collect()
    want = ordered.row_number_in_order(df, ["k"], ["t", "id"], F.lit(0), "rn").collect()
    assert {(r.id, r.rn) for r in got} == {(r.id, r.rn) for r in want}
    prev = ordered.previous_in_order(df, ["k"], ["t", "id"], even, ["id"]).collect()
    want = ordered.previous_in_order(df, ["k"], ["t", "id"], F.lit(0), ["id"]).collect()
    assert {(r.id, r.prev_id) for r in prev} == {(r.id, r.prev_id) for r in want}


def _bursty(spark):
    """A burst within a second, a burst on one instant, rows without a position."""
    rng = random.Random(4)
    times = [rng.random() for _ in range(1500)] + [2.0] * 1200 + [rng.randrange(3, 100_000) * 1.0 for _ in range(200)] + [None] * 90
    rng.shuffle(times)
    return spark.createDataFrame([("k" if i % 7 else None, t, i, i % 5) for i, t in enumerate(times)], "k string, t double, id int, v int")


def test_bursts_are_cut_by_count(spark):
    even = ordered.Even(F.col("t"), 50_000, rows=100, tie=F.col("id"))
    sizes = ordered._bucketed(_bursty(spark), ["k"], even).groupBy("_k", "_b").count()
    assert sizes.agg(F.max("count")).first()[0] <= 150
    assert sizes.count() < 80


@pytest.mark.parametrize("nulls_last", [False, True])
def test_result_does_not_depend_on_bucket_size(spark, nulls_last):
    df = _bursty(spark)
    by = [F.asc_nulls_last("t") if nulls_last else F.asc_nulls_first("t"), F.col("id")]
    plain = W.partitionBy("k").orderBy(*by)
    want = {r.id: (r.rn, r.s) for r in df.select("id", F.row_number().over(plain).alias("rn"), F.sum("v").over(plain.rowsBetween(W.unboundedPreceding, 0)).alias("s")).collect()}
    for rows in (1, 100, 1_000_000):
        for tie in (None, F.col("id")):
            even = ordered.Even(F.col("t"), 50_000, rows, tie, nulls_last)
            rn = {r.id: r.rn for r in ordered.row_number_in_order(df, ["k"], by, even, "rn").collect()}
            assert rn == {i: v[0] for i, v in want.items()}
    s = {r.id: r.s for r in ordered.running_sum_in_order(df, ["k"], by, ordered.Even(F.col("t"), 50_000, 100, F.col("id"), nulls_last), F.col("v"), "s").collect()}
    assert s == {i: v[1] for i, v in want.items()}


def test_previous_with_null_positions(spark):
    df = _bursty(spark)
    plain = W.partitionBy("k").orderBy("t", "id")
    want = {r.id: r.p for r in df.select("id", F.lag("id").over(plain).alias("p")).collect()}
    for rows in (1, 100, 1_000_000):
        got = ordered.previous_in_order(df, ["k"], ["t", "id"], ordered.Even(F.col("t"), 50_000, rows, F.col("id")), ["id"]).collect()
        assert {r.id: r.prev_id for r in got} == want


def test_newest_good(spark):
    from staygrid.operators.windows import newest_good_or_newest
    rows = [("a", 5, 500), ("a", 4, 200), ("b", 9, 500), ("b", 8, 500), ("b", 7, 500), ("b", 6, 200), ("c", 1, 404)]
    df = spark.createDataFrame(rows, "k string, t int, status int")
    got = {r.k: r.t for r in newest_good_or_newest(df, ["k"], ["t"], "status").collect()}
    assert got == {"a": 4, "b": 9, "c": 1}


def test_price_drop(spark):
    from staygrid.operators.windows import price_drops
    rows = [("p", 1, 100.0), ("p", 2, 98.0), ("p", 3, 95.0), ("q", 1, 100.0), ("q", 2, 96.0), ("z", 1, 0.0), ("z", 2, 0.0)]
    got = price_drops(spark.createDataFrame(rows, "k string, t int, price double"), ["k"], ["t"], "price").collect()
    assert [r.k for r in got] == ["p"]


def test_json_changes(spark):
    cases = [
        ('{"plans":[{"price":"$19","n":1}]}', '{"plans":[{"price":"$24","n":1}]}', {"plans[0].price": ('"$19"', '"$24"')}),
        ('{"tags":["a","b"]}', '{"tags":["a","b","c"]}', {"tags[2]": (None, '"c"')}),
        ('{"o":{"x":1}}', '{"o":"s"}', {"o": ('{"x":1}', '"s"')}),
        ('{"a":1,"b":"e\u0301  x"}', '{"b":"\u00e9 x\u200b","a":1}', {}),
        ('{"f":1}', '{"f":true}', {"f": ("1", "true")}),
        ('{"f":1000}', '{"f":1e3,"g":null}', {"g": (None, "null")}),
        ('{"n":null}', '{"n":0}', {"n": ("null", "0")}),
        (None, '{"a":{"b":[1]}}', {"a": (None, '{"b":[1]}')}),
        ('{"a":[[1,2],[3]]}', '{"a":[[1],[3,4]]}', {"a[0][1]": ("2", None), "a[1][1]": (None, "4")}),
        ("{bad", "{worse", {"": ('"{bad"', '"{worse"')}),
        ('{"t":"[{\\""}', '{"t":"[["}', {"t": ('"[{\\""', '"[["')}),
        ('{"x":' * 20 + "1" + "}" * 20, '{"x":' * 20 + "2" + "}" * 20, {".".join("x" * 20): ("1", "2")}),
        ('{"\u00e9":"\u00e9a"}', '{"\u00e9":"\u00e9b"}', {"\u00e9": ('"\u00e9a"', '"\u00e9b"')}),
        ("[]", "{}", {"": ("[]", "{}")}),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "id int, a string, b string")
    got = {}
    for r in changes.json_diff(df, ["id"], "a", "b").collect():
        got.setdefault(r.id, {})[r.path] = (r.previous, r.current)
    assert got == {i: want for i, (_, _, want) in enumerate(cases) if want}


@pytest.mark.parametrize("crowded", [1, 5000])
def test_merge_by_components(spark, crowded):
    rng = random.Random(crowded)
    rows = [("hot", i, rng.choice([None, f"e{i // 8}"]), f"t{i // 8}", rng.choice([None, i // 8, i // 8 + 1]), [rng.choice("xyz")], "u1") for i in range(400)]
    rows += [("c", i, "e", f"t{i % 2}", 1, [rng.choice("xyz")], "u1") for i in range(12)]
    rows += [("hot", -1, None, None, None, ["q"], "u3"), ("b", 1, "e", None, None, ["q"], "u3"), ("b", 2, None, "t", None, [], "u3")]
    df = spark.createDataFrame(rows, "name string, ord int, email string, title string, phone int, areas array<string>, src string")
    got = records.merge_records(df, ["name"], "ord", ["email", "title", "phone"], ["areas"], "src", crowded=crowded).collect()
    for name in ("hot", "b", "c"):
        want = greedy([(r[1], r[2:5], r[5], r[6]) for r in rows if r[0] == name], 3)
        assert {((r.email, r.title, r.phone), tuple(sorted(r.areas)), tuple(r.sources)) for r in got if r.name == name} == want
    assert len(got) == len({(r.name, r.email, r.title, r.phone) for r in got})


def test_merge_of_a_hot_block(spark):
    """100 000 records of one block, each with gaps; groups of four belong together."""
    k = F.col("id")
    rows = spark.range(100_000).select(F.lit("b").alias("name"), k.alias("ord"), F.concat(F.lit("n"), F.floor(k / 4)).alias("a"),
                                       F.when(k % 2 == 0, F.floor(k / 4)).alias("b"), F.when(k % 2 == 1, "x").alias("c"))
    got = records.merge_records(rows, ["name"], "ord", ["a", "b", "c"])
    assert got.filter(F.col("b").isNotNull() & (F.col("c") == "x")).count() == got.count() == 25_000


def test_similar_texts_against_all_pairs(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.sample(base[:rng.choice([3, 8, 30])], rng.randint(1, 3)) + ["the"] * rng.randint(0, 1)) for _ in range(150)]
    for i in range(100):
        words = base + [f"v{i % 7}"]
        words[rng.randrange(30)] = f"x{i % 5}"
        texts.append(" ".join(rng.sample(words, len(words))))
    texts += ["", "", " ", None, "The THE the", "the"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for least, hot in ((0.9, 64), (0.9, 1), (0.5, 3), (0.34, 1), (1.0, 1)):
        members, pairs = similarity.similar_texts(df, "id", "t", least, hot)
        classes = {r.id: r.class_id for r in members.collect()}
        sets = {i: frozenset(t.lower().split()) for i, t in enumerate(texts) if t is not None}
        assert all((classes[i] == classes[j]) == (sets[i] == sets[j] if sets[i] else texts[i] == texts[j]) for i in sets for j in sets)
        named = {c: sets[c] for c in classes.values() if sets[c]}
        want = {(a, b): len(named[a] & named[b]) / len(named[a] | named[b]) for a in named for b in named if a < b}
        assert {(r.a, r.b): r.similarity for r in pairs.collect()} == {k: v for k, v in want.items() if v >= least}




def test_components_leave_out_what_is_done(spark, monkeypatch):
    """2,000 pairs and a chain of 200: rounds for the chain do not take the pairs along."""
    from staygrid.operators import components as module
    stored = []

    def counted(df, write=module.cut_lineage):
        out = write(df)
        stored.append(out.count())
        return out

    monkeypatch.setattr(module, "cut_lineage", counted)
    rows = [(i, i // 2) for i in range(4000)] + [(5000 + i + d, 9000 + i) for i in range(199) for d in (0, 1)]
    found = module.components(spark.createDataFrame(rows, "node long, hub long")).collect()
    names = {r.node: r.component for r in found}
    assert len(found) == len(names) == 4200 and len(set(names.values())) == 2001
    assert all(names[i] == names[i + 1] for i in range(0, 4000, 2)) and len({names[5000 + i] for i in range(200)}) == 1
    assert sum(stored) < 20_000


def test_merge_keeps_kinds_of_values(spark):
    """Dates, decimals, nested arrays and records alone in their block come out as they went in."""
    kinds = "name string, ord long, a date, b decimal(10,2), c double, items array<struct<x:int,y:string>>, more array<array<int>>, src string"
    from datetime import date
    from decimal import Decimal
    day, price = date(2024, 2, 29), Decimal("1.50")
    rows = [("n", 5, day, None, None, [(1, "p")], None, "u2"), ("n", 6, None, price, None, [(1, "p"), (2, None)], [[1], [1]], "u1"), ("n", 7, day, price, 0.5, None, [[2, 3]], None),
            ("alone", 1, None, price, None, [(1, "p"), (1, "p")], [[1], [1]], None), ("other", 2, None, None, None, None, None, "u9")]
    for crowded in (1, 5000):
        got = records.merge_records(spark.createDataFrame(rows, kinds), ["name"], "ord", ["a", "b", "c"], ["items", "more"], "src", crowded=crowded)
        assert {r.name: tuple(r)[1:] for r in got.collect()} == {
            "n": (day, price, 0.5, [(1, "p"), (2, None)], [[1], [2, 3]], 5, ["u1", "u2"]),
            "alone": (None, price, None, [(1, "p"), (1, "p")], [[1], [1]], 1, []), "other": (None, None, None, None, None, 2, ["u9"])}
