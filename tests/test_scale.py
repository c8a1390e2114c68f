"""Work that must not grow faster than the input: what is stored, shuffled, sent to Python or kept in state."""

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from staygrid.functions import text
from staygrid.operators import changes, setpairs, similarity, topk
from staygrid.plans import chunks, warehouse
from staygrid.streaming.stale import _Silence


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sketches_never_differ_in_more_bits_than_the_sets_in_words(spark):
    sets = [set(range(40)), set(range(5, 45)), set(range(200)), set(range(100, 110)), set(range(10, 900))]
    listed = spark.createDataFrame([(i, len(s), w) for i, s in enumerate(sets) for w in s], "class_id long, n int, w long")
    found = similarity._sketches(listed.select("class_id", "n", F.xxhash64("w").alias("word")))
    pairs = found.alias("x").crossJoin(found.alias("y")).select(
        F.col("x.class_id").alias("a"), F.col("y.class_id").alias("b"), similarity._flips(F.col("x.sketch"), F.col("y.sketch")).alias("flips"))
    got = {(r.a, r.b): r.flips for r in pairs.collect()}
    assert len(got) == 25
    for (a, b), flips in got.items():
        assert flips <= len(sets[a] ^ sets[b]) and (flips == 0) == (a == b)


class _Handle:
    def __init__(self):
        self.value, self.timers = None, []

    def getValueState(self, name, schema):
        return self

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        self.timers.append(at)


class _Times:
    def __init__(self, now):
        self.now = now

    def getCurrentWatermarkInMs(self):
        return self.now

    getExpiryTimeInMs = getCurrentWatermarkInMs


def test_a_job_has_one_timer_for_all_its_signs():
    job, handle = _Silence(["k"], 100), _Handle()
    job.init(handle)
    times = [0, 10, 250, 1000, 1000, 5000]
    rows = pd.DataFrame({"sign_at": times, "sign_ended": [False, False, False, False, True, False]})
    list(job.handleInputRows((7,), iter([rows, rows]), _Times(0)))
    assert handle.timers == [100]
    out = pd.concat(job.handleExpiredTimer((7,), _Times(3000), _Times(100)))
    assert out.to_dict("list") == {"k": [7, 7], "last_seen": [10, 250], "stale_at": [110, 350]}
    assert handle.timers == [100, 5100]
    assert list(job.handleExpiredTimer((7,), _Times(5100), _Times(5050))) == []
    out = pd.concat(job.handleExpiredTimer((7,), _Times(5101), _Times(5100)))
    assert out["last_seen"].tolist() == [5000] and handle.value is None


def test_a_place_that_its_type_cannot_hold_is_null(spark):
    flat = spark.createDataFrame([("a", "Phố, Huế, Việt Nam", 100.5, 1000.25), ("b", "", 16.5, 108.25)], "hotel_id string, address string, latitude double, longitude double")
    got = {r.hotel_id: (r.latitude, r.longitude) for r in warehouse.locations(flat).collect()}
    assert got["a"] == (None, None) and [float(x) for x in got["b"]] == [16.5, 108.25]


def test_nfc_leaves_batches_in_arrow(spark):
    given = ["é" * (i % 5) if i % 7 else None for i in range(300)]
    rows = spark.createDataFrame(list(enumerate(given)), "i int, t string").select("i", text.nfc("t").alias("n"))
    assert "ArrowEvalPython" in _plan(rows)
    assert text.nfc.evalType != F.pandas_udf(_same, "string").evalType
    got = dict(rows.collect())
    assert got == {i: None if v is None else unicodedata.normalize("NFC", v) for i, v in enumerate(given)}


def _same(s: pd.Series) -> pd.Series:
    return s


def test_span_table_function_takes_few_texts_at_a_time(spark):
    chunks.register_table_functions(spark)
    plan = _plan(spark.sql("SELECT s.* FROM VALUES ('a. b.') AS d(md), LATERAL md_spans(d.md) AS s"))
    assert "BatchEvalPythonUDTF" in plan and "ArrowEvalPythonUDTF" not in plan


def test_assembling_shuffles_the_spans_once(spark):
    spans = spark.createDataFrame([(1, p, p // 3, "text", f"t{p}", None, False) for p in range(200)],
                                  "d int, pos int, block int, kind string, text string, lang string, is_header boolean")
    chosen = spark.createDataFrame([(1, p) for p in (0, 63, 64, 127, 199)], "d int, pos int")
    out = chunks.assembled(spans, chosen, ["d"])
    assert out.first().answer == "t0\n\nt63 t64\n\nt127\n\nt199"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        # One for the spans, two for the places.
        assert _plan(chunks.assembled(spans, chosen, ["d"])).count("Exchange hashpartitioning") <= 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_json_diff_looks_at_the_pairs_once(spark):
    pairs = spark.createDataFrame([(1, '{"a": 1, "b": "é"}', '{"a": 2, "b": "é"}'), (2, "{}", '{"c": "x"}')], "i int, a string, b string")
    out = changes.json_diff(pairs, ["i"], "a", "b")
    assert "variant" not in _plan(out)
    assert {tuple(r) for r in out.collect()} == {(1, "a", "1", "2"), (2, "c", None, '"x"')}


def test_small_slices_grow_with_the_tables_and_keep_the_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vecs = rng.integers(-2, 3, (300, 4)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "vec_id int, embedding array<double>")
    asked = df.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    out = topk.nearest_batch(df, asked, 5, query_rows=1, vector_rows=1)
    got = {}
    for r in out.collect():
        got.setdefault(r.query_id, {})[r.position] = (r.vec_id, round(r.similarity, 9))
    size = np.linalg.norm(vecs, axis=1)
    for q in range(300):
        with np.errstate(divide="ignore", invalid="ignore"):
            sim = np.where(size * size[q] == 0, 0.0, vecs @ vecs[q] / (size * size[q]))
        best = sorted(range(300), key=lambda i: (-round(sim[i], 9), i))[:5]
        assert [round(v[1], 9) for _, v in sorted(got[q].items())] == [round(sim[i], 9) for i in best]


def test_long_gated_texts_are_made_after_the_shuffle(spark, monkeypatch, tmp_path):
    from staygrid.queries import texts
    from staygrid.queries.registry import Tables

    spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(texts, "spread", lambda df, *keys, **_: df.repartition(4, *keys))
    monkeypatch.setattr(chunks, "spread", lambda df, *keys, **_: df.repartition(4, *keys))
    out = texts.x7(Tables(spark, str(tmp_path)))
    shuffled = [line for line in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "RepartitionByExpression" in line]
    assert shuffled and not any("body" in line for line in shuffled)
    assert out.count() == 40


def _near_copies(count, changed):
    """Texts of 120 words each, ``changed`` of them their own."""
    rng = np.random.default_rng(7)
    base = [f"word{i:03}{'x' * (i % 7)}" for i in range(120)]
    texts = []
    for i in range(count):
        own = base.copy()
        for at in rng.choice(120, changed, replace=False):
            own[at] = f"own{i}-{at}"
        texts.append(" ".join(own))
    return texts


def test_pairs_of_similar_texts_travel_without_their_words(spark):
    texts = _near_copies(160, 8)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(4)
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        every = disk.getAllFiles()
        return {every.apply(i).getPath(): every.apply(i).length() for i in range(every.size())}

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        before = files()
        pairs = similarity.similar_texts(df, "id", "t", 0.7)[1]
        assert pairs.count() == 160 * 159 // 2
        shuffled = sum(size for path, size in files().items() if path not in before and "shuffle_" in path)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Each text meets 159 others.
    assert shuffled < 10 * sum(map(len, texts))


def test_similar_pairs_are_the_same_in_many_tiles(spark, monkeypatch):
    for name, size in (("PLACES", 300), ("SKETCHES", 9), ("WORDS", 700)):
        monkeypatch.setattr(similarity, name, size)
    rng = np.random.default_rng(5)
    texts = [*_near_copies(30, 12), *_near_copies(5, 1), *(" ".join(f"w{x}" for x in rng.integers(0, 40, rng.integers(1, 30))) for _ in range(60)), "w1", " ", "", None]
    rows = [(f"t{i:03}", x) for i, x in enumerate(texts)]
    # An id with two texts, a text that comes twice, a row without an id.
    rows += [("t003", "some other text"), ("t900", texts[0]), rows[7], (None, "w2")]
    df = spark.createDataFrame(rows, "id string, t string").repartition(3)
    sets = {}
    for i, x in rows:
        if i is not None and x is not None:
            sets.setdefault(i, set()).add(frozenset(x.lower().split()))
    members, pairs = similarity.similar_texts(df, "id", "t", 0.6)
    named = {r.class_id for r in members.collect()}
    single = {i: next(iter(sets[i])) for i in named if len(sets[i]) == 1 and next(iter(sets[i]))}
    want = {(a, b): len(single[a] & single[b]) / len(single[a] | single[b]) for a in single for b in single if a < b}
    got = [(r.a, r.b, r.similarity) for r in pairs.collect()]
    assert len(got) == len({x[:2] for x in got}) > 400
    assert {(a, b): s for a, b, s in got if a in single and b in single} == {k: v for k, v in want.items() if v >= 0.6}


def test_blocks_of_numbers_come_back():
    rng = np.random.default_rng(1)
    columns = [rng.integers(0, top, 1000) for top in (1, 200, 60_000, 1 << 24, 1 << 40)] + [np.zeros(0, np.int64)]
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(columns, setpairs.unpacked(setpairs.packed(*columns))))


def test_a_pair_meets_at_its_first_common_word_only():
    # Two sets with the same 20 words, all of which are in their prefixes: one meeting, not 20.
    n, at = np.full(40, 60), np.tile(np.arange(20), 2)
    no = np.repeat([0, 1], 20)
    met = list(setpairs.meeting(n, at, at + 100, np.where(at > 0, at + 99, 0), no, 0.5))
    assert [(a.tolist(), b.tolist()) for a, b in met] == [([0], [1])]


def test_packed_sketches_bound_the_difference():
    rng = np.random.default_rng(2)
    sets = [rng.choice(1 << 20, size, replace=False).astype(np.int32) for size in (5, 40, 200, 900)]
    sets += [np.concatenate([x[: len(x) * 3 // 4], x[-1:] + (1 << 21)]) for x in sets]
    n = np.array([len(x) for x in sets])
    slots = setpairs.slots_of(n)
    bits = np.split(setpairs.sketches(n, np.concatenate(sets)), np.cumsum(slots)[:-1])
    for x, one in zip(sets, bits):
        for y, other in zip(sets, bits):
            differ = int(setpairs.flips(one[None, :], other[None, :])[0])
            assert differ <= len(set(x.tolist()) ^ set(y.tolist())) and (differ == 0) == (x is y)
