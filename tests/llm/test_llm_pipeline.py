"""The corpus pipeline against plain versions of its stages."""

import llm_cases as cases
from pyspark.sql import functions as F

import corpus_pipeline
from staygrid.llm import language, sentencepieces

FOLDER = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    rejected = {k for k, t in docs if not any(c.isalpha() for c in t or "")}
    left = [d for d in docs if d[0] not in rejected]
    kept = cases.exact(left)
    left = [d for d in left if kept[d[0]][2]]
    names = cases.groups([(k, cases.simhash(t)) for k, t in left])
    left = [d for d in left if names[d[0]] == d[0]]
    hits = cases.contamination(left, items)
    left = [d for d in left if not hits[d[0]][1]]
    model = sentencepieces.Model(sentencepieces.model_path(None))
    want = {k: len(model.encode([t])[0]) // 4 for k, t in left}
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want and len(got) == len(want) and all(r.exact for r in got)


def test_stages_on_odd_rows(spark, tmp_path):
    cases.benchmark(spark, [(1, "a row without an id")]).write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (cases.odd(spark), cases.none(spark)):
        columns = docs.columns
        some = docs.head(1)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
            if name != "sentencepiece":
                assert docs.columns == columns
        # 1 to 3 are one text, 8 a repeated row, 10 and 11 copies; the others have no letter or are in the benchmark.
        assert sorted(r.doc_id for r in docs.collect()) == ([3, 8, 9, 10] if some else [])


#: Null and repeated ids with texts of their own, and copies of them.
FOX = "the quick brown fox jumps over the lazy dog and runs away from it again"
SEA = "far out at sea nobody hears how slowly an old wooden ship falls apart"
OAK = "beneath seven oaks there sleeps one hedgehog dreaming about ripe autumn pears"
MIX = [(None, FOX), (None, SEA), (None, SEA), (1, OAK), (1, FOX + " today"), (2, OAK), (2, "seventy drummers marched past our silent house before breakfast"), (1, OAK)]


def rows_of(docs):
    return sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)


def test_exact_dedup_keeps_every_text(spark):
    want = sorted([MIX[0], MIX[1], MIX[3], MIX[4], MIX[6]], key=str)
    for parts in (1, 5):
        assert rows_of(corpus_pipeline.exact_dedup(spark, cases.odd(spark, MIX).repartition(parts), "")) == want
    # No id occurs twice: the copy of a document without an id goes all the same.
    assert rows_of(corpus_pipeline.exact_dedup(spark, cases.odd(spark, MIX[:3]), "")) == [MIX[1], MIX[0]]
    # Copies that differ in another column: always the same one stays.
    a, b = cases.odd(spark, MIX[:1]), cases.odd(spark, MIX[:1]).withColumn("source", F.lit("other"))
    assert [r.source for c in (a.union(b), b.union(a)) for r in corpus_pipeline.exact_dedup(spark, c, "").collect()] == ["other", "other"]


def test_near_dedup_judges_rows(spark):
    # Same words but for white space and case: one fingerprint.  A document with an id stays rather than one without.
    docs = [(None, FOX), (None, FOX.upper()), (None, SEA), (3, SEA.title()), (3, OAK), (3, OAK.upper()), (None, SEA)]
    got = rows_of(corpus_pipeline.near_dedup(spark, cases.odd(spark, docs), ""))
    assert sorted(((i, t.lower()) for i, t in got), key=str) == [(3, OAK), (3, SEA), (None, FOX)]
    # Rows that are equal are copies too.
    assert rows_of(corpus_pipeline.near_dedup(spark, cases.odd(spark, [(None, FOX), (None, FOX), (4, SEA), (4, SEA)]), "")) == [(4, SEA), (None, FOX)]


def test_language_judges_rows(spark):
    docs = [(None, FOX), (None, None), (None, "12 + 34"), (5, SEA), (5, "!!"), (5, None), (9, OAK)]
    assert rows_of(corpus_pipeline.identified(spark, cases.odd(spark, docs), "")) == [(5, SEA), (9, OAK), (None, FOX)]


def test_decontaminated_judges_rows(spark, tmp_path):
    cases.benchmark(spark, [(1, FOX)]).write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = [(None, "Here: " + FOX), (None, SEA), (None, None), (5, FOX), (5, OAK)]
    assert rows_of(corpus_pipeline.decontaminated(spark, cases.odd(spark, docs), str(tmp_path))) == [(5, OAK), (None, SEA), (None, None)]


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "benchmark_decontamination", "sentencepiece"]
    assert language.UNKNOWN == "und"
