import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from staygrid.plans import chunks, redaction
from pyspark.sql import functions as F


@pytest.mark.parametrize("n, sizes", [(0, []), (500, [500]), (1000, [1000, 200]), (1800, [1000, 1000, 200])])
def test_overlapping(spark, n, sizes):
    df = spark.createDataFrame([(1, "x" * n)], "id int, t string")
    assert [len(r.content) for r in chunks.overlapping(df, ["id"], "t").orderBy("chunk_no").collect()] == sizes


def test_overlapping_blank_and_bad(spark):
    df = spark.createDataFrame([(1, " " * 1500)], "id int, t string")
    assert chunks.overlapping(df, ["id"], "t").count() == 0
    with pytest.raises(ValueError):
        chunks.overlapping(df, ["id"], "t", 10, 10)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .!\n\né漢😀", max_size=400), st.integers(1, 60), st.integers(4, 80))
def test_boundary_invariants(text, max_chars, max_bytes):
    pieces = chunks.boundary_pieces(text, max_chars, max_bytes)
    assert "".join(p for _, p in pieces) == text
    at = 0
    for start, p in pieces:
        assert start == at and p and len(p) <= max_chars and len(p.encode()) <= max_bytes
        at += len(p)


def test_boundary_preference():
    assert chunks.boundary_pieces("aaaa bbbb\n\ncc. dd ee", 16)[0][1] == "aaaa bbbb\n\n"
    assert chunks.boundary_pieces("aaaa bbbbbb. cc dd ee", 16)[0][1] == "aaaa bbbbbb. "


def test_bad_limits(spark):
    with pytest.raises(ValueError):
        chunks.at_boundaries(spark.range(1), ["id"], "id", 0)


@pytest.mark.parametrize("style, want", [("tag", "mail <EMAIL_ADDRESS> now"), ("mask", "mail ****** now"), ("remove", "mail  now")])
def test_redaction(spark, style, want):
    df = spark.createDataFrame([(1, "mail a@b.co now")], "id int, t string")
    assert redaction.redact_documents(df, ["id"], "t", style).first().redacted == want


def test_overlapping_spans_are_skipped(val):
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(k).alias("kind")) for a, b, k in [(7, 12, "B"), (5, 11, "A")]])
    assert val(lambda t: redaction.redacted(t, spans, "tag"), t="mail a@b.co now") == "mail <A> now"


def test_entities_and_gate(spark):
    rows = [(1, "a@b.co card 4111 1111 1111 1111"), (2, " \n"), (3, "x" * 250_001)]
    df = spark.createDataFrame(rows, "id int, t string")
    out = {r.id: r for r in redaction.redact_documents(df, ["id"], "t", "tag", ["FINANCIAL"]).collect()}
    assert out[1].redacted == "a@b.co card <CREDIT_CARD>" and out[1].n_spans == 1
    assert (out[2].status, out[2].reason, out[2].redacted) == ("skipped", "empty_input", " \n")
    assert (out[3].status, out[3].reason, out[3].redacted) == ("skipped", "too_large", None)


def test_spans_are_offsets(spark):
    import re
    body = "é a@b.co, x@y.org +1 555 123 4567 a@b.co"
    rows = redaction.span_rows(spark.createDataFrame([(1, body)], "id int, t string"), ["id"], "t").collect()
    for kind, pattern in redaction.PATTERNS.items():
        assert sorted((r.start, r.end) for r in rows if r.kind == kind) == [m.span() for m in re.finditer(pattern, body)]


MD = "# H *x*\n\nOne. Two [l](u)!\nthree\n\n- item a\n- item b\n\n> quoted. text\n\n| a | b* |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |\n\n```py\nx = 1\n\ny\n```\n"


def test_markdown_spans():
    got = [(s["kind"], s["text"]) for s in chunks.markdown_spans(MD)]
    assert got == [
        ("heading", "H x"), ("text", "One."), ("text", "Two [l](u)!"), ("text", "three"), ("text", "item a"), ("text", "item b"),
        ("text", "quoted."), ("text", "text"), ("table", "a | b*"), ("table", "1 | 2"), ("table", "3 | 4"), ("code", "x = 1"), ("code", "y")]


def test_assembled(spark):
    df = spark.createDataFrame([(1, MD)], "id int, md string")
    spans = chunks.spans_of(df, ["id"], "md")
    chosen = spark.createDataFrame([(1, p) for p in (0, 1, 2, 10, 11, 12, 99)], "id int, pos int")
    assert chunks.assembled(spans, chosen, ["id"]).first().answer == (
        "H x\n\nOne. Two [l](u)!\n\n| a | b\\* |\n| --- | --- |\n| 3 | 4 |\n\n```py\nx = 1\ny\n```")


def test_table_functions_in_sql(spark):
    """Rows of the SQL functions are those of the DataFrame forms; NULL and empty texts give none."""
    chunks.register_table_functions(spark)
    texts = [MD, "aaaa bbbb\n\ncc. dd ee é漢😀" * 9, "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, md string")
    got = spark.sql("SELECT id, c.* FROM {d} AS d, LATERAL chunk_markdown(d.md, 16, 20) AS c", d=docs)
    assert sorted(got.collect()) == sorted(chunks.at_boundaries(docs, ["id"], "md", 16, 20).collect())
    spans = spark.sql("SELECT id, s.* FROM {d} AS d, LATERAL md_spans(d.md) AS s", d=docs)
    key = lambda r: r[:2]
    assert sorted(map(tuple, spans.collect()), key=key) == sorted(map(tuple, chunks.spans_of(docs, ["id"], "md").collect()), key=key)
    assert {r.id for r in got.collect()} == {0, 1}


def test_table_function_limits(spark):
    chunks.register_table_functions(spark)
    with pytest.raises(Exception, match="max_chars must be positive"):
        spark.sql("SELECT * FROM chunk_markdown('abc', 0, 10)").collect()


def _plain_redaction(text, spans):
    out, at = [], 0
    for start, end, kind in sorted(spans, key=lambda s: s[0]):
        if start < at or start > len(text):
            continue
        out += [text[at:start], f"<{kind}>"]
        at = min(end, len(text))
    return "".join(out) + text[at:]


def test_redaction_of_many_spans(spark):
    """Overlapping, equal, empty and far spans in any number, against a plain loop; block borders change nothing."""
    import random
    r = random.Random(5)
    rows = []
    for i, n in enumerate([1, 2, 3, 4, 5, 9, 10, 50, 300]):
        text = "".join(r.choice("ab é漢😀\n") for _ in range(200))
        spans = [(s, s + r.randrange(6), r.choice("AB")) for s in (r.randrange(205) for _ in range(n))]
        rows.append((i, text, spans))
    df = spark.createDataFrame(rows, "id int, t string, s array<struct<start:int,end:int,kind:string>>")
    got = {x.id: x.out for x in df.select("id", redaction.redacted(F.col("t"), F.col("s")).alias("out")).collect()}
    assert got == {i: _plain_redaction(t, s) for i, t, s in rows}


def test_spans_of_a_text_full_of_matches(spark):
    body = " ".join(f"a{i}@b.co" for i in range(3000))
    rows = redaction.span_rows(spark.createDataFrame([(1, body)], "id int, t string"), ["id"], "t").collect()
    assert [body[x.start:x.end] for x in rows] == body.split(" ")
