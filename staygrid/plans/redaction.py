"""Sensitive spans: detection by pattern, entity mapping, rendering, gating.

All JVM-side.  Offsets come from splitting a text at a pattern: the pieces'
and matches' lengths add up to each match's position.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import let
from ..session import spread

MAX_BYTES = 250_000

# Span kind -> entity.
KIND_ENTITY = {
    "PRIVATE_PERSON": "PERSON", "PERSON": "PERSON",
    "PRIVATE_EMAIL": "EMAIL", "EMAIL_ADDRESS": "EMAIL",
    "PRIVATE_PHONE": "PHONE", "PHONE_NUMBER": "PHONE", "PHONEIMEI": "PHONE",
    "PRIVATE_ADDRESS": "LOCATION", "LOCATION": "LOCATION",
    "ACCOUNT_NUMBER": "FINANCIAL", "CREDIT_CARD": "FINANCIAL", "IBAN_CODE": "FINANCIAL", "US_BANK_NUMBER": "FINANCIAL",
    "US_SSN": "FINANCIAL", "US_ITIN": "FINANCIAL", "CRYPTO": "FINANCIAL",
    "SECRET": "SECRET", "API_KEY": "SECRET", "PASSWORD": "SECRET", "US_DRIVER_LICENSE": "SECRET",
    "US_PASSPORT": "SECRET", "MEDICAL_LICENSE": "SECRET",
}

# Stand-ins for the external detector.  No pattern can match an empty text, and
# none rescans a long run of letters from each of its positions.
PATTERNS = {
    "EMAIL_ADDRESS": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "PHONE_NUMBER": r"\+?[0-9]{1,3}[ -][0-9]{3}[ -][0-9]{3}[ -][0-9]{4}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}",
    "CREDIT_CARD": r"[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}",
    "IBAN_CODE": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}",
    "API_KEY": r"(?:sk|pk|ghp|AKIA)[-_A-Za-z0-9]{16,}",
}


def entity_of(kind: Column) -> Column:
    pairs = [F.lit(x) for kv in KIND_ENTITY.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), kind)


def source_class(raw: Column, model_name: str) -> Column:
    return F.when(raw == model_name, "model").when(raw.endswith("Recognizer"), "heuristics").otherwise("unknown")


def _walked(
    items: Column, empty: Column, step: Callable[[Column, Column, Column], Column], close: Callable[[Column], Column], closed: str,
    shared: Callable[[Column, Column], Column] = lambda at, block: F.lit(0),
) -> Column:
    """Folds ``items`` into struct(at, out), where ``step`` appends to ``out``; ``out`` ends as a list of ``close``d parts.

    Appending copies the list, so the items are taken in blocks of the root of their number: each block fills a list of its
    own, which is closed and appended once.  ``shared`` is worked out once per block, for its steps.  There must be an item.
    """
    n = F.greatest(F.size(items), F.lit(1))
    width = F.ceil(F.sqrt(n)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / width).cast("int")), lambda k: F.slice(items, k * width + 1, width))
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{closed}>)").alias("out"))

    def add(acc: Column, block: Column) -> Column:
        inside = let(shared(acc["at"], block), lambda c: F.aggregate(
            block, F.struct(acc["at"].alias("at"), empty.alias("out")), lambda a, s: step(a, s, c)))
        return let(inside, lambda w: F.struct(w["at"].alias("at"), F.concat(acc["out"], F.array(close(w["out"]))).alias("out")))

    return F.aggregate(blocks, start, add)


def pattern_spans(text: Column, kind: str, pattern: str) -> Column:
    """array<struct<start, end, kind>> of all matches, offsets in characters."""
    span = "struct<start:int,end:int,kind:string>"
    empty = F.expr(f"cast(array() as array<{span}>)")

    def step(acc: Column, s: Column, _: Column) -> Column:
        end = acc["at"] + s["gap"] + s["size"]
        found = F.struct((acc["at"] + s["gap"]).alias("start"), end.alias("end"), F.lit(kind).alias("kind"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(found)).alias("out"))

    def located(m: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m)), F.length)
        sized = F.zip_with(gaps, F.transform(m, F.length), lambda g, n: F.struct(g.alias("gap"), n.alias("size")))
        spans = let(sized, lambda z: F.flatten(_walked(z, empty, step, lambda out: out, f"array<{span}>")["out"]))
        return F.when(F.size(m) == 0, empty).otherwise(spans)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), located)


def detected(text: Column, patterns: dict[str, str] | None = None) -> Column:
    return F.flatten(F.array(*[pattern_spans(text, k, p) for k, p in (patterns or PATTERNS).items()]))


def span_rows(docs: DataFrame, keys: list[str], body: str, patterns: dict[str, str] | None = None) -> DataFrame:
    """Rows (keys, start, end, kind, entity)."""
    rows = spread(docs, *keys).select(*keys, F.explode(detected(F.col(body), patterns)).alias("_s"))
    return rows.select(*keys, "_s.start", "_s.end", "_s.kind", entity_of(F.col("_s.kind")).alias("entity"))


def allowed(spans: Column, entities: list[str] | None) -> Column:
    """Spans of the wanted entities; unmapped kinds drop once a list is given."""
    if not entities:
        return spans
    return F.filter(spans, lambda s: F.coalesce(entity_of(s["kind"]).isin(entities), F.lit(False)))


def lifted(spans: Column, chunk_start: Column) -> Column:
    """Chunk offsets to document offsets."""
    return F.transform(spans, lambda s: F.struct(
        (s["start"] + chunk_start).alias("start"), (s["end"] + chunk_start).alias("end"), s["kind"].alias("kind")))


def redacted(text: Column, spans: Column, style: str = "tag") -> Column:
    """Text with spans replaced by a tag, a mask or nothing; overlaps are skipped."""
    if style not in ("tag", "mask", "remove"):
        raise ValueError("style must be tag, mask or remove")
    def put(s: Column) -> Column:
        if style == "tag":
            return F.concat(F.lit("<"), s["kind"], F.lit(">"))
        if style == "mask":
            return F.repeat(F.lit("*"), F.greatest(F.lit(0), s["end"] - s["start"]))
        return F.lit("")

    # By start only, keeping the given order among equals.
    numbered = F.transform(spans, lambda s, i: F.struct(
        s["start"].alias("start"), i.alias("i"), s["end"].alias("end"), s["kind"].alias("kind")))
    # A place in a text is found by counting from its beginning, so each block has its stretch of the text.
    def stretch(at: Column, block: Column) -> Column:
        return F.struct(at.alias("base"), F.substr(text, at + 1, F.greatest(F.lit(0), F.element_at(block, -1)["start"] - at)).alias("text"))

    def step(n: Column, acc: Column, s: Column, c: Column) -> Column:
        kept = F.array(F.substr(c["text"], acc["at"] - c["base"] + 1, s["start"] - acc["at"]), put(s))
        return F.when((s["start"] < acc["at"]) | (s["start"] > n), acc).otherwise(F.struct(
            F.least(s["end"], n).alias("at"), F.concat(acc["out"], kept).alias("out")))

    empty = F.expr("cast(array() as array<string>)")
    walked = let(F.sort_array(numbered), lambda z: let(F.length(text), lambda n: _walked(
        z, empty, lambda acc, s, c: step(n, acc, s, c), lambda out: F.array_join(out, ""), "string", stretch)))
    tail = lambda w: F.concat(F.array_join(w["out"], ""), F.substr(text, w["at"] + 1))
    return F.when(F.size(spans) == 0, text).otherwise(let(walked, tail))


def gate(text: Column) -> Column:
    """Why a text is not redacted; NULL when it is."""
    return F.when(~F.regexp_like(text, F.lit(r"(?U)\S")), "empty_input").when(F.octet_length(text) > MAX_BYTES, "too_large")


def document_status(chunks: DataFrame, keys: list[str], ok: str = "ok", reason: str = "reason", order: str = "chunk_no") -> DataFrame:
    """All or nothing: one failed chunk fails its document, with the first reason."""
    failed_at = F.when(~F.col(ok), F.col(order))
    return chunks.groupBy(*keys).agg(
        F.when(F.bool_and(ok), "ok").otherwise("failed").alias("status"), F.min_by(reason, failed_at).alias("reason"))


def redact_documents(docs: DataFrame, keys: list[str], body: str, style: str = "tag", entities: list[str] | None = None, patterns: dict[str, str] | None = None) -> DataFrame:
    """(keys, status, reason, redacted, n_spans) per document."""
    staged = spread(docs, *keys).select(*keys, F.col(body).alias("_t"), gate(F.col(body)).alias("reason"))
    plain = F.col("reason").isNull()
    # Refused texts are not searched.
    found = staged.withColumn("_s", F.when(plain, allowed(detected(F.col("_t"), patterns), entities)))
    return found.select(
        *keys, F.when(plain, "ok").otherwise("skipped").alias("status"), "reason",
        F.when(plain, redacted(F.col("_t"), F.col("_s"), style)).when(F.col("reason") == "empty_input", F.col("_t")).alias("redacted"),
        F.when(plain, F.size("_s")).otherwise(0).alias("n_spans"))
