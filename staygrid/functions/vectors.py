"""Vector expressions over ``array<float>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when a vector has no length, NULL when one is missing."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def term_rates(text: Column, words: list[str]) -> Column:
    """Occurrences of each word divided by the text's length."""
    low, n = F.lower(text), F.length(text)
    counts = [F.regexp_count(low, F.lit(w)) for w in words]
    return F.when(n > 0, F.transform(F.array(*counts), lambda c: c / n)).otherwise(
        F.array(*[F.lit(0.0) for _ in words])
    )


def query_score(text: Column, search: str) -> Column:
    """Cosine of the text's word rates against those of the search text itself."""
    import re

    words = [w for w in re.split(r"\W+", search.lower(), flags=re.ASCII) if w]
    if not words:
        return F.lit(0.0)
    return cosine(term_rates(text, words), term_rates(F.lit(search), words))
