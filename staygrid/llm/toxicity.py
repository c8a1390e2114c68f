"""Toxicity by a classifier chain.

Categories are predicted one after the other by logistic regressions on words and their beginnings; each model also
sees the probabilities of the categories before it.  For training these are out-of-fold predictions, made by models
that have not seen the row, so that later models learn how far earlier ones can be trusted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staygrid.llm.common import slices
from staygrid.session import cut_lineage

#: Labelled rows that the chain is fitted on, about; words and beginnings kept per category; folds.
ROWS, FEATURES, FOLDS = 10_000, 1500, 5
#: Documents that must have a feature, in training, and how far it must be from chance (chi-square, one degree).
LEAST, FAR = 5, 40.0
#: Beginnings of words, in letters.
BEGINNINGS = (4, 5, 6)
PENALTY, STEPS = 0.02, 400
#: Distinct words that a worker remembers; it starts anew beyond.
REMEMBERED = 400_000
WORD = re.compile(r"\w+")


def features_of(word: str) -> list[str]:
    """A word and its beginnings, these marked by a hyphen."""
    return [word, *(word[:n] + "-" for n in BEGINNINGS if len(word) > n)]


def features(text: str | None) -> set[str]:
    return {f for w in set(WORD.findall((text or "").lower())) for f in features_of(w)}


def sample_of(labelled: DataFrame, rows: int = ROWS) -> DataFrame:
    """About ``rows`` of the labelled rows, by a hash of their id; all if there are fewer."""
    have = labelled.count()
    if have <= rows:
        return labelled
    return labelled.filter(F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("sample")), 1) < int(rows / have * 2.0 ** 63))


def _tallied(categories: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1024):
            marks = np.column_stack([part.column(f"y{k}").to_numpy(zero_copy_only=False) for k in range(categories)]).astype(int).tolist()
            tally: dict[str, list[int]] = {}
            for text, ys in zip(part.column("text").to_pylist(), marks):
                for f in features(text):
                    t = tally.get(f)
                    if t is None:
                        t = tally[f] = [0] * (categories + 1)
                    t[0] += 1
                    for k, y in enumerate(ys):
                        t[k + 1] += y
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(tally), pa.string()), *(pa.array([t[i] for t in tally.values()], pa.int64()) for i in range(categories + 1))],
                names=["feature", "n", *(f"n{k}" for k in range(categories))])
    return run


def choose(train: DataFrame, categories: int, keep: int = FEATURES, least: int = LEAST) -> list[list[str]]:
    """Per category the features that speak for it most, by chi-square: at most ``keep`` that are over-represented in its rows.

    What is commoner in other rows is left out: it would let a long text's ordinary words outweigh what is wrong with it.
    """
    total, *positive = train.agg(F.count(F.lit(1)), *(F.sum(F.col(f"y{k}")) for k in range(categories))).first()
    if not total:
        return [[] for _ in range(categories)]
    counts = "".join(f", n{k} long" for k in range(categories))
    tally = train.mapInArrow(_tallied(categories), f"feature string, n long{counts}").groupBy("feature").agg(
        F.sum("n").alias("n"), *(F.sum(f"n{k}").alias(f"n{k}") for k in range(categories))).filter(F.col("n") >= least)
    tally = cut_lineage(tally)
    chosen: list[list[str]] = []
    for k in range(categories):
        p, a, n = float(positive[k] or 0), F.col(f"n{k}").cast("double"), F.col("n").cast("double")
        if not 0 < p < total:
            chosen.append([])
            continue
        gap = a * (total - p) - (n - a) * p
        chi = gap * gap * total / (n * (total - n + F.lit(1e-9)) * p * (total - p))
        over = tally.withColumn("chi", chi).filter((a * total > n * p) & (F.col("chi") >= FAR))
        chosen.append([r.feature for r in over.orderBy(F.desc("chi"), "feature").limit(keep).select("feature").collect()])
    return chosen


class Lookup:
    """Feature numbers of texts; each distinct word is looked up once."""

    def __init__(self, names: tuple[str, ...]):
        self.numbers = {f: i for i, f in enumerate(names)}
        self.known: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str | None) -> list[int]:
        known = self.known
        own = set(WORD.findall((text or "").lower()))
        if len(known) > REMEMBERED:
            known.clear()
        for w in own.difference(known):
            known[w] = tuple(n for f in features_of(w) if (n := self.numbers.get(f)) is not None)
        return sorted({n for w in own for n in known[w]})


@lru_cache(maxsize=1)
def lookup(names: tuple[str, ...]) -> Lookup:
    return Lookup(names)


def _numbered(names: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = lookup(names)
        for part in slices(batches):
            found = [find(x) for x in part.column("text").to_pylist()]
            kept = [i for i, n in enumerate(part.schema.names) if n != "text"]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), pa.array(found, pa.list_(pa.int32()))],
                                             names=[*(part.schema.names[i] for i in kept), "found"])
    return run


def fit(found: list[np.ndarray], earlier: np.ndarray, y: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Weights of the features (0 but for the category's own ones), the earlier probabilities and a constant, by Adam on the penalised loss."""
    size = len(own)
    width = size + earlier.shape[1] + 1
    lengths = np.array([len(f) for f in found])
    at = np.concatenate(found).astype(np.int64) if lengths.sum() else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(found)), lengths)
    w, m, v = np.zeros(width), np.zeros(width), np.zeros(width)
    rate = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    w[-1] = np.log(rate / (1 - rate))
    for step in range(1, STEPS + 1):
        z = np.bincount(row, weights=w[at], minlength=len(y)) + earlier @ w[size:-1] + w[-1]
        gap = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y) / len(y)
        g = np.concatenate((np.bincount(at, weights=gap[row], minlength=size)[:size] * own, earlier.T @ gap, [gap.sum()]))
        g[:-1] += PENALTY * w[:-1] / len(y)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-9)
    return w


def probability(w: np.ndarray, found: list[int] | np.ndarray, earlier: list[float], size: int) -> float:
    z = w[np.asarray(found, np.int64)].sum() + (np.dot(w[size:-1], earlier) if len(earlier) else 0.0) + w[-1]
    return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def train_chain(train: DataFrame, names: list[str], chosen: list[list[str]], folds: int = FOLDS) -> tuple[list[np.ndarray], list[float]]:
    """(weights of each category's model on all rows, its out-of-fold accuracy); ``chosen`` has the features of each category.

    ``train`` has text, fold and y0, y1, ...; it is a bounded sample.  The models of a category (one without each fold and
    one on all rows) are fitted side by side, one task each.
    """
    size, categories = len(names), len(chosen)
    rows = cut_lineage(train.select("text", "fold", *(f"y{k}" for k in range(categories))).mapInArrow(
        _numbered(tuple(names)), "fold int, " + "".join(f"y{k} int, " for k in range(categories)) + "found array<int>"))
    rows = rows.withColumn("earlier", F.array().cast("array<double>"))
    out, accuracy = [], []
    for k in range(categories):
        label, own = f"y{k}", np.isin(names, chosen[k])

        def fitted(part: pd.DataFrame) -> pd.DataFrame:
            model = int(part["model"].iloc[0])
            earlier = np.array(part["earlier"].tolist(), float).reshape(len(part), -1)
            w = fit([np.asarray(f) for f in part["found"]], earlier, part[label].to_numpy(float), own)
            return pd.DataFrame({"model": [model], "w": [w.tolist()]})

        models = F.filter(F.sequence(F.lit(0), F.lit(folds)), lambda m: m != F.col("fold"))  # model ``folds`` sees all rows
        weights = {r.model: np.array(r.w) for r in rows.withColumn("model", F.explode(models)).groupBy("model").applyInPandas(
            fitted, "model int, w array<double>").collect()}

        def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches:
                p = [probability(weights.get(f, weights[folds]), x, e, size) for f, x, e in zip(
                    part.column("fold").to_pylist(), part.column("found").to_pylist(), part.column("earlier").to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p, pa.float64())], names=[*part.schema.names, "p"])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        rows = cut_lineage(rows.mapInArrow(predicted, f"{fields}, p double"))
        accuracy.append(rows.agg(F.avg(((F.col("p") >= 0.5).cast("int") == F.col(label)).cast("double"))).first()[0])
        rows = rows.withColumn("earlier", F.concat("earlier", F.array("p"))).drop("p")
        out.append(weights[folds])
    return out, accuracy


def _scored(names: tuple[str, ...], weights: list[np.ndarray], categories: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = lookup(names)
        for part in slices(batches):
            table = []
            for text in part.column("text").to_pylist():
                found, ps = find(text), []
                for w in weights:
                    ps.append(probability(w, found, ps, len(names)))
                table.append(ps)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array([t[k] for t in table], pa.float64()) for k in range(len(categories)))],
                                             names=["doc_id", *(f"p_{c}" for c in categories)])
    return run


def score(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], rows: int = ROWS, folds: int = FOLDS) -> DataFrame:
    """doc_id, p_<category> ..., and <last category> (probability of at least 0.5): one row per row of ``docs``.

    ``categories`` maps names, in the order of the chain, to conditions on ``labels`` (doc_id and their columns); rows of
    ``labels`` where a condition is null, or without an id or text, are not learned from.  The fit uses about ``rows``
    labelled ids.  An id with several rows of labels counts once where they agree and is not learned from where they
    don't; of several texts with one id the first by a hash of its content is learned from.  So the result does not
    depend on how rows are dealt to tasks.  Without labels of both kinds a category gets its share of the labels (0
    without any) everywhere.  Null texts are scored as empty ones; every row of ``docs`` is scored, repeated ones too.
    """
    names = list(categories)
    marked = labels.select(F.col("doc_id").alias("_id"), *(c.cast("int").alias(f"y{k}") for k, c in enumerate(categories.values()))).dropna()
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    ys = [f"y{k}" for k in range(len(names))]
    agreed = marked.groupBy("_id").agg(*(F.min(y).alias(y) for y in ys), *(F.max(y).alias(f"_{y}") for y in ys))
    for y in ys:
        agreed = agreed.filter(F.col(y) == F.col(f"_{y}"))
    chosen = cut_lineage(sample_of(agreed.select(F.col("_id").alias("doc_id"), *ys), rows))
    found = texts.filter(F.col("text").isNotNull()).join(chosen.select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi")
    known = found.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).join(chosen.hint("shuffle_hash"), "doc_id")
    train = cut_lineage(known.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(folds)).cast("int")).repartition(8 * folds, "doc_id").drop("doc_id"))
    chosen_terms = choose(train, len(names))
    terms = sorted({t for ts in chosen_terms for t in ts})
    if train.isEmpty():
        weights = [np.concatenate((np.zeros(len(terms) + k), [-35.0])) for k in range(len(names))]
    else:
        weights, _ = train_chain(train, terms, chosen_terms, folds)
    kind = texts.schema["doc_id"].dataType.simpleString()
    scored = texts.mapInArrow(_scored(tuple(terms), weights, names), f"doc_id {kind}" + "".join(f", `p_{c}` double" for c in names))
    return scored.withColumn(names[-1], F.col(f"p_{names[-1]}") >= 0.5)
