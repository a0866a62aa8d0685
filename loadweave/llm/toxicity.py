"""Toxicity by a factorization machine over hashed terms.

A text's terms are its lower-cased words and their first four and five
characters, hashed into 2**18 buckets and counted once per document. The
buckets that differ most between the classes of the sample (likelihood ratio,
at most `features` of those beyond what chance gives the best of all buckets)
get a linear weight and a vector; the score is the logistic of

    w0 + sum w_i + sum over pairs <v_i, v_j>

so that two terms can say more together than apart. The model is fitted on at
most `sample_rows` labelled documents, those with the smallest hash of their
id, and is of fixed size; every document is scored, over its whole text.

Null and empty texts have no term and get the score of the bias alone. Without
examples of both classes every score is the share of toxic examples (0 if there
is none). Repeated rows are scored alike. Labels that are null are ignored; of
several labels of one document the largest counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

BUCKETS = 1 << 18
_WORD = re.compile(r"\w+")
_CACHE_WORDS = 300_000
MIN_STEPS = 2000  # of the fit, however small the sample


def word_buckets(word: str) -> tuple[int, ...]:
    terms = {word} | {f"^{word[:n]}" for n in (4, 5) if len(word) > n}
    return tuple(xxhash.xxh32_intdigest(t.encode()) & (BUCKETS - 1) for t in terms)


class Terms:
    """Buckets of a text, optionally mapped to feature numbers; words are cached up to a limit."""

    def __init__(self, feature_of: np.ndarray | None = None):
        self.feature_of, self.cache = feature_of, {}

    def _of(self, word: str) -> tuple[int, ...]:
        got = word_buckets(word)
        if self.feature_of is not None:
            got = tuple(int(f) for f in self.feature_of[list(got)] if f >= 0)
        if len(self.cache) >= _CACHE_WORDS:
            self.cache.clear()
        self.cache[word] = got
        return got

    def __call__(self, text: str | None) -> list[int]:
        found: set[int] = set()
        for word in set(_WORD.findall((text or "").lower())):
            got = self.cache.get(word)
            found.update(self._of(word) if got is None else got)
        return sorted(found)


@dataclass
class Machine:
    """A fitted model: feature number per bucket (-1: none), bias, linear weights, vectors."""

    feature_of: np.ndarray
    bias: float
    linear: np.ndarray
    vectors: np.ndarray

    def score(self, active: list[list[int]]) -> np.ndarray:
        flat = np.array([f for row in active for f in row], dtype=np.int64)
        row = np.repeat(np.arange(len(active)), [len(r) for r in active])
        z = np.full(len(active), self.bias)
        np.add.at(z, row, self.linear[flat])
        sums, squares = np.zeros((len(active), self.vectors.shape[1])), np.zeros(len(active))
        np.add.at(sums, row, self.vectors[flat])
        np.add.at(squares, row, (self.vectors[flat] ** 2).sum(1))
        z += 0.5 * ((sums**2).sum(1) - squares)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model may learn from; a row without an id is none of them."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def examples(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """(text, toxic) of the sampled learning rows."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("_toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    # at most sample_rows pairs of numbers
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", F.col("_toxic").alias("toxic"))


def _term_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    terms, counts = Terms(), np.zeros((2, BUCKETS), dtype=np.int64)
    for pdf in batches:
        for text, toxic in zip(pdf["text"], pdf["toxic"]):
            counts[int(toxic > 0), terms(text)] += 1
    seen = np.flatnonzero(counts.sum(0))
    yield pd.DataFrame({"bucket": seen, "clean": counts[0, seen], "toxic": counts[1, seen]})


def _likelihood_ratio(n_clean: int, n_toxic: int) -> Column:
    """G statistic of a term against the classes; unlike chi square it stays small for rare terms."""
    share = n_toxic / (n_clean + n_toxic)
    df = F.col("toxic") + F.col("clean")

    def part(seen: Column, documents: Column, rate: float) -> Column:
        return F.when(seen > 0, seen * F.log(seen / (documents * rate))).otherwise(0.0)

    absent = F.lit(n_clean + n_toxic) - df
    return 2 * (
        part(F.col("toxic"), df, share) + part(F.col("clean"), df, 1 - share)
        + part(n_toxic - F.col("toxic"), absent, share) + part(n_clean - F.col("clean"), absent, 1 - share)
    )


def _active(feature_of: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = Terms(feature_of)
        for pdf in batches:
            yield pd.DataFrame({"active": [terms(t) for t in pdf["text"]], "toxic": pdf["toxic"]})

    return run


def train(
    docs: DataFrame, labels: DataFrame, sample_rows: int = 16_384, features: int = 1024, factors: int = 8,
    epochs: int = 30, step: float = 0.1, shrink: float = 1e-4, seed: int = 7,
) -> Machine:
    """Fit on at most `sample_rows` documents; the driver sees those rows' feature numbers only."""
    sample = examples(docs, labels, sample_rows).cache()
    try:
        n_clean, n_toxic = (int(x or 0) for x in sample.agg(F.sum((F.col("toxic") <= 0).cast("int")), F.sum((F.col("toxic") > 0).cast("int"))).first())
        none = Machine(np.full(BUCKETS, -1, dtype=np.int32), 0.0, np.zeros(1), np.zeros((1, factors)))
        if not n_clean or not n_toxic:
            none.bias = 30.0 if n_toxic else -30.0
            return none
        counts = sample.mapInPandas(_term_counts, "bucket long, clean long, toxic long").groupBy("bucket").agg(
            F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        counts = counts.cache()  # at most BUCKETS rows
        chance = 2 * np.log(max(2, counts.count()))  # about what the best of so many unrelated terms reaches
        gains = [
            (r.gain, r.bucket) for r in counts.withColumn("gain", _likelihood_ratio(n_clean, n_toxic))
            .orderBy(F.col("gain").desc(), "bucket").limit(features).collect()
        ]
        counts.unpersist()
        best = [bucket for gain, bucket in gains if gain >= chance]
        feature_of = none.feature_of.copy()
        feature_of[best] = np.arange(len(best))
        rows = sample.mapInPandas(_active(feature_of), "active array<long>, toxic long").toPandas()
    finally:
        sample.unpersist()
    order = np.argsort([f"{len(a)}:{list(a)}:{t}" for a, t in zip(rows["active"], rows["toxic"])], kind="stable")
    return fit(feature_of, [list(rows["active"].iloc[k]) for k in order], rows["toxic"].to_numpy()[order] > 0,
               max(1, len(best)), factors, epochs, step, shrink, seed)


def fit(feature_of, active, toxic, features, factors, epochs, step, shrink, seed) -> Machine:
    """Mini-batch AdaGrad on the logistic loss."""
    rng = np.random.default_rng(seed)
    w0 = float(np.log((toxic.sum() + 1) / ((~toxic).sum() + 1)))
    w, v = np.zeros(features), rng.normal(0, 0.02, (features, factors))
    g0, gw, gv = 1e-6, np.full(features, 1e-6), np.full((features, factors), 1e-6)
    batches = max(1, len(active) // 128)
    for _ in range(max(epochs, MIN_STEPS // batches)):
        for part in np.array_split(rng.permutation(len(active)), batches):
            x = np.zeros((len(part), features))
            for k, row in enumerate(part):
                x[k, active[row]] = 1
            sums = x @ v
            z = w0 + x @ w + 0.5 * ((sums**2).sum(1) - (x @ v**2).sum(1))
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic[part]) / len(part)
            d0, dw = error.sum(), x.T @ error + shrink * w
            dv = x.T @ (error[:, None] * sums) - v * (x.T @ error)[:, None] + shrink * v
            g0, gw, gv = g0 + d0**2, gw + dw**2, gv + dv**2
            w0 -= step * d0 / g0**0.5
            w -= step * dw / np.sqrt(gw)
            v -= step * dv / np.sqrt(gv)
    return Machine(feature_of, w0, w, v)


def scored(docs: DataFrame, machine: Machine, text: str = "text", column: str = "score") -> DataFrame:
    """All columns of `docs` and the score; a column of that name is replaced."""
    kept = docs.drop(column)
    schema = T.StructType([*kept.schema.fields, T.StructField(column, T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = Terms(machine.feature_of)
        for pdf in batches:
            yield pdf.assign(**{column: machine.score([terms(t) for t in pdf[text]])})

    return kept.mapInPandas(run, schema)
