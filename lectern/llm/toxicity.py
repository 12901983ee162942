"""Toxicity by weak supervision: many voters, a generative model of them, and a linear classifier on its posterior labels.

1. A lexicon is mined from labelled documents that aren't held out: words and word heads that stand far more often in documents
   marked toxic. Aggregation runs on Spark; the terms come to the driver, whose number the training rows bound.
2. Voters look at a text and say toxic, clean or nothing: shards of the lexicon by kind and strength, patterns (several hits,
   density, shouting, clean at length). Verdicts that the training labels contradict often are left out; the labels cast no vote.
3. A generative model (expectation maximisation over votes that are independent given the class) estimates each voter's
   accuracy. Voters that go together beyond that, by their residual correlations, share their weight.
4. A logistic regression on hit counts is trained on the posterior labels. It alone scores documents, where they lie.

At most ``MOST_TRAINING`` labelled documents, the first by hash of their ids, are used in 1 to 4. A score looks at the text alone.

Defined cases: null and empty texts have no hit and score as such; null labels and documents without one don't train; a null id
is held out; repeated rows score alike; with no label or one class only the score is the class's share; an empty table gives an
empty result; texts of any length are read whole; other columns are left alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .quality import scored, training_rows, training_table
from .sketch import shingle_hashes

MOST_TRAINING = 12_000
#: Terms of the lexicon stand in at least so many toxic documents, so many times as often in them as in others, and surprise by
#: at least so much (twice the log likelihood ratio against standing anywhere alike).
LEAST_DOCUMENTS, LEAST_LIFT, LEAST_SURPRISE = 4, 10.0, 24.0
#: Lengths of word heads, and lexicon shards for each length (0: whole words).
HEADS, SHARDS = (3, 4, 5, 6, 7), 4
NONE = -1

_WORD = re.compile(r"[^\W_]+")


def mine(rows: DataFrame) -> dict[tuple[int, str], float]:
    """(head length or 0, term) -> log lift, from training rows (text, label).

    Of rows that share their least shingle hash, as copies and near copies do, one of each label counts: else whatever words one
    toxic document holds would pass for toxic ones once it has been copied a few times.
    """
    rows = rows.withColumn("group", F.array_min(shingle_hashes(F.coalesce("text", F.lit(""))))).dropDuplicates(["group", "label"])
    words = F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+"))
    kinds = [F.transform(words, _tagged(0))]
    kinds += [F.transform(F.array_distinct(F.transform(F.filter(words, _longer(k)), _head(k))), _tagged(k)) for k in HEADS]
    terms = rows.select("label", F.explode(F.concat(*kinds)).alias("term")).where("term.w != ''")
    counts = terms.groupBy("term").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean")).where(F.col("toxic") >= LEAST_DOCUMENTS)
    total = rows.agg(F.coalesce(F.sum("label"), F.lit(0)).alias("n1"), F.coalesce(F.sum(1 - F.col("label")), F.lit(0)).alias("n0"))
    lift = F.log(((F.col("toxic") + 0.1) / (F.col("n1") + 1)) / ((F.col("clean") + 0.1) / (F.col("n0") + 1)))
    both, alike = F.col("toxic") + F.col("clean"), F.col("n1") / (F.col("n1") + F.col("n0"))
    surprise = 2 * (F.col("toxic") * F.log(F.col("toxic") / both / alike) + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / both / (1 - alike))).otherwise(0))
    best = counts.crossJoin(F.broadcast(total)).withColumn("lift", lift).withColumn("surprise", surprise)
    best = best.where((F.col("lift") >= float(np.log(LEAST_LIFT))) & (F.col("surprise") >= LEAST_SURPRISE))
    best = best.select("term.k", "term.w", "lift")
    return {(r.k, r.w): r.lift for r in best.collect()}


def _tagged(k: int) -> Callable[[Column], Column]:
    return lambda w: F.struct(F.lit(k).alias("k"), w.alias("w"))


def _longer(k: int) -> Callable[[Column], Column]:
    return lambda w: F.length(w) > k


def _head(k: int) -> Callable[[Column], Column]:
    return lambda w: F.substring(w, 1, k)


@dataclass(frozen=True)
class Lexicon:
    """Shards of terms: one table of term -> shard for each kind of term."""

    shards: tuple[dict[str, int], ...]

    @property
    def width(self) -> int:
        return len(self.shards) * SHARDS + 5

    @staticmethod
    def of(lifts: dict[tuple[int, str], float]) -> Lexicon:
        """Shards of a kind hold terms of like strength."""
        tables = []
        for i, k in enumerate((0, *HEADS)):
            terms = sorted((t for t in lifts if t[0] == k), key=lambda t: (-lifts[t], t[1]))
            tables.append({w: i * SHARDS + SHARDS * at // len(terms) for at, (_, w) in enumerate(terms)})
        return Lexicon(tuple(tables))

    def describe(self, texts: list[str | None]) -> np.ndarray:
        """Distinct words that hit, by shard; words; words that hit; share of characters in upper case; exclamation marks; distinct hits."""
        out = np.zeros((len(texts), self.width))
        for row, text in zip(out, texts, strict=True):
            words = _WORD.findall((text or "").lower())
            hits, distinct = 0, 0
            for word, n in Counter(words).items():
                found = [s[w] for s, w in zip(self.shards, (word, *[word[:k] if len(word) > k else None for k in HEADS]), strict=True) if w in s]
                if found:
                    row[found] += 1
                    hits, distinct = hits + n, distinct + 1
            upper = sum(map(str.isupper, text or ""))
            row[-5:] = len(words), hits, upper / max(1, len(text or "")), (text or "").count("!"), distinct
        return out


def votes_of(x: np.ndarray) -> np.ndarray:
    """(documents, voters) of 1 toxic, 0 clean, ``NONE`` no vote."""
    shards, (words, hits, upper, shouts, distinct) = x[:, :-5], x[:, -5:].T
    dense = hits / np.maximum(words, 1)
    voters = [
        *np.where(shards > 0, 1, NONE).T,
        np.where(hits >= 2, 1, NONE),
        np.where(distinct >= 2, 1, NONE),
        np.where(dense > 0.005, 1, np.where(words > 20, 0, NONE)),
        np.where(hits == 0, 0, NONE),
        np.where((hits == 0) & (words > 50), 0, NONE),
        np.where(upper > 0.5, 1, NONE),
        np.where(shouts > 3, 1, NONE),
    ]
    return np.stack(voters, 1).astype(np.int64)


def kept_voters(votes: np.ndarray, y: np.ndarray, least: float = 0.8) -> np.ndarray:
    """Votes without the verdicts that the labels of the training rows contradict more often than ``1 - least``: this is all that the
    labels tell the label model, and says which class is which."""
    right = [((votes == v) & (y == v)[:, None]).sum(0) >= least * (votes == v).sum(0) for v in (0, 1)]
    return np.where(((votes == 0) & right[0]) | ((votes == 1) & right[1]), votes, NONE)


def label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 30, together: float = 0.4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of class 1 for each row, each voter's accuracy, and the voters' correlations beyond the class.

    ``start`` is a first guess of the posteriors, which says which class is 1. Between rounds, voters whose residuals correlate by
    more than ``together`` form groups; a group's voters each count by one over its effective size.
    """
    n, m = votes.shape
    seen = np.stack([votes == v for v in (NONE, 0, 1)], 2).astype(float)  # rows, voters, outcomes
    posterior, weight, correlations = start.clip(0.02, 0.98), np.ones(m), np.eye(m)
    table = np.zeros((2, m, 3))
    for step in range(rounds):
        for y, p in enumerate((1 - posterior, posterior)):
            table[y] = (np.einsum("i,ijk->jk", p, seen) + 1) / (p.sum() + 3)
        prior = (posterior.sum() + 1) / (n + 2)
        odds = np.einsum("ijk,jk->ij", seen, np.log(table[1]) - np.log(table[0])) @ weight + np.log(prior / (1 - prior))
        posterior = 1 / (1 + np.exp(-odds.clip(-30, 30)))
        if step in (5, 15) and n:
            cast = np.where(votes == 1, 1.0, np.where(votes == 0, -1.0, 0.0))
            mean = np.stack([table[y, :, 2] - table[y, :, 1] for y in (0, 1)])
            rest = cast - (1 - posterior)[:, None] * mean[0] - posterior[:, None] * mean[1]
            spread = np.sqrt((rest**2).mean(0)) + 1e-9
            correlations = (rest.T @ rest) / n / np.outer(spread, spread)
            near = np.clip(np.where(np.abs(correlations) > together, np.abs(correlations), 0), 0, 1)
            np.fill_diagonal(near, 1)
            weight = 1 / near.sum(0)
    accuracy = (table[1, :, 2] * prior + table[0, :, 1] * (1 - prior)) / np.maximum(1 - table[0, :, 0] * (1 - prior) - table[1, :, 0] * prior, 1e-9)
    return posterior, accuracy, correlations


def features_of(x: np.ndarray) -> np.ndarray:
    """What the linear classifier sees: hits by shard and in all, in logs and by length, and whether there is any."""
    words, hits, upper, shouts, distinct = x[:, -5:].T
    rates = hits / np.maximum(words, 1)
    more = [np.log1p(hits), np.log1p(distinct), hits > 0, hits > 1, np.minimum(rates * 50, 3), np.log1p(words) / 10, upper, np.log1p(shouts) / 5]
    return np.concatenate((np.log1p(x[:, :-5]), np.stack(more, 1).astype(float)), 1)


@dataclass(frozen=True)
class Linear:
    weights: np.ndarray
    bias: float

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(features @ self.weights + self.bias).clip(-30, 30)))


def train_linear(features: np.ndarray, soft: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> Linear:
    """Logistic regression on soft labels by Newton's method; the bias isn't penalised."""
    x = np.concatenate((features, np.ones((len(features), 1))), 1)
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ w).clip(-30, 30)))
        slope = x.T @ (p - soft) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), slope)
        w -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
    return Linear(w[:-1], float(w[-1]))


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    linear: Linear

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return self.linear.scores(features_of(self.lexicon.describe(texts)))


def fit_table(x: np.ndarray, y: np.ndarray) -> Linear:
    """The linear classifier from described training rows and their labels."""
    if not len(x) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return Linear(np.zeros(features_of(x).shape[1]), float(np.log(share / (1 - share))))
    votes = kept_voters(votes_of(x), y)
    start = ((votes == 1).sum(1) + 0.5) / ((votes != NONE).sum(1) + 1)
    posterior, _, _ = label_model(votes, start)
    return train_linear(features_of(x), posterior)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", most: int = MOST_TRAINING) -> Model:
    rows = materialise(training_rows(docs, labels, label, id_col, text_col, most), "toxicity-training")  # at most ``most``, read thrice
    lexicon = Lexicon.of(mine(rows))
    return Model(lexicon, fit_table(*training_table(rows, lexicon.describe, lexicon.width, most)))


def without_toxic(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, that aren't predicted toxic. Nothing is shuffled but the training rows."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(texts.tolist()))

    return docs.where(score(F.col(text_col).cast("string")) < threshold)


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    return scored(docs, model.scores, id_col=id_col, text_col=text_col, threshold=threshold)
