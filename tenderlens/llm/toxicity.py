"""Toxicity classifier with counterfactual regularisation.

A logistic model over the presence of words and word beginnings. Besides the usual loss it pays
for every change of score between a labelled sentence and the same sentence with its identity terms
swapped for other terms of their kind, so that a neutral mention of a group does not move the score.

Learning uses at most ``max_train_rows`` labelled rows (those with the smallest hash of their id); the
choice of words is counted by Spark, and only the chosen words of those rows reach the driver.
Scoring reads every whole text where it lies, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlens.llm.registry import query, table, text_or_empty

MAX_TRAIN_ROWS = 20_000
MAX_FEATURES = 4_000
MAX_PAIRS = 20_000
MAX_SEEN = 250_000              # words a scorer remembers
# Identity terms by kind; a swap takes the next one of the same kind.
IDENTITY_TERMS = (
    ("women", "men", "nonbinary"), ("woman", "man"), ("girls", "boys"), ("female", "male"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus"),
    ("black", "white", "asian", "latino"), ("gay", "straight", "lesbian", "bisexual"),
    ("immigrant", "native"), ("immigrants", "natives"), ("old", "young"), ("disabled", "abled"),
    ("african", "european", "american", "mexican", "chinese", "indian", "arab"),
)
_EDGE = re.compile(r"^\W+|\W+$")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_PREFIXES = (4, 5)


def word_features(token: str) -> tuple[str, ...]:
    """A token's features: the bare lower-case word and, for longer words, how it begins."""
    word = _EDGE.sub("", token).lower()
    if not word:
        return ()
    return (word, *(f"{word[:k]}~" for k in _PREFIXES if len(word) > k))


def text_features(text: str) -> set[str]:
    return {f for token in set(text.split()) for f in word_features(token)}


def swapped(sentence: str, terms=IDENTITY_TERMS) -> str | None:
    """The sentence with each identity term replaced by the next of its kind, None without any."""
    following = {t: kind[(i + 1) % len(kind)] for kind in terms for i, t in enumerate(kind)}
    hits = 0

    def change(match):
        nonlocal hits
        other = following.get(match[0].lower())
        hits += other is not None
        return match[0] if other is None else other

    out = re.sub(r"\w+", change, sentence)
    return out if hits else None


class Scorer:
    """Scores texts by the weights of the features they hold; words seen before are looked up."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias, self.seen = weights, bias, {}

    def score(self, texts: Iterable[str]) -> np.ndarray:
        seen, weights = self.seen, self.weights
        out = []
        for text in texts:
            found = set()
            for token in set(text.split()):
                hit = seen.get(token)
                if hit is None:
                    if len(seen) >= MAX_SEEN:
                        seen.clear()
                    hit = seen[token] = tuple(f for f in word_features(token) if f in weights)
                if hit:
                    found.update(hit)
            out.append(self.bias + sum(weights[f] for f in sorted(found)))
        return 1.0 / (1.0 + np.exp(-np.clip(np.array(out, float), -30, 30)))


def fit_weights(rows: list[np.ndarray], labels: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]],
                features: int, penalty: float = 10.0, decay: float = 1e-3, steps: int = 400) -> tuple[np.ndarray, float]:
    """Minimise log loss + decay * |w|^2 + penalty * mean (score - swapped score)^2 by gradient steps."""
    def packed(sets):
        lengths = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate([*sets, np.empty(0, np.int64)]).astype(np.int64)
        return flat, np.repeat(np.arange(len(sets)), lengths), len(sets)

    def logits(pack, w, b):
        flat, owner, n = pack
        return b + np.bincount(owner, w[flat], minlength=n)

    def back(pack, g):
        return np.bincount(pack[0], g[pack[1]], minlength=features)

    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    data, left, right = packed(rows), packed([a for a, _ in pairs]), packed([b for _, b in pairs])
    w, b = np.zeros(features), 0.0
    slope, square = np.zeros(features + 1), np.zeros(features + 1)
    for step in range(1, steps + 1):
        error = (sigmoid(logits(data, w, b)) - labels) / max(1, len(labels))
        grad = np.append(back(data, error) + 2 * decay * w / max(1, features), error.sum())
        if pairs:
            p, q = sigmoid(logits(left, w, b)), sigmoid(logits(right, w, b))
            gap = 2 * penalty * (p - q) / len(pairs)
            gp, gq = gap * p * (1 - p), -gap * q * (1 - q)
            grad += np.append(back(left, gp) + back(right, gq), gp.sum() + gq.sum())
        slope = 0.9 * slope + 0.1 * grad
        square = 0.99 * square + 0.01 * grad ** 2
        move = 0.1 * (slope / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def learn(labelled: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS, max_features: int = MAX_FEATURES,
          penalty: float = 10.0, terms=IDENTITY_TERMS) -> tuple[dict[str, float], float]:
    """Weights from rows (doc_id, text, label). Without both labels the model is the base rate."""
    sample = labelled.orderBy(F.crc32(F.col("doc_id").cast("string")), "doc_id").limit(max_train_rows)
    identity = sorted({t for kind in terms for t in kind})

    def count(batches):
        totals: dict[str, list[int]] = {}
        for frame in batches:
            for text, label in zip(frame["text"], frame["label"]):
                for f in text_features(text):
                    totals.setdefault(f, [0, 0])[label] += 1
        yield pd.DataFrame([(f, n[0], n[1]) for f, n in totals.items()], columns=["f", "n0", "n1"])

    fixed = sample.repartition("doc_id").persist()
    try:
        sizes = {r["label"]: r["n"] for r in fixed.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
        if not n0 or not n1:
            share = (n1 + 0.5) / (n0 + n1 + 1.0)
            return {}, float(np.log(share / (1 - share)))
        counts = fixed.mapInPandas(count, "f string, n0 long, n1 long").groupBy("f").agg(
            F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).filter(F.col("n0") + F.col("n1") >= 3)
        chosen = counts.select("f", _surprise("n0", "n1", n0, n1).alias("g")).filter("g > 10").orderBy(
            F.desc("g"), "f").limit(max_features).collect()
        index = {f: i for i, f in enumerate(sorted({r["f"] for r in chosen} | set(identity)))}

        def find(batches):
            at = lambda text: sorted(index[f] for f in text_features(text) if f in index)
            for frame in batches:
                out = []
                for doc, text, label in zip(frame["doc_id"], frame["text"], frame["label"]):
                    out.append((doc, label, at(text), None))
                    for sentence in _SENTENCE.split(text):
                        other = swapped(sentence, terms)
                        if other is not None:
                            out.append((doc, label, at(sentence), at(other)))
                yield pd.DataFrame(out, columns=["doc_id", "label", "x", "y"])

        found = fixed.mapInPandas(find, "doc_id long, label int, x array<int>, y array<int>").persist()
        rows = found.filter("y IS NULL").orderBy("doc_id").collect()
        pairs = found.filter("y IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id", "x"), "doc_id", "x", "y").limit(MAX_PAIRS).collect()
        found.unpersist()
    finally:
        fixed.unpersist()
    w, b = fit_weights([np.array(r["x"], np.int64) for r in rows], np.array([r["label"] for r in rows], float),
                       [(np.array(p["x"], np.int64), np.array(p["y"], np.int64)) for p in pairs], len(index), penalty)
    return {f: float(w[i]) for f, i in index.items() if abs(w[i]) > 1e-6}, float(b)


def _surprise(n0: str, n1: str, all0: int, all1: int) -> Column:
    """Log-likelihood ratio of a feature that is more frequent under label 1, else 0."""
    a, b = F.col(n1).cast("double"), F.col(n0).cast("double")
    rate = (a + b) / (all0 + all1)
    part = lambda k, n, p: F.when(k > 0, k * F.log(k / (n * p))).otherwise(0.0)
    gain = 2 * (part(a, all1, rate) + part(b, all0, rate)
                + part(all1 - a, all1, 1 - rate) + part(all0 - b, all0, 1 - rate))
    return F.when(a / all1 > b / all0, gain).otherwise(0.0)


def score_column(spark: SparkSession, weights: dict[str, float], bias: float, text: Column) -> Column:
    """Score of every text; null and empty texts get the score of no feature."""
    shared = spark.sparkContext.broadcast((weights, bias))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(*shared.value)
        for texts in batches:
            yield pd.Series(scorer.score(texts))

    return score(F.coalesce(text, F.lit("")))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Labelled rows that are not held out. A document labelled twice counts as toxic if any label says so."""
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(
        "doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label"))
    order = F.crc32(F.col("doc_id").cast("string"))
    marks = marks.orderBy(order, "doc_id").limit(MAX_TRAIN_ROWS)
    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    # At most MAX_TRAIN_ROWS pairs of numbers, so they can be broadcast and the texts stay where they are.
    return texts.join(F.broadcast(marks), "doc_id")


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    threshold: float = 0.3, **options) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Learns from the labelled rows whose id is not held out. Null ids are scored like any other row and
    never held out; repeated rows get equal scores; without labels every score is the same.
    """
    weights, bias = learn(training_rows(docs, labels, id_col, text_col), **options)
    score = score_column(docs.sparkSession, weights, bias, F.col(text_col))
    scored = docs.select(F.col(id_col).alias("doc_id"), score.alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               threshold: float = 0.3, **options) -> DataFrame:
    """The rows below the threshold, with their own columns; nothing is shuffled."""
    weights, bias = learn(training_rows(docs, labels, id_col, text_col), **options)
    return docs.filter(score_column(docs.sparkSession, weights, bias, F.col(text_col)) < threshold)


@query("op5_toxicity")
def op5_toxicity(spark, sf_dir):
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
