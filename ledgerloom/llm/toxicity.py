"""Toxicity by a classifier chain: linear models in a fixed order, each fed the probabilities of those before it.

Categories are label columns. A model's features are the presence of selected words and the probabilities of earlier categories.
While training, earlier probabilities are out-of-fold: the model that made them never saw the document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, frames, materialise, small_batches


@dataclass
class Link:
    """One category: word hashes (sorted) with their weights, weights of earlier probabilities, and the intercept."""

    name: str
    words: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    intercept: float


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.3, steps: int = 25) -> np.ndarray:
    """Weights (the last is the intercept) of a regularised logistic regression, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    w, eye = np.zeros(x.shape[1]), np.eye(x.shape[1]) * l2
    eye[-1, -1] = 1e-6
    for _ in range(steps):
        p = _sigmoid(x @ w)
        gradient = x.T @ (p - y) + eye @ w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + eye, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def select_words(docs: list[np.ndarray], y: np.ndarray, count: int) -> np.ndarray:
    """The hashes of the count words whose presence tells most about y (chi-square), sorted."""
    if not docs or not sum(map(len, docs)):
        return np.zeros(0, np.uint64)
    words, inverse = np.unique(np.concatenate(docs), return_inverse=True)
    of = np.repeat(y, [len(d) for d in docs])
    seen, positive = np.bincount(inverse, minlength=len(words)), np.bincount(inverse, weights=of, minlength=len(words))
    n, p = len(docs), max(1e-9, min(1 - 1e-9, float(y.mean())))
    score = (positive - seen * p) ** 2 / (seen * p * (1 - p) * (1 - seen / (n + 1)))
    score[seen < 3] = 0
    return np.sort(words[np.argsort(-score, kind="stable")[:count]])


def _presence(docs: list[np.ndarray], words: np.ndarray) -> np.ndarray:
    x = np.zeros((len(docs), len(words)), np.float32)
    for i, d in enumerate(docs):
        if len(d) and len(words):
            at = np.minimum(np.searchsorted(words, d), len(words) - 1)
            x[i, at[words[at] == d]] = 1
    return x


def fit_chain(docs: list[np.ndarray], labels: dict[str, np.ndarray], folds: np.ndarray, n_folds: int, count: int = 256) -> list[Link]:
    """docs: distinct word hashes of each document. labels: 0/1 for each category, in chain order. folds: of each document."""
    earlier, links = np.zeros((len(docs), 0)), []
    for name, y in labels.items():
        y = y.astype(np.float64)
        words = select_words(docs, y, count)
        x = np.hstack([_presence(docs, words), earlier])
        w = fit_logistic(x, y)
        links.append(Link(name, words, w[: len(words)], w[len(words) : -1], float(w[-1])))
        out = np.full(len(docs), y.mean())
        for fold in range(n_folds):
            train, test = folds != fold, folds == fold
            if train.any() and test.any():
                kept = [d for d, t in zip(docs, train, strict=True) if t]
                own = select_words(kept, y[train], count)  # words are chosen without the fold too
                v = fit_logistic(np.hstack([_presence(kept, own), earlier[train]]), y[train])
                out[test] = _sigmoid(np.hstack([_presence([d for d, t in zip(docs, test, strict=True) if t], own), earlier[test]]) @ v[:-1] + v[-1])
        earlier = np.hstack([earlier, out[:, None]])
    return links


def distinct_words(words: Words) -> Iterator[np.ndarray]:
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        yield np.unique(words.hashes[a:b])


def train_chain(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = ("quality", "toxic"), sample_docs: int = 10_000, sample_words: int = 4_000_000, n_folds: int = 5) -> list[Link]:
    """A chain fitted on at most sample_docs labelled documents, those whose identifiers hash lowest, with sample_words words in all.

    Words are counted once in each document; a document that would go over sample_words is left out with those after it, so what
    reaches the driver, hashed words, is bounded whatever the texts' lengths. Rows with a null label, text or identifier are left out; a
    document that is labelled twice counts with its least labels, one of several rows with its first. Without any labelled document
    the chain calls nothing toxic. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    wanted = labels.select("doc_id", *categories).dropna().groupBy("doc_id").agg(*(F.min(c).cast("int").alias(c) for c in categories))
    wanted = wanted.withColumn("order", F.xxhash64(F.lit(3), "doc_id")).orderBy("order", "doc_id").limit(sample_docs)
    sample = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(wanted), "doc_id")

    def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in frames(batches):
            words = Words(list(batch["text"]), "ascii_alnum")
            yield batch[["order", *categories]].assign(words=[d.tobytes() for d in distinct_words(words)])

    features = sample.select("order", *categories, "text").mapInPandas(featurise, f"order long, {', '.join(f'{c} int' for c in categories)}, words binary")
    features = materialise(features, "toxicity-sample")
    sizes = features.select("order", (F.length("words") / 8).cast("long").alias("n")).orderBy("order", "n").toPandas()  # sample_docs rows or few more
    kept = sizes[sizes["n"].cumsum() <= sample_words]["order"]
    rows = features.where(F.col("order") <= int(kept.max())).toPandas() if len(kept) else features.limit(0).toPandas()
    rows = rows.sort_values("order", kind="stable").drop_duplicates("order")
    if rows.empty:
        return [Link(c, np.zeros(0, np.uint64), np.zeros(0), np.zeros(i), -30.0) for i, c in enumerate(categories)]
    found = [np.frombuffer(w, np.uint64) for w in rows["words"]]
    return fit_chain(found, {c: rows[c].to_numpy() for c in categories}, np.arange(len(rows)) % n_folds, n_folds)


def score_toxicity(docs: DataFrame, chain: list[Link], threshold: float = 0.3) -> DataFrame:
    """doc_id, a probability prob_<category> for each link, and toxic (that of the last link is at least threshold).

    Whole texts are scored. Null and empty texts, having no words, get the intercepts' probability and are never toxic. Repeated rows
    give repeated results, an empty table an empty result; other columns are dropped.
    """
    small_batches(docs.sparkSession)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in frames(batches):
            words = Words(list(batch["text"]), "ascii_alnum")
            own = list(distinct_words(words))
            of = np.repeat(np.arange(len(own)), [len(d) for d in own])
            flat = np.concatenate([*own, np.zeros(0, np.uint64)])
            earlier, out = np.zeros((len(own), 0)), {"doc_id": batch["doc_id"]}
            for link in chain:
                z = np.full(len(own), link.intercept) + earlier @ link.earlier
                if len(link.words) and len(flat):
                    at = np.minimum(np.searchsorted(link.words, flat), len(link.words) - 1)
                    z += np.bincount(of, weights=np.where(link.words[at] == flat, link.weights[at], 0.0), minlength=len(own))
                p = _sigmoid(z)
                out[f"prob_{link.name}"] = p
                earlier = np.hstack([earlier, p[:, None]])
            out["toxic"] = (p >= threshold) & np.array([len(d) > 0 for d in own], dtype=bool)
            yield pd.DataFrame(out)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    columns = "".join(f"prob_{link.name} double, " for link in chain)
    return docs.select("doc_id", "text").mapInPandas(score, f"doc_id {id_type}, {columns}toxic boolean")
