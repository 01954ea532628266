"""Document quality from a linear-chain conditional random field over lines.

Every line has two labels, bad and good.  A line's features describe its own characters and words
and those of its neighbours; transition weights tie adjacent labels.  Training takes every line's
label from its document's.  Forward-backward gives each line its marginal of being good, and the
mean of these, weighted by line length, is the document's score.

The fit uses at most ``SAMPLE`` labelled documents, those with the smallest hash of their id;
scoring reads all of every text.  Training and scoring run the recursions over many documents at
once, position by position.

Defined cases: null and empty texts count as one empty line and get a score; labels that are null
or whose document is missing are ignored; repeated rows get equal scores; without any label
(empty tables) every score is 0.5; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import crc_mod

SAMPLE, FOLDS, THRESHOLD = 4000, 5, 0.3
ROUNDS, RATE, RIDGE = 250, 0.2, 1e-5

#: Byte classes: lower, upper, digit, space, sentence punctuation, other ASCII, beyond ASCII.
_CLASS = np.full(256, 5, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[[ord(x) for x in ".,;:?'\"()-"]] = 4
_CLASS[128:] = 6
OWN = 20


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines x OWN features, line weights) of a text."""
    data = (text or "").encode("utf-8", "replace")
    lines = data.split(b"\n")
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    out = np.zeros((len(lines), OWN))
    begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    full = np.flatnonzero(size)
    if len(full):
        kinds = _CLASS[np.frombuffer(data, np.uint8)]
        edge = np.append(begin[full], len(data))
        for c in range(7):
            before = np.concatenate([[0], np.cumsum(kinds == c, dtype=np.int64)])
            n = before[edge[:-1] + size[full]] - before[edge[:-1]]
            out[full, c] = n / size[full]
    seen: dict[bytes, int] = {}
    for i, line in enumerate(lines):
        words = line.split()
        n = len(words)
        if n:
            distinct = len(set(words))
            out[i, 7] = distinct / n
            out[i, 8] = n > 5 and distinct * 2 < n
            out[i, 9] = min(size[i] / n / 20, 2)
            out[i, 10] = np.log1p(n) / 6
            out[i, 11] = line in seen
        seen[line] = i
    out[:, 12] = size == 0
    out[:, 13] = out[:, 5] > 0.02
    out[:, 14] = out[:, 5] > 0.1
    out[:, 15] = out[:, 1] > 0.3
    out[:, 16] = out[:, 2] > 0.2
    out[:, 17] = out[:, 4] > 0.15
    out[:, 18] = len(seen) / len(lines)
    out[:, 19] = len(lines) == 1
    return out, size + 1.0


def with_neighbours(x: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after, and a constant."""
    edge = np.zeros((1, x.shape[1]))
    return np.hstack([x, np.vstack([edge, x[:-1]]), np.vstack([x[1:], edge]), np.ones((len(x), 1))])


class Chains:
    """Documents as chains of lines, laid out so that a step covers one position of all of them."""

    def __init__(self, features: list[np.ndarray]):
        self.x = np.vstack(features)
        sizes = np.array([len(f) for f in features])
        self.first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.order = np.argsort(-sizes, kind="stable")
        self.sizes = sizes
        self.weight = 1.0 / sizes  # in training: every document weighs the same, however many lines it has

    def marginals(self, w: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(P(label) for each line, expected transitions)."""
        score = np.zeros((len(self.x), 2))
        score[:, 1] = self.x @ w
        top = score.max(axis=1, keepdims=True)
        node, pair = np.exp(score - top), np.exp(trans)
        alpha, beta, scale = np.zeros_like(node), np.ones_like(node), np.ones(len(node))
        first, sizes = self.first[self.order], self.sizes[self.order]
        steps = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(int(sizes.max()))]
        for t, n in enumerate(steps):
            at = first[:n] + t
            a = node[at] if t == 0 else node[at] * (alpha[at - 1] @ pair)
            s = a.sum(axis=1)
            alpha[at], scale[at] = a / s[:, None], s
        expected = np.zeros((2, 2))
        for t in range(len(steps) - 1, 0, -1):
            at = first[: steps[t]] + t
            onward = node[at] * beta[at] / scale[at][:, None]
            expected += pair * ((alpha[at - 1] * self.weight[self.order[: steps[t]], None]).T @ onward)
            beta[at - 1] = onward @ pair.T
        p = alpha * beta
        return p / p.sum(axis=1, keepdims=True), expected


def fit_chains(features: list[np.ndarray], labels: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Weights (lines' features, transitions) by gradient ascent with adaptive steps."""
    chains = Chains([with_neighbours(f) for f in features])
    y = np.repeat(labels, chains.sizes).astype(float)
    stays = np.zeros((2, 2))
    for label, size in zip(labels, chains.sizes, strict=True):
        stays[label, label] += (size - 1) / size
    by_line = np.repeat(chains.weight, chains.sizes)
    theta = np.zeros(chains.x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, ROUNDS + 1):
        p, expected = chains.marginals(theta[:-4], theta[-4:].reshape(2, 2))
        grad = np.append(chains.x.T @ ((y - p[:, 1]) * by_line), (stays - expected).ravel()) / len(labels) - RIDGE * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return theta[:-4], theta[-4:].reshape(2, 2)


def score_texts(texts, model: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    if model is None:
        return np.full(len(texts), 0.5)
    out = np.zeros(len(texts))
    for at in range(0, len(texts), 500):
        made = [line_features(t) for t in texts[at : at + 500]]
        chains = Chains([with_neighbours(f) for f, _ in made])
        good = chains.marginals(*model)[0][:, 1]
        weight = np.concatenate([w for _, w in made])
        out[at : at + 500] = np.add.reduceat(good * weight, chains.first) / np.add.reduceat(weight, chains.first)
    return np.clip(out, 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = FOLDS) -> tuple[np.ndarray, np.ndarray] | None:
    """Fit on at most ``sample`` labelled documents outside the held-out fold."""
    known = labels.where("quality IN (0, 1)").where(crc_mod("doc_id", folds) != 0).select("doc_id", "quality").dropDuplicates(["doc_id"])
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bounded, so it may be broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "y": batch["quality"], "x": [line_features(t)[0].astype(np.float32).tobytes() for t in batch["text"]]})

    got = sorted(texts.mapInPandas(rows, "doc_id long, y int, x binary").collect(), key=lambda r: r.doc_id)
    if not got:
        return None
    return fit_chains([np.frombuffer(r.x, np.float32).reshape(-1, OWN).astype(float) for r in got], [r.y for r in got])


def score(docs: DataFrame, model, into: str = "score") -> DataFrame:
    """``docs`` with a column ``into``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def good(texts: pd.Series) -> pd.Series:
        return pd.Series(score_texts(texts.tolist(), shared.value))

    return docs.withColumn(into, good("text"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", (crc_mod("doc_id", FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
