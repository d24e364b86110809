"""Quality scores from preference pairs (Bradley-Terry).

A good document is preferred to a bad one. The score is linear in features of
the whole text: its statistics, standardised and cut into hinges at their
quantiles. Weights minimise the logistic loss of score differences over seeded
pairs by Newton steps, which take the pairs in blocks: the fit runs on the driver,
and its memory does not grow with the number of pairs. The threshold is the quantile of the sample's scores at
the share of bad documents; the reported score is the logistic function of the
distance to it, so 0.5 is the threshold. The fit sees a bounded sample
(``most`` documents, ``pairs`` pairs); every document is scored whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from pactspark.llm.quality_rules import labelled_features
from pactspark.llm.rowwise import with_text_columns
from pactspark.llm.stats import NAMES, describe
from pactspark.llm.words import WordHashes


@dataclass
class Ranker:
    centre: np.ndarray
    scale: np.ndarray
    knots: np.ndarray
    weights: np.ndarray
    threshold: float

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        hinges = [np.maximum(z - k, 0) for k in self.knots]
        return np.concatenate([z, *hinges], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.threshold, -500, 500)))


def fit_ranker(x: np.ndarray, y: np.ndarray, pairs: int = 60_000, ridge: float = 1.0, steps: int = 12, seed: int = 11, block: int = 2048) -> Ranker:
    """Weights from pairs (label 1 over label 0); without pairs every score is 0.5."""
    width = x.shape[1]
    if not len(y):
        return Ranker(np.zeros(width), np.ones(width), np.zeros((0, width)), np.zeros(width), 0.0)
    centre, scale = np.median(x, axis=0), x.std(axis=0) + 1e-9
    knots = np.quantile((x - centre) / scale, [0.1, 0.3, 0.5, 0.7, 0.8, 0.9, 0.96], axis=0)
    ranker = Ranker(centre, scale, knots, np.zeros(width * (1 + len(knots))), 0.0)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if len(good) and len(bad):
        rng = np.random.default_rng(seed)
        phi = np.empty((len(y), len(ranker.weights)))
        for at in range(0, len(y), block):
            phi[at : at + block] = ranker.expand(x[at : at + block])
        over, under = rng.choice(good, pairs), rng.choice(bad, pairs)
        for _ in range(steps):
            gradient, hessian = -ridge * ranker.weights, ridge * np.eye(phi.shape[1])
            for at in range(0, pairs, block):
                d = phi[over[at : at + block]] - phi[under[at : at + block]]
                p = 1 / (1 + np.exp(np.clip(d @ ranker.weights, -50, 50)))
                gradient += d.T @ p
                hessian += (d * (p * (1 - p))[:, None]).T @ d
            ranker.weights = ranker.weights + np.linalg.solve(hessian, gradient)
        ranker.threshold = float(np.quantile(phi @ ranker.weights, len(bad) / len(y)))
    return ranker


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = 20_000) -> Ranker:
    """A ranker from the labelled documents; ids and labels that are null, or ids that repeat, as in ``fit_rules``."""
    return fit_ranker(*labelled_features(docs, labels, id_col, text_col, label_col, most))


def apply_quality(docs: DataFrame, ranker: Ranker, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from 0.5) of each whole text, each name after ``prefix``.

    A null text is scored as an empty one. Rows are judged alone, so repeated
    rows get equal values; an empty table stays empty. Columns of ``docs`` with
    one of these names give way: choose a prefix to keep them. A very long text
    is described by one task, which holds its words.
    """

    def make():
        cache = WordHashes()

        def of(texts: list) -> list:
            score = ranker.score(np.array([describe(t, cache)[1] for t in texts]).reshape(-1, len(NAMES)))
            return [score, (score >= 0.5).astype(np.int32)]

        return of

    return with_text_columns(docs, text_col, [(f"{prefix}score", "double"), (f"{prefix}predicted", "int")], make)
