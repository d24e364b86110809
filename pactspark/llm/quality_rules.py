"""Quality rules learned as gradient-boosted trees over document statistics.

Trees are grown on histograms by logistic loss (Newton leaf values). Chosen
features are monotone: a split that would let a leaf value move against the
feature's direction is not made, and leaves stay within the bounds that the
splits above set. The ensemble is flattened into numpy node arrays and scores a
batch level by level. The fit sees a bounded sample of labelled documents
(``most``, a documented parameter); every document is scored whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactspark.llm.rowwise import with_text_columns
from pactspark.llm.stats import BASE, NAMES, describe
from pactspark.llm.words import WordHashes

#: More of these never makes a document better.
MONOTONE = {"symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1, "same_neighbour_share": -1, "bang_per_word": -1, "bar_per_word": -1, "upper_words_share": -1}


@dataclass
class Forest:
    """All trees' nodes in one array each; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float
    cut: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        at = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.start + self.value[at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit_forest(x: np.ndarray, y: np.ndarray, directions: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, leaf: float = 3.0, ridge: float = 1.0) -> Forest:
    """Boosted trees on (rows, features) with labels 0/1 and a direction (-1, 0, 1) a feature."""
    if not len(y) or y.min() == y.max():
        start = 4.0 if not len(y) or y.max() else -4.0
        return Forest(*(np.zeros(1, t) for t in (int, float, int, int, float)), np.zeros(1, int), 1, start, 0.5)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) for j in range(x.shape[1])]
    codes = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    start = float(np.log(y.mean() / (1 - y.mean())))
    raw = np.full(len(y), start)
    nodes: list[list] = []
    roots = []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, lo: float, hi: float) -> int:
        me = len(nodes)
        value = float(np.clip(g[rows].sum() / (h[rows].sum() + ridge), lo, hi))
        nodes.append([0, np.inf, me, me, value * rate])
        if level == depth:
            return me
        best = (1e-6, 0, 0, 0.0)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        for j, e in enumerate(edges):
            if not len(e):
                continue
            gs = np.bincount(codes[rows, j], g[rows], len(e) + 1).cumsum()[:-1]
            hs = np.bincount(codes[rows, j], h[rows], len(e) + 1).cumsum()[:-1]
            a, b = np.clip(gs / (hs + ridge), lo, hi), np.clip((total_g - gs) / (total_h - hs + ridge), lo, hi)
            gain = gs * a - 0.5 * (hs + ridge) * a * a + (total_g - gs) * b - 0.5 * (total_h - hs + ridge) * b * b
            gain = gain - (total_g * value - 0.5 * (total_h + ridge) * value * value)
            gain[(hs < leaf) | (total_h - hs < leaf) | ((b - a) * directions[j] < 0)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), j, k, float(a[k] + b[k]) / 2)
        if not best[1] and not best[2] and best[0] <= 1e-6:
            return me
        _, j, k, middle = best
        down = codes[rows, j] <= k
        bounds = ((lo, hi), (lo, hi)) if not directions[j] else ((lo, middle), (middle, hi))[:: int(directions[j])]
        left = grow(rows[down], g, h, level + 1, *bounds[0])
        right = grow(rows[~down], g, h, level + 1, *bounds[1])
        nodes[me][:4] = [j, float(edges[j][k]), left, right]
        return me

    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        root = grow(np.arange(len(y)), y - p, np.maximum(p * (1 - p), 1e-9), 0, -np.inf, np.inf)
        roots.append(root)
        at = np.full(len(y), root)
        table = nodes
        f, t, a, b, v = (np.array(c) for c in zip(*table, strict=True))
        for _ in range(depth):
            at = np.where(x[np.arange(len(y)), f[at]] <= t[at], a[at], b[at])
        raw = raw + v[at]
    f, t, a, b, v = (np.array(c) for c in zip(*nodes, strict=True))
    return Forest(f, t, a, b, v, np.array(roots), depth, start, 0.5)


def labelled_features(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``most`` labelled documents, those of the smallest id hashes."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter("_id is not null and _y in (0, 1)")
    picked = known.groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(most)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(picked), "_id")  # at most ``most`` rows
    texts = texts.groupBy("_id").agg(F.min("_text").alias("_text"), F.first("_y").alias("_y"))  # an id may repeat

    def make():
        cache = WordHashes()
        return lambda texts: [[describe(t, cache)[1] for t in texts]]

    rows = with_text_columns(texts, "_text", [("_x", "array<double>")], make).select("_id", "_x", "_y").toArrow().sort_by("_id")
    return pc.list_flatten(rows["_x"]).to_numpy().reshape(-1, len(NAMES)), rows["_y"].to_numpy().astype(int)


def fit_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = 20_000, clean_loss: float = 0.003) -> Forest:
    """Trees for ``label_col`` (1: good); the cut rejects at most ``clean_loss`` of the good sample and nothing of 0.5 or more.

    Null labels and ids teach nothing; an id with several labels counts as good if
    one is, with several texts by the least of them. Without labels of both kinds
    all is kept that the base rules keep.
    """
    x, y = labelled_features(docs, labels, id_col, text_col, label_col, most)
    forest = fit_forest(x, y, np.array([MONOTONE.get(n, 0) for n in NAMES]))
    if (y == 1).any():
        forest.cut = float(min(0.5, np.quantile(forest.score(x[y == 1]), clean_loss)))
    return forest


FIELDS = [*((n, "long") for n in BASE), ("base_failed", "boolean"), ("kept", "boolean"), ("rule_score", "double")]


def apply_rules(docs: DataFrame, forest: Forest, text_col: str = "text", least_words: int = 50, repeat_per_cent: int = 50, prefix: str = "") -> DataFrame:
    """``docs`` with the BASE counts, base_failed, kept and rule_score of each whole text, each name after ``prefix``.

    A null or empty text has no words and fails the base rules. Rows are judged
    alone, so repeated rows get equal values; an empty table stays empty. Columns
    of ``docs`` with one of these names give way: choose a prefix to keep them. A
    very long text is described by one task, which holds its words.
    """

    def make():
        cache = WordHashes()

        def of(texts: list) -> list:
            found = [describe(t, cache) for t in texts]
            base = np.array([b for b, _ in found], np.int64).reshape(-1, len(BASE))
            score = forest.score(np.array([f for _, f in found]).reshape(-1, len(NAMES)))
            failed = (base[:, 0] < least_words) | (100 * base[:, 4] > repeat_per_cent * base[:, 0])
            return [*base.T, failed, ~failed & (score >= forest.cut), score]

        return of

    return with_text_columns(docs, text_col, [(prefix + n, kind) for n, kind in FIELDS], make)
