"""Hierarchical language identification.

First the family (Germanic, Romance, ...; a language outside the table is its own),
then the language within it, each by linear support vector machines that vote
one against one. Features are the square roots of the shares of hashed byte
n-grams (one to three) of the lower-cased text, letters only.

The machines are fitted on the driver to a bounded sample (``per_language``
documents of each language); every document is predicted from its whole text.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pactspark.llm.rowwise import with_text_columns

# ISO 639-1 codes by family.
FAMILIES = {
    "germanic": "en de nl af fy lb sv da no nb nn is fo yi",
    "romance": "fr es it pt ro ca gl oc co sc rm la",
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg",
    "celtic": "ga gd cy br gv kw",
    "baltic": "lt lv",
    "uralic": "fi et hu se",
    "turkic": "tr az kk ky uz tk tt ug",
    "indo-aryan": "hi ur bn pa gu mr ne si sa or as",
    "semitic": "ar he am mt",
    "dravidian": "ta te kn ml",
}
_FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
SIZE = 4096
_BLANK = bytes(32 if c < 65 or 90 < c < 97 or 122 < c < 128 else c for c in range(256))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def profile(text: str) -> np.ndarray:
    """Square roots of n-gram shares, of length one."""
    raw = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace").translate(_BLANK), np.uint8)
    raw = raw[(raw != 32) | np.concatenate([[True], raw[:-1] != 32])].astype(np.uint32)
    two = raw[:-1] << np.uint32(8) | raw[1:]
    three = two[:-1] << np.uint32(8) | raw[2:]
    bits = np.uint32(32 - 11)
    codes = np.concatenate([raw, (two * np.uint32(0x9E3779B1)) >> bits, ((three * np.uint32(0x85EBCA6B)) >> bits) + np.uint32(2048)])
    counts = np.bincount(codes, minlength=SIZE).astype(np.float32)
    return np.sqrt(counts / len(codes))


def fit_machine(x: np.ndarray, y: np.ndarray, cost: float = 20.0, steps: int = 60) -> np.ndarray:
    """Weights and bias of a linear SVM with squared hinge loss on labels -1 and 1, by conjugate gradients."""
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1)
    w = np.zeros(x.shape[1])
    balance = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)) * len(y) * cost / len(y)
    for _ in range(8):  # Newton rounds on the active set
        active = (y * (x @ w)) < 1
        a, c = x[active], balance[active]
        gradient = w + 2 * a.T @ (c * (a @ w - y[active]))
        step, r = np.zeros_like(w), -gradient
        p, rr = r.copy(), r @ r
        for _ in range(steps):
            if rr < 1e-12:
                break
            hp = p + 2 * a.T @ (c * (a @ p))
            alpha = rr / (p @ hp)
            step += alpha * p
            r -= alpha * hp
            rr, old = r @ r, rr
            p = r + (rr / old) * p
        w = w + step
    return w


@dataclass
class Machines:
    """One-against-one machines between ``names``."""

    names: list
    pairs: list[tuple[int, int]]
    weights: np.ndarray

    def vote(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The winner's index and a score in (0, 1): the logistic of its least margin."""
        if len(self.names) == 1:
            return np.zeros(len(x), int), np.ones(len(x))
        margin = x @ self.weights[:, :-1].T + self.weights[:, -1]
        votes = np.zeros((len(x), len(self.names)))
        for k, (i, j) in enumerate(self.pairs):
            votes[:, i] += (margin[:, k] > 0) + 1e-3 * np.tanh(margin[:, k])
            votes[:, j] += (margin[:, k] <= 0) - 1e-3 * np.tanh(margin[:, k])
        won = votes.argmax(axis=1)
        least = np.full(len(x), np.inf)
        for k, (i, j) in enumerate(self.pairs):
            least = np.minimum(least, np.where(won == i, margin[:, k], np.where(won == j, -margin[:, k], np.inf)))
        return won, 1 / (1 + np.exp(-np.clip(3 * least, -50, 50)))


def fit_machines(x: np.ndarray, y: list, names: list) -> Machines:
    y = np.array(y)
    pairs = list(combinations(range(len(names)), 2))
    weights = np.zeros((len(pairs), x.shape[1] + 1))
    for k, (i, j) in enumerate(pairs):
        rows = (y == names[i]) | (y == names[j])
        weights[k] = fit_machine(x[rows], np.where(y[rows] == names[i], 1.0, -1.0))
    return Machines(names, pairs, weights)


@dataclass
class Identifier:
    families: Machines
    within: list[Machines]

    def predict(self, texts: list) -> tuple[list[str], list[float]]:
        rows = [i for i, t in enumerate(texts) if has_letter(t)]
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        if rows and self.families.names:
            x = np.stack([profile(texts[i]) for i in rows])
            family, sure = self.families.vote(x)
            for f in np.unique(family):
                at = np.flatnonzero(family == f)
                own, score = self.within[f].vote(x[at])
                for k, o, s in zip(at, own, score * sure[at], strict=True):
                    names[rows[k]], scores[rows[k]] = self.within[f].names[o], float(s)
        return names, scores


def fit_identifier(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = 500, families: Mapping[str, str] = _FAMILY_OF) -> Identifier:
    """Fit to ``docs``, all of which may be learned from; rows without a language or letters teach nothing."""
    known = docs.select(F.col(text_col).cast("string").alias("_text"), F.col(lang_col).cast("string").alias("_lang"), F.xxhash64(F.col(id_col)).alias("_h")).filter("_lang is not null and _text is not null")
    counts = {r[0]: r[1] for r in known.groupBy("_lang").count().collect()}  # one row a language
    if not counts:
        return Identifier(Machines([], [], np.zeros((0, SIZE + 1))), [])
    share = F.create_map(*(F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, (2 * per_language + 50) / n))))
    drawn = known.filter(F.pmod("_h", F.lit(1 << 30)) < F.element_at(share, F.col("_lang")) * (1 << 30))
    drawn = drawn.withColumn("_n", F.row_number().over(Window.partitionBy("_lang").orderBy("_h"))).filter(F.col("_n") <= per_language)

    def profiles(batches):
        for batch in batches:
            got = [(t.as_py(), lang.as_py()) for t, lang in zip(batch.column(0), batch.column(1), strict=True)]
            got = [(profile(t).astype(np.float32).tobytes(), lang) for t, lang in got if has_letter(t)]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.string())], names=["x", "y"])

    rows = drawn.mapInArrow(profiles, "x binary, y string").toPandas().sort_values(["y", "x"])
    x = np.frombuffer(b"".join(rows["x"]), np.float32).reshape(-1, SIZE)
    langs = rows["y"].tolist()
    of = {lang: families.get(lang, lang) for lang in sorted(set(langs))}
    names = sorted(set(of.values()))
    within = []
    for family in names:
        own = [i for i, lang in enumerate(langs) if of[lang] == family]
        within.append(fit_machines(x[own], [langs[i] for i in own], sorted({langs[i] for i in own})))
    return Identifier(fit_machines(x, [of[lang] for lang in langs], names), within)


def identify(docs: DataFrame, identifier: Identifier, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score from the whole text alone.

    ``und`` with score 0 if the text is null or has no letter (or nothing was
    learned). Repeated rows get equal values; an empty table stays empty. Columns
    of these names give way. A very long text is profiled by one task, as one array.
    """
    return with_text_columns(docs, text_col, [("lang_pred", "string"), ("score", "double")], lambda: lambda texts: list(identifier.predict(texts)))
