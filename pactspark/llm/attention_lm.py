"""A causal self-attention language model on subword ids, trained in numpy.

A text is its words' subword ids (each word after a space, cut by a public
byte-level vocabulary), then an end. Windows of ``2 * HALF`` ids overlap by half:
each scores its second half with all that stands before in the window, so every
id is scored once. Two attention heads read the window, masked and in batches:

- the first averages what earlier ids say about the text; with the last id it
  weighs ``TOPICS`` learned distributions over the ids that begin words;
- the second looks for earlier places that followed the same id and copies the id
  that stands there, with a learned gate and a sink for "nothing alike".

How a begun word goes on, and where it ends, comes from counts of id bigrams and
trigrams within words, interpolated by Witten and Bell's rule. All parts are
normalised, so a text's score is the log probability of a proper model.

Training: word counts cover all training texts and grow with them; the id counts
follow from the words. The weights start on the driver from a bounded sample
(``start_windows``), then every partition trains once on all windows of all its
training texts and the results are averaged by how much each one saw, chunk by
chunk in a shuffle. Frequent words (``head_words``) are looked up in the task; the
rest meets the counts in a join. ``most_grams`` bounds what is broadcast.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactspark.llm import scratch
from pactspark.llm.words import mix64, split_words

HALF, KINDS, OWN = 16, 8192, 7168
LOOK, VALUE, FIND, HIDDEN, TOPICS = 8, 16, 12, 16, 8
#: Columns of the embedding table: as a query (look, find), as a key (look, value), as what stood before a key, as the last id.
_Q, _K, _B, _H = (slice(a, b) for a, b in ((0, LOOK + FIND), (LOOK + FIND, 2 * LOOK + FIND + VALUE), (2 * LOOK + FIND + VALUE, 2 * (LOOK + FIND) + VALUE), (2 * (LOOK + FIND) + VALUE, 2 * (LOOK + FIND) + VALUE + HIDDEN)))
_WIDTH = _H.stop
_TABLES = {"q": _Q, "k": _K, "b": _B, "h": _H}
_BACK = HALF + np.arange(HALF)[:, None] - np.arange(2 * HALF)[None, :]
_SEEN = (_BACK >= 0).astype(np.float32)
_BACK = np.clip(_BACK, 0, 2 * HALF - 1)
_ADD = np.ones((2 * HALF, 1), np.float32)
#: A score's natural exponent as the bits of a float, and those of 1; embeddings and biases are held so that no score passes 64.
_SCALE, _ONE = np.float32(2**23 / np.log(2)), np.float32(127 * 2**23)
_FAR = 1.8


class Pieces:
    """Subword ids of single words, each after a space, under a byte-level vocabulary given as ranks."""

    def __init__(self, ranks_path: str):
        import base64

        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.size = max(ranks.values()) + 1
        self.of = tiktoken.Encoding("ranks", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece

    def flat(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All words' ids in a row, and how many each word has."""
        each = [self.of(b" " + w) for w in words]
        lens = np.fromiter(map(len, each), np.int64, len(each))
        return np.fromiter((i for e in each for i in e), np.int64, int(lens.sum())), lens


def grams(ids: np.ndarray, lens: np.ndarray, size: int, depth: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """For every id after the first of a word and every word's end: the symbol, and its contexts by order (3, n).

    Symbols are ids and ``size`` for the end. A context is 31 bits: the last id,
    the last two (or the word's begin), and all of the word so far, up to
    ``depth`` ids (beyond them it is of no word).
    """
    ends = np.cumsum(lens)
    after = np.append(ids[1:], size)
    after[ends - 1] = size
    before = np.insert(ids[:-1], 0, size)
    before[ends - lens] = size
    whole = np.full(len(ids), -1, np.int64)
    at, code = ends - lens, np.zeros(len(lens), np.uint64)
    for n in range(min(depth, int(lens.max(initial=0)))):
        on = lens > n
        at, code, lens = at[on] + (n > 0), code[on], lens[on]
        code = mix64(code * np.uint64(2) + ids[at].astype(np.uint64) + np.uint64(n + 1))
        whole[at] = (code >> np.uint64(33)).astype(np.int64)
    two = (mix64((before * (size + 1) + ids).astype(np.uint64)) >> np.uint64(33)).astype(np.int64)
    return after, np.stack([ids, two, whole])


def gram_codes(symbol: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """One 64-bit code of order, context and symbol each; -1 where there is no context."""
    order = np.arange(len(contexts), dtype=np.int64)[:, None]
    return np.where(contexts >= 0, (order << 48 | contexts) << 16 | symbol, -1)


def _places(held: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where ``wanted`` stand in the sorted ``held``, -1 where they don't; a hash index would take four times the memory of ``held``."""
    if not len(held):
        return np.full(len(wanted), -1)
    order = np.argsort(wanted)  # a search goes on near the last one
    at, asked = np.empty(len(wanted), np.int64), wanted[order]
    found = np.minimum(np.searchsorted(held, asked), len(held) - 1)
    at[order] = np.where(held[found] == asked, found, -1)
    return at


@dataclass
class Counts:
    """Witten-Bell probabilities of symbols within words from counted codes, in order; what is not held has count 0."""

    size: int
    codes: np.ndarray
    counts: np.ndarray

    def __post_init__(self) -> None:
        self.counts = np.append(self.counts, 0).astype(np.float32)  # the last one is for what is not held
        self.contexts, where = np.unique(self.codes >> 16, return_inverse=True)
        self.total = np.append(np.bincount(where, self.counts[:-1], len(self.contexts)), 0.0)
        self.kinds = np.append(np.bincount(where, minlength=len(self.contexts)).astype(float), 1)
        last = self.codes >> 48 == 0
        alone = np.bincount(self.codes[last] & 0xFFFF, self.counts[:-1][last], self.size + 1) + 0.5
        self.alone = alone / alone.sum()

    def probability(self, symbol: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        p = self.alone[symbol]
        for code in gram_codes(symbol, contexts):
            at, hit = _places(self.contexts, code >> 16), _places(self.codes, code)
            p = (self.counts[hit] + self.kinds[at] * p) / (self.total[at] + self.kinds[at])
        return p


class Lexicon(dict):
    """Words to numbers, with each word's ids, its probabilities within the word, its end's and its count.

    Number 0 is the end of a text. Words beyond the given head are met as they
    come (count -1: not known here) and forgotten beyond ``most``.
    """

    def __init__(self, pieces: Pieces, counts: Counts, start: np.ndarray, head: tuple[list[bytes], np.ndarray], texts: int, most: int = 900_000):
        super().__init__()
        self.pieces, self.grams, self.start, self.head, self.texts, self.most = pieces, counts, start, head, texts, most
        self._clear()

    def _clear(self) -> None:
        self.clear()
        end = self.pieces.size
        self.ids, self.stat = np.array([end], np.int32), np.array([self.start[end]], np.float32)
        self.first, self.lens = np.zeros(1, np.int64), np.ones(1, np.int64)
        self.ending, self.count = np.ones(1, np.float32), np.array([self.texts], np.int64)
        self.pending: list[bytes] = []
        self.used = 1
        words, n = self.head
        self.update(zip(words, range(1, len(words) + 1), strict=True))
        self.pending = list(words)
        self._settle(n)

    def __missing__(self, word: bytes) -> int:
        at = self[word] = self.used + len(self.pending)
        self.pending.append(word)
        return at

    def _settle(self, counts: np.ndarray | None = None) -> None:
        words, self.pending = self.pending, []
        if not words:
            return
        ids, lens = self.pieces.flat(words)
        p = self.grams.probability(*grams(ids, lens, self.pieces.size))
        ends = np.cumsum(lens)
        stat = np.concatenate([[0.0], p[:-1]])
        stat[ends - lens] = self.start[ids[ends - lens]]
        self.first = np.concatenate([self.first, len(self.ids) + ends - lens])
        self.lens = np.concatenate([self.lens, lens])
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        self.stat = np.concatenate([self.stat, stat.astype(np.float32)])
        self.ending = np.concatenate([self.ending, p[ends - 1].astype(np.float32)])
        self.count = np.concatenate([self.count, np.full(len(words), -1, np.int64) if counts is None else counts])
        self.used += len(words)

    def numbers(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words, an end after each text, and how many each text has."""
        if len(self) > self.most:
            self._clear()
        lens = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        out = np.zeros(int(lens.sum()), np.int64)
        at = 0
        for t, n in zip(texts, lens.tolist(), strict=True):
            out[at : at + n - 1] = np.fromiter(map(self.__getitem__, t), np.int64, n - 1)
            at += n
        self._settle()
        return out, lens

    def spell(self, numbers: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids, which of them begin words, their probabilities by counts alone, and how many each text has."""
        n = self.lens[numbers]
        ends = np.cumsum(n)
        begin = ends - n
        at = np.repeat(self.first[numbers] - begin, n) + np.arange(ends[-1] if len(ends) else 0)
        ids, stat = self.ids[at], self.stat[at]
        first = np.zeros(len(ids), bool)
        first[begin] = True
        before = np.concatenate([[1.0], self.ending[numbers[:-1]]])
        before[np.cumsum(lens)[:-1]] = 1.0  # a text's first word follows no other
        stat[begin] *= before
        size = np.add.reduceat(n, np.cumsum(lens) - lens) if len(lens) else lens
        return ids, first, stat, size


def windows(ids: np.ndarray, first: np.ndarray, stat: np.ndarray, size: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inputs (n, 2 HALF; -1: nothing there), targets (n, HALF; -1), whether those begin words, their counted probabilities, and the text of each window."""
    per = -(-size // HALF)
    n = int(per.sum())
    owner = np.repeat(np.arange(len(size)), per)
    offset = np.repeat(np.cumsum(per) - per, size) * HALF + np.arange(len(ids)) - np.repeat(np.cumsum(size) - size, size)
    target, begins, known = np.full(n * HALF, -1, np.int32), np.zeros(n * HALF, bool), np.ones(n * HALF, np.float32)
    target[offset], begins[offset], known[offset] = ids, first, stat
    seen = np.full(n * HALF + 1, -1, np.int32)
    seen[1:] = target
    starts = (np.cumsum(per) - per) * HALF
    seen[starts] = end
    own = seen[:-1].reshape(n, HALF)
    past = np.concatenate([np.full((1, HALF), -1, np.int32), own[:-1]]) if n else own
    past[np.cumsum(per) - per] = -1
    return np.concatenate([past, own], axis=1), target.reshape(n, HALF), begins.reshape(n, HALF), known.reshape(n, HALF), owner


def fresh(seed: int = 5) -> dict:
    rng = np.random.default_rng(seed)
    emb = (rng.standard_normal((KINDS, _WIDTH)) * 0.3).astype(np.float32)
    find = np.clip(rng.standard_normal((KINDS, FIND)) * 1.2, -_FAR, _FAR).astype(np.float32)  # like ids find each other from the start
    emb[:, LOOK : LOOK + FIND], emb[:, _B], emb[:, _H] = find, find, 0
    p = {"emb": emb, "near": np.zeros(2 * HALF, np.float32), "far": np.full(2 * HALF, -8, np.float32)}
    p |= {"w1": (rng.standard_normal((VALUE, HIDDEN)) * 1.5).astype(np.float32), "b1": np.full(HIDDEN, 0.1, np.float32), "w2": (rng.standard_normal((HIDDEN, TOPICS + 1)) * 0.5).astype(np.float32), "b2": np.zeros(TOPICS + 1, np.float32)}
    p["topic"] = (rng.standard_normal((TOPICS, KINDS)) * 0.5).astype(np.float32)
    return p


def _weights(scores: np.ndarray, blank: np.ndarray, upto: int) -> np.ndarray:
    """Attention weights before their sum: 2**x with the fraction of x taken linearly, 0 for the future and for blank columns.

    ``scores`` come scaled and offset so that their integer part is the bits of that float.
    """
    out = scores.astype(np.int32).view(np.float32)
    out *= _SEEN
    out[blank, :, :upto] = 0
    return out


@dataclass
class Lm:
    """Weights, the kind of each id, and how often each kind begins a word."""

    p: dict
    kind: np.ndarray
    begins: np.ndarray

    def ready(self) -> dict:
        """Tables as the forward pass reads them."""
        r = {n: np.empty((KINDS, at.stop - at.start), np.float32) for n, at in _TABLES.items()}
        r |= {"ratio": np.ones((KINDS, TOPICS + 1), np.float32), "log": np.log(self.begins).astype(np.float32), "per": (1 / self.begins).astype(np.float32)}
        self.refresh(r, slice(None), self.p["emb"])
        self.shares(r, np.arange(KINDS))
        return r

    def shares(self, r: dict, kinds: np.ndarray) -> None:
        """Sets the topics' ratios of these kinds, which ``refresh`` leaves as they were."""
        r["ratio"][kinds, 1:] = (r["f"].take(kinds, axis=1) * r["per"].take(kinds)).T

    def refresh(self, r: dict, rows: np.ndarray | slice, values: np.ndarray) -> None:
        """Brings the tables ``r``, but for the ratios, up to date where only the ``rows`` of the embedding, now ``values``, have moved; all other weights may have."""
        p = self.p
        for n, at in _TABLES.items():
            r[n][rows] = values[:, at] * _SCALE if n == "q" else values[:, at]
        r["near"], r["far"] = p["near"][_BACK] * _SCALE + _ONE, p["far"][_BACK] * _SCALE + _ONE
        f = p["topic"] + r["log"]
        f -= f.max(axis=1, keepdims=True)
        np.exp(f, out=f)
        f /= f.sum(axis=1, keepdims=True)
        r["f"] = f

    def forward(self, r: dict, x: np.ndarray, y: np.ndarray, begins: np.ndarray, known: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
        """Probabilities of targets ``y`` (anything where y is -1); with ``keep`` also what the backward pass reads."""
        p = self.p
        kx = self.kind.take(x)
        q, k = r["q"].take(kx[:, HALF:], axis=0), r["k"].take(kx, axis=0)
        blank = np.flatnonzero(x[:, HALF - 1] < 0)
        s = q[..., :LOOK] @ k[..., :LOOK].transpose(0, 2, 1)
        s += r["near"]
        s = _weights(s, blank, HALF)
        total = s @ _ADD
        c = s @ k[..., LOOK:]
        c /= total
        # Only ids that begin words are told apart by what the text is about.
        at = np.flatnonzero(begins.ravel())
        cw, ky = c.reshape(-1, VALUE).take(at, axis=0), self.kind.take(y.ravel().take(at))
        pre = cw @ p["w1"]
        pre += r["h"].take(kx[:, HALF:].ravel().take(at), axis=0)
        pre += p["b1"]
        h = np.maximum(pre, 0)
        z = h @ p["w2"]
        z += p["b2"]
        np.exp(z, out=z)
        z /= np.einsum("ij->i", z)[:, None]
        ratio = r["ratio"].take(ky, axis=0)
        lift = np.einsum("ij,ij->i", z, ratio)
        base = known.ravel().copy()
        base[at] *= lift
        base = base.reshape(y.shape)
        # The finding head: keys are what stood before, values the ids there.
        b = r["b"].take(np.concatenate([kx[:, :1], kx[:, :-1]], axis=1), axis=0)
        t = q[..., LOOK:] @ b.transpose(0, 2, 1)
        t += r["far"]
        t = _weights(t, blank, HALF + 1)
        t[..., 0] = 0
        every = (t @ _ADD)[..., 0]
        match = x[:, None, :] == y[:, :, None]
        copied = np.einsum("ijk,ijk->ij", t, match.view(np.int8))
        every += 1
        copied /= every
        out = copied + base / every
        if not keep:
            return out, {}
        return out, {"kx": kx, "ky": ky, "at": at, "q": q, "k": k, "s": s / total, "cw": cw, "h": h, "pre": pre, "e": z, "ratio": ratio, "lift": lift, "b": b, "t": t / every[..., None], "match": match, "copied": copied, "sink": 1 / every, "base": base}

    def gradients(self, r: dict, x: np.ndarray, y: np.ndarray, begins: np.ndarray, known: np.ndarray) -> tuple[float, dict]:
        """The mean loss in nats, and its gradients; that of ``emb`` as (rows, values)."""
        p = self.p
        prob, a = self.forward(r, x, y, begins, known, keep=True)
        ok = y >= 0
        n = max(int(ok.sum()), 1)
        loss = -np.log(prob[ok]).sum() / n
        flat = lambda v: v.reshape(-1, v.shape[-1])
        dp = np.where(ok, -1 / (np.maximum(prob, 1e-30) * n), 0).astype(np.float32)
        dlift = (dp * a["sink"] * known).ravel()[a["at"]].astype(np.float32)
        dz = dlift[:, None] * a["e"] * (a["ratio"] - a["lift"][:, None])
        g = {"w2": a["h"].T @ dz, "b2": dz.sum(axis=0)}
        dpre = (dz @ p["w2"].T) * (a["pre"] > 0)
        g["w1"], g["b1"] = a["cw"].T @ dpre, dpre.sum(axis=0)
        dc = np.zeros((y.size, VALUE), np.float32)
        dc[a["at"]] = dpre @ p["w1"].T
        dc = dc.reshape(*y.shape, VALUE)
        q = a["q"] * (1 / _SCALE)
        ds = dc @ a["k"][..., LOOK:].transpose(0, 2, 1)
        ds -= np.einsum("ijk,ijk->ij", ds, a["s"])[..., None]
        ds *= a["s"]
        dv = a["s"].transpose(0, 2, 1) @ dc
        dq1, dk1 = ds @ a["k"][..., :LOOK], ds.transpose(0, 2, 1) @ q[..., :LOOK]
        # prob = copied + base * sink; a weight t moves copied by t (match - copied) and sink by -t sink.
        dt = a["match"] - (a["copied"] + a["base"] * a["sink"])[..., None]
        dt *= a["t"]
        dt *= dp[..., None]
        dq2, db = dt @ a["b"], (dt.transpose(0, 2, 1) @ q[..., LOOK:])[:, 1:]
        for name, d in (("near", ds), ("far", dt)):
            g[name] = np.bincount(_BACK.ravel(), (d.sum(axis=0) * _SEEN).ravel(), 2 * HALF).astype(np.float32)
        # Sums by row of the embedding, over the rows that are met.
        kx = a["kx"]
        rows = np.flatnonzero(np.bincount(kx.ravel(), minlength=KINDS))
        nth = np.empty(KINDS, np.int64)
        nth[rows] = np.arange(len(rows))
        at = nth.take(kx)
        last = at[:, HALF:].ravel()
        values = np.empty((len(rows), _WIDTH), np.float32)
        met = ((_Q, last, (dq1, dq2)), (_H, last.take(a["at"]), (dpre,)), (_K, at.ravel(), (dk1, dv)), (_B, at[:, :-1].ravel(), (db,)))
        for to, where, parts in met:
            for d in parts:
                d, width = flat(d), d.shape[-1]
                sums = np.zeros(len(rows) * width, np.float32)
                np.add.at(sums, (where[:, None] * width + np.arange(width)).ravel(), d.ravel())
                values[:, to.start : to.start + width] = sums.reshape(-1, width)
                to = slice(to.start + width, to.stop)
        g["emb"] = (rows, values)
        # The ratios' columns are the topics over ``begins``.
        moved = dlift[:, None] * a["e"][:, 1:] * a["ratio"][:, 1:]
        cell = a["ky"][:, None] + np.arange(TOPICS) * KINDS
        g["topic"] = np.bincount(cell.ravel(), moved.ravel(), TOPICS * KINDS).reshape(TOPICS, KINDS).astype(np.float32)
        g["topic"] -= r["f"] * moved.sum(axis=0)[:, None]
        return float(loss), g

    def score(self, given: tuple, texts: int, step: int = 128) -> np.ndarray:
        """Sums of log10 probabilities by text, from ``windows``."""
        x, y, begins, known, owner = given
        r = self.ready()
        rows = np.empty(len(x))
        for at in range(0, len(x), step):
            to = slice(at, at + step)
            prob, _ = self.forward(r, x[to], y[to], begins[to], known[to])
            rows[to] = np.log(np.where(y[to] >= 0, np.maximum(prob, 1e-30), 1)).sum(axis=1, dtype=float)
        return np.bincount(owner, rows, texts) / np.log(10)


class Trainer:
    """Adam; the embedding's rows move only when they are met. Between its steps nothing else may move the weights."""

    def __init__(self, lm: Lm, rate: float):
        self.lm, self.rate, self.t, self.seen = lm, rate, 0, 0
        self.m, self.v = ({n: np.zeros_like(a) for n, a in lm.p.items()} for _ in range(2))
        self.tables = lm.ready()

    def step(self, x: np.ndarray, y: np.ndarray, begins: np.ndarray, known: np.ndarray, slow: float = 1.0) -> float:
        self.t += 1
        self.seen += int((y >= 0).sum())
        self.lm.shares(self.tables, self.lm.kind.take(y[begins]))
        loss, grads = self.lm.gradients(self.tables, x, y, begins, known)
        now = self.rate * slow * min(1, self.t / 20)
        for n, g in grads.items():
            at, g = g if n == "emb" else (slice(None), g)
            m, v = self.m[n][at], self.v[n][at]
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            g *= g
            g *= 0.01
            v += g
            np.sqrt(v * (1 / (1 - 0.99**self.t)), out=g)
            g += 1e-8
            np.divide(m, g, out=g)
            g *= -now * (4 if n == "topic" else 1) / (1 - 0.9**self.t)
            g += self.lm.p[n][at]
            if limit := {"emb": _FAR, "near": 12, "far": 12}.get(n):
                np.clip(g, -limit, limit, out=g)
            self.lm.p[n][at] = g
            if n == "emb":
                self.m[n][at], self.v[n][at] = m, v
                rows, values = at, g
        self.lm.refresh(self.tables, rows, values)
        return loss


def train(lm: Lm, given: tuple, steps: int, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Trainer:
    """``steps`` batches drawn from the windows ``given``, at a falling rate."""
    made, rng = Trainer(lm, rate), np.random.default_rng(seed)
    for t in range(steps if len(given[0]) else 0):
        at = rng.integers(0, len(given[0]), batch)
        made.step(*(a[at] for a in given[:4]), slow=1 - t / steps)
    return made


def _one_thread() -> None:
    """A task has one core; numpy's library would start a thread a core of the machine."""
    import ctypes
    import glob
    import os

    for found in glob.glob(os.path.join(os.path.dirname(np.__file__), "..", "numpy.libs", "*openblas*")):
        library = ctypes.CDLL(found)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                return


def _trim() -> None:
    """Workers serve one task after another; give back what earlier ones freed and the C library holds on to."""
    import ctypes

    library = ctypes.CDLL(None)
    if hasattr(library, "malloc_trim"):  # glibc's
        library.malloc_trim(0)


def _texts(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Slices of batches, of about ``most`` bytes of text, with their words."""
    for whole in batches:
        texts, start, held = whole.column(whole.schema.get_field_index("text")), 0, 0
        for i, text in enumerate(texts):
            held += len(text.as_buffer() or b"") if text.is_valid else 0
            if held >= most or i - start >= 512:
                yield (part := whole.slice(start, i + 1 - start)), [split_words(t.as_py()) for t in part.column(part.schema.get_field_index("text"))]
                start, held = i + 1, 0
        if start < whole.num_rows:
            yield (part := whole.slice(start)), [split_words(t.as_py()) for t in part.column(part.schema.get_field_index("text"))]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()
    give = lambda c: pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["word", "n"])
    for batch in batches:
        for text in batch.column(0):
            held.update(split_words(text.as_py()))
            if len(held) > 500_000:
                yield give(held)
                held = Counter()
    yield give(held)


def _count_grams(ranks_path: str):
    """(code, n) of all words: ids, word beginnings (both order 7) and what follows within words.

    The two short contexts count each distinct word once, which tells better what
    new words are like; the whole word so far counts occurrences.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(ranks_path)
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column(1).to_numpy()
            ids, lens = pieces.flat(batch.column(0).to_pylist())
            codes = gram_codes(*grams(ids, lens, pieces.size))
            each = np.repeat(n, lens)
            seen, begun = np.int64(7) << 48 | ids, np.int64(7) << 48 | np.int64(1) << 16 | ids[np.cumsum(lens) - lens]
            all_ = np.concatenate([codes[0], codes[1], codes[2], seen, begun])
            times = np.concatenate([np.ones(2 * len(ids), np.int64), each, each, n])
            held, where = np.unique(all_, return_inverse=True)
            sums = np.bincount(where, times, len(held)).astype(np.int64)
            ok = held >= 0
            yield pa.RecordBatch.from_arrays([pa.array(held[ok]), pa.array(sums[ok])], names=["code", "n"])

    return run


@dataclass
class Maker:
    """What a task needs to turn texts into windows."""

    ranks_path: str
    codes: np.ndarray
    counts: np.ndarray
    start: np.ndarray
    head: tuple[list[bytes], np.ndarray]
    texts: int

    def lexicon(self) -> Lexicon:
        pieces = Pieces(self.ranks_path)
        return Lexicon(pieces, Counts(pieces.size, self.codes, self.counts), self.start, self.head, self.texts)


def _drawn(maker: Maker, share: float):
    """Of each text's windows those that a hash of id and number draws, text by text."""
    lexicon = maker.lexicon()

    def of(ids: list, texts: list[list[bytes]]) -> tuple:
        given = windows(*lexicon.spell(*lexicon.numbers(texts)), lexicon.pieces.size)
        seeds = np.array([xxhash.xxh3_64_intdigest(f"0:{own}") for own in ids], np.uint64)
        owner = given[4]
        nth = np.arange(len(owner)) - np.searchsorted(owner, owner)
        lot = mix64(seeds[owner] + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        at = np.flatnonzero(lot < np.uint64(min(share, 1) * (2**64 - 2048)))
        return tuple(a[at] for a in given)

    return of


def _start_windows(maker: Maker, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = None
        for part, texts in _texts(batches):
            draw = draw or _drawn(maker, share)
            rows = zip(*draw(part.column(0).to_pylist(), texts)[:4], strict=True)
            made = [b"".join((x.tobytes(), y.tobytes(), f.tobytes(), k.tobytes())) for x, y, f, k in rows]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["w"])

    return run


def _unpacked(rows: list[bytes]) -> tuple:
    """Windows in an order of their own."""
    size = 4 * 2 * HALF + 4 * HALF + HALF + 4 * HALF
    raw = np.frombuffer(b"".join(sorted(rows)), np.uint8).reshape(-1, size)
    cut = np.cumsum([0, 8 * HALF, 4 * HALF, HALF, 4 * HALF])
    x, y, f, k = (np.ascontiguousarray(raw[:, a:b]) for a, b in zip(cut, cut[1:], strict=False))
    return x.view(np.int32), y.view(np.int32), f.view(bool), k.view(np.float32)


CHUNK = 1 << 14


def _partition_weights(lm: Lm, maker: Maker, batch: int, rate: float):
    """Trains once on every window of the partition's texts and gives (chunk of the weights, weight * weights, weight)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _one_thread()
        _trim()
        lexicon, trainer, held = None, None, []

        def learn(least: int) -> list:
            given = tuple(np.concatenate(a) for a in zip(*held, strict=True))
            order = np.random.default_rng(trainer.t).permutation(len(given[0]))
            whole = len(order) - len(order) % least
            for at in range(0, whole, batch):
                trainer.step(*(a[order[at : at + batch]] for a in given))
            return [tuple(a[order[whole:]] for a in given)]

        for part, texts in _texts(batches):
            if lexicon is None:
                lexicon, trainer = maker.lexicon(), Trainer(Lm({n: a.copy() for n, a in lm.p.items()}, lm.kind, lm.begins), rate)
            held.append(windows(*lexicon.spell(*lexicon.numbers(texts)), lexicon.pieces.size)[:4])
            if sum(len(h[0]) for h in held) >= 16 * batch:
                held = learn(batch)
        if held:
            learn(1)
        if trainer is None or not trainer.seen:
            return
        flat = np.concatenate([a.ravel() for a in trainer.lm.p.values()])
        for n, at in enumerate(range(0, len(flat), CHUNK)):
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([(flat[at : at + CHUNK] * np.float32(trainer.seen)).tobytes()], pa.binary()), pa.array([trainer.seen], pa.int64())], names=["chunk", "sum", "seen"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums runs of one chunk, a row at a time."""
    at, total, seen = None, None, 0
    give = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary()), pa.array([seen], pa.int64())], names=["chunk", "sum", "seen"])
    for batch in batches:
        for n, values, weight in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            values = np.frombuffer(values.as_buffer(), np.float32)
            if n != at:
                if at is not None:
                    yield give()
                at, total, seen = n, np.zeros(len(values)), 0
            total += values
            seen += weight
    if at is not None:
        yield give()


def _averaged(lm: Lm, rows: list) -> dict:
    flat = np.concatenate([np.frombuffer(r["sum"], float) / r["seen"] for r in sorted(rows, key=lambda r: r["chunk"])]).astype(np.float32)
    out, at = {}, 0
    for n, a in lm.p.items():
        out[n] = flat[at : at + a.size].reshape(a.shape).copy()
        at += a.size
    return out


def _commonest(counted: DataFrame, most: int) -> DataFrame:
    """The rows of the largest ``n``, as many whole steps of a sixteenth of a doubling as ``most`` rows hold."""
    step = F.floor(F.log2("n") * 16).cast("int")
    left, least = most, 0
    for at, rows in sorted(((r[0], r[1]) for r in counted.groupBy(step).count().collect()), reverse=True):  # at most 64 * 16 steps
        left -= rows
        if left < 0:
            least = at + 1
            break
    return counted.filter(step >= least)


SCORED = "doc_id long, _row long, n_tokens long, _known long, _base double, _rest array<struct<word binary, k long>>, score double"


def _scored(lm: Lm, maker: Maker, total: int, kinds: int):
    floor = np.log10(total + kinds + 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _one_thread()
        _trim()
        lexicon = maker.lexicon()
        types = [pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.struct([("word", pa.binary()), ("k", pa.int64())])), pa.float64()]
        for part, texts in _texts(batches):
            numbers, lens = lexicon.numbers(texts)
            scores = lm.score(windows(*lexicon.spell(numbers, lens), lexicon.pieces.size), len(texts))
            count, starts = lexicon.count[numbers], np.cumsum(lens) - lens
            known = np.add.reduceat((count > 0).astype(np.int64), starts)
            base = np.add.reduceat(np.where(count >= 0, np.log10(np.maximum(count, 0) + 1.0) - floor, 0.0), starts)
            rest: list[list] = [[] for _ in texts]
            far = np.flatnonzero(count < 0)
            for i, at in zip(np.searchsorted(starts, far, "right") - 1, far, strict=True):
                rest[i].append(texts[i][at - starts[i]])
            columns = [lens, known, base, [[{"word": w, "k": k} for w, k in Counter(r).items()] for r in rest], scores]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[f.split()[0] for f in SCORED.replace("struct<word binary, k long>", "s").split(", ")])

    return run


def score_texts(
    docs: DataFrame, learns: Column, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", start_windows: int = 24_000, start_steps: int = 800, batch: int = 128, head_words: int = 200_000, most_grams: int = 1_000_000
) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    ``learns`` says which rows may be learned from. A null or empty text has the
    end alone. Repeated rows and null ids are scored like others; with nothing to
    learn from all counts are 0; an empty table gives none. Other columns, whatever
    their names, are not read. A very long text is scored in windows; its words and
    ids are held by one task. The session's Arrow batches are held small.
    """
    scratch.small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(learns, F.lit(False)).alias("learns"))
    taught = rows.filter("learns").select("doc_id", "text")
    counts = scratch.save(taught.select("text").mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    texts = taught.count()
    words, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    head = _commonest(counts.filter(F.octet_length("word") <= 64), head_words).toArrow().sort_by("word")
    codes = scratch.save(counts.mapInArrow(_count_grams(ranks_path), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")), "grams")
    size = Pieces(ranks_path).size
    order = F.shiftright("code", 48)
    ids = codes.filter(order == 7).toPandas()  # at most two rows an id of the vocabulary
    held = _commonest(codes.filter(order < 7), most_grams).withColumn("n", F.least("n", F.lit(2**31 - 1)).cast("int")).toArrow()

    code, n = ids["code"].to_numpy(np.int64), ids["n"].to_numpy(np.int64)
    begun = (code >> 16 & 1) == 1
    seen, start = (np.bincount(code[at] & 0xFFFF, n[at], size + 1) for at in (~begun, begun))
    seen[size] = start[size] = texts
    by_use = np.lexsort((np.arange(size + 1), -seen))
    kind = np.full(size + 2, KINDS - 1, np.int32)  # the last one: nothing there
    kind[by_use[:OWN]] = np.arange(OWN)
    kind[by_use[OWN:]] = OWN + by_use[OWN:] % (KINDS - 1 - OWN)
    start = start + 0.01
    begins = np.bincount(kind[: size + 1], start, KINDS) + 1e-3
    lm = Lm(fresh(), kind, begins / begins.sum())
    by_code = np.argsort(held["code"].to_numpy())
    maker = Maker(ranks_path, held["code"].to_numpy()[by_code], held["n"].to_numpy()[by_code], start / start.sum(), (head["word"].to_pylist(), head["n"].to_numpy()), texts)
    del held, head, by_code

    # The start: a bounded sample, of whole texts drawn by id and of windows in them.
    part = min(1.0, start_windows / max(1.0, 2.5 * words / HALF))
    few_of = max(part, min(1.0, 20 * part))
    few = taught.filter(F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(1 << 30)) < few_of * (1 << 30))
    first = few.mapInArrow(_start_windows(maker, part / few_of), "w binary").toPandas()
    train(lm, _unpacked(first["w"].map(bytes).tolist()), start_steps)
    sums = taught.mapInArrow(_partition_weights(lm, maker, batch, 0.0012), "chunk int, sum binary, seen long")
    averaged = sums.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_summed, "chunk int, sum binary, seen long").collect()  # the model once
    if averaged:
        lm.p = _averaged(lm, averaged)

    total, kinds = words + texts, distinct + (texts > 0)
    scored = rows.select("doc_id", "text", F.monotonically_increasing_id().alias("_row"))
    scored = scratch.save(scored.mapInArrow(_scored(lm, maker, total, kinds), SCORED), "scored")
    rest = scored.select("_row", F.inline("_rest")).join(counts, "word", "left")
    value = F.col("k") * (F.log10(F.coalesce("n", F.lit(0)) + 1.0) - F.lit(float(np.log10(total + kinds + 1.0))))
    more = rest.groupBy("_row").agg(F.sum(value).alias("_more"), F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("_also"))
    out = scored.drop("_rest").join(more, "_row", "left")
    return out.select("doc_id", "n_tokens", (F.col("_known") + F.coalesce("_also", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("_base") + F.coalesce("_more", F.lit(0.0))).alias("base_score"), "score")
