import math
import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pactspark.llm import attention_lm as A
from pactspark.llm import scratch
from pactspark.llm.words import split_words

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def small(rng, texts=6):
    """A model and windows over a few texts of few ids."""
    words = [b"the", b"of", b"thetion", b"x", b"zebra", b"zebras"]
    pieces = A.Pieces(RANKS)
    ids, lens = pieces.flat(words)
    symbol, contexts = A.grams(ids, lens, pieces.size)
    codes = np.unique(A.gram_codes(symbol, contexts))
    counts = A.Counts(pieces.size, codes[codes >= 0], np.full((codes >= 0).sum(), 3))
    start = np.bincount(ids[np.cumsum(lens) - lens], minlength=pieces.size + 1) + 0.01
    lexicon = A.Lexicon(pieces, counts, start / start.sum(), (words[:3], np.array([5, 4, 3])), texts)
    kind = np.arange(pieces.size + 2, dtype=np.int32) % (A.KINDS - 1)
    kind[-1] = A.KINDS - 1
    begins = np.bincount(kind[:-1], start, A.KINDS) + 1e-3
    p = A.fresh(3)
    p["far"] += 6  # so that the copying head has a part
    lm = A.Lm(p, kind, begins / begins.sum())
    docs = [[words[i] for i in rng.integers(0, len(words), n)] for n in (0, 1, 7, 15, 16, 70)][:texts]
    return lm, lexicon, docs


def test_windows_hold_each_id_once_with_what_stands_before():
    lm, lexicon, docs = small(np.random.default_rng(1))
    numbers, lens = lexicon.numbers(docs)
    ids, first, stat, size = lexicon.spell(numbers, lens)
    x, y, begins, known, owner = A.windows(ids, first, stat, size, lexicon.pieces.size)
    assert (y >= 0).sum() == len(ids) and (y[y >= 0] == ids).all() and begins.sum() == first.sum()
    at = 0
    for d, n in enumerate(size):
        whole = [lexicon.pieces.size, *ids[at : at + n]]
        rows = np.flatnonzero(owner == d)
        for w, row in enumerate(rows):
            lo = w * A.HALF
            mine = [v for v in x[row] if v >= 0]
            assert mine == whole[max(0, lo - A.HALF) : lo + A.HALF][: len(mine)] and len(mine) >= min(len(whole) - max(0, lo - A.HALF), A.HALF)
        at += n


def test_what_follows_a_context_sums_to_one():
    lm, lexicon, _ = small(np.random.default_rng(2))
    size = lexicon.pieces.size
    ids, lens = lexicon.pieces.flat([b"zebras", b"qqq", b"the"])
    _, contexts = A.grams(ids, lens, size)
    every = np.arange(size + 1)
    for c in contexts.T:
        assert lexicon.grams.probability(every, np.repeat(c[:, None], size + 1, 1)).sum() == pytest.approx(1)


def test_probabilities_within_words_equal_a_plain_version():
    rng = np.random.default_rng(9)
    contexts, symbol = rng.integers(0, 5, (3, 60)), rng.integers(0, 9, 60)
    contexts[2, ::4] = -1
    every = A.gram_codes(symbol, contexts)
    for codes in (np.unique(every[:, :30][every[:, :30] >= 0]), np.array([], np.int64)):
        counts = rng.integers(1, 9, len(codes))
        made = A.Counts(8, codes, counts)
        held = dict(zip(codes.tolist(), counts.tolist(), strict=True))
        want = made.alone[symbol]
        for order in every:
            for i, code in enumerate(order.tolist()):
                like = [n for c, n in held.items() if c >> 16 == code >> 16]
                kinds = len(like) or 1
                want[i] = (held.get(code, 0) + kinds * want[i]) / (sum(like) + kinds)
        assert np.allclose(made.probability(symbol, contexts), want)


def test_counts_keep_no_index_beside_the_codes():
    n = 400_000
    codes = np.arange(n, dtype=np.int64) // 3 << 16 | np.arange(n) % 3
    tracemalloc.start()
    try:
        made = A.Counts(10, codes, np.ones(n, np.int32))
        made.probability(np.array([1, 2]), np.array([[4, 5], [6, -1], [7, 8]]))
        assert tracemalloc.get_traced_memory()[0] < 16 * n
    finally:
        tracemalloc.stop()


def test_python_workers_get_small_batches(spark, corpus):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    try:
        A.score_texts(spark.createDataFrame(list(enumerate(corpus[:6])), "doc_id long, text string"), F.lit(True), RANKS, start_steps=2)
        long = spark.range(5000, numPartitions=1).selectExpr("id as doc_id", "repeat('word ', 1000) as text")
        got = [r["n"] for r in long.mapInArrow(sizes, "n long").collect()]
        assert len(got) > 3 and max(got) < 2 * scratch.BATCH
    finally:
        spark.conf.unset(key)


def test_every_next_id_sums_to_one():
    """One place after some text: the probabilities of all ids that may begin a word there and of all that go on sum to 1."""
    lm, lexicon, _ = small(np.random.default_rng(3))
    size = lexicon.pieces.size
    numbers, lens = lexicon.numbers([[b"the", b"zebra", b"the"]])
    ids, first, stat, n = lexicon.spell(numbers, lens)
    at = int(np.flatnonzero(first)[-1])  # after the last word
    x, *_ = A.windows(ids, first, stat, n, size)
    every = np.arange(size + 1, dtype=np.int32)
    _, contexts = A.grams(*lexicon.pieces.flat([b"the"]), size)
    more = lexicon.grams.probability(every, np.repeat(contexts[:, -1:], size + 1, 1))
    prob = 0.0
    for begins, known in ((True, more[size] * lexicon.start), (False, np.where(every < size, more, 0))):
        for part in np.array_split(every, 60):
            y = np.full((len(part), A.HALF), -1, np.int32)
            y[:, at] = part
            k = np.ones((len(part), A.HALF), np.float32)
            k[:, at] = known[part]
            f = np.zeros((len(part), A.HALF), bool)
            f[:, at] = begins
            out, a = lm.forward(lm.ready(), np.repeat(x[:1], len(part), 0), y, f, k, keep=True)
            prob += (a["base"] * a["sink"])[:, at].sum() + (a["copied"][:, at].sum() if begins else 0)  # an id is copied once, however it stands
    assert prob == pytest.approx(1, abs=2e-3)


def test_gradients_follow_differences():
    lm, lexicon, docs = small(np.random.default_rng(4))
    x, y, begins, known, _ = A.windows(*lexicon.spell(*lexicon.numbers(docs)), lexicon.pieces.size)
    _, grads = lm.gradients(lm.ready(), x, y, begins, known)
    rows, values = grads.pop("emb")
    grads["emb"] = np.zeros_like(lm.p["emb"])
    grads["emb"][rows] = values
    rng = np.random.default_rng(5)
    for name, g in grads.items():
        direction = (rng.standard_normal(g.shape) * (np.abs(g) > 0)).astype(np.float32)
        direction *= 0.02 / max(np.abs(direction).max(), 1e-9)
        old, losses = lm.p[name], []
        for sign in (1, -1):
            lm.p[name] = old + sign * direction
            losses.append(lm.gradients(lm.ready(), x, y, begins, known)[0])
        lm.p[name] = old
        told, seen = float((g * direction).sum()), (losses[0] - losses[1]) / 2
        assert abs(told - seen) < 0.15 * max(abs(told), abs(seen)) + 2e-4, name


def test_steps_move_the_tables_with_the_weights_and_do_not_rebuild_them(monkeypatch):
    lm, lexicon, docs = small(np.random.default_rng(8))
    x, y, begins, known, _ = A.windows(*lexicon.spell(*lexicon.numbers(docs)), lexicon.pieces.size)
    built, ready = [], A.Lm.ready
    monkeypatch.setattr(A.Lm, "ready", lambda self: built.append(1) or ready(self))
    trainer = A.Trainer(lm, 0.05)
    losses = [trainer.step(x, y, begins, known) for _ in range(25)]
    assert len(built) <= 1 and losses[-1] < losses[0]
    want = ready(lm)
    trainer.lm.shares(trainer.tables, np.arange(A.KINDS))
    assert all(np.array_equal(trainer.tables[n], want[n]) for n in want)


def test_the_future_is_not_read():
    lm, lexicon, docs = small(np.random.default_rng(6))
    long = docs[5]
    other = [*long[:30], *([b"of"] * 40)]
    got = []
    for text in (long, other):
        x, y, begins, known, _ = A.windows(*lexicon.spell(*lexicon.numbers([text])), lexicon.pieces.size)
        got.append(lm.forward(lm.ready(), x, y, begins, known)[0].ravel())
    shared = int(lexicon.lens[lexicon.numbers([long[:30]])[0][:-1]].sum())
    assert np.allclose(got[0][:shared], got[1][:shared], rtol=1e-4) and not np.allclose(got[0][shared : shared + 9], got[1][shared : shared + 9], rtol=1e-4)


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(7)
    vocabulary = [["the", "dog", "runs", "House"], ["der", "hund", "rennt", "Haus"]]
    texts = [" ".join(vocabulary[i % 2][j] for j in rng.integers(0, 4, 60)) for i in range(60)]
    return [*texts, None, "", " \t\n", texts[0], "unseen½ words\x0bhere", "word " * 20_000]


def test_counts_and_base_score_equal_a_plain_version(spark, corpus):
    docs = spark.createDataFrame([(i if i != 5 else None, t, 1.5, "mine") for i, t in enumerate(corpus)], "doc_id long, text string, score double, learns string")
    learns = F.coalesce(F.col("doc_id"), F.lit(0)) % 3 != 0
    got = A.score_texts(docs, learns, RANKS, start_steps=60, head_words=4).toPandas()
    ids = [i if i != 5 else None for i in range(len(corpus))]
    words = [split_words(t) for t in corpus]
    taught = [w for i, w in zip(ids, words, strict=True) if (i or 0) % 3 != 0]
    c = Counter(w for t in taught for w in [*t, "end"])
    n, v = sum(c.values()), len(c)
    want = sorted((-1 if i is None else i, len(w) + 1, sum(c[x] > 0 for x in [*w, "end"]), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in [*w, "end"]), 3)) for i, w in zip(ids, words, strict=True))
    have = sorted((-1 if r.doc_id != r.doc_id else int(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in got.itertuples())
    assert [h[:4] for h in have] == [w[:4] for w in want]
    assert np.allclose([h[4] for h in have], [w[4] for w in want], rtol=1e-6)
    assert np.isfinite(got.score).all() and (got.score < 0).all()
    by = got.dropna(subset="doc_id").set_index(got.dropna(subset="doc_id").doc_id.astype(int))
    assert by.score[0] == pytest.approx(by.score[63], rel=1e-5)  # equal texts
    held = [i for i in range(60) if i % 3 == 0]
    assert (by.score[held] > by.base_score[held]).mean() > 0.9


def test_nothing_to_learn_from_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = A.score_texts(docs, F.lit(None).cast("boolean"), RANKS, start_steps=2).toPandas().set_index("doc_id")
    assert got.n_known.tolist() == [0, 0] and got.train_tokens.tolist() == [0, 0] and np.isfinite(got.score).all()
    assert got.base_score[1] == pytest.approx(0)
    assert A.score_texts(docs.limit(0), F.lit(True), RANKS, start_steps=2).count() == 0


def test_the_weights_train_on_every_window(spark, corpus, monkeypatch):
    seen = {}
    averaged = A._averaged
    monkeypatch.setattr(A, "_averaged", lambda lm, rows: seen.update({r["chunk"]: r["seen"] for r in rows}) or averaged(lm, rows))
    docs = spark.createDataFrame(list(enumerate(corpus)), "doc_id long, text string").repartition(3)
    A.score_texts(docs, F.col("doc_id") % 3 != 0, RANKS, start_steps=2)
    taught = [split_words(t) for i, t in enumerate(corpus) if i % 3 != 0]
    pieces = A.Pieces(RANKS)
    assert set(seen.values()) == {sum(len(pieces.flat(t)[0]) + 1 for t in taught)}
