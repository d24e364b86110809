"""Operators 3, 5, 6, 8, 9 and 10 and the pipeline against plain versions: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pactspark.llm import language, packing, pairwise_rank, quality_rules, transport_stream
from pactspark.llm.queries import VOCABULARY
from pactspark.llm.sharding import shard_bytes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, kept string, score string, size string, rep string"
EN, DE, FR = (s.split() for s in ("the of and to that with from this which there their would", "der die und nicht mit ein auf ist sich werden auch nach", "le la les des une dans pour que avec sur plus cette"))


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(2)
    out = []
    for i in range(90):
        words = (EN, DE, FR)[i % 3]
        good = " ".join(rng.choice(words) + rng.choice(["", "s", "e", ","]) for _ in range(rng.randrange(60, 120)))
        bad = "\n".join([f"BUY {rng.choice(words).upper()} #1 !!! |"] * rng.randrange(14, 30))
        out.append((i, bad if i % 5 == 0 else good, ("en", "de", "fr")[i % 3], f"s{i % 4}"))
    out += [(200, None, "en", None), (201, "", None, "s0"), (202, "½ ² 123 --", "de", "s1"), (203, out[1][1], "de", "s1"), (203, out[1][1], "de", "s1"), (None, out[2][1], "fr", "s1")]
    out += [(204, " ".join(rng.choice(EN) for _ in range(20_000)), "en", "s2"), (205, "a b c\r\na b c\r\n\n \na b c", None, "s3"), (206, "l\u2028x\u00a0y <|endoftext|> $$", "en", "s3")]
    rows = [(*r, "mine", "own", "7", "r") for r in out]
    return rows, spark.createDataFrame(rows, SCHEMA).cache(), spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(90)], "doc_id long, quality int")


def plain_base(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n, hit = Counter(grams), set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            hit |= {i, i + 1, i + 2}
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), failed


def test_rules_count_as_a_plain_version_and_keep_the_good(table):
    rows, docs, labels = table
    got = quality_rules.apply_rules(docs, quality_rules.fit_rules(docs, labels), prefix="_q_").collect()
    assert len(got) == len(rows) and all((r["kept"], r["score"], r["size"]) == ("mine", "own", "7") for r in got)
    for r in got:
        assert tuple(r[f"_q_{n}"] for n in (*quality_rules.BASE, "base_failed")) == plain_base(r["text"])
        assert not (r["_q_kept"] and r["_q_base_failed"])
    verdict = {r["doc_id"]: r["_q_kept"] for r in got}
    assert sum(verdict[i] for i in range(90) if i % 5) >= 70 and not any(verdict[i] for i in range(0, 90, 5))
    assert quality_rules.apply_rules(docs.limit(0), quality_rules.fit_rules(docs.limit(0), labels)).count() == 0


def test_ranker_tells_held_out_documents(table):
    rows, docs, labels = table
    ranker = pairwise_rank.fit_quality(docs, labels.filter("doc_id % 2 = 0"))
    got = {r["doc_id"]: r for r in pairwise_rank.apply_quality(docs, ranker, prefix="_r_").collect()}
    held = [i for i in range(90) if i % 2]
    assert sum(got[i]["_r_predicted"] == int(i % 5 != 0) for i in held) >= 0.9 * len(held)
    assert all(0 <= r["_r_score"] <= 1 and r["_r_predicted"] == int(r["_r_score"] >= 0.5) and r["score"] == "own" for r in got.values())
    assert got[200]["_r_score"] == got[201]["_r_score"] and got[1]["_r_score"] == got[203]["_r_score"]


def test_languages_of_held_out_documents(table):
    rows, docs, _ = table
    got = language.identify(docs.select("doc_id", "text"), language.fit_identifier(docs.filter("doc_id % 2 = 0"))).collect()
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}
    assert len(got) == len(rows) and [by[i] for i in (200, 201, 202)] == [("und", 0.0)] * 3
    held = [i for i in range(90) if i % 2 and i % 5]
    assert sum(by[i][0] == ("en", "de", "fr")[i % 3] for i in held) >= 0.95 * len(held)
    assert by[1] == by[203] and by[204][0] == "en" and all(0 <= s <= 1 for _, s in by.values())


def test_shards_as_a_plain_version(table):
    rows, docs, _ = table
    got = shard_bytes(docs, shards=5).collect()
    want = sorted((str(r[0]), len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_many_equal_rows_spread_evenly(spark):
    docs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.col("id")).alias("doc_id"), F.lit("the same text").alias("text"))
    sizes = [r["count"] for r in shard_bytes(docs, shards=8, ranges_per_shard=4).groupBy("shard").count().collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 4


def test_packed_pieces_hold_each_id_once(table):
    rows, docs, _ = table
    slow = Tokenizer.from_file(VOCABULARY[0])
    ids = Counter((r[0], tuple([*slow.encode(r[1] or "", add_special_tokens=False).ids, 1])) for r in rows)
    whole = {own: each for own, each in ids}
    sequences = packing.pack(docs.repartition(3), *VOCABULARY, width=512, open_windows=8, pad_id=3)
    got = packing.pieces(sequences).collect()
    seen, filled = Counter(), defaultdict(list)
    for r in got:
        part = whole[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["doc_tokens"] == len(whole[r["doc_id"]]) and len(part) == r["length"]
        assert r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
        seen[r["doc_id"]] += r["length"]
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
        assert bytes(r["ids"]) == b"".join(i.to_bytes(4, "little") for i in part)
    assert seen == Counter({own: sum(len(e) * n for (o, e), n in ids.items() if o == own) for own in whole})
    for pieces in filled.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 512
    assert sum(seen.values()) >= 0.9 * 512 * len(filled)
    whole_windows = sequences.collect()
    assert sorted(r["sequence_id"] for r in whole_windows) == sorted(filled)
    for r in whole_windows:
        held, tokens = bytes(r["ids"]), r["tokens"]
        assert tokens == sum(p["length"] for p in r["pieces"])
        assert len(held) == 4 * (tokens if tokens & (tokens - 1) == 0 else 512)
        assert held[4 * tokens :] == (3).to_bytes(4, "little") * (len(held) // 4 - tokens)


def test_media_as_a_plain_version(table):
    rows, docs, _ = table
    media = transport_stream.store_media(docs)
    got = defaultdict(set)
    for r in transport_stream.media_features(media).collect():
        got[r["doc_id"]].add(tuple(r)[1:])
    for own, text, *_ in rows:
        raw = (text or "").encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        stored = transport_stream.mux(padded)
        assert len(got[own]) == 1 and next(iter(got[own]))[:6] == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]), len(stored), hashlib.sha256(stored).hexdigest())
    long = media.filter("doc_id = 204").first()
    assert [p["random_access"] for p in long["points"]][0] and all(long["media"][p["packet"] * 188] == 0x47 for p in long["points"])


def test_empty_tables(table):
    _, docs, _ = table
    empty = docs.limit(0)
    assert packing.pack(empty, *VOCABULARY).count() == 0 == transport_stream.store_media(empty).count()
    assert language.identify(empty, language.fit_identifier(empty)).count() == 0


def test_every_stage_keeps_the_columns_and_rows_it_should(spark, table, tmp_path):
    rows, docs, labels = table
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    now, before = spark.read.parquet(f"{tmp_path}/documents.parquet"), Counter(rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, str(tmp_path)).collect(), SCHEMA)
        after = Counter(map(tuple, now.collect()))
        assert now.columns == docs.columns and set(after) <= set(before), name
        assert (all(n <= before[r] for r, n in after.items()) if name != "mixing" else all(n <= 2 * before[r] for r, n in after.items())), name
        if name in ("quality_rules", "quality_classifier"):
            assert sum(r[0] is not None and r[0] < 90 and r[0] % 5 > 0 for r in after) >= 70 and not any(r[0] in range(0, 90, 5) for r in after), name
        if name == "near_dedup":
            assert sum(n for r, n in after.items() if r[1] == rows[1][1]) == 1 and {r[1] for r in after} == {r[1] for r in before}
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == {r[0] for r in before}


def test_the_ranker_s_fit_is_small_on_the_driver():
    rng = np.random.default_rng(2)
    x, y = rng.random((20_000, 18)), (rng.random(20_000) < 0.8).astype(int)
    tracemalloc.start()
    try:
        pairwise_rank.fit_ranker(x, y)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 80e6  # all pairs at once take 230 MB


def test_the_ranker_is_the_same_in_blocks_of_any_size():
    rng = np.random.default_rng(3)
    x = rng.random((500, 6))
    y = (x[:, 0] + 0.1 * rng.standard_normal(500) > 0.3).astype(int)
    whole, cut = (pairwise_rank.fit_ranker(x, y, pairs=3000, block=n) for n in (3000, 7))
    assert np.allclose(whole.weights, cut.weights, rtol=1e-8) and np.isclose(whole.threshold, cut.threshold)
