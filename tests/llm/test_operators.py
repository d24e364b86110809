"""Each operator against a plain version on small tables: nulls, empty and repeated texts, extra columns."""

import hashlib
import random

import pytest

from pactspark.llm import transport_stream, warc
from pactspark.llm.mixing import mix_sources
from pactspark.llm.near_dedup import near_duplicates
from pactspark.llm.quality_rules import fit_forest
from pactspark.llm.sharding import shard_bytes

SCHEMA = "doc_id long, text string, source string, size int, rep string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    out = [(None, "a b c d e f", "x", 1, "r"), (0, None, None, 1, "r"), (1, "", "x", 1, "r"), (2, "one", "x", 1, "r"), (3, "one", "y", None, None)]
    for i in range(10, 60, 2):
        base = [rng.choice(words) for _ in range(80)]
        near = [*base]
        near[rng.randrange(80)] = "changed"
        out += [(i, " ".join(base), "y", 1, "r"), (i + 1, " ".join(near if i % 4 else base), "z", 1, "r")]
    return out


def shingles(text, k=4):
    words = (text or "").lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def test_near_duplicates_match_brute_force(spark, rows):
    got = {r["doc_id"]: r for r in near_duplicates(spark.createDataFrame(rows, SCHEMA), k=4, per_cent=80).collect()}
    known = [(r[0], shingles(r[1])) for r in rows if r[0] is not None]
    root = {i: i for i, _ in known}
    for _ in known:
        for i, a in known:
            for j, b in known:
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    assert {i: got[i]["component_id"] for i in root} == root
    assert {i: got[i]["n_shingles"] for i in root} == {i: len(s) for i, s in known}
    assert got[None]["component_id"] is None and got[None]["kept"]


def roots_of(known, per_cent=80):
    """Smallest id of each component, by brute force."""
    root = {i: i for i, _ in known}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, a) in enumerate(known):
        for j, b in known[:n]:
            if 100 * min(len(a), len(b)) >= per_cent * max(len(a), len(b)) and 100 * len(a & b) >= per_cent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def test_many_near_copies_of_one_template_match_brute_force(spark):
    rng = random.Random(11)
    template, out = [f"t{i}" for i in range(400)], []
    for i in range(350):  # copies with 7 words replaced, each with a child of 9 more
        one = list(template)
        for at in rng.sample(range(400), 7):
            one[at] = f"a{rng.randrange(10**9)}"
        two = list(one)
        for at in rng.sample(range(400), 9):
            two[at] = f"b{rng.randrange(10**9)}"
        out += [(2 * i, " ".join(one)), (2 * i + 1, " ".join(two))]
    rng.shuffle(out)
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(out, "doc_id long, text string"), k=4).collect()}
    assert got == roots_of([(i, shingles(t)) for i, t in out])


def test_an_id_with_two_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(5, a), (5, b), (7, a + " more"), (8, b + " more"), (3, b)]
    got = sorted((r["doc_id"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect())
    assert got == [(3, 3), (5, 3), (5, 5), (7, 5), (8, 3)]


@pytest.mark.parametrize("block", [4096, 50])
def test_twins_in_a_templated_family_match_brute_force(spark, block):
    rng = random.Random(5)
    template = [f"t{i}" for i in range(170)]
    family = []
    for i in range(300):  # of one template, alike to about 73 %; each with a twin alike to about 83 %
        one = [*template, *(f"u{i}_{j}" for j in range(30))]
        family += [(2 * i, " ".join(one)), (2 * i + 1, " ".join([*one[:-18], *(f"v{i}_{j}" for j in range(18))]))]
    rng.shuffle(family)
    chain = [f"c{i}" for i in range(200)]
    for i in range(12):  # each alike to the next only
        family.append((1000 + i, " ".join([*template, *chain[i * 14 : i * 14 + 28]])))
    root = roots_of([(i, shingles(text)) for i, text in family])
    assert 250 < len(set(root.values())) < 350
    frame = spark.createDataFrame(family, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(frame, k=4, per_cent=80, block=block).collect()}
    assert got == root


def test_shards_have_gapless_slots_and_near_equal_bytes(spark, rows):
    got = shard_bytes(spark.createDataFrame(rows, SCHEMA), shards=4).collect()
    assert len(got) == len(rows)
    total = sum(r["size"] for r in got)
    for shard in range(4):
        own = [r for r in got if r["shard"] == shard]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 4) <= 2 * max(r["size"] for r in got)


def test_mix_is_near_its_targets_and_repeats(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    one = sorted(map(str, mix_sources(frame).select("doc_id", "source", "target", "taken").collect()))
    got = mix_sources(frame).collect()
    assert one == sorted(f"Row(doc_id={r['doc_id']!r}, source={r['source']!r}, target={r['target']!r}, taken={r['taken']!r})" for r in got)
    for source in ("x", "y", "z"):
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 80
    assert all(r["taken"] <= 2 * r["size"] for r in got)


def test_warc_round_trip(spark):
    long = "é" * 700_000
    pages = [(1, "http://a b", "x" * 2000), (2, None, "x" * 2000), (3, "u", None), (4, "u", "short"), (5, "u", "short"), (6, "u", long)]
    got = {r["page_id"]: r for r in warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for page, _, html in pages:
        raw = (html or "").encode()
        assert (got[page]["payload_bytes"], got[page]["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
    assert {p: got[p]["refers_to"] for p in got if got[p]["record_type"] == "revisit"} == {1: 2}


@pytest.mark.parametrize("size", [1, 64, 181, 184, 4000, 300_000])
def test_transport_stream_round_trip(size):
    data = random.Random(size).randbytes(size)
    payload, points = transport_stream.demux(transport_stream.mux(data))
    assert payload == data and points[0][2] and [p[1] for p in points] == sorted(p[1] for p in points)


def test_a_lost_packet_is_noticed():
    stream = transport_stream.mux(bytes(5000))
    with pytest.raises(ValueError, match="continuity"):
        transport_stream.demux(stream[: 188 * 5] + stream[188 * 6 :])


def packet(pid, counter, body, start=False, only_adaptation=False):
    head = bytes([0x47]) + ((0x4000 if start else 0) | pid).to_bytes(2, "big")
    if only_adaptation:
        return head + bytes([0x20 | counter, 183, 0]) + b"\xff" * 182
    if len(body) == 184:
        return head + bytes([0x10 | counter]) + body
    pad = 183 - len(body)
    return head + bytes([0x30 | counter, pad]) + (b"\x00" + b"\xff" * (pad - 1) if pad else b"") + body


def test_streams_of_other_writers_are_read():
    """A network entry, programme information, a section over two packets, a packet sent twice, one without payload, two streams."""
    section, stamp = transport_stream._section, transport_stream._stamp
    pat = b"\x00" + section(0, 1, b"\x00\x00\xe0\x10" + b"\x00\x01\xf0\x00")
    info = bytes([0x0E, 180]) + bytes(180)
    entry = lambda pid: b"\x06" + (0xE000 | pid).to_bytes(2, "big") + b"\xf0\x02\x0a\x00"
    pmt = b"\x00" + section(2, 1, b"\xe1\x00" + (0xF000 | len(info)).to_bytes(2, "big") + info + entry(0x100) + entry(0x101))
    unit = lambda pts, data: b"\x00\x00\x01\xbd" + (len(data) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + stamp(pts) + data
    one = packet(0x100, 3, unit(90, b"first"), start=True)
    stream = packet(0, 0, pat, True) + packet(0x1000, 0, pmt[:184], True) + packet(0x1000, 1, pmt[184:]) + one + one
    stream += packet(0x100, 3, b"", only_adaptation=True) + packet(0x1FFF, 9, bytes(184)) + packet(0x101, 0, unit(5, b"other"), True) + packet(0x100, 4, unit(180, b"second"), True)
    got = transport_stream.read_stream(stream)
    assert {p: [(t, d) for _, t, _, d in units] for p, units in got.items()} == {0x100: [(90, b"first"), (180, b"second")], 0x101: [(5, b"other")]}


def test_forest_keeps_its_monotone_direction():
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.random((400, 2))
    y = ((x[:, 0] + 0.3 * rng.standard_normal(400)) < 0.5).astype(int)
    forest = fit_forest(x, y, np.array([-1, 0]))
    grid = np.stack([np.linspace(0, 1, 50), np.full(50, 0.5)], axis=1)
    assert (np.diff(forest.raw(grid)) <= 1e-9).all()


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(empty).count() == shard_bytes(empty).count() == mix_sources(empty).count() == 0
