"""MinHash near-duplicate detection with an LSH forest.

Every distinct shingle set gets a signature of ``TREES * STEP`` minima. Tree t
orders the sets by the signature read from position ``STEP * t`` on. Sets that
share the first STEP values of that order form a region. The rows of all regions
are sorted in their order, over the whole cluster, and each set's neighbours
there, those it shares the longest prefixes with, are candidates if their
signatures agree; so the depth adapts to how crowded a region is. Regions that
then still hold several components are compared in full: all pairs of members of
different components whose signatures agree, small regions at once, hot ones in
blocks of at most about ``block`` sets, of like sizes only. Every candidate is
confirmed on the full sets before it links.

Scale: equal sets are collapsed by an aggregate before anything else; only keys
shared by two sets or more travel on; a hot region is never gathered: it is
aggregated to (size, first member), range-partitioned by its order, and what is
not linked then is compared in blocks dealt over the tasks, whose comparisons grow with the square of the sets that its first
member doesn't account for; components come from
large-star/small-star rounds whose hot vertices meet only joins that adaptive
execution can split. Nothing about documents reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactspark.llm import scratch
from pactspark.llm.words import WordHashes, mix64, shingle_set, split_words

TREES, STEP, WIDE = 24, 4, 1024
SIZE = TREES * STEP
_RNG = np.random.default_rng(20240607)
_A = (_RNG.integers(0, 2**31, SIZE, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[None, :]
_B = _RNG.integers(0, 2**32, SIZE, dtype=np.uint32)[None, :]
_WIDE_A = (_RNG.integers(0, 2**31, WIDE, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[None, :]
_WIDE_B = _RNG.integers(0, 2**32, WIDE, dtype=np.uint32)[None, :]


def _minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima of 32-bit affine permutations, in blocks so that a long text needs no large matrix."""
    low = np.full(a.shape[1], 0xFFFFFFFF, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(low, (x[at : at + 1024, None] * a + b).min(axis=0), out=low)
    return low


def signature(shingles: np.ndarray) -> np.ndarray:
    return _minima(shingles, _A, _B)


def wide_signature(shingles: np.ndarray) -> np.ndarray:
    """WIDE further minima, of which 8 bits each are kept."""
    return (_minima(shingles, _WIDE_A, _WIDE_B) & np.uint32(255)).astype(np.uint8)


def _sketches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            ids, counts, keys, signatures = batch.column(0), [], [], []
            for text in batch.column(1):
                s = shingle_set(cache.of(split_words(text.as_py())), k)
                counts.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                signatures.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary())], names=["doc_id", "n_shingles", "set_key", "sig"])

    return run


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, SIZE)


def _keys(sig: np.ndarray, tree: int, depth: int) -> np.ndarray:
    """One 64-bit key of the tree and the first ``depth`` values in its order."""
    at = range(tree * STEP, tree * STEP + depth)
    key = np.full(len(sig), tree * 131 + depth, np.uint64)
    for j in at:
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, j])
    return key.view(np.int64)


def _first_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sig, reps = _signatures(batch.column(1)), batch.column(0)
        for tree in range(TREES) if len(sig) else ():
            yield pa.RecordBatch.from_arrays([reps, pa.array(np.full(len(sig), tree, np.int32)), pa.array(_keys(sig, tree, STEP))], names=["rep", "tree", "key"])


def _ordered_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, order, rep): per tree, the signature's low bytes read from the tree's position on."""
    for batch in batches:
        if not batch.num_rows:
            continue
        low, reps = _signatures(batch.column(1)).astype(np.uint8), batch.column(0).to_numpy()
        flat, lens = pc.list_flatten(batch.column(2)), pc.list_value_length(batch.column(2)).to_numpy()
        rows = np.repeat(np.arange(len(reps)), lens)
        trees, keys = flat.field(0).to_numpy(), flat.field(1).to_numpy()
        order = low[rows[:, None], (trees[:, None] * STEP + np.arange(SIZE)[None, :]) % SIZE]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.FixedSizeBinaryArray.from_buffers(pa.binary(SIZE), len(rows), [None, pa.py_buffer(order.tobytes())]).cast(pa.binary()), pa.array(reps[rows])], names=["key", "order", "rep"])


def _with_regions(rows: DataFrame) -> DataFrame:
    """Rows whose key at least two sets share, with the region's size and first member."""
    regions = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("pivot")).filter("n > 1")
    return rows.join(regions, "key")


def _neighbours(least: int, reach: int):
    """In sorted (key, order, rep) rows: the pairs of a region of which one is among the ``reach`` before the other, and whose signatures agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = (batch.column(0).to_numpy(), np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, SIZE), batch.column(2).to_numpy())
            key, order, rep = (np.concatenate(x) for x in zip(before, now, strict=True)) if before else now
            new = len(rep) - batch.num_rows
            a, b = [], []
            for back in range(1, min(reach, len(rep) - 1) + 1):
                i = np.arange(max(new, back), len(rep))
                i = i[key[i] == key[i - back]]
                i = i[(order[i] == order[i - back]).sum(axis=1) >= least]
                a.append(np.minimum(rep[i], rep[i - back]))
                b.append(np.maximum(rep[i], rep[i - back]))
            before = (key[-reach:], order[-reach:], rep[-reach:])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b)], names=["a", "b"])

    return run


def _agreeing(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                same = (_signatures(batch.column(2)) == _signatures(batch.column(3))).sum(axis=1)
                yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(same >= least))

    return run


def _sets(k: int, of: Callable[[np.ndarray], np.ndarray], name: str):
    """(rep, ``of`` its set as bytes) from (rep, text, set_key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            out: tuple[list, list] = ([], [])
            for rep, text, key in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                s = shingle_set(cache.of(split_words(text.as_py())), k)
                if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == key.as_py():
                    out[0].append(rep.as_py())
                    out[1].append(of(s).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary())], names=["rep", name])

    return run


def _linked(per_cent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yes = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if 100 * min(len(p), len(q)) < per_cent * max(len(p), len(q)):
                    yes.append(False)
                    continue
                at = np.searchsorted(q, p)
                at[at == len(q)] = 0
                both = int((q[at] == p).sum())
                yes.append(100 * both >= per_cent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(yes, pa.bool_()))

    return run


def _first_tree(sig: np.ndarray, one: np.ndarray) -> np.ndarray:
    """The first tree in which each signature shares a region with ``one``: there, and nowhere else, the pair is given."""
    return (sig == one).reshape(-1, TREES, STEP).all(axis=2).argmax(axis=1)


def _across(least: int, least_wide: int):
    """In runs of one region (at most the region bound), the pairs of different components whose signatures agree, the wide ones too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def pairs(rows: list[tuple]) -> tuple[list, list]:
            a, b = [], []
            sig = np.frombuffer(b"".join(r[3] for r in rows), np.uint32).reshape(-1, SIZE)
            wide = np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(-1, WIDE)
            comp = np.array([r[2] for r in rows], np.int64)
            reps = np.array([r[1] for r in rows], np.int64)
            for i in range(1, len(rows)):
                hit = np.flatnonzero((comp[:i] != comp[i]) & ((sig[:i] == sig[i]).sum(axis=1) >= least))
                hit = hit[(wide[hit] == wide[i]).sum(axis=1) >= least_wide]
                hit = hit[_first_tree(sig[hit], sig[i]) == rows[0][5]]
                a.extend(np.minimum(reps[hit], reps[i]).tolist())
                b.extend(np.maximum(reps[hit], reps[i]).tolist())
            return a, b

        def batch_of(found: tuple[list, list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[-1][0] != row[0]:
                    yield batch_of(pairs(held))
                    held = []
                held.append(row)
        if held:
            yield batch_of(pairs(held))

    return run


def _between(least: int, least_wide: int, per_cent: int):
    """Runs of (key, kind, lo, hi), each of two blocks of a hot region (one where lo = hi and kind = 0): the pairs of different components whose signatures agree, the wide ones too."""

    def pairs(rows: list[tuple], alone: bool) -> tuple[list, list]:
        a, b = [], []
        rows = sorted(rows, key=lambda r: r[6])  # by set size: sets that link lie within a range of it
        side, reps, comp, sizes = (np.array([r[j] for r in rows], np.int64) for j in (4, 5, 7, 6))
        sig = np.frombuffer(b"".join(r[8] for r in rows), np.uint32).reshape(-1, SIZE)
        wide = np.frombuffer(b"".join(r[9] for r in rows), np.uint8).reshape(-1, WIDE)
        low = sig.astype(np.uint8)  # a first look at 8 bits a minimum: never fewer agree than of the whole
        other = np.arange(len(rows)) if alone else np.flatnonzero(side == 1)
        low_o, sizes_o = low[other], sizes[other]
        upto = np.searchsorted(sizes_o, 100 * sizes // per_cent, "right")
        down = np.searchsorted(sizes_o, -(-per_cent * sizes // 100), "left")
        for i in range(len(rows)) if alone else np.flatnonzero(side == 0):
            start, end = max(int(down[i]), i + 1) if alone else int(down[i]), int(upto[i])
            if start >= end:
                continue
            lanes = (low_o[start:end] == low[i]).view(np.uint64)
            same = (lanes.sum(axis=1, dtype=np.uint64) * np.uint64(0x0101010101010101)) >> np.uint64(56)
            hit = other[start + np.flatnonzero(same >= least)]
            hit = hit[comp[hit] != comp[i]]
            hit = hit[(sig[hit] == sig[i]).sum(axis=1) >= least]
            hit = hit[(wide[hit] == wide[i]).sum(axis=1) >= least_wide]
            hit = hit[_first_tree(sig[hit], sig[i]) == rows[0][10]]
            a.extend(np.minimum(reps[hit], reps[i]).tolist())
            b.extend(np.maximum(reps[hit], reps[i]).tolist())
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def found() -> pa.RecordBatch:
            kind, lo, hi = held[0][1:4]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in pairs(held, kind == 0 and lo == hi)], names=["a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[-1][:4] != row[:4]:
                    yield found()
                    held = []
                held.append(row)
        if held:
            yield found()

    return run


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Columns (v, component) for every vertex of ``edges`` (a, b): the smallest id reachable.

    Alternates large-star and small-star until the edges no longer change; each
    round is a table in the shared folder. Raises if ``most_rounds`` don't do.
    """

    def star(directed: DataFrame, small: bool) -> DataFrame:
        low = directed.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        each = directed.join(low, "u")
        if small:
            return each.select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a != b").distinct()
        return each.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()

    edges = scratch.save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "edges")
    print_before = None
    for _ in range(most_rounds):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        both = both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both, small=False)
        edges = scratch.save(star(large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), small=True), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == print_before:
            return edges.select(F.col("a").alias("v"), F.col("b").alias("component")).union(edges.select(F.col("b"), F.col("b")).distinct())
        print_before = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, per_cent: int = 80, region: int = 64, block: int = 4096, reach: int = 3) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_shingles, component_id, kept).

    Links texts with 100 * intersection >= per_cent * union of their distinct
    k-word shingles (A-Z lower-cased). Null and empty texts have no shingles and
    link with nothing. Repeated rows get equal values; where an id has several
    texts, each is judged by itself. A null id gets a null component and is kept.
    Other columns, whatever their names, are not read. An empty table gives none.
    A very long text's shingles are held by one task, its signature in blocks.
    """
    least = int(SIZE * (per_cent / 100 - 0.18))  # over four standard deviations below the threshold
    least_wide = int(WIDE * (per_cent / 100 - 0.05))  # four standard deviations below
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketch = scratch.save(base.mapInArrow(_sketches(k), "doc_id long, n_shingles long, set_key binary, sig binary"), "sketch")
    one = sketch.filter("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles"))
    classes = scratch.save(one.withColumn("rep", F.monotonically_increasing_id()), "classes")  # numbered once, as written
    sigs = classes.select("rep", "sig")

    members = scratch.save(_with_regions(classes.select("rep", "sig").mapInArrow(_first_rows, "rep long, tree int, key long")), "members")

    def from_sets(reps: DataFrame, of: Callable[[np.ndarray], np.ndarray], name: str) -> DataFrame:
        needed = reps.distinct().join(classes.select("rep", F.col("id").alias("doc_id"), "set_key"), "rep")
        texts = base.join(needed, "doc_id").select("rep", "text", "set_key")  # an id may hold other texts too: the key tells
        return scratch.save(texts.mapInArrow(_sets(k, of, name), f"rep long, {name} binary").dropDuplicates(["rep"]), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link on the full sets."""
        sets = from_sets(pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))), lambda s: s, "shingles")
        with_a = pairs.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("p")), "a")
        with_both = with_a.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("q")), "b").select("a", "b", "p", "q")
        return scratch.save(with_both.mapInArrow(_linked(per_cent), "a long, b long"), "links")

    # Sorted orders: what shares the longest prefix stands side by side, however crowded the region is.
    places = members.groupBy("rep").agg(F.collect_list(F.struct("tree", "key")).alias("places"))  # at most one a tree
    ordered = scratch.save(places.join(sigs, "rep").select("rep", "sig", "places").mapInArrow(_ordered_rows, "key long, order binary, rep long"), "ordered")
    ordered = ordered.repartitionByRange("key", "order", "rep").sortWithinPartitions("key", "order", "rep")
    tried = scratch.save(ordered.mapInArrow(_neighbours(least, reach), "a long, b long").distinct(), "pairs")
    links = confirmed(tried)
    found = components(links)

    def split_regions() -> DataFrame:
        """Members, with their components, of the regions that hold several."""
        label = lambda c: found.select(F.col("v").alias(c), F.col("component").alias(f"{c}_of"))
        rows = members.join(label("rep"), "rep", "left").join(label("pivot"), "pivot", "left")
        rows = rows.select("key", "tree", "rep", "n", "pivot", F.coalesce("rep_of", "rep").alias("component"), F.coalesce("pivot_of", "pivot").alias("main"))
        mixed = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi").select("key")
        return scratch.save(rows.join(mixed, "key", "left_semi"), "labelled")

    # What is not yet with its region's first member meets that one before it meets all.
    apart = split_regions().filter("component != main").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    apart = apart.join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("p")), "a").join(sigs.select(F.col("rep").alias("b"), F.col("sig").alias("q")), "b").select("a", "b", "p", "q")
    apart = scratch.save(apart.mapInArrow(_agreeing(least), "a long, b long").join(tried, ["a", "b"], "left_anti"), "pairs")
    if not apart.isEmpty():
        links, tried = links.union(confirmed(apart)), tried.union(apart)
        found = components(links)

    # Regions bound recall: at 80 % about 3 linked pairs in a million share none. So every pair of different components
    # in one region is compared, in small regions at once, in hot ones by blocks.
    labelled = split_regions()
    runs = labelled.filter(F.col("n") <= region).select("key", "tree", "rep", "component")

    # The sets linked with a hot region's first member meet all others there, and the others each other.
    hot = labelled.filter(F.col("n") > region).withColumn("waits", F.col("component") != F.col("main"))
    blocks = hot.groupBy("key").agg(F.ceil(F.count_if("waits") / block).cast("int").alias("waiting"), F.ceil(F.count_if(~F.col("waits")) / block).cast("int").alias("linked"))
    dealt = hot.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("rep"), F.when(F.col("waits"), F.col("waiting")).otherwise(F.col("linked"))).cast("int"))
    unit = lambda kind, lo, hi, side: F.struct(F.lit(kind).alias("kind"), lo.alias("lo"), hi.alias("hi"), side.alias("side"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = F.col("own")
    among = F.transform(upto("waiting"), lambda j: unit(0, F.least(own, j), F.greatest(own, j), (own > j).cast("int")))
    asked = F.transform(upto("linked"), lambda j: unit(1, own, j, F.lit(0)))
    given = F.transform(upto("waiting"), lambda j: unit(1, j, own, F.lit(1)))
    dealt = dealt.select("key", "tree", "rep", "component", F.explode(F.when(~F.col("waits"), given).otherwise(F.concat(among, asked))).alias("unit")).select("key", "tree", "unit.*", "rep", "component")
    dealt = scratch.save(dealt, "dealt")

    # Members of one region are alike without linking: the wide signature keeps most such pairs from the full check.
    wide = from_sets(runs.select("rep").union(dealt.select("rep")), wide_signature, "wide")
    signed = sigs.join(wide, "rep")
    across = runs.join(signed, "rep").select("key", "rep", "component", "sig", "wide", "tree").repartition("key").sortWithinPartitions("key", "rep")
    across = across.mapInArrow(_across(least, least_wide), "a long, b long")
    sized = signed.join(classes.select("rep", "n_shingles"), "rep")
    run_of = ["key", "kind", "lo", "hi"]
    rest = dealt.join(sized, "rep").select(*run_of, "side", "rep", "n_shingles", "component", "sig", "wide", "tree").repartition(*run_of).sortWithinPartitions(*run_of, "side", "rep")
    rest = rest.mapInArrow(_between(least, least_wide, per_cent), "a long, b long")

    more = scratch.save(across.union(rest).distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
    if not more.isEmpty():
        links = links.union(confirmed(more))
        found = components(links)

    # Numbers give way to ids: a component is called by its smallest one.
    linked = scratch.save(classes.select("set_key", "rep", "id").join(found.withColumnRenamed("v", "rep"), "rep").select("set_key", "component", "id"), "linked")
    named = linked.select("set_key", "component").join(linked.groupBy("component").agg(F.min("id").alias("found")), "component")
    alone = classes.join(linked, "set_key", "left_anti").select("set_key", F.col("id").alias("found"))
    joined = sketch.select("doc_id", "n_shingles", "set_key").join(named.select("set_key", "found").union(alone), "set_key", "left")
    return joined.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id")).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
