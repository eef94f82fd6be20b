"""MinHash near-duplicate detection with an LSH forest.

Each distinct shingle set gets ``TREES * DEPTH`` MinHash values, cut into one label of ``DEPTH``
values of 16 bits per tree. A tree is one sorted order of all labels, dealt by range over the
tasks. Neighbours in an order that share at least ``LEAST`` leading values are candidates, the
``WINDOW`` next ones of each row: where labels crowd, the window holds those with the longest
common prefixes, so the depth adapts to the region. A region (rows with the same ``LEAST``
leading values) that is wider than the window or touches the edge of a task is noted. After the
first links are merged, those noted regions that still hold several components are descended: a
region of more than ``CELL_BYTES`` of shingle sets is parted by the next label value, and so on to
``DEPTH``; a cell that is still larger then is compared block against block. So no candidate of
the forest is lost, no task holds more than two blocks, and the cost of a crowd falls with each
value by which it is parted. Exact copies collapse before, by a 128-bit hash of the set, and links
are confirmed on full shingle sets.

Recall of the candidates: a pair of similarity s shares ``DEPTH`` values in some tree with
probability 1 - (1 - s ** DEPTH) ** TREES, which is 0.99996 at 0.85 and 0.997 at 0.80, and
``LEAST`` values, all that a region which is not crowded asks for, with more than 0.99993.

Defined results: null, empty or blank texts have the empty set and link with nothing; rows that
repeat a doc_id are returned once each, every row with the component of its own text; rows without
doc_id get null component_id and are kept, and no other row links through them; an empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from .common import Scratch, broadcast_if_small, chunks, mix, shingle_sets, slices

TREES, DEPTH, LEAST, WINDOW = 32, 8, 6, 8
HASHES = TREES * DEPTH
#: Of a sketch of one bit per hash, how many bits must agree before a pair is confirmed on full sets:
#: at similarity 0.85, 236.8 of 256 agree with a deviation of 4.2, so 218 is 4.3 deviations below.
AGREE_SHARE, DEVIATIONS = 0.5, 4.3
#: Shingle sets of a cell or block, in bytes; a longer set is a block of its own.
CELL_BYTES = 2 << 20
#: Tables of ids or links are dealt to this share of the shuffle's tasks.
NARROW = 16

_rng = np.random.Generator(np.random.PCG64(77001))
_XOR = _rng.integers(0, 1 << 32, (HASHES, 1), dtype=np.uint32)
_MUL = _rng.integers(0, 1 << 31, (HASHES, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SIGNATURE = "doc_id long, n_shingles long, h1 long, h2 long, labels binary, sketch binary"


def _least_agree(similarity: float) -> int:
    p = similarity + (1 - similarity) * AGREE_SHARE
    return int(HASHES * p - DEVIATIONS * (HASHES * p * (1 - p)) ** 0.5)


def _minhash(shingles: np.ndarray) -> np.ndarray:
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 1024):
        x = low[at : at + 1024] ^ _XOR
        x *= _MUL
        np.minimum(best, x.min(axis=1), out=best)
    return best * np.uint32(0x9E3779B1)  # the least values are small: spread them


def _labels(signature: np.ndarray) -> bytes:
    return (signature >> np.uint32(16)).astype(">u2").tobytes()


def _sketch(signature: np.ndarray) -> bytes:
    return np.packbits(((signature >> np.uint32(15)) & np.uint32(1)).astype(np.uint8)).tobytes()


def signatures(docs: DataFrame, width: int = 5) -> DataFrame:
    """Per row: doc_id, set size, 128-bit set hash, tree labels and sketch (null for the empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            rows: list[tuple] = []
            for part in chunks(texts):
                for s in shingle_sets(part, width):
                    if not len(s):
                        rows.append((0, None, None, None, None))
                        continue
                    sig = _minhash(s)
                    with np.errstate(over="ignore"):
                        h1 = int(mix(s).sum().astype(np.int64))
                        h2 = int(mix(s ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum().astype(np.int64))
                    rows.append((len(s), h1, h2, _labels(sig), _sketch(sig)))
            n, h1, h2, labels, sketch = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(labels, pa.binary()), pa.array(sketch, pa.binary())],
                names=["doc_id", "n_shingles", "h1", "h2", "labels", "sketch"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _SIGNATURE)


def sets_of(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id and the sorted distinct shingle hashes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            at = 0
            for part in chunks(texts):
                found = list(shingle_sets(part, width))
                offsets = np.zeros(len(found) + 1, np.int32)
                np.cumsum([len(s) for s in found], out=offsets[1:])
                values = pa.array(np.concatenate(found).view(np.int64)) if found else pa.array([], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.ListArray.from_arrays(pa.array(offsets), values)], names=["id", "shingles"])
                at += len(part)

    return docs.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(run, "id long, shingles array<long>")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    start = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], np.uint8)[start : start + len(column) * width].reshape(-1, width)


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return HASHES - np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


def forest(reps: DataFrame) -> DataFrame:
    """One row per tree and distinct set: tree, label, id, sketch."""
    size = DEPTH * 2
    trees = F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), F.substring("labels", 1 + size * t, size).alias("label")) for t in range(TREES)]))
    return reps.select("id", "sketch", trees.alias("t")).select("t.tree", "t.label", "id", "sketch")


def _neighbours(least: int):
    prefix = LEAST * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, ...] | None = None
        edge: tuple[int, bytes] | None = None

        def out(a=(), b=(), agree=(), regions=()):
            n, m = len(a), len(regions)
            none = [None]
            return pa.RecordBatch.from_arrays(
                [pa.array([*a, *none * m], pa.int64()), pa.array([*b, *none * m], pa.int64()), pa.array([*agree, *none * m], pa.int32()), pa.array([*none * n, *[r[0] for r in regions]], pa.int32()), pa.array([*none * n, *[r[1] for r in regions]], pa.binary())],
                names=["a", "b", "agree", "tree", "prefix"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            tree = batch.column(0).to_numpy(zero_copy_only=False)
            lead = np.ascontiguousarray(_matrix(batch.column(1), DEPTH * 2)[:, :prefix])
            ids = batch.column(2).to_numpy(zero_copy_only=False)
            sketch = np.ascontiguousarray(_matrix(batch.column(3), HASHES // 8)).view(np.uint64)
            fresh = 0
            if held is not None:
                fresh = len(held[0])
                tree, lead, ids, sketch = (np.concatenate(x) for x in zip(held, (tree, lead, ids, sketch), strict=True))
            key = lead.view(np.uint32)
            regions: set[tuple[int, bytes]] = set()
            if edge is None:
                regions.add((int(tree[0]), lead[0].tobytes()))
            edge = (int(tree[-1]), lead[-1].tobytes())
            found_a, found_b, found_n = [], [], []
            for o in range(1, WINDOW + 2):
                if len(ids) <= o:
                    break
                low = max(0, fresh - o)
                left, right = slice(low, len(ids) - o), slice(low + o, len(ids))
                same = np.flatnonzero((tree[left] == tree[right]) & (key[left] == key[right]).all(axis=1)) + low
                if o > WINDOW:
                    regions.update((int(tree[i]), lead[i].tobytes()) for i in same)
                    continue
                agree = _agreement(sketch[same], sketch[same + o])
                ok = agree >= least
                found_a.append(ids[same[ok]])
                found_b.append(ids[same[ok] + o])
                found_n.append(agree[ok])
            if found_a:
                a, b, n = np.concatenate(found_a), np.concatenate(found_b), np.concatenate(found_n)
                yield out(np.minimum(a, b), np.maximum(a, b), n, sorted(regions))
            elif regions:
                yield out(regions=sorted(regions))
            held = (tree[-WINDOW - 1 :], lead[-WINDOW - 1 :], ids[-WINDOW - 1 :], sketch[-WINDOW - 1 :])
        if edge is not None:
            yield out(regions=[edge])

    return run


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, comp): the smallest id reachable over ``edges`` (a, b), by alternating large and small stars.

    Every step is a partially aggregated minimum and a join that adaptive execution may split;
    the result of each round is a written table, so recovery never replays more than one round.
    """
    links = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    step, before = 0, None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        step += 1
        links = scratch.write(small, f"{name}-{step}", NARROW)
        state = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if step > 1:
            scratch.drop(f"{name}-{step - 1}")
        if state == before:
            break
        before = state
    # a star forest: every u points at its root
    return links.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(links.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    shared = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("n"))
    return shared.where(100 * F.col("n").cast("long") >= percent * (F.col("na") + F.col("nb") - F.col("n"))).select("a", "b")


def _with_components(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Those of the pairs that still lie in different components."""
    ca = comps.select(F.col("id").alias("a"), F.col("comp").alias("ca"))
    cb = comps.select(F.col("id").alias("b"), F.col("comp").alias("cb"))
    return pairs.join(ca, "a", "left").join(cb, "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).drop("ca", "cb")


def _mixed(reps: DataFrame, regions: DataFrame, comps: DataFrame, scratch: Scratch) -> DataFrame:
    """tree, cell, id, comp, blocks: the rows of noted regions that hold more than one component, in cells.

    A cell is the shortest label prefix, from ``LEAST`` values on, whose sets fit ``CELL_BYTES``, or
    the whole label; ``blocks`` is over 1 only for whole labels that don't fit.
    """
    prefix = lambda k: F.substring("label", 1, k * 2)
    rows = forest(reps).select("tree", prefix(LEAST).alias("cell"), "label", "id").join(regions.withColumnRenamed("prefix", "cell"), ["tree", "cell"])
    rows = rows.join(comps, "id", "left").join(reps.select("id", F.col("n_shingles").alias("n")), "id").withColumn("comp", F.coalesce("comp", "id"))
    held = []
    for k in range(LEAST, DEPTH + 1):
        # read twice, for the sums and for the rows
        rows = rows.persist(StorageLevel.DISK_ONLY)
        held.append(rows)
        # a cell without two components has nothing to compare, at any depth
        sums = rows.groupBy("tree", "cell").agg(F.sum(F.col("n") * 8).alias("bytes"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
        rows = rows.drop("bytes").join(sums.select("tree", "cell", "bytes"), ["tree", "cell"])
        if k < DEPTH:
            rows = rows.withColumn("cell", F.when(F.col("bytes") > CELL_BYTES, prefix(k + 1)).otherwise(F.col("cell")))
    mixed = scratch.write(rows.select("tree", "cell", "id", "comp", F.ceil(F.col("bytes") / CELL_BYTES).cast("int").alias("blocks")), "mixed", NARROW)
    for x in held:
        x.unpersist()
    return mixed


def _rest(mixed: DataFrame, sets: DataFrame, sketches: DataFrame, least: int, percent: int) -> DataFrame:
    """Links between different components of a cell, block against block.

    A pair is compared in the first tree whose cell it shares, first by sketch, then on full sets;
    of the links in a block only those that join what earlier ones have not joined are returned, so
    a block returns fewer links than it has rows.
    """
    # of each document, the cells it is in, tree by tree: at most TREES of them
    cells = mixed.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("tree", F.xxhash64("tree", "cell")))).alias("in"))
    places = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.coalesce(F.element_at("in", t), F.lit(0)))
    details = sketches.join(cells.select("id", places.alias("places")), "id").join(sets, "id")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = mixed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("tree", "cell", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "id", "comp").join(details, "id")

    def compare(table: pa.Table) -> pa.Table:
        column = lambda name: table[name].to_numpy()
        lists = lambda name: (lambda x: (x.offsets.to_numpy(), x.values.to_numpy()))(table[name].combine_chunks())
        ids, comp, part, tree = column("id"), column("comp"), column("own"), table["tree"][0].as_py()
        sketch = np.ascontiguousarray(_matrix(table["sketch"].combine_chunks(), HASHES // 8)).view(np.uint64)
        offsets, values = lists("places")
        earlier = values[offsets[0] : offsets[-1]].reshape(len(ids), TREES)[:, :tree]
        offsets, values = lists("shingles")
        sizes = np.diff(offsets)
        joined = {c: c for c in comp.tolist()}

        def root(c: int) -> int:
            while joined[c] != c:
                joined[c] = joined[joined[c]]
                c = joined[c]
            return c

        found_a, found_b = [], []
        a_rows, b_rows = np.flatnonzero(part == table["lo"][0].as_py()), np.flatnonzero(part == table["hi"][0].as_py())
        for i in a_rows:
            others = b_rows[comp[b_rows] != comp[i]]
            others = others[_agreement(sketch[others], sketch[i]) >= least]
            # sizes alone bound the similarity
            low, high = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
            others = others[100 * low >= percent * high]
            others = others[~((earlier[others] == earlier[i]) & (earlier[i] != 0)).any(axis=1)]
            for j in others.tolist():
                a, b = root(int(comp[i])), root(int(comp[j]))
                if a == b:
                    continue
                both = np.concatenate((values[offsets[i] : offsets[i + 1]], values[offsets[j] : offsets[j + 1]]))
                both.sort()
                n = int((both[1:] == both[:-1]).sum())
                if 100 * n >= percent * (len(both) - n):
                    joined[max(a, b)] = min(a, b)
                    found_a.append(min(ids[i], ids[j]))
                    found_b.append(max(ids[i], ids[j]))
        return pa.table({"a": pa.array(found_a, pa.int64()), "b": pa.array(found_b, pa.int64())})

    return dealt.groupBy("tree", "cell", "lo", "hi").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5, small_rows: int = 1_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    least = _least_agree(percent / 100)
    signed = scratch.write(signatures(docs, width), "signed")
    classes = signed.where("h1 is not null and doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("id"), F.min("n_shingles").alias("n_shingles"), F.min("labels").alias("labels"), F.min("sketch").alias("sketch"))
    reps = scratch.write(classes, "reps")
    order = forest(reps).repartitionByRange("tree", "label", "id").sortWithinPartitions("tree", "label", "id")
    # what is read only while this function runs is kept on the executors' disks and computed again where one is lost
    near = order.mapInArrow(_neighbours(least), "a long, b long, agree int, tree int, prefix binary").persist(StorageLevel.DISK_ONLY)
    pairs = scratch.write(near.where("a is not null and a <> b").groupBy("a", "b").agg(F.max("agree").alias("agree")), "pairs", NARROW)
    regions = near.where("prefix is not null").select("tree", "prefix").distinct()

    def need(ids: DataFrame, name: str) -> DataFrame:
        ids = scratch.write(ids.distinct(), f"{name}-ids", NARROW)
        found = sets_of(docs.select(F.col("doc_id").cast("long"), "text").join(broadcast_if_small(ids, small_rows), "doc_id", "left_semi"), width)
        return scratch.write(found, name)

    def link(found: DataFrame, name: str) -> DataFrame:
        # dealt anew, so that the comparing tasks don't each write a file of a few links
        return scratch.write(found.groupBy("b", "a").agg(F.count("*").alias("n")).select("a", "b"), name, NARROW)

    # the likeliest partner of each document first: most groups merge on these alone; each end is reduced
    # to a row per document before both are put together, so that no pair is doubled
    best = lambda end: pairs.groupBy(F.col(end).alias("node")).agg(F.max(F.struct("agree", "a", "b")).alias("pair"))
    first = scratch.write(best("a").unionByName(best("b")).groupBy("node").agg(F.max("pair").alias("pair")).select("pair.a", "pair.b").distinct(), "first", NARROW)
    # every document of a pair is in one of these too
    sets = need(first.select(F.col("a").alias("doc_id")).unionByName(first.select(F.col("b").alias("doc_id"))), "sets")
    links = link(confirm(first, sets, percent), "links-1")
    comps = components(links, scratch, "comp1")
    second = scratch.write(_with_components(pairs.join(first, ["a", "b"], "left_anti"), comps), "second", NARROW)
    if not second.isEmpty():
        links = links.unionByName(link(confirm(second, sets, percent), "links-2"))
        comps = components(links, scratch, "comp2")
    mixed = _mixed(reps, regions, comps, scratch)
    near.unpersist()
    if not mixed.isEmpty():
        sets = need(mixed.select(F.col("id").alias("doc_id")), "sets-3")
        rest = link(_rest(mixed, sets, reps.select("id", "sketch"), least, percent), "links-3")
        if not rest.isEmpty():
            links = links.unionByName(rest)
            comps = components(links, scratch, "comp3")
    scratch.drop("pairs", "sets-ids", "sets", "first", "second", "mixed", "sets-3-ids", "sets-3", "links-1", "links-2", "links-3")
    labelled = reps.select("h1", "h2", "id").join(comps, "id", "left").select("h1", "h2", F.coalesce("comp", "id").alias("comp"))
    joined = signed.select("doc_id", "n_shingles", "h1", "h2").join(labelled, ["h1", "h2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
