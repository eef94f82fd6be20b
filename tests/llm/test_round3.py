"""What round 3 changed in earlier operators, against plain Python written apart from them."""

import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm import toxic_model, toxic_scores

from quarrymark.llm import decontaminate, media, mixing, queries
from quarrymark.scratch import Scratch


@pytest.mark.parametrize("share", [1, 16])
def test_scratch_tables_never_narrow_the_work_below(spark, share):
    def mark(batches):
        from pyspark import TaskContext

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"task": pa.array([TaskContext.get().partitionId()] * batch.num_rows, pa.int64())})

    written = Scratch(spark, "tasks").write(spark.range(0, 240, 1, 12).mapInArrow(mark, "task long"), "t", share)
    assert written.distinct().count() == 12


# ---- media ------------------------------------------------------------------------------------


def slow_codes(payload):
    """Frame by frame: a Hann-windowed spectrum, its three strongest maxima, and for each the nearest one 1, 3 and 8 frames on."""
    x, frames = np.frombuffer(payload, np.uint8).astype(np.float32), []
    for at in range(0, max(1, len(x) - 256 + 1 + (-(len(x) - 256)) % 128), 128):
        part = np.zeros(256, np.float32)
        part[: len(x[at : at + 256])] = x[at : at + 256]
        power = np.abs(np.fft.rfft((part - part.mean()) * np.hanning(256).astype(np.float32))).astype(np.float32)
        tops = [k for k in range(1, 128) if power[k] > power[k - 1] and power[k] >= power[k + 1] and power[k] > 1]
        frames.append(sorted(sorted(tops, key=lambda k: -power[k])[:3]))
    found = []
    for t, own in enumerate(frames):
        for gap in (1, 3, 8):
            for a in own if t + gap < len(frames) and frames[t + gap] else []:
                found.append((t, a << 16 | min(frames[t + gap], key=lambda b: (abs(b - a), b)) << 8 | gap))
    return sorted(found)


def test_codes_equal_a_plain_transform():
    rng = random.Random(2)
    for n in (64, 256, 320, 384, 1280, 6400):
        payload = bytes(rng.randrange(32, 127) for _ in range(n))
        times, codes = media.pair_codes(*media.peaks(payload))
        assert list(zip(times.tolist(), codes.tolist(), strict=True)) == slow_codes(payload)
    gaps = {c & 255 for _, c in slow_codes(payload)}
    assert gaps == {1, 3, 8}


# ---- mixing -----------------------------------------------------------------------------------


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights, goal, free, budget = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, {}, set(sizes), 1.5 * sum(sizes.values())
    while free:
        level = (budget - sum(goal.values())) / sum(weights[s] for s in free)
        over = [s for s in free if weights[s] * level > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            goal[s] = 2 * sizes[s]
            free.discard(s)
    return goal | {s: weights[s] * level for s in free}


def test_op5_meets_its_targets(spark, tmp_path):
    rng = random.Random(7)
    docs = [(k, "w " * rng.choice([1, 2, 3, 10, 40, 200, 900]), rng.choice(["é", "a", "a", "b", "Z", None, "漢"])) for k in range(700)] + [(None, "same text", "a")] * 300
    spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({"size": F.lit(1), "mark": F.lit("x"), "rank": F.lit(0)}).write.parquet(str(tmp_path / "documents.parquet"))
    got, sizes, longest = queries.op5_mix_sources(spark, str(tmp_path)), defaultdict(int), defaultdict(int)
    for _, t, s in docs:
        n = len(t.split())
        sizes[s] += n
        longest[s] = max(longest[s], n)
    want = plain_targets(sizes)
    by_size = {(sizes[s], round(want[s], 6)): s for s in sizes}
    taken = defaultdict(int)
    for r in got.collect():
        s = by_size[r["source_size"], round(r["target"], 6)]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] += r["taken"]
    assert set(taken) == set(sizes)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= min(longest[s] / 2, 0.02 * want[s]) + 1, s


def test_rounding_is_near_for_any_rates(spark):
    rng = random.Random(3)
    rows = []
    for k in range(40):
        cells = [(f"s{k}", size, rng.randrange(1, 4), rng.choice([0.0, 2.0, rng.random(), 2 * rng.random()])) for size in sorted(rng.sample(range(1, 500), rng.randrange(1, 60)))]
        goal = sum(size * n * rate for _, size, n, rate in cells)
        rows += [(*c, goal, 0) for c in [*cells, (f"s{k}", 0, 3, 1.0)]]
    table = spark.createDataFrame(rows, "source string, size long, n long, rate double, target double, source_size long")
    out = defaultdict(lambda: [0, 0.0, 0])
    for r in mixing.rounded(table, 2).collect():
        assert 0 <= r["total"] <= 2 * r["n"] and (r["size"] or not r["total"])
        mine = out[r["source"]]
        out[r["source"]] = [mine[0] + r["total"] * r["size"], r["target"], max(mine[2], r["size"])]
    assert len(out) == 40 and all(abs(got - want) <= longest / 2 + 1e-6 for got, want, longest in out.values())


def test_sources_are_ranked_over_ranges(spark):
    names = [f"s{k}" for k in range(500)] + ["", "Z", "é", "漢", "𐍈", "ﬁ", None]
    rows = spark.createDataFrame([(n, 1) for n in names], "source string, source_size long").repartition(5)
    got = {r["source"]: r["rank"] for r in mixing.ranks(rows, Scratch(spark, "ranks")).collect()}
    want = sorted(names, key=lambda s: (s is None, s or ""))
    assert got == {s: k + 1 for k, s in enumerate(want)}


# ---- decontamination --------------------------------------------------------------------------


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Items of 1 to 400 words, each whole in one document and with a fifth of its shingles broken in another."""
    rng, folder = random.Random(11), tmp_path_factory.mktemp("planted")
    vocabulary = [f"w{k}" for k in range(3000)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items, docs, whole = [], [], set()
    for k, n in enumerate([1, 2, 3, 4, 5, 6, 8, 9, 12, 15, 16, 17, 20, 30, 50, 90, 150, 250, 400] * 12):
        item = [f"{w}i{k}" for w in prose(n)] if n < 5 else prose(n)
        items.append((k, " ".join(item)))
        near = list(item)
        near[0] = near[0] if n < 30 else "broken"  # at the edge: one shingle is lost
        for part in (item, near):
            around = prose(rng.choice([0, 3, 40, 900, 6000]))
            at = rng.randrange(len(around) + 1)
            docs.append((len(docs), " ".join([*around[:at], *part, *around[at:]])))
            whole.add((len(docs) - 1, k))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    spark.createDataFrame(docs, "doc_id long, text string").repartition(6).write.parquet(str(folder / "documents.parquet"))
    return str(folder), whole


def test_planted_items_are_found(spark, planted):
    folder, whole = planted
    got = {(r["doc_id"], r["item_id"]): (r["item_shingles"], r["shared_shingles"]) for r in queries.op6_decontaminate(spark, folder).collect()}
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    rel = con.sql(queries.ORACLES["op6_decontaminate"])
    want = {(r["doc_id"], r["item_id"]): (r["item_shingles"], r["shared_shingles"]) for r in (dict(zip(rel.columns, x, strict=True)) for x in rel.fetchall())}
    assert all(want[k] == v for k, v in got.items()) and whole <= set(want)
    assert len(got) >= 0.995 * len(want)  # candidates come from signatures


def test_fewest_hits_lose_one_case_in_a_thousand(spark):
    from math import ceil, comb

    p = decontaminate.KEPT
    for q, hits in ((r["q"], r["h"]) for r in spark.range(12, 400).select(F.col("id").alias("q"), decontaminate.fewest_hits(F.col("id"), 0.8).alias("h")).collect()):
        n = ceil(0.8 * q - 1e-9)
        assert sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(hits)) < 1.1e-3, q


# ---- toxicity ---------------------------------------------------------------------------------


def test_toxicity_reads_across_white_space_and_scripts(spark):
    words, calm = ["idiot", "moron", "worthless", "grumblefoot"], ["water", "river", "market", "mountain"]
    model = toxic_model(spark, words)
    look = str.maketrans("aeopcxi", "аеорсхі")
    forms = [
        lambda w: ". ".join(w) + ".", lambda w: " ".join(w[k : k + 2] for k in range(0, len(w), 2)), lambda w: f"{w[:2]} {w[2:]}", lambda w: f"{w[:-2]} {w[-2:]}", lambda w: "/".join(w), lambda w: w.translate(look),
        lambda w: "".join(chr(ord(c) + 0xFEE0) for c in w), lambda w: "".join(c + "́" for c in w), lambda w: "​".join(w), lambda w: w.upper().translate(str.maketrans("OI", "ОІ")),
    ]
    tests = [f"the garden {f(w)} window" for f in forms for w in [*words, *calm]]
    out = toxic_scores(spark, model, tests)
    flagged = [x > 0.3 for x in out]
    for k in range(len(forms)):
        mine = flagged[k * 8 : k * 8 + 8]
        assert sum(mine[:4]) >= 3 and not any(mine[4:]), (k, tests[k * 8 : k * 8 + 8], mine)
    # parts of two long words, or across the edges of words, spell nothing
    assert not any(x > 0.3 for x in toxic_scores(spark, model, ["worth less water", "some oron window", "smo ronan", re.sub("x", "", "i dio tic")]))
