"""What is stored between runs, landings as a data source, streams with timers and joins by time."""

import random
from collections import defaultdict
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quarrymark.functions import numbers
from quarrymark.manifest import Conflict, Manifests
from quarrymark.operators import components, history, page_log, scoring, timejoins
from quarrymark.operators.entities import connected_components
from quarrymark.sources import contracts, landed
from quarrymark.streaming import pages as streams
from quarrymark.streaming import timers

START = datetime(2026, 9, 10, 12, tzinfo=UTC)
HOUR = timedelta(hours=1)
PAGE = "url string, final_url string, http_status int, mime_type string, fetched_at timestamp, expires_at timestamp, content_hash string, html string, cleaned_text string, error string"


def plan_of(df):
    return df._jdf.queryExecution().toString()


# ---- manifests, history -------------------------------------------------------------------------


def test_a_version_is_taken_once(spark, tmp_path):
    log = Manifests(spark, str(tmp_path / "m"))
    assert log.latest() == (0, {})
    log.commit(1, {"a": "é"})
    with pytest.raises(Conflict):
        log.commit(1, {"a": 2})
    assert log.latest() == (1, {"a": "é"}) and not [p for p in (tmp_path / "m").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]
    seen = []

    def late(content):
        if not seen:  # another writer comes first
            seen.append(1)
            log.commit(2, content | {"b": 1})
        return content | {"c": 1}

    assert log.change(late) == 3 and log.latest()[1] == {"a": "é", "b": 1, "c": 1}
    assert log.change(lambda content: None) == 3
    log.forget(3)
    assert log.versions() == [3]


def sources(spark, run, *urls):
    return spark.createDataFrame([(run, k, u) for k, u in enumerate(urls)], "run_id string, seq long, url string")


def test_a_save_that_dies_between_tables_shows_the_old_run(spark, tmp_path):
    root = str(tmp_path / "h")
    runs = spark.createDataFrame([("r1", "old")], "run_id string, status string")
    shown = lambda: ({(r["run_id"], r["status"]) for r in history.read(spark, root, "search_runs").collect()}, {r["url"] for r in history.read(spark, root, "sources").collect()})
    assert shown() == (set(), set())
    history.save_run(root, {"search_runs": runs, "sources": sources(spark, "r1", "a", "b")})
    before = ({("r1", "old")}, {"a", "b"})
    assert shown() == before
    broken = sources(spark, "r1", "c").withColumn("seq", F.raise_error(F.lit("executor gone")).cast("long"))
    with pytest.raises(Exception, match="executor gone"):
        history.save_run(root, {"search_runs": runs.withColumn("status", F.lit("new")), "sources": broken})
    assert shown() == before  # its first table was written already
    history.save_run(root, {"search_runs": runs.withColumn("status", F.lit("new")), "sources": sources(spark, "r2", "z")})
    # one save: the run r1 has no sources any more, r2 no row of its own
    assert shown() == ({("r1", "new")}, {"z"})
    assert history.vacuum(spark, root) >= 2 and shown() == ({("r1", "new")}, {"z"})
    with pytest.raises(ValueError):
        history.save_run(root, {"page_cache": runs})


def test_tables_of_the_former_layout_stay_readable(spark, tmp_path):
    sources(spark, "r0", "x").unionByName(sources(spark, "r1", "y")).write.partitionBy("run_id").parquet(str(tmp_path / "sources"))
    history.save_run(str(tmp_path), {"sources": sources(spark, "r1", "new")})
    assert {(r["run_id"], r["url"]) for r in history.read(spark, str(tmp_path), "sources").collect()} == {("r0", "x"), ("r1", "new")}
    assert history.list_sources(spark, str(tmp_path), "r1").count() == 1


# ---- the cache's log ----------------------------------------------------------------------------


def entries(spark, *rows):
    """(url, hours after the start, text) as cache entries that live two hours."""
    return spark.createDataFrame([(u, u, 200, "text/html", START + h * HOUR, START + (h + 2) * HOUR, t, t, t, None) for u, h, t in rows], PAGE)


def test_upserts_touch_their_buckets_and_lookups_read_theirs(spark, tmp_path):
    root = str(tmp_path / "cache")
    urls = [f"https://s{k}.ru/p" for k in range(40)]
    assert page_log.read(spark, root).count() == 0 and page_log.lookup(spark, root, spark.createDataFrame([("a",)], "url string"), START).count() == 0
    first = page_log.upsert(root, entries(spark, *((u, 0, "old") for u in urls), (None, 0, "lost")), buckets=8)
    assert first == list(range(8))
    files = lambda: {str(p) for p in (tmp_path / "cache").rglob("part-*")}
    before = files()
    touched = page_log.upsert(root, entries(spark, (urls[0], 1, "new"), (urls[0], 0.5, "between")))
    assert len(touched) == 1 and all(f"bucket={touched[0]}/" in f for f in files() - before) and before <= files()
    found = page_log.lookup(spark, root, spark.createDataFrame([(urls[0],), (None,)], "url string"), START + HOUR)
    assert [(r["url"], r["html"]) for r in found.collect()] == [(urls[0], "new")]
    assert all(f"bucket={touched[0]}/" in f for f in found.inputFiles())
    expired = page_log.lookup(spark, root, spark.createDataFrame([(u,) for u in urls], "url string"), START + 2.5 * HOUR)
    assert [r["url"] for r in expired.collect()] == [urls[0]]


def test_log_is_latest_wins_through_compaction_and_vacuum(spark, tmp_path):
    root, rng, want = str(tmp_path / "cache"), random.Random(4), {}
    for step in range(6):
        rows = [(f"u{rng.randrange(30)}", rng.randrange(4), f"t{step}-{k}") for k in range(12)]
        best = {}
        for u, h, t in rows:  # within one upsert: the latest, then the least hash
            best[u] = min([best[u], (-h, t)]) if u in best else (-h, t)
        for u, (h, t) in best.items():
            if u not in want or -h >= want[u][0]:
                want[u] = (-h, t)
        page_log.upsert(root, entries(spark, *rows), buckets=4)
        if step == 3:
            assert page_log.compact(spark, root, most=2) and page_log.compact(spark, root, most=2) == []
    got = lambda: {r["url"]: r["html"] for r in page_log.read(spark, root).collect()}
    assert got() == {u: t for u, (_, t) in want.items()}
    before = {r["url"] for r in page_log.read(spark, root, version=1).collect()}
    assert before and before <= set(want)
    assert page_log.vacuum(spark, root) > 0 and page_log.vacuum(spark, root) == 0
    assert got() == {u: t for u, (_, t) in want.items()}


def test_a_repeated_batch_adds_nothing_and_writers_meet(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "cache")
    assert page_log.upsert(root, entries(spark, ("a", 0, "x")), buckets=2, source="s", epoch=0)
    assert page_log.upsert(root, entries(spark, ("a", 1, "y")), source="s", epoch=0) == []
    plain, calls = page_log._write, []

    def slow(rows, root, buckets):
        out = plain(rows, root, buckets)
        if not calls:
            calls.append(1)
            page_log.upsert(root, entries(spark, ("b", 0, "other")))
        return out

    monkeypatch.setattr(page_log, "_write", slow)
    page_log.upsert(root, entries(spark, ("a", 2, "z")), source="s", epoch=1)
    assert {r["url"]: r["html"] for r in page_log.read(spark, root).collect()} == {"a": "z", "b": "other"}


# ---- landings -----------------------------------------------------------------------------------


def landing(spark, path):
    rows = [(f"{k // 3 % 3:02d}" if k % 10 else None, ["сыр", "a/b=c d", None][k % 3 if k % 7 else 2], str(k), START + k * HOUR if k % 4 else None, f"p{k}") for k in range(60)]
    df = spark.createDataFrame(rows, landed.LANDED)
    landed.land(df, path)
    return rows, df


def test_filters_become_requests(spark, tmp_path):
    path = str(tmp_path / "l")
    rows, df = landing(spark, path)
    everything = landed.read_landed(spark, path)
    assert sorted(map(tuple, everything.select("number", "region", "category", "payload").collect()), key=repr) == sorted(((n, r, c, p) for r, c, n, _, p in rows), key=repr)
    assert everything.rdd.getNumPartitions() == len({(r, c) for r, c, *_ in rows})
    for condition in ("region = '01'", "region in ('01', '02') and category = 'сыр'", "category = 'a/b=c d' and payload > 'p3'", "region is null", "region = '09'", "region <> '01'", "number = '7'"):
        got = landed.read_landed(spark, path).where(condition)
        assert sorted(r["number"] for r in got.collect()) == sorted(r["number"] for r in df.where(condition).collect()), condition
    asked = landed.read_landed(spark, path).where("region in ('01', '02') and category = 'сыр'")
    wanted = {(r, c) for r, c, *_ in rows if r in ("01", "02") and c == "сыр"}
    assert asked.rdd.getNumPartitions() == len(wanted) and "region#" not in plan_of(asked).split("== Physical Plan ==")[1].split("BatchScan")[0].split("Filter")[-1]
    assert landed.Request("01", " сыр ", (), 7).parameters() == {"productsearch": "сыр", "perpage": "7", "sort": "-signDate", "customerregion": "01"}


def test_limit_takes_the_newest_of_each_request(spark, tmp_path):
    path = str(tmp_path / "l")
    rows, _ = landing(spark, path)
    groups = defaultdict(list)
    for r, c, n, at, p in rows:
        groups[r, c].append((at is not None, at and at.timestamp(), n, p))
    want = {x[2] for g in groups.values() for x in sorted(g, reverse=True)[:2]}
    assert {r["number"] for r in landed.read_landed(spark, path, limit=2).collect()} == want


def test_contracts_provider_reads_its_requests_alone(spark, tmp_path):
    payload = lambda n, region: '{"contracts": {"total": 1, "data": [{"regNum": "%s", "regionCode": "%s", "products": [{"name": "Сыр мягкий"}], "suppliers": [{"organizationName": "ООО %s", "inn": "7700000000"}]}]}}' % (n, region, n)  # noqa: E731, UP031
    rows = [("66", "сыр", "1", START, payload("1", "66")), ("77", "сыр", "2", START, payload("2", "77")), ("66", "хлеб", "3", START, payload("3", "66"))]
    landed.land(spark.createDataFrame(rows, landed.LANDED), str(tmp_path / "c"))
    found = contracts.landed_contracts(str(tmp_path / "c"), F.lit(START))(spark, scoring.Request("сыр", "Екатеринбург"))
    assert [r["name"] for r in found.suppliers.collect()] == ["ООО 1"]


# ---- streams ------------------------------------------------------------------------------------


def feed(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def run_stream(spark, tmp_path, build, name, schema):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / f"{name}-in"))
    q = timers.start(build(stream), str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-ck"))
    q.awaitTermination()
    return [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]


def test_entries_expire_one_by_one_and_free_their_state(spark, tmp_path):
    schema = "url string, fetched_at timestamp, expires_at timestamp"
    row = lambda u, at, life: (u, START + at * HOUR, START + (at + life) * HOUR)
    build = lambda s: timers.expired_entries(s, "1 hour")
    feed(spark, tmp_path / "e-in", [row("a", 0, 1), row("b", 0, 10), row("a", 0.5, 2), (None, START, START)], schema)
    first = run_stream(spark, tmp_path, build, "e", schema)
    out = lambda: sorted((r["url"], (r["expires_at"] - START.replace(tzinfo=None)) / HOUR) for r in spark.read.parquet(str(tmp_path / "e-out")).collect())
    assert out() == []
    feed(spark, tmp_path / "e-in", [row("c", 6, 1)], schema)  # the watermark comes to hour 5: a's second entry ends
    second = run_stream(spark, tmp_path, build, "e", schema)
    assert out() == [("a", 2.5)]
    feed(spark, tmp_path / "e-in", [row("b", 4, 1), row("b", 5.5, 1), row("c", 9, 1), row("d", 30, 1)], schema)  # the first is late; c's entry had ended when fetched anew
    third = run_stream(spark, tmp_path, build, "e", schema)
    assert out() == [("a", 2.5), ("b", 6.5), ("c", 7.0), ("c", 10.0)]
    assert first[-1] > 0 and second and third[-1] == first[-1] // 2  # of two entries one is left: d's


def test_runs_end_whole_or_at_their_deadline(spark, tmp_path):
    schema = "run_id string, url string, finished_at timestamp, failed boolean, expected int, deadline timestamp"
    row = lambda r, u, at, bad, n, end: (r, u, START + at * HOUR, bad, n, START + end * HOUR)
    build = lambda s: timers.ended_runs(s, "0 seconds")
    feed(spark, tmp_path / "r-in", [row("whole", "b", 1, True, 2, 5), row("whole", "a", 0, False, 2, 5), row("part", "a", 1, True, 3, 5), row("part", "late", 6, False, 3, 5)], schema)
    run_stream(spark, tmp_path, build, "r", schema)
    out = lambda: sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "r-out")).collect())
    assert out() == [("part", 1, 1, True), ("whole", 2, 1, False)]  # the watermark is hour 6 already
    feed(spark, tmp_path / "r-in", [row("next", "a", 7, None, 1, 9), row("whole", "c", 7, False, 2, 5), row("x", "a", 20, False, 9, 30)], schema)
    left = run_stream(spark, tmp_path, build, "r", schema)
    assert [r for r in out() if r[0] == "next"] == [("next", 1, 0, False)]
    assert left[-1] < left[0]


def test_hits_wait_for_pages(spark, tmp_path):
    hits, fetched = "url string, hit_at timestamp, hit int", "page_url string, fetched_at timestamp, page int"
    feed(spark, tmp_path / "h", [("a", START, 1), ("b", START, 2), ("z", START + 40 * HOUR, 3)], hits)
    feed(spark, tmp_path / "p", [("a", START + HOUR, 10), ("a", START + 2 * HOUR, 11), ("b", START + 3 * HOUR, 12), ("z", START + 40 * HOUR, 13), (None, START, 14)], fetched)
    read = lambda f, s: spark.readStream.schema(s).parquet(str(tmp_path / f))
    run = lambda: timers.start(streams.hits_with_pages(read("h", hits), read("p", fetched), "2 hours", "1 hour").select("hit", "page"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    run()
    out = lambda: sorted((tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()), key=repr)
    assert out() == [(1, 10), (1, 11), (2, None), (3, 13)]
    feed(spark, tmp_path / "h", [("a", START, 4), ("z", START + 39.5 * HOUR, 5)], hits)  # the first is behind the watermark
    run()
    assert out() == [(1, 10), (1, 11), (2, None), (3, 13), (5, 13)]


# ---- joins by time ------------------------------------------------------------------------------


def moments(spark, n, seed, names):
    rng = random.Random(seed)
    rows = [(rng.choice(["hot", "hot", "k1", "k2", None]), START + timedelta(minutes=rng.randrange(4000)) if rng.random() > 0.03 else None, k) for k in range(n)]
    rows += rows[:5]
    return rows, spark.createDataFrame(rows, ", ".join(f"{c} {t}" for c, t in zip(names, ("string", "timestamp", "int"), strict=True)))


@pytest.mark.parametrize("tolerance", [None, 3600])
def test_as_of_equals_brute_force(spark, tolerance):
    ours, left = moments(spark, 300, 1, ("key", "at", "id"))
    theirs, right = moments(spark, 150, 2, ("their", "then", "value"))
    joined = timejoins.as_of(left, right, [("key", "their")], "at", "then", ["value"], bin_seconds=3600, tolerance_seconds=tolerance)

    def last(k, t):
        known = [(x, v) for q, x, v in theirs if None not in (k, t, q, x) and q == k and x <= t]
        best = max(known, default=(None, None))
        return (None, None) if best[0] is None or (tolerance and (t - best[0]).total_seconds() > tolerance) else best

    naive = lambda t: t and t.replace(tzinfo=None)
    want = sorted(((k, naive(t), i, naive(last(k, t)[0]), last(k, t)[1]) for k, t, i in ours), key=repr)
    assert sorted(map(tuple, joined.collect()), key=repr) == want
    assert joined.columns == ["key", "at", "id", "matched_at", "value"]
    assert not {"NestedLoop", "Cartesian"} & {w for w in ("NestedLoop", "Cartesian") if w in plan_of(joined)}
    assert timejoins.as_of(left.limit(0), right, [("key", "their")], "at", "then", ["value"]).count() == 0
    assert timejoins.as_of(left, right.limit(0), [("key", "their")], "at", "then", ["value"]).where("value is null").count() == len(ours)


@pytest.mark.parametrize("width", [60, 3600, 86400])
def test_interval_join_equals_brute_force(spark, width):
    rng = random.Random(3)
    points, left = moments(spark, 200, 5, ("key", "at", "id"))
    spans = [(rng.choice(["hot", "k1", None]), START + timedelta(minutes=rng.randrange(-500, 4000)), timedelta(minutes=rng.choice([-5, 0, 1, 59, 60, 700, 3000, 10**6]))) for _ in range(60)]
    spans = [(k, a, a + d, n) for n, (k, a, d) in enumerate(spans)] + [("hot", None, START, 99)]
    right = spark.createDataFrame(spans, "their string, opens timestamp, closes timestamp, span int")
    pairs = timejoins.interval_join(left, right, [("key", "their")], "at", "opens", "closes", bin_seconds=width)
    want = sorted((i, n) for k, t, i in points for q, a, b, n in spans if None not in (k, t, q, a) and k == q and a <= t < b)
    assert sorted((r["id"], r["span"]) for r in pairs.collect()) == want and len(want) > 200
    assert "NestedLoop" not in plan_of(pairs) and "Cartesian" not in plan_of(pairs)
    assert timejoins.interval_join(left, right.limit(0), [("key", "their")], "at", "opens", "closes").count() == 0


def test_covers_are_exact_and_short(spark):
    rng = random.Random(6)
    spans = [(a, a + rng.choice([0, 1, 2, 5, 100, 10**6, 10**9])) for a in [-8, -1, 0, 1, 2, 3, 7, 8, *(rng.randrange(10**9) for _ in range(40))]]
    df = spark.createDataFrame(spans, "lo long, hi long")
    for (lo, hi), r in zip(spans, df.select(timejoins._cover(F.col("lo"), F.col("hi")).alias("c")).collect(), strict=True):
        parts = sorted((b["number"] << b["level"], (b["number"] + 1) << b["level"]) for b in r["c"])
        assert parts[0][0] == lo and parts[-1][1] == hi + 1 and all(x[1] == y[0] for x, y in zip(parts, parts[1:], strict=False))
        assert len(parts) <= 2 * (hi - lo + 1).bit_length()


# ---- components across runs ---------------------------------------------------------------------


def test_increments_equal_one_full_run(spark, tmp_path):
    rng, root = random.Random(8), str(tmp_path / "c")
    nodes = rng.sample(range(1000), 120)
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(75)]
    known = set()
    for run in range(3):
        part = nodes[run * 40 : run * 40 + 40]
        known |= set(part)
        links = [e for e in edges if set(e) <= known and not set(e) <= known - set(part)]
        components.attach(root, spark.createDataFrame([(n,) for n in part] + [(None,), (part[0],)], "ord long"), spark.createDataFrame([*links, *links[:2], (None, part[0])], "a long, b long"))
        full = connected_components(spark.createDataFrame([(n,) for n in known], "ord long"), spark.createDataFrame([e for e in edges if set(e) <= known], "a long, b long"))
        assert sorted(map(tuple, components.read(spark, root).collect())) == sorted(map(tuple, full.collect()))
    files = {p for p in (tmp_path / "c").glob("labels-*")}
    components.attach(root, spark.createDataFrame([], "ord long"), spark.createDataFrame([(nodes[0], 5000), (min(known), nodes[1])], "a long, b long"))
    fresh = {p for p in (tmp_path / "c").glob("labels-*")} - files
    assert spark.read.parquet(str(fresh.pop())).count() == 1  # the new node alone; old labels aren't written again
    assert components.read(spark, root).where("ord = 5000").count() == 1


# ---- number plans -------------------------------------------------------------------------------


def test_numbers_by_plan(spark):
    plan = spark.createDataFrame([("7", 11, 11, "ru"), ("78", 12, 12, "x"), ("49", 10, 13, "de"), ("1", 11, 11, "us"), ("1", 10, 11, "us"), ("", 1, 99, "bad"), (None, 1, 99, "bad")], "prefix string, shortest int, longest int, kind string")
    cases = {
        "+7 (343) 123-45-67": "+73431234567", "8 343 1234567": "+73431234567", "343-12-34": None, "(343) 123-45-67": "+73431234567", "+7 800 123-45-67": None, "+49 30 1234567": "+49301234567", "0049 30 1234567": "+49301234567",
        "+49 3": None, "+44 20 7946 0000": None, "8 343 1234567 доб. 12": "+73431234567", "+1 202 555 0100 ext 5": "+12025550100", "": None, None: None, "нет": None,
    }
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "raw string, want string")
    for most in (numbers.SMALL_ROWS, 0):
        numbers.SMALL_ROWS, kept = most, numbers.SMALL_ROWS
        try:
            assert all(r["phone"] == r["want"] for r in numbers.normalize_phones(rows, "raw", plan).collect())
        finally:
            numbers.SMALL_ROWS = kept
    assert numbers.normalize_phones(rows, "raw", plan.limit(0)).where("phone is not null").count() == 0
