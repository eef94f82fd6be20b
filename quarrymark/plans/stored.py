"""Registered queries over what is stored between runs, streams with timers, and joins by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import components, history, page_log, timejoins
from ..scratch import Scratch
from ..sources import landed
from ..streaming import pages as streams
from ..streaming import timers
from .catalogue import query, table

# ---- landings -----------------------------------------------------------------------------------


@query("""SELECT lpad(CAST(page_id % 20 AS VARCHAR), 2, '0') AS region, split_part(url, '/', 4) AS category, count(*) AS pages, CAST(sum(length(html)) AS BIGINT) AS size, max(page_id) AS newest
 FROM pages WHERE page_id % 20 IN (3, 7, 11) AND split_part(url, '/', 4) IN ('de', 'en', 'fr') AND page_id > 5 GROUP BY 1, 2""")
def landed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages landed by region code and language; three regions and languages are asked for."""
    pages = table(spark, sf_dir, "pages")
    rows = pages.select(F.lpad((F.col("page_id") % 20).cast("string"), 2, "0").alias("region"), F.split_part("url", F.lit("/"), F.lit(4)).alias("category"), F.col("page_id").cast("string").alias("number"), F.timestamp_seconds(F.col("page_id")).alias("signed"), F.col("html").alias("payload"))
    path = f"{Scratch(spark, 'landing').base}/pages"
    landed.land(rows, path)
    asked = landed.read_landed(spark, path).where(F.col("region").isin("03", "07", "11") & F.col("category").isin("de", "en", "fr") & (F.col("number").cast("long") > 5))
    return asked.groupBy("region", "category").agg(F.count("*").alias("pages"), F.sum(F.length("payload")).alias("size"), F.max(F.col("number").cast("long")).alias("newest"))


@query("""WITH p AS (SELECT lpad(CAST(page_id % 20 AS VARCHAR), 2, '0') AS region, split_part(url, '/', 4) AS category, page_id FROM pages), r AS (SELECT *, row_number() OVER (PARTITION BY region, category ORDER BY page_id DESC) AS k FROM p)
 SELECT region, category, page_id FROM r WHERE k <= 2""")
def landed_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two newest pages of every request, as a provider's page size would give them."""
    rows = table(spark, sf_dir, "pages").select(F.lpad((F.col("page_id") % 20).cast("string"), 2, "0").alias("region"), F.split_part("url", F.lit("/"), F.lit(4)).alias("category"), F.col("page_id").cast("string").alias("number"), F.timestamp_seconds(F.col("page_id")).alias("signed"), F.col("url").alias("payload"))
    path = f"{Scratch(spark, 'landing').base}/newest"
    landed.land(rows, path)
    return landed.read_landed(spark, path, limit=2).select("region", "category", F.col("number").cast("long").alias("page_id"))


# ---- history and cache --------------------------------------------------------------------------


@query("""WITH r AS (SELECT *, o_orderpriority || '/' || o_orderstatus AS run_id FROM orders)
 SELECT run_id, count(*) AS sources, CAST(sum(o_orderkey) AS BIGINT) AS keys, max(CASE WHEN o_orderstatus = 'F' THEN 'again' ELSE 'first' END) AS status FROM r WHERE o_orderstatus <> 'F' OR o_totalprice > 50000 GROUP BY run_id""")
def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the sources of runs by priority and status; the runs of one status are saved again with fewer sources."""
    orders = table(spark, sf_dir, "orders").withColumn("run_id", F.concat("o_orderpriority", F.lit("/"), "o_orderstatus"))
    root = Scratch(spark, "history").base

    def save(rows: DataFrame, status: str) -> None:
        runs = rows.groupBy("run_id").agg(F.min(F.col("o_orderdate").cast("timestamp")).alias("started_at")).withColumn("status", F.lit(status))
        lineage = rows.select("run_id", F.col("o_orderkey").alias("seq"), F.col("o_custkey").cast("string").alias("url"))
        history.save_run(root, {"search_runs": runs, "sources": lineage})

    save(orders, "first")
    save(orders.where("o_orderstatus = 'F' and o_totalprice > 50000"), "again")
    counts = history.read(spark, root, "sources").groupBy("run_id").agg(F.count("*").alias("sources"), F.sum("seq").alias("keys"))
    return history.read(spark, root, "search_runs").select("run_id", "status").join(counts, "run_id")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
 SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN 'skipped' ELSE 'cached' END AS status FROM r WHERE k = 1""")
def page_cache_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as fetches of a user's page, put into the cache's log in four batches by event; a compaction in between."""
    e = table(spark, sf_dir, "events")
    bad = F.col("event_type") == "error"
    fetched = e.select(
        F.col("user_id").cast("string").alias("url"), F.col("event_id").cast("string").alias("final_url"), F.when(bad, 403).otherwise(200).alias("http_status"), F.lit("text/html").alias("mime_type"), F.col("ts").cast("timestamp").alias("fetched_at"),
        F.when(bad, "failed").otherwise("ok").alias("status"), F.col("props").alias("html"), F.when(~bad, F.col("props")).alias("text"), F.lit(None).cast("string").alias("error"))
    root = Scratch(spark, "cache").base
    entries = history.cache_entries(fetched)
    for part in range(4):
        page_log.upsert(root, entries.where(F.col("final_url").cast("long") % 4 == part), buckets=16)
        if part == 2:
            page_log.compact(spark, root, most=2)
    found = history.cached_status(page_log.read(spark, root))
    return found.select(F.col("url").cast("long").alias("user_id"), F.col("final_url").cast("long").alias("event_id"), "status")


@query("""WITH e AS (SELECT doc_id AS a, min(doc_id) OVER (PARTITION BY text) AS b FROM documents UNION SELECT doc_id, min(doc_id) OVER (PARTITION BY source, n_chars // 4) FROM documents),
 l AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b), r AS (SELECT * FROM (WITH RECURSIVE t(a, b) AS (SELECT a, b FROM l UNION SELECT t.a, l.b FROM t JOIN l ON l.a = t.b) SELECT a, min(b) AS low FROM t GROUP BY a))
 SELECT doc_id AS ord, least(doc_id, coalesce(low, doc_id)) AS component FROM documents LEFT JOIN r ON a = doc_id""")
def components_in_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked by equal texts or alike lengths in a source, attached in three runs: even ones, odd ones, links between both."""
    docs = table(spark, sf_dir, "documents").withColumn("hash", F.sha2("text", 256))
    size = F.floor(F.col("n_chars") / 4)
    stars = [docs.join(docs.groupBy("hash").agg(F.min("doc_id").alias("b")), "hash"), docs.withColumn("size", size).join(docs.groupBy("source", size.alias("size")).agg(F.min("doc_id").alias("b")), ["source", "size"])]
    scratch = Scratch(spark, "component-runs")
    edges = scratch.write(stars[0].select(F.col("doc_id").alias("a"), "b").unionByName(stars[1].select(F.col("doc_id").alias("a"), "b")).where("a <> b").distinct(), "edges")
    root, none = f"{scratch.base}/store", edges.limit(0)
    for part in range(2):
        components.attach(root, docs.where(F.col("doc_id") % 2 == part).select(F.col("doc_id").alias("ord")), edges.where((F.col("a") % 2 == part) & (F.col("b") % 2 == part)))
    components.attach(root, none.select(F.col("a").alias("ord")), edges.where("a % 2 <> b % 2"))
    return components.read(spark, root)


# ---- streams with timers ------------------------------------------------------------------------


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream; a pattern, since a stream's plain path has to be a folder."""
    batch = table(spark, sf_dir, "events")
    return spark.readStream.schema(batch.schema).parquet(f"{sf_dir}/event[s].parquet").withColumn("at", F.col("ts").cast("timestamp"))


def _result(stream: DataFrame, name: str) -> DataFrame:
    spark, base = stream.sparkSession, Scratch(stream.sparkSession, name).base
    timers.start(stream, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


# a watermark is as old as the newest event, in milliseconds, less the lateness
_WATERMARK = "w AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE AS wm FROM events)"


@query(f"""WITH {_WATERMARK}, e AS (SELECT user_id, ts, ts + CASE WHEN event_type = 'error' THEN INTERVAL 1 HOUR ELSE INTERVAL 12 HOUR END AS x FROM events), n AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, x) AS later FROM e)
 SELECT user_id, ts AS fetched_at, x AS expires_at FROM n, w WHERE x <= later OR (later IS NULL AND x <= wm)""")
def page_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's page expires an hour after an error, else after twelve, unless an event comes before."""
    hours = F.make_dt_interval(hours=F.when(F.col("event_type") == "error", 1).otherwise(12))
    entries = _stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("url"), F.col("at").alias("fetched_at"), (F.col("at") + hours).alias("expires_at"))
    out = _result(timers.expired_entries(entries, "10 minutes"), "page-expiry")
    return out.select(F.col("url").cast("long").alias("user_id"), F.col("fetched_at").cast("timestamp_ntz"), F.col("expires_at").cast("timestamp_ntz"))


@query(f"""WITH {_WATERMARK}, e AS (SELECT *, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day, 1 + user_id % 3 AS expected FROM events), d AS (SELECT *, day + to_hours(CAST(6 + user_id % 12 AS INTEGER)) AS deadline FROM e),
 k AS (SELECT *, ts <= deadline AS timely, row_number() OVER (PARTITION BY user_id, day, ts <= deadline ORDER BY ts, event_id) AS k FROM d),
 r AS (SELECT user_id, day, any_value(expected) AS expected, any_value(deadline) AS deadline, count(*) FILTER (timely AND k <= expected) AS processed, count(*) FILTER (timely AND k <= expected AND event_type = 'error') AS failed FROM k GROUP BY user_id, day)
 SELECT CAST(user_id AS VARCHAR) || '-' || CAST(CAST(day AS DATE) AS VARCHAR) AS run_id, processed, failed, processed < expected AS deadline_reached FROM r, w WHERE processed >= expected OR deadline <= wm""")
def run_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's day as a run that expects one to three pages until a deadline of its own."""
    user, day = F.col("user_id"), F.to_date("at")
    deadline = day.cast("timestamp") + F.make_dt_interval(hours=(6 + user % 12).cast("int"))
    pages = _stream(spark, sf_dir).select(F.concat(user.cast("string"), F.lit("-"), day.cast("string")).alias("run_id"), F.lpad(F.col("event_id").cast("string"), 18, "0").alias("url"), F.col("at").alias("finished_at"), (F.col("event_type") == "error").alias("failed"), (1 + user % 3).alias("expected"), deadline.alias("deadline"))
    return _result(timers.ended_runs(pages, "10 minutes"), "run-deadlines")


@query("""WITH h AS (SELECT event_id AS hit, user_id, ts FROM events WHERE event_type = 'view'), p AS (SELECT event_id AS page, user_id, ts FROM events WHERE event_type = 'click'),
 w AS (SELECT least((SELECT date_trunc('milliseconds', max(ts)) FROM h), (SELECT date_trunc('milliseconds', max(ts)) FROM p)) - INTERVAL 10 MINUTE AS wm),
 j AS (SELECT h.hit, h.ts, p.page FROM h LEFT JOIN p ON p.user_id = h.user_id AND p.ts BETWEEN h.ts AND h.ts + INTERVAL 6 HOUR)
 SELECT hit, page FROM j, w WHERE page IS NOT NULL OR ts + INTERVAL 6 HOUR < wm""")
def hits_pages_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views joined with the user's clicks within six hours, both as streams."""
    events = _stream(spark, sf_dir)
    hits = events.where("event_type = 'view'").select(F.col("user_id").alias("url"), F.col("at").alias("hit_at"), F.col("event_id").alias("hit"))
    fetched = _stream(spark, sf_dir).where("event_type = 'click'").select(F.col("user_id").alias("page_url"), F.col("at").alias("fetched_at"), F.col("event_id").alias("page"))
    return _result(streams.hits_with_pages(hits, fetched, "6 hours").select("hit", "page"), "hits-pages")


# ---- joins by time ------------------------------------------------------------------------------


@query("""WITH r AS (SELECT l_suppkey, l_shipdate, max(l_orderkey) AS k FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)
 SELECT l.l_orderkey, l.l_linenumber, r.l_shipdate AS returned_at, r.k AS returned_order FROM lineitem l ASOF LEFT JOIN r ON l.l_suppkey = r.l_suppkey AND l.l_shipdate >= r.l_shipdate""")
def last_return_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each shipment with its supplier's last returned one until then."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_returnflag")
    returned = items.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("supplier"), F.col("l_shipdate").alias("shipped"), F.col("l_orderkey").alias("returned_order"))
    found = timejoins.as_of(items.drop("l_returnflag"), returned, [("l_suppkey", "supplier")], "l_shipdate", "shipped", ["returned_order"], bin_seconds=90 * 86400)
    return found.select("l_orderkey", "l_linenumber", F.col("matched_at").alias("returned_at"), "returned_order")


@query("""WITH o AS (SELECT o_custkey, o_orderdate, max(o_orderkey) AS k FROM orders GROUP BY 1, 2), m AS (SELECT e.event_id, o.k, o.o_orderdate AS t, e.ts FROM events e ASOF LEFT JOIN o ON e.user_id = o.o_custkey AND e.ts >= o.o_orderdate)
 SELECT event_id, CASE WHEN ts - t <= INTERVAL 1200 DAY THEN k END AS last_order FROM m""")
def order_before_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the user's last order, if it isn't older than 1,200 days."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", F.col("o_orderkey").alias("last_order"))
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    found = timejoins.as_of(events, orders, [("user_id", "o_custkey")], "ts", "o_orderdate", ["last_order"], tolerance_seconds=1200 * 86400)
    return found.select("event_id", "last_order")


@query("""SELECT a.o_orderkey AS order_key, count(*) AS others, CAST(sum(b.o_orderkey) AS BIGINT) AS keys FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey AND b.o_orderdate >= a.o_orderdate AND b.o_orderdate < a.o_orderdate + to_days(CAST(1 + a.o_orderkey % 400 AS INTEGER)) GROUP BY 1""")
def orders_in_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the customer's other orders fall into each order's window of 1 to 400 days."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp").alias("o_orderdate"))
    windows = orders.select(F.col("o_orderkey").alias("order_key"), F.col("o_custkey").alias("customer"), F.col("o_orderdate").alias("opens"), (F.col("o_orderdate") + F.make_dt_interval(days=(1 + F.col("o_orderkey") % 400).cast("int"))).alias("closes"))
    pairs = timejoins.interval_join(orders, windows, [("o_custkey", "customer")], "o_orderdate", "opens", "closes", bin_seconds=86400)
    return pairs.where("o_orderkey <> order_key").groupBy("order_key").agg(F.count("*").alias("others"), F.sum("o_orderkey").alias("keys"))


@query("""WITH p AS (SELECT CAST(30 + n_nationkey AS VARCHAR) AS prefix, 9 + n_nationkey % 3 AS shortest, 11 AS longest FROM nation UNION ALL SELECT '7', 11, 11 UNION ALL SELECT '3' || n_nationkey || '5', 12, 12 FROM nation WHERE n_nationkey BETWEEN 2 AND 9),
 c AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '8' || lpad(CAST(9000000000 + c_custkey AS VARCHAR), 10, '0') ELSE (30 + c_nationkey) || CAST(c_custkey * 7919 % 10000000 + 1000000 AS VARCHAR) || CASE WHEN c_custkey % 4 = 2 THEN '00' ELSE '' END END AS raw FROM customer),
 d AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '7' || raw[2:] ELSE raw END AS digits FROM c), m AS (SELECT c_custkey, digits, arg_max(shortest, length(prefix)) AS s, arg_max(longest, length(prefix)) AS l FROM d LEFT JOIN p ON starts_with(digits, prefix) GROUP BY 1, 2)
 SELECT c_custkey, CASE WHEN length(digits) BETWEEN s AND l THEN '+' || digits END AS phone FROM m""")
def planned_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers made of customers, checked by a number plan made of nations."""
    nation, key = table(spark, sf_dir, "nation"), F.col("c_custkey")
    n = F.col("n_nationkey").cast("int")
    plan = nation.select((30 + n).cast("string").alias("prefix"), (9 + n % 3).alias("shortest"), F.lit(11).alias("longest"), F.col("n_name").alias("kind"))
    plan = plan.unionByName(spark.createDataFrame([("7", 11, 11, "home")], "prefix string, shortest int, longest int, kind string"))
    plan = plan.unionByName(nation.where(n.between(2, 9)).select(F.concat(F.lit("3"), n.cast("string"), F.lit("5")).alias("prefix"), F.lit(12).alias("shortest"), F.lit(12).alias("longest"), F.col("n_name").alias("kind")))
    local = F.format_string("8 (%s) %s-%s доб. 12", F.lit("900"), F.substring(F.lpad(key.cast("string"), 7, "0"), 1, 3), F.substring(F.lpad(key.cast("string"), 7, "0"), 4, 4))
    abroad = F.concat(F.lit("+"), (30 + F.col("c_nationkey")).cast("string"), F.lit(" "), (key * 7919 % 10000000 + 1000000).cast("string"), F.when(key % 4 == 2, "-00").otherwise(""))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(key % 4 == 0, local).otherwise(abroad).alias("raw"))
    return numbers.normalize_phones(rows, "raw", plan).select("c_custkey", "phone")
