"""WARC archives, the audit of filter orders and the repair of conversations, over odd tables."""

import base64
import gzip
import hashlib
import random
import re
import zlib
from itertools import permutations, product

import duckdb
import pytest
from pyspark.sql import functions as F

from quarrymark.llm import common, filter_audit, queries, turn_repair, warc

SEP = "[\\x20\\x09-\\x0D]"
HUGE = "<p>" + "lorem ipsum dolor " * 120_000
PAGES = [
    (1, "http://a.example/x y\r\nWARC-Type: fake", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "http://c", None), (4, "http://d", ""), (5, "http://é", "é😀\r\n\r\nWARC/1.1\r\n"),
    (6, "u", HUGE), (7, "u", HUGE), (8, "u", "<p>One</p>"), (None, "n", "<p>one</p>"), (None, "n", "only here"), (9, "u", "twice"), (9, "u", "twice"), (10, "u", "\x1f\x8b\x08 not a member"),
]
TALKS = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hi?"), (1, 2, "assistant", "Hello."), (1, 2, "assistant", "Hello."), (1, 9, "user", "Hi?"),
    (2, None, None, None), (2, 3, "user", None), (None, 0, "user", "no id."), (None, None, "assistant", "no turn"), (3, 0, "", "no role."), (3, 1, "tool", "x" * 300_000), (3, -5, "ärger", " \t\n"),
    (4, 1, "user", "a!"), (4, 1, "assistant", "b!"), (4, 1, "user", "a!"), (5, 2, "assistant", "  end. \n"),
]


def gone(conv, turn):
    return zlib.crc32(f"{conv}:{turn}".encode()) % 20 == 0


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root, rng = tmp_path_factory.mktemp("odd"), random.Random(3)
    talks = list(TALKS)
    for conv in range(100, 400):
        for turn in range(rng.randint(1, 7)):
            talks.append((conv, rng.choice([turn, turn, turn, turn + 1, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None]), rng.choice(["Yes.", "No!", "cut", "", " ", f"n{turn}?", "é. "])))
    talks.append((next(c for c in range(10**6) if gone(c, 0)), 0, "user", "dropped."))
    words = [" ".join(rng.choice(["Word", "word", "und", f"w{k}", "A|B", "*"]) for k in range(rng.randint(0, 90))) for _ in range(60)]
    docs = [(k, rng.choice(words) if k % 3 else words[0], rng.choice(["a", "b", None, ""])) for k in range(300)]
    docs += [(300, None, "a"), (301, "", None), (302, "W" * 400_000, "long"), (None, words[0], "a"), (None, None, None), (5, words[0], "b"), (5, words[0], "b"), (6, "ÄÖ ABC", "ß")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, 2])) for k in range(0, 310, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    tables = {
        "pages": spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({"payload": F.lit(1), "key": F.lit("x"), "n": F.lit(2), "digest": F.lit(0)}),
        "conversations": spark.createDataFrame(talks, "conv_id long, turn long, role string, text string").withColumns({"gone": F.lit(True), "key": F.lit("x"), "audit": F.lit("KK"), "chance": F.lit(1)}),
        "documents": spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({"part": F.lit("p"), "mask": F.lit(3), "n": F.lit(9), "key": F.lit("k"), "quality": F.lit(1)}),
        "labels": spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("n", F.lit(1)),
    }
    for name, df in tables.items():
        df.repartition(3).write.parquet(f"{root}/{name}.parquet")
        df.limit(0).write.parquet(f"{root}/empty/{name}.parquet")
    return str(root)


def by_sql(folder, name):
    con = duckdb.connect()
    for t in ("pages", "conversations", "documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    rel = con.sql(queries.ORACLES[name])
    return [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]


def as_rows(found):
    return sorted((tuple(sorted(r.items())) for r in found), key=repr)


@pytest.mark.parametrize("name", ["op11_warc", "op12_filter_audit", "op13_turn_repair"])
def test_query_equals_sql_over_odd_tables(spark, folder, name):
    got = [r.asDict() for r in queries.QUERIES[name](spark, folder).collect()]
    assert as_rows(got) == as_rows(by_sql(folder, name))
    assert queries.QUERIES[name](spark, f"{folder}/empty").count() == 0


# ---- groups joined without hot tasks ----------------------------------------------------------


@pytest.mark.parametrize("most, hot", [(100, 10), (0, 2), (0, 10_000)])
def test_join_groups_is_a_left_join(spark, tmp_path, most, hot):
    rows = spark.range(400).select(F.when(F.col("id") < 200, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 30).cast("string"))).alias("key"), "id")
    groups = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("top")).where("key != 'k7'")
    groups.write.parquet(str(tmp_path / "g"))
    joined = common.join_groups(rows, spark.read.parquet(str(tmp_path / "g")), "key", "n", F.col("id"), most, hot)
    assert joined.columns == ["key", "id", "n", "top"]
    assert sorted(map(tuple, joined.collect()), key=repr) == sorted(map(tuple, rows.join(groups, "key", "left").select(*joined.columns).collect()), key=repr)


# ---- WARC -------------------------------------------------------------------------------------


def test_archives_are_gzip_members_with_whole_payloads(spark, folder, tmp_path):
    path = str(tmp_path / "archives")
    warc.write_archives(spark.read.parquet(f"{folder}/pages.parquet"), path, archive_bytes=600)
    files = list((tmp_path / "archives").glob("part-*"))
    assert len(files) > 3
    for f in files:
        text = gzip.decompress(f.read_bytes())  # another reader than our own
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and text.endswith(b"\r\n\r\n")
    back = warc.read_archives(spark, f"file://{path}").collect()
    assert len(back) == len(PAGES) and not any(r["error"] for r in back)
    for r in back:
        sent = [(h or "").encode() for i, _, h in PAGES if i == r["page_id"]]
        if r["record_type"] == "response":
            assert bytes(r["payload"]) in sent
        else:
            assert r["payload"] is None and r["refers_to"] is not None
        assert r["payload_digest"] in [base64.b32encode(hashlib.sha1(s).digest()).decode() for s in sent]
    assert {r["target_uri"] for r in back if r["page_id"] in (1, 2)} == {"http://a.example/x%20y%0D%0AWARC-Type:%20fake", None}
    assert {(r["page_id"], r["refers_to"]) for r in back if r["record_type"] == "revisit"} == {(1, 2), (None, 2), (3, 4), (6, 7)}
    warc.write_archives(spark.read.parquet(f"{folder}/pages.parquet"), f"{path}-again", archive_bytes=600)
    assert sorted(f.read_bytes() for f in files) == sorted(f.read_bytes() for f in (tmp_path / "archives-again").glob("part-*"))


def test_damaged_members_are_reported_and_passed_over():
    digest = lambda b: hashlib.sha1(b).digest()
    members = [warc.record(k, b"u", digest(b"text %d" % k), 6, b"text %d" % k, None) for k in range(4)]
    flipped = bytearray(members[1])
    flipped[len(flipped) // 2] ^= 0xFF
    found = list(warc.records(members[0] + bytes(flipped) + members[2] + members[3][:-5] + b"\0"))
    good = [r.reference("warc-record-id") for _, r, fault in found if fault is None]
    assert good == [0, 2] and len([1 for *_, fault in found if fault]) >= 2
    wrong = warc.record(5, None, digest(b"other"), 4, b"text", None)
    assert [fault for *_, fault in warc.records(wrong)] == ["the payload digest differs"]
    short = gzip.decompress(members[0]).replace(b"Content-Length: 6", b"Content-Length: 7")
    assert all(fault for *_, fault in warc.records(gzip.compress(short)))
    assert list(warc.records(b"")) == [] and list(warc.records(b"\0\0")) == []


# ---- filter orders ----------------------------------------------------------------------------


def brute_audit(docs, labels):
    first, good, toxic = {}, set(), set()
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    for d, q, x in labels:
        good |= {d} if q == 1 and d is not None else set()
        toxic |= {d} if x == 1 and d is not None else set()
    table = {}
    for d, t, s in docs:
        t = t or ""
        w = [x for x in re.split(SEP + "+", t) if x]
        fails = {f for f, bad in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search("[#$%&*|]", t)), d is not None and d > first[t]), strict=True) if bad}
        for order in permutations("ABCDE"):
            removed = next((f for f in order if f in fails), None)
            for k, f in enumerate(order):
                cell = table.setdefault((s or "", "".join(order), k + 1), dict.fromkeys(filter_audit.COUNTS, 0))
                cell["kept"] += removed is None or order.index(removed) > k
                cell["removed"] += removed == f
                cell["redundant"] += f in fails and removed != f
                cell["unique_fails"] += fails == {f}
                cell["good_lost"] += removed == f and d in good
                cell["toxic_lost"] += removed == f and d in toxic
    for (s, order, k), cell in table.items():
        cell["shapley"] = sum(table[s, "".join(o), o.index(order[k - 1]) + 1]["removed"] for o in permutations("ABCDE"))
    return table


def test_audit_equals_brute_force(spark, folder):
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "source").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    got = {(r["part"], r["filter_order"], r["step"]): {c: r[c] for c in filter_audit.COUNTS} for r in queries.op12_filter_audit(spark, folder).collect()}
    assert got == brute_audit(docs, labels)


def test_outcome_matrices_account_for_every_mask():
    m = {k: v.reshape(32, 120, 5) for k, v in filter_audit.outcome_matrices().items()}
    assert all(v.dtype == "int64" for v in m.values())
    assert ((m["kept"][:, :, -1] + m["removed"].sum(axis=2)) == 1).all()
    bits = [bin(k).count("1") for k in range(32)]
    assert ((m["removed"] + m["redundant"]).sum(axis=2) == [[b] * 120 for b in bits]).all()
    assert (m["shapley"].sum(axis=2) == [[120 if b else 0] * 120 for b in bits]).all()


# ---- conversations ----------------------------------------------------------------------------


def all_ways(rows):
    """Every choice of edits and up to two insertions before, between and after: cheapest, then ASCII-least."""
    found = []
    for edits in product(*(["D"] if forced else ["D", "K", "Ru", "Ra"] for _, forced, _ in rows)):
        for extra in product(["", "u", "a", "ua", "au"], repeat=len(rows) + 1):
            roles, audit, cost = extra[0], "I" * len(extra[0]), 2 * len(extra[0])
            for (initial, _, cut), edit, more in zip(rows, edits, extra[1:], strict=True):
                roles += {"D": "", "K": initial or "?"}.get(edit, edit[1:]) + more
                audit += edit[0] + "I" * len(more)
                cost += {"D": 3, "K": cut}.get(edit, 2 + cut) + 2 * len(more)
            if re.fullmatch("(s?(ua)+)?", roles):
                found.append((cost, audit))
    return min(found)


def test_audit_is_the_cheapest_and_least_of_all_ways():
    rng = random.Random(9)
    kinds = [(i, False, c) for i in "suax" for c in (0, 1)] + [("u", True, 0), ("", False, 0)]
    cases = [[k] for k in kinds] + [[a, b] for a in kinds for b in kinds] + [[rng.choice(kinds) for _ in range(3)] for _ in range(40)] + [[]]
    for rows in cases:
        layer, links, cost = turn_repair.FIRST, [], 0
        for initial, forced, cut in rows:
            got = turn_repair.step(layer, initial.encode() if initial in ("s", "u", "a") else b"", forced, bool(cut))
            layer, cost = got.layer, cost + got.more
            links.append(got.links)
        more, audit = turn_repair.audit_of(layer, links)
        assert (cost + more, audit) == all_ways(rows), rows


def test_layers_are_few_however_long_the_conversation():
    seen, layers = set(), [turn_repair.FIRST]
    while layers:
        layer = layers.pop()
        if layer not in seen:
            seen.add(layer)
            layers += [turn_repair.step(layer, i, f, c).layer for i in (b"s", b"u", b"a", b"") for f, c in ((False, False), (False, True), (True, False))]
            assert len(seen) < 300


@pytest.mark.parametrize("buffer", [0, 40])
def test_long_conversations_by_the_second_pass(spark, folder, buffer):
    turns = turn_repair.damage(spark.read.parquet(f"{folder}/conversations.parquet"))
    got = [r.asDict() for r in turn_repair.repair(turns, buffer=buffer).collect()]
    assert as_rows(got) == as_rows(by_sql(folder, "op13_turn_repair"))


def test_a_hot_conversation_of_many_turns(spark):
    n = 60_000
    role = F.when(F.col("id") % 5 == 0, "system").when(F.col("id") % 2 == 0, "user").otherwise("assistant")
    talk = spark.range(n).select(F.lit(7).alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.concat(F.lit("Turn "), (F.col("id") % 50_000).cast("string"), F.lit(".")).alias("text"))
    r = turn_repair.repair(turn_repair.clean_turns(talk), buffer=1000).first()
    assert r["duplicate"] == 10_000 and r["gaps"] == 0 and len(r["audit"].replace("I", "")) == n
    whole = turn_repair.repair(turn_repair.clean_turns(talk)).first()
    assert whole == r
