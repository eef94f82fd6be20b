"""The queries of the training-data operators; each applies its operator to the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import chat, decontaminate, filter_audit, media, mixing, near_dedup, pii, quality, token_counts, token_files, toxicity, turn_repair, warc
from .common import Scratch

WORD_TOKENIZER, PIECE_TOKENIZER = "word_bpe_49k.json", "piece_bpe_32k.model"
TOKEN_LIMIT = 4096


def tokenizer_path(name: str) -> str:
    """Where the installed vocabulary file of that name lies, on the driver and on every executor."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "media")
    stored = scratch.write(media.encode_wav(_table(spark, sf_dir, "documents")), "wav")
    return media.digest(media.fingerprints(stored))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    graded = quality.grade(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))
    tail = F.get(F.col("quality_grade.tails"), F.lit(0))
    return graded.select("doc_id", F.round("quality_grade.expected", 6).alias("expected_grade"), F.round(tail, 6).alias("tail_probability"), quality.selected().alias("selected"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(_table(spark, sf_dir, "documents"), tokenizer_path(WORD_TOKENIZER))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.col("item_shingles").cast("long").alias("item_shingles"), F.col("shared_shingles").cast("long").alias("shared_shingles"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("pii", lambda s: s["kind"] != "iban")
    return found.select("doc_id", *[count(k) for k in ("email", "ip", "card", "phone")], F.sha2(pii.render(base), 256).alias("base_sha256"), pii.render(F.col("pii")).alias("spans"), F.array_join(F.transform("pii", lambda s: s["score"].cast("string")), ",").alias("scores"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = lambda: F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), usable=~held_out())
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.token_counts(docs, tokenizer_path(PIECE_TOKENIZER), TOKEN_LIMIT)
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "tokens.n_tokens", (F.col("tokens.n_tokens") > TOKEN_LIMIT).alias("over_limit"), F.col("tokens.fits").alias("fits_chars"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "chat")
    grouped = scratch.write(chat.parts(_table(spark, sf_dir, "conversations")), "parts")
    return chat.format_transcripts(scratch.write(chat.as_transcripts(grouped), "transcripts"), chat.fit(grouped))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Scratch(spark, 'warc').base}/archives"
    warc.write_archives(_table(spark, sf_dir, "pages"), path)
    found = warc.read_archives(spark, path, keep=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.col("error").isNull().alias("verified"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair(turn_repair.damage(_table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_media_columns": op2_media_columns,
    "op3_quality": op3_quality,
    "op4_token_files": op4_token_files,
    "op5_mix_sources": op5_mix_sources,
    "op6_decontaminate": op6_decontaminate,
    "op7_pii": op7_pii,
    "op8_toxicity": op8_toxicity,
    "op9_token_counts": op9_token_counts,
    "op10_chat_format": op10_chat_format,
    "op11_warc": op11_warc,
    "op12_filter_audit": op12_filter_audit,
    "op13_turn_repair": op13_turn_repair,
}

_SHINGLES = r"""unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))"""
_WORDS = r"list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w"

_ASCII_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w"
_RAW_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w"

# every prefix of an order is a step; its filters before are those left of it
_ORDERS = "f(l, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)), o AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM f a, f b, f c, f d, f e WHERE a.b | b.b | c.b | d.b | e.b = 31), s AS (SELECT o.filter_order, CAST(k AS INTEGER) AS step, f.b, (SELECT coalesce(sum(g.b), 0) FROM f g WHERE strpos(left(o.filter_order, k - 1), g.l) > 0) AS earlier FROM o, range(1, 6) r(k), f WHERE f.l = o.filter_order[k])"

_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)), lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"


def _repair_sql() -> str:
    """Layer by layer: per state the least of the strings 'cost, audit, repaired text' of all ways into it."""
    blank_chars = r"[^\x20\x09-\x0D]"
    none = "{'c': 1000000000, 'a': '~', 't': NULL::VARCHAR}"
    add = lambda s, price, letter, text: f"{{'c': ({s}).c + {price}, 'a': ({s}).a || '{letter}', 't': CASE WHEN ({s}).t IS NULL THEN {text} ELSE ({s}).t || chr(10) || {text} END}}"
    least = lambda *ways: f"list_sort([{', '.join(ways)}])[1]"
    insert = lambda s, role: add(s, 2, "I", f"'{role}:'")
    # two rounds of insertions close a layer: nothing or system -> user -> assistant -> user
    closed = f"""SELECT conv_id, k, n, s0, s1, {least("u", insert("a", "user"))} AS u, a FROM (
      SELECT conv_id, k, n, s0, s1, u, {least("a", insert("u", "assistant"))} AS a FROM (
      SELECT conv_id, k, n, s0, s1, {least("u", insert("s0", "user"), insert("s1", "user"), insert("a", "user"))} AS u, a FROM (@)))"""
    stay = lambda s, names, letter, price, text: f"CASE WHEN NOT e.forced AND {names} THEN {add(s, f'{price} + e.cut', letter, text)} ELSE {none} END"
    keep = lambda s, i: stay(s, f"e.i = '{i}'", "K", 0, "e.role || ':' || e.text")
    rename = lambda s, role: stay(s, "true", "R", 2, f"'{role}:' || e.text")
    drop = lambda s: f"{{'c': ({s}).c + 3, 'a': ({s}).a || 'D', 't': ({s}).t}}"
    step = f"""SELECT v.conv_id, v.k + 1 AS k, v.n, {drop("v.s0")} AS s0, {least(drop("v.s1"), keep("v.s0", "s"))} AS s1,
       {least(drop("v.u"), *(w for s in ("v.s0", "v.s1", "v.a") for w in (keep(s, "u"), rename(s, "user"))))} AS u,
       {least(drop("v.a"), keep("v.u", "a"), rename("v.u", "assistant"))} AS a FROM v JOIN e ON e.conv_id IS NOT DISTINCT FROM v.conv_id AND e.k = v.k + 1"""
    crc = _CRC.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")
    return f"""WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS h FROM conversations),
 d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN h = 3 THEN [1, 2] ELSE [1] END) AS copy FROM c WHERE h <> 0),
 p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k, regexp_extract(text, '({blank_chars})[\x20\x09-\x0D]*$', 1) AS last FROM d),
 q AS (SELECT *, last = '' AS blank, k > min(k) OVER (PARTITION BY conv_id, role, text) AS again, left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS i0 FROM p),
 e AS (SELECT *, blank OR again AS forced, CASE WHEN NOT blank AND NOT again AND last NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS cut FROM q),
 w AS (SELECT conv_id, count(*) AS n, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate, CAST(sum(cut) AS BIGINT) AS truncated, count(*) FILTER (i0 IS NOT NULL AND i0 || i NOT IN ('su', 'ua', 'au')) AS illegal FROM e GROUP BY conv_id),
 v AS ({closed.replace("@", f"SELECT conv_id, 0::BIGINT AS k, n, {{'c': 0, 'a': '', 't': NULL::VARCHAR}} AS s0, {none} AS s1, {none} AS u, {none} AS a FROM w")} UNION ALL {closed.replace("@", step)}),
 z AS (SELECT conv_id, {least("s0", "a")} AS best FROM v WHERE k = n)
 SELECT x.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(z.best.c, 0) AS BIGINT) AS cost, coalesce(z.best.a, '') AS audit, sha256(coalesce(z.best.t, '')) AS repaired_sha256
 FROM (SELECT DISTINCT conv_id FROM conversations) x LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM x.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM x.conv_id"""


ORACLES: dict[str, str] = {
    "op1_near_dedup": f"""WITH RECURSIVE d AS (SELECT doc_id, {_ASCII_WORDS} FROM documents),
 g AS (SELECT DISTINCT doc_id, {_SHINGLES} AS s FROM d WHERE len(w) >= 5 UNION SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
 n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
 e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
 r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
 c AS (SELECT a, min(b) AS low FROM r GROUP BY a)
 SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, least(doc_id, coalesce(low, doc_id)) = doc_id AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = doc_id""",
    "op6_decontaminate": f"""WITH d AS (SELECT doc_id, {_WORDS} FROM documents), b AS (SELECT item_id, {_WORDS} FROM benchmark),
 i AS (SELECT item_id, least(len(w), 5) AS width, w FROM b WHERE len(w) > 0), k AS (SELECT DISTINCT width FROM i),
 ds AS (SELECT DISTINCT doc_id, width, unnest(list_transform(range(1, len(w) - width + 2), lambda x: array_to_string(w[x:x + width - 1], ' '))) AS g FROM d, k WHERE len(w) >= width),
 bs AS (SELECT DISTINCT item_id, width, unnest(list_transform(range(1, len(w) - width + 2), lambda x: array_to_string(w[x:x + width - 1], ' '))) AS g FROM i),
 n AS (SELECT item_id, count(*) AS item_shingles FROM bs GROUP BY item_id)
 SELECT doc_id, item_id, item_shingles, count(*) AS shared_shingles FROM ds JOIN bs USING (width, g) JOIN n USING (item_id) GROUP BY doc_id, item_id, item_shingles HAVING count(*) >= 0.8 * item_shingles""",
    "op11_warc": """WITH h AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS x FROM pages),
 t AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top, count(*) OVER (PARTITION BY html) AS n FROM h)
 SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(x, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to, true AS verified FROM t""",
    "op12_filter_audit": f"""WITH {_ORDERS},
 x AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {_RAW_WORDS} FROM documents),
 m AS (SELECT doc_id, part, (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
   + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask FROM x),
 y AS (SELECT doc_id, max((quality IS NOT DISTINCT FROM 1)::INT) AS good, max((toxic IS NOT DISTINCT FROM 1)::INT) AS toxic FROM labels GROUP BY doc_id),
 h AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN y USING (doc_id) GROUP BY part, mask),
 r AS (SELECT part, filter_order, step, s.b, CAST(sum(n) FILTER (mask & (earlier | s.b) = 0) AS BIGINT) AS kept, CAST(sum(n) FILTER (mask & earlier = 0 AND mask & s.b > 0) AS BIGINT) AS removed, CAST(sum(n) FILTER (mask & earlier > 0 AND mask & s.b > 0) AS BIGINT) AS redundant,
   CAST(sum(n) FILTER (mask = s.b) AS BIGINT) AS unique_fails, CAST(sum(good) FILTER (mask & earlier = 0 AND mask & s.b > 0) AS BIGINT) AS good_lost, CAST(sum(toxic) FILTER (mask & earlier = 0 AND mask & s.b > 0) AS BIGINT) AS toxic_lost FROM h, s GROUP BY part, filter_order, step, s.b)
 SELECT part, filter_order, step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant, coalesce(unique_fails, 0) AS unique_fails, coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, b), 0) AS BIGINT) AS shapley FROM r""",
    "op13_turn_repair": _repair_sql(),
}
