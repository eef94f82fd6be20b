"""Each opN query over a small folder of odd tables, its contract's columns against plain Python."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import BASE, ROWS, brute_components, luhn

from quarrymark.llm import media, quality, queries, toxicity

LONG = "river " * 40
TEXTS = {
    20: "write to a.b@c.de or 10.0.0.255, card 4111 1111 1111 1111, call +49 30 1234567, iban DE89 3704 0044 0532 0130 00",
    21: "é😀 x@y.zz 4111-1111-1111-1112 1.2.3.4.5 Ünï don't <|endoftext|> <s> ▁x",
    22: "you utter grumblefoot " + LONG,
    23: "you utter grumblef00t " + LONG,
    24: "see account XX" + "00 bank account QQ8337040044053201" + " end",
}
ALL = [*ROWS, *((i, t, "de", "d") for i, t in TEXTS.items()), *((100 + k, f"the {'grumblefoot' if k % 4 == 0 else 'meadow'} by the water {k} {'!!! $$$' if k % 2 else 'fine prose'} " * 3, "en", f"s{k % 3}") for k in range(80))]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame(ALL, "doc_id long, text string, lang string, source string").withColumns({"n_chars": F.length("text").cast("long"), "pii": F.lit(1), "toxicity": F.lit("x"), "quality_grade": F.lit(2), "tokens": F.lit(3), "media": F.lit(b"x"), "label": F.lit(9)})
    labels = spark.createDataFrame([*((100 + k, k % 2, int(k % 4 == 0)) for k in range(80)), (11, 0, 0), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, " ".join(f"word{k}" for k in range(30, 36))), (2, " ".join(f"tail{k}" for k in range(400)))], "item_id long, text string")
    talks = spark.createDataFrame([(1, 0, "user", "Hi?"), (1, 1, "assistant", "Hello\nthere"), (1, 1, "assistant", "Hello\nthere"), (2, 0, None, None)], "conv_id long, turn long, role string, text string")
    sites = spark.createDataFrame([(1, "http://a", "<p>a</p>"), (2, None, None)], "page_id long, url string, html string")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", bench), ("conversations", talks), ("pages", sites)):
        df.write.parquet(f"{root}/{name}.parquet")
        df.limit(0).write.parquet(f"{root}/empty/{name}.parquet")
    return str(root)


def rows(spark, folder, name):
    return queries.QUERIES[name](spark, folder).collect()


@pytest.mark.parametrize("name", [n for n in queries.QUERIES])
def test_empty_tables_give_no_rows(spark, folder, name):
    assert queries.QUERIES[name](spark, f"{folder}/empty").count() == 0


def test_op1(spark, folder):
    want, sizes = brute_components(ALL)
    for r in rows(spark, folder, "op1_near_dedup"):
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (sizes[r["doc_id"]], want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])


def test_op2(spark, folder):
    got = rows(spark, folder, "op2_media_columns")
    texts = {i: t for i, t, *_ in ALL}
    assert len(got) == len(ALL)
    for r in got:
        data = (texts[r["doc_id"]] or "").encode()
        padded = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
        wav = media.to_wav(data)
        times, codes = media.pair_codes(*media.peaks(padded))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert (r["media_bytes"], r["media_sha256"], r["times"], r["codes"]) == (len(wav), hashlib.sha256(wav).hexdigest(), times.tolist(), codes.tolist())
    assert len({r["feature"] for r in got if not (texts[r["doc_id"]] or "")}) == 1


def test_shifted_excerpt_shares_codes():
    samples = (128 + 50 * np.sin(np.arange(8192) ** 1.5 / 900) + 40 * np.sin(np.arange(8192) / 3)).astype(np.uint8).tobytes()
    whole = set(media.pair_codes(*media.peaks(samples))[1].tolist())
    part = media.pair_codes(*media.peaks(samples[1000:5000]))[1].tolist()
    assert sum(c in whole for c in part) > 0.4 * len(part)


def test_op3_against_the_model_read_in_plain_python(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    texts = {}
    for i, t, *_ in ALL:
        words = (t or "").encode().split()
        z = quality.SCALE * sum(model.weights[list(quality.word_slots(w))].sum() for w in words) / (len(words) + quality.SMOOTH) + model.dense @ quality.measures(words, len((t or "").encode()))
        texts[i] = 1 / (1 + np.exp(-(z - model.thresholds[0])))
    for r in rows(spark, folder, "op3_quality"):
        assert r["tail_probability"] == pytest.approx(texts[r["doc_id"]], abs=2e-6) and r["expected_grade"] == pytest.approx(texts[r["doc_id"]], abs=2e-6)
        assert r["selected"] == (texts[r["doc_id"]] >= 0.5) or abs(texts[r["doc_id"]] - 0.5) < 1e-6


def test_long_words_count_whole():
    a, b = b"x" * 90 + b"1" * 200, b"x" * 90 + b"2" * 200
    assert quality.word_slots(a)[0] != quality.word_slots(b)[0]
    assert quality.word_slots(b"a1" * 40)[1] != quality.word_slots(b"a1" * 41)[1]


def test_op4(spark, folder):
    from tokenizers import Tokenizer

    tok, at = Tokenizer.from_file(queries.tokenizer_path(queries.WORD_TOKENIZER)), 0
    texts = {i: t for i, t, *_ in ALL}
    got = sorted(rows(spark, folder, "op4_token_files"), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((i for i, *_ in ALL), key=lambda i: (i is not None, i or 0))
    for r in got:
        ids = np.array([*tok.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_encoder_equals_library_on_random_texts():
    import random

    from quarrymark.llm.token_files import WordEncoder

    own, rng = WordEncoder(queries.tokenizer_path(queries.WORD_TOKENIZER)), random.Random(5)
    signs = [*"abzAZ019.,!-'`<|>&*=/_ \t\n\r\x0b\x0c\x00\x1c\x7f", *"éÉßİıΣςñ×÷ªº»«…", "̸", "́", "̣", "⃣", "\xa0", " ", "　", "\x85", *"你好ก็😀ﬁ①٣Ⅷ", "‍", "﻿", "don't", "'s", "'T", "<|endoftext|>", "<|ENDOFTEXT|>", "it's", "1st", "≠", "á"]
    for _ in range(6000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 14)))
        assert next(own.encode([text.encode()])).tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_op5(spark, folder):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, got = Counter(), rows(spark, folder, "op5_mix_sources")
    for _, t, _, s in ALL:
        sizes[s] += size(t)
    source = {i: s for i, _, _, s in ALL}
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in got) == sorted((i is None, i or 0, size(t)) for i, t, *_ in ALL)
    for r in got:
        assert r["source_size"] == sizes[source[r["doc_id"]]] and r["target"] <= 2 * r["source_size"] + 1e-6
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    assert sum({(r["source_size"], r["target"]): r["target"] for r in got}.values()) == pytest.approx(1.5 * sum(sizes.values()), rel=1e-6) or len(set(sizes.values())) < len(sizes)


def test_op6_short_and_long_items(spark, folder):
    words = lambda t: (t or "").lower().split()
    sets = lambda t: {tuple(words(t)[k : k + 5]) for k in range(len(words(t)) - 4)}
    items = {r["item_id"]: sets(r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    want = {(d, i, len(x), len(sets(t) & x)) for d, t, *_ in ALL if d is not None for i, x in items.items() if len(sets(t) & x) >= 0.8 * len(x)}
    assert {tuple(r[c] for c in ("doc_id", "item_id", "item_shingles", "shared_shingles")) for r in rows(spark, folder, "op6_decontaminate")} == want
    assert {i for _, i, *_ in want} == {1, 2}


def test_op7(spark, folder):
    patterns = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    digits = lambda m: re.sub("[^0-9]", "", m)
    good = {"email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m.split(".")), "card": lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m)), "phone": lambda m: 9 <= len(digits(m)) <= 15}
    texts = {i: t for i, t, *_ in ALL}
    for r in rows(spark, folder, "op7_pii"):
        spans = sorted((m.start(), n, k, m.end()) for n, (k, p) in enumerate(patterns) for m in re.finditer(p, texts[r["doc_id"]] or "") if good[k](m.group()))
        base = ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert [r[f"n_{k}"] for k, _ in patterns] == [sum(s[2] == k for s in spans) for k, _ in patterns]
        assert ",".join(x for x in r["spans"].split(",") if not x.startswith("iban")) == base
        assert len([x for x in r["scores"].split(",") if x]) == len([x for x in r["spans"].split(",") if x])
        assert ("iban" in r["spans"]) == (r["doc_id"] == 20)


def test_pii_context_decides_added_spans(spark):
    from quarrymark.llm import pii

    def iban(country, rest):
        for check in range(100):
            number = f"{country}{check:02d}{rest}"
            if int("".join(str(int(c, 36)) for c in number[4:] + number[:4])) % 97 == 1:
                return number

    odd = iban("XX", "12345678901234567")  # no country registers it
    df = spark.createDataFrame([(1, f"code {odd} here"), (2, f"my bank account {odd} here")], "doc_id long, text string").withColumn("pii", F.lit("clash"))
    out = {r["doc_id"]: r["pii"] for r in pii.find_pii(df).collect()}
    assert not [s for s in out[1] if s["kind"] == "iban"] and [s["value"] for s in out[2] if s["kind"] == "iban"] == [odd]
    assert pii.find_pii(df).columns == ["doc_id", "text", "pii"]
    many = spark.createDataFrame([(1, " é ".join(f"u{k}@m{k}.com" for k in range(3000)))], "doc_id long, text string")
    assert pii.redact(pii.find_pii(many)).first()["redacted"] == " é ".join(["[email]"] * 3000)


def test_op8_against_the_model_read_in_plain_python(spark, folder):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"), usable=~out)
    reader, texts = toxicity.Reader(model.chars, model.known), {i: t for i, t, *_ in ALL}
    got = rows(spark, folder, "op8_toxicity")
    assert len(got) == len(ALL)
    for r in got:
        found = reader.text(texts[r["doc_id"]], reader.word)
        z = model.bias + sum(model.weights[f] for f in sorted(found) if f in model.weights)
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)
        assert (r["held_out"], r["predicted"]) == (held(r["doc_id"]), int(r["score"] >= 0.3))
    by = {r["doc_id"]: r["score"] for r in got}
    right = [(by[100 + k] >= 0.3) == (k % 4 == 0) for k in range(80) if held(100 + k)]
    assert np.mean(right) == 1 and by[22] > 0.3 and by[23] > 0.3


def test_op9(spark, folder):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path(queries.PIECE_TOKENIZER))
    texts = {i: t or "" for i, t, *_ in ALL}
    got = rows(spark, folder, "op9_token_counts")
    assert len(got) == len(ALL) and any(r["over_limit"] for r in got)
    for r in got:
        n = len(model.encode(texts[r["doc_id"]]))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 4096)


def test_op10(spark, folder):
    got = {r["conv_id"]: r for r in rows(spark, folder, "op10_chat_format")}
    assert set(got) == {1, 2} and got[2]["n_turns"] == 1
    assert BASE and got[1]["rendered"].endswith("<|end|>\n")
