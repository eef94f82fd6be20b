"""The training-data operators against plain Python, on small tables with every odd case."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymark.llm import chat, decontaminate, media, mixing, near_dedup, pii, quality, token_counts, token_files, toxicity
from quarrymark.llm.common import shingle_sets, word_hashes
from quarrymark.llm.queries import PIECE_TOKENIZER, WORD_TOKENIZER, tokenizer_path

BASE = " ".join(f"word{i}" for i in range(120))
ROWS = [
    (1, BASE, "en", "a"),
    (2, BASE.upper(), "en", "a"),
    (3, BASE.replace("word60", "other"), "en", "b"),
    (4, " ".join(f"item{i}" for i in range(90)), "en", "b"),
    (5, "few words here", "en", None),
    (6, "Few  words\there", "en", None),
    (7, "", "en", "c"),
    (8, None, None, None),
    (9, " \n\t ", "fr", "c"),
    (10, "x" * 30_000, "fr", "c"),
    (11, BASE + " " + " ".join(f"tail{i}" for i in range(3000)), "en", "a"),
    (11, BASE + " " + " ".join(f"tail{i}" for i in range(3000)), "en", "a"),
    (None, "no identifier but some words in it", "en", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumns({"size": F.lit("clash"), "copies": F.lit(-1), "n_shingles": F.lit(-1), "hash": F.lit(b"x"), "n_chars": F.length("text").cast("long")})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows, percent=85):
    ids = sorted({i for i, *_ in rows if i is not None})
    sets = {i: shingles(t) for i, t, *_ in rows if i is not None}
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            n = len(sets[a] & sets[b])
            if a < b and sets[a] and 100 * n >= percent * (len(sets[a] | sets[b])):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def test_word_hashes_and_shingles():
    h, first = word_hashes([b"Ab cd", b"", b"ab\tCD\n"])
    assert list(first) == [0, 2, 2, 4] and h[0] == h[2] and h[1] == h[3] and h[0] != h[1]
    assert [len(s) for s in shingle_sets([b"a b c d e f", b"a b", b" ", b"a a a a a a"], 5)] == [2, 1, 0, 1]


def test_near_duplicates(spark, docs, empty):
    rows = near_dedup.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    want, sizes = brute_components(ROWS)
    for r in rows:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["component_id"], r["n_shingles"], r["kept"]) == (want[r["doc_id"]], sizes[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])
    assert near_dedup.near_duplicates(empty).count() == 0


def test_dense_regions_lose_no_link(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(160):  # variants that link to some others only
        words = [f"w{k}" for k in range(100)]
        for k in rng.integers(0, 100, 2):
            words[k] = f"v{rng.integers(0, 4)}"
        rows.append((i, " ".join(words)))
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)[0]


def test_media(docs, empty):
    rows = media.digest(media.fingerprints(media.encode_wav(docs))).collect()
    by = {r["doc_id"]: r for r in rows}
    for i, t, *_ in ROWS:
        data = (t or "").encode()
        padded = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
        r = by[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert by[7]["feature"] == by[8]["feature"] and len(rows) == len(ROWS)
    assert media.from_wav(media.to_wav(b"abc"))[:3] == b"abc" and media.fingerprints(media.encode_wav(empty)).count() == 0
    tone = bytes((128 + 100 * np.sin(np.arange(1024) * 2 * np.pi * 32 / 256)).astype(np.uint8))
    assert 32 in media.peaks(tone)[1]


def test_quality_orders_three_grades(spark, docs, empty):
    rng = np.random.default_rng(1)
    kinds = (["###", "!!!"], ["plain", "words"], ["fine", "prose"])
    data = [(i, " ".join(rng.choice(kinds[i % 3], 40)), i % 3) for i in range(240)]
    table = spark.createDataFrame(data, "doc_id long, text string, quality int")
    model = quality.fit(table.select("doc_id", "text"), table.where("doc_id < 150"))
    assert model.grades == [0, 1, 2] and model.thresholds[0] < model.thresholds[1]
    out = quality.grade(table, model).where("doc_id >= 150").select("quality", "quality_grade.*").collect()
    assert np.mean([abs(r["expected"] - r["quality"]) < 0.5 for r in out]) > 0.95
    assert all(r["tails"][0] >= r["tails"][1] for r in out)
    assert quality.grade(docs, model).count() == len(ROWS) and quality.grade(empty, model).count() == 0
    none = quality.fit(docs, table.limit(0))
    assert quality.grade(docs, none).where(quality.selected()).count() == len(ROWS)


def test_token_files(docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path(WORD_TOKENIZER))
    rows = sorted(token_files.token_files(docs, tokenizer_path(WORD_TOKENIZER)).collect(), key=lambda r: r["start"])
    at = 0
    for r, (i, t, *_) in zip(rows, sorted(ROWS, key=lambda x: (x[0] is not None, x[0] or 0)), strict=True):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_files.token_files(empty, tokenizer_path(WORD_TOKENIZER)).count() == 0


@pytest.mark.parametrize("bits", [1, 7, 13, 16, 17, 32])
def test_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1001, dtype=np.uint64).astype(np.uint32)
    packed = token_files.pack(ids, bits)
    assert len(packed) == -(-1001 * bits // 8)
    assert (token_files.unpack(packed, bits, 0, 1001) == ids).all() and (token_files.unpack(packed, bits, 17, 400) == ids[17:417]).all()


def test_encoder_equals_library_on_odd_texts():
    own = token_files.WordEncoder(tokenizer_path(WORD_TOKENIZER))
    texts = ["", "don't I've <|endoftext|> a<|startoftext|>b Ünï", "A. b, C! »d.« x!!! ÉTÉ. ñ.", "\x00 a b", "É kK"]
    assert [x.tolist() for x in own.encode([t.encode() for t in texts])] == [own.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_mixing(spark, docs, empty):
    rng = np.random.default_rng(2)
    extra = [(100 + i, " ".join(["t"] * int(n)), "en", f"s{i % 4}") for i, n in enumerate(rng.integers(1, 60, 200))] + [(500 + i, "same text twice", "en", "s0") for i in range(120)]
    table = docs.select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string, source string"))
    rows = mixing.mix(table).collect()
    assert len(rows) == len(ROWS) + len(extra)
    sizes = defaultdict(int)
    for _, t, _, s in [*ROWS, *extra]:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    goal, free, budget = {}, set(sizes), 1.5 * sum(sizes.values())
    while True:
        level = (budget - sum(goal.values())) / sum(weights[s] for s in free)
        over = [s for s in free if weights[s] * level > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            goal[s] = 2 * sizes[s]
            free.discard(s)
    goal |= {s: weights[s] * level for s in free}
    taken = defaultdict(int)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], goal[r["source"]]) and 0 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
    for s in ("s0", "s1", "s2", "s3"):
        assert abs(taken[s] - goal[s]) <= max(3, 0.02 * goal[s])
    again = {(r["doc_id"], r["size"]): r["copies"] for r in mixing.mix(table.repartition(3)).collect()}
    assert all(again[r["doc_id"], r["size"]] == r["copies"] for r in rows if r["doc_id"] != 11)
    assert mixing.mix(empty).count() == 0


@pytest.mark.parametrize("rows", [[(1, "some words here", "a"), (2, None, "b"), (3, " ", "b"), (4, None, None), (5, "more of them", "a")], [(1, None, "a"), (2, "", "b"), (3, "\t\n", None)]])
def test_mixing_returns_sources_without_words(spark, rows):
    got = {r["doc_id"]: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert sorted(got) == [i for i, *_ in rows]
    for i, text, source in rows:
        if not (text or "").strip():
            assert (got[i]["source"], got[i]["size"], got[i]["copies"], got[i]["source_size"]) == (source, 0, 0, 0)
            assert got[i]["target"] == 0


def test_decontamination(spark, docs, empty):
    items = [(1, " ".join(f"word{i}" for i in range(40, 60))), (2, " ".join(f"tail{i}" for i in range(10, 30)).replace("tail20", "zzz")), (3, "few words"), (4, None), (5, " ".join(f"tail{i}" for i in range(70, 76))), (6, " ".join(f"tail{i}" for i in range(20)).replace("tail5", "q").replace("tail12", "q")), (None, BASE)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    sh = lambda t, n=5: {tuple(w[k : k + n]) for w in [(t or "").lower().split()] for k in range(len(w) - n + 1)}
    width = lambda x: min(5, len((x or "").split()))  # noqa: E731  (shorter items are one shingle)
    want = {(d, i): len(sh(t, width(x)) & sh(x, width(x))) for d, t, *_ in ROWS if d is not None for i, x in items if i is not None and width(x) and len(sh(t, width(x)) & sh(x, width(x))) >= 0.8 * len(sh(x, width(x)))}
    got = {(r["doc_id"], r["item_id"]): r["shared_shingles"] for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == want and {3, 1} <= {i for _, i in want}
    assert decontaminate.contaminated(empty, bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def luhn(s):
    return sum((v - 9 if v > 9 else v) for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(s)))) % 10 == 0


def test_pii(spark, docs, empty):
    texts = ["mail a.b@c.de_x@y.zz! 1.2.3.4.5.6.7.8 999.1.1.1 10.0.0.255", "card 4111 1111 1111 1111 and 4111-1111-1111-1112, +1 (988) 555-2485.", "é😀 x@y.z +49 30 1234567 \x01\x02 a@b.cd", "1" * 20_000, "a" * 20_000 + "@", None, "", "iban DE89 3704 0044 0532 0130 00 or DE88370400440532013000", "@.@ +1 + +12-", "0" * 15 + ".1.1.1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.find_pii(df).withColumn("s", pii.render(F.col("pii"))).collect()}
    patterns = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    good = {"email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m.split(".")), "card": lambda m: 12 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m)), "phone": lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15}
    for i, t in enumerate(texts):
        if t and len(t) > 10_000:
            continue
        spans = sorted((m.start(), n, k, m.end()) for n, (k, p) in enumerate(patterns) for m in re.finditer(p, t or "") if good[k](m.group()))
        base = ",".join(x for x in found[i]["s"].split(",") if not x.startswith("iban"))
        assert base == ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
    assert found[3]["s"] == "" and found[4]["s"] == ""
    assert "iban:5:32" in found[7]["s"] and found[7]["s"].count("iban") == 1
    assert found[1]["pii"][0]["score"] > 0.8  # "card" stands before it
    assert pii.redact(pii.find_pii(df)).where("doc_id = 2").first()["redacted"].endswith("[email]")
    assert pii.find_pii(docs).count() == len(ROWS) and pii.find_pii(empty).count() == 0


def test_toxicity(spark, docs, empty):
    rng = np.random.default_rng(5)
    calm = [f"calm{k}" for k in range(50)]
    data = [(i, " ".join([*rng.choice(calm, 30), *(["grumblefoot"] if i % 5 == 0 else ["stonewall"])]), int(i % 5 == 0)) for i in range(400)]
    table = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    model = toxicity.fit(table.select("doc_id", "text"), table)
    tests = ["calm1 grumblefoot calm2", "calm3 calm4", "calm1 gr0mblef00t", "calm1 grrrumblefooot calm", "calm1 g.r.u.m.b.l.e.f.o.o.t", "calm1 g r u m b l e f o o t calm2", "calm1 GRUMBLEF00T", "", None]
    out = [r["toxicity"] for r in toxicity.score(spark.createDataFrame(list(enumerate(tests)), "doc_id long, text string"), model).orderBy("doc_id").collect()]
    assert out[0] > 0.5 and out[1] < 0.3 and out[7] == out[8] < 0.3
    assert sum(x > 0.3 for x in out[2:7]) >= 4
    assert toxicity.score(docs, model).count() == len(ROWS) and toxicity.score(empty, model).count() == 0
    blank = toxicity.fit(docs, table.limit(0))
    assert all(0 <= r["toxicity"] <= 1 for r in toxicity.score(docs, blank).collect())


def toxic_model(spark, toxic):
    """A model over calm words, some doubled, and one toxic word a document."""
    rng = np.random.default_rng(5)
    calm = ["the", "letter", "good", "summer", "people", "water", "garden", "window", "hello", "mountain", "river", "story", "market", "evening"]
    data = [(i, " ".join([*rng.choice(calm, 30), *([toxic[i // 5 % len(toxic)]] if i % 5 == 0 else ["stonewall"])]), int(i % 5 == 0)) for i in range(400)]
    table = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    return toxicity.fit(table.select("doc_id", "text"), table)


def toxic_scores(spark, model, tests):
    return [r["toxicity"] for r in toxicity.score(spark.createDataFrame(list(enumerate(tests)), "doc_id long, text string"), model).orderBy("doc_id").collect()]


def test_toxicity_reads_long_runs_to_their_end(spark):
    model = toxic_model(spark, ["grumblefoot", "\u574f\u4eba\u8fc7\u6765"])
    fill = ["river", "garden", "window", "mountain", "evening", "market", "story", "water"] * 3
    bad = [c.join([*fill, "grumblefoot", *fill]) for c in (",", "_", "-", "/", "")]
    bad += [".....".join("grumblefoot"), "g" * 60 + "rumblefoot", "\u4f60\u597d\u6c34\u5c71" * 15 + "\u574f\u4eba\u8fc7\u6765" + "\u4f60\u597d\u6c34\u5c71" * 15]
    good = [c.join([*fill, *fill]) for c in (",", "_", "-", "/", "")] + [".....".join("mountain"), "g" * 60 + "arden", "\u4f60\u597d\u6c34\u5c71" * 30]
    out = toxic_scores(spark, model, bad + good)
    assert min(out[: len(bad)]) > 0.3 > max(out[len(bad) :]), out


def test_toxicity_decodes_every_disguise(spark):
    model = toxic_model(spark, ["idiot", "moron", "worthless", "ass"])
    bad = ["id.iot", "mor-on", "wo.rth.less", "idi*ot", "mooron", "iidiot", "a s s", "a$s", "a$$", "(m.o.ron).", "i d i o t", "wwoorthless"]
    good = ["let.ter", "gar-den", "sum.mer", "wa*ter", "goood", "rriver", "t h e", "w1ndow", "peop|e", "(m.a.rket).", "w a t e r", "ggaarden"]
    out = toxic_scores(spark, model, [f"the river {x} water" for x in bad + good])
    assert min(out[: len(bad)]) > 0.3 > max(out[len(bad) :]), list(zip(bad + good, out, strict=True))


def test_toxicity_pieces_hold_every_character():
    for n in (0, 1, 39, 40, 41, 60, 61, 80, 99, 1000):
        run = "".join(chr(0x4000 + k) for k in range(n))
        cut = toxicity.pieces(run)
        assert set("".join(cut)) == set(run) and all(len(p) <= toxicity.LONGEST for p in cut)
        assert all(any(run[k : k + 20] in p for p in cut) for k in range(max(1, n - 19)))


def test_prefix_counts_equal_library(docs, empty):
    import sentencepiece

    path = tokenizer_path(PIECE_TOKENIZER)
    model, own = sentencepiece.SentencePieceProcessor(model_file=path), token_counts.PrefixCounter(path)
    for t in ("", " ", "Hello  world\nagain\n\n x", "▁a ▁▁b", "é́ ﬁ 你好 😀<s></s>", "def f(x):\n    return x..", "x" * 80):
        assert own.prefix_counts(t).tolist() == [len(model.encode(t[:k])) for k in range(len(t) + 1)]
    rows = token_counts.token_counts(docs, path, 100).collect()
    for r in rows:
        assert r["tokens"]["n_tokens"] == len(model.encode(r["text"] or ""))
        fits = r["tokens"]["fits"]
        assert len(model.encode((r["text"] or "")[:fits])) <= 100
    assert token_counts.token_counts(empty, path, 1).count() == 0
    assert token_counts.prefix_tables(docs.where("doc_id = 5"), path).first()["prefix_counts"][-1] == len(model.encode("few words here"))


def test_prefix_counts_equal_library_with_little_memory():
    import sentencepiece

    path = tokenizer_path(PIECE_TOKENIZER)
    model, own = sentencepiece.SentencePieceProcessor(model_file=path), token_counts.PrefixCounter(path)
    own.MOST_KNOWN = own.MOST_HEADS = 3
    own.MOST_STEPS = 0
    rng = random.Random(11)
    words = "the of ing unbelievable 中文字 Привет über 12345 😀 é́ http://x.y/z?a=b <s> ▁ \x00 \u200b \u00a0 xxxxxxxxxxxx".split(" ")
    for _ in range(300):
        t = "".join(rng.choice(words) + rng.choice(["", " ", "  ", "\n", "...", "!!!"]) for _ in range(rng.randrange(12)))
        counts, cut = own.prefix_counts(t), rng.randrange(len(t) + 1)
        assert (counts[-1], counts[cut]) == (len(model.encode(t)), len(model.encode(t[:cut])))


def rendering(turns):
    return "".join(f"<|{r}|>\n{t}\n<|end|>\n" for r, t in turns)


def test_chat(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    grouped = chat.parts(turns)
    model = chat.fit(grouped)
    text = "User: hi there?\nAssistant: First line.\nsecond line of it\n### Human: more?\n[agent] done"
    assert [r for r, _ in model.parse(text)] == ["user", "assistant", "user", "assistant"]
    assert model.parse(text)[1][1] == "First line.\nsecond line of it"
    rows = grouped.collect()
    gold = {(r["conv_id"], r["part"]): ",".join(t["role"] for t in r["turns"]) for r in rows}
    raw = {(r["conv_id"], r["part"]): r["transcript"] for r in chat.as_transcripts(grouped).collect()}
    out = chat.format_transcripts(chat.as_transcripts(grouped), model).collect()
    assert len(out) == len(gold) and np.mean([gold[r["conv_id"], r["part"]] == r["roles"] for r in out]) > 0.8
    for r in out:  # the query's rows against the model read alone, one conversation at a time
        alone = model.parse(raw[r["conv_id"], r["part"]])
        assert (r["n_turns"], r["roles"], r["rendered"]) == (len(alone), ",".join(x for x, _ in alone), rendering(alone))
    odd = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "assistant", "a"), (1, None, None, None), (None, 3, "tool", ""), (1, 2000, "ASSISTANT", "x" * 5000)], "conv_id long, turn long, role string, text string").withColumn("part", F.lit("clash"))
    assert chat.format_transcripts(chat.as_transcripts(chat.parts(odd)), model).count() == 4
    assert chat.format_transcripts(chat.as_transcripts(chat.parts(odd.limit(0))), model).count() == 0


def best_path(model, lines):
    """The best score by trying every path."""
    import itertools

    emit = [model.mark[:, m] + model.size[:, z] + model.asks[:, a] for m, z, a in map(chat.observe, lines)]
    score = lambda p: model.start[p[0]] + emit[0][p[0]] + sum(model.step[a, b] + e[b] for a, b, e in zip(p[:-1], p[1:], emit[1:], strict=True))
    return max(itertools.product(range(chat.STATES), repeat=len(lines)), key=score)


def test_chat_viterbi_is_the_best_of_all_paths(spark, sf_dir):
    model = chat.fit(chat.parts(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    for lines in (["User: a?", "b", "Assistant: c"], ["no marker", "[agent] x", "y" * 300, "[customer] z?"], [""], ["A: b", "Q: c?", "Note: d", "e", "f?"]):
        assert model.states(lines) == list(best_path(model, lines))


def test_chat_parts_change_nothing(spark):
    rng = np.random.default_rng(4)
    line = lambda: " ".join(rng.choice(["well", "the", "river", "why?", "User:", "so"], int(rng.integers(1, 30))))
    turns = [(1, k, ("user", "assistant")[k % 2], "\n".join(line() for _ in range(int(rng.integers(1, 4))))) for k in range(3 * chat.PART)]
    grouped = chat.parts(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    model = chat.fit(grouped)
    out = sorted(chat.format_transcripts(chat.as_transcripts(grouped), model).collect(), key=lambda r: r["part"])
    assert [r["part"] for r in out] == [0, 1, 2]
    raw = sorted(chat.as_transcripts(grouped).collect(), key=lambda r: r["part"])
    whole = model.parse("\n".join(r["transcript"] for r in raw))
    assert ",".join(r["roles"] for r in out) == ",".join(r for r, _ in whole)
    assert "".join(r["rendered"] for r in out) == rendering(whole)
