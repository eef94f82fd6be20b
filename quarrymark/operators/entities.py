"""Entity resolution: strong keys, fuzzy pairs in blocks, connected components, merging of groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..scratch import Scratch

SCALARS = ("legal_name", "inn", "address", "minimum_order", "minimum_order_kg", "price", "delivery", "phone", "phone_raw", "email", "website", "domain")
LISTS = ("product_categories", "matched_products", "contract_products", "regions", "certificates", "discovery_queries", "source_urls")
SIMILAR = 90
#: Blocks of at most as many names are compared pair by pair; larger ones by what is left of names, where a name has at most as many forms with characters left out.
SMALL_BLOCK, MOST_LEFT_OUT = 32, 1024


def normalize_suppliers(suppliers: DataFrame) -> DataFrame:
    """Suppliers in common form: addresses, contacts, regions, minimum in kilograms; evidence sources join the sources."""
    raw = F.coalesce(C.blank_to_null("phone_raw"), C.blank_to_null("phone"))
    evidence = F.transform("evidence", lambda e: e.withField("source_url", F.coalesce(C.normalize_url(e["source_url"]), e["source_url"])))
    kilograms = F.coalesce(F.nullif("minimum_order_kg", F.lit(0.0)), C.parse_weight_kg("minimum_order"))
    out = suppliers.withColumns({"domain": C.normalize_domain("website"), "website": C.normalize_url("website"), "phone_raw": raw, "phone": C.normalize_phone(raw), "email": C.normalize_email("email"), "inn": C.normalize_inn("inn"), "regions": C.normalize_regions("regions"), "minimum_order_kg": kilograms, "evidence": evidence})
    urls = F.concat(F.transform("source_urls", C.normalize_url), F.transform("evidence", lambda e: e["source_url"]))
    return out.withColumn("source_urls", C.distinct_non_null(urls))


def strong_keys(suppliers: DataFrame) -> DataFrame:
    """(ord, key): identifiers, domains, tax numbers and phones that make two records one company."""
    key = lambda name, value: F.when(C.blank_to_null(value).isNotNull(), F.concat(F.lit(f"{name}:"), value))
    domain = F.coalesce(C.blank_to_null("domain"), C.normalize_domain("website"))
    keys = F.array_compact(F.array(key("id", F.col("id")), key("domain", domain), key("inn", F.col("inn")), key("phone", F.col("phone"))))
    return suppliers.select("ord", F.explode(keys).alias("key"))


def strong_edges(suppliers: DataFrame) -> DataFrame:
    """(a, b): each record linked to the first one with the same key; a hot key gives a star, no pairs."""
    keys = strong_keys(suppliers).distinct()
    first = keys.groupBy("key").agg(F.min("ord").alias("b"))
    return keys.join(first, "key").where("ord <> b").select(F.col("ord").alias("a"), "b").distinct()


def token_set_ratio(a, b):
    """The best ratio among shared words and shared words with each side's rest; 100 if one side is contained."""
    words = lambda x: F.array_distinct(F.filter(F.split(x, r"(?U)\s+"), lambda w: w != ""))
    text = lambda arr: F.array_join(F.sort_array(arr), " ")

    def compare(v):
        shared, left, right = v["shared"], F.trim(F.concat_ws(" ", v["shared"], v["a"])), F.trim(F.concat_ws(" ", v["shared"], v["b"]))
        contained = (shared != "") & ((v["a"] == "") | (v["b"] == ""))
        with_shared = F.when(shared != "", F.greatest(C.indel_ratio(shared, left), C.indel_ratio(shared, right))).otherwise(0.0)
        return F.when(contained, F.lit(100.0)).otherwise(F.greatest(C.indel_ratio(left, right), with_shared))

    def parts(v):
        return C.bind(F.struct(text(F.array_intersect(v["a"], v["b"])).alias("shared"), text(F.array_except(v["a"], v["b"])).alias("a"), text(F.array_except(v["b"], v["a"])).alias("b")), compare)

    return F.when(a.isNotNull() & b.isNotNull(), C.bind(F.struct(words(a).alias("a"), words(b).alias("b")), parts))


def _sorted_words(x):
    return F.sort_array(F.array_distinct(F.filter(F.split(x, r"(?U)\s+"), lambda w: w != "")))


def _grams(x):
    """Character pairs of a text with a mark before it; an empty text has the mark alone."""
    marked = F.concat(F.lit("^"), x)
    return F.when(F.length(x) == 0, F.array(F.lit("^"))).otherwise(F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.substring(marked, i, F.lit(2))))


def _prefix(grams, text):
    """Of the numbered pairs, as many in hash order as two texts 90 alike must share one of.

    Texts 90 alike differ by at most 2/9 of the length of either in inserted and deleted
    characters, each of which changes two pairs at most.
    """
    numbered = F.transform(grams, lambda g, i: F.xxhash64(g, F.size(F.filter(F.slice(grams, F.lit(1), i + 1), lambda h: h == g))))
    return F.slice(F.sort_array(numbered), F.lit(1), (2 * F.floor(F.length(text) * 2 / 9 + 1e-9) + 1).cast("int"))


def alike(a, b):
    """Whether the indel ratio of two texts is at least 90, by the subsequence only where the edit distance leaves it open.

    Inserted and deleted characters are at least the edit distance and at most twice that.
    """
    total, edits = F.length(a) + F.length(b), F.levenshtein(a, b)
    return F.when(10 * edits > total, False).when(20 * edits <= total, True).otherwise(C.indel_ratio(a, b) >= SIMILAR)


def alike_addresses(a, b):
    """Whether ``token_set_ratio`` of two texts of words is at least 90; shared words begin both sides, so lengths tell their ratio."""
    words = lambda x: F.split(x, " ")
    text = lambda arr: F.array_join(F.sort_array(arr), " ")

    def compare(v):
        left, right = F.trim(F.concat_ws(" ", v["shared"], v["a"])), F.trim(F.concat_ws(" ", v["shared"], v["b"]))
        shared, shorter = F.length(v["shared"]), F.least(F.length(left), F.length(right))
        return F.when(shared == 0, alike(left, right)).when((v["a"] == "") | (v["b"] == "") | (11 * shared >= 9 * shorter), True).otherwise(alike(left, right))

    def parts(v):
        return C.bind(F.struct(text(F.array_intersect(v["a"], v["b"])).alias("shared"), text(F.array_except(v["a"], v["b"])).alias("a"), text(F.array_except(v["b"], v["a"])).alias("b")), compare)

    return C.bind(F.struct(words(a).alias("a"), words(b).alias("b")), parts)


def _members(suppliers: DataFrame) -> DataFrame:
    """(ord, form, name, address, mail) of records that a name and something beside it can link; ``form`` is the first record with the same three.

    Words of names are sorted, those of addresses sorted and distinct, as their ratios take them.
    """
    ordered = lambda x: F.array_join(F.sort_array(F.filter(F.split(x, r"(?U)\s+"), lambda w: w != "")), " ")
    rows = suppliers.select("ord", C.normalize_company_name("name").alias("name"), F.lower(C.clean_text("address")).alias("address"), C.blank_to_null(F.regexp_extract(F.coalesce("email", F.lit("")), "@(.+)$", 1)).alias("mail"))
    rows = rows.where("name is not null and (address is not null or mail is not null)")
    rows = rows.select("ord", ordered(F.col("name")).alias("name"), F.array_join(_sorted_words(F.col("address")), " ").alias("address"), "mail")
    rows = materialise(rows, suppliers.sparkSession)
    first = rows.groupBy(F.col("name").alias("n"), F.col("address").alias("a"), F.col("mail").alias("m")).agg(F.min("ord").alias("form"))
    same = (F.col("name") == F.col("n")) & F.col("address").eqNullSafe(F.col("a")) & F.col("mail").eqNullSafe(F.col("m"))
    return materialise(rows.join(first, same).select("ord", "form", "name", "address", "mail"), suppliers.sparkSession)


def _blocks(forms: DataFrame) -> DataFrame:
    """(form, name, address, block, same): where ``same``, alike names of a block are linked, else if their addresses are alike too.

    Same are the e-mail domain and the address. Other addresses 90 alike share a word or are 90 alike
    as strings of sorted words, so they share a longer part of a word, a short word or one of the
    first pairs of characters.
    """
    words, parts = F.split("address", " "), F.split("address", r"(?U)[\s,.]+")
    short = F.filter(words, lambda w: ~F.exists(F.split(w, r"[\s,.]+"), lambda v: F.length(v) > 2))
    rows = forms.select("form", "name", "address", "mail", _grams(F.col("address")).alias("pairs"))
    others = F.concat(F.transform(F.filter(parts, lambda w: F.length(w) > 2), lambda w: F.concat(F.lit("a:"), w)), F.transform(short, lambda w: F.concat(F.lit("s:"), w)), F.transform(_prefix(F.col("pairs"), F.col("address")), lambda k: F.concat(F.lit("g:"), k.cast("string"))))
    block = lambda b, same: F.struct(b.alias("block"), F.lit(same).alias("same"))
    own = F.array(block(F.concat(F.lit("m:"), F.col("mail")), True), block(F.concat(F.lit("e:"), F.col("address")), True))
    every = F.concat(own, F.coalesce(F.transform(F.array_distinct(others), lambda b: block(b, False)), F.array().cast("array<struct<block:string,same:boolean>>")))
    return rows.select("form", "name", "address", F.explode(every).alias("b")).select("form", "name", "address", "b.block", "b.same").where("block is not null")


def _choices(n, k):
    """Ways to leave out k of n characters; beyond three too many to list."""
    return F.when(k == 0, F.lit(1)).when(k == 1, n).when(k == 2, n * (n - 1) / 2).when(k == 3, n * (n - 1) * (n - 2) / 6).otherwise(F.lit(1 << 30))


def _shorter(texts):
    """Of (text, at) all texts with one more character left out, from place ``at`` on, so that each choice comes once."""
    places = lambda v: F.when(v["at"] <= F.length(v["text"]), F.sequence(v["at"], F.length(v["text"]))).otherwise(F.array().cast("array<int>"))
    cut = lambda v, i: F.struct(F.concat(F.substring(v["text"], F.lit(1), i - 1), F.substring(v["text"], i + 1, F.length(v["text"]))).alias("text"), i.alias("at"))
    return F.flatten(F.transform(texts, lambda v: F.transform(places(v), lambda i: cut(v, i))))


def _keyed(blocks: DataFrame) -> DataFrame:
    """Rows of blocks with a ``key`` that every two alike names of a block share.

    A block of few rows has one key, which is all its pairs. In a larger one, names of a and b
    characters are alike if they have ceil(0.45 (a + b)) characters in common in order: the names
    left when the others are taken out ("v" and the rest) are keys, for the lengths that the block has
    and where they are few. Where they are not, keys are pairs of characters ("p").
    """
    long, none = F.length("name"), F.array().cast("array<string>")
    stats = blocks.groupBy("block").agg(F.count("*").alias("n"), F.collect_set(long).alias("lengths"), F.coalesce(F.min("address") != F.max("address"), F.lit(False)).alias("several"))
    rows = blocks.join(stats.where("n > 1"), "block").where("same or several").withColumn("a", long)
    most = F.when(F.col("same"), MOST_LEFT_OUT).otherwise(MOST_LEFT_OUT // 16)
    common = lambda b: F.floor((9 * (F.col("a") + b) + 19) / 20).cast("int")
    few = lambda b: F.greatest(_choices(F.col("a"), F.col("a") - common(b)), _choices(b, b - common(b))) <= most
    near = F.filter("lengths", lambda b: (9 * b <= 11 * F.col("a")) & (9 * F.col("a") <= 11 * b))
    rows = rows.withColumn("near", F.when(F.col("n") > SMALL_BLOCK, near).otherwise(F.array().cast("array<int>")))
    rows = rows.withColumns({"left_out": F.array_distinct(F.transform(F.filter("near", few), lambda b: F.col("a") - common(b))), "paired": F.exists("near", lambda b: ~few(b)), "t0": F.array(F.struct(F.col("name").alias("text"), F.lit(1).alias("at")))})
    for k in (1, 2, 3):  # a projection for each step: each array is made once
        rows = rows.withColumn(f"t{k}", F.when(F.array_max("left_out") >= k, _shorter(F.col(f"t{k - 1}"))))
    taken = lambda k: F.when(F.array_contains("left_out", k), F.array_distinct(F.transform(f"t{k}", lambda v: F.concat(F.lit("v"), v["text"])))).otherwise(none)
    rows = rows.withColumn("grams", F.when(F.col("paired"), _grams(F.col("name"))))
    pairs = F.when(F.col("paired"), F.transform(_prefix(F.col("grams"), F.col("name")), lambda k: F.concat(F.lit("p"), k.cast("string")))).otherwise(none)
    keys = F.when(F.col("n") <= SMALL_BLOCK, F.array(F.lit(""))).otherwise(F.concat(*[taken(k) for k in range(4)], pairs))
    return rows.select("form", "name", "address", "block", "same", F.explode(keys).alias("key"))


def _alike_pairs(keyed: DataFrame, apart: bool = False) -> DataFrame:
    """Distinct (x, y) of forms that share a key and are alike; with ``apart`` only those of different ``component``.

    Of two such at least one is outside of the smallest component under the key, so a key whose rows
    are mostly of that one makes few pairs.
    """
    fields = ["form", "name", "address", *(["component", "head"] if apart else [])]
    rows = keyed.withColumn("head", F.min("component").over(Window.partitionBy("block", "key"))) if apart else keyed
    one = lambda at, df: df.select("block", "key", "same", F.struct(*fields).alias(at))
    pairs = one("l", rows.where("component <> head") if apart else rows).join(one("r", rows).drop("same"), ["block", "key"])
    pairs = pairs.where("l.component <> r.component and (r.component = r.head or l.form < r.form)" if apart else "l.form < r.form")
    total = F.length("l.name") + F.length("r.name")
    pairs = pairs.where((F.col("same") | (F.col("l.address") != F.col("r.address"))) & (10 * F.abs(F.length("l.name") - F.length("r.name")) <= total) & (10 * F.levenshtein("l.name", "r.name") <= total))
    pairs = pairs.select("same", F.least("l.form", "r.form").alias("x"), F.greatest("l.form", "r.form").alias("y"), F.col("l.name").alias("n"), F.col("r.name").alias("m"), F.col("l.address").alias("a"), F.col("r.address").alias("b"))
    # dealt by a number of its own, as a few MB of pairs are work for more than one task
    dealt = pairs.repartition(int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")), "x", "y").distinct()
    return dealt.where(alike(F.col("n"), F.col("m")) & (F.col("same") | alike_addresses(F.col("a"), F.col("b")))).select("x", "y").distinct()


def fuzzy_edges(suppliers: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of alike names backed by the same e-mail domain or alike addresses.

    Records with the same name, address and domain are compared once and their pairs put in after that.
    """
    members = _members(suppliers)
    forms = _alike_pairs(_keyed(_blocks(members.where("ord = form"))))
    own = lambda at: members.select(F.col("form").alias(at), F.col("ord").alias(f"{at}_ord"))
    across = forms.join(own("x"), "x").join(own("y"), "y")
    within = own("x").join(own("y"), F.col("x") == F.col("y")).where("x_ord < y_ord")
    pairs = across.select("x_ord", "y_ord").unionByName(within.select("x_ord", "y_ord"))
    return pairs.select(F.least("x_ord", "y_ord").alias("a"), F.greatest("x_ord", "y_ord").alias("b"))


def company_components(suppliers: DataFrame) -> DataFrame:
    """(ord, component) under strong keys and ``fuzzy_edges``, whose pairs are not all listed.

    Names that share what is left of them are alike among themselves if they are short enough, so under the same
    backing a link to the shortest stands for all their pairs. What is left is compared between
    records that these links and the strong keys leave apart.
    """
    spark = suppliers.sparkSession
    members = _members(suppliers)
    every = _blocks(members.where("ord = form"))
    # of forms with the same name in a block one stands for all
    units = every.where("not same").unionByName(every.where("same").groupBy("block", "same", "name").agg(F.min("form").alias("form"), F.first("address").alias("address")))
    named = every.where("same").join(units.where("same").select("block", "name", F.col("form").alias("first")), ["block", "name"]).select(F.col("form").alias("a"), F.col("first").alias("b"))
    keyed = materialise(_keyed(units), spark)
    left = keyed.where("same and key like 'v%'").select("form", "block", "key", F.length("name").alias("long"))
    head = left.groupBy("block", "key").agg(F.min(F.struct("long", "form")).alias("head"))
    stars = left.join(head, ["block", "key"]).where(20 * (F.length("key") - 1) >= 9 * (F.col("long") + F.col("head.long"))).select(F.col("form").alias("a"), F.col("head.form").alias("b"))
    own = members.select(F.col("ord").alias("a"), F.col("form").alias("b"))
    # what only pairs tell is first asked of neighbours in the order of names, so that the like of one template are together by then
    others = keyed.where("not (same and key like 'v%') and key <> ''")
    before = others.withColumn("l", F.lag(F.struct("form", "name", "address")).over(Window.partitionBy("block", "key").orderBy("name", "form")))
    surely = before.where(20 * F.levenshtein("l.name", "name") <= F.length("l.name") + F.length("name")).select("same", F.col("l.form").alias("a"), F.col("form").alias("b"), F.col("l.address").alias("c"), F.col("address").alias("d"))
    stars = stars.unionByName(surely.distinct().where(F.col("same") | alike_addresses(F.col("c"), F.col("d"))).select("a", "b"))
    links = strong_edges(suppliers).unionByName(own).unionByName(named).unionByName(stars).where("a <> b")
    found = connected_components(suppliers.select("ord"), links)
    rest = keyed.where("not (same and key like 'v%')").join(found.select(F.col("ord").alias("form"), "component"), "form")
    apart = materialise(_alike_pairs(rest, True).select(F.col("x").alias("a"), F.col("y").alias("b")), spark)
    if apart.isEmpty():
        return found
    return connected_components(found, found.select(F.col("ord").alias("a"), F.col("component").alias("b")).unionByName(apart))


def materialise(df: DataFrame, spark: SparkSession) -> DataFrame:
    """Cuts plan and lineage by a table in the shared folder, which survives lost executors."""
    return Scratch(spark, "entities").write(df, "table")


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(ord, component) of each distinct node: the smallest ord reachable, by minima over neighbours and pointer jumping.

    The joins are merged, never broadcast: a round's tables would pass through the driver, round after round.
    """
    spark = nodes.sparkSession
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), spark)
    labels = materialise(nodes.select("ord").distinct().withColumn("component", F.col("ord")), spark)
    while True:
        near = both.join(labels.select(F.col("ord").alias("b"), "component").hint("merge"), "b").groupBy(F.col("a").alias("ord")).agg(F.min("component").alias("near"))
        lower = labels.join(near.hint("merge"), "ord", "left").select("ord", "component", F.least("component", F.coalesce("near", "component")).alias("next"))
        jump = lower.alias("x").join(lower.select(F.col("ord").alias("o"), F.col("next").alias("far")).hint("merge").alias("y"), F.col("x.next") == F.col("y.o"), "left")
        moved = materialise(jump.select("ord", "component", F.least("next", F.coalesce("far", "next")).alias("next")), spark)
        changed = not moved.where("next <> component").isEmpty()
        labels = moved.select("ord", F.col("next").alias("component"))
        if not changed:
            return labels


def merge_groups(suppliers: DataFrame, components: DataFrame) -> DataFrame:
    """One record per component.

    Newest records come first. A single field takes the value with the best evidence, then the
    newest; lists and evidence are united in that order; name and everything else come from the
    newest record with a website, else the newest.
    """
    rows = suppliers.join(components, "ord")
    order = F.row_number().over(Window.partitionBy("component").orderBy(F.desc("checked_at"), "ord"))
    rows = rows.withColumn("_n", order)
    trust = lambda f: F.coalesce(F.array_max(F.transform(F.filter("evidence", lambda e: e["field_name"] == f), lambda e: e["confidence"])), F.lit(0.0))
    best = lambda f: F.max_by(f, F.when(F.col(f).isNotNull() & (F.col(f).cast("string") != ""), F.struct(trust(f).alias("t"), F.col("checked_at"), (-F.col("_n")).alias("n")))).alias(f)
    united = lambda f: F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(F.col("_n"), F.coalesce(F.col(f), F.array().cast("array<string>")).alias("v")))), lambda x: x["v"]))).alias(f)
    leader = F.struct((~F.coalesce(F.col("website") != "", F.lit(False))).cast("int").alias("w"), "_n")
    kept = [c for c in suppliers.columns if c not in (*SCALARS, *LISTS, "evidence", "company_type", "checked_at", "ord")]
    merged = rows.groupBy("component").agg(
        *[F.min_by(c, leader).alias(c) for c in kept], *[best(f) for f in SCALARS], *[united(f) for f in LISTS],
        F.coalesce(F.min_by("company_type", F.when(F.col("company_type") != "unknown", F.col("_n"))), F.min_by("company_type", leader)).alias("company_type"),
        F.max("checked_at").alias("checked_at"), F.min("ord").alias("ord"), F.count("*").alias("records"))
    # of facts with the same field, source and quote the first counts; found by key, never pair by pair
    facts = rows.select("component", "_n", F.posexplode("evidence").alias("_i", "e")).select("component", F.struct("_n", "_i", "e").alias("x"), "e.field_name", "e.source_url", "e.quote")
    distinct = facts.groupBy("component", "field_name", "source_url", "quote").agg(F.min("x").alias("x"))
    evidence = distinct.groupBy("component").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["e"]).alias("evidence"))
    kind = dict(suppliers.dtypes)["evidence"]
    return merged.join(evidence, "component", "left").withColumn("evidence", F.coalesce("evidence", F.array().cast(kind)))


def deduplicate(suppliers: DataFrame) -> DataFrame:
    """Companies from supplier records with an ordinal ``ord`` of their own each; ``records`` counts the merged ones."""
    known = materialise(suppliers.select("ord", "id", "domain", "website", "inn", "phone", "name", "address", "email"), suppliers.sparkSession)
    return merge_groups(suppliers, company_components(known))
