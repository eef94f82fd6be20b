import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quarrymark.functions import constants as K
from quarrymark.functions.schemas import CONTRACTS, HIT, PLACES, SUPPLIER
from quarrymark.operators import entities, extraction, history, links, page_log, pages, results, scoring
from quarrymark.plans import search
from quarrymark.sources import contracts, places, provider, web

AT = datetime(2026, 9, 10, 12, 0)


def checked():
    return F.lit("2026-09-10 12:00:00").cast("timestamp")


REQUEST = scoring.Request("замороженные сырники", "Екатеринбург", 50.0, True, True)


def evidence(name, value, confidence=0.9):
    return {"field_name": name, "value": value, "source_url": "https://example.ru/page", "quote": f"цитата про {value}", "confidence": confidence}


def supplier(**own):
    base = {"id": "test-supplier", "name": "Тестовый поставщик", "company_type": "wholesaler", "product_categories": ["замороженные сырники"], "matched_products": [], "contract_products": [], "regions": ["Екатеринбург"], "certificates": [], "source_urls": [], "discovery_queries": ["q"], "evidence": [], "checked_at": AT}
    return base | own


def frame(spark, *rows):
    df = spark.createDataFrame([json.dumps(r | {"checked_at": r.get("checked_at", AT).isoformat()}, ensure_ascii=False) for r in rows], "string").toDF("j")
    return df.select(F.from_json("j", SUPPLIER).alias("s"), F.monotonically_increasing_id().alias("n")).select("s.*").withColumn("ord", F.row_number().over(__import__("pyspark").sql.Window.orderBy(F.monotonically_increasing_id())).cast("long") - 1)


def full():
    return supplier(matched_products=["сырники замороженные"], evidence=[evidence("matched_products", "сырники замороженные")], delivery="доставка по городу", minimum_order="от 10 кг", certificates=["декларация"], phone="+73431234567", email="a@b.ru", price="100 руб.", website="https://example.ru", domain="example.ru", source_urls=["https://example.ru"])


def scored(spark, row, request=REQUEST):
    return scoring.score(frame(spark, row).withColumn("page_unavailable", F.lit(False)), request).first()


def test_score_full_sparse_and_wrong_region(spark):
    best = scored(spark, full())
    assert best["score"] == 100 and best["result_group"] == "verified"
    assert sum(i["points"] for i in best["breakdown"]) == 100
    sparse = scored(spark, supplier(evidence=[evidence("matched_products", "x")], website="https://example.ru", domain="example.ru"))
    assert sparse["score"] == 50
    wrong = scored(spark, supplier(regions=["Москва"], evidence=[evidence("matched_products", "x")], website="https://example.ru", domain="example.ru"))
    assert wrong["score"] == 20


@pytest.mark.parametrize("own,reason", [({"company_type": "retailer"}, "розничная"), ({"company_type": "marketplace"}, "каталог"), ({"product_categories": ["пельмени"], "evidence": [evidence("matched_products", "x")]}, "ассортимент")])
def test_exclusions(spark, own, reason):
    row = scored(spark, supplier(**own))
    assert row["result_group"] == "excluded" and row["score"] == 0 and reason in row["exclusion_reason"]


def test_candidate_without_evidence_and_weights(spark):
    row = scored(spark, supplier(contract_products=["сырники"], website="https://example.ru", domain="example.ru"))
    assert row["result_group"] == "candidate" and "ЕИС" in row["verification_reason"]
    heavy = K.WEIGHTS | {"category_match": 60.0}
    assert scoring.max_score(heavy) == 130


def test_generic_words_only_relate(spark):
    row = scored(spark, supplier(product_categories=["замороженные овощи"], evidence=[evidence("matched_products", "x")]))
    assert row["related_only"] and row["key_ratio"] == 0


def test_components_and_merge(spark):
    rows = frame(
        spark,
        supplier(id="a", name="ООО Ромашка", inn="7700000000", checked_at=datetime(2026, 9, 1), phone="+73430000001", evidence=[evidence("phone", "+73430000001", 0.9)]),
        supplier(id="b", name="Ромашка", inn="7700000000", website="https://romashka.ru", domain="romashka.ru", phone="+73430000002", evidence=[evidence("phone", "+73430000002", 0.5)]),
        supplier(id="c", name="Василёк", address="Екатеринбург, улица Мира, 1"),
        supplier(id="d", name="ООО «Василек»", address="улица Мира, 1, г. Екатеринбург"),
        supplier(id="e", name="Третья"),
    )
    out = {r["ord"]: r for r in entities.deduplicate(rows).collect()}
    assert out[0]["name"] == "Ромашка" and out[0]["phone"] == "+73430000001" and out[0]["records"] == 2
    assert len(out[0]["evidence"]) == 2
    assert sum(r["records"] for r in out.values()) == 5
    assert entities.deduplicate(rows.limit(0)).count() == 0


def test_token_set_ratio(one):
    assert one(lambda v: entities.token_set_ratio(v, F.lit("b a x")), "a b x", "a b", "q") == [100.0, 100.0, pytest.approx(0.0)]


def test_normalize_supplier(spark):
    row = entities.normalize_suppliers(frame(spark, supplier(website="https://www.Shop.ru/", phone="8 343 1234567", regions=["ЕКБ", "екатеринбург"], minimum_order="5 кг", minimum_order_kg=0.0, source_urls=["https://a.ru/?utm_source=1"], evidence=[evidence("x", "y")]))).first()
    assert (row["website"], row["domain"], row["phone"], row["phone_raw"], row["regions"], row["minimum_order_kg"]) == ("https://shop.ru", "shop.ru", "+73431234567", "8 343 1234567", ["Екатеринбург"], 5.0)
    assert row["source_urls"] == ["https://a.ru", "https://example.ru/page"]


PAGE = """<html><head><script type="application/ld+json">{"@graph": [{"@type": "Organization", "legalName": "ООО Ромашка", "address": {"streetAddress": "ул. Мира, 1"}}, {"@type": ["Product"], "name": "Сырники замороженные"}]}</script>
<script type="application/ld+json">{bad</script></head></html>"""
TEXT = "О компании\nСырники замороженные оптом\nЦена: 450 руб./кг\nМинимальный заказ от 20 кг\nДоставка по городу\nДекларация соответствия\nИНН: 7700000000\n+7 (343) 123-45-67\nsales@romashka.ru"


def page_rows(spark, text=TEXT, html=PAGE, url="https://romashka.ru/p"):
    return spark.createDataFrame([("s", url, url, "ok", text, html, 1)], "supplier_id string, url string, final_url string, status string, text string, html string, ord long")


def test_page_facts_have_quotes(spark):
    facts = {r["field_name"]: r for r in extraction.page_facts(page_rows(spark), "замороженные сырники").collect()}
    assert facts["price"]["value"] == "450 руб./кг" and facts["price"]["quote"] == "Цена: 450 руб./кг"
    assert facts["phone"]["value"] == "+73431234567" and facts["inn"]["value"] == "7700000000"
    assert facts["legal_name"]["value"] == "ООО Ромашка" and facts["address"]["value"] == "ул. Мира, 1"
    assert facts["matched_products"]["value"] == "Сырники замороженные" and facts["email"]["confidence"] == 0.9
    assert {"minimum_order", "delivery", "certificates"} <= set(facts)
    fee = {r["field_name"] for r in extraction.page_facts(page_rows(spark, "Стоимость доступа 300 руб."), "сырники").collect()}
    assert "price_access_note" in fee and "price" not in fee
    assert extraction.page_facts(page_rows(spark, None, None), "сырники").count() == 0


def test_enrich_fills_and_verifies(spark):
    row = extraction.enrich(frame(spark, supplier(id="s", phone=None, company_type="unknown")), page_rows(spark), "замороженные сырники").first()
    assert row["price"] == "450 руб./кг" and row["matched_products"] == ["Сырники замороженные"] and len(row["evidence"]) >= 8
    assert (row["name"], row["legal_name"], row["company_type"], row["phone_raw"]) == ("Тестовый поставщик", "ООО Ромашка", "wholesaler", "+7 (343) 123-45-67")
    assert {e["field_name"]: e["quote"] for e in row["evidence"]}["company_type"] == "Тестовый поставщик"  # a name is read first
    kept = extraction.enrich(frame(spark, supplier(id="s", phone="1", price="5 руб.", company_type="retailer", legal_name="X")), page_rows(spark), "замороженные сырники").first()
    assert (kept["price"], kept["company_type"], kept["legal_name"]) == ("5 руб.", "retailer", "X")
    assert not {"price", "company_type", "legal_name", "phone", "price_access_note"} & {e["field_name"] for e in kept["evidence"]}
    facts = spark.createDataFrame([("s", "price", "450", "Цена: 450", "https://romashka.ru/p/"), ("s", "price", "1", "выдумка", "https://romashka.ru/p")], "supplier_id string, field_name string, value string, quote string, source_url string")
    good, bad = extraction.verify_facts(facts, page_rows(spark))
    assert [r["value"] for r in good.collect()] == ["450"] and [r["value"] for r in bad.collect()] == ["1"]


def test_structured_data_at_any_depth(spark):
    inner = {"@type": "Organization", "name": "ООО Глубина"}
    for _ in range(9):
        inner = {"@graph": [[inner]]}
    html = '<script type="application/ld+json">' + json.dumps(inner, ensure_ascii=False) + "</script>"
    row = extraction.page_structures(spark.createDataFrame([("u", html)], "url string, html string")).first()
    assert row["organisation"] == "ООО Глубина"


def test_model_facts_merge(spark):
    url = "https://romashka.ru/p"
    fact = lambda v, q, u=url: {"value": v, "quote": q, "source_url": u}
    answer = {"legal_name": fact(" ООО Ромашка ", " О компании "), "inn": fact("1", "выдумка"), "company_type": fact("Wholesaler", "оптом"), "price": fact("300", "Доставка"), "delivery": fact("x", "Доставка"), "phone": fact("8 343 1234567", "+7 (343) 123-45-67"),
              "matched_products": [fact("Сырники", "Сырники замороженные оптом"), fact(" ", "оптом"), fact("Ещё", "оптом", "https://other.ru")], "regions": [], "certificates": [fact("Декларация", "Декларация соответствия")]}
    answers = extraction.parse_model_facts(spark.createDataFrame([("s", json.dumps(answer, ensure_ascii=False))], "supplier_id string, payload string"))
    facts = extraction.model_facts(answers)
    before = frame(spark, supplier(id="s", company_type="unknown", delivery="есть", source_urls=["https://a.ru"]))
    merged, counts = extraction.merge_model_facts(before, facts, page_rows(spark))
    row, n = merged.first(), counts.first()
    assert (row["legal_name"], row["company_type"], row["price"], row["delivery"], row["inn"], row["phone_raw"]) == ("ООО Ромашка", "wholesaler", "300", "есть", None, "8 343 1234567")
    assert row["matched_products"] == ["Сырники"] and row["certificates"] == ["Декларация"] and row["source_urls"] == ["https://a.ru", url]
    assert (n["accepted"], n["rejected"]) == (6, 3)
    assert {(e["field_name"], e["confidence"]) for e in row["evidence"]} == {(f, 0.82) for f in ("legal_name", "company_type", "price", "phone", "matched_products", "certificates")}
    again, _ = extraction.merge_model_facts(merged, facts, page_rows(spark))
    assert len(again.first()["evidence"]) == len(row["evidence"])
    fee = spark.createDataFrame([("s", "price", "300 руб.", "Стоимость доступа 300 руб.", url, 0)], "supplier_id string, field_name string, value string, quote string, source_url string, ord int")
    merged, counts = extraction.merge_model_facts(before, fee, page_rows(spark, "Стоимость доступа 300 руб."))
    assert merged.first()["price"] is None and counts.first()["rejected"] == 1


def test_repeated_records_count_once_each(spark):
    rows = frame(spark, *[supplier(id="x", name="ООО Ромашка", phone=f"+7343000000{k}") for k in range(4)])
    numbered = search.numbered(rows.drop("ord"))
    assert [r["records"] for r in entities.deduplicate(numbered).collect()] == [4]
    chain = spark.createDataFrame([(k,) for k in (0, 1, 1, 2, 3, 4)], "ord long")
    edges = spark.createDataFrame([(k, k + 1) for k in range(4)], "a long, b long")
    assert sorted(map(tuple, entities.connected_components(chain, edges).collect())) == [(k, 0) for k in range(5)]


def hits(spark, *rows):
    return spark.createDataFrame([(u, t, "", "q", "p", i + 1, s, [], i) for i, (u, t, s) in enumerate(rows)], HIT)


def test_hits(spark):
    rows = hits(spark, ("https://a.ru/?utm_source=x", "A", None), ("https://www.a.ru", "A2", "s1"), ("https://vk.com/x", "B", None))
    out = pages.deduplicate_hits(rows).collect()
    assert [(r["url"], r["supplier_id"], r["ord"]) for r in out] == [("https://a.ru", "s1", 0)]
    made = web.suppliers_from_hits(hits(spark, ("https://shop.ru/x", "Завод сыров — купить", None), ("https://tiu.ru/q", "Купить оптом сырники", None)), checked()).orderBy("name").collect()
    assert [(r["name"], r["company_type"], r["website"]) for r in made] == [("Завод сыров", "manufacturer", "https://shop.ru"), ("Купить оптом сырники", "marketplace", None)]
    known = frame(spark, supplier(id="s1"))
    assert links.attach_hits(known, pages.deduplicate_hits(rows)).first()["website"] == "https://a.ru"
    assert links.unattached_hits(known, hits(spark, ("https://b.ru", "B", "zz"))).count() == 1
    assert links.hit_sources(hits(spark, ("https://b.ru", "B", "s1")), known).first()["supplier_name"] == "Тестовый поставщик"
    assert links.fetch_urls(known.withColumn("website", F.lit("https://2gis.ru/x")), rows).count() == 3


def test_page_owners_and_caps(spark):
    known = frame(spark, supplier(id="s", source_urls=["https://tiu.ru/1"], domain="shop.ru"))
    landed = spark.createDataFrame([("https://shop.ru/a", "https://shop.ru/a"), ("https://tiu.ru/1", "https://tiu.ru/1"), ("https://tiu.ru/2", "https://tiu.ru/2")], "url string, final_url string")
    assert {r["url"] for r in links.page_owners(landed, known).collect()} == {"https://shop.ru/a", "https://tiu.ru/1"}
    urls = spark.createDataFrame([(f"https://d{i % 3}.ru/{i // 6}", i) for i in range(24)], "url string, ord long")
    assert pages.select_initial_urls(urls, 2, 3).groupBy("domain").count().count() == 2
    html = '<a href="/catalog/x">Каталог продукции</a><a href="https://other.ru/catalog">x</a><a href="/about">о нас</a>'
    found = pages.useful_links(spark.createDataFrame([("https://shop.ru/", html)], "url string, html string")).collect()
    assert [(r["target"], r["place"]) for r in found] == [("https://shop.ru/catalog/x", 1)]


def test_contracts(spark, tmp_path):
    payload = {"contracts": {"total": 1, "data": [{"regNum": "1", "signDate": "2026-01-02T00", "regionCode": "66", "contractUrl": "http://z.ru/1", "customer": {"postalAddress": "620000"}, "products": [{"name": "Сырники замороженные"}, {"name": "Пельмени"}], "suppliers": [{"organizationName": "ООО Ромашка", "inn": "7700000000", "contactInfo": {"email": "A@b.ru"}}]}, {"regNum": "1", "products": [{"name": "Сырники"}]}]}}
    (tmp_path / "a.json").write_text(json.dumps(payload, ensure_ascii=False))
    got = contracts.contract_suppliers(contracts.read_contracts(spark, str(tmp_path)), scoring.Request("сырники", "Екатеринбург"), checked())
    row = got.suppliers.first()
    assert (row["name"], row["inn"], row["contract_products"], row["regions"], row["email"]) == ("ООО Ромашка", "7700000000", ["Сырники замороженные"], ["Екатеринбург"], "a@b.ru")
    assert got.sources.first()["url"] == "https://z.ru/1" and contracts.contract_stats(contracts.read_contracts(spark, str(tmp_path))).first()["newest"] == "2026-01-02"


def test_limits_of_contracts_and_places_can_be_lifted(spark):
    data = [{"regNum": str(n), "products": [{"name": "Сырники"}], "suppliers": [{"organizationName": f"ООО {n}"}]} for n in range(20)]
    landed = spark.createDataFrame([(json.dumps({"contracts": {"data": data}}),)], "payload string").select(F.from_json("payload", CONTRACTS)["contracts"].alias("contracts"), F.lit("u").alias("api_url"), F.lit(0).alias("ord"))
    many = lambda *most: contracts.contract_suppliers(landed, scoring.Request("сырники", ""), checked(), *most).suppliers.count()
    assert (many(), many(None), many(3)) == (12, 20, 3)
    cards = spark.createDataFrame([(json.dumps({"result": {"items": [{"id": str(n), "name": "A"} for n in range(40)]}}),)], "payload string").select(F.from_json("payload", PLACES).alias("x")).select("x.*", F.lit(0).alias("ord"))
    of = lambda *most: places.place_suppliers(cards, "q", checked(), *most).suppliers.count()
    assert (of(), of(None)) == (30, 40)


def test_registry(spark):
    xml = "<rss><channel><item><title>t</title><link>/epz/card?reestrNumber=123456789012345678</link><description>d</description></item><item><link>/x</link><description>№ 123456789012345678</description></item></channel></rss>"
    items = contracts.parse_rss(spark.createDataFrame([("сырники", xml, 0)], "query string, xml string, ord long")).collect()
    assert [r["registry_number"] for r in items] == ["123456789012345678"]
    common = "Информация о поставщиках\nОрганизация\nООО Ромашка\nИНН\n7700000000\nтел 8 343 123 45 67\nИнформация о контракте\nМесто поставки товара, выполнения работы или оказания услуги\nг Екатеринбург"
    cards = spark.createDataFrame([("сырники", "1", "https://z.ru/c", common, "https://z.ru/p", "Сырники замороженные 1 кг")], "query string, registry_number string, common_url string, common_text string, product_url string, product_text string")
    row = contracts.registry_suppliers(cards, REQUEST, checked()).first()
    assert (row["name"], row["inn"], row["regions"], row["phone"]) == ("ООО Ромашка", "7700000000", ["Екатеринбург"], "+73431234567")


def test_places(spark, tmp_path):
    payload = {"meta": {"code": 200}, "result": {"items": [{"id": "1", "name": "Оптовый склад", "link": "/firm/1", "rubrics": [{"name": "Молоко"}], "adm_div": [{"name": "ЕКБ"}], "org": {"id": "9", "name": "ООО Склад"}, "contact_groups": [{"contacts": [{"type": "phone", "value": "8 343 1234567"}, {"type": "website", "value": "sklad.ru"}]}]}, {"id": "2"}]}}
    (tmp_path / "a.json").write_text(json.dumps(payload, ensure_ascii=False))
    got = places.place_suppliers(places.read_places(spark, str(tmp_path)).withColumn("ord", F.lit(0)), "q", checked())
    row = got.suppliers.first()
    assert (row["id"], row["company_type"], row["website"], row["phone"], row["regions"]) == ("2gis-9", "wholesaler", "https://sklad.ru", "+73431234567", ["Екатеринбург"])
    assert got.sources.count() == 2


def test_web_sources(spark):
    q = "query string, supplier_id string, payload string, ord long"
    js = json.dumps({"web": {"results": [{"url": "https://a.ru", "title": "<b>A</b>", "description": "x"}]}})
    assert web.json_hits(spark.createDataFrame([("q", None, js, 0)], q)).first()["title"] == "A"
    page = '<div class="result"><a class="result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.ru%2Fx">A b</a><a class="result__snippet">s</a></div>'
    assert web.html_hits(spark.createDataFrame([("q", None, page, 0)], q)).first()["url"] == "https://a.ru/x"
    card = '<div class="card_item product"><a class="link" href="/products/1">Сырники замороженные</a><div class="ii_company" title="Компания: Ромашка"><a href="/producers/1/x">p</a></div><span data-producer-id="7"></span></div>'
    row = web.catalog_hits(spark.createDataFrame([("сырники", None, card, 0)], q)).first()
    assert (row["title"], row["related_urls"]) == ("Ромашка", ["https://productcenter.ru/producers/7/x"])
    robots = spark.createDataFrame([("https://a.ru", "User-agent: *\nDisallow: /private")], "origin string, body string")
    urls = spark.createDataFrame([("https://a.ru/private/x",), ("https://a.ru/y",), ("https://b.ru/z",)], "url string")
    assert {r["url"]: r["allowed"] for r in web.robots_allowed(urls, robots).collect()} == {"https://a.ru/private/x": False, "https://a.ru/y": True, "https://b.ru/z": True}
    assert web.choose_provider({"yandex": None, "brave": "k"}) == "brave"


def test_queries_built():
    r = scoring.Request("сырники", "Екатеринбург", documents_required=True)
    assert len(provider.build_queries(r)) == 6 and provider.build_queries(scoring.Request(" ")) == []
    assert provider.contract_queries(scoring.Request("сырники", eis_queries=("10.12", "Сырники", "творог"))) == ["сырники", "творог"]
    assert provider.registry_queries(scoring.Request("филе куриное"))[0] == "филе куриное"
    assert provider.contract_parameters("x", "66", 99)["perpage"] == "50"
    assert provider.registry_address("https://r.example/", "филе куриное").startswith("https://r.example/epz/contract/search/rss?searchString=%D1%84%D0%B8%D0%BB%D0%B5+")


def test_failed_provider_is_a_warning(spark):
    def broken(spark, request):
        raise OSError("no such landing folder")

    out = provider.collect(spark, REQUEST, {"broken": broken, "good": lambda s, r: provider.Result(frame(s, supplier()))})
    assert out.suppliers.count() == 1 and out.warnings == ["broken: no such landing folder"]


def test_history_and_cache(spark, tmp_path):
    rows = scoring.score(frame(spark, full()).withColumn("page_unavailable", F.lit(False)), REQUEST)
    for _ in range(2):
        history.save_run(str(tmp_path), {"suppliers": history.supplier_payload(rows, "r1"), "evidence": results.evidence_long(rows).withColumn("run_id", F.lit("r1"))})
    assert history.list_suppliers(spark, str(tmp_path), "r1").count() == 1
    assert history.read(spark, str(tmp_path), "evidence").count() == 1
    landed = spark.createDataFrame([("u", "u", 200, "text/html", AT, "ok", "<p>", "t", None), ("v", "v", 403, None, AT, "skipped", "", "", "robots")], "url string, final_url string, http_status int, mime_type string, fetched_at timestamp, status string, html string, text string, error string")
    cache = history.cache_entries(landed)
    assert {r["url"]: r["status"] for r in history.cached_status(cache).collect()} == {"u": "cached", "v": "skipped"}
    assert [r["url"] for r in history.fresh(cache, "2026-09-10 13:30:00").collect()] == ["u"]
    assert history.upsert_cache(cache, cache.withColumn("error", F.lit("new"))).where("error = 'new'").count() == 2


def test_tables(spark, tmp_path):
    rows = scoring.score(frame(spark, full(), full() | {"id": "x"}).withColumn("page_unavailable", F.lit(False)), REQUEST)
    assert tuple(results.result_table(rows.limit(0)).columns) == K.TABLE_COLUMNS
    assert len(results.export_frame(rows).columns) == 23
    assert set(results.comparison(rows, ["test-supplier", "x"]).columns) == {"Критерий", "test-supplier", "x"}
    with pytest.raises(ValueError):
        results.comparison(rows, ["x"])
    path = results.write_single_csv(rows, str(tmp_path), "r")
    assert path.read_bytes().startswith(b"\xef\xbb\xbf")
    assert rows.select(scoring.format_breakdown().alias("b")).first()["b"].endswith("Итого: 100/100")


def test_whole_search(spark, tmp_path):
    page = page_rows(spark).drop("supplier_id", "status").withColumns({"http_status": F.lit(200), "mime_type": F.lit("text/html"), "error": F.lit(None).cast("string")})
    none = spark.createDataFrame([], provider.SOURCE)
    out = search.search(REQUEST, frame(spark, supplier(id="s", evidence=[], regions=["ЕКБ"], source_urls=["https://romashka.ru/p"])), hits(spark, ("https://vasilek.ru", "Василёк — оптом", None)), page, none, checked())
    groups = {r["name"]: r["result_group"] for r in out.companies.collect()}
    assert groups["Тестовый поставщик"] == "verified"
    fact = {"value": "ООО Ответ", "quote": "Доставка по городу", "source_url": "https://romashka.ru/p"}
    answers = spark.createDataFrame([("s", json.dumps({"legal_name": fact, "certificates": [fact]}, ensure_ascii=False))], "supplier_id string, payload string")
    bare = page.withColumn("html", F.lit(None).cast("string"))
    told = search.search(REQUEST, frame(spark, supplier(id="s", evidence=[], source_urls=["https://romashka.ru/p"])), hits(spark), bare, none, checked(), answers)
    row = told.companies.where("id = 's'").first()
    assert row["legal_name"] == "ООО Ответ" and "ООО Ответ" in row["certificates"]
    for _ in range(2):
        search.save(out, REQUEST, str(tmp_path), "run-1", checked(), checked(), ["places: no answer"])
    run = history.list_runs(spark, str(tmp_path)).collect()
    assert [(r["run_id"], r["status"], r["suppliers_found"]) for r in run] == [("run-1", "partial", 1)] and json.loads(run[0]["stats"])["suppliers_found"] == 1
    assert history.list_suppliers(spark, str(tmp_path), "run-1").count() == out.companies.count()
    assert history.read(spark, str(tmp_path), "evidence").count() == results.evidence_long(out.companies).count() > 0
    assert history.list_sources(spark, str(tmp_path), "run-1").count() == out.sources.count()
    assert {r["url"] for r in search.first_pages(frame(spark, supplier(website="https://b.ru")), hits(spark, ("https://a.ru/x", "A", None))).collect()} == {"https://a.ru/x", "https://b.ru"}
    (tmp_path / "file").write_text("no folder")
    assert not search.persist(out, REQUEST, str(tmp_path / "file"), "run-2", checked(), checked(), ("no folder",)) and out.warnings[0].startswith("history: ")
    assert search.persist(out, REQUEST, str(tmp_path), "run-2", checked(), checked())
    assert {(r["run_id"], r["status"]) for r in history.list_runs(spark, str(tmp_path)).collect()} == {("run-1", "partial"), ("run-2", "partial")}
    linked = page.withColumn("html", F.lit('<a href="/catalog">Каталог</a><a href="/p">опт</a><a href="/contact">Контакты</a><a href="/opt">Опт</a>'))
    assert {r["url"] for r in search.next_pages(linked).collect()} == {"https://romashka.ru/catalog", "https://romashka.ru/opt"}
    assert out.counters.first()["suppliers_found"] == 1


def test_fuzzy_edges_miss_no_alike_address(spark):
    import random

    r = random.Random(4)

    def misspelt(text):
        at = r.randrange(len(text) + 1)
        return text[:at] + r.choice("абвгд") + text[at:]

    rows = [("Ромашка Трейд", "Екатеринбург"), ("Ромашка Трейд", "Екатиринбург"), ("Ромашка Трейд", "д 5"), ("Ромашки Трейд", "д 5"), ("Ромашка Трейд", None)]
    for name, address in (("Северная птица компания", "Новосибирск"), ("Уральский мясокомбинат", "Екатеринбург Первомайская"), ("аб", "Пермь"), ("Курица", "д 12 к 3")):
        rows += [(name, address), *((misspelt(name), " ".join(map(misspelt, address.split()))) for _ in range(6))]
    df = spark.createDataFrame([(i, n, a, None) for i, (n, a) in enumerate(rows)], "ord long, name string, address string, email string")
    full = df.select("ord", entities.C.normalize_company_name("name").alias("name"), F.lower(entities.C.clean_text("address")).alias("address"))
    x, y = full.alias("x"), full.alias("y")
    alike = (entities.C.token_sort_ratio(F.col("x.name"), F.col("y.name")) >= 90) & (entities.token_set_ratio(F.col("x.address"), F.col("y.address")) >= 90)
    want = {tuple(p) for p in x.crossJoin(y).where("x.ord < y.ord").where(alike).select("x.ord", "y.ord").collect()}
    assert {(r["a"], r["b"]) for r in entities.fuzzy_edges(df).collect()} == want and {(0, 1), (2, 3)} <= want


def test_visible_text_equals_a_plain_parser(spark, sf_dir):
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.lines, self.hidden = [], 0

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("script", "style", "noscript", "svg", "template")

        def handle_endtag(self, tag):
            self.hidden -= tag in ("script", "style", "noscript", "svg", "template")

        def handle_data(self, data):
            if not self.hidden:
                self.lines += [x.strip() for x in data.splitlines() if x.strip()]

    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html", web.visible_text("html").alias("text")).collect():
        plain = Plain()
        plain.feed(r["html"])
        assert r["text"].split() == " ".join(plain.lines).split()


def test_export_rows_hold_every_field(spark):
    row = results.export_frame(scoring.score(frame(spark, full()).withColumn("page_unavailable", F.lit(False)), REQUEST)).first().asDict()
    values = " | ".join(str(v) for v in row.values())
    for value in ("Тестовый поставщик", "сырники замороженные", "доставка по городу", "от 10 кг", "декларация", "+73431234567", "a@b.ru", "100 руб.", "https://example.ru"):
        assert value in values


def test_xml_hits_and_composite(spark):
    import base64

    group = lambda url, title: f"<group><doc><url>{url}</url><title>{title}</title><passages><passage>про сырники</passage></passages></doc></group>"
    xml = "<?xml version='1.0'?><yandexsearch><response><results><grouping>" + group("https://a.ru/x", "А") + group("https://b.ru", "Б") + "</grouping></results></response></yandexsearch>"
    landed = spark.createDataFrame([("q", None, base64.b64encode(xml.encode()).decode(), 0)], "query string, supplier_id string, payload string, ord long")
    primary = web.xml_hits(landed)
    assert [(r["url"], r["title"], r["snippet"], r["rank"]) for r in primary.orderBy("rank").collect()] == [("https://a.ru/x", "А", "про сырники", 1), ("https://b.ru", "Б", "про сырники", 2)]
    fallback = hits(spark, ("https://c.ru", "C", "s1"), ("https://a.ru/x", "A", None))
    urls = lambda df: [r["url"] for r in df.collect()]
    assert urls(web.composite_hits(primary, fallback, 2)) == ["https://a.ru/x", "https://b.ru"]  # early stop
    assert urls(web.composite_hits(primary, fallback, 5)) == ["https://c.ru", "https://a.ru/x", "https://b.ru"]  # a linked hit comes first
    assert urls(web.composite_hits(None, fallback, 1)) == ["https://c.ru"]


def test_card_pages_owners_and_model_pages(spark):
    items = spark.createDataFrame([("1",), ("2",), ("3",)], "registry_number string")
    common = spark.createDataFrame([("1", "u1", "t1"), ("2", "u2", "t2")], "registry_number string, url string, text string")
    out = contracts.join_card_pages(items, common, common.where("registry_number = '1'")).orderBy("registry_number").collect()
    assert [(r["registry_number"], r["common_text"], r["product_text"]) for r in out] == [("1", "t1", "t1"), ("2", "t2", None)]
    owners = spark.createDataFrame([("a", "u1"), ("b", "u1"), ("b", "u2"), ("b", "u3"), ("b", "u4"), ("c", "u5")], "supplier_id string, url string")
    known = spark.createDataFrame([("a", 2), ("b", 1), ("c", 3)], "id string, ord long")
    assert {(r["url"], r["supplier_id"]) for r in links.first_owner(owners, known).collect()} == {("u1", "b"), ("u2", "b"), ("u3", "b"), ("u4", "b"), ("u5", "c")}
    landed = spark.createDataFrame([(f"u{k}", k) for k in range(1, 6)], "url string, ord long")
    assert {(r["supplier_id"], r["url"]) for r in links.model_pages(known, owners, landed, 2).collect()} == {("b", "u1"), ("b", "u2"), ("a", "u1")}


def test_second_wave_fills_what_is_left_of_a_domain(spark):
    fresh = spark.createDataFrame([("https://a.ru/1", "a.ru", 1), ("https://a.ru/2", "a.ru", 2), ("https://a.ru/3", "a.ru", 3), ("https://b.ru/1", "b.ru", 4)], "url string, domain string, ord long")
    visited = spark.createDataFrame([("https://a.ru", "a.ru"), ("https://a.ru/1", "a.ru")], "url string, domain string")
    assert {r["url"] for r in pages.second_wave(fresh, visited).collect()} == {"https://a.ru/2", "https://b.ru/1"}


def test_queries_of_web_and_places(spark):
    r = scoring.Request("сырники", "Екатеринбург")
    assert provider.places_queries(r) == ["сырники Екатеринбург", "сырники оптом Екатеринбург", "продукты оптом Екатеринбург"]
    got = provider.web_queries(r, frame(spark, supplier(id="a", company_type="retailer"), supplier(id="b", name="Ромашка"))).collect()
    assert [x["supplier_id"] for x in got] == [None, None, "b"] and got[2]["query"] == '"Ромашка" "сырники"'


def test_errors_are_redacted_and_kept(spark, tmp_path, one):
    def broken(spark, request):
        raise OSError("key=secret-1\nfailed")

    assert provider.collect(spark, REQUEST, {"p": broken}, ("secret-1",)).warnings == ["p: key=*** failed"]
    assert one(lambda v: entities.C.redact_error(v, "secret-1", 9), "a secret-1\nxyz") == ["a *** xyz"]
    (tmp_path / "a.json").write_text(json.dumps({"meta": {"code": 403, "error": {"message": "нет доступа"}}}, ensure_ascii=False))
    got = places.place_suppliers(places.read_places(spark, str(tmp_path)).withColumn("ord", F.lit(0)), "q", checked())
    assert got.suppliers.count() == 0 and [(r["status"], r["note"]) for r in got.sources.collect()] == [("failed", "нет доступа")]


def test_lists_tables_and_csv(spark, tmp_path):
    runs = spark.createDataFrame([(f"r{k}", AT.replace(day=k + 1)) for k in range(25)], "run_id string, started_at timestamp")
    rows = spark.createDataFrame([("r1", 2, "https://b.ru", "b.ru", "ok", "page"), ("r1", 1, "https://a.ru", "a.ru", "failed", "catalog"), ("r2", 0, "https://c.ru", "c.ru", "ok", "page")], "run_id string, seq long, url string, domain string, status string, source_kind string")
    for name, df in (("search_runs", runs), ("sources", rows)):
        full_row = df.select(*[(F.col(c.split(" ")[0]) if c.split(" ")[0] in df.columns else F.lit(None)).cast(c.split(" ")[1]).alias(c.split(" ")[0]) for c in history.HISTORY[name].split(", ")])
        full_row.write.parquet(str(tmp_path / name))
    assert [r["run_id"] for r in history.list_runs(spark, str(tmp_path)).collect()] == [f"r{k}" for k in range(24, 4, -1)]
    listed = history.list_sources(spark, str(tmp_path), "r1")
    assert [r["url"] for r in listed.collect()] == ["https://a.ru", "https://b.ru"]
    assert [(r["Статус"], r["Тип источника"], r["Компания"]) for r in results.sources_table(listed).collect()] == [("не загрузилось", "отраслевой каталог", "—"), ("загружено", "страница", "—")]
    best = scoring.score(frame(spark, supplier(contract_products=["сырники"], website="https://example.ru", domain="example.ru")).withColumn("page_unavailable", F.lit(False)), REQUEST)
    assert "ЕИС" in results.candidate_table(best).first()["Причина проверки"]
    results.write_csv(best, str(tmp_path / "csv"))
    assert spark.read.options(header=True, multiLine=True).csv(str(tmp_path / "csv")).count() == 1


def test_page_streams(spark, tmp_path):
    from quarrymark.streaming import pages as streams

    kind = "url string, final_url string, http_status int, mime_type string, fetched_at timestamp, status string, html string, text string, error string"
    row = lambda url, day, text: (url, url, 200, "text/html", AT.replace(day=day), "ok", text, text, None)
    read = lambda folder: spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / folder))
    for k, rows in enumerate([[row("https://a.ru/?utm_source=x", 1, "old"), row("https://b.ru", 1, "b")], [row("https://a.ru", 2, "new")], [row("https://c.ru", 3, "c")]]):
        spark.createDataFrame(rows, kind).withColumn("url", entities.C.normalize_url("url")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        streams.upsert_stream(read("in"), str(tmp_path / "cache"), str(tmp_path / "ck")).awaitTermination()
    cache = page_log.read(spark, str(tmp_path / "cache"))
    assert {r["url"]: r["cleaned_text"] for r in cache.collect()} == {"https://a.ru": "new", "https://b.ru": "b", "https://c.ru": "c"}
    q = streams.fresh_pages(read("in")).writeStream.format("memory").queryName("fresh").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("fresh").groupBy("url").count().where("count > 1").isEmpty()
