"""One small test for each finding of round 4 that was right."""

from quarrymark.operators import links, pages


def test_f1_each_way_of_writing_a_url_is_normalised_once(spark):
    hits = [("https://a.ru/#x", None, 5, ["https://A.ru"]), ("https://a.ru/#x", "s2", 7, ["https://b.ru/", "https://a.ru/#y"]), ("https://www.a.ru", "s1", 6, []), ("https://a.ru", None, 2, []), ("https://a.ru/#x", "s3", 8, None), ("https://b.ru", "", 9, None), (None, "s", 1, None)]
    df = spark.createDataFrame(hits, "url string, supplier_id string, ord long, related_urls array<string>")
    out = pages.deduplicate_hits(df)
    assert sorted(map(tuple, out.collect()), key=str) == [("https://a.ru", "s1", 2, []), ("https://b.ru", "", 9, [])]
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    reads = next(i for i, line in enumerate(plan) if "Aggregate" in line)
    assert not any("regexp" in line for line in plan[reads + 1 :])  # before: every hit was normalised, some more than once


def test_f1_addresses_of_pages_are_normalised_once(spark):
    known = spark.createDataFrame([("a", "a.ru", None, ["https://b.ru/2"]), ("b", "b.ru", None, ["https://b.ru/1"]), ("c", None, None, ["https://tiu.ru/1"]), ("d", "a.ru", None, []), ("d", "b.ru", None, ["https://b.ru/2"])], "id string, domain string, website string, source_urls array<string>")
    landed = spark.createDataFrame([("https://b.ru/1", "https://www.b.ru/1#x"), ("https://b.ru/2", "https://a.ru/"), ("https://b.ru/2", "https://b.ru/2"), ("https://tiu.ru/1", None)], "url string, final_url string")
    out = links.page_owners(landed, known)
    assert sorted(map(tuple, out.collect())) == [("a", "https://b.ru/2"), ("b", "https://b.ru/1"), ("b", "https://b.ru/2"), ("c", "https://tiu.ru/1"), ("d", "https://b.ru/1"), ("d", "https://b.ru/2")]
    assert "final_url" not in out._jdf.queryExecution().optimizedPlan().toString()  # before: for each of four joins


def test_f3_whole_contracts_are_not_shuffled(spark):
    import json

    from pyspark.sql import functions as F

    from quarrymark.functions.schemas import CONTRACTS
    from quarrymark.operators.scoring import Request
    from quarrymark.sources import contracts

    party = lambda name, inn=None: {"organizationName": name, "inn": inn, "contactInfo": {"email": f"{name}@x.ru"}}
    contract = lambda number, *parties, product="Сырники": {"regNum": number, "products": [{"name": product}], "suppliers": list(parties), "regionCode": "66"}
    landed = [(1, [contract("7", party("a", "1"), party("b")), contract("8", party("z"), product="Творог")]), (2, [contract("7", party("late")), contract("", party("nameless")), contract("9", party("B"), party(" "), party("c"))]), (3, None), (4, []), (5, [contract("8", party("y")), contract("5", party("A", "1"), party("c"))])]
    rows = spark.createDataFrame([(f"https://u{o}.ru", o, json.dumps({"contracts": {"data": data}})) for o, data in landed], "api_url string, ord long, payload string")
    out = contracts.contract_suppliers(rows.select("api_url", "ord", F.from_json("payload", CONTRACTS)["contracts"].alias("contracts")), Request("сырники", ""), F.lit("2026-01-01").cast("timestamp"), None)
    assert sorted(tuple(r) for r in out.suppliers.select("name", "email", F.col("source_urls")[0]).collect()) == [("a", "a@x.ru", "https://u1.ru"), ("b", "b@x.ru", "https://u1.ru"), ("c", "c@x.ru", "https://u2.ru")]
    assert sorted(r["note"] for r in out.sources.collect()) == ["контракт № 7, дата не указана"] * 2 + ["контракт № 9, дата не указана"]
    plan = out.suppliers._jdf.queryExecution().optimizedPlan().toString().splitlines()
    below = plan[next(i for i, line in enumerate(plan) if "WindowGroupLimit [number" in line) + 1]
    assert "AS keys" in below and "AS suppliers" not in below  # before: products, suppliers and addresses of every contract
