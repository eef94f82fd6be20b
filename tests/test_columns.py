import pytest
from pyspark.sql import functions as F

from quarrymark.functions import columns as C
from quarrymark.functions import constants as K


def test_urls(one):
    assert one(C.normalize_url, "https://www.example.ru/catalog/?utm_source=ya&page=2#anchor", "HTTP://Example.RU", "example.ru", None, "https://a.ru/x/;p=1?b=&gclid=3&c=d+e", "https://a.ru/?q=%D1%8B") == [
        "https://example.ru/catalog?page=2", "http://example.ru", None, None, "https://a.ru/x?b=&c=d+e", "https://a.ru?q=%D1%8B"]
    assert one(C.normalize_domain, "https://user@www.Shop.ru:8080/a?b", "shop.ru/path", "", None) == ["shop.ru", "shop.ru", None, None]
    assert one(C.is_blocked, "https://m.vk.com/x", "https://notvk.com", "https://example.ru", None) == [True, False, False, False]
    assert one(C.is_http_url, "https://a.ru", "ftp://a.ru", "https://", None) == [True, False, False, False]
    assert one(C.redirect_target, "//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.ru%2Fx&rut=1", "https://b.ru") == ["https://a.ru/x", "https://b.ru"]


def test_contacts(one):
    assert one(C.normalize_phone, "+7 (343) 123-45-67", "8 343 1234567", "343-12-34", None, "+7 112 000 00 00") == ["+73431234567", "+73431234567", None, None, None]
    assert one(C.normalize_email, " Info@Example.RU ", "no at", "a@b.c", None) == ["info@example.ru", None, None, None]
    assert one(C.normalize_inn, "ИНН 7700000000", "123", "770000000012", None) == ["7700000000", None, "770000000012", None]


def test_regions(one):
    assert one(C.normalize_region, "Свердловская обл.", "ЕКБ", "г. Москва", "Тверь", "город Москва", "", None) == ["Свердловская область", "Екатеринбург", "Москва", "Тверь", "город Москва", None, None]
    covers = lambda wanted: lambda v: C.region_covers(v, F.lit(wanted))
    assert one(covers("Екатеринбург"), "Россия", "Екатеринбург", "Москва", None) == [True, True, False, False]
    assert one(covers("Россия"), "Екатеринбург") == [False]
    assert one(C.region_code, "Московская область", "г. Уфа", "Лондон") == ["50", "02", None]


def test_quantities(one):
    assert one(C.parse_weight_kg, "500 г", "1,5 т", "от 10 000 руб.", "5 20 кг", "10 000 кг", None) == [0.5, 1500.0, None, 520.0, 10000.0, None]
    assert one(C.parse_volume_l, "250 мл", "2 м3") == [0.25, 2000.0]
    assert one(C.general_number, 50.0, 0.5, 1500.25) == ["50", "0.5", "1500.25"]


def test_names(one):
    assert one(C.normalize_company_name, 'ООО "Ромашка"', "публичное акционерное общество Хлеб", "ИП", None) == ["ромашка", "публичное хлеб", None, None]


def test_stems_and_conflicts(one):
    match = lambda v: C.title_matches(v, F.lit("купить сырники замороженные"))
    assert one(match, "Сырник замороженный, 1 кг", "Сырники", "") == [True, False, False]
    assert one(lambda v: C.conflicts(v, F.lit("филе куриное"), K.TITLE_CONFLICTS), "Пельмени с филе", "Филе") == [True, False]
    assert one(lambda v: C.same_word(v, F.lit("сырники")), "сырник", "сырок", "сырнику") == [True, False, True]


@pytest.mark.parametrize("a,b", [("", ""), ("abc", ""), ("kitten", "sitting"), ("сырники", "сырник"), ("aabb", "abab")])
def test_indel_ratio_equals_dynamic_programming(one, a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            table[i][j] = table[i - 1][j - 1] + 1 if x == y else max(table[i - 1][j], table[i][j - 1])
    want = 100.0 if not a + b else 200.0 * table[-1][-1] / (len(a) + len(b))
    assert one(lambda v: C.indel_ratio(v, F.lit(b)), a) == [pytest.approx(want)]


def test_lines(one):
    text = "Первая  строка\n\n Сырники оптом замороженные от производителя \nсырники замороженные"
    assert one(lambda v: C.product_quote(C.text_lines(v), F.lit("замороженные сырники")), text, "", None) == ["сырники замороженные", None, None]
    assert one(lambda v: C.value_after(C.text_lines(v), "ИНН"), "ИНН\n7700\nx", "x") == ["7700", None]
    assert one(lambda v: C.first_match(v, K.PRICE), "цена 300р. за кг", "от 450 руб./кг") == ["300р", "от 450 руб./кг"]
    assert one(C.url_id.__get__("web-"), "https://example.ru") == ["web-" + __import__("uuid").uuid5(__import__("uuid").NAMESPACE_URL, "https://example.ru").hex[:16]]


def test_html(one):
    page = "<html><style>p{}</style><p>Сырники&amp;Co<br>100&#39; руб</p><script>var a='<b>'</script></html>"
    assert one(C.html_text, page, "", None)[:2] == ["Сырники&Co\n100' руб", ""]
    assert one(C.plain_html, "<b>a</b> &lt;x&gt;") == ["a <x>"]
