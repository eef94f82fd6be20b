"""Fixed values that are part of the semantics: word lists, domains, aliases, units, weights, labels."""

from __future__ import annotations

# fixed values: query parameters that only track
TRACKING_PREFIXES = ("utm_", "yclid", "gclid", "fbclid", "_openstat")

# fixed values: legal forms, removed from names in this order
LEGAL_FORMS = (
    "общество с ограниченной ответственностью", "индивидуальный предприниматель", "акционерное общество", "публичное акционерное общество",
    "открытое акционерное общество", "закрытое акционерное общество", "торговый дом", "производственная компания",
    "ооо", "оао", "зао", "пао", "нао", "ао", "ип", "тд", "тк", "тпк", "гк",
)

# fixed values: units of mass in kilograms and of volume in litres
WEIGHT_UNITS = {"кг": 1.0, "килограмм": 1.0, "килограммов": 1.0, "г": 0.001, "гр": 0.001, "грамм": 0.001, "граммов": 0.001, "т": 1000.0, "тонна": 1000.0, "тонн": 1000.0, "тонны": 1000.0}
VOLUME_UNITS = {"л": 1.0, "литр": 1.0, "литров": 1.0, "мл": 0.001, "миллилитров": 0.001, "м3": 1000.0}

# fixed values: spellings of regions, and which regions contain a region
REGION_ALIASES = {
    "екб": "Екатеринбург", "ёбург": "Екатеринбург", "ебург": "Екатеринбург", "екатеринбург": "Екатеринбург",
    "свердловская область": "Свердловская область", "свердловская обл": "Свердловская область",
    "россия": "Россия", "рф": "Россия", "российская федерация": "Россия", "вся россия": "Россия",
    "урал": "Урал", "уральский федеральный округ": "Урал", "урфо": "Урал",
    "москва": "Москва", "московская область": "Московская область", "санкт-петербург": "Санкт-Петербург", "спб": "Санкт-Петербург",
}
REGION_WITHIN = {
    "Екатеринбург": ("Свердловская область", "Урал", "Россия"),
    "Свердловская область": ("Урал", "Россия"),
    "Урал": ("Россия",),
    "Москва": ("Московская область", "Россия"),
    "Московская область": ("Россия",),
    "Санкт-Петербург": ("Россия",),
}
# fixed values: region codes by name, the first name found in a region's text counts
REGION_CODES = {
    "москва": "77", "московская область": "50", "санкт-петербург": "78", "ленинградская область": "47", "екатеринбург": "66", "свердловская область": "66",
    "новосибирск": "54", "новосибирская область": "54", "краснодар": "23", "краснодарский край": "23", "красноярск": "24", "красноярский край": "24",
    "челябинск": "74", "челябинская область": "74", "пермь": "59", "пермский край": "59", "уфа": "02", "республика башкортостан": "02",
    "казань": "16", "республика татарстан": "16", "самара": "63", "самарская область": "63", "ростов-на-дону": "61", "ростовская область": "61",
    "нижний новгород": "52", "нижегородская область": "52", "омск": "55", "омская область": "55", "воронеж": "36", "воронежская область": "36",
    "волгоград": "34", "волгоградская область": "34", "тюмень": "72", "тюменская область": "72",
}

# fixed values: sites whose pages are never candidates
BLOCKED_DOMAINS = (
    "2gis.ru", "aliexpress.ru", "avito.ru", "barahla.net", "dzen.ru", "facebook.com", "instagram.com", "irr.ru", "market.yandex.ru", "ok.ru", "ozon.ru",
    "t.me", "telegram.me", "vk.com", "wildberries.ru", "youtube.com", "youla.ru", "edadeal.ru", "lenta.com", "magnit.ru", "online.metro-cc.ru",
    "perekrestok.ru", "pyaterochka.ru", "samokat.ru", "vprok.ru",
)
# fixed values: catalogue sites, for pages and (a longer list) for scoring
CATALOG_DOMAINS = (
    "all.biz", "aboutpartner.ru", "agroserver.ru", "flagma.ru", "foodtender.ru", "gostpp.ru", "meatinfo.ru", "optomtovar.ru", "optkatalog.ru",
    "productcenter.ru", "pulscen.ru", "regtorg.ru", "satom.ru", "tiu.ru", "vsepostavshiki.ru", "yopt.org",
)
SCORING_CATALOG_DOMAINS = (
    "productcenter.ru", "aboutpartner.ru", "agroserver.ru", "all.biz", "foodtender.ru", "gostpp.ru", "meatinfo.ru", "optomtovar.ru", "optkatalog.ru", "pulscen.ru",
    "tiu.ru", "satom.ru", "flagma.ru", "blizko.ru", "yell.ru", "2gis.ru", "rusprofile.ru", "regtorg.ru", "vsepostavshiki.ru", "yopt.org",
)

# fixed values: words that say nothing about a product, per use
SCORING_STOP_WORDS = ("оптом", "опт", "от", "до", "с", "и", "для", "в", "на", "по", "или", "а", "также", "куплю", "купить", "поставщик", "поставщики", "производитель", "цена", "цены", "доставка")
EXTRACTION_STOP_WORDS = ("для", "или", "при", "оптом", "купить", "цена", "поставщик")
CONTRACT_STOP_WORDS = ("купить", "оптом", "поставка", "поставщик", "цена")
REGISTRY_STOP_WORDS = ("купить", "поставка", "поставку", "оптом", "цена", "окпд2")
TITLE_STOP_WORDS = ("купить", "оптом", "поставщик", "производитель", "цена")
GENERIC_TOKENS = ("замороженный", "заморозка", "охлаждённый", "охлажденный", "свежий", "продукты", "продукция", "полуфабрикаты", "товары", "весовой", "фасованный", "пищевой")

# fixed values: markers of prepared food, per use
SCORING_CONFLICTS = ("сэндвич", "сендвич", "пельмен", "пельмеш", "котлет", "жульен", "рулет", "вялен", "снек", "запеч", "жарен", "салат", "шаурм")
CONTRACT_CONFLICTS = ("сэндвич", "сендвич", "пельмен", "пельмеш", "котлет", "жульен", "рулет", "вялен", "снек")
TITLE_CONFLICTS = ("гречк", "пельмен", "сэндвич", "вялен", "снек", "жульен", "котлет", "рулет", "запеч", "жарен", "салат", "шаурм")
CARD_CONFLICTS = ("гречк", "пельмен", "пельмеш", "сэндвич", "вялен", "снек", "жульен", "котлет", "рулет", "запеч", "жарен", "салат", "шаурм")
CARD_MERITS = ("опт", "производител", "поставщик", "гост", "заморож", "охлажд", "доставка", "прайс")

# fixed values: markers in page lines
ACCESS_PRICE_MARKERS = ("цена доступа", "стоимость доступа", "доступ к контакт", "откроются все контакты", "оплатить", "подписк", "тариф")
LISTING_MARKERS = ("купить/продать", "купить оптом", "поставщики ", "производители ", " в россии", "цены на ")
DELIVERY_WORDS = ("доставк", "самовывоз", "транспортн")
CERTIFICATE_WORDS = ("сертификат", "деклараци", "ветеринарн", "меркурий")
USEFUL_LINK_WORDS = ("catalog", "product", "produk", "assort", "opt", "dostav", "delivery", "contact", "sert", "document", "каталог", "продук", "опт", "достав", "контакт", "документ")
CAPTCHA_MARKERS = ("captcha", "подтвердите, что вы не робот", "проверка браузера")
COMPANY_TYPES = ("manufacturer", "distributor", "wholesaler", "marketplace", "retailer", "unknown")
LINE_COMPANY_TYPES = (
    ("retailer", ("розничн", "супермаркет", "магазин у дома", "мясная лавка")),
    ("manufacturer", ("производител", "производство", "фабрика", "завод")),
    ("distributor", ("дистрибьют",)),
    ("wholesaler", ("оптов", "оптом", "поставщик")),
)
PLACE_COMPANY_TYPES = (
    ("retailer", ("рознич", "фирменный магазин", "гипермаркет", "магазин продуктов", "магазин у дома", "мясная лавка", "продуктовый магазин", "супермаркет")),
    ("manufacturer", ("производитель", "производство", "фабрика", "завод")),
    ("distributor", ("дистрибьютор", "дистрибуция")),
    ("wholesaler", ("опт", "оптов", "поставщик", "склад")),
)
# fixed values: lines of a contract card
SUPPLIER_SECTION = ("Информация о поставщиках", "Информация о контракте", "Обеспечение исполнения")
SUPPLIER_HEADERS = ("Организация", "Страна, код", "Адрес места нахождения", "Почтовый адрес", "Телефон, электронная почта", "Статус", "Индивидуальный предприниматель", "Юридическое лицо")
DELIVERY_PLACE = "Место поставки товара, выполнения работы или оказания услуги"
CHICKEN_FILLET_QUERIES = ("филе куриное", "куриное филе", "филе грудки куриной", "грудка куриная без кости", "филе цыпленка-бройлера", "10.12.20.110")

# fixed values: patterns of facts on pages, as Java expressions with Unicode classes
EMAIL = r"(?U)[\w.+-]+@[\w.-]+\.[A-Za-zА-Яа-я]{2,}"
PHONE = r"(?U)(?:\+7|8)[\s(.-]*\d{3}[\s).-]*\d{3}[\s.-]*\d{2}[\s.-]*\d{2}"
REGISTRY_PHONE = r"(?U)(?:\+?7|8)[\s(.-]*\d{3}[\s).-]*\d{3}[\s.-]*\d{2}[\s.-]*\d{2}"
INN = r"(?iuU)ИНН\s*[:№]?\s*(\d{10}|\d{12})"
PRICE = r"(?iuU)(?:от\s*)?\d[\d\s]*(?:[,.]\d+)?\s*(?:₽|р\.?\b|руб(?:\.|лей|ля)?)(?:\s*(?:/|за\s+)\s*(?:кг|килограмм\w*|шт\.?|штук\w*|упаков\w*))?"
MINIMUM_ORDER = r"(?iuU)(?:минимальн\w*\s+заказ|минимальн\w*\s+партия|заказ\s+от)[^\n]{0,100}"
NUMBER = r"(\d[\d\s]*(?:[.,]\d+)?)"

# fixed values: weights of the score
WEIGHTS = {
    "category_match": 30.0, "region_match": 20.0, "delivery_available": 15.0, "minimum_order_found": 10.0, "minimum_order_fits": 5.0,
    "certificates_found": 10.0, "direct_contacts": 5.0, "price_published": 5.0,
    "penalty_region_unconfirmed": -10.0, "penalty_secondary_source_only": -5.0, "penalty_page_unavailable": -20.0,
}
TRACKED_FIELDS = ("regions", "minimum_order", "price", "delivery", "certificates", "phone", "email", "address", "inn")

# fixed values: labels of the tables shown to people
MISSING = "не найдено"
FIELD_LABELS = {
    "name": "название", "legal_name": "юридическое название", "company_type": "тип компании", "product_categories": "ассортимент",
    "matched_products": "совпавшие позиции", "contract_products": "товары из контрактов ЕИС", "website": "сайт", "regions": "регион работы",
    "minimum_order": "минимальный заказ", "price": "цена", "price_access_note": "условия доступа к цене", "delivery": "доставка",
    "certificates": "документы", "phone": "телефон", "email": "email", "address": "адрес", "inn": "ИНН",
}
TABLE_COLUMNS = ("Оценка", "Компания", "Категории", "Регион", "Минимальный заказ", "Цена", "Доставка", "Документы", "Контакты", "Сайт", "Проверено")
STATUS_LABELS = {"ok": "загружено", "cached": "из кэша", "failed": "не загрузилось", "skipped": "пропущено"}
KIND_LABELS = {"page": "страница", "organization_api": "API организаций", "search_result": "результат поиска", "official_site": "официальный сайт", "catalog": "отраслевой каталог", "government_contract": "государственный контракт"}

# fixed values: templates of search queries
REGION_TEMPLATES = ("{category} оптом {region}", "поставщик {category} доставка {region}", "{category} прайс поставщик {region}")
PLAIN_TEMPLATES = ("{category} оптом", "производитель {category} оптовые условия", "{category} сертификаты производитель")
MAX_QUERIES = 6
