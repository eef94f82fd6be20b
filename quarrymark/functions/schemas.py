"""Schemas of the records: suppliers, evidence, hits, pages, contracts, places, facts, history."""

EVIDENCE = "struct<field_name:string,value:string,source_url:string,quote:string,confidence:double>"
SUPPLIER = (
    "id string, name string, legal_name string, inn string, company_type string, product_categories array<string>, matched_products array<string>, "
    "contract_products array<string>, address string, regions array<string>, minimum_order string, minimum_order_kg double, price string, price_access_note string, "
    "delivery string, certificates array<string>, phone string, phone_raw string, email string, website string, domain string, source_urls array<string>, "
    f"discovery_queries array<string>, evidence array<{EVIDENCE}>, checked_at timestamp"
)
HIT = "url string, title string, snippet string, query string, provider string, rank int, supplier_id string, related_urls array<string>, ord long"
PAGE = "url string, final_url string, status string, http_status int, mime_type string, html string, text string, error string, ord long"
SOURCE = "url string, domain string, status string, http_status int, note string, supplier_name string, discovery_query string, provider string, source_kind string"
REQUEST = "category string, region string, required_volume_kg double, delivery_required boolean, documents_required boolean, extra_requirements string, eis_queries array<string>, max_results int"
FACT = "struct<value:string,quote:string,source_url:string>"
#: The record an extraction model returns for a page: single facts and lists of facts.
PAGE_FACTS = ", ".join([*(f"{n} {FACT}" for n in ("legal_name", "inn", "company_type", "address", "minimum_order", "price", "delivery", "phone", "email")), *(f"{n} array<{FACT}>" for n in ("matched_products", "regions", "certificates"))])
CONTRACTS = (
    "contracts struct<total:long,data:array<struct<regNum:string,number:string,signDate:string,regionCode:string,contractUrl:string,"
    "customer:struct<postalAddress:string,legalAddress:string>,products:array<struct<name:string>>,"
    "suppliers:array<struct<organizationName:string,inn:string,factualAddress:string,postalAddress:string,contactInfo:struct<phone:string,phoneNumber:string,email:string>>>>>>"
)
PLACES = (
    "meta struct<code:string,error:struct<message:string>>, result struct<items:array<struct<id:string,name:string,full_name:string,address_name:string,link:string,"
    "rubrics:array<struct<name:string>>,adm_div:array<struct<name:string>>,org:struct<id:string,name:string>,"
    "contact_groups:array<struct<contacts:array<struct<type:string,value:string,text:string>>>>>>>"
)
WEB_RESULTS = "web struct<results:array<struct<url:string,title:string,description:string>>>"
#: A row of a landing: the request that brought it, its number and date, the payload as it came.
LANDED = "region string, category string, number string, signed timestamp, payload string"
HISTORY = {
    "search_runs": "run_id string, started_at timestamp, finished_at timestamp, status string, request string, stats string, warnings string, suppliers_found int, candidates_found int",
    "suppliers": "run_id string, supplier_id string, name string, score double, excluded boolean, verification_status string, payload string",
    "evidence": "run_id string, supplier_id string, field_name string, value string, source_url string, quote string, confidence double",
    "sources": f"run_id string, seq long, {SOURCE}",
    "page_cache": "url string, final_url string, http_status int, mime_type string, fetched_at timestamp, expires_at timestamp, content_hash string, html string, cleaned_text string, error string",
}
