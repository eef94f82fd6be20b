"""Scalar functions as Column expressions: URLs, contacts, regions, quantities, names, words.

Everything stays in the JVM. An empty string counts as missing and becomes null. Case folding is
``lower``; white space and word characters are Unicode (``(?U)``).
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K

Text = Column | str


def col(x: Text) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strings(values: Sequence[str]) -> Column:
    """A literal array of strings."""
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def lookup(table: Mapping[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def blank_to_null(x: Text) -> Column:
    return F.nullif(col(x), F.lit(""))


def clean_text(x: Text) -> Column:
    """White space squeezed and trimmed; null if nothing is left."""
    return blank_to_null(F.trim(F.regexp_replace(col(x), r"(?U)\s+", " ")))


def strip(x: Text) -> Column:
    return F.regexp_replace(col(x), r"(?U)^\s+|\s+$", "")


def first_match(x: Text, pattern: str, group: int = 0) -> Column:
    return blank_to_null(F.regexp_extract(col(x), pattern, group))


def bind(x: Text, body) -> Column:
    """``body(x)`` with ``x`` computed once: a lambda variable, so that nesting doesn't multiply the expression."""
    return F.get(F.transform(F.array(col(x)), body), F.lit(0))


def any_of(values: Sequence[str]) -> str:
    """A regular expression that matches any of the literal values."""
    return "|".join(re.sub(r"([^\w\s])", r"\\\1", v) for v in values)


def contains_any(x: Text, markers: Sequence[str]) -> Column:
    """Whether the lower-cased text holds any of the markers."""
    return F.lower(col(x)).rlike(any_of(markers))


def distinct_non_null(x: Text) -> Column:
    return F.array_distinct(F.array_compact(col(x)))


def redact_error(x: Text, secret: str | None = None, most: int = 200) -> Column:
    """An error message on one line, cut, with a secret masked."""
    masked = F.replace(col(x), F.lit(secret), F.lit("***")) if secret else col(x)
    return F.substring(F.translate(masked, "\n", " "), 1, most)


# ---- URLs -----------------------------------------------------------------------------------


def is_http_url(x: Text) -> Column:
    return F.coalesce(col(x).rlike("(?i)^https?://[^/?#]+"), F.lit(False))


def normalize_url(x: Text) -> Column:
    """Scheme and host in lower case, no leading www., fragment, tracking parameters or closing slashes; null without a host."""
    return bind(F.regexp_replace(strip(x), "#.*$", ""), _normalized)


def _normalized(url: Column) -> Column:
    part = lambda n: F.regexp_extract(url, r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?//([^/?]*)([^?]*)(?:\?(.*))?$", n)
    host = F.regexp_replace(F.lower(part(2)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_replace(part(3), r";[^/]*$", ""), "/+$", "")
    key = lambda p: F.lower(F.try_url_decode(F.split_part(p, F.lit("="), F.lit(1))))
    tracked = lambda p: F.exists(strings(K.TRACKING_PREFIXES), lambda t: F.startswith(key(p), t))
    kept = F.filter(F.split(part(4), "&"), lambda p: (p != "") & ~F.coalesce(tracked(p), F.lit(False)))
    coded = lambda v: F.url_encode(F.coalesce(F.try_url_decode(v), v))
    value = lambda p: F.when(F.instr(p, "=") > 0, F.substr(p, F.instr(p, "=") + 1)).otherwise("")
    pairs = F.transform(kept, lambda p: F.concat(coded(F.split_part(p, F.lit("="), F.lit(1))), F.lit("="), coded(value(p))))
    query = F.array_join(pairs, "&")
    scheme = F.when(part(1) != "", F.concat(F.lower(part(1)), F.lit("://"))).otherwise("//")
    return F.when(host != "", F.concat(scheme, host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def normalize_domain(x: Text) -> Column:
    """The host without user, port, leading www. and case; also of an address without a scheme."""
    rest = F.regexp_replace(strip(x), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//", "")
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":.*$", "")
    return blank_to_null(F.regexp_replace(F.lower(host), r"^www\.", ""))


def domain_in(domain: Text, domains: Sequence[str]) -> Column:
    """Whether a domain is one of the list or below one; false for null."""
    return F.coalesce(col(domain).rlike(rf"(?:^|\.)(?:{any_of(domains)})$"), F.lit(False))


def is_blocked(url: Text) -> Column:
    return domain_in(normalize_domain(url), K.BLOCKED_DOMAINS)


def is_catalog(url: Text) -> Column:
    return domain_in(normalize_domain(url), K.CATALOG_DOMAINS)


def is_scoring_catalog(domain: Text) -> Column:
    return domain_in(domain, K.SCORING_CATALOG_DOMAINS)


def redirect_target(url: Text) -> Column:
    """The address a search redirect names in ``uddg``, else the address itself."""
    return F.coalesce(F.try_url_decode(first_match(url, r"[?&]uddg=([^&#]*)", 1)), col(url))


def absolute_place_url(link: Text, item_id: Text) -> Column:
    """//, /, bare and missing forms of a place's link."""
    x = blank_to_null(strip(link))
    host = F.lit("https://2gis.ru/")
    return (
        F.when(x.isNull(), F.concat(host, F.lit("firm/"), F.replace(F.url_encode(col(item_id)), F.lit("+"), F.lit("%20"))))
        .when(F.startswith(x, F.lit("//")), F.concat(F.lit("https:"), x))
        .when(F.contains(x, F.lit("://")), x)
        .otherwise(F.concat(host, F.ltrim(x, F.lit("/"))))
    )


def url_id(prefix: str, x: Text) -> Column:
    """A stable id: the first 16 hex digits of the version-5 UUID of a URL (or name)."""
    h = F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), F.encode(col(x), "UTF-8")))
    return F.concat(F.lit(prefix), F.substring(h, 1, 12), F.lit("5"), F.substring(h, 14, 3))


# ---- contacts and identifiers -----------------------------------------------------------------


def normalize_email(x: Text) -> Column:
    e = F.lower(strip(x))
    return F.when(e.rlike(r"(?U)^[^@\s]+@[^@\s]+\.[a-z]{2,}$"), e)


def normalize_phone(x: Text) -> Column:
    """+7 and ten digits of a Russian number that begins with 3, 4, 8 or 9; else null.

    A rule in place of number-plan metadata: other countries' numbers with + and 11 to 15 digits pass as they are.
    """
    digits = F.regexp_replace(col(x), "[^0-9]", "")
    core = F.when(F.length(digits) == 10, digits).when((F.length(digits) == 11) & digits.rlike("^[78]"), F.substring(digits, 2, 10))
    foreign = F.startswith(strip(x), F.lit("+")) & ~F.startswith(digits, F.lit("7")) & F.length(digits).between(11, 15)
    return F.when(foreign, F.concat(F.lit("+"), digits)).when(core.rlike("^[3489]"), F.concat(F.lit("+7"), core))


def normalize_inn(x: Text) -> Column:
    """The digits, if there are exactly 10 or 12."""
    digits = F.regexp_replace(col(x), "[^0-9]", "")
    return F.when(F.length(digits).isin(10, 12), digits)


# ---- regions ------------------------------------------------------------------------------------


def normalize_region(x: Text) -> Column:
    key = F.regexp_replace(F.lower(strip(x)), r"(?U)^(г\.?|город|гор\.)\s*", "")
    key = F.trim(F.regexp_replace(key, r"(?U)\s*(обл\.?|область)$", " область"))
    key = F.rtrim(F.regexp_replace(key, r"(?U)\s+", " "), F.lit("."))
    return F.coalesce(F.element_at(lookup(K.REGION_ALIASES), key), blank_to_null(strip(x)))


def normalize_regions(x: Text) -> Column:
    return distinct_non_null(F.transform(col(x), normalize_region))


def region_covers(own: Text, wanted: Text) -> Column:
    """Whether a region is the wanted one or contains it."""
    a, b = normalize_region(own), normalize_region(wanted)
    wider = F.create_map(*[x for k, v in K.REGION_WITHIN.items() for x in (F.lit(k), strings(v))])
    within = F.coalesce(F.array_contains(F.element_at(wider, b), a), F.lit(False))
    return F.coalesce((F.lower(a) == F.lower(b)) | within, F.lit(False))


def region_code(x: Text) -> Column:
    """The code of the first listed name that the region's text holds."""
    text = F.lower(F.regexp_replace(col(x), r"(?U)\s+", " "))
    return F.coalesce(*[F.when(F.contains(text, F.lit(name)), code) for name, code in K.REGION_CODES.items()])


# ---- quantities ---------------------------------------------------------------------------------


def parse_number(x: Text) -> Column:
    return F.replace(F.translate(col(x), " \u00a0", ""), F.lit(","), F.lit(".")).try_cast("double")


def parse_with_units(x: Text, units: Mapping[str, float]) -> Column:
    """The first number with a unit, in the base unit, to six places."""
    names = "|".join(sorted(units, key=len, reverse=True))
    pattern = rf"(?U){K.NUMBER}\s*({names})(?!\w)"
    text = F.lower(col(x))
    return F.round(parse_number(first_match(text, pattern, 1)) * F.element_at(lookup(units), first_match(text, pattern, 2)), 6)


def parse_weight_kg(x: Text) -> Column:
    return parse_with_units(x, K.WEIGHT_UNITS)


def parse_volume_l(x: Text) -> Column:
    return parse_with_units(x, K.VOLUME_UNITS)


def general_number(x: Text) -> Column:
    """A number without closing zeros, up to six places."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", col(x).cast("double")), "0+$", ""), r"\.$", "")


# ---- names and words ------------------------------------------------------------------------------


def normalize_company_name(x: Text) -> Column:
    name = F.regexp_replace(F.lower(strip(x)), "[«»\"'`]", " ")
    name = F.regexp_replace(name, r"(?U)[^\w\s-]", " ")
    for form in K.LEGAL_FORMS:
        name = F.regexp_replace(name, rf"(?U)(?<!\w){form}(?!\w)", " ")
    return clean_text(name)


def scoring_tokens(x: Text) -> Column:
    """Words of more than two characters, without stop words."""
    words = F.regexp_extract_all(F.lower(col(x)), F.lit(r"(?U)[\w-]+"), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*K.SCORING_STOP_WORDS))


def plain_tokens(x: Text, stop: Sequence[str] = ()) -> Column:
    """Words of at least three letters, digits or hyphens, optionally without stop words."""
    words = F.regexp_extract_all(F.lower(col(x)), F.lit("[а-яёa-z0-9-]{3,}"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*stop)) if stop else words


def same_stem(a: Column, b: Column) -> Column:
    """Equal, or alike in the first five characters (four if one has no more)."""
    n = F.least(F.lit(5), F.length(a), F.length(b))
    return (a == b) | ((n >= 4) & (F.left(a, n) == F.left(b, n)))


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, one row of the table per character of ``a``."""

    def table(v: Column) -> Column:
        def row(before: Column, c: Column) -> Column:
            def cell(acc: Column, j: Column) -> Column:
                more = F.when(F.get(v["b"], j - 1) == c, F.get(before, j - 1) + 1).otherwise(F.greatest(F.get(before, j), F.element_at(acc, -1)))
                return F.concat(acc, F.array(more))

            return F.aggregate(F.sequence(F.lit(1), F.size(v["b"])), F.array(F.lit(0)), cell)

        return F.element_at(F.aggregate(v["a"], F.transform(F.sequence(F.lit(0), F.size(v["b"])), lambda _: F.lit(0)), row), -1)

    both = F.struct(F.split(a, "").alias("a"), F.split(b, "").alias("b"))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0)).otherwise(bind(both, table))


def indel_ratio(a: Column, b: Column) -> Column:
    """200 * common subsequence / summed lengths; 100 for two empty strings."""

    def ratio(v: Column) -> Column:
        total = F.length(v["a"]) + F.length(v["b"])
        return F.when(total == 0, F.lit(100.0)).otherwise(F.lit(200.0) * common_subsequence(v["a"], v["b"]) / total)

    return F.when(a.isNotNull() & b.isNotNull(), bind(F.struct(a.alias("a"), b.alias("b")), ratio))


def token_sort_ratio(a: Column, b: Column) -> Column:
    ordered = lambda x: F.array_join(F.sort_array(F.filter(F.split(x, r"(?U)\s+"), lambda w: w != "")), " ")
    return indel_ratio(ordered(a), ordered(b))


def same_word(a: Column, b: Column) -> Column:
    """Equal, alike in five characters, or 88 alike by common subsequence (only tried if lengths allow it)."""
    prefix = (F.length(a) >= 5) & (F.length(b) >= 5) & (F.left(a, F.lit(5)) == F.left(b, F.lit(5)))
    reachable = 200 * F.least(F.length(a), F.length(b)) >= 88 * (F.length(a) + F.length(b))
    return (a == b) | prefix | (reachable & (indel_ratio(a, b) >= 88))


def all_stems_found(wanted: Column, actual: Column) -> Column:
    """Whether every wanted word has a like-stemmed actual one; false if none is wanted."""
    # both once, however often they are used: an expression in a lambda is computed for every element
    fit = lambda v: (F.size(v["wanted"]) > 0) & F.forall(v["wanted"], lambda w: F.exists(v["actual"], lambda x: same_stem(w, x)))
    return bind(F.struct(wanted.alias("wanted"), actual.alias("actual")), fit)


def conflicts(product: Text, query: Text, markers: Sequence[str]) -> Column:
    """Whether the product names prepared food that the query doesn't."""
    p, q = F.lower(col(product)), F.lower(col(query))
    return F.exists(strings(markers), lambda m: F.contains(p, m) & ~F.contains(q, m))


def title_matches(title: Text, query: Text) -> Column:
    return all_stems_found(plain_tokens(query, K.TITLE_STOP_WORDS), plain_tokens(title))


# ---- lines ----------------------------------------------------------------------------------------


def text_lines(x: Text) -> Column:
    """Lines with white space squeezed, blank ones dropped; null text has none."""
    lines = F.transform(F.split(F.coalesce(col(x), F.lit("")), r"\R"), lambda s: F.trim(F.regexp_replace(s, r"(?U)\s+", " ")))
    return F.filter(lines, lambda s: s != "")


def first_line(lines: Column, test, most: int = 240) -> Column:
    return F.substring(F.get(F.filter(lines, test), F.lit(0)), 1, most)


def keyword_line(lines: Column, words: Sequence[str], most: int = 240) -> Column:
    return first_line(lines, lambda s: contains_any(s, words), most)


def product_quote(lines: Column, category: Text, stop: Sequence[str] = K.EXTRACTION_STOP_WORDS, most: int = 240) -> Column:
    """The shortest line, the first of equals, in which every word of the category appears."""

    def shortest(v: Column) -> Column:
        fit = F.filter(v["lines"], lambda s: all_stems_found(v["wanted"], plain_tokens(s)))
        keyed = F.transform(fit, lambda s, i: F.struct(F.length(s).alias("n"), i.alias("i"), s.alias("line")))
        return F.substring(F.array_min(keyed)["line"], 1, most)

    return bind(F.struct(plain_tokens(category, stop).alias("wanted"), col(lines).alias("lines")), shortest)


def value_after(lines: Column, label: str) -> Column:
    """The line after the first line that is the label."""

    def following(x: Column) -> Column:
        at = F.array_position(x, label)
        return F.when(at > 0, F.get(x, at.cast("int")))

    return bind(lines, following)


def typed_by(text: Text, types: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """The first company type of which the text holds a marker; null if none."""
    return F.coalesce(*[F.when(contains_any(text, words), F.lit(kind)) for kind, words in types])


def _telling(lines: Column, name: Text) -> Column:
    """Of the name and the first 80 lines, those that tell a company type, with it."""
    typed = F.transform(F.concat(F.array(col(name)), F.slice(lines, 1, 80)), lambda s: F.struct(typed_by(s, K.LINE_COMPANY_TYPES).alias("kind"), s.alias("line")))
    return F.filter(typed, lambda x: x["kind"].isNotNull())


def line_company_type(lines: Column, name: Text) -> Column:
    """The type of the first telling line among the name and the first 80 lines."""
    return F.coalesce(F.get(_telling(lines, name), F.lit(0))["kind"], F.lit("unknown"))


def company_type_line(lines: Column, name: Text, most: int = 240) -> Column:
    """That line."""
    return F.substring(F.get(_telling(lines, name), F.lit(0))["line"], 1, most)


def plain_html(x: Text) -> Column:
    """Tags removed, the common entities resolved, white space squeezed."""
    text = F.regexp_replace(col(x), "<[^>]+>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.coalesce(clean_text(text), F.lit(""))


def html_text(x: Text) -> Column:
    """The visible lines of a page, without scripts, styles and the like (expression form; see ``sources.html`` for a parser)."""
    body = F.regexp_replace(col(x), r"(?is)<(script|style|noscript|svg|template)\b.*?</\1\s*>", "\n")
    body = F.regexp_replace(F.regexp_replace(body, r"(?s)<!--.*?-->", ""), "<[^>]+>", "\n")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        body = F.replace(body, F.lit(entity), F.lit(char))
    return F.array_join(F.filter(F.transform(F.split(body, r"\R"), strip), lambda s: s != ""), "\n")
