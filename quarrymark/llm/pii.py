"""Personal data: regular expressions propose spans, checksums confirm them, context scores them.

Every match is marked by ``regexp_replace`` with two control characters, which no pattern can
match; the marked text is split at them and running lengths give the offsets, in code points.
Matches are leftmost and non-overlapping per kind. Patterns that begin with an unbounded run only
start where the run or the last match starts, and runs are possessive, so long runs cost linear
time; the matches are the same. Kinds: email, ip (parts at most 255), card (12 to 19 digits and the
Luhn sum), phone (9 to 15 digits), and beyond them iban (country lengths 15 to 34, mod 97 is 1).
A span's score starts from its kind, and a word for its kind shortly before it adds ``CONTEXT_GAIN``.
Base kinds are kept whatever their score, which is returned; beyond them a span needs ``LEAST_SCORE``:
an iban of the length its country registers has it, any other one only beside such a word.
DataFrame expressions only; time is linear in the text, but for running sums over the spans of one
text, which take the power 1.5 of their number.

Defined results: null and empty texts have no spans; rows that repeat are each searched; an empty
table gives no rows. A column of the name ``into`` is replaced, other columns pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

OPEN, CLOSE, OTHER = "\x01", "\x02", "\x03"
SPAN = "struct<kind:string,start:int,end:int,value:string,score:double>"

#: Kinds in their order, their patterns, scores and context words.
KINDS = ("email", "ip", "card", "phone", "iban")
BASE = KINDS[:4]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
}
NEEDS = {"email": "@", "phone": "+"}
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.5}
CONTEXT = {
    "email": "mail|contact|write|kontakt|correo|courriel",
    "ip": "ip|host|server|address|adresse",
    "card": "card|visa|master|credit|karte|tarjeta|carte",
    "phone": "phone|call|tel|mobile|fax|anruf",
    "iban": "iban|bank|account|konto|cuenta|compte",
}
CONTEXT_WIDTH, CONTEXT_GAIN, LENGTH_GAIN, LEAST_SCORE = 40, 0.1, 0.3, 0.6
#: The number of characters that countries register for their account numbers.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "ES": 24, "FI": 18,
    "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21,
    "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24,
    "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VG": 24, "XK": 20,
}
STEP, PIECE = 64, 4096


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _number(char: Column) -> Column:
    return char.cast("int")


def luhn_valid(digits: Column) -> Column:
    """Whether the digits pass the Luhn sum."""
    size = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = _number(F.substr(digits, size - i + 1, F.lit(1)))
        twice = d * 2
        return (total + F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)).cast("int")

    return F.aggregate(F.sequence(F.lit(1), size), F.lit(0), add) % 10 == 0


def iban_valid(value: Column) -> Column:
    """Whether the number, moved behind by four characters and letters read as 10 to 35, leaves 1 modulo 97."""
    plain = F.regexp_replace(value, " ", "")
    moved = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))

    def add(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substr(moved, i, F.lit(1)))
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97).cast("int")

    return F.length(plain).between(15, 34) & (F.aggregate(F.sequence(F.lit(1), F.length(plain)), F.lit(0), add) == 1)


def _confirmed(kind: str, value: Column) -> Column:
    if kind == "ip":
        return ~F.exists(F.split(value, "\\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) > 3) | (F.right(p, F.lit(3)).cast("int") > 255))
    if kind == "card":
        digits = _digits(value)
        return F.length(digits).between(12, 19) & luhn_valid(digits)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    if kind == "iban":
        return iban_valid(value)
    return F.lit(True)


def _bound(value: Column, use) -> Column:
    """``use`` of the value, computed once: a lambda's body would compute it anew for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(values: Column) -> Column:
    """The sum of the values before each one: within steps of ``STEP`` values, then over the steps."""
    before = lambda xs: F.aggregate(xs, F.array(F.lit(0)), lambda acc, v: F.concat(acc, F.array((F.element_at(acc, -1) + v).cast("int"))))
    steps = lambda xs: F.transform(F.sequence(F.lit(0), ((F.size(xs) - 1) / STEP).cast("int")), lambda k: before(F.slice(xs, k * STEP + 1, F.lit(STEP))))
    spread = lambda rows, heads: F.flatten(F.transform(rows, lambda x, k: F.transform(F.slice(x, F.lit(1), F.size(x) - 1), lambda v: v + F.get(heads, k))))
    return _bound(values, lambda xs: _bound(steps(xs), lambda rows: _bound(before(F.transform(rows, lambda x: F.element_at(x, -1))), lambda heads: spread(rows, heads))))


def _scored(kind: str, value: Column, before: Column) -> Column:
    score = F.lit(BASE_SCORE[kind]) + F.when(F.lower(before).rlike(rf"\b(?:{CONTEXT[kind]})"), CONTEXT_GAIN).otherwise(0.0)
    if kind == "iban":
        lengths = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])
        score += F.when(F.coalesce(F.element_at(lengths, F.left(value, F.lit(2))), F.lit(0)) == F.length(F.regexp_replace(value, " ", "")), LENGTH_GAIN).otherwise(0.0)
    return F.round(score, 2)


def _spans(marked: Column, kind: str) -> Column:
    """The confirmed spans of one kind from the marked text; each part but the first begins with a span."""

    def of_parts(parts: Column, plain: Column, starts: Column) -> Column:
        def span(part: Column, i: Column) -> Column:
            value = F.substring_index(part, CLOSE, 1)
            begin = F.get(starts, i + 1)
            # context reaches back to the last span of the kind
            score = _scored(kind, value, F.right(F.get(plain, i), F.lit(CONTEXT_WIDTH)))
            return F.struct(F.lit(kind).alias("kind"), begin.alias("start"), (begin + F.length(value)).alias("end"), value.alias("value"), score.alias("score"))

        return F.filter(F.transform(F.slice(parts, F.lit(2), F.size(parts)), span), lambda s: _confirmed(kind, s["value"]) & ((s["score"] >= LEAST_SCORE) if kind not in BASE else F.lit(True)))

    unmarked = lambda parts: F.transform(parts, lambda p: F.translate(p, CLOSE, ""))
    lengths = lambda plain: F.transform(plain, lambda p: F.length(p))
    kept = _bound(F.split(marked, OPEN), lambda parts: _bound(unmarked(parts), lambda plain: _bound(_running(lengths(plain)), lambda starts: of_parts(parts, plain, starts))))
    return F.when(F.instr(marked, OPEN) > 0, kept).otherwise(F.array().cast(f"array<{SPAN}>"))


def find_pii(docs: DataFrame, text: str = "text", into: str = "pii", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Adds the spans of all kinds, by start and then kind, as an array of (kind, start, end, value, score)."""
    kept = [c for c in docs.columns if c.lower() != into.lower()]
    clean, marks = free_name(docs, f"{into}__clean"), {k: free_name(docs, f"{into}__{k}") for k in kinds}
    out = docs.withColumn(clean, F.translate(F.coalesce(F.col(text), F.lit("")), OPEN + CLOSE, OTHER + OTHER))
    out = out.withColumns({marks[k]: F.when(F.contains(clean, F.lit(NEEDS[k])) if k in NEEDS else F.lit(True), F.regexp_replace(clean, PATTERNS[k], f"{OPEN}$0{CLOSE}")).otherwise(F.lit("")) for k in kinds})
    order = F.create_map(*[F.lit(x) for i, k in enumerate(kinds) for x in (k, i)])
    spans = F.concat(*[_spans(F.col(marks[k]), k) for k in kinds])
    keyed = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("order"), s.alias("span"))))
    return out.select(*kept, F.transform(keyed, lambda s: s["span"]).alias(into))


def render(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", spans: str = "pii", into: str = "redacted") -> DataFrame:
    """Adds the text with each span replaced by its kind in brackets; of overlapping spans the first one counts.

    The text is cut into pieces of ``PIECE`` characters once, so that no span is sought from the text's start.
    """

    def follow(acc: Column, s: Column) -> Column:
        counts = s["start"] >= acc["at"]
        return F.struct(F.when(counts, s["end"]).otherwise(acc["at"]).alias("at"), F.concat(acc["flags"], F.when(counts, "1").otherwise("0")).alias("flags"))

    flags = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("flags")), follow)["flags"]
    first_ones = _bound(flags, lambda x: F.filter(F.col(spans), lambda _, i: F.substr(x, i + 1, F.lit(1)) == "1"))
    cut = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def fill(kept: Column, pieces: Column) -> Column:
        def between(begin: Column, end: Column) -> Column:
            first = (begin / PIECE).cast("int")
            near = F.array_join(F.slice(pieces, first + 1, ((end - 1) / PIECE).cast("int") - first + 1), "")
            return F.when(begin < end, F.substr(near, begin - first * PIECE + 1, end - begin)).otherwise("")

        end_of = lambda i: F.when(i < 0, 0).otherwise(F.get(kept, i)["end"])
        filled = F.transform(kept, lambda s, i: F.concat(between(end_of(i - 1), s["start"]), F.lit("["), s["kind"], F.lit("]")))
        return F.concat(F.array_join(filled, ""), between(end_of(F.size(kept) - 1), F.length(F.col(text))))

    whole = _bound(first_ones, lambda kept: _bound(cut, lambda pieces: fill(kept, pieces)))
    return docs.withColumn(into, F.when(F.col(text).isNotNull(), whole))
