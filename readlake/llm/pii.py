"""Personal data: patterns propose spans, checksums confirm them, context moves their score.

DataFrame operations only. Positions come from the lengths of the matches and of the text
between them, in code points. The patterns have no repeated groups, which Java's engine
would match by recursion: where a kind needs one, the separators that may stand inside a
match are first replaced by a sign of their own, one for one, in a copy of the text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import fresh

BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "iban", "national_id", "short_card", "secret"]
THRESHOLD = 0.5
CONTEXT = 40  # code points on either side
NEAR, FAR = 0.4, -0.3  # what a supporting or a contradicting word nearby adds
INNER_DOT, INNER_SPACE = "\ue001", "\ue000"

_LOCAL = r"A-Za-z0-9._%+" + INNER_DOT + "-"
_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
# How many signs an IBAN has, by country.
IBAN_LENGTHS = {
    15: "NO",
    16: "BE",
    18: "DK FI FK FO GL NL SD",
    19: "MK SI",
    20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST",
    26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA",
    30: "JO KW MU YE",
    31: "MT SC",
    32: "LC",
    33: "RU",
}
_AGAINST = "version|build|isbn|serial|order no|sha1|commit"


def _iban() -> str:
    """An IBAN in groups of four or without spaces, as long as its country has it, so that a word
    in capitals after it is not taken in; of a country that is not listed, any length."""
    known = []
    for length, countries in IBAN_LENGTHS.items():
        fours, rest = divmod(length - 4, 4)
        tail = f" ?[A-Z0-9]{{{rest}}}" if rest else ""
        known.append(f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{fours}}}{tail}")
    listed = "|".join(" ".join(IBAN_LENGTHS.values()).split())
    other = f"(?!{listed})[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?"
    return f"(?<![A-Za-z0-9])(?:{'|'.join([*known, other])})(?![A-Za-z0-9])"


@dataclass(frozen=True)
class Kind:
    """``gate`` is a cheap pattern that texts without a match fail; ``score`` what a confirmed
    match starts with. A match is kept from THRESHOLD on; base kinds are always kept."""

    name: str
    pattern: str
    gate: str
    score: float
    context: str = ""
    copy: str = "text"


PATTERNS = [
    Kind("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++{INNER_DOT}[A-Za-z0-9{INNER_DOT}-]++", "@", 0.9, "mail|contact|@", "dotted"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.6, "ip|address|host|server|login"),
    Kind("card", f"[0-9][0-9{INNER_SPACE}]++", "[0-9](?:[ -]?[0-9]){12}", 0.8, "card|visa|credit|karte|carte|tarjeta", "glued"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.6, "phone|tel|call|mobile|fax"),
    Kind("iban", _iban(), "[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", 0.8, "iban|bank|account|konto|compte|cuenta"),
    Kind("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.3, "ssn|social security|national id"),
    Kind("secret", r"(?<![0-9A-Za-z])[0-9a-f]{32,64}(?![0-9A-Za-z])", "[0-9a-f]{32}", 0.3, "token|secret|api.?key|password|passwd"),
]


def _of(kind: str) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def step(total: Column, k: Column) -> Column:
        digit = F.substring(digits, k, F.lit(1)).cast("int")
        doubled = F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit)
        return total + F.when((F.length(digits) - k) % 2 == 1, doubled).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN's check digits are right."""
    moved = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def step(rest: Column, sign: Column) -> Column:
        digit = sign.between("0", "9")
        return F.when(digit, (rest * 10 + sign.try_cast("int")) % 97).otherwise((rest * 100 + F.ascii(sign) - 55) % 97)

    signs = F.filter(F.split(moved, ""), lambda s: s != "")
    return F.aggregate(signs, F.lit(0), step) == 1


def _confirmed(kind: str, match: Column) -> Column:
    """The name under which a match counts; null if its check fails."""
    digits = _digits(match)
    n = F.length(digits)
    if kind == "ip":
        ok = match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    elif kind == "card":
        name = F.when(n.between(16, 19), "card").when(n.between(13, 15), "short_card")
        return F.when(n.between(13, 19) & luhn(F.when(n.between(13, 19), digits).otherwise("0")), name)
    elif kind == "phone":
        ok = n.between(8, 15)
    elif kind == "iban":
        ok = mod97(F.replace(match, F.lit(" "), F.lit("")))
    elif kind == "national_id":
        ok = ~match.rlike("^(000|666|9)|-00-|-0000$")
    else:
        ok = F.lit(True)
    return F.when(ok, F.lit(kind))


def _located(kind: Kind) -> Column:
    """The confirmed matches of a kind as structs (kind, start, end, score), from the columns
    with its matches and the lengths of the text between them."""
    matches, gaps = F.col(f"_match_{kind.name}"), F.col(f"_gap_{kind.name}")
    spans = F.zip_with(
        matches, F.slice(gaps, F.lit(1), F.size(matches)), lambda m, g: F.struct(m.alias("m"), g.alias("g"))
    )
    empty = F.from_json(F.lit("[]"), "array<struct<start:int,end:int,m:string>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("found"))

    def place(state: Column, span: Column) -> Column:
        begin = state["at"] + span["g"]
        end = begin + F.length(span["m"])
        one = F.array(F.struct(begin.alias("start"), end.alias("end"), span["m"].alias("m")))
        return F.struct(end.alias("at"), F.concat(state["found"], one).alias("found"))

    placed = F.aggregate(spans, start, place, lambda state: state["found"])
    named = F.transform(
        placed,
        lambda s: F.struct(
            _confirmed(kind.name, s["m"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")
        ),
    )
    named = F.filter(named, lambda s: s["kind"].isNotNull())

    def scored(s: Column) -> Column:
        first = F.greatest(s["start"] - CONTEXT, F.lit(0))
        around = F.lower(
            F.concat(
                F.substring(F.col("text"), first + 1, s["start"] - first),
                F.lit(" "),
                F.substring(F.col("text"), s["end"] + 1, F.lit(CONTEXT)),
            )
        )
        start_score = F.when(s["kind"] == "short_card", F.lit(0.3)).otherwise(F.lit(kind.score))
        moved = F.when(around.rlike(kind.context), F.lit(NEAR)).otherwise(F.lit(0.0)) + F.when(
            around.rlike(_AGAINST), F.lit(FAR)
        ).otherwise(F.lit(0.0))
        score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), start_score + moved))
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), score.alias("score"))

    kept = F.filter(
        F.transform(named, scored), lambda s: s["kind"].isin(BASE_KINDS) | (s["score"] >= THRESHOLD)
    )
    none = F.from_json(F.lit("[]"), "array<struct<kind:string,start:int,end:int,score:double>>")
    return F.when(F.size(matches) > 0, kept).otherwise(none)


def with_spans(documents: DataFrame, text_column: str = "text", name: str = "spans") -> DataFrame:
    """One more column: an array of (kind, start, end, score), by kind in the order of KINDS,
    then by start; places in code points, the end exclusive.

    Base kinds: email addresses, IPv4 addresses, card numbers of 16 to 19 digits that pass
    Luhn, phone numbers of 8 to 15 digits. Added where check and context agree: IBANs (mod
    97), national ids, card numbers of 13 to 15 digits, secrets. Spans of one pattern do
    not overlap, those of different ones may. Null and empty texts have none.
    """
    carried = F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("_row")
    texts = documents.select(carried, F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text"))
    dots = F.regexp_replace(F.replace("text", F.lit(INNER_DOT), F.lit(" ")), r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", INNER_DOT)
    spaces = F.regexp_replace(F.replace("text", F.lit(INNER_SPACE), F.lit("_")), "(?<=[0-9])[ -](?=[0-9])", INNER_SPACE)
    gates = {kind.name: F.col("text").rlike(kind.gate) for kind in PATTERNS}
    gates["email"] = F.contains("text", F.lit("@"))
    texts = texts.select("*", *(gate.alias(f"_has_{name}") for name, gate in gates.items()))
    copies = texts.select(
        "_row",
        "text",
        *(f"_has_{kind.name}" for kind in PATTERNS),
        F.when(F.col("_has_email"), dots).alias("dotted"),
        F.when(F.col("_has_card"), spaces).alias("glued"),
    )
    parts = []
    for kind in PATTERNS:
        has, copy = F.col(f"_has_{kind.name}"), F.col(kind.copy)
        found = F.when(has, F.regexp_extract_all(copy, F.lit(kind.pattern), F.lit(0)))
        between = F.when(has, F.transform(F.split(copy, kind.pattern), F.length))
        parts += [found.alias(f"_match_{kind.name}"), between.alias(f"_gap_{kind.name}")]
    split = copies.select("_row", "text", *parts)
    located = split.select("_row", *(_located(kind).alias(f"_at_{kind.name}") for kind in PATTERNS))
    both = F.concat(*(F.col(f"_at_{kind.name}") for kind in PATTERNS))
    ordered = F.concat(*(F.filter(F.col(name), _of(k)) for k in KINDS))
    return located.select("_row", both.alias(name)).select("_row.*", ordered.alias(name))


def as_text(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    written = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(written, ",")


def find_pii(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row its id as ``doc_id``, a count for each base kind, ``base_sha256`` of the base
    spans as text, and all ``spans`` as text. Repeated rows come back as they are; other
    columns are not read."""
    source = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    found = with_spans(source, "text").select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["kind"].isin(BASE_KINDS))
    counts = [
        F.size(F.filter("spans", _of(k))).cast("bigint").alias(f"n_{k}") for k in BASE_KINDS
    ]
    return found.select("doc_id", *counts, F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))


def redact(documents: DataFrame, text_column: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in brackets; spans that overlap are
    replaced together, by the first one's kind. Texts without spans stay as they are."""
    (name,) = fresh(documents, "spans")
    text = F.col(f"`{text_column}`")
    ordered = F.array_sort(
        F.transform(name, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    )
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def cut(state: Column, s: Column) -> Column:
        piece = F.concat(
            state["out"],
            F.substring(text, state["at"] + 1, s["start"] - state["at"]),
            F.lit("["),
            F.upper(s["kind"]),
            F.lit("]"),
        )
        out = F.when(s["start"] >= state["at"], piece).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), out.alias("out"))

    def finish(state: Column) -> Column:
        return F.concat(state["out"], F.substring(text, state["at"] + 1, F.length(text)))

    masked = F.aggregate(ordered, start, cut, finish)
    found = with_spans(documents, text_column, name)
    return found.withColumn(text_column, F.when(F.size(name) > 0, masked).otherwise(text)).drop(name)
