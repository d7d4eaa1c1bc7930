"""Personal data in texts, with DataFrame functions alone.

Patterns propose spans, checks confirm them (numeric ranges, Luhn sums, the mod-97 rule of account
numbers), and words near a span, before or after it, adjust its score. The four base kinds (email,
ip, card, phone) stand once their check holds; the further kinds need a score of at least `ACCEPT`.

A pattern's matches and the pieces of text between them give the spans: a match starts after all
pieces and matches before it. Running sums go over blocks of `BLOCK` matches and over the blocks'
sums, overlaps are found by bisection, and texts are cut from chunks of `CHUNK` characters, so that
a text of very many matches takes little more than linear time. Patterns are possessive and start only where a run
of their characters starts, so that long runs cost no more than their length.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK, CHUNK = 128, 1024
ACCEPT = 0.5
#: Characters before and after a span in which its context words are looked for.
NEAR = 48

EMAIL_CHAR = "[A-Za-z0-9._%+-]"
#: Account numbers by length, with the country codes of that length.
IBAN_CODES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST",
    26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD", 28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _iban() -> str:
    """An account number of the length of its country; of 15 to 34 characters, up to the start of the next one, if the country is not in the table."""
    known = "|".join(f"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{length - 4}}}" for length, codes in IBAN_CODES.items())
    every = f"(?:{'|'.join(IBAN_CODES.values()).replace(' ', '|')})[0-9]{{2}}"
    other = f"(?!{every})[A-Z]{{2}}[0-9]{{2}}(?:(?!\\x20{every})\\x20?[A-Z0-9]){{11,30}}+"
    return f"(?<![A-Za-z0-9])(?:{known}|{other})(?![A-Za-z0-9])"


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of value, which is computed once however often f uses it."""
    return F.transform(F.array(value), f)[0]


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a Luhn sum that 10 divides."""
    doubled = lambda v, i: F.when(i % 2 == 0, v * 2 - F.when(v > 4, 9).otherwise(0)).otherwise(v)
    values = F.transform(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), lambda i: doubled(F.ascii(F.substring(digits, -i, F.lit(1))) - 48, i))
    return (F.length(digits) > 0) & (F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0)


def mod97(account: Column) -> Column:
    """Whether an account number, its first four characters moved to the end and letters written as 10 to 35, is 1 modulo 97."""
    moved = F.concat(F.substr(account, F.lit(5)), F.substring(account, 1, 4))

    def step(rest: Column, i: Column, text: Column) -> Column:
        code = F.ascii(F.substring(text, i, F.lit(1)))
        return F.when(code < 58, rest * 10 + code - 48).otherwise(rest * 100 + code - 55) % 97

    return _let(moved, lambda t: F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), F.lit(0), lambda r, i: step(r, i, t)) == 1)


@dataclass(frozen=True)
class Kind:
    """A kind of personal data: where it can occur, its pattern, its check, its score, and what context words near it add."""

    name: str
    needs: str  # a cheap pattern without which the text has no match
    pattern: str
    check: Callable[[Column], Column]
    context: str
    score: float = 0.8
    gain: float = 0.2
    base: bool = True


PHONE_WORDS = "phone|tel[.:]|t[ée]l|call|mobile|mobil|fax|ruf|llam"
KINDS = (
    Kind("email", "@", rf"(?:(?<!{EMAIL_CHAR})|\G){EMAIL_CHAR}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda m: F.lit(True), "mail|contact|kontakt|correo|courriel|write|schreib|escrib"),
    Kind("ip", r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+", lambda m: m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"), r"\bips?\b|server|host|login|address|adresse|direcci"),
    Kind("card", r"[0-9][\x20-]?[0-9]", r"[0-9](?:[\x20-]?[0-9])++", lambda m: _let(_digits(m), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False)), "card|visa|master|amex|credit|karte|carte|tarjeta|pay|zahl"),
    Kind("phone", r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: F.length(_digits(m)).between(9, 15), PHONE_WORDS),
    Kind("iban", r"[A-Z]{2}[0-9]{2}", _iban(), lambda m: mod97(F.regexp_replace(m, r"\x20", "")), "iban|account|konto|compte|cuenta", base=False),
    Kind(
        "ssn", r"[0-9]-[0-9]{2}-[0-9]", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000$"),
        "ssn|social security|sozialversicherung|s[ée]curit[ée] sociale|seguridad social", 0.3, 0.5, False,
    ),
    Kind("local_phone", r"[0-9]{3}\)?[\x20.-][0-9]{3}", r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])", lambda m: F.lit(True), PHONE_WORDS, 0.3, 0.4, False),
)


def _in_blocks(values: Column, over: Callable[[Column], Column]) -> Column:
    """`over` of each block of BLOCK values."""
    blocks = F.sequence(F.lit(0), F.floor(F.size(values) / BLOCK).cast("int"))
    return F.transform(blocks, lambda b: over(F.slice(values, b * BLOCK + 1, F.lit(BLOCK))))


def _spans(text: Column, kind: Kind) -> Column:
    """The kind's spans in text, by start: an array of (kind, start, end, score)."""

    # piece i and match i, each step their summed length
    def pairs(s: Column) -> Column:
        def pair(m: Column, i: Column) -> Column:
            near = F.concat(F.right(s["p"][i], F.lit(NEAR)), F.lit("\n"), F.left(s["p"][i + 1], F.lit(NEAR)))
            return F.struct(m.alias("m"), near.alias("near"), F.length(s["p"][i]).alias("lead"), F.length(m).alias("long"))

        return F.transform(s["m"], pair)

    def placed(pairs: Column) -> Column:
        total = lambda x: F.aggregate(x, F.lit(0), lambda a, v: a + v["lead"] + v["long"])
        plain = lambda x: F.aggregate(x, F.lit(0), lambda a, v: a + v)
        begins = _let(_in_blocks(pairs, total), lambda sums: F.transform(sums, lambda v, b: plain(F.slice(sums, F.lit(1), b))))

        def span(x: Column, i: Column, begins: Column) -> Column:
            block = F.floor(i / BLOCK).cast("int")
            start = begins[block] + total(F.slice(pairs, block * BLOCK + 1, i % BLOCK)) + x["lead"]
            score = F.lit(kind.score) + F.when(F.lower(x["near"]).rlike(kind.context), kind.gain).otherwise(0.0)
            return F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), (start + x["long"]).alias("end"), score.alias("score"), kind.check(x["m"]).alias("ok"))

        return _let(begins, lambda b: F.transform(pairs, lambda x, i: span(x, i, b)))

    both = F.struct(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("m"), F.split(text, kind.pattern, -1).alias("p"))
    found = F.filter(_let(_let(both, pairs), placed), lambda x: x["ok"] & (x["score"] >= (0.0 if kind.base else ACCEPT)))
    return F.when(text.rlike(kind.needs), F.transform(found, lambda x: F.struct(x["kind"], x["start"], x["end"], x["score"])))


def _overlaps(x: Column, spans: Column) -> Column:
    """Whether the span x overlaps one of `spans`, which are in order and apart: that with the last start before x's end, found by bisection."""

    def step(at: Column, power: Column) -> Column:
        further = (at + power).cast("int")
        return F.when((further <= F.size(spans)) & (F.get(spans, further - 1)["start"] < x["end"]), further).otherwise(at)

    before = F.aggregate(F.array(*[F.lit(1 << k) for k in range(24, -1, -1)]), F.lit(0), step)
    return (F.size(spans) > 0) & _let(before, lambda n: (n > 0) & (F.get(spans, n - 1)["end"] > x["start"]))


def find_spans(text: Column) -> Column:
    """All spans of a text: a struct of one array a kind, in the order of KINDS; null counts as empty.

    Spans of a further kind that overlap a base span are left out.
    """
    none = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    all_kinds = F.struct(*[F.coalesce(_spans(F.coalesce(text, F.lit("")), k), none).alias(k.name) for k in KINDS])

    def without_overlap(s: Column) -> Column:
        base = [s[k.name] for k in KINDS if k.base]

        def apart(y: Column) -> Column:
            hit = _overlaps(y, base[0])
            for b in base[1:]:
                hit = hit | _overlaps(y, b)
            return ~F.coalesce(hit, F.lit(False))

        further = lambda x: F.when(F.size(x) == 0, x).otherwise(F.filter(x, apart))
        return F.struct(*[(s[k.name] if k.base else further(s[k.name])).alias(k.name) for k in KINDS])

    return _let(all_kinds, without_overlap)


def _written(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def scan(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone, base_sha256, spans and least_score for every row.

    Positions count code points, the end is exclusive. A null or empty text has no spans: counts 0,
    spans empty, base_sha256 that of the empty string. Repeated rows get a row each, a null key stays
    null, an empty table gives an empty result. Other columns, whatever their names, are not read.
    """

    def summary(s: Column) -> Column:
        base = F.concat(*[s[k.name] for k in KINDS if k.base])
        every = F.concat(*[s[k.name] for k in KINDS])
        return F.struct(
            *[F.size(s[k.name]).cast("long").alias(f"n_{k.name}") for k in KINDS if k.base],
            F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"),
            _written(every).alias("spans"),
            F.array_min(F.transform(every, lambda x: x["score"])).alias("least_score"),
        )

    out = documents.select(F.col(key).alias("key"), _let(find_spans(F.col(text)), summary).alias("found"))
    return out.select(F.col("key").alias(key), "found.*")


def _piece(chunks: Column, begin: Column, end: Column) -> Column:
    """The text between two positions, from the text's chunks of CHUNK characters."""
    first, last = F.floor(begin / CHUNK).cast("int"), F.floor(end / CHUNK).cast("int")
    chunk = lambda i: F.coalesce(F.get(chunks, i), F.lit(""))
    inside = F.substring(chunk(first), begin - first * CHUNK + 1, end - begin)
    across = F.concat(
        F.substr(chunk(first), begin - first * CHUNK + 1), F.array_join(F.slice(chunks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substring(chunk(last), F.lit(1), end - last * CHUNK)
    )
    return F.when(end <= begin, F.lit("")).when(first == last, inside).otherwise(across)


def redacted(text: Column) -> Column:
    """text with each span replaced by its kind in angle brackets; spans that overlap become one, named by the first.

    Null stays null, and an empty text empty; a text of very many spans takes little more than
    linear time. Repeated rows are changed alike.
    """

    def rebuilt(spans: Column, chunks: Column) -> Column:
        furthest = lambda x: F.coalesce(F.array_max(F.transform(x, lambda y: y["end"])), F.lit(0))

        def part(x: Column, i: Column, tops: Column) -> Column:
            block = F.floor(i / BLOCK).cast("int")
            done = F.greatest(F.coalesce(F.array_max(F.slice(tops, F.lit(1), block)), F.lit(0)), furthest(F.slice(spans, block * BLOCK + 1, i % BLOCK)))
            name = lambda d: F.when(x["start"] >= d, F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">"))).otherwise(F.lit(""))
            return _let(done, lambda d: F.concat(_piece(chunks, d, x["start"]), name(d)))

        parts = _let(_in_blocks(spans, furthest), lambda tops: F.transform(spans, lambda x, i: part(x, i, tops)))
        return F.concat(F.array_join(parts, ""), _let(furthest(spans), lambda end: _piece(chunks, end, F.length(text))))

    def whole(s: Column) -> Column:
        chunks = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{CHUNK}}}"), F.lit(0))
        return F.when(F.size(s) == 0, text).otherwise(_let(chunks, lambda c: rebuilt(s, c)))

    ordered = lambda s: F.array_sort(F.transform(F.concat(*[s[k.name] for k in KINDS]), lambda x: F.struct(x["start"], (-x["end"]).alias("minus"), x["end"], x["kind"])))
    return _let(_let(find_spans(text), ordered), whole)
