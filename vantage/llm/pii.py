"""Personal data: regular expressions propose spans, validators confirm, context adjusts scores.

All of it stays in the JVM as column expressions over one row's text, with no shuffle. Spans are
offsets in code points, end exclusive. The gaps between matches come from splitting a text at its
own matches; validators run on the matches before any offset is taken, and offsets are sums of
lengths in blocks, so a text with very many matches costs little more than its length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns, in the order of output. A start inside a run of characters that the pattern
#: could have begun with earlier is never leftmost, so the runs are anchored and possessive,
#: which keeps matching linear on long runs and gives the same matches.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "paycard": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,14}(?![ -]?[0-9])",
    "secret": r"(?<![A-Za-z0-9_/+=-])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,80}|xox[abprs]-[A-Za-z0-9-]{10,80}|[A-Za-z0-9_+/-]{20,128}={0,2})(?![A-Za-z0-9_/+=-])",
}
BASE_KINDS = ["email", "ip", "card", "phone"]
#: What a pattern must hold to be worth running.
NEEDS = {"email": "@", "phone": "+"}
#: Words near a span that speak for it.
CONTEXT = {
    "email": "e-?mails?|contact|write|kontakt|correo|courriel",
    "ip": "ip|address|server|host|login",
    "card": "card|visa|mastercard|credit|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|fax|ruf|telefon|teléfono|téléphone",
    "iban": "iban|account|konto|compte|cuenta|bank",
    "ssn": "ssn|social|security|taxpayer",
    "paycard": "card|visa|amex|credit|karte|carte|tarjeta",
    "secret": "token|secret|password|passwd|pwd|api[_-]?key|apikey|access[_-]?key|auth|bearer|credentials?|passwort|clave|contraseña|jeton",
}
#: Words near a span that speak against it.
AGAINST = "example|sample|dummy|placeholder|fake|beispiel|ejemplo|exemple|version|isbn|serial|checksum|digest|commit|sha-?1|sha-?256|md5"
#: Score from the pattern and its validator alone; context words add or take away.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.6, "ssn": 0.35, "paycard": 0.4, "secret": 0.35}
CONTEXT_GAIN, CONTEXT_LOSS = 0.2, 0.3
#: Characters on either side that count as near; matches whose lengths are summed at once; bits
#: per character from which on a secret is random enough.
REACH, SUM_BLOCK, SECRET_BITS = 40, 64, 3.0


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), then), 0)


def _spans(kind: str) -> Column:
    """Array of (s, e, v, c): start, end, text and lower-cased neighbourhood of each valid match."""
    m, g = F.col(f"m_{kind}"), F.col(f"g_{kind}")
    last = F.size(m) - 1
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, b: a + b)
    good = F.filter(F.sequence(F.lit(0), last), lambda k: _valid(kind, F.get(m, k)))

    def placed(which: Column, lengths: Column, before: Column) -> Column:
        def one(k: Column) -> Column:
            block = F.floor(k / SUM_BLOCK).cast("int")
            s = F.get(before, block) + total(F.slice(lengths, block * SUM_BLOCK + 1, k % SUM_BLOCK)) + F.length(F.get(g, k))
            near = F.lower(F.concat(F.right(F.get(g, k), F.lit(REACH)), F.lit(" "), F.left(F.get(g, k + 1), F.lit(REACH))))
            return F.struct(s.alias("s"), (s + F.length(F.get(m, k))).alias("e"), F.get(m, k).alias("v"), near.alias("c"))

        return F.transform(which, one)

    lengths = F.transform(F.sequence(F.lit(0), last), lambda k: F.length(F.get(g, k)) + F.length(F.get(m, k)))

    def sums(x: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor(F.size(x) / SUM_BLOCK).cast("int"))
        return F.aggregate(blocks, F.array(F.lit(0)), lambda a, j: F.array_append(a, F.element_at(a, -1) + total(F.slice(x, j * SUM_BLOCK + 1, F.lit(SUM_BLOCK)))))

    none = F.array().cast("array<struct<s:int,e:int,v:string,c:string>>")
    found = _let(good, lambda which: F.when(F.size(which) > 0, _let(lengths, lambda x: _let(sums(x), lambda before: placed(which, x, before)))).otherwise(none))
    return F.when(F.size(m) > 0, found).otherwise(none)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(v: Column) -> Column:
    d = _digits(v)

    def add(total: Column, i: Column) -> Column:
        x = d.substr(-i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + x % 10 + F.floor(x / 10).cast("int")

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0


def mod97(v: Column) -> Column:
    """The ISO 7064 check of an IBAN: first four characters last, letters as 10 to 35."""
    s = F.regexp_replace(v, " ", "")
    turned = F.split(F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4)), "")

    def step(r: Column, ch: Column) -> Column:
        n = F.ascii(ch)
        return F.when(n >= 65, (r * 100 + n - 55) % 97).otherwise((r * 10 + n - 48) % 97)

    return F.length(s).between(15, 34) & (F.aggregate(turned, F.lit(0), step) == 1)


def entropy(v: Column) -> Column:
    """Bits per character of a string."""
    n = F.length(v)

    def part(chars: Column) -> Column:
        def bits(total: Column, ch: Column) -> Column:
            p = F.size(F.filter(chars, lambda x: x == ch)) / n
            return total - p * F.log2(p)

        return F.aggregate(F.array_distinct(chars), F.lit(0.0), bits)

    return _let(F.split(v, ""), part)


def _valid(kind: str, v: Column) -> Column:
    n = F.length(_digits(v))
    return {
        "email": lambda: F.lit(True),
        "ip": lambda: F.forall(F.split(v, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False))),
        "card": lambda: n.between(16, 19) & luhn(v),
        "phone": lambda: n.between(8, 15),
        "iban": lambda: mod97(v),
        "ssn": lambda: ~v.rlike("^(000|666|9)") & ~v.rlike("-00-") & ~v.rlike("0000$"),
        "paycard": lambda: n.between(13, 15) & luhn(v),
        "secret": lambda: v.rlike("[0-9]") & v.rlike("[A-Za-z]") & (entropy(v) >= SECRET_BITS),
    }[kind]()


def _score(kind: str, near: Column) -> Column:
    word = lambda words: near.rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{words})(?![\p{{L}}\p{{N}}])")
    return F.round(PRIOR[kind] + F.when(word(CONTEXT[kind]), CONTEXT_GAIN).otherwise(0.0) - F.when(word(AGAINST), CONTEXT_LOSS).otherwise(0.0), 2)


def find_pii(docs: DataFrame, keep: list[str], text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``keep`` columns and, per kind, an array spans_<kind> of (s, e, v, score).

    Base kinds (email, ip, card, phone) keep every validated match whatever its score; the other
    kinds keep those of at least ``threshold``: an IBAN unless words speak against it, a social
    security number, a shorter card number and a random string only where words speak for it.
    Null and empty texts have empty arrays. Rows are judged one by one, so repeated rows and
    empty tables need nothing special.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    has = lambda k, x: F.when(F.instr("_t", NEEDS[k]) > 0, x).otherwise(F.array().cast("array<string>")) if k in NEEDS else x
    one = docs.select(*keep, t.alias("_t"))
    two = one.select(*keep, "_t", *[has(k, F.regexp_extract_all("_t", F.lit(p), 0)).alias(f"m_{k}") for k, p in PATTERNS.items()])
    three = two.select(*keep, *[f"m_{k}" for k in PATTERNS], *[F.when(F.size(f"m_{k}") > 0, F.split("_t", p, -1)).alias(f"g_{k}") for k, p in PATTERNS.items()])
    four = three.select(*keep, *[_spans(k).alias(f"a_{k}") for k in PATTERNS])

    def judged(k: str) -> Column:
        scored = F.transform(f"a_{k}", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v"), _score(k, x["c"]).alias("score")))
        return scored if k in BASE_KINDS else F.filter(scored, lambda x: x["score"] >= threshold)

    return four.select(*keep, *[judged(k).alias(f"spans_{k}") for k in PATTERNS])


def pii_digest(found: DataFrame) -> DataFrame:
    """Contract columns from ``find_pii``; n_spans counts spans of all kinds, scores lists every
    span with its score."""

    def told(kinds: list[str], *parts: str) -> Column:
        def of(kind: str) -> Column:
            return F.transform(f"spans_{kind}", lambda x: F.concat_ws(":", F.lit(kind), *[x[p] for p in parts]))

        return F.array_join(F.flatten(F.array(*[of(k) for k in kinds])), ",")

    kinds = list(PATTERNS)
    counts = [F.size(f"spans_{k}").cast("long") for k in PATTERNS]
    return found.select("doc_id", *[c.alias(f"n_{k}") for k, c in zip(PATTERNS, counts, strict=True)], sum(counts[1:], counts[0]).alias("n_spans"), F.sha2(told(BASE_KINDS, "s", "e"), 256).alias("base_sha256"), told(kinds, "s", "e").alias("spans"), told(kinds, "s", "e", "score").alias("scores"))
