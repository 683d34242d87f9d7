"""Format-preserving pseudonyms for personal data.

Validated numbers (payment cards by check digit, telephone and social numbers, IPv4
addresses), calendar dates and e-mail names are permuted within their format by a
keyed Feistel network, so equal values get equal pseudonyms in every document and
different values never share one. Digits stay digits, letters stay letters of their
case, separators stay where they are, a card stays valid, an address's parts stay
below 256, a date stays a date between 1900 and 2099. Addresses whose parts have
leading zeros aren't valid. Column functions only: no shuffle, and rows without a digit
or an "@" aren't looked at twice. All text around the values stays as it is.

Defined cases: null text stays null; repeated rows give equal results; candidates
that fail validation stay as they are; of a very long text the values are one array; an
empty table gives no rows; all other columns are kept, whatever their names, but one
called as the added one, which gives way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ROUNDS = 8
FIRST_DAY, DAYS = "1900-01-01", 73049

# Candidate patterns, in order of precedence.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
IP = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"
DATE = r"(?<![\d-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d-])"
SOCIAL = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
CARD = r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])"
PHONE = r"(?<![\w.-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?\d{3}|\d{3}[ .-]\d{3})[ .-]\d{3,4}(?![\w-])"
KINDS = ["email", "ip", "date", "social", "card", "phone"]
PATTERNS = dict(zip(KINDS, [EMAIL, IP, DATE, SOCIAL, CARD, PHONE]))


def _let(value: Column, body) -> Column:
    """body(value), evaluated once."""
    return F.transform(F.array(value), body)[0]


def feistel(values: Column, sizes: Column, key: str, kind: str) -> Column:
    """An array of numbers, each below its size, permuted: alternate halves (by even and odd place) are
    shifted by a keyed hash of the other half. Undone by shifting back in reverse order."""

    def turn(a: Column, r: Column) -> Column:
        fixed = F.array_join(F.filter(a, lambda _, i: i % 2 == r % 2).cast("array<string>"), ",")
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), F.array_join(sizes.cast("array<string>"), ","), fixed), 256)
        return _let(
            digest,
            lambda d: F.transform(
                a,
                lambda x, i: F.when(i % 2 == r % 2, x).otherwise(
                    F.pmod(x + F.conv(F.substring(d, (F.floor(i / 2) % 8 * 8 + 1).cast("int"), F.lit(8)), 16, 10).cast("long"), F.get(sizes, i))
                ),
            ),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), values, turn)


def _classes(text: Column) -> Column:
    """(value, size, first code) of each character; size 1 for what stays."""
    def kind(c: Column) -> Column:
        code = F.ascii(c).cast("long")
        made = lambda first, size: F.struct((code - first).alias("v"), F.lit(size).cast("long").alias("m"), F.lit(first).cast("long").alias("f"))
        return F.when(c.rlike("^[0-9]$"), made(48, 10)).when(c.rlike("^[a-z]$"), made(97, 26)).when(c.rlike("^[A-Z]$"), made(65, 26))

    return F.filter(F.transform(F.split(text, ""), kind), lambda s: s.isNotNull())


def _permute_text(text: Column, key: str, kind: str) -> Column:
    """Letters and digits of a text permuted within their classes; other characters stay."""
    return _let(
        _classes(text),
        lambda cs: _let(
            F.transform(F.arrays_zip(feistel(F.transform(cs, lambda s: s["v"]), F.transform(cs, lambda s: s["m"]), key, kind).alias("v"), cs.alias("c")), lambda z: F.chr(z["v"] + z["c"]["f"])),
            lambda made: _refill(text, made),
        ),
    )


def _refill(text: Column, made: Column) -> Column:
    """text with its letters and digits replaced by the given ones in order."""
    start = F.struct(F.lit(0).alias("i"), F.lit("").alias("out"))

    def step(a: Column, c: Column) -> Column:
        own = c.rlike("^[0-9A-Za-z]$")
        return F.struct((a["i"] + F.when(own, 1).otherwise(0)).alias("i"), F.concat(a["out"], F.when(own, F.get(made, a["i"])).otherwise(c)).alias("out"))

    return F.aggregate(F.split(text, ""), start, step, lambda a: a["out"])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """Weighted digit sum from the right, the last digit at weight one."""
    n = F.char_length(digits)
    return F.aggregate(
        F.transform(F.split(digits, ""), lambda c, i: _let(c.cast("int") * F.when((n - i) % 2 == 0, 2).otherwise(1), lambda x: F.when(x > 9, x - 9).otherwise(x))),
        F.lit(0), lambda a, x: a + x,
    )


def _card(text: Column, key: str) -> Column:
    """All digits but the last are permuted; the last makes the number valid again."""
    digits = _digits(text)
    size = F.char_length(digits)
    body = _permute_text(F.substring(digits, F.lit(1), size - 1), key, "card")
    whole = _let(body, lambda b: F.concat(b, ((10 - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))
    return _let(F.split(whole, ""), lambda made: _refill(text, made))


def _ip(text: Column, key: str) -> Column:
    parts = F.split(text, r"\.").cast("array<long>")
    return F.array_join(feistel(parts, F.array_repeat(F.lit(256).cast("long"), 4), key, "ip").cast("array<string>"), ".")


def _day(text: Column) -> Column:
    """Day number of a date in one of the three formats; null if it is none in range."""
    iso = F.when(text.rlike("^[0-9]{4}"), text).otherwise(F.concat_ws("-", F.substring(text, 7, 4), F.substring(text, 4, 2), F.substring(text, 1, 2)))
    day = F.date_diff(F.try_to_date(iso, "yyyy-MM-dd"), F.lit(FIRST_DAY).cast("date")).cast("long")
    return F.when((day >= 0) & (day < DAYS), day)


def _date(text: Column, key: str) -> Column:
    """The day number walks through a 271 x 270 Feistel until it is a day of the range again."""
    once = lambda d: _let(feistel(F.array(F.floor(d / 270).cast("long"), d % 270), F.array(F.lit(271).cast("long"), F.lit(270).cast("long")), key, "date"), lambda p: p[0] * 270 + p[1])
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(24)), once(_day(text)), lambda d, _: F.when(d < DAYS, d).otherwise(once(d)))
    def shape(d: Column) -> Column:
        date = F.date_add(F.lit(FIRST_DAY).cast("date"), d.cast("int"))
        return F.when(text.rlike("^[0-9]{4}"), F.date_format(date, "yyyy-MM-dd")).when(text.contains("/"), F.date_format(date, "dd/MM/yyyy")).otherwise(F.date_format(date, "dd.MM.yyyy"))

    return _let(walked, shape)


def kind_of(text: Column) -> Column:
    """Kind of a whole candidate that passes validation, else null."""
    digits = _digits(text)
    valid = {
        "ip": F.forall(F.split(text, r"\."), lambda p: (p.cast("int") < 256) & ((F.char_length(p) == 1) | ~F.startswith(p, F.lit("0")))),
        "date": _day(text).isNotNull(),
        "card": luhn_sum(digits) % 10 == 0,
        "phone": F.char_length(digits).between(9, 15),
    }
    out = F.lit(None).cast("string")
    for kind in reversed(KINDS):
        whole = text.rlike(f"^(?:{PATTERNS[kind]})$")
        out = F.when(F.when(whole, valid.get(kind, F.lit(True))).otherwise(False), F.lit(kind)).otherwise(out)
    return out


def pseudonym(text: Column, kind: Column, key: str) -> Column:
    """A validated value's pseudonym; an e-mail keeps its domain, a telephone number its country code."""
    domain = F.regexp_extract(text, "@.*$", 0)
    country = F.regexp_extract(text, r"^\+\d{1,3}(?=[ .(-])", 0)
    return (
        F.when(kind == "email", F.concat(_permute_text(F.regexp_extract(text, "^[^@]+", 0), key, "email"), domain))
        .when(kind == "ip", _ip(text, key))
        .when(kind == "date", _date(text, key))
        .when(kind == "card", _card(text, key))
        .when(kind == "phone", F.concat(country, _permute_text(F.substring(text, F.char_length(country) + 1, F.lit(64)), key, "phone")))
        .otherwise(_permute_text(text, key, "social"))
    )


#: The key of queries and tests; a caller passes a secret of its own.
DEMO_KEY = "lumenframe demonstration key"
FOUND = "pseudonyms_found"


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """docs with personal values in text replaced, and FOUND: array of (kind, value, pseudonym) in order (empty for none)."""
    text, candidates = F.col("text").cast("string"), "|".join(PATTERNS.values())
    told = F.transform(
        F.regexp_extract_all(text, F.lit(candidates), F.lit(0)),
        lambda v: _let(kind_of(v), lambda k: F.struct(k.alias("kind"), v.alias("value"), F.when(k.isNotNull(), pseudonym(v, k, key)).otherwise(v).alias("pseudonym"))),
    )
    # the parts between the candidates are the text split at them
    filled = lambda values: F.array_join(F.transform(F.split(text, candidates), lambda p, i: F.concat(p, F.coalesce(F.get(values, i)["pseudonym"], F.lit("")))), "")
    made = _let(told, lambda values: F.struct(F.filter(values, lambda t: t["kind"].isNotNull()).alias("found"), filled(values).alias("text")))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != FOUND)).alias("row"), F.when(text.rlike("@|[0-9]"), made).alias("made"))
    empty = F.array().cast("array<struct<kind:string,value:string,pseudonym:string>>")
    new = F.when(F.size("made.found") > 0, F.col("made.text")).otherwise(F.col("row")["text"].cast("string"))
    kept = [new.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c != FOUND]
    return rows.select(*kept, F.coalesce("made.found", empty).alias(FOUND))
