"""PII: format-preserving Feistel pseudonyms, in SQL functions only.

Numbers and dates are found by one pattern and validated by their own rules:
card numbers by length and Luhn, US social security numbers by their blocks,
phone numbers by the numbering plan, IPv4 addresses by octet, IBANs by mod 97,
dates by the calendar; mail addresses, and values named as passwords, tokens or
keys, are treated like numbers. Each becomes another valid value of its format by
a Feistel network whose round function is SHA-256 under a key, a permutation: one
value has one pseudonym in all documents and two values never share one.

The halves of a string are shifted in turn, digits to digits and letters to
letters, by a hash of the other half; check digits are computed anew. Addresses
and social security numbers are two numbers added to in turn, within their
ranges; so are the days of 1900 to 2099, of which a date outside is not taken.

Defined cases: a null text stays null with no value found; an empty text stays;
what fails validation stays as it is; equal rows get equal results; an empty
table gives an empty result; other columns are not read. Narrow: no shuffle. A very
long text is searched whole, in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The session's setting that holds a deployment's key; without it, pseudonyms are under a key that anyone can read here.
KEY_SETTING, KEY = "spark.rasterlake.pii.key", "no key is set"
ROUNDS = 4

#: The formats that are looked for, the first that matches at a place wins.
FORMATS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "secret": r"(?<![A-Za-z0-9])(?:[Pp]assword|[Pp]asswd|[Tt]oken|[Ss]ecret|[Aa]pi[_-]?[Kk]ey)\s{0,3}[:=]\s{0,3}[\"']?[A-Za-z0-9+/_=-]{8,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![0-9./-])(?:(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])|(?:0[1-9]|[12][0-9]|3[01])\.(?:0[1-9]|1[0-2])\.(?:19|20)[0-9]{2}|(?:0[1-9]|1[0-2])/(?:0[1-9]|[12][0-9]|3[01])/(?:19|20)[0-9]{2})(?![0-9/-])",
    "ipv4": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+])(?:\+1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9])",
    "card": r"(?<![0-9-])[1-9][0-9]{3}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9-])",
}
PATTERN = "|".join(f"(?:{p})" for p in FORMATS.values())
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Days of 1900-01-01 to 2099-12-31, as numbers a * 277 + b; the last row is short.
FIRST_DAY, DAYS, DAY_ROW = "1900-01-01", 73049, 277


def _hash(key: str, round_: Column, value: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{key}|"), round_.cast("string"), F.lit("|"), value).cast("binary"), 256)


def _number(hex_digits: Column) -> Column:
    return F.conv(F.substring(hex_digits, 1, 12), 16, 10).cast("long")


def _shift(text: Column, stream: Column) -> Column:
    """Each digit and letter moved within its class by the stream's bytes."""

    def move(c: Column, k: Column) -> Column:
        step = F.conv(F.substr(stream, (k % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")

        def within(alphabet: str) -> Column:
            return F.substr(F.lit(alphabet), (F.position(c, F.lit(alphabet)) - 1 + step) % len(alphabet) + 1, F.lit(1))

        return F.when(c.rlike("^[0-9]$"), within(DIGITS)).when(c.rlike("^[a-z]$"), within(LOWER)).when(c.rlike("^[A-Z]$"), within(UPPER)).otherwise(c)

    return F.when(F.length(text) == 0, text).otherwise(F.array_join(F.transform(F.split(text, ""), move), ""))


def feistel_text(text: Column, key: str) -> Column:
    """A permutation of strings of one shape (where digits, small and capital letters stand)."""
    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), half).alias("l"), F.substr(text, half + 1, F.length(text)).alias("r"))

    def turn(s: Column, i: Column) -> Column:
        left = _shift(s["l"], _hash(key, i * 2, s["r"]))
        # the right half's turn hashes the new left half, which is named once so that it is computed once
        pair = F.transform(F.array(left), lambda new: F.struct(new.alias("l"), _shift(s["r"], _hash(key, i * 2 + 1, new)).alias("r")))
        return F.element_at(pair, 1)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: F.concat(s["l"], s["r"]))


def feistel_pair(left: Column, right: Column, a: int, b: int, key: str, finish) -> Column:
    """A permutation of pairs of numbers below a and b."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def turn(s: Column, i: Column) -> Column:
        new = (s["l"] + _number(_hash(key, i * 2, s["r"].cast("string")))) % a
        pair = F.transform(F.array(new), lambda x: F.struct(x.alias("l"), ((s["r"] + _number(_hash(key, i * 2 + 1, x.cast("string")))) % b).alias("r")))
        return F.element_at(pair, 1)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, finish)


def _only_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn_sum(digits: Column, doubled: int) -> Column:
    """Luhn sum of digits; every second from the right is doubled, from place ``doubled`` (0 or 1)."""
    places = F.transform(F.reverse(F.split(digits, "")), lambda c, k: F.when(k % 2 == doubled, (c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10).cast("int")).otherwise(c.cast("int")))
    return F.aggregate(places, F.lit(0), lambda x, y: x + y)


def refilled(text: Column, digits: Column) -> Column:
    """``text`` with its digits replaced in order; what stands between them stays."""
    step = F.aggregate(F.split(text, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), lambda s, c: F.struct(F.concat(s["out"], F.when(c.rlike("^[0-9]$"), F.substr(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"), (s["at"] + F.when(c.rlike("^[0-9]$"), 1).otherwise(0)).alias("at")))
    return step["out"]


def _card(m: Column, key: str) -> Column:
    digits = _only_digits(m)
    n = F.length(digits)
    body = F.concat(F.substr(digits, F.lit(1), F.lit(1)), feistel_text(F.substr(digits, F.lit(2), n - 2), key))
    whole = F.concat(body, ((10 - luhn_sum(body, 0) % 10) % 10).cast("string"))
    return F.when(n.between(13, 19) & (luhn_sum(digits, 1) % 10 == 0), refilled(m, whole))


def _phone(m: Column, key: str) -> Column:
    digits = _only_digits(m)
    lead = F.length(digits) - 10
    area, exchange = F.substr(digits, lead + 1, F.lit(1)), F.substr(digits, lead + 4, F.lit(1))
    free = feistel_text(F.concat(F.substr(digits, lead + 2, F.lit(2)), F.substr(digits, lead + 5, F.lit(6))), key)
    return refilled(m, F.concat(F.substr(digits, F.lit(1), lead), area, F.substr(free, F.lit(1), F.lit(2)), exchange, F.substr(free, F.lit(3), F.lit(6))))


def _ipv4(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    o = lambda k: F.element_at(octets, k)
    text = lambda s: F.concat_ws(".", *(F.shiftright(s[half], bits).bitwiseAND(F.lit(255)).cast("string") for half in "lr" for bits in (8, 0)))
    return F.when(F.forall(octets, lambda x: x <= 255), feistel_pair(o(1) * 256 + o(2), o(3) * 256 + o(4), 65536, 65536, key, text))


def _ssn(m: Column, key: str) -> Column:
    """Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999."""
    area, group, serial = (F.split_part(m, F.lit("-"), F.lit(k)).cast("int") for k in (1, 2, 3))

    def text(s: Column) -> Column:
        a = s["l"] + 1 + F.when(s["l"] >= 665, 1).otherwise(0)
        return F.concat_ws("-", F.lpad(a.cast("string"), 3, "0"), F.lpad((F.floor(s["r"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((s["r"] % 9999 + 1).cast("string"), 4, "0"))

    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    index = area - 1 - F.when(area > 666, 1).otherwise(0)
    return F.when(valid, feistel_pair(index, (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, text))


def _mod97(text: Column) -> Column:
    """Remainder of an IBAN's digits, letters counting 10 to 35."""
    moved = F.concat(F.substr(text, F.lit(5), F.length(text)), F.substr(text, F.lit(1), F.lit(4)))
    value = lambda c: F.when(c.rlike("^[0-9]$"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda r, c: (r * F.when(c.rlike("^[0-9]$"), 10).otherwise(100) + value(c)) % 97)


def _iban(m: Column, key: str) -> Column:
    plain = F.replace(m, F.lit(" "), F.lit(""))
    body = feistel_text(F.substr(plain, F.lit(5), F.length(plain)), key)
    check = F.lpad((98 - _mod97(F.concat(F.substr(plain, F.lit(1), F.lit(2)), F.lit("00"), body))).cast("string"), 2, "0")
    whole = F.concat(F.substr(plain, F.lit(1), F.lit(2)), check, body)
    spaced = F.aggregate(F.split(m, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), lambda s, c: F.struct(F.concat(s["out"], F.when(c == " ", c).otherwise(F.substr(whole, s["at"], F.lit(1)))).alias("out"), (s["at"] + F.when(c == " ", 0).otherwise(1)).alias("at")))["out"]
    return F.when(F.length(plain).between(15, 34) & (_mod97(plain) == 1), spaced)


def _date(m: Column, key: str) -> Column:
    """Days permuted by walking the cycle of a permutation of a few more numbers until a day comes."""
    shape = F.when(m.contains("-"), "yyyy-MM-dd").when(m.contains("."), "dd.MM.yyyy").otherwise("MM/dd/yyyy")
    year = F.when(m.contains("-"), F.substr(m, F.lit(1), F.lit(4))).otherwise(F.substr(m, F.lit(7), F.lit(4)))
    month = F.when(m.contains("-"), F.substr(m, F.lit(6), F.lit(2))).when(m.contains("."), F.substr(m, F.lit(4), F.lit(2))).otherwise(F.substr(m, F.lit(1), F.lit(2)))
    day = F.when(m.contains("-"), F.substr(m, F.lit(9), F.lit(2))).when(m.contains("."), F.substr(m, F.lit(1), F.lit(2))).otherwise(F.substr(m, F.lit(4), F.lit(2)))
    found = F.concat_ws("-", year, month, day).try_cast("date")
    number = F.date_diff(found, F.lit(FIRST_DAY).cast("date"))
    rows = -(-DAYS // DAY_ROW)
    once = lambda x: feistel_pair(F.floor(x / DAY_ROW), x % DAY_ROW, rows, DAY_ROW, key, lambda s: s["l"] * DAY_ROW + s["r"])
    # rows * DAY_ROW - DAYS numbers are no day, so no walk over them is longer than that many steps and one
    extra = rows * DAY_ROW - DAYS
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(extra)), once(number.cast("long")), lambda v, _: F.when(v >= DAYS, once(v)).otherwise(v))
    made = F.date_add(F.lit(FIRST_DAY).cast("date"), walked.cast("int"))
    y, mo, da = (F.date_format(made, p) for p in ("yyyy", "MM", "dd"))
    text = F.when(shape == "yyyy-MM-dd", F.concat_ws("-", y, mo, da)).when(shape == "dd.MM.yyyy", F.concat_ws(".", da, mo, y)).otherwise(F.concat_ws("/", mo, da, y))
    return F.when(found.isNotNull() & number.between(0, DAYS - 1), text)


def _email(m: Column, key: str) -> Column:
    return F.concat(feistel_text(F.split_part(m, F.lit("@"), F.lit(1)), key), F.lit("@"), F.split_part(m, F.lit("@"), F.lit(-1)))


def _secret(m: Column, key: str) -> Column:
    name = F.regexp_extract(m, r"^(\w+[-_]?\w*\s*[:=]\s*[\"']?)", 1)
    return F.concat(name, feistel_text(F.substr(m, F.length(name) + 1, F.length(m)), key))


MAKERS = {"email": _email, "secret": _secret, "iban": _iban, "date": _date, "ipv4": _ipv4, "ssn": _ssn, "phone": _phone, "card": _card}


def pseudonym(match: Column, key: str = KEY) -> Column:
    """(kind, value) of a match of ``PATTERN``; a null kind if it is not valid."""
    chosen = None
    for kind, pattern in FORMATS.items():
        here = match.rlike(f"^(?:{pattern})$")
        made = MAKERS[kind](match, f"{key}|{kind}")
        chosen = F.when(here, F.struct(F.when(made.isNotNull(), F.lit(kind)).alias("kind"), made.alias("value"))) if chosen is None else chosen.when(here, F.struct(F.when(made.isNotNull(), F.lit(kind)).alias("kind"), made.alias("value")))
    return chosen


def pseudonymise(docs: DataFrame, key: str = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_values, kinds) of every document."""
    only = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    matches = F.when(F.col("text").rlike(PATTERN), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)))
    found = only.withColumn("matches", matches)
    replaced = found.withColumn("made", F.transform("matches", lambda m: pseudonym(m, key)))
    new = F.zip_with("matches", "made", lambda m, p: F.coalesce(p["value"], m))
    gaps = F.split("text", PATTERN, -1)
    text = F.array_join(F.flatten(F.zip_with(gaps, new, lambda g, n: F.array(g, F.coalesce(n, F.lit(""))))), "")
    kinds = F.filter(F.transform("made", lambda p: p["kind"]), lambda k: k.isNotNull())
    none = F.array().cast("array<string>")
    return replaced.select("doc_id", F.when(F.col("matches").isNull(), F.col("text")).otherwise(text).alias("text"), F.coalesce(F.size(kinds), F.lit(0)).cast("long").alias("n_values"), F.coalesce(F.array_sort(F.array_distinct(kinds)), none).alias("kinds"))
