"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations in SQL functions.

A value keeps its format: a card number stays a card number of the same network whose check digit holds,
a date stays a date of its century.  The same value always becomes the same pseudonym, however it is written: what is
permuted is the bare value (a card's or a phone number's digits, an account number without blanks, an address in lower case, the day
of a date), and the writing's separators and capitals are put back.  So records stay
linked across documents, and different values of a format never become the same one.  Who has
the key can turn pseudonyms back (reveal=True).

Everything runs inside the JVM as expressions of one projection: no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_of

ROUNDS = 8

# Patterns of what is looked at; values then have to pass their kind's validation.
_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,10}\.[A-Za-z]{2,24}(?![A-Za-z0-9-])"
_SECRET = r"(?<![A-Za-z0-9])(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9+/_.-]{8,}+"
_CLOUD_KEY = r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"
_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_CARD = r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?<c>[ -])[0-9]{4}\k<c>[0-9]{4}\k<c>[0-9]{1,4}(?:\k<c>[0-9]{1,3})?|3[0-9]{3}(?<x>[ -])[0-9]{6}\k<x>[0-9]{5})(?![0-9A-Za-z])"
_SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
_ISO_DATE = r"(?<![0-9A-Za-z./-])(?:18|19|20|21)[0-9]{2}(?<d>[-/.])(?:0[1-9]|1[0-2])\k<d>(?:0[1-9]|[12][0-9]|3[01])(?![0-9A-Za-z/-]|\.[0-9])"
_DOT_DATE = r"(?<![0-9A-Za-z./-])(?:0[1-9]|[12][0-9]|3[01])\.(?:0[1-9]|1[0-2])\.(?:18|19|20|21)[0-9]{2}(?![0-9A-Za-z/-]|\.[0-9])"
_SLASH_DATE = r"(?<![0-9A-Za-z./-])(?:0[1-9]|1[0-2])/(?:0[1-9]|[12][0-9]|3[01])/(?:18|19|20|21)[0-9]{2}(?![0-9A-Za-z/-]|\.[0-9])"
_IP = r"(?<![0-9A-Za-z.-])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9A-Za-z-]|\.[0-9])"
_PHONE = (
    r"(?:\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}|\+[0-9]{1,3}(?:[ .-]?\([0-9]{1,4}\)|[ .-]?[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}|(?<![0-9A-Za-z])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}"
    r"|(?<![0-9A-Za-z+(.-])[2-9][0-9]{2}(?<p>[-.])[0-9]{3}\k<p>[0-9]{4})(?![0-9A-Za-z])"
)
# the order decides between patterns that could begin at the same place
PATTERN = "|".join([_EMAIL, _SECRET, _CLOUD_KEY, _IBAN, _SSN, _ISO_DATE, _DOT_DATE, _SLASH_DATE, _IP, _CARD, _PHONE])

# Country calling codes of two digits; 1 and 7 stand alone, others have three.
_CALLING = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()

# Alphabets by mask letter; what has another mask letter stays as it is.
_ALPHABETS = {"d": "0123456789", "l": "abcdefghijklmnopqrstuvwxyz", "u": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "h": "0123456789abcdef", "k": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _chars(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def _number(hexadecimal: Column) -> Column:
    return F.conv(hexadecimal, 16, 10).cast("long")


def _rounds(reveal: bool) -> Column:
    return F.array(*[F.lit(r) for r in (reversed(range(ROUNDS)) if reveal else range(ROUNDS))])


def _permute_text(text: Column, mask: Column, kind: str, key: str, reveal: bool) -> Column:
    """Shift the masked characters within their alphabets; every other position keys the rest in turn."""

    def shifted(c: Column, m: Column, pad: Column) -> Column:
        out = F.when(F.lit(False), c)
        for letter, alphabet in _ALPHABETS.items():
            n = len(alphabet)
            at = F.instr(F.lit(alphabet), c) - 1
            to = F.pmod(at - pad if reveal else at + pad, F.lit(n))
            out = out.when(m == letter, F.substr(F.lit(alphabet), (to + 1).cast("int"), F.lit(1)))
        return out.otherwise(c)

    def one_round(chars: Column, r: Column, masks: Column) -> Column:
        rest = F.array_join(F.transform(chars, lambda c, i: F.when(F.pmod(i + r, F.lit(2)) == 0, c).otherwise("")), "\n")
        pads = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), rest), 512)
        return _let(
            pads,
            lambda h: F.transform(
                chars,
                lambda c, i: F.when(F.pmod(i + r, F.lit(2)) == 0, c).otherwise(
                    shifted(c, F.get(masks, i), _number(F.substr(h, (F.pmod(i * 4, F.lit(128)) + 1).cast("int"), F.lit(4))))
                ),
            ),
        )

    return _let(_chars(mask), lambda masks: F.array_join(F.aggregate(_rounds(reveal), _chars(text), lambda acc, r: one_round(acc, r, masks)), ""))


def _refill(value: Column, bare: Column, separators: str) -> Column:
    """value with its characters, other than those that match separators, replaced by those of bare in order."""
    before = lambda i: F.length(F.regexp_replace(F.substr(value, F.lit(1), i + 1), separators, ""))
    return F.array_join(F.transform(_chars(value), lambda c, i: F.when(c.rlike(separators), c).otherwise(F.substr(bare, before(i), F.lit(1)))), "")


def _permute_pair(left: Column, right: Column, a: Column, b: Column, kind: str, key: str, reveal: bool) -> Column:
    """struct(l, r) with l in 0..a-1 and r in 0..b-1, permuted by modular additions in turn."""

    def pad(r: Column, other: Column) -> Column:
        return _number(F.substr(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), other.cast("string")), 256), F.lit(1), F.lit(12)))

    def step(acc: Column, r: Column) -> Column:
        even = F.pmod(r, F.lit(2)) == 0
        sign = -1 if reveal else 1
        return F.struct(
            F.when(even, F.pmod(acc["l"] + sign * pad(r, acc["r"]), a)).otherwise(acc["l"]).alias("l"),
            F.when(even, acc["r"]).otherwise(F.pmod(acc["r"] + sign * pad(r, acc["l"]), b)).alias("r"),
        )

    return F.aggregate(_rounds(reveal), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """Sum of digits counted from the right, those at even (doubled=0) or odd (1) places doubled."""
    return F.aggregate(
        F.reverse(_chars(digits)),
        F.struct(F.lit(0).alias("s"), F.lit(0).alias("i")),
        lambda acc, c: F.struct(
            (acc["s"] + _let(c.cast("int") * F.when(F.pmod(acc["i"], F.lit(2)) == doubled, 2).otherwise(1), lambda d: F.when(d > 9, d - 9).otherwise(d))).alias("s"),
            (acc["i"] + 1).alias("i"),
        ),
        lambda acc: acc["s"],
    )


def _mod97(text: Column) -> Column:
    """The number that digits, and letters as 10 to 35, spell, modulo 97."""
    return F.aggregate(
        _chars(text),
        F.lit(0),
        lambda acc, c: F.when(c.between("0", "9"), F.pmod(acc * 10 + c.cast("int"), F.lit(97))).otherwise(F.pmod(acc * 100 + F.ascii(c) - 55, F.lit(97))),
    )


def _date(value: Column, year: Column, month: Column, day: Column, write: Callable[[Column], Column], key: str, reveal: bool) -> Column:
    """Permute the days of the value's century: 36,525 where its first year is a leap year, else 36,524."""
    date = F.try_to_date(F.concat_ws("-", year, month, day), "yyyy-MM-dd")
    first = F.substr(year, F.lit(1), F.lit(2))
    long_ = F.pmod(first.cast("int"), F.lit(4)) == 0
    a, b = F.when(long_, 75).otherwise(92), F.when(long_, 487).otherwise(397)
    start = F.to_date(F.concat(first, F.lit("00-01-01")))
    moved = _let(F.datediff(date, start), lambda n: _permute_pair(F.floor(n / b), F.pmod(n, b), a, b, "date", key, reveal))
    return F.when(date.isNull(), value).otherwise(write(_let(moved, lambda p: F.date_add(start, (p["l"] * b + p["r"]).cast("int")))))


def pseudonym(value: Column, key: str, reveal: bool = False) -> Column:
    """What stands in the text for one match of PATTERN; the value itself if it isn't valid."""
    part = lambda k, n: F.substr(value, F.lit(k), F.lit(n))
    whole = lambda p: value.rlike(f"^(?:{p})$")
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]", "l"), "[A-Z]", "u"), "[0-9]", "d"), "[^lud]", "x")

    # an address keeps its domain and, place by place, its capitals
    at = F.instr(value, "@")
    local = F.substr(value, F.lit(1), at - 1)
    moved = _permute_text(F.lower(local), F.translate(F.substr(classes, F.lit(1), at - 1), "u", "l"), "email", key, reveal)
    capitals = F.zip_with(_chars(local), _chars(moved), lambda c, m: F.when(c.between("A", "Z"), F.upper(m)).otherwise(m))
    email = F.concat(F.array_join(capitals, ""), F.substr(value, at))

    # a secret keeps its label; hexadecimal stays hexadecimal
    label = F.regexp_extract(value, r"^[A-Za-z_-]+[\"']?\s{0,3}[=:]\s{0,3}[\"']?", 0)
    body = F.substr(value, F.length(label) + 1)
    hidden = F.when(body.rlike("^[0-9a-f]+$"), F.repeat(F.lit("h"), F.length(body))).otherwise(F.substr(classes, F.length(label) + 1))
    secret = F.concat(label, _permute_text(body, hidden, "secret", key, reveal))
    cloud = F.concat(part(1, 4), _permute_text(part(5, 16), F.lit("k" * 16), "cloud", key, reveal))

    # a card keeps its first digit (the network); its last is the check digit
    digits = F.regexp_replace(value, "[^0-9]", "")
    last = F.length(digits)
    moved = _permute_text(F.substr(digits, F.lit(2), last - 2), F.repeat(F.lit("d"), last - 2), "card", key, reveal)
    made = _let(F.concat(F.substr(digits, F.lit(1), F.lit(1)), moved), lambda v: F.concat(v, F.pmod(-_luhn_sum(v, 0), F.lit(10)).cast("string")))
    card = _let(made, lambda m: _refill(value, m, "[^0-9]"))

    # an account number keeps its country; the check digits follow from the rest
    packed = F.regexp_replace(value, " ", "")
    account_ok = _mod97(F.concat(F.substr(packed, F.lit(5)), F.substr(packed, F.lit(1), F.lit(4)))) == 1
    moved = _permute_text(F.substr(packed, F.lit(5)), F.regexp_replace(F.regexp_replace(F.substr(packed, F.lit(5)), "[A-Z]", "u"), "[0-9]", "d"), "account", key, reveal)
    made = _let(moved, lambda m: F.concat(part(1, 2), F.lpad((98 - _mod97(F.concat(m, part(1, 2), F.lit("00")))).cast("string"), 2, "0"), m))
    account = _let(made, lambda m: _refill(value, m, " "))

    # a social security number: 898 areas (not 000, 666, 900 and up), 99 groups, 9,999 serials
    area, group, serial = part(1, 3).cast("int"), part(5, 2).cast("int"), part(8, 4).cast("int")
    ssn_ok = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    left = F.when(area > 666, area - 2).otherwise(area - 1) * 99 + group - 1
    pair = _permute_pair(left, serial - 1, F.lit(898 * 99), F.lit(9999), "ssn", key, reveal)
    ssn = _let(
        pair,
        lambda p: _let(
            F.floor(p["l"] / 99).cast("int"),
            lambda n: F.concat_ws(
                "-",
                F.lpad(F.when(n >= 665, n + 2).otherwise(n + 1).cast("string"), 3, "0"),
                F.lpad((F.pmod(p["l"], F.lit(99)) + 1).cast("string"), 2, "0"),
                F.lpad((p["r"] + 1).cast("string"), 4, "0"),
            ),
        ),
    )

    separator = part(5, 1)
    iso = _date(value, part(1, 4), part(6, 2), part(9, 2), lambda d: F.concat_ws("", F.date_format(d, "yyyy"), separator, F.date_format(d, "MM"), separator, F.date_format(d, "dd")), key, reveal)
    dotted = _date(value, part(7, 4), part(4, 2), part(1, 2), lambda d: F.date_format(d, "dd.MM.yyyy"), key, reveal)
    slashed = _date(value, part(7, 4), part(1, 2), part(4, 2), lambda d: F.date_format(d, "MM/dd/yyyy"), key, reveal)

    ip = _let(
        F.transform(F.split(value, r"\."), lambda x: x.cast("long")),
        lambda q: _let(
            _permute_pair(q[0] * 256 + q[1], q[2] * 256 + q[3], F.lit(65536), F.lit(65536), "ip", key, reveal),
            lambda p: F.concat_ws(
                ".", *[x.cast("string") for h in ("l", "r") for x in (F.floor(p[h] / 256), F.pmod(p[h], F.lit(256)))]
            ),
        ),
    )

    # a phone number keeps its country code and the digit after it; without a plus it is a national number of country code 1
    code = F.when(~value.startswith("+"), 0).when(digits.rlike("^[17]"), 1).when(digits.rlike("^(?:" + "|".join(_CALLING) + ")"), 2).otherwise(3)
    rest = F.substr(digits, code + 2)
    made = F.concat(F.substr(digits, F.lit(1), code + 1), _permute_text(rest, F.repeat(F.lit("d"), F.length(rest)), "phone", key, reveal))
    phone = _let(made, lambda m: _refill(value, m, "[^0-9]"))
    count = F.length(digits)

    return (
        F.when(whole(_EMAIL), email)
        .when(whole(_SECRET), secret)
        .when(whole(_CLOUD_KEY), cloud)
        .when(whole(_IBAN), F.when(account_ok, account).otherwise(value))
        .when(whole(_SSN), F.when(ssn_ok, ssn).otherwise(value))
        .when(whole(_ISO_DATE), iso)
        .when(whole(_DOT_DATE), dotted)
        .when(whole(_SLASH_DATE), slashed)
        .when(whole(_IP), ip)
        .when(whole(_CARD), F.when(F.pmod(_luhn_sum(digits, 1), F.lit(10)) == 0, card).otherwise(value))
        .when(count.between(8, 15), phone)
        .otherwise(value)
    )


def pseudonymise(docs: DataFrame, key: str, text: str = "text", doc_id: str = "doc_id", reveal: bool = False) -> DataFrame:
    """One row per document: doc_id, text with pseudonyms, n_values (how many were replaced).

    Handled: mail addresses (local part), labelled secrets and cloud keys, account numbers (IBAN check), social
    security numbers, dates of 1800 to 2199, IPv4 addresses, card numbers (Luhn check), phone numbers.  A
    value that fails its check stays.  Null text becomes empty.  Rows, repeated ones too, are kept one to one;
    other columns are ignored.
    """
    body = text_of(text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), body.alias("body"), F.regexp_extract_all(body, F.lit(PATTERN), F.lit(0)).alias("found"))
    rows = rows.withColumn("put", F.when(F.size("found") > 0, F.transform("found", lambda v: pseudonym(v, key, reveal))))
    gaps = F.split("body", PATTERN, -1)
    joined = F.array_join(F.zip_with(gaps, F.col("put"), lambda g, v: F.concat(g, F.coalesce(v, F.lit("")))), "")
    changed = F.size(F.filter(F.zip_with("found", "put", lambda a, b: a != b), lambda x: x)).cast("long")
    return rows.select(
        "doc_id",
        F.when(F.col("put").isNull(), F.col("body")).otherwise(joined).alias("text"),
        F.when(F.col("put").isNull(), F.lit(0).cast("long")).otherwise(changed).alias("n_values"),
    )
