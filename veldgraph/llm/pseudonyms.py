"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

One pattern finds candidates of all kinds; each is validated (check digits, calendar,
number ranges) and a valid one is replaced by a keyed permutation of itself within
its format, so the pseudonym validates by the same rule and equal values get equal
pseudonyms in all documents. The permutation is an alternating Feistel network: in
each round one half is shifted, character by character within its class or as a
number within its range, by an HMAC-SHA-256 of kind, round and the other half. It is a
bijection of every format, so different values never meet and the holder of the key
can undo it. A value's separators have no part in it: a number gets one pseudonym in
all its spellings, and a day one in all forms of dates.

The key is in the query's plan. Set ``spark.redaction.string.regex`` to a pattern that
matches ``KEY_MARK`` and what follows it to keep it out of the UI and of event logs.

====== =============================== ================================================
kind   valid if                        what is permuted
====== =============================== ================================================
email  the pattern matches             letters and digits of the local part
iban   check digits (mod 97) are right letters and digits after them; they are recomputed
ip     four numbers up to 255          both halves of the address
date   in the calendar, 1900 to 2099   the day within its century, days of the month up to 12 and later ones apart
ssn    no field is reserved            area, and group with serial
phone  8 to 15 digits after ``+``      the digits after the country code, but for a trunk zero in brackets
card   the Luhn digit is right         the digits between the first and the last; that is recomputed
====== =============================== ================================================

Nulls, empty and repeated rows: a null text stays null and has no counts but zeros;
an empty one stays empty. Rows stand for themselves. Texts are treated whole, in
time linear in their length. Other columns are kept by ``pseudonymised``.
"""

from __future__ import annotations

import calendar
import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "iban", "ip", "date", "ssn", "phone", "card")
EMAIL = r"(?<![A-Za-z0-9])[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9_%+-])?@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])"
DATE = r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![./-]?[0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?!-?[0-9])"
def _phone_tail(n: int) -> str:
    """The digits after the first ``n`` of a number of 8 to 15, each with at most one separator before it. A last group of one digit is taken only if no longer one ends the number."""
    return rf"(?:(?:[ .-]?[0-9]){{{7 - n},{14 - n}}}[0-9]|(?:[ .-]?[0-9]){{{8 - n},{15 - n}}})"


_AREAS = "|".join(rf"[0-9]{{{c}}}[ .-]?\([0-9]{{{a}}}\){_phone_tail(c + a)}" for c in (1, 2, 3) for a in (1, 2, 3, 4))
PHONE = rf"(?<![0-9+])\+(?:[0-9]{_phone_tail(1)}|{_AREAS})(?![0-9])"
CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])"
PATTERNS = dict(zip(KINDS, (EMAIL, IBAN, IP, DATE, SSN, PHONE, CARD), strict=True))
ANY = "|".join(PATTERNS.values())
#: A cheap test that every candidate passes: a phone number by its start, an IBAN by its country and check digits, an address by its dots, an email by its sign and the others by three digits in a row.
HINT = r"[0-9]{3}|@|[0-9]\.[0-9]|\+[0-9]|[A-Z]{2}[0-9]{2}"
ROUNDS = 8
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The days after the 12th of all months of 1900-1999 and 2000-2099 as products, for a permutation of each century.
CENTURIES = ((1900, 4, 5531), (2000, 125, 177))
#: Calling codes of one and two digits; all others have three.
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98")
#: Stands before the key in a plan's literals.
KEY_MARK = "pseudonym-key:"
#: Days after the 12th before each month of four years, the first of them a leap year.
LATE_DAYS = [sum(calendar.monthrange(2000 + m // 12, m % 12 + 1)[1] - 12 for m in range(n)) for n in range(48)]


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def _digest(key: str, kind: str, turn: Column, other: Column) -> Column:
    """HMAC-SHA-256 in hexadecimal digits."""
    own = key.encode() if len(key.encode()) <= 64 else hashlib.sha256(key.encode()).digest()
    pad = lambda by: F.unhex(F.substring(F.lit(KEY_MARK + bytes(c ^ by for c in own.ljust(64, b"\0")).hex()), len(KEY_MARK) + 1, 128))
    inner = F.sha2(F.concat(pad(0x36), F.encode(F.concat_ws("|", F.lit(kind), turn, other), "UTF-8")), 256)
    return F.sha2(F.concat(pad(0x5C), F.unhex(inner)), 256)


def _shifted(half: Column, digest: Column) -> Column:
    """Every digit and ASCII letter moved within its class; other characters stay."""

    def moved(c: Column, j: Column) -> Column:
        by = F.conv(F.substring(digest, (j % 15) * 4 + 1, 4), 16, 10).cast("int")
        letter = lambda alphabet: F.substring(F.lit(alphabet), (F.instr(F.lit(alphabet), c) - 1 + by) % 26 + 1, F.lit(1))
        return F.when(c.rlike("^[0-9]$"), ((c.cast("int") + by) % 10).cast("string")).when(c.rlike("^[a-z]$"), letter(LOWER)).when(c.rlike("^[A-Z]$"), letter(UPPER)).otherwise(c)

    return F.array_join(F.transform(F.split(half, ""), moved), "")


def permuted_text(text: Column, key: str, kind: str, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of the strings with the same classes of characters."""
    cut = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), cut).alias("l"), F.substring(text, cut + 1, F.length(text)).alias("r"))
    step = lambda s, i: F.when(
        i % 2 == 1, F.struct(_shifted(s["l"], _digest(key, kind, i, s["r"])).alias("l"), s["r"].alias("r"))
    ).otherwise(F.struct(s["l"].alias("l"), _shifted(s["r"], _digest(key, kind, i, s["l"])).alias("r")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, lambda s: F.concat(s["l"], s["r"]))


def permuted_pair(left: Column, right: Column, a: int, b: int, key: str, kind: str, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of the pairs (l, r) with 0 <= l < a and 0 <= r < b, as a struct."""
    value = lambda digest, most: F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % most
    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))
    step = lambda s, i: F.when(
        i % 2 == 1, F.struct(((s["l"] + value(_digest(key, kind, i, s["r"]), a)) % a).alias("l"), s["r"].alias("r"))
    ).otherwise(F.struct(s["l"].alias("l"), ((s["r"] + value(_digest(key, kind, i, s["l"]), b)) % b).alias("r")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)


def _laid(chars: Column, like: Column, kept: str) -> Column:
    """``chars`` put in the places of the characters of ``like`` that the class ``kept`` has; the others stay."""
    at = lambda i: F.length(F.regexp_replace(F.substring(like, F.lit(1), i + 1), f"[^{kept}]", ""))
    return F.array_join(F.transform(F.split(like, ""), lambda c, i: F.when(c.rlike(f"^[{kept}]$"), F.substring(chars, at(i), F.lit(1))).otherwise(c)), "")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits, the last one counted once."""
    doubled = F.array(*[F.lit(2 * d if d < 5 else 2 * d - 9) for d in range(10)])
    value = lambda c, i: F.when(i % 2 == 1, F.get(doubled, c.cast("int"))).otherwise(c.cast("int"))
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda s, x: s + x)


def iban_rest(compact: Column) -> Column:
    """The account with its first four characters last, letters as numbers from 10, modulo 97."""
    turned = F.concat(F.substring(compact, F.lit(5), F.length(compact)), F.substring(compact, 1, 4))
    number = lambda c: F.when(c.rlike("^[0-9]$"), c.cast("int")).otherwise(F.instr(F.lit(UPPER), c) + 9)
    step = lambda s, c: F.pmod(s * F.when(c.rlike("^[0-9]$"), 10).otherwise(100) + number(c), F.lit(97))
    return F.aggregate(F.split(turned, ""), F.lit(0), step)


def _email(m: Column, key: str) -> Column:
    at = F.instr(m, "@")
    return F.concat(permuted_text(F.substring(m, F.lit(1), at - 1), key, "email"), F.substring(m, at, F.length(m)))


def _iban(m: Column, key: str) -> Column:
    compact = F.replace(m, F.lit(" "), F.lit(""))
    country, body = F.substring(compact, 1, 2), permuted_text(F.substring(compact, F.lit(5), F.length(compact)), key, "iban")
    checked = lambda b: F.concat(country, F.lpad((98 - iban_rest(F.concat(country, F.lit("00"), b))).cast("string"), 2, "0"), b)
    valid = (F.length(compact) >= 15) & (F.length(compact) <= 34) & (iban_rest(compact) == 1)
    return F.when(valid, _laid(_let(body, checked), m, "A-Z0-9"))


def _ip(m: Column, key: str) -> Column:
    part = lambda i: F.get(F.split(m, r"\."), F.lit(i)).cast("int")
    out = permuted_pair(part(0) * 256 + part(1), part(2) * 256 + part(3), 65536, 65536, key, "ip")
    text = lambda p: F.concat_ws(".", *[x.cast("string") for x in (F.floor(p["l"] / 256), p["l"] % 256, F.floor(p["r"] / 256), p["r"] % 256)])
    return F.when(F.forall(F.split(m, r"\."), lambda x: x.cast("int") <= 255), _let(out, text))


def _in_century(day: Column, first: int, a: int, b: int, key: str) -> Column:
    """Another day of the century whose day of the month is up to 12 if the day's is, and after the 12th if it is not."""
    month, dom = (F.year(day) - first) * 12 + F.month(day) - 1, F.dayofmonth(day)
    made = lambda m, d: F.make_date(F.lit(first) + F.floor(m / 12).cast("int"), F.pmod(m, F.lit(12)).cast("int") + 1, d.cast("int"))
    early = _let(permuted_pair(month, dom - 1, 1200, 12, key, f"early{first}"), lambda p: made(p["l"].cast("int"), p["r"] + 1))
    before = F.array(*[F.lit(n) for n in LATE_DAYS])
    whole = 4 * 365 + 1 - 48 * 12

    def late(n: Column) -> Column:
        # 1900 had no 29 February, the 36th such day of its century.
        n = n + F.when(n >= 35, 1).otherwise(0) if first == 1900 else n
        rest = F.pmod(n, F.lit(whole)).cast("int")
        m = F.size(F.filter(before, lambda x: x <= rest)) - 1
        return made((F.floor(n / whole) * 48).cast("int") + m, rest - F.get(before, m) + 13)

    n = F.datediff(day, F.lit(f"{first}-01-01").cast("date")) - 12 * (month + 1)
    moved = permuted_pair(F.floor(n / b), F.pmod(n, F.lit(b)), a, b, key, f"late{first}")
    return F.when(dom <= 12, early).otherwise(_let(_let(moved, lambda p: p["l"] * b + p["r"]), late))


def _date(m: Column, key: str) -> Column:
    # The middle number of a date with strokes is the month unless it can't be. A day after the 12th stays one, so its form can be told again.
    day_last = lambda form: F.when(form == "MM/dd/yyyy", F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 1, 2), F.substring(m, 4, 2))).otherwise(
        F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2))
    )
    year_first = F.concat_ws("-", F.substring(m, 1, 4), F.substring(m, 6, 2), F.substring(m, 9, 2))
    form = F.when(m.rlike("^[0-9]{4}-"), "yyyy-MM-dd").when(m.rlike("^[0-9]{4}/"), "yyyy/MM/dd").when(m.rlike(r"\."), "dd.MM.yyyy").when(F.substring(m, 4, 2).cast("int") > 12, "MM/dd/yyyy").otherwise("dd/MM/yyyy")
    day = F.try_to_date(F.when(form.startswith("yyyy"), year_first).otherwise(day_last(form)), "yyyy-MM-dd")

    def moved(d: Column) -> Column:
        out = F.lit(None).cast("date")
        for first, a, b in CENTURIES:
            out = F.when((F.year(d) >= first) & (F.year(d) < first + 100), _in_century(d, first, a, b, key)).otherwise(out)
        return out

    def written(d: Column) -> Column:
        y, mo, dd = (F.date_format(d, x) for x in ("yyyy", "MM", "dd"))
        strokes = F.when(F.substring(m, 4, 2).cast("int") > 12, F.concat_ws("/", mo, dd, y)).otherwise(F.concat_ws("/", dd, mo, y))
        text = F.when(m.rlike("^[0-9]{4}-"), F.concat_ws("-", y, mo, dd)).when(m.rlike("^[0-9]{4}/"), F.concat_ws("/", y, mo, dd)).when(m.rlike(r"\."), F.concat_ws(".", dd, mo, y)).otherwise(strokes)
        return F.when(d.isNotNull(), text)

    return _let(_let(day, moved), written)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = F.substring(m, 1, 3).cast("int"), F.substring(m, 5, 2).cast("int"), F.substring(m, 8, 4).cast("int")
    # Areas 001 to 899 without 666 are numbered from 0; groups and serials start at 1.
    pair = permuted_pair(area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn")
    text = lambda p: F.concat_ws(
        "-", F.lpad((p["l"] + F.when(p["l"] >= 665, 2).otherwise(1)).cast("string"), 3, "0"), F.lpad((F.floor(p["r"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((p["r"] % 9999 + 1).cast("string"), 4, "0")
    )
    return F.when((area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0), _let(pair, text))


def _phone(m: Column, key: str) -> Column:
    plain = F.replace(m, F.lit("(0)"), F.lit("(_)"))
    digits = F.regexp_replace(plain, "[^0-9]", "")
    n = F.length(F.regexp_replace(m, "[^0-9]", ""))

    def moved(d: Column) -> Column:
        code = F.regexp_extract(d, f"^(?:{'|'.join(CALLING)}|[0-9]{{3}})", 0)
        return F.concat(code, permuted_text(F.substring(d, F.length(code) + 1, F.length(d)), key, "phone"))

    return F.when((n >= 8) & (n <= 15), F.replace(_let(_let(digits, moved), lambda d: _laid(d, plain, "0-9")), F.lit("(_)"), F.lit("(0)")))


def _card(m: Column, key: str) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    body = F.concat(F.substring(digits, 1, 1), permuted_text(F.substring(digits, F.lit(2), F.length(digits) - 2), key, "card"))
    checked = lambda b: F.concat(b, F.pmod(-luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)).cast("string"))
    return F.when((luhn_sum(digits) % 10 == 0) & ~digits.rlike(r"^([0-9])\1*$"), _let(_let(body, checked), lambda d: _laid(d, m, "0-9")))


_RULES: dict[str, Callable[[Column, str], Column]] = dict(zip(KINDS, (_email, _iban, _ip, _date, _ssn, _phone, _card), strict=True))


def _named(kind: str) -> Callable[[Column], Column]:
    return lambda text: F.when(text.isNotNull(), F.struct(F.lit(kind).alias("kind"), text.alias("text")))


def pseudonym(found: Column, key: str) -> Column:
    """(kind, text) of one candidate: its first kind whose pattern and rule accept it; kind null and the text itself if none does."""
    tried = [_let(F.when(found.rlike(f"^(?:{PATTERNS[kind]})$"), _RULES[kind](found, key)), _named(kind)) for kind in KINDS]
    return F.coalesce(*tried, F.struct(F.lit(None).cast("string").alias("kind"), found.alias("text")))


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """All columns of docs; ``text`` has pseudonyms, ``replaced`` the kind of each one in order. A longer list of lookups is never built: a text that fails ``HINT`` holds no candidate and is passed on as it is."""
    plain = F.coalesce(F.col("text"), F.lit(""))
    has = plain.rlike(HINT)
    none = F.array().cast("array<string>")
    found = F.when(has, F.regexp_extract_all(plain, F.lit(ANY), F.lit(0))).otherwise(none)
    named = docs.withColumn("found_", F.transform(found, lambda m: pseudonym(m, key)))
    gaps = F.split(F.col("text"), ANY, -1)
    joined = F.array_join(F.flatten(F.zip_with(gaps, F.col("found_.text"), lambda g, m: F.array(g, F.coalesce(m, F.lit(""))))), "")
    out = named.withColumn("text", F.when(F.exists("found_", lambda x: x["kind"].isNotNull()), joined).otherwise(F.col("text")))
    return out.withColumn("replaced", F.filter(F.col("found_.kind"), lambda k: k.isNotNull())).drop("found_")


def pseudonym_counts(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, the number of pseudonyms of each kind and of all, and the text with them."""
    done = pseudonymised(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), key)
    count = lambda kind: F.size(F.filter("replaced", lambda k: k == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(k) for k in KINDS]
    return done.select("doc_id", *counts, F.size("replaced").cast("long").alias("n_replaced"), "text")

