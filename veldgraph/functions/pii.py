"""Personal data by six patterns: detection, masks, redaction, hashes and checks of input. All are columns of built-in functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as each kind.
PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"(?:010|011|016|017|018|019)[-\s]?\d{3,4}[-\s]?\d{4}",
    "ssn": r"\d{6}[-\s]?[1-4]\d{6}",
    "credit_card": r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b",
    "bank_account": r"\b\d{3,6}[-\s]?\d{2,6}[-\s]?\d{4,8}\b",
    "ip_address": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
}
#: The kinds that texts are masked for, in this order.
MASKED = ("email", "phone", "ssn", "credit_card", "ip_address")
# Signs of an attack, in the order in which they are tried.
SQL_INJECTION = (
    r"(\bunion\b.*\bselect\b)",
    r"(\bselect\b.*\bfrom\b)",
    r"(\binsert\b.*\binto\b)",
    r"(\bupdate\b.*\bset\b)",
    r"(\bdelete\b.*\bfrom\b)",
    r"(\bdrop\b.*\btable\b)",
    r"(--|\#|\/\*|\*\/)",
    r"(\bor\b\s+\d+\s*=\s*\d+)",
    r"(\band\b\s+\d+\s*=\s*\d+)",
)
XSS = (r"<script[^>]*>.*?</script>", r"javascript:", r"on\w+\s*=", r"<iframe[^>]*>", r"<object[^>]*>", r"<embed[^>]*>")
PATH_TRAVERSAL = (r"\.\./", r"\.\.", r"%2e%2e", r"\.\.%2f")


def _all(text: Column, kind: str) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))


def detected(text: Column) -> Column:
    """kind -> matches, for the kinds that occur. A value may stand under several."""
    every = F.create_map(*[x for k in PATTERNS for x in (F.lit(k), _all(text, k))])
    return F.map_filter(every, lambda _k, v: F.size(v) > 0)


def contains_pii(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in PATTERNS.values()])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def masked_email(value: Column) -> Column:
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    n = F.length(local)
    stars = F.when(n <= 1, local).when(n <= 3, F.concat(F.left(local, F.lit(1)), F.repeat(F.lit("*"), n - 1))).otherwise(F.concat(F.left(local, F.lit(1)), F.repeat(F.lit("*"), n - 2), F.right(local, F.lit(1))))
    return F.when(F.contains(value, F.lit("@")), F.concat(stars, F.lit("@"), domain)).otherwise(value)


def masked_phone(value: Column) -> Column:
    d = _digits(value)
    n = F.length(d)
    return F.when(n < 8, value).when(n.isin(10, 11), F.concat(F.left(d, F.lit(3)), F.lit("-****-"), F.right(d, F.lit(4)))).otherwise(F.concat(F.left(d, n - 4), F.lit("****")))


def masked_ssn(value: Column) -> Column:
    d = _digits(value)
    return F.when(F.length(d) == 13, F.concat(F.left(d, F.lit(6)), F.lit("-"), F.substring(d, 7, 1), F.lit("******"))).otherwise(value)


def masked_card(value: Column) -> Column:
    d = _digits(value)
    return F.when(F.length(d) >= 12, F.concat(F.lit("****-****-****-"), F.right(d, F.lit(4)))).otherwise(value)


def masked_account(value: Column) -> Column:
    d = _digits(value)
    n = F.length(d)
    return F.when(n >= 6, F.concat(F.left(d, F.lit(3)), F.lit("-***-"), F.repeat(F.lit("*"), n - 6), F.right(d, F.lit(3)))).otherwise(value)


def masked_name(value: Column) -> Column:
    part = lambda p: F.concat(F.left(p, F.lit(1)), F.repeat(F.lit("*"), F.length(p) - 1))
    return F.array_join(F.transform(F.filter(F.split(value, r"\s+"), lambda p: p != ""), part), " ")


def masked_ip(value: Column) -> Column:
    return F.regexp_replace(value, r"^([0-9]{1,3})\.([0-9]{1,3})\.[0-9]{1,3}\.[0-9]{1,3}$", "$1.$2.***.***")


MASKS = {"email": masked_email, "phone": masked_phone, "ssn": masked_ssn, "credit_card": masked_card, "bank_account": masked_account, "ip_address": masked_ip}


def _replaced(kind: str):  # noqa: ANN202
    return lambda text, match: F.replace(text, match, MASKS[kind](match))


def masked_text(text: Column) -> Column:
    """All matches masked, kind by kind. Matches are those of the text as it was, replaced wherever they stand."""
    out = text
    for kind in MASKED:
        out = F.aggregate(_all(text, kind), out, _replaced(kind))
    return out


def redacted_fields(columns: list[str], secret: tuple[str, ...] = ("password", "token", "secret", "api_key", "ssn", "credit_card")) -> list[Column]:
    return [F.lit("[REDACTED]").alias(c) if c.lower() in secret else F.col(c) for c in columns]


def salted_hash(text: Column, salt: str) -> Column:
    return F.sha2(F.encode(F.concat(text, F.lit(salt)), "UTF-8"), 256)


def encrypted(text: Column, key: str) -> Column:
    """AES-GCM with a key of 16, 24 or 32 bytes, in Base64."""
    return F.base64(F.aes_encrypt(F.encode(text, "UTF-8"), F.encode(F.lit(key), "UTF-8")))


def decrypted(text: Column, key: str) -> Column:
    return F.decode(F.aes_decrypt(F.unbase64(text), F.encode(F.lit(key), "UTF-8")), "UTF-8")


def escaped(text: Column) -> Column:
    """HTML escapes, no control characters but tab and line end, no white space at the ends."""
    out = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return F.trim(out)


def first_matching(text: Column, patterns: tuple[str, ...]) -> Column:
    """The number of the first pattern that the lower-case text matches; null if none does."""
    out = F.lit(None).cast("int")
    for i, p in reversed(list(enumerate(patterns))):
        out = F.when(F.lower(text).rlike(p), i).otherwise(out)
    return out


def safe_filename(name: Column) -> Column:
    return F.left(F.regexp_replace(F.regexp_replace(name, r"^.*[/\\]", ""), r"[^A-Za-z0-9가-힣._-]", "_"), F.lit(255))


def valid_url(url: Column) -> Column:
    return url.rlike(r"^https?://[A-Za-z0-9.-]+(:[0-9]+)?(/\S*)?$")


def valid_email(value: Column) -> Column:
    return value.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$")


def valid_phone(value: Column) -> Column:
    return _digits(value).rlike(r"^01[0-9][0-9]{7,8}$")
