"""Column functions on typed text fields."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import formats as K

SPACE = r"[\s ﻿]"  # the format's white space


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def infer_type(text: Column) -> Column:
    t = stripped(text)
    phone = t.rlike(K.PHONE) & (F.length(digits(t)) >= 7)
    return F.when(phone, "phone").when(t.rlike(K.URL), "url").when(t.rlike(K.EMAIL), "email").otherwise("text")


def sniff_value(text: Column) -> Column:
    """Type of a recovered value: @ tells an email, a scheme or any dot a url, the rest is a phone."""
    return F.when(text.contains("@"), "email").when(text.rlike("(?i)^https?:") | text.contains("."), "url").otherwise("phone")


def sniff_verified(text: Column) -> Column:
    return F.when(text.rlike(r"^\+?\d{8,}$"), "phone").when(text.rlike("(?i)^https?:"), "url").otherwise("text")


def known_type(kind: Column) -> Column:
    return F.when(kind.isin(K.TYPES), kind).otherwise("text")


def known_intent(intent: Column) -> Column:
    return F.when(intent.isin(K.INTENTS), intent).otherwise("actionable")


def safe_scheme(text: Column) -> Column:
    """No scheme is safe; otherwise it must be an allowed one."""
    scheme = F.lower(F.regexp_extract(stripped(text), r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1))
    return (scheme == "") | scheme.isin(K.SCHEMES)


def encoded(text: Column) -> Column:
    """Percent encoding that keeps letters, digits and -_.!~*'()."""
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def action_uri(kind: Column, text: Column) -> Column:
    """Where acting on a field leads; null where it may not. Web links are made https."""
    web = F.when(text.rlike("(?i)^https?://"), text).otherwise(F.concat(F.lit("https://"), text))
    web = F.regexp_replace(web, "(?i)^http://", "https://")
    return (
        F.when(kind == "phone", F.concat(F.lit("tel:"), F.regexp_replace(text, "[^+0-9]", "")))
        .when(kind == "email", F.concat(F.lit("mailto:"), stripped(text)))
        .when((kind == "url") & safe_scheme(text), web)
        .when(kind == "address", F.concat(F.lit("https://maps.google.com/?q="), encoded(text)))
    )


def action_verb(kind: Column) -> Column:
    return F.when(kind == "phone", "Call").when(kind == "email", "Email").when(kind == "url", "Open").when(kind == "address", "Directions")


def action_enabled(kind: Column, text: Column, intent: Column, may_disable: Column, platform_disables: Column) -> Column:
    allowed = ~(F.coalesce(may_disable, F.lit(False)) & F.coalesce(platform_disables, F.lit(False)))
    return F.coalesce(kind.isin(K.ACTIONABLE) & allowed & (F.coalesce(intent, F.lit("actionable")) != "readonly") & action_uri(kind, text).isNotNull(), F.lit(False))


def fits(text: Column) -> Column:
    return F.octet_length(text) <= K.CAPACITY


def phone_form(text: Column) -> Column:
    return F.regexp_replace(text, "[^+0-9]", "")


@F.pandas_udf(StringType())
def composed(text: pd.Series) -> pd.Series:
    """Unicode NFC, which Spark has no function for."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def generic_form(text: Column) -> Column:
    return stripped(F.regexp_replace(composed(text), f"{SPACE}+", " "))


def price_form(text: Column) -> Column:
    """Digits, point and currency signs only."""
    return F.regexp_replace(stripped(text), r"[^0-9.₹$€£]", "")


def url_form(text: Column) -> Column:
    """Scheme and host in lower case, no slash at the end."""
    t = stripped(text)
    head = F.regexp_extract(t, r"^((?:[A-Za-z][A-Za-z0-9+.\-]*://)?[^/?#]*)", 1)
    return F.regexp_replace(F.concat(F.lower(head), F.substr(t, F.length(head) + 1)), "/$", "")


def email_form(text: Column) -> Column:
    """Host in lower case."""
    t = stripped(text)
    return F.concat(F.regexp_extract(t, "^([^@]*@?)", 1), F.lower(F.regexp_extract(t, "^[^@]*@?(.*)$", 1)))


def file_name(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9_.\-]+", "-")


def xml_escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def base36(millis: Column) -> Column:
    """Content id from a clock in milliseconds."""
    return F.concat(F.lit(K.ID_PREFIX), F.lower(F.conv(millis.cast("string"), 10, 36)))


def text_width(text: Column, pixels) -> Column:
    """Estimated width of monospaced text."""
    return F.length(text) * pixels * 0.6


def crc16(data: Column) -> Column:
    """CCITT-FALSE checksum (polynomial 0x1021, start 0xFFFF) of binary data, as nested folds over bytes and bits."""
    values = F.transform(F.sequence(F.lit(1), F.octet_length(data)), lambda i: F.conv(F.hex(F.substr(data, i, F.lit(1))), 16, 10).cast("int"))
    shift = lambda c, _: F.when(c.bitwiseAND(0x8000) != 0, F.shiftleft(c, 1).bitwiseXOR(F.lit(0x1021))).otherwise(F.shiftleft(c, 1)).bitwiseAND(F.lit(0xFFFF))
    bits = F.array(*[F.lit(0)] * 8)
    whole = F.aggregate(values, F.lit(0xFFFF), lambda c, b: F.aggregate(bits, c.bitwiseXOR(F.shiftleft(b, 8)), shift))
    return F.when(F.octet_length(data) == 0, F.lit(0xFFFF)).otherwise(whole)
