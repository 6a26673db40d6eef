"""Expressions that hide personal data. All are built-in functions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of personal data in values.
EMAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
PHONE = r"\+?\d[\d\s\-\.\(\)]{7,}\d"
POSTCODE = r"\b\d{5}\b"
NAME = r"\b[A-ZÉÈÊÀÂÙÔÎÏ][a-zéèêëàâùûüôîïç]{3,}(?:\s+[A-ZÉÈÊÀÂÙÔÎÏ][a-zéèêëàâùûüôîïç]{3,})+\b"

# Date formats, tried in this order.
DATE_FORMATS = [
    (r"\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}", "yyyy-M-d H:m:s"),
    (r"\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}", "yyyy-M-d H:m"),
    (r"\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}", "d/M/yyyy H:m:s"),
    (r"\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}", "d/M/yyyy H:m"),
    (r"\d{4}-\d{1,2}-\d{1,2}", "yyyy-M-d"),
    (r"\d{1,2}/\d{1,2}/\d{4}", "d/M/yyyy"),
    (r"\d{1,2}-\d{1,2}-\d{4}", "d-M-yyyy"),
    (r"\d{4}/\d{1,2}/\d{1,2}", "yyyy/M/d"),
    (r"\d{1,2}/\d{1,2}/\d{4}", "M/d/yyyy"),
]


def pseudonym(value: Column, salt: str) -> Column:
    """``ID_`` and ten hex digits of a salted SHA-256; null and blank stay."""
    value = value.cast("string")
    return F.when(F.trim(value) == "", value).when(value.isNotNull(), F.concat(F.lit("ID_"), F.upper(F.substring(F.sha2(F.concat(F.lit(f"{salt}::"), value), 256), 1, 10))))


def mask(value: Column) -> Column:
    return F.when(value.isNotNull(), "[MASKED]")


def generalise_address(value: Column) -> Column:
    """The first five-digit code with up to two words after it, else ``[ADDR_MASKED]``."""
    code = F.regexp_extract(value, POSTCODE, 0)
    words = F.filter(F.split(F.regexp_extract(value, rf"(?s){POSTCODE}(.*)", 1), r"\s+"), lambda x: x != "")
    return F.when(value.isNull(), None).when(code == "", "[ADDR_MASKED]").otherwise(F.concat_ws(" ", F.lit("CP"), code, F.slice(words, 1, 2)))


def round_position(value: Column, decimals: int = 2) -> Column:
    """A coordinate with two decimals. Text that isn't a number stays."""
    number = value.try_cast("double")
    return F.when(number.isNull(), value.cast("string")).otherwise(F.round(number, decimals).cast("string"))


def generalise_date(value: Column) -> Column:
    """Year and month of a date in one of the known formats, else ``[DATE_MASKED]``."""
    text = F.trim(value)
    found = [F.when(text.rlike(f"^{shape}$"), F.date_format(F.try_to_timestamp(text, F.lit(form)), "yyyy-MM")) for shape, form in DATE_FORMATS]
    first = F.regexp_extract(text, r"(\d{4})[-/](\d{2})[-/]\d{2}", 0)
    second = F.regexp_extract(text, r"(\d{2})[/-](\d{2})[/-](\d{4})", 0)
    found.append(F.when(first != "", F.concat_ws("-", F.substring(first, 1, 4), F.substring(first, 6, 2))))
    found.append(F.when(second != "", F.concat_ws("-", F.substring(second, 7, 4), F.substring(second, 4, 2))))
    return F.when(value.isNotNull(), F.coalesce(*found, F.lit("[DATE_MASKED]")))


def month_of(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM")


def scrub(value: Column, names: bool = True) -> Column:
    """Free text with e-mail addresses, phone numbers, postcodes and runs of capitalised words replaced, in this order."""
    for pattern, sign in ((EMAIL, "[EMAIL]"), (PHONE, "[PHONE]"), (POSTCODE, "[CP]"), *([(NAME, "[NAME]")] if names else [])):
        value = F.regexp_replace(value, pattern, sign)
    return value
