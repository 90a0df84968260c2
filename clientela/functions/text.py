"""Text helpers of the campaign: first name, phone, link and message texts."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from clientela import labels


def first_word(name: Column) -> Column:
    """First word of ``name``; an empty text when there is none."""
    return F.coalesce(F.regexp_extract(name, r"(?U)^\s*(\S+)", 1), F.lit(""))


def clean_phone(phone: Column) -> Column:
    """Digits only, with the country prefix when the number is long enough to be a full one."""
    digits = F.regexp_replace(F.replace(phone, F.lit(".0"), F.lit("")), "[^0-9]", "")
    needs_prefix = ~digits.startswith(labels.COUNTRY_PREFIX) & (F.length(digits) >= 10)
    return F.when(needs_prefix, F.concat(F.lit(labels.COUNTRY_PREFIX), digits)).otherwise(digits)


def percent_encode(text: Column) -> Column:
    """UTF-8 percent encoding that leaves letters, digits and ``_ . - ~ /`` as they are."""
    encoded = F.url_encode(text)
    for found, wanted in (("+", "%20"), ("*", "%2A"), ("%2F", "/"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(found), F.lit(wanted))
    return encoded


def fill(template: str, values: Mapping[str, Column]) -> Column:
    """Concatenate the literal parts of ``template`` with the columns named in its braces."""
    parts = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2:
            parts.append(values[piece].cast("string"))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def headed(df, headers: Mapping[str, str]):
    """Rename the columns of ``df`` to their display headers."""
    return df.withColumnsRenamed({k: v for k, v in headers.items() if k in df.columns})
