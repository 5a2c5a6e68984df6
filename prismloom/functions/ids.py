"""Identifiers: 128-bit values written as UUID text in several notations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_digits(col: Column) -> Column:
    """The 32 hex digits of an id (hyphens, blanks, case and a 0x prefix do not
    count), or null when the text does not hold exactly 32 of them."""
    bare = _bare(col)
    return F.when(F.unhex(bare).isNotNull() & (F.length(bare) == 32), bare)


def _bare(col: Column) -> Column:
    """Lower-case text without blanks around, hyphens and a 0x prefix; no patterns, as this runs on every id."""
    text = F.translate(F.lower(F.trim(col)), "-", "")
    return F.when(text.startswith("0x"), F.substring(text, F.lit(3), F.length(text))).otherwise(text)


def dashed(digits: Column) -> Column:
    """Canonical 36-character form of 32 hex digits."""
    return F.concat_ws("-", *[F.substring(digits, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def canonical_id(col: Column) -> Column:
    """Canonical form; text that is no id stays as it is, trimmed and in lower case."""
    digits = hex_digits(col)
    return F.when(digits.isNotNull(), dashed(digits)).otherwise(F.lower(F.trim(col)))


def id_key(col: Column) -> Column:
    """Compact binary join key: 16 bytes for an id, else a tag byte and the UTF-8 text.
    Halves what a shuffle of UUID text moves."""
    packed = F.unhex(_bare(col))
    return F.when((F.octet_length(packed) == 16) & (F.length(_bare(col)) == 32), packed).otherwise(F.concat(F.lit(bytearray(b"\x00")), F.encode(F.lower(F.trim(col)), "utf-8")))


def key_text(key: Column) -> Column:
    """Inverse of :func:`id_key`."""
    return F.when(F.octet_length(key) == 16, dashed(F.lower(F.hex(key)))).otherwise(F.decode(F.substring(key, F.lit(2), F.octet_length(key)), "utf-8"))


def content_id(*parts: Column) -> Column:
    """md5 over length-prefixed parts, as UUID text. A null part differs from an empty one."""
    encoded = [F.when(p.isNull(), F.lit("~")).otherwise(F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string"))) for p in parts]
    return dashed(F.md5(F.concat(*encoded)))
