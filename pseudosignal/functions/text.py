"""Text normalisation as native column expressions."""

from __future__ import annotations

import functools
import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

_SHARP_S = "ß"


@functools.cache
def simple_upper_table() -> tuple[str, str]:
    """Non-ASCII characters that have a one-to-one upper case, and that upper case.

    ``upper`` applies the full Unicode mapping, which may lengthen a string
    (sharp s becomes two letters) and follows the Unicode version of the JVM.
    Pseudonyms need the simple mapping, one character for one character:

    * the upper case itself where it is a single character,
    * otherwise the character whose lower case is this one (title-case Greek),
    * otherwise the character stays. Sharp s stays too: the capital sharp s maps
      down to it, but not the other way round.
    """
    letters = [chr(c) for c in range(0x80, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    raised_from = {}
    for ch in letters:
        low = ch.lower()
        if low != ch and len(low) == 1:
            raised_from.setdefault(low, ch)
    source, target = [], []
    for ch in letters:
        up = ch.upper()
        if len(up) > 1:
            up = ch if ch == _SHARP_S else raised_from.get(ch, ch)
        if up != ch:
            source.append(ch)
            target.append(up)
    return "".join(source), "".join(target)


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def _translate_upper(text: Column) -> Column:
    source, target = simple_upper_table()
    ascii_low, ascii_up = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, ascii_low + source, ascii_up + target)


def simple_upper(text: Column) -> Column:
    """Upper case, one character for one character, whatever the JVM's Unicode version."""
    return F.when(_is_ascii(text), F.upper(text)).otherwise(_translate_upper(text))


def present(text: Column) -> Column:
    """The text, or NULL when it is empty: absent, NULL and '' mean the same here."""
    return F.nullif(text, F.lit(""))


def is_blank(text: Column) -> Column:
    """True for NULL, '' and text made of Unicode white space only."""
    given = F.coalesce(text, F.lit(""))
    # Text that begins with a visible ASCII character needs no pattern search.
    return ~(F.substring(given, 1, 1).between("!", "~") | given.rlike(r"(?U)\S"))


def normalise_id(text: Column) -> Column:
    """Identifier without white space, dots and dashes, in upper case. NULL becomes ''."""
    plain = F.upper(F.regexp_replace(text, r"[\s.\-]+", ""))
    other = _translate_upper(F.regexp_replace(text, r"(?U)[\s.\-]+", ""))
    return F.coalesce(F.when(_is_ascii(text), plain).otherwise(other), F.lit(""))


def normalise_name(text: Column) -> Column:
    """Name in upper case with single blanks between its words. NULL becomes ''."""
    plain = F.upper(F.trim(F.regexp_replace(text, r"\s+", " ")))
    other = _translate_upper(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))
    return F.coalesce(F.when(_is_ascii(text), plain).otherwise(other), F.lit(""))
