"""Small text expressions shared by batch and streaming."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from augurlog.functions import packs

# A token is a run of two or more letters, digits or underscores.
TOKEN = r"[\p{L}\p{N}_]{2,}"


def blank_if_null(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def line_text(process: Column, message: Column) -> Column:
    """``process: message``, the text form that rules and the model read."""
    return F.concat(blank_if_null(process), F.lit(": "), blank_if_null(message))


def tokens(text: Column) -> Column:
    """Lower-case word tokens of two or more characters, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def first_token(lowered: Column) -> Column:
    """First token of a lower-case text; ``""`` if it has none."""
    return F.regexp_extract(lowered, TOKEN, 0)


def last_token(lowered: Column) -> Column:
    """Last token of a lower-case text, found from its end; ``""`` if it has none."""
    return F.reverse(F.regexp_extract(F.reverse(lowered), TOKEN, 0))


def terms_of(words: Column, ngram_max: int) -> Column:
    """A struct per word: the word ``a`` and, for pairs, the word after it ``b``."""
    following = F.slice(words, 2, 1 << 30) if ngram_max > 1 else F.array().cast("array<string>")
    return F.arrays_zip(words.alias("a"), following.alias("b"))


def sanitise(col: Column) -> Column:
    """Line breaks and commas become blanks, so a field is safe in a CSV line."""
    return F.translate(col.cast("string"), "\n,", "  ")


def example_text(text: Column, live: bool = False) -> Column:
    """First characters of a window text on one line (live output also drops commas)."""
    head = F.substring(text, 1, packs.EXAMPLE_CHARS)
    return F.translate(head, "\n,", "  ") if live else F.translate(head, "\n", " ")
