"""Column expressions for text; all stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the 29 signs that count as white space at the ends of a text.
BLANKS = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends; null for null."""
    return F.regexp_replace(text, f"^{BLANKS}+|{BLANKS}+$", "")


def not_blank(text: Column) -> Column:
    """Whether there is more than white space; null for null (a filter drops it)."""
    return ~text.rlike(rf"\A{BLANKS}*\z")


def folded(text: Column) -> Column:
    """Without white space and punctuation, in lower case."""
    return F.regexp_replace(F.lower(text), rf"[\p{{P}}{BLANKS[1:-1]}]+", "")


def default(column: Column, value: str) -> Column:
    """A missing field's default; a null counts as missing."""
    return F.coalesce(column, F.lit(value))


def clean_name(name: Column) -> Column:
    """A source's name in lower case, without blanks and punctuation around it; null where nothing is left."""
    plain = F.regexp_replace(F.lower(name), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    return F.when(plain != "", plain)


def label_word(label: Column) -> Column:
    """``safe`` or ``unsafe``, in whatever spelling and with whatever code after it; else null."""
    word = F.lower(F.regexp_extract(strip(label), r"^(\p{L}+)", 1))
    return F.when(word.isin("safe", "unsafe"), word)
