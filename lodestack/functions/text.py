"""Text functions on columns: case, excerpts, patterns, hashes, counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters with the White_Space property of Unicode, as a class for Java's regular expressions.
WHITE = r"[\t\n\x0B\f\r \x85\xA0  -     　]"
#: The same for Python's strip.
WHITE_CHARS = "\t\n\x0b\x0c\r \x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B)))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, UPPER, LOWER)


def same_word(a: Column, b: Column) -> Column:
    """Equality that ignores the case of A-Z only."""
    return ascii_lower(a) == ascii_lower(b)


def content_hash(c: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, in lower-case hex."""
    return F.sha2(c.cast("binary"), 256)


def token_count(c: Column) -> Column:
    """Words between white space."""
    return F.regexp_count(c, F.lit(WHITE.replace("[", "[^", 1) + "+")).cast("long")


def is_blank(c: Column) -> Column:
    return ~c.rlike(WHITE.replace("[", "[^", 1))


def excerpt(c: Column, size: int = 120) -> Column:
    """White space collapsed; cut at size characters with an ellipsis."""
    flat = F.regexp_replace(F.regexp_replace(c, f"{WHITE}+", " "), "^ | $", "")
    return F.when(F.length(flat) > size, F.concat(F.substring(flat, 1, size), F.lit("…"))).otherwise(flat)


def head(c: Column, size: int = 500) -> Column:
    """The first size characters, with dots if there is more."""
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("..."))).otherwise(c)


def title_pattern(slug: str) -> str:
    """A LIKE pattern that finds a slug's words in a title: - and _ match anything, a caller's % too."""
    return "%" + slug.lower().replace("\\", "\\\\").replace("-", "%").replace("_", "%") + "%"


def utc_text(c: Column) -> Column:
    """A timestamp as text with milliseconds and Z."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def epoch_text(c: Column) -> Column:
    """Seconds since 1970 as text, in whole seconds."""
    return F.concat(F.date_format(F.timestamp_seconds(F.floor(c)), "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))


def utf8_text(data: Column, strict: bool = False) -> Column:
    """The text of bytes; what isn't UTF-8 is replaced, or, if strict, makes the whole text null."""
    if strict:
        return F.try_validate_utf8(data.cast("string"))
    return F.make_valid_utf8(data.cast("string"))
