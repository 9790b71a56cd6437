"""Text expressions with the same meaning as the Python string methods the rules assume."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Line ends of str.splitlines: \R lacks the three information separators.
LINE_END = r"\R|[\x1c-\x1e]"

# The characters str.strip removes.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def normalize_newlines(text: Column) -> Column:
    """Turn ``\\r\\n`` and lone ``\\r`` into ``\\n``."""
    return F.when(text.contains("\r"), F.regexp_replace(text, r"\r\n?", "\n")).otherwise(text)


def normalize_path(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def strip(text: Column) -> Column:
    """Drop Unicode white space on both sides, in one pass over each side."""
    return F.trim(text, F.lit(WHITE_SPACE))


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(WHITE_SPACE))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITE_SPACE))


def lines(text: Column) -> Column:
    """All lines without their ends; a final line end opens no further line."""
    body = F.regexp_replace(text, f"(?:{LINE_END})\\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, LINE_END))


def tail_lines(text: Column, n: int) -> Column:
    """The last ``n`` lines of ``text``."""
    all_lines = lines(text)
    return F.slice(all_lines, F.greatest(F.size(all_lines) - F.lit(n - 1), F.lit(1)), n)


def occurrences(text: Column, needle: str) -> Column:
    """How often a one-character ``needle`` occurs."""
    return F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))


def contains_any(text: Column, needles) -> Column:
    """True if ``text`` holds any of the given strings."""
    hit = F.lit(False)
    for needle in needles:
        hit = hit | text.contains(needle)
    return hit


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_stem(path: Column) -> Column:
    """File name without its last suffix; a leading dot starts no suffix."""
    name = file_name(path)
    return F.regexp_replace(name, r"^(.+)\.[^.]+$", "$1")
