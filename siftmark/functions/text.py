"""Text expressions: all are built-in column expressions, none leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that Python's str.strip() removes.
_SPACE_CODES = [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
PY_SPACE = "".join(map(chr, _SPACE_CODES))


def py_strip(c: Column | str) -> Column:
    """Strip as Python does: every Unicode space, U+001C to U+001F too. Null stays null."""
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(PY_SPACE))


def is_blank(c: Column | str) -> Column:
    return F.coalesce(py_strip(c) == "", F.lit(True))


def word_text(c: Column) -> Column:
    """The words of a text, one space between them. A word is a longest run of letters and numbers
    (categories L and N), lower-cased after it was found. Null gives an empty string."""
    return F.lower(F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}]+", " ")))


def words(c: Column) -> Column:
    """``word_text`` as an array; texts without words give an empty array."""
    t = word_text(c)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def doc_key(text: Column, url: Column | None = None) -> Column:
    """``doc_`` and the first 16 hex digits of sha1(url, line feed, stripped text). A null url is empty; a
    null text gives null."""
    u = F.lit("") if url is None else F.coalesce(url, F.lit(""))
    return F.concat(F.lit("doc_"), F.substring(F.sha1(F.concat(u, F.lit("\n"), py_strip(text)).cast("binary")), 1, 16))


def is_positive(flag: Column, kind: str) -> Column:
    """Whether a selection flag is set: a boolean itself, a number that truncates to 1, one of three
    strings. ``kind`` is the flag's Spark type; null is not set."""
    if kind == "boolean":
        found = flag
    elif kind == "string":
        # The strings that count as set.
        found = py_strip(flag).isin("1", "true", "True")
    else:
        found = flag.cast("long") == 1
    return F.coalesce(found, F.lit(False))


def query_text(c: Column, keep_prefix: bool = False) -> Column:
    """A query without its leading ``query:`` (any case, at the very start) and surrounding space."""
    if keep_prefix:
        return c
    return F.when(F.lower(F.substring(c, 1, 6)) == "query:", py_strip(F.substr(c, F.lit(7)))).otherwise(py_strip(c))


def rqid(codes: Column) -> Column:
    """``<r0_12> <r1_7> ...`` of an array of codes."""
    return F.array_join(F.transform(codes, lambda c, i: F.concat(F.lit("<r"), i.cast("string"), F.lit("_"), c.cast("string"), F.lit(">"))), " ")


def rqid_tokens(levels: int, codes: int) -> list[str]:
    """The tokens that identifiers are made of, in order: what a tokenizer has to add to its vocabulary."""
    return [f"<r{level}_{c}>" for level in range(levels) for c in range(codes)]


def rqid_codes(text: Column) -> Column:
    """The codes of an rqid; a text without any gives an error, null gives null."""
    found = F.regexp_extract_all(text, F.lit(r"<r[0-9]+_([0-9]+)>"), F.lit(1)).cast("array<int>")
    return F.when(text.isNull(), F.lit(None)).when(F.size(found) == 0, F.raise_error(F.concat(F.lit("no codes in: "), text)).cast("array<int>")).otherwise(found)
