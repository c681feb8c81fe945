"""Text functions: Column in, Column out; Python only where a built-in can't say it."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def fold(text: pd.Series) -> pd.Series:
    """NFKD, combining marks dropped, case folded (Spark has no NFKD); null stays null."""
    return text.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).casefold())


_ACCENTED = "".join(chr(c) for c in range(0xC0, 0x180) if len(unicodedata.normalize("NFD", chr(c))) == 2 and unicodedata.normalize("NFD", chr(c))[0].isascii())
_PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in _ACCENTED)


def fold_latin(text: Column) -> Column:
    """The fold for Latin letters, without Python."""
    return F.lower(F.translate(text, _ACCENTED, _PLAIN))


def fold_citation(text: Column) -> Column:
    """Folded, dots after letters dropped unless a digit follows, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(fold_latin(text), r"([a-z])\.(?![0-9])", "$1"), r"\s+", " "))


def anchor_norm(anchor: Column) -> Column:
    """Lower case without spaces, dots and section signs."""
    return F.lower(F.translate(F.coalesce(anchor, F.lit("")), " .§", ""))


def anchor_in_family(anchor: Column, parent: Column) -> Column:
    """The anchor is the parent or one of its parts: s33a(1) is in s33a, s33a isn't in s3."""
    return (anchor == parent) | anchor.startswith(F.concat(parent, F.lit("(")))


def string_hash(text: Column) -> Column:
    return F.sha2(fold_latin(text), 256)


def payload_hash(raw: Column, text: Column) -> Column:
    return F.sha2(F.coalesce(raw, text), 256)


def nul_to_replacement(text: Column) -> Column:
    """NUL becomes U+FFFD; offsets stay."""
    return F.translate(text, "\x00", "�")


#: C1 control codes that stand for cp1252 characters.
_CP1252 = "".join(bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
_C1 = "".join(chr(b) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))


def fix_cp1252(text: Column) -> Column:
    """C1 codes become the cp1252 characters they stand for; offsets stay."""
    return F.translate(text, _C1, _CP1252)


def tokens(text: Column) -> Column:
    """Lower-case index tokens: letters, digits and marks inside words; digits joined by / or . stay one."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[0-9]+(?:[/.][0-9]+)+|[\p{L}\p{N}]+(?:['’][\p{L}]+)*"), F.lit(0))


def surnames(name: Column, stop: tuple[str, ...] = ("the", "and", "v", "of", "ltd", "plc", "inc", "re", "ex", "parte")) -> Column:
    """Distinct words of at least three letters that aren't stop words, sorted."""
    words = F.regexp_extract_all(fold_latin(name), F.lit(r"[a-z]{3,}"), F.lit(0))
    return F.array_sort(F.array_except(F.array_distinct(words), F.array(*map(F.lit, stop))))


def id_segments(stable_id: Column, n: int = 2) -> Column:
    return F.array_join(F.slice(F.split(stable_id, "/"), 1, n), "/")


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(fold_latin(text), r"[^a-z0-9]+", "-"), F.lit("-"))


def strip_html(html: Column) -> Column:
    """Text of a page: scripts, styles and tags dropped, five entities decoded, white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))
