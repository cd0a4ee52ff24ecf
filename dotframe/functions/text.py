"""Names and translated text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ORPHAN = r"\\(\d+)/"
CANDIDATE = r"\b[a-z]{6,}\b"

#: The same with letters, digits and _ of all of Unicode about it, as in
#: Python: no part of a word with other letters.
WHOLE_CANDIDATE = r"(?<![\p{L}\p{N}_])[a-z]{6,}(?![\p{L}\p{N}_])"


def flat_stem(path: Column) -> Column:
    """Relative path without its last suffix, folders joined by _."""
    return F.translate(F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", ""), "/", "_")


def strip_orphans(text: Column) -> Column:
    return F.regexp_replace(text, ORPHAN, "")


def spell_candidates(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CANDIDATE), 0)


def whole_candidates(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WHOLE_CANDIDATE), 0)


def english(lang: Column) -> Column:
    """English in any spelling and region; texts without a language count, as
    the translation table is English unless another is named."""
    known = F.lower(F.regexp_replace(lang, r"^\s+|\s+$", ""))
    return F.coalesce(known.rlike(r"^(en([-_].*)?)?$"), F.lit(True))


def cut(text: Column, n: int = 800) -> Column:
    return F.substring(text, 1, n)
