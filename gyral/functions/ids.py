"""Readers of case ids, subjects and file paths as native column expressions."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cohort and subject number; then, after a separator, a three-digit visit. Used on lower case text with plain digits.
CASE = (
    r"(?s)^.*?(?:^|[^a-z0-9]|(?<=brats))(?:(gli|goat)[^a-z0-9]*(?=[0-9]{5})|(hcp)[^a-z0-9]*(?=[0-9]{7}))0*([0-9]+)"
    r"(?:[^a-z0-9]+([0-9]{3})(?![0-9]))?.*$"
)
#: Marks a text that CASE has read, as no text holds it after plain().
READ = "\x01"


@cache
def _plain_table() -> tuple[str, str]:
    """Every decimal digit of Unicode with its ASCII digit, and the full-width Latin letters with theirs."""
    pairs = [(chr(c), str(d)) for c in range(128, sys.maxunicode + 1) if (d := unicodedata.decimal(chr(c), None)) is not None]
    pairs += [(chr(c), chr(c - 0xFEE0)) for c in (*range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B))]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def plain(text: Column) -> Column:
    """Lower case, with digits of any script and full-width letters as ASCII, and no mark of CASE."""
    return F.lower(F.when(text.rlike(r"[^\x02-\x7F]"), F.translate(text, _plain_table()[0] + READ, _plain_table()[1])).otherwise(text))


def _read(name: Column) -> Column:
    """Mark, cohort-number-visit; another text where cohort and number can't be read. Evaluated once a name."""
    return F.regexp_replace(plain(name), CASE, f"{READ}$1$2-$3-$4")


def subject_key(name: Column) -> Column:
    """'cohort-number' of the subject a name speaks of; null where cohort or number can't be read.

    Null and empty names give null. Leading zeros, case, separators, quotes, folders and endings don't matter.
    """
    return F.nullif(F.regexp_extract(_read(name), f"^{READ}([a-z]+-[0-9]+)-", 1), F.lit(""))


def case_key(name: Column) -> Column:
    """'cohort-number-visit' (no visit for the goat cohort); null where a part is missing."""
    return F.nullif(F.regexp_extract(_read(name), f"(?<=^{READ})(?:goat-[0-9]+|(?:gli|hcp)-[0-9]+-[0-9]{{3}}$)", 0), F.lit(""))


def cohort_of(key: Column) -> Column:
    """'gli', 'hcp' or 'goat' of a subject or case key; null for null."""
    return F.substring_index(key, "-", 1)


def file_key(path: Column) -> Column:
    """The file a path means: its last segment in lower case, without surrounding blanks; null for no file."""
    bare = F.regexp_replace(path, r"(?U)^\s+|[\s/\\]+$", "")
    last = F.substring_index(F.translate(bare, "\\", "/"), "/", -1)
    key = F.lower(F.regexp_replace(last, r"(?U)^\s+|\s+$", ""))
    return F.nullif(key, F.lit(""))
