"""Language tags as column expressions. Null means unknown, ``mixed`` more than one language, ``und`` undetermined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names for several languages, and for leaving the choice open.
MIXED = ["mixed", "multi", "multilingual", "bilingual", "mixte"]
OPEN = ["auto", "detect", "automatic"]


def normal_tag(tag: Column) -> Column:
    """``mixed``, null for an open choice, else the primary part of a tag in lower case."""
    clean = F.lower(F.trim(F.translate(tag, "_", "-")))
    return F.when(clean.isNull() | clean.isin(OPEN), F.lit(None)).when(clean.isin(MIXED), F.lit("mixed")).otherwise(F.nullif(F.substring_index(clean, "-", 1), F.lit("")))


def resolved_language(*tags: Column) -> Column:
    """The first of several candidates, from the most to the least telling, that says a language."""
    return F.coalesce(*map(normal_tag, tags))


def languages_of(tag: Column, every: tuple[str, ...] = ("en", "fr")) -> Column:
    """A tag's languages: all of ``every`` for a mixed or open one."""
    clean = normal_tag(tag)
    return F.when(clean.isNull() | (clean == "mixed"), F.array(*map(F.lit, every))).otherwise(F.array(clean))


def merged_tag(tags: Column) -> Column:
    """One tag for an array of them: null without any, the only one, or ``mixed``."""
    known = F.array_distinct(F.filter(F.transform(tags, normal_tag), lambda t: t.isNotNull()))
    return F.when(F.size(known) == 0, F.lit(None)).when((F.size(known) > 1) | F.array_contains(known, "mixed"), F.lit("mixed")).otherwise(F.get(known, F.lit(0)))


def agree(a: Column, b: Column) -> Column:
    """Whether two tags can stand for one block: an unknown one agrees with any."""
    return a.isNull() | b.isNull() | (a == b)
