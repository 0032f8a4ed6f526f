"""Text expressions: tokens, folding, sentences, similarity. All are built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters and what they fold to.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def words(text: Column) -> Column:
    """White-space separated tokens; none for null or blank."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def fold(text: Column) -> Column:
    """Lower case without the accents of Latin-1; œ and æ as two letters."""
    low = F.replace(F.replace(F.lower(text), F.lit("œ"), F.lit("oe")), F.lit("æ"), F.lit("ae"))
    return F.translate(low, ACCENTED, PLAIN)


def folded_tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 of the folded text."""
    return F.filter(F.split(F.regexp_replace(fold(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def sentences(text: Column) -> Column:
    """Trimmed, non-empty sentences: cut after ``.``, ``!`` or ``?`` before white space, and at line ends."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r"([.!?])\s+", "$1\n")
    return F.filter(F.transform(F.split(marked, "\n"), lambda s: F.trim(s)), lambda s: s != "")


def jaccard(a: Column, b: Column) -> Column:
    """Size of the intersection over that of the union; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def coverage(claim: Column, support: Column) -> Column:
    """Share of the claim's terms (repeats count) that the support has; 1 for an empty claim."""
    return F.when(F.size(claim) == 0, F.lit(1.0)).otherwise(F.size(F.filter(claim, lambda t: F.array_contains(support, t))) / F.size(claim))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 minus the edit distance over the longer length; 1 for two empty strings."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longer)


def initials(name: Column) -> Column:
    """First letters of the first two parts of a name, a hyphen counting as a space, in capitals; ``?`` without any."""
    parts = F.slice(words(F.translate(name, "-", " ")), 1, 2)
    joined = F.upper(F.array_join(F.transform(parts, lambda p: F.left(p, F.lit(1))), ""))
    return F.when(joined == "", F.lit("?")).otherwise(joined)


def file_name(name: Column, fallback: str = "file", most: int = 180) -> Column:
    """A name without characters that file systems refuse, without dots and blanks at its ends, at most ``most`` long."""
    safe = F.substring(F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]+', "_"), r"^[ .]+|[ .]+$", ""), 1, most)
    reserved = F.upper(F.substring_index(safe, ".", 1)).rlike("^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$")
    return F.when(F.coalesce(safe, F.lit("")) == "", F.lit(fallback)).when(reserved, F.concat(F.lit("_"), safe)).otherwise(safe)
