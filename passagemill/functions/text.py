"""Text expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's str.strip and Unicode call blank, and the invisible format characters.
BLANK = r"[\s\p{Z}\p{Cf}]"


def strip_all(c: Column) -> Column:
    """Remove whitespace of any kind, and invisible format characters, at both ends."""
    return F.regexp_replace(c, rf"^{BLANK}+|{BLANK}+$", "")


def is_missing(c: Column) -> Column:
    """True for NULL, blank text and the word ``nan`` in any case."""
    return c.isNull() | c.rlike(rf"^{BLANK}*(?i:nan)?{BLANK}*$")


def same_writing(c: Column) -> Column:
    """Letters and digits of the lower-cased text; NULL where the text is missing."""
    return F.when(~is_missing(c), F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", ""))


def words_joined(c: Column) -> Column:
    """Lower-cased words, one blank apart; apostrophes and invisible characters join their word."""
    bare = F.regexp_replace(F.lower(c), r"[\p{Cf}'’]+", "")
    return F.when(~is_missing(c), F.btrim(F.regexp_replace(bare, r"[^\p{L}\p{N}]+", " ")))


def normalize(c: Column) -> Column:
    """Lower case, outer blanks removed, inner blanks collapsed (P5)."""
    return F.regexp_replace(F.btrim(F.lower(c), F.lit(" \t\n\r\f\x0b")), r"\s+", " ")


def keyword_key(c: Column) -> Column:
    """Lower case and outer blanks removed, inner blanks kept."""
    return F.btrim(F.lower(c), F.lit(" \t\n\r\f\x0b"))


def is_empty_text(c: Column) -> Column:
    """Falsy, blank, or ``nan`` (P4 as an ASCII predicate with an exact SQL twin)."""
    t = F.btrim(F.coalesce(c, F.lit("")), F.lit(" \t\n\r\f\x0b"))
    return (t == "") | (F.lower(t) == "nan")


def chunks(c: Column, words: int = 200) -> Column:
    """Pieces of at most ``words`` words; line breaks are removed first, words are split at single blanks."""
    parts = F.split(F.replace(c, F.lit("\n"), F.lit("")), " ")
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / words).cast("int")), lambda i: F.array_join(F.slice(parts, i * words + 1, words), " "))


# fixed value: where a sentence ends
_SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z])"


def sentences(c: Column) -> Column:
    """Sentences: split after ``.``, ``!`` or ``?`` and blanks before a capital letter (S3)."""
    ws = F.lit(" \t\n\r\f\x0b")
    return F.filter(F.transform(F.split(F.btrim(c, ws), _SENTENCE_END), lambda x: F.btrim(x, ws)), lambda x: x != "")
