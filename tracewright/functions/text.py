"""Text functions as column expressions: tokens, shingles, redaction, page text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import REDACTIONS, STOP_WORDS

def blank(text: Column) -> Column:
    """Null as the empty text."""
    return F.coalesce(text, F.lit(""))


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text; other letters part words."""
    return F.regexp_extract_all(F.lower(blank(text)), F.lit("[a-z0-9]+"), F.lit(0))


def metric_tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and apostrophes (ASCII)."""
    return F.transform(F.regexp_extract_all(blank(text), F.lit("[A-Za-z0-9']+"), F.lit(0)), F.lower)


def judge_tokens(text: Column) -> Column:
    """Distinct lower-cased words of two or more letters or digits (Unicode) that are no stop words."""
    words = F.filter(F.split(F.lower(blank(text)), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 1)
    return F.array_except(F.array_distinct(words), F.array(*map(F.lit, STOP_WORDS)))


def shingles(words: Column, k: int = 3) -> Column:
    """Distinct runs of ``k`` words; the distinct words themselves where there are fewer than ``k``."""

    def runs(bound: Column) -> Column:
        n = F.size(bound)
        starts = F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1)))
        parts = F.transform(starts, lambda i: F.array_join(F.slice(bound, i, F.lit(k)), " "))
        return F.when(n < k, F.array_distinct(bound)).otherwise(F.array_distinct(parts))

    # bound as a variable, so the words are made once and not for every shingle
    return F.element_at(F.transform(F.array(words), runs), 1)


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; 1 when both are empty, 0 when one is."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.coalesce(F.try_divide(both.cast("double"), union.cast("double")), F.lit(0.0)))


def overlap(a: Column, b: Column) -> Column:
    """Share of ``a`` that is in ``b``; 0 when ``a`` is empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(a).cast("double")), F.lit(0.0))


def redact(text: Column, rules=REDACTIONS) -> Column:
    """Secrets and personal data replaced by ``[redacted-<label>]``, rule by rule."""
    for label, pattern in rules:
        text = F.regexp_replace(text, pattern, f"[redacted-{label}]")
    return text


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(blank(text), r"\s+", " "))


def phrase(text: Column, words: int = 8) -> Column:
    """The first words of a text."""
    return F.array_join(F.slice(F.split(squeeze(text), " "), 1, words), " ")


def clipped(text: Column, n: int, mark: str = "…") -> Column:
    """A text cut to ``n`` characters, with a mark where something was cut."""
    return F.when(F.char_length(text) > n, F.concat(F.substring(text, 1, n), F.lit(mark))).otherwise(text)


def page_text(text: Column, limit: int = 2000) -> Column:
    """Stripped non-blank lines, joined and cut."""
    lines = F.filter(F.transform(F.split(blank(text), r"\r\n|\n|\r"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return clipped(F.array_join(lines, "\n"), limit)


def snippet(text: Column, needle: str, around: int = 80) -> Column:
    """What stands around the first hit of ``needle`` (any case), with marks where more stands; null without a hit."""
    at = F.instr(F.lower(text), needle.lower())
    first = F.greatest(at - around, F.lit(1))
    last = F.least(at + len(needle) - 1 + around, F.char_length(text))
    piece = F.substring(text, first, last - first + 1)
    before, after = F.when(first > 1, F.lit("…")).otherwise(F.lit("")), F.when(last < F.char_length(text), F.lit("…")).otherwise(F.lit(""))
    return F.when(at > 0, F.concat(before, piece, after))


def numbers(text: Column) -> Column:
    """The numbers of a text, in order."""
    return F.transform(F.regexp_extract_all(blank(text), F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0)), lambda x: x.try_cast("double"))
