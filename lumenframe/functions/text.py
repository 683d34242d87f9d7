"""Text rules as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

C = Column | str
# Letters folded to ASCII.
FOLD_FROM, FOLD_TO = "çğıöşüâîûéèêáíóúñäß", "cgiosuaiueeeaiounas"
WORD = "a-zçğıöşüâîû0-9"


def _c(x: C) -> Column:
    return F.col(x) if isinstance(x, str) else x


def turkish_lower(x: C) -> Column:
    """Lower case with the dotted capital first, which plain lowering would split in two."""
    return F.lower(F.translate(_c(x), "İ", "i"))


def ascii_fold(x: C) -> Column:
    return F.trim(F.regexp_replace(F.translate(turkish_lower(x), FOLD_FROM, FOLD_TO), r"\s+", " "))


def contains_any(x: C, words: Sequence[str]) -> Column:
    """Whether any of the words occurs in the text, anywhere."""
    out = F.lit(False)
    for w in words:
        out = out | _c(x).contains(w)
    return out


def quote(word: str) -> str:
    return "".join("\\" + c if c in r"\.^$|?*+()[]{}-" else c for c in word)


def matched_words(x: C, words: Sequence[str]) -> Column:
    """The words that occur with no letter or digit before them, in the list's order."""
    return F.filter(F.array(*(F.when(_c(x).rlike(f"(^|[^{WORD}]){quote(w)}"), F.lit(w)) for w in words)), lambda w: w.isNotNull())


def tokens(x: C) -> Column:
    return F.array_distinct(F.filter(F.split(F.regexp_replace(turkish_lower(x), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != ""))


def jaccard(a: C, b: C) -> Column:
    """Shared over all tokens of two token arrays; 0 for two empty ones."""
    u = F.size(F.array_union(_c(a), _c(b)))
    return F.when(u > 0, F.size(F.array_intersect(_c(a), _c(b))) / u).otherwise(0.0)


def clean_name(x: C, limit: int = 60) -> Column:
    """Without control and format characters, squeezed, null when empty or longer than the limit in code points."""
    t = F.trim(F.regexp_replace(F.regexp_replace(_c(x), r"[\p{Cc}\p{Cf}]", ""), r"\s+", " "))
    return F.when(F.char_length(t).between(1, limit), t)


def redact_coordinates(x: C) -> Column:
    """Coordinates in query strings replaced."""
    return F.regexp_replace(_c(x), r"((?:lat|lng|lon|latitude|longitude)=)-?\d+(?:\.\d+)?", "$1[redacted]")


def first_tag(x: C, rules: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """Name of the first rule one of whose words occurs in the text."""
    out = F.lit(default)
    for name, words in reversed(rules):
        out = F.when(contains_any(x, words), name).otherwise(out)
    return out


def gate_reason(title: C, text: C, must: Sequence[str], title_only: Sequence[str], blocked: Sequence[str], min_title: int = 10) -> Column:
    """ok, or the first reason against: no_must_have, blocked, too_short."""
    t, f = F.trim(turkish_lower(title)), F.trim(turkish_lower(text))
    return (
        F.when(~(contains_any(f, must) | contains_any(t, title_only)), "no_must_have").when(contains_any(f, blocked), "blocked")
        .when(F.char_length(t) <= min_title, "too_short").otherwise("ok")
    )
