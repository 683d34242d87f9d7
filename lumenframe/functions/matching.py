"""Many words found in one pass over a text.

What a text could hold is taken from it first, as runs of letters and what they make, and
met with the wanted words as sets, so that the time is that of the text plus that of the list,
not their product. Texts are lowered by the caller; null gives null.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

from .text import WORD, C, _c

#: Letters before which a name may not begin in named places.
NAME_LETTERS = "a-z0-9ğüşıöç"
#: Endings that say where: 'da, 'nda, daki and the like, or the word for a district behind the name.
LOCATIVE = "['’]?n?[dt][ae](?:ki)?"
DISTRICT_WORD = r"\s+il[çc]esi(?:n?[dt][ae](?:ki)?)?"


def _list(words: Sequence[str]) -> Column:
    return F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then of the value, which is worked out once however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def runs(low: C, most: int) -> Column:
    """Runs of letters and digits, and up to `most` neighbouring ones joined by single spaces."""
    grams = lambda c, n: F.when(F.size(c) >= n, F.transform(F.sequence(F.lit(1), F.size(c) - (n - 1)), lambda i: F.array_join(F.slice(c, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))
    of = lambda chain: let(F.split(chain, " "), lambda c: F.concat(c, *(grams(c, n) for n in range(2, most + 1))))
    # cut at what ends a chain; a pattern for chains would go as deep as a text has words
    chains = F.filter(F.transform(F.split(_c(low), f"[^{WORD} ]|[ ]{{2,}}"), F.trim), lambda c: c != "")
    return F.flatten(F.transform(chains, of))


def whole_words(low: C, words: Sequence[str]) -> Column:
    """The words (or phrases with single spaces) that stand in the text with no letter or digit on either side, in the list's order."""
    return F.array_intersect(_list(words), F.filter(runs(low, max((len(w.split(" ")) for w in words), default=1)), lambda w: w.isin(*words)))


def at_starts(low: C, words: Sequence[str], letters: str = NAME_LETTERS) -> Column:
    """The words that stand in the text with none of the letters before them, whatever follows, in the list's order."""
    longest = max(map(len, words), default=1)
    heads = F.regexp_extract_all(_c(low), F.lit(f"(?s)(?<![{letters}])(?=([{letters}].{{0,{longest - 1}}}))"), F.lit(1))
    lengths = F.array(*map(F.lit, sorted({len(w) for w in words})))
    return F.array_intersect(_list(words), F.flatten(F.transform(heads, lambda h: F.transform(lengths, lambda n: F.substring(h, F.lit(1), n)))))


def followed(low: C, chars: int) -> tuple[Column, Column]:
    """Runs of letters and digits, and the next `chars` characters behind each; two arrays that go together."""
    pattern = F.lit(f"(?s)([{WORD}]+)(?=(.{{0,{chars}}}))")
    return F.regexp_extract_all(_c(low), pattern, F.lit(1)), F.regexp_extract_all(_c(low), pattern, F.lit(2))


def located_names(low: C, most_words: int) -> Column:
    """What the text names with a locative ending or as a district: each possible name of up to most_words words, ending taken off.

    An n before the ending may belong to either, so both names are given; the dictionary decides.
    """

    def of(n: int) -> Column:
        words = f"(?:[{WORD}]+ ){{{n}}}"
        # what may be a mention first, without a step back inside a run; the few that are found are then taken apart
        likely = f"(?<![{WORD}])(?=((?:[{WORD}]++ ){{{n}}}[{WORD}]++(?:\\s+il[çc]esi[{WORD}]*+|['’][{WORD}]++|(?<=[dt][ae]|[dt][ae]ki))))"
        apart = [f"^({words}[{WORD}]+?){LOCATIVE}(?![{WORD}])", f"^({words}[{WORD}]+){LOCATIVE}(?![{WORD}])", f"^({words}[{WORD}]+){DISTRICT_WORD}(?![{WORD}])"]
        return F.flatten(F.transform(F.regexp_extract_all(_c(low), F.lit(likely), F.lit(1)), lambda m: F.array(*(F.regexp_extract(m, p, 1) for p in apart))))

    return F.filter(F.array_distinct(F.concat(*map(of, range(most_words)))), lambda name: name != "")
