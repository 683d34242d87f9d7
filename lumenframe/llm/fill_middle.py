"""Fill-in-middle forms of documents by bit-parallelism on big integers.

A text is cut into units, runs of ASCII letters and single other code points. One
byte per code point, translated to 0 or 1, gives the mask of letters as one big
integer, the first code point in its lowest bit. A unit starts everywhere but at a
letter behind a letter, so the starts are the mask's complement joined to the
complement of the mask moved by one place; the number of their bits is the number of
units, and the place of a unit is found by halving the mask: the low half keeps the
wanted bit, or its count is taken off and the high half goes on. All steps are linear
in the text, and memory is a few times its length.

Two hashes of the id choose the ends of prefix and middle among the n + 1 places
between units, a third whether the text is changed at all, a fourth the order.

Defined cases: null text counts as empty, empty texts and those that hold one of the
marks stay plain; a null id hashes as an empty one; repeated rows are changed alike;
an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .batches import map_batches, texts_of

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
#: Parts of a hundred that are changed, and parts of those that have the suffix first.
CHANGED, SUFFIX_FIRST = 90, 20
SEED = 1

#: Bytes of letters become the digit 1, all others 0.
_LETTER_DIGITS = bytes(49 if chr(b).isalpha() and b < 128 else 48 for b in range(256))


def unit_starts(text: str) -> int:
    """The mask of unit starts: bit i is set where a unit starts at code point i."""
    if not text:
        return 0
    # code points beyond one byte become "?", which is no letter either; digits run from the highest bit down
    letters = int(text.encode("latin-1", "replace").translate(_LETTER_DIGITS)[::-1], 2)
    every = (1 << len(text)) - 1
    return every ^ (letters & (letters << 1))


def ranked_bit(mask: int, rank: int, width: int) -> int:
    """The place of the set bit that has `rank` set bits below it; width where there is none."""
    if rank >= mask.bit_count():
        return width
    place = 0
    while width > 1:
        half = width >> 1
        low = mask & ((1 << half) - 1)
        below = low.bit_count()
        if rank < below:
            mask, width = low, half
        else:
            mask, rank, width, place = mask >> half, rank - below, width - half, place + half
    return place


def rearranged(text: str, h: tuple[int, int, int, int], changed: int = CHANGED, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of prefix and of middle, output) of one text and its four hashes."""
    starts = unit_starts(text)
    n = starts.bit_count()
    if not text or h[2] % 100 >= changed or any(m in text for m in MARKS):
        return n, "plain", None, None, text
    first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = (ranked_bit(starts, k, len(text)) for k in (first, second))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < suffix_first:
        return n, "spm", a, b - a, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return n, "psm", a, b - a, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


def fill_in_middle(docs: DataFrame, seed: int = SEED, changed: int = CHANGED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars, output for every row; nothing is shuffled."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))), 256)
    hashes = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k}") for k in range(4)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = zip(*(batch.column(2 + k).to_pylist() for k in range(4)))
            told = [rearranged(t, h, changed, suffix_first) for t, h in zip(texts_of(batch.column(1)), drawn)]
            n, form, prefix, middle, output = zip(*told) if told else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", "text", *hashes)
    return map_batches(rows, run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: str = "output", form: str = "form") -> F.Column:
    """The text that an output and its form stand for. No text that is changed holds a mark, and no mark starts as another ends, so each is found once."""
    parts = F.split(F.col(output), "|".join(MARKS), -1)
    part = lambda k: F.element_at(parts, k)
    return F.when(F.col(form) == "psm", F.concat(part(2), part(4), part(3))).when(F.col(form) == "spm", F.concat(part(3), part(4), part(2))).otherwise(F.col(output))


def oracle_sql(seed: int = SEED) -> str:
    """What the query gives, from lists of units."""
    return f"""with d as (select doc_id, coalesce(text, '') t, sha256('{seed}:' || coalesce(doc_id::varchar, '')) s from documents),
 h as (select *, ('0x' || s[1:8])::ubigint h1, ('0x' || s[9:16])::ubigint h2, ('0x' || s[17:24])::ubigint h3, ('0x' || s[25:32])::ubigint h4,
  regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') u from d),
 f as (select *, len(u) n, case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain'
  when h4 % 100 < 20 then 'spm' else 'psm' end form, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) b from h),
 p as (select *, array_to_string(u[1:a], '') p, array_to_string(u[a+1:b], '') m, array_to_string(u[b+1:n], '') x from f)
 select doc_id, n::bigint n, form, case when form <> 'plain' then length(p)::bigint end prefix_chars, case when form <> 'plain' then length(m)::bigint end middle_chars,
  sha256(case form when 'psm' then '<P>' || p || '<S>' || x || '<M>' || m when 'spm' then '<S>' || x || '<P>' || p || '<M>' || m else t end) output_sha256,
  sha256(t) restored_sha256 from p"""
