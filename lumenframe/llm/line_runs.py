"""Removal of repeated line runs by a distributed suffix array over line-ID sequences.

A document is a sequence of lines, each cut further at its sentence ends (a space after
a single . ! or ?; several marks in a row end none), so that a passage that starts or ends inside a line is found by the sentences
it holds whole; white space behind a cut belongs to it. These units are called lines
below. A line that occurs once can be in no repeated run, so only repeated lines get a
rank: their place in the sorted order of digests. Prefix doubling then ranks blocks of
2, 4, 8, ... lines by the pair of ranks of their halves, each time keeping only the
pairs that occur again; ranks come from a range-partitioned sort of the distinct pairs
(of the digests: from sorts within ranges of equal width, as they are spread evenly), never from one task. Suffixes of equal rank at a depth are a longest-common-prefix
interval: the places of one repeated run.

A run counts when it holds `min_words` words (1: any repeated line). Every longest
repeated run is the union of the shortest stretches of that many words that start or
end at one of its lines, so reading the intervals of those stretches finds all of it:
one of L lines is told by the ranks of its first and last 2^k lines, 2^k <= L, which
overlap. All places of a stretch but the first, by (doc_id, digest of the text, line),
are deleted. A row of doubling is left out where no stretch of its neighbourhood is that
long. Groups that hold over a 512th of the places are at most 512; they are joined by
broadcast, the others by key, so that no task gets a large group whole.

Defined cases: null text has no lines and stays null; blank lines are in no run, don't
part one and stay; lines may repeat inside one document, too; rows with the same doc_id
and text are one document and keep or lose the same lines; null doc_ids come first, in
the order of their text's digest; between two lines that stay next to each other after a
deletion stands the first line break that stood between them, else the first space; a
very long text is one array of lines and rows of places; texts and documents emptied by
deletion stay as rows with what is left; an empty table gives no rows; other columns are
kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.durable import keep
from .batches import join_groups

MIN_WORDS = 50
#: Bits of a digest that tell its range.
RANGE_BITS = 12
WHITE = r"[\x20\x09-\x0D]"
#: What stands between two lines: a line break or the space behind a sentence, with the white space after it.
BREAK = rf"[\n\x20](?<=\n|[^.!?][.!?]\x20){WHITE}*"


def _words(line: Column, odd: Column) -> Column:
    """Words of a trimmed line: its runs of characters that aren't white. odd: whether its text holds white space other than single spaces and line breaks."""
    spaces = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit("")))
    return F.when(odd, F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))).otherwise(spaces + 1)


def _trimmed(line: Column) -> Column:
    """A line without white space at its ends; few have any, and trimming takes apart all characters of a line."""
    ends = F.lit(False)
    for mark in "\n \t\r\x0b\x0c":
        ends = ends | F.startswith(line, F.lit(mark)) | F.endswith(line, F.lit(mark))
    return F.when(ends, F.trim(line, F.lit(" \t\n\x0b\x0c\r"))).otherwise(line)


def _key(text: Column) -> list[Column]:
    """A document's order and identity; a null id is the digest of its text below all ids from 0 on."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text).bitwiseOR(F.lit(-(1 << 63)))).alias("d"), F.hash(text).alias("h")]


def lines_of(docs: DataFrame) -> DataFrame:
    """d, h (document), i (place in it), words, x and y (96 bits of digest) of all lines that aren't blank."""
    text = F.col("text").cast("string")
    odd = F.lit(False)
    for mark in ("  ", "\t", "\r", "\x0b", "\x0c"):
        odd = odd | F.contains(text, F.lit(mark))
    # what a document has once is computed below the explode; outer: a split is never empty, and no filter on its size makes Spark cut the text twice
    once = docs.where(text.isNotNull()).select(*_key(text), odd.alias("odd"), F.split(text, BREAK).alias("lines"))
    lines = once.select("d", "h", "odd", F.posexplode_outer("lines").alias("i", "line")).withColumn("line", _trimmed(F.col("line"))).where("line <> ''")
    return lines.select("d", "h", "i", _words(F.col("line"), F.col("odd")).alias("words"), F.xxhash64("line").alias("x"), F.hash("line").alias("y"))


def _ranked(groups: DataFrame, *order: str) -> DataFrame:
    """groups with a rank that rises in the given order: sorted by range, numbered where each range lies, then kept.

    The groups are kept first: finding the ranges reads them once more.
    """
    return keep(keep(groups).orderBy(*order).withColumn("rank", F.monotonically_increasing_id()))


def _ranked_digests(groups: DataFrame) -> DataFrame:
    """groups with a rank that rises with x, y. Digests are spread evenly, so their first bits tell ranges that needn't be found."""
    part = F.shiftright("x", 64 - RANGE_BITS)
    within = F.row_number().over(Window.partitionBy("part").orderBy("x", "y"))
    rank = F.shiftleft(F.col("part") + (1 << (RANGE_BITS - 1)), 40) + within
    return keep(groups.withColumn("part", part).withColumn("rank", rank).drop("part"))


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """d, h, i, rank, fore, back, deep, flat of the places whose line occurs at least twice, in rows of such neighbours with min_words words; no other can be in a run.

    fore and back: lines of the shortest stretch of min_words words that starts or ends here (0: none); deep and flat: the most and the least of them among the neighbours.
    """
    lines = keep(lines_of(docs), distinct=("x", "y"))
    ranked = _ranked_digests(lines.groupBy("x", "y").agg(F.count("*").alias("c")).where("c > 1"))
    again = join_groups(lines, ranked, ["x", "y"], lines.count(), "shuffle_hash").select("d", "h", "i", "words", "rank")
    return keep(_stretched(again, min_words))


def _stretched(places: DataFrame, min_words: int) -> DataFrame:
    """Stretches by running word counts: all windows share the documents' partitioning, and all but two their sort orders."""
    doc = Window.partitionBy("d", "h").orderBy("i")
    # a place that comes again belongs to a row of the table that comes again
    once = places.withColumns({"last": F.lag("i").over(doc), "at": F.dense_rank().over(doc)}).where("last is null or last <> i")
    # neighbours have the same difference of place and number; counts rise along the document, so they order places as i does
    rows = once.select("d", "h", "i", "words", "rank", (F.col("i") - F.col("at")).alias("island"), F.sum("words").over(doc.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    rows = rows.withColumn("before", F.col("upto") - F.col("words")).sortWithinPartitions("d", "h", "island", "before")
    island = Window.partitionBy("d", "h", "island")
    summed = rows.withColumns({"all": F.sum("words").over(island), "head": F.min("i").over(island)}).where(F.col("all") >= min_words)
    # the last line that starts less than min_words words from here, and the last that ends min_words words before this one's end
    ahead = island.orderBy("before").rangeBetween(Window.unboundedPreceding, min_words - 1)
    start = F.max("i").over(island.orderBy("upto").rangeBetween(Window.unboundedPreceding, -min_words))
    both = summed.withColumns({"stop": F.max("i").over(ahead), "stop_upto": F.max("upto").over(ahead), "first": F.min("before").over(ahead)}).withColumn("start", start)
    fore = F.when(F.col("stop_upto") - F.col("before") >= min_words, F.col("stop") - F.col("i") + 1).otherwise(0)
    back = F.when(F.col("upto") - F.col("first") >= min_words, F.col("i") - F.coalesce(F.col("start") + 1, F.col("head")) + 1).otherwise(0)
    told = both.select("d", "h", "island", "i", "rank", fore.alias("fore"), back.alias("back"))
    least = F.least(*(F.when(F.col(n) > 0, F.col(n)) for n in ("fore", "back")))
    return told.withColumns({"deep": F.max(F.greatest("fore", "back")).over(island), "flat": F.min(least).over(island)}).drop("island")


def depths(places: DataFrame) -> DataFrame:
    """k, d, h, i, rank: blocks of 2^k lines that occur again, by the rank of their content."""
    ranks, found, k = places.select("d", "h", "i", "rank", "deep", "flat"), None, 0
    while True:
        size = 1 << k
        # only stretches of size to 2 * size - 1 lines are told by these ranks
        told = ranks.where(F.col("flat") < 2 * size).select(F.lit(k).alias("k"), "d", "h", "i", "rank")
        found = told if found is None else found.union(told)
        here = Window.partitionBy("d", "h").orderBy("i").rangeBetween(size, size)
        deeper = ranks.where(F.col("deep") >= 2 * size)
        if deeper.isEmpty():
            return found
        pairs = keep(deeper.select("d", "h", "i", "deep", "flat", F.col("rank").alias("r1"), F.first("rank").over(here).alias("r2")).where("r2 is not null"))
        classes = _ranked(pairs.groupBy("r1", "r2").agg(F.count("*").alias("c")).where("c > 1"), "r1", "r2")
        ranks = keep(join_groups(pairs, classes, ["r1", "r2"], pairs.count(), "shuffle_hash").select("d", "h", "i", "rank", "deep", "flat"))
        k += 1


def deleted_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """d, h, cut_lines (sorted places of the lines to delete) of every document that loses any."""
    places = repeated_lines(docs, min_words)
    ranks = depths(places)
    both = F.array(F.struct(F.col("i").alias("i"), F.col("fore").alias("n")), F.struct((F.col("i") - F.col("back") + 1).alias("i"), F.col("back").alias("n")))
    wanted = places.select("d", "h", F.explode(both).alias("s")).select("d", "h", "s.i", "s.n").where("n > 0").distinct()
    # a stretch of 2^k to 2^(k+1) - 1 lines: the ranks of its first and last 2^k lines, which cover it, tell it
    wanted = wanted.withColumn("k", F.floor(F.log2("n") + 1e-9).cast("int")).withColumn("j", F.expr("i + n - shiftleft(1, k)"))
    # places are dealt evenly, so a task's share of them is hashed; neither side is sorted, and the ranks are dealt once for both joins
    ranks = ranks.repartition("k", "d", "h", "i")
    first = ranks.withColumnRenamed("rank", "r1").join(wanted.hint("shuffle_hash"), ["k", "d", "h", "i"])
    told = keep(first.hint("shuffle_hash").join(ranks.select("k", "d", "h", F.col("i").alias("j"), F.col("rank").alias("r2")), ["k", "d", "h", "j"]).select("d", "h", "i", "n", "r1", "r2"))
    groups = told.groupBy("n", "r1", "r2").agg(F.count("*").alias("c"), F.min(F.struct("d", "h", "i")).alias("first")).where("c > 1")
    later = join_groups(told, keep(groups), ["n", "r1", "r2"], told.count(), "shuffle_hash").where(~F.struct("d", "h", "i").eqNullSafe(F.col("first")))
    # a stretch as one long, its first line and its length; collected as such
    stretch = F.shiftleft(F.col("i").cast("long"), 32).bitwiseOR(F.col("n").cast("long"))
    sets = later.groupBy("d", "h").agg(F.collect_set(stretch).alias("stretches"))
    first, length = (lambda s: F.shiftright(s, 32).cast("int")), (lambda s: s.bitwiseAND(F.lit((1 << 32) - 1)).cast("int"))
    lines = F.flatten(F.transform("stretches", lambda s: F.sequence(first(s), first(s) + length(s) - 1)))
    return sets.select("d", "h", F.sort_array(F.array_distinct(lines)).alias("cut_lines"))


def remaining(text: Column, gone: Column) -> Column:
    """A text less the lines at the given places."""
    lines, breaks = F.split(text, BREAK), F.regexp_extract_all(text, F.lit(BREAK), F.lit(0))

    def rebuilt(lines: Column, breaks: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)

        def between(k: Column, after: Column) -> Column:
            inside = F.slice(breaks, k + 1, after - k)
            return F.coalesce(F.get(F.filter(inside, lambda b: F.contains(b, F.lit("\n"))), F.lit(0)), F.get(inside, F.lit(0)))

        def joined(kept: Column) -> Column:
            return F.array_join(F.transform(kept, lambda k, n: F.concat(F.get(lines, k), F.when(n + 1 < F.size(kept), between(k, F.get(kept, n + 1))).otherwise(F.lit("")))), "")

        return F.transform(F.array(kept), joined)[0]

    return F.transform(F.array(F.struct(lines.alias("l"), breaks.alias("b"))), lambda s: rebuilt(s["l"], s["b"]))[0]


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the later copies of repeated line runs deleted from text; every row and other column stays."""
    return with_cuts(docs, min_words).select("row.*")


def with_cuts(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """row (a struct of docs' columns, text as remove_repeats leaves it) and cut_lines (places of the deleted lines; null for none)."""
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *_key(F.col("text").cast("string")))
    joined = whole.join(deleted_lines(docs, min_words).hint("shuffle_hash"), ["d", "h"], "left")  # texts aren't sorted
    old = F.col("row")["text"].cast("string")
    text = F.when(F.col("cut_lines").isNotNull(), remaining(old, F.col("cut_lines"))).otherwise(old)
    return joined.select(F.struct(*(text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns)).alias("row"), "cut_lines")
