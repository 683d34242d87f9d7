"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A paragraph is a line, cut further at sentence ends. The fingerprint of a text is a table
of `CELLS` cells (count, xor of 64-bit digests, xor of their 32-bit checks) in three
parts; each distinct paragraph is in one cell of every part. Two fingerprints are
subtracted cell by cell and peeled: a cell left with one digest gives it away and it
is taken out of its other cells, until all are empty; what came out are the digests
on one side only. Where that fails, since more paragraphs differ than the cells
hold, both texts get larger tables: a table for every few digests, dealt by value,
and each of these is tried again with twice the cells and other hashes until it
peels. Seven sizes end that: independent tries of which the later ones miss with a
chance below one in a thousand each, so that a pair which defeats all of them
(the query then stops with an error) is not to be met.

Likeness is twice the shared digests over all digests of both sides, from the tables'
counts and what peeling recovers; digest lists are never compared. Column functions only.

Defined cases: null text is empty; an empty text has an empty sketch, and two empty
sketches are alike (1.0); blank lines are no paragraphs; repeated paragraphs of one
text count once; rows of one doc_id and text are one document and come back once each;
of several texts with one doc_id the next is that of the lower digest; null doc_ids
come last, by digest; after the last document comes the first, so that of a table with
one document it is its own; a very long text is one array of digests; an empty table
gives no rows; other input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.durable import cut
from .line_runs import BREAK

#: Cells of a fingerprint.
CELLS = 12
#: Digests that one of the larger tables holds on average, and the sizes it is tried in.
BUCKET_KEYS = 4
SIZES = (12, 24, 48, 96, 192, 384, 768)
ROUNDS = 24
_CELL = "struct<n:int,k:bigint,x:int>"
_FOUND = "array<struct<k:bigint,n:int,a:int,b:int,c:int>>"


def digests(text: Column) -> Column:
    """Distinct paragraph digests of a text."""
    lines = F.filter(F.split(text, BREAK), lambda u: F.trim(u, F.lit(" \t\n\x0b\x0c\r")) != "")
    return F.array_distinct(F.transform(lines, lambda u: F.xxhash64(u)))


def _places(k: str, cells: int, seed: int) -> str:
    """The three cells of digest k as fields a, b, c; 20 bits of one hash tell each."""
    part = lambda n: f"cast({n} * {cells // 3} + (shiftrightunsigned(h, {21 * n}) & 1048575) % {cells // 3} as int)"
    return f"transform(array(xxhash64({seed}, {k})), h -> named_struct('a', {part(0)}, 'b', {part(1)}, 'c', {part(2)}))[0]"


def table_sql(keys: str, cells: int, seed: int = 0) -> str:
    """The cells of an array of digests."""
    entries = f"transform({keys}, k -> named_struct('k', k, 'x', hash(k), 'p', {_places('k', cells, seed)}))"
    return (
        f"transform(array({entries}), es -> transform(sequence(0, {cells - 1}), c -> aggregate(es, named_struct('n', 0, 'k', 0L, 'x', 0), "
        "(s, e) -> if(c in (e.p.a, e.p.b, e.p.c), named_struct('n', s.n + 1, 'k', s.k ^ e.k, 'x', s.x ^ e.x), s))))[0]"
    )


def subtract_sql(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (x, y) -> named_struct('n', x.n - y.n, 'k', x.k ^ y.k, 'x', x.x ^ y.x))"


def peel_sql(difference: str, cells: int, seed: int = 0) -> str:
    """Digests of one side only as (k, n, cells), n 1 for the first's and -1 for the second's; null if the difference can't be peeled."""
    entry = f"transform(array({_places('c.k', cells, seed)}), p -> named_struct('k', c.k, 'n', c.n, 'a', p.a, 'b', p.b, 'c', p.c))[0]"
    single = f"array_distinct(transform(filter(s.cells, c -> abs(c.n) = 1 and c.x = hash(c.k)), c -> {entry}))"
    take = "transform(s.cells, (c, i) -> aggregate(pure, c, (z, p) -> if(i in (p.a, p.b, p.c), named_struct('n', z.n - p.n, 'k', z.k ^ p.k, 'x', z.x ^ hash(p.k)), z)))"
    step = (
        f"if(not s.go, s, transform(array({single}), pure -> if(size(pure) = 0, named_struct('cells', s.cells, 'found', s.found, 'go', false), "
        f"named_struct('cells', {take}, 'found', concat(s.found, pure), 'go', true)))[0])"
    )
    return (
        f"aggregate(sequence(1, {ROUNDS}), named_struct('cells', {difference}, 'found', cast(array() as {_FOUND}), 'go', true), (s, r) -> {step}, "
        "s -> if(forall(s.cells, c -> c.n = 0 and c.k = 0 and c.x = 0), s.found, null))"
    )


def buckets_sql(keys: str, side: str) -> str:
    """Arrays of digests, side * side of them, by two rounds of remainders."""
    return (
        f"flatten(transform(sequence(0, {side} - 1), s -> transform(array(filter({keys}, k -> pmod(k, {side}) = s)), part -> "
        f"transform(sequence(0, {side} - 1), t -> filter(part, k -> pmod(shiftright(k, 8), {side}) = t)))[0]))"
    )


def larger_sql(a: str, b: str, sizes: tuple[int, ...] = SIZES) -> str:
    """Digests that only one of two texts has, from tables of their buckets, each tried in the given sizes.

    Buckets are a square number, so that dealing takes its root twice.
    """
    failed = f"cast(raise_error('paragraph tables of all sizes failed to peel') as {_FOUND})"
    tries = ", ".join(peel_sql(subtract_sql(table_sql("p.a", m, m), table_sql("p.b", m, m)), m, m) for m in sizes)
    side = f"cast(greatest(1, ceil(sqrt(greatest(size({a}), size({b})) / {BUCKET_KEYS}.0D))) as int)"
    pairs = f"transform(array({side}), m -> zip_with({buckets_sql(a, 'm')}, {buckets_sql(b, 'm')}, (x, y) -> named_struct('a', x, 'b', y)))[0]"
    return f"flatten(transform({pairs}, p -> coalesce({tries}, {failed})))"


def count_sql(table: str) -> str:
    """Digests that a fingerprint holds."""
    return f"aggregate(slice({table}, 1, {CELLS // 3}), 0, (s, c) -> s + c.n)"


def likeness_sql(ta: str, tb: str, a: str, b: str, sizes: tuple[int, ...] = SIZES) -> str:
    """Likeness of two fingerprints ta and tb; a and b, the texts' digests, only feed larger tables where ta and tb don't peel."""
    found = f"size(coalesce({peel_sql(subtract_sql(ta, tb), CELLS)}, {larger_sql(a, b, sizes)}))"
    return f"transform(array({count_sql(ta)} + {count_sql(tb)}), n -> if(n = 0, 1.0D, 1.0D - {found} / cast(n as double)))[0]"


def fingerprint_text(table: str) -> str:
    """A fingerprint's cells in hex: count, digests, checks."""
    return f"array_join(transform({table}, c -> concat(lpad(hex(c.n), 8, '0'), lpad(hex(c.k), 16, '0'), lpad(hex(c.x & 4294967295L), 8, '0'))), '')"


KEY = ["no_id", "d", "h"]


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and KEY: what tells a document."""
    text, d = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").cast("long")
    return docs.select(d.alias("doc_id"), text.alias("text"), d.isNull().alias("no_id"), F.coalesce(d, F.lit(0)).alias("d"), F.xxhash64(text).alias("h"))


def followers(docs: DataFrame) -> DataFrame:
    """KEY of each document (as following_*), and KEY and n_chars of the one it follows by descending doc_id; the first follows the last.

    A sort by range numbers the keys; a range's last document takes the first of the next range, and these are no more than ranges.
    """
    keys = _keyed(docs).select(*KEY, F.char_length("text").alias("n_chars")).groupBy(*KEY).agg(F.first("n_chars").alias("n_chars"))
    placed = cut(keys.orderBy("no_id", F.desc("d"), F.desc("h")).withColumn("m", F.monotonically_increasing_id()).withColumn("range", F.shiftright("m", 33)))
    heads = sorted(placed.groupBy("range").agg(F.min_by(F.struct(*KEY), "m").alias("head")).collect())
    after = [(r["range"], heads[(n + 1) % len(heads)]["head"]) for n, r in enumerate(heads)]
    ends = docs.sparkSession.createDataFrame(after, placed.select("range", F.struct(*KEY).alias("head")).schema)
    lead = F.lead(F.struct(*KEY)).over(Window.partitionBy("range").orderBy("m"))
    told = placed.withColumn("then", lead).join(F.broadcast(ends), "range").withColumn("then", F.coalesce("then", "head"))
    return told.select(*(F.col(f"then.{c}").alias(f"following_{c}") for c in KEY), *KEY, "n_chars")


def compare_edits(docs: DataFrame, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """doc_id, n_chars, edited (text with its last third replaced from the next document), fingerprints and likenesses.

    A text moves once, to the place of its key; its start, digests and fingerprint move on to the document before it.
    """
    texts = _keyed(docs).groupBy(*KEY).agg(F.first("text").alias("text"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    starts = texts.withColumnsRenamed({c: f"following_{c}" for c in KEY}).join(followers(docs), [f"following_{c}" for c in KEY])
    starts = starts.select(*KEY, "n_chars", F.substring("text", F.lit(1), third).alias("start"), digests(F.col("text")).alias("kn"))
    both = texts.join(starts, KEY).withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars") - third), "start"))
    both = both.select(*KEY, F.col("n_chars").cast("long").alias("n_chars"), "edited", digests(F.col("text")).alias("ka"), digests(F.col("edited")).alias("ke"), "kn")
    tables = ", ".join(f"'{t}', {table_sql(k, CELLS)}" for t, k in (("a", "ka"), ("e", "ke"), ("n", "kn")))
    made = f"named_struct('fingerprint', {fingerprint_text('t.a')}, 'edited_fingerprint', {fingerprint_text('t.e')}, 'near_edited', {likeness_sql('t.a', 't.e', 'ka', 'ke', sizes)}, 'near_next', {likeness_sql('t.a', 't.n', 'ka', 'kn', sizes)})"
    told = both.selectExpr(*KEY, "n_chars", "edited", f"transform(array(named_struct({tables})), t -> {made})[0] as made")
    return _keyed(docs).select("doc_id", *KEY).join(told, KEY).select("doc_id", "n_chars", "edited", "made.*")
