"""Secret scans over an incremental blob ledger.

Every version of a text is a blob named by the SHA-256 of its content. The ledger holds,
for each blob, the rules ("kind:version") that have seen it and the spans they found: a
row stands for one scan of a blob, its pairs of blob and rule version are those with
each of its rules. A scan runs only the rules that a blob hasn't met in their present
version, whichever documents or versions of documents (paths) the blob is in and
however often it recurs, and findings are joined back to all paths by the blob's name.
Column functions only.

Positions come from marking: a rule's matches are wrapped in two control
characters, the text is split at them, and running lengths of the parts are the
code-point offsets. The control characters are first replaced by a third one in
the text, which no rule matches, so lengths and matches stay as they were.

Defined cases: null text is the empty blob; repeated rows and copies share one
scan; an empty table gives no rows; spans of different kinds may overlap; spans of
rule versions that aren't in use any more stay in the ledger and are told no more; of
a very long text the spans are one array; other input columns are ignored (scan) or
kept, whatever their names (redact).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

OPEN, CLOSE, OTHER = "\x01", "\x02", "\x03"

# Rules by kind, as (kind, version, pattern, least length of the measured group). The first three are the base.
RULES: list[tuple[str, int, str, int]] = [
    ("assign", 1, r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 6),
    ("access", 1, r"()(AKIA[A-Z0-9]+)", 20),
    ("hex", 1, r"()([0-9a-f]{24,})", 24),
    ("pem", 1, r"()(-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----)", 1),
    ("github", 1, r"()(gh[pousr]_[A-Za-z0-9]{36,})", 1),
    ("slack", 1, r"()(xox[abprs]-[A-Za-z0-9-]{10,})", 1),
    ("jwt", 1, r"()(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", 1),
]
BASE = ["assign", "access", "hex"]
SPAN = "struct<start:long,kind_no:int,kind:string,stop:long>"


#: Elements that a running value is carried over at a time.
CHUNK = 128


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once: what stands in a lambda is worked out for each element."""
    return F.transform(F.array(value), use)[0]


def _chunks(values: Column) -> Column:
    """Stretches of CHUNK elements of a bound array that isn't empty."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / CHUNK).cast("int")), lambda j: F.slice(values, j * CHUNK + 1, F.lit(CHUNK)))


def before(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """op over all longs before each one, from 0, of an array that isn't empty.

    A list that grows in an aggregate is copied at each step; here none grows beyond a chunk, or the number of chunks.
    """
    zero = F.lit(0).cast("long")
    walk = lambda xs, start: F.slice(F.aggregate(xs, F.array(start), lambda acc, x: F.concat(acc, F.array(op(F.element_at(acc, -1), x)))), F.lit(1), F.size(xs))
    return let(let(values, _chunks), lambda cs: let(walk(F.transform(cs, lambda c: F.aggregate(c, zero, lambda x, y: op(x, y))), zero), lambda starts: F.flatten(F.transform(cs, lambda c, j: walk(c, starts[j])))))


def spans_of(text: Column, number: int) -> Column:
    """Spans of one rule, left to right: the matches whose measured group is long enough."""
    kind, _, pattern, least = RULES[number]
    marked = F.regexp_replace(text, pattern, f"{OPEN}$1{CLOSE}$2{OPEN}")
    # parts: outside, head, tail, outside, head, tail, ..., outside; head and tail are the groups of a match
    parts = F.split(F.translate(marked, CLOSE, OPEN), OPEN)
    size = lambda part: F.char_length(part).cast("long")

    def placed(p: Column) -> Column:
        last = F.floor((F.size(p) - 1) / 3).cast("int") - 1
        sizes = F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(size(p[k * 3]).alias("outside"), (size(p[k * 3 + 1]) + size(p[k * 3 + 2])).alias("match"), size(p[k * 3 + 2]).alias("tail")))
        return let(sizes, lambda m: let(before(F.transform(m, lambda s: s["outside"] + s["match"]), lambda x, y: x + y), lambda at: F.filter(F.transform(m, lambda s, k: span(s, at[k])), lambda s: s["tail"] >= least)))

    def span(s: Column, at: Column) -> Column:
        start = at + s["outside"]
        return F.struct(start.alias("start"), F.lit(number).alias("kind_no"), F.lit(kind).alias("kind"), (start + s["match"]).alias("stop"), s["tail"].alias("tail"))

    found = F.transform(let(parts, placed), lambda s: F.struct(*(s[c].alias(c) for c in ("start", "kind_no", "kind", "stop"))))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def rule_names(rules: list[tuple] | None = None) -> list[str]:
    return [f"{kind}:{version}" for kind, version, _, _ in rules or RULES]


def find_spans(text: Column, wanted: Column | None = None) -> Column:
    """All spans of a text, by start, then rule order; of the wanted rules only, where these are given."""
    plain = F.translate(F.coalesce(text, F.lit("")), OPEN + CLOSE, OTHER * 2)
    none = F.array().cast(f"array<{SPAN}>")
    one = lambda n, name: spans_of(plain, n) if wanted is None else F.when(F.array_contains(wanted, name), spans_of(plain, n)).otherwise(none)
    return F.array_sort(F.concat(*(one(n, name) for n, name in enumerate(rule_names()))))


def blob_name(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Ledger rows to add: blob, rules (those that scanned it now), spans. Only pairs of blob and rule version that the ledger lacks are scanned.

    Copies are folded on the map side, and blobs that all rules have seen leave before their text is looked at.
    """
    text = F.col("text").cast("string")
    blobs = docs.select(blob_name(text).alias("blob"), F.coalesce(text, F.lit("")).alias("text")).dropDuplicates(["blob"])
    every = F.array(*map(F.lit, rule_names()))
    if ledger is None:
        return blobs.select("blob", every.alias("rules"), find_spans(F.col("text")).alias("spans"))
    seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("seen"))
    unseen = blobs.join(seen, "blob", "left").withColumn("rules", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>"))))
    return unseen.where(F.size("rules") > 0).select("blob", "rules", find_spans(F.col("text"), F.col("rules")).alias("spans"))


def update_ledger(docs: DataFrame, path: str) -> DataFrame:
    """The ledger table at path (Parquet, made if it isn't there) after a scan of docs; what the scan finds is appended."""
    spark = docs.sparkSession
    schema = f"blob string, rules array<string>, spans array<{SPAN}>"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    scan(docs, spark.read.schema(schema).parquet(path) if there else None).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _told(ledger: DataFrame) -> DataFrame:
    """blob, spans of the rules in use. Blobs without findings aren't sent along: absence means none."""
    now = F.create_map(*(F.lit(x) for name in rule_names() for x in (name.split(":")[0], name)))
    spans = F.filter("spans", lambda s: F.array_contains("rules", F.try_element_at(now, s["kind"])))
    rows = ledger.where(F.size("spans") > 0).select("blob", spans.alias("spans")).where(F.size("spans") > 0)
    return rows.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))


def findings(docs: DataFrame, ledger: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys (what tells a path or a version of one), blob, spans of every row of docs."""
    paths = docs.select(*keys, blob_name(F.col("text").cast("string")).alias("blob"))
    return paths.join(_told(ledger), "blob", "left").select(*keys, "blob", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:stop of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """docs with each secret span that the ledger tells replaced by its kind in brackets (overlapping spans by the first's); other columns as they were.

    Without a ledger docs are scanned into a new one first.
    """
    ledger = scan(docs) if ledger is None else ledger
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), blob_name(F.col("text").cast("string")).alias("blob"))
    joined = whole.join(_told(ledger), "blob", "left")
    text = F.col("row")["text"].cast("string")
    cut = lambda t, start, stop: F.substring(t, (start + 1).cast("int"), (stop - start).cast("int"))

    def marked(c: Column) -> Column:
        """Text from the first free place before a chunk's spans to the one before its last: cut out once, as a place is found by walking to it."""
        base = c[0]["free"]
        kept = lambda t: F.transform(F.filter(c, lambda s: s["start"] >= s["free"]), lambda s: F.concat(cut(t, s["free"] - base, s["start"] - base), F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return let(cut(text, base, F.greatest(F.element_at(c, -1)["start"], base)), lambda t: F.array_join(kept(t), ""))

    # free: where the spans before end
    free = before(F.transform("spans", lambda s: s["stop"]), F.greatest)
    spans = let(free, lambda f: F.transform("spans", lambda s, k: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), f[k].alias("free"))))
    rest = F.substring(text, (F.array_max(F.transform("spans", lambda s: s["stop"])) + 1).cast("int"), F.lit(2147483647))
    clean = F.concat(F.array_join(F.transform(let(spans, _chunks), marked), ""), rest)
    told = F.when(F.col("spans").isNotNull(), clean).otherwise(text)
    return joined.select(*(told.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))


def oracle_sql() -> str:
    """The findings of a whole scan as SQL: matches marked, parts split, positions by running lengths."""

    def parts(number: int) -> str:
        kind, _, pattern, least = RULES[number]
        p = "'" + pattern.replace("'", "''") + "'"
        marked = f"replace(regexp_replace(t, {p}, chr(1)||'\\1'||chr(2)||'\\2'||chr(1), 'g'), chr(2), chr(1))"
        return f"select rid, {number} kind_no, '{kind}' kind, {least} least_n, string_split({marked}, chr(1)) parts from d where regexp_matches(t, {p})"

    base = ", ".join(f"'{k}'" for k in BASE)
    counts = ", ".join(f"count(*) filter (where kind = '{k}') n_{k}" for k in BASE)
    one = "kind||':'||a||':'||b"
    return f"""with d as (select row_number() over () rid, doc_id, replace(replace(coalesce("text", ''), chr(1), chr(3)), chr(2), chr(3)) t from documents),
 m as ({' union all '.join(map(parts, range(len(RULES))))}),
 u as (select rid, kind_no, kind, least_n, unnest(parts) p, generate_subscripts(parts, 1) i from m),
 c as (select *, length(p) n, (sum(length(p)) over (partition by rid, kind_no order by i rows unbounded preceding))::bigint b from u),
 s as (select *, lag(b - n) over (partition by rid, kind_no order by i) a from c),
 g as (select rid, {counts}, string_agg({one}, ',' order by a, kind_no) filter (where kind in ({base})) base, string_agg({one}, ',' order by a, kind_no) spans from s where i % 3 = 0 and n >= least_n group by rid)
 select doc_id, {', '.join(f'coalesce(n_{k}, 0) n_{k}' for k in BASE)}, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans from d left join g using (rid)"""
