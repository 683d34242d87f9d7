"""Writes as DataFrame transforms: a target and a change go in, the next version of the target comes out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def insert_ignore(target: DataFrame, incoming: DataFrame, key: list[str], order: list[Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(next target, rows really inserted). A key takes one incoming row: the first by `order`, any without it."""
    if order:
        one = incoming.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")
    else:
        one = incoming.dropDuplicates(key)
    fresh = one.join(target.select(*key), key, "left_anti")
    return target.unionByName(fresh, allowMissingColumns=True), fresh


def upsert(target: DataFrame, incoming: DataFrame, key: list[str], keep_old_where_null: bool = True) -> DataFrame:
    """Insert or update on conflict; a null in the incoming row keeps the old value unless told otherwise. Keys are unique on both sides."""
    old, new = target.alias("o"), incoming.alias("n")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key]
    met = F.col("n._new").isNotNull()
    cols = []
    for c in target.columns:
        if c not in incoming.columns:
            cols.append(F.col(f"o.{c}"))
        elif c in key or keep_old_where_null:
            cols.append(F.coalesce(f"n.{c}", f"o.{c}").alias(c))
        else:
            cols.append(F.when(met, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return old.join(incoming.withColumn("_new", F.lit(1)).alias("n"), on, "full_outer").select(*cols)


def changed_only(target: DataFrame, incoming: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Incoming rows that differ from the target in one of the columns, nulls compared as values; unknown keys don't count."""
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}"))
    return incoming.alias("n").join(target.alias("o"), [F.col(f"n.{k}") == F.col(f"o.{k}") for k in key]).where(differs).select("n.*")


def undo_log(target: DataFrame, incoming: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Key with old_* and new_* of every row the update would change."""
    both = changed_only(target, incoming, key, columns).alias("n").join(target.alias("o"), [F.col(f"n.{k}") == F.col(f"o.{k}") for k in key])
    return both.select(*(F.col(f"n.{k}") for k in key), *(F.col(f"{s}.{c}").alias(f"{w}_{c}") for c in columns for s, w in (("o", "old"), ("n", "new"))))


def patch(target: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Update of only the provided (non-null) fields; keys unknown to the target are ignored."""
    c, cols = changes.alias("c"), changes.columns
    return target.alias("t").join(c, F.col(f"t.{key}") == F.col(f"c.{key}"), "left").select(*(F.coalesce(f"c.{x}", f"t.{x}").alias(x) if x in cols and x != key else F.col(f"t.{x}") for x in target.columns))


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Writes df over just the partitions it holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def seed(children: DataFrame, parents: DataFrame, child_key: Column, parent_key: Column, parent_id: str) -> DataFrame:
    """children with their parent's id, all or nothing: ValueError if any has no parent."""
    p = parents.select(parent_key.alias("_k"), F.col(parent_id))
    c = children.withColumn("_k", child_key)
    lost = c.join(p, "_k", "left_anti")
    if not lost.isEmpty():
        raise ValueError(f"rows without a parent: {[r['_k'] for r in lost.select('_k').limit(5).collect()]}")
    return c.join(p, "_k").drop("_k")


def scrub(df: DataFrame, column: str, cleaned: Column) -> DataFrame:
    """Rows whose column the cleaning changes, with the cleaned value; the rest need no write."""
    return df.withColumn("_clean", cleaned).where(~F.col("_clean").eqNullSafe(F.col(column))).withColumn(column, F.col("_clean")).drop("_clean")


def latest_with_previous(df: DataFrame, key: str, at: str, value: str, tie: str) -> DataFrame:
    """Latest row per key (ties: highest `tie`), and the value of the latest row strictly before its time."""
    newest = Window.partitionBy(key).orderBy(F.desc(at), F.desc(tie))
    top = F.max(at).over(Window.partitionBy(key))
    ranked = df.withColumn("_n", F.row_number().over(newest)).withColumn("_top", top)
    before = ranked.where(F.col(at) < F.col("_top")).groupBy(key).agg(F.max_by(value, F.struct(at, tie)).alias(f"previous_{value}"))
    return ranked.where("_n = 1").drop("_n", "_top").join(before, key, "left")


def first_acceptable_source(counts: DataFrame, name: str, rows: str, rank: str, enough: int = 10) -> DataFrame:
    """The source to use: the first in order with enough rows, else the one with most; none of zero rows."""
    good = F.col(rows) >= enough
    order = Window.orderBy(F.desc(good), F.when(good, F.col(rank)).otherwise(-F.col(rows)), F.col(rank))
    return counts.where(F.col(rows) > 0).withColumn("_n", F.row_number().over(order)).where("_n = 1").select(name, rows)


def retention(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that no rule removes, removed rows per rule; a row counts for the first rule that takes it)."""
    hit = F.lit(None).cast("string")
    for name, condition in reversed(rules.items()):
        hit = F.when(F.coalesce(condition, F.lit(False)), name).otherwise(hit)
    tagged = df.withColumn("_rule", hit)
    return tagged.where(F.col("_rule").isNull()).drop("_rule"), tagged.where(F.col("_rule").isNotNull()).groupBy(F.col("_rule").alias("rule")).count()
