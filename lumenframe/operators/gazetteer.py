"""Names of shapes matched to a gazetteer by stages: as written, folded to ASCII, by alias, by what stands before "merkez", as the bare province.

Every spelling a shape may be found under becomes a row with its stage, and all of them meet the
gazetteer in one equi-join on province, kind of spelling and spelling, in which only spellings that
one district has are left; the earliest stage that hits decides. A district that several shapes
hit is in conflict and goes to none of them.

Letters are lowered the Turkish way and everything else is taken out of names, which come composed (NFC).
Defined cases: a null name or province, or a name without letters, matches nothing; gazetteer
rows that repeat an id and a name count once; shapes that repeat an id count once if they are alike; an
empty gazetteer matches nothing; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import C, _c, turkish_lower

# Circumflexes taken off, letters folded to ASCII, endings that stand for a centre, other spellings.
CIRCUMFLEX, PLAIN = "âîû", "aiu"
TURKISH, ASCII = "çğıöşü", "cgiosu"
CENTRE_ENDING = r"(?i)\s*(\(\s*merkez(\s+[iİ]lçe)?\s*\)|merkezi|merkez(\s+[iİ]lçe)?|district)\s*$"
CENTRE = "merkez"
ALIASES = {"imbros": "gökçeada", "princeislands": "adalar", "karakeçeli": "karakeçili"}


def letters(name: C) -> Column:
    """Lower-case letters of a name, circumflexes taken off; null for none."""
    return F.nullif(F.regexp_replace(F.translate(turkish_lower(name), CIRCUMFLEX, PLAIN), f"[^a-z{TURKISH}]", ""), F.lit(""))


def folded(name: Column) -> Column:
    return F.translate(name, TURKISH, ASCII)


def before_centre(name: C) -> Column:
    """What stands before an ending that means the centre; null without one, or where nothing does."""
    base = F.regexp_replace(_c(name), CENTRE_ENDING, "")
    return F.when(_c(name).rlike(CENTRE_ENDING) & (base != ""), F.trim(base))


def _unique(districts: DataFrame) -> DataFrame:
    """_province, _kind, _key, district_id of the spellings that one district of a province has."""
    told = districts.where("district_id is not null").select("district_id", letters("province").alias("p"), letters("name").alias("n")).where("p is not null and n is not null").distinct()
    kinds = F.explode(F.array(F.struct(F.lit("written").alias("kind"), F.col("n").alias("key")), F.struct(F.lit("folded").alias("kind"), folded(F.col("n")).alias("key"))))
    spelt = told.select("p", "district_id", kinds.alias("s")).groupBy(F.col("p").alias("_province"), F.col("s.kind").alias("_kind"), F.col("s.key").alias("_key"))
    return spelt.agg(F.count("*").alias("n"), F.min("district_id").alias("district_id")).where("n = 1").drop("n")


def matched_shapes(shapes: DataFrame, districts: DataFrame, aliases: Mapping[str, str] = ALIASES) -> DataFrame:
    """shape_id, district_id, stage (exact, folded, alias, centre, bare_province) and conflict: district_id is null where nothing matches or several shapes want it.

    shapes: shape_id, name, province; districts: district_id, name, province.
    """
    told = shapes.where("shape_id is not null").select("shape_id", letters("name").alias("raw"), letters("province").alias("p"), letters(before_centre("name")).alias("base")).distinct()
    alias = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))[F.col("raw")] if aliases else F.lit(None).cast("string")
    is_province = lambda c: (F.col(c) == F.col("p")) | (folded(F.col(c)) == folded(F.col("p")))
    way = lambda order, stage, kind, key, when=None: F.struct(F.lit(order).alias("order"), F.lit(stage).alias("stage"), F.lit(kind).alias("kind"), (key if when is None else F.when(when, key)).alias("key"))
    base = F.col("base")
    ways = F.array(
        way(1, "exact", "written", F.col("raw")), way(2, "folded", "folded", folded(F.col("raw"))), way(3, "alias", "written", alias),
        way(4, "centre", "written", F.lit(CENTRE), is_province("base")), way(5, "centre", "written", base, ~is_province("base")), way(6, "centre", "folded", folded(base), ~is_province("base")),
        way(7, "bare_province", "written", F.lit(CENTRE), is_province("raw")),
    )
    asked = told.select("shape_id", F.col("p").alias("_province"), F.explode(F.filter(ways, lambda w: w["key"].isNotNull())).alias("w")).select("shape_id", "_province", F.col("w.kind").alias("_kind"), F.col("w.key").alias("_key"), "w.order", "w.stage")
    hits = asked.join(_unique(districts), ["_province", "_kind", "_key"])
    best = hits.groupBy("shape_id").agg(F.min(F.struct("order", "stage", "district_id")).alias("b")).select("shape_id", "b.stage", F.col("b.district_id").alias("hit"))
    wanted = best.groupBy("hit").agg(F.count("*").alias("wanted"))
    sole = best.join(wanted, "hit").select("shape_id", "stage", F.when(F.col("wanted") == 1, F.col("hit")).alias("district_id"), (F.col("wanted") > 1).alias("conflict"))
    return told.select("shape_id").distinct().join(sole, "shape_id", "left").select("shape_id", "district_id", "stage", F.coalesce("conflict", F.lit(False)).alias("conflict"))
