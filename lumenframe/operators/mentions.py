"""Which district a text reports from: names with a locative ending, told apart by the province that the text names.

The possible names of a text are taken from it in one pass and equi-joined to the gazetteer, so
neither the number of districts nor that of texts meets the other as a product. A name of several
provinces stands for the one that the text names, if it names just one that has it; else it stays
several. A text with more than one district left is a roundup and gets none.

Defined cases: a null text mentions nothing; a null name or one of GENERIC never does; rows of the
gazetteer that repeat count once; texts that repeat keep their own rows by id (a null id gives no row).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import matching
from ..functions.text import turkish_lower
from .durable import keep
from .spatial import small

# Names that are no places in running text.
GENERIC = ["merkez"]


def mentioned_districts(texts: DataFrame, districts: DataFrame, text_id: str, text: str, provinces: str) -> DataFrame:
    """text_id, district_id, province of each district that a text mentions, homonyms narrowed.

    texts: text_id, text, provinces (array of the provinces it names); districts: district_id, name, province.
    """
    named = _names(districts)
    return _narrowed(_told(texts, named, text_id, text, provinces), named, text_id)


def _names(districts: DataFrame) -> DataFrame:
    named = districts.where("district_id is not null and name is not null").select("district_id", "province", turkish_lower("name").alias("_name"), turkish_lower("province").alias("_province"))
    return named.where(~F.col("_name").isin(GENERIC)).distinct()


def _told(texts: DataFrame, named: DataFrame, text_id: str, text: str, provinces: str) -> DataFrame:
    """Id, provinces and possible names of each text, kept, as that is the one time that texts are read."""
    most = named.agg(F.max(F.size(F.split("_name", " ")))).first()[0] or 1
    names = matching.let(turkish_lower(F.coalesce(text, F.lit(""))), lambda low: matching.located_names(low, most))
    return keep(texts.select(F.col(text_id), F.col(provinces).alias("_provinces"), names.alias("_names")))


def _narrowed(told: DataFrame, named: DataFrame, text_id: str) -> DataFrame:
    told = told.where(F.col(text_id).isNotNull()).select(text_id, "_provinces", F.explode("_names").alias("_name"))
    found = told.join(small(named), "_name").select(text_id, "_provinces", "district_id", "province", "_province").distinct()
    one = F.when(F.size("_provinces") == 1, turkish_lower(F.element_at("_provinces", 1)))
    marked = found.withColumn("_there", F.coalesce(F.col("_province") == one, F.lit(False)))
    # a text mentions few districts, so what says whether any lies in its province is small
    there = marked.where("_there").select(text_id).distinct().withColumn("_any", F.lit(True))
    return marked.join(there, text_id, "left").where(F.col("_any").isNull() | F.col("_there")).select(text_id, "district_id", "province")


def single_district(texts: DataFrame, districts: DataFrame, text_id: str, text: str, provinces: str) -> DataFrame:
    """text_id, mentions (districts left), district_id (null unless it is one), place: district, ambiguous_district, province_only or no_place, for every text."""
    named = _names(districts)
    told = _told(texts, named, text_id, text, provinces)
    met = _narrowed(told, named, text_id).groupBy(text_id).agg(F.countDistinct("district_id").alias("mentions"), F.min("district_id").alias("only"))
    n = F.coalesce("mentions", F.lit(0))
    return told.select(text_id, "_provinces").join(met, text_id, "left").select(
        text_id, n.cast("long").alias("mentions"), F.when(n == 1, F.col("only")).alias("district_id"),
        F.when(n == 1, "district").when(n > 1, "ambiguous_district").when(F.size("_provinces") == 1, "province_only").otherwise("no_place").alias("place"),
    )


def sighting_gate(reason: Column, claimed_state: Column, place: Column) -> Column:
    """Where a report stops before a sighting: irrelevant, status_claim_excluded, ambiguous_district, province_only or no_place; pass if nowhere."""
    return (
        F.when(~F.coalesce(reason == "vegetation_fire", F.lit(False)), "irrelevant")
        .when(F.coalesce(claimed_state != "ongoing", F.lit(False)), "status_claim_excluded").when(place == "district", "pass").otherwise(place)
    )
