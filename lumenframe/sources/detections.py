"""Detection files of several products: one reader per header, one shape out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import geo, rules

#: The study area's box (south, north, west, east).
AREA = (35.8, 42.2, 25.6, 44.8)


def read_product(spark: SparkSession, path: str, product: str) -> DataFrame:
    """A product's CSV with the header's names lower-cased and trimmed, all text, unquoted; the product is a column."""
    raw = spark.read.option("header", True).option("quote", "").option("mode", "PERMISSIVE").csv(path)
    return raw.toDF(*(c.strip().lower() for c in raw.columns)).withColumn("product", F.lit(product))


def union_products(frames: list[DataFrame]) -> DataFrame:
    """Products with different columns side by side; a missing column is null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def normalise(raw: DataFrame) -> DataFrame:
    """Typed detections, with valid (has place, time and confidence) and inside (the area's box) flags; no row is lost here."""
    has = lambda *names: [F.col(n) for n in names if n in raw.columns] or [F.lit(None).cast("string")]
    number = lambda *names: F.coalesce(*(rules.safe_number(c) for c in has(*names)))
    out = raw.select(
        "product", number("latitude").alias("lat"), number("longitude").alias("lng"),
        rules.hhmm_timestamp(has("acq_date")[0], has("acq_time")[0]).alias("acquired_at"),
        F.coalesce(*has("confidence")).alias("confidence"), rules.confidence_tier(F.coalesce(*has("confidence"))).alias("tier"),
        number("frp").alias("frp"), number("bright_ti4", "brightness").alias("brightness"), number("bright_ti5", "bright_t31").alias("brightness_2"),
        number("scan").alias("scan_km"), number("track").alias("track_km"), F.coalesce(*has("satellite")).alias("satellite"), F.coalesce(*has("daynight")).alias("daynight"),
    )
    valid = F.col("lat").isNotNull() & F.col("lng").isNotNull() & F.col("acquired_at").isNotNull() & (F.trim("confidence") != "")
    return out.withColumn("valid", F.coalesce(valid, F.lit(False))).withColumn("inside", F.coalesce(geo.in_box("lat", "lng", *AREA), F.lit(False)))


NATURAL_KEY = ["product", "acquired_at", "lat", "lng"]


def ingest(normal: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new rows, one row of counts per product: fetched, malformed, outside, duplicates, inserted)."""
    good = normal.where("valid and inside").drop("valid", "inside")
    fresh = good.dropDuplicates(NATURAL_KEY).join(known.select(*NATURAL_KEY), NATURAL_KEY, "left_anti")
    seen = normal.groupBy("product").agg(
        F.count("*").alias("fetched"), F.sum(F.when(~F.col("valid"), 1).otherwise(0)).alias("malformed"), F.sum(F.when(F.col("valid") & ~F.col("inside"), 1).otherwise(0)).alias("outside")
    )
    kept = fresh.groupBy("product").agg(F.count("*").alias("inserted"))
    counts = seen.join(kept, "product", "left").withColumn("inserted", F.coalesce("inserted", F.lit(0)))
    return fresh, counts.withColumn("duplicates", F.col("fetched") - F.col("malformed") - F.col("outside") - F.col("inserted"))
