"""Readers of weather, news, page, shape and raster payloads held in text or binary columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

CURRENT = "struct<current:struct<temperature_2m:double,relative_humidity_2m:double,wind_speed_10m:double,wind_direction_10m:double>>"
SERIES = "struct<properties:struct<timeseries:array<struct<time:string,data:struct<instant:struct<details:struct<air_temperature:double,relative_humidity:double,wind_speed:double,wind_from_direction:double>>>>>>>"


def _reading(t: Column, h: Column, w: Column, d: Column) -> Column:
    return F.struct(t.alias("temperature"), h.alias("humidity"), w.alias("wind"), d.alias("wind_direction"))


def current_weather(body: str | Column) -> Column:
    """Reading of a body with a current block; null unless temperature, humidity and wind are there."""
    c = F.from_json(body, CURRENT)["current"]
    whole = c["temperature_2m"].isNotNull() & c["relative_humidity_2m"].isNotNull() & c["wind_speed_10m"].isNotNull()
    return F.when(whole, _reading(c["temperature_2m"], c["relative_humidity_2m"], c["wind_speed_10m"], c["wind_direction_10m"]))


def series_weather(body: str | Column, as_of: Column, max_hours: float = 3.0) -> Column:
    """Reading of the time step nearest to as_of (the first on ties), m/s made km/h; null beyond max_hours."""
    steps = F.from_json(body, SERIES)["properties"]["timeseries"]
    gap = lambda s: F.abs(F.unix_micros(F.try_to_timestamp(s["time"])) - F.unix_micros(as_of))
    timed = F.filter(F.transform(steps, lambda s, i: F.struct(gap(s).alias("gap"), i.alias("i"), s["data"]["instant"]["details"].alias("d"))), lambda s: s["gap"].isNotNull())
    best = F.array_min(F.transform(timed, lambda s: F.struct(s["gap"].alias("gap"), s["i"].alias("i"), s["d"].alias("d"))))
    d = best["d"]
    return F.when(best["gap"] <= int(max_hours * 3.6e9), _reading(d["air_temperature"], d["relative_humidity"], d["wind_speed"] * 3.6, d["wind_from_direction"]))


def with_fallback(points: DataFrame, first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """points with the first provider's reading, else the second's, and which it was."""
    a, b = first.select(key, F.col("reading").alias("_a")), second.select(key, F.col("reading").alias("_b"))
    return points.join(a, key, "left").join(b, key, "left").withColumn("reading", F.coalesce("_a", "_b")).withColumn("provider", F.when(F.col("_a").isNotNull(), 1).when(F.col("_b").isNotNull(), 2)).drop("_a", "_b")


def cells_to_fetch(queue: DataFrame, cell: str, order: list[Column], cached: DataFrame, as_of: Column, ttl_hours: float = 1.0, batch: int = 50, budget: int = 3000, used: int = 0) -> DataFrame:
    """Distinct cells in queue order that no live cache entry covers, with their batch, as far as the day's budget goes."""
    live = cached.where(F.col("read_at") > as_of - F.make_dt_interval(F.lit(0), F.lit(int(ttl_hours)))).select(cell)
    todo = queue.join(live, cell, "left_anti").withColumn("_k", F.struct(*order)).groupBy(cell).agg(F.min("_k").alias("_k"))
    left = max(0, budget - used)
    ranked = todo.orderBy("_k").limit(left).agg(F.array_sort(F.collect_list(F.struct("_k", cell))).alias("q"))  # at most the budget's cells
    return ranked.select(F.posexplode("q").alias("i", "s")).select(F.col(f"s.{cell}").alias(cell), F.floor(F.col("i") / batch).alias("batch"))


def rss_items(df: DataFrame, body: str, feed: str) -> DataFrame:
    """feed, title, link, summary, published_at of every item of an RSS body, one item or many."""
    item = "struct<title:string,link:string,description:string,pubDate:string>"
    parsed = F.from_xml(F.col(body), f"struct<channel:struct<item:array<{item}>>>")
    rows = df.select(feed, F.explode(parsed["channel"]["item"]).alias("i"))
    when = F.try_to_timestamp(F.regexp_replace("i.pubDate", r"^\w{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss Z"))
    return rows.select(feed, "i.title", "i.link", F.col("i.description").alias("summary"), when.alias("published_at")).where(F.col("title").isNotNull())


def search_articles(df: DataFrame, body: str, blocked_domains: list[str]) -> DataFrame:
    """Articles of a news-search body: compact time stamps parsed, blocked domains (and their subdomains) left out."""
    parsed = F.from_json(body, "struct<articles:array<struct<url:string,title:string,seendate:string,domain:string>>>")["articles"]
    rows = df.select(F.explode(parsed).alias("a")).select("a.url", "a.title", "a.domain", F.try_to_timestamp("a.seendate", F.lit("yyyyMMdd'T'HHmmss'Z'")).alias("published_at"))
    out = F.lit(False)
    for d in blocked_domains:
        out = out | (F.col("domain") == d) | F.col("domain").endswith("." + d)
    return rows.where(~F.coalesce(out, F.lit(False)))


def page_cards(df: DataFrame, html: str, pattern: str, names: list[str]) -> DataFrame:
    """Cards of HTML pages: each match of the pattern with one group per name (no nested groups)."""
    groups = [F.regexp_extract_all(html, F.lit(pattern), F.lit(k + 1)) for k in range(len(names))]
    return df.withColumn("card", F.explode(F.arrays_zip(*(g.alias(n) for g, n in zip(groups, names))))).select(*df.columns, *(F.col(f"card.{n}").alias(n) for n in names))


def page_links(df: DataFrame, html: str) -> DataFrame:
    """href and text of each anchor of HTML pages."""
    return page_cards(df, html, r'<a[^>]*\bhref="([^"]*)"[^>]*>([^<]*)</a>', ["href", "anchor"])


def geojson_rings(body: str | Column) -> Column:
    """Rings of a Polygon or MultiPolygon geometry, each an array of [lng, lat]; parity makes holes of inner ones."""
    kind = F.get_json_object(body, "$.type")
    coords = F.get_json_object(body, "$.coordinates")
    one, many = F.from_json(coords, "array<array<array<double>>>"), F.from_json(coords, "array<array<array<array<double>>>>")
    return F.when(kind == "Polygon", one).when(kind == "MultiPolygon", F.flatten(many))


def geojson_features(df: DataFrame, lat: str, lng: str, properties: list[str], digits: int = 4) -> DataFrame:
    """One GeoJSON feature per row as text; rows without a place are dropped."""
    point = F.struct(F.lit("Point").alias("type"), F.array(F.round(lng, digits), F.round(lat, digits)).alias("coordinates"))
    return df.where(F.col(lat).isNotNull() & F.col(lng).isNotNull()).select(F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*properties).alias("properties"))).alias("feature"))


def burn_pixels(tiles: DataFrame, values: str, width: str) -> DataFrame:
    """Rows of a tile's row-major values: row, col, value and its kind (burned day 1..366, skipped 0/-1/-2, unexpected)."""
    keep = [c for c in tiles.columns if c not in (values,)]
    v = F.col("value")
    kind = F.when(v.between(1, 366), "burned").when(v.isin(0, -1, -2), "skipped").otherwise("unexpected")
    return tiles.select(*keep, F.posexplode(values).alias("_i", "value")).select(*(c for c in keep if c != width), F.floor(F.col("_i") / F.col(width)).cast("long").alias("row"), (F.col("_i") % F.col(width)).cast("long").alias("col"), "value", kind.alias("kind"))


def track_elements(body: str | Column, name: str) -> Column:
    """The two element lines that follow an object's name line in a text of such triples; null if it isn't there."""
    lines = F.transform(F.split(body, r"\r?\n"), lambda x: F.rtrim(x))
    at = F.array_position(lines, F.lit(name))
    return F.when(at > 0, F.slice(lines, (at + 1).cast("int"), 2))


def bundle_file(name: str | Column) -> Column:
    """product, year and day (as a date) of a bundle's file name like PRODUCT_..._doy2021244...; null parts if it differs."""
    c = F.col(name) if isinstance(name, str) else name
    year, day = F.regexp_extract(c, r"doy(\d{4})(\d{3})", 1).try_cast("int"), F.regexp_extract(c, r"doy(\d{4})(\d{3})", 2).try_cast("int")
    return F.struct(F.nullif(F.regexp_extract(c, r"^([A-Za-z0-9]+)", 1), F.lit("")).alias("product"), F.date_add(F.make_date(year, F.lit(1), F.lit(1)), day - 1).alias("date"))
