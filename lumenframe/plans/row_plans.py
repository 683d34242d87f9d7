"""Parsing, predicates, scores, text rules and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, rules, text, times
from ..operators import reporting, state
from ..sources import feeds
from ..operators.durable import cut
from ..sources.tables import table
from .stand_ins import AS_OF, CENTRES, DET, PLACES, centres, detections, places, secs

# Region boxes tried in order, as (key, south, north, west, east).
REGIONS = [
    ("ege", 36.5, 39.5, 26.0, 30.5), ("akdeniz", 36.0, 38.5, 29.5, 37.0), ("marmara", 39.5, 42.0, 26.0, 32.0), ("karadeniz", 40.5, 42.2, -180.0, 180.0),
    ("ic_anadolu", 38.0, 41.0, 30.0, 37.5), ("dogu_anadolu", 38.0, 42.0, 37.5, 44.8), ("guneydogu_anadolu", 36.0, 38.5, 36.0, 44.8),
]
# Words for the rule engines over the test documents.
MUST, BLOCKED, TITLE = ["the", "que", "der "], ["idiot", "###"], ["license"]
TAGS = [("legal", ["license", "rights"]), ("iberian", ["ción"]), ("german", ["keit", "lich"]), ("french", ["eaux", "ment"])]


def parsed_times(spark, sf):
    """Unpadded clock texts, good and bad, made from event ids."""
    d = detections(spark, sf)
    t = F.when(F.col("event_id") % 7 == 0, "").when(F.col("event_id") % 7 == 1, "9x9").otherwise((F.col("event_id") % 2500).cast("string"))
    day = F.when(F.col("event_id") % 11 == 0, "2024/01/05").when(F.col("event_id") % 11 == 1, "2024-02-30").otherwise(F.date_format("acquired_at", "yyyy-MM-dd"))
    conf = F.element_at(F.array(*map(F.lit, ["high", "n", "low", "85", "30", "29", "H", "nominal", "x1"])), (F.col("event_id") % 9 + 1).cast("int"))
    num = F.element_at(F.array(*map(F.lit, [" 1.5 ", "", "abc", "NaN", "-3e2"])), (F.col("event_id") % 5 + 1).cast("int"))
    return d.select("event_id", F.floor(F.unix_micros(rules.hhmm_timestamp(day, t)) / 1_000_000).cast("long").alias("at"), rules.confidence_tier(conf).alias("tier"), rules.safe_number(num).alias("number"))


PARSED_SQL = f"""with {DET}, x as (select *, case event_id%7 when 0 then '' when 1 then '9x9' else (event_id%2500)::varchar end t, case event_id%11 when 0 then '2024/01/05' when 1 then '2024-02-30' else strftime(acquired_at,'%Y-%m-%d') end d,
 ['high','n','low','85','30','29','H','nominal','x1'][event_id%9+1] c, [' 1.5 ','','abc','NaN','-3e2'][event_id%5+1] n from det),
 y as (select *, lpad(t,4,'0') p from x)
 select event_id, case when regexp_full_match(d,'[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') and regexp_full_match(t,'[0-9]{{1,4}}') and substr(p,1,2)<'24' and substr(p,3,2)<'60' then epoch(try_cast(d||' '||substr(p,1,2)||':'||substr(p,3,2)||':00' as timestamp))::bigint end "at",
 case when regexp_full_match(c,'[0-9]+') then case when c::int>=80 then 'high' when c::int>=30 then 'nominal' else 'low' end when lower(c)='high' or lower(c)='h' then 'high' when lower(c)='nominal' or lower(c)='n' then 'nominal' else 'low' end tier,
 case when isfinite(try_cast(nullif(trim(n),'') as double)) then try_cast(trim(n) as double) end number from y"""


def regions(spark, sf):
    d = detections(spark, sf)
    by_box = geo.first_box("lat", "lng", REGIONS)
    named = F.when(F.col("event_id") % 3 == 0, F.lit("dogu_anadolu"))
    km = geo.haversine_km("lat", "lng", F.lit(39.0), F.lit(35.0))
    inside = F.when(F.col("event_id") % 4 == 0, F.lit(None)).otherwise(F.col("event_id") % 4 == 1)
    return d.select("event_id", by_box.alias("box"), F.coalesce(named, by_box).alias("region"), rules.gate(inside, km).alias("passes"), F.coalesce(geo.in_box("lat", "lng", 35.8, 42.2, 25.6, 44.8), F.lit(False)).alias("in_area"))


_BOX_SQL = "coalesce(" + ",".join(f"case when lat between {s} and {n} and lng between {w} and {e} then '{k}' end" for k, s, n, w, e in REGIONS) + ")"
REGIONS_SQL = f"""with {DET} select event_id, {_BOX_SQL} box, coalesce(case when event_id%3=0 then 'dogu_anadolu' end, {_BOX_SQL}) region,
 coalesce(case when event_id%4=0 then null else event_id%4=1 end, {geo.haversine_sql('lat', 'lng', '39.0e0', '35.0e0')}<=250) passes, lat between 35.8 and 42.2 and lng between 25.6 and 44.8 in_area from det"""


def _weather(d):
    return d.withColumn("temperature", (F.col("event_id") % 460) / 10.0).withColumn("humidity", (F.col("event_id") * 7 % 1000) / 10.0).withColumn("wind", (F.col("event_id") * 3 % 800) / 10.0).withColumn("fires", F.when(F.col("event_id") % 6 == 0, F.lit(None)).otherwise(F.col("event_id") % 13))


_WEATHER_SQL = f"{DET}, wx as (select *, (event_id%460)/10.0e0 t, (event_id*7%1000)/10.0e0 h, (event_id*3%800)/10.0e0 w, case when event_id%6=0 then null else event_id%13 end f from det)"
_SCORE_SQL = """least(100, (case when t>=40 then 30 when t>=35 then 22 when t>=30 then 14 when t>=25 then 7 else 0 end)+(case when h<=20 then 25 when h<=30 then 20 when h<=40 then 13 when h<=50 then 6 else 0 end)
 +(case when w>=50 then 25 when w>=35 then 18 when w>=20 then 11 when w>=10 then 5 else 0 end)+(case when coalesce(f,0)>=10 then 20 when coalesce(f,0)>=5 then 15 when coalesce(f,0)>=2 then 10 when coalesce(f,0)>=1 then 5 else 0 end)
 +(case when t>40 and h<20 then 20 when t>35 and h<30 then 10 else 0 end))"""


def risk(spark, sf):
    w = _weather(detections(spark, sf)).withColumn("score", rules.risk_score("temperature", "humidity", "wind", "fires")).withColumn("level", rules.risk_level("score"))
    return w.select("event_id", F.col("score").cast("long").alias("score"), "level", rules.dryness_index("temperature", "humidity", "wind").cast("long").alias("dryness"), rules.vegetation_pressure("temperature", "wind").cast("long").alias("pressure"), F.col("fires").alias("nearby"))


RISK_SQL = f"""with {_WEATHER_SQL}, s as (select *, {_SCORE_SQL} score from wx) select event_id, score::bigint score, case when score>=75 then 'Critical' when score>=50 then 'High' when score>=25 then 'Medium' else 'Low' end "level",
 least(100, floor(t/45*50+(100-h)/100*35+w/80*15+0.5))::bigint dryness, least(100, floor(w/80*50+t/45*50+0.5))::bigint pressure, f nearby from s"""


def transitions(spark, sf):
    """Notices by level change against the entity's previous score that day."""
    from pyspark.sql import Window

    w = _weather(detections(spark, sf)).withColumn("level", rules.risk_level(rules.risk_score("temperature", "humidity", "wind", "fires")))
    by = Window.partitionBy("incident_id").orderBy("acquired_at", "event_id")
    w = w.withColumn("previous", F.lag("level").over(by)).withColumn("told", F.col("event_id") % 5 == 0)
    return w.select("event_id", rules.alert_transition("level", "previous", "told").alias("notify"), rules.waking_hours("acquired_at", "Europe/Istanbul").alias("awake"), rules.stale("acquired_at", F.lit(AS_OF).cast("timestamp"), 48).alias("stale"), times.local_date("acquired_at", "Europe/Istanbul").alias("local_day"), times.fixed_offset_day("acquired_at").alias("day_no"))


TRANSITIONS_SQL = f"""with {_WEATHER_SQL}, s as (select *, {_SCORE_SQL} score from wx), l as (select *, case when score>=75 then 3 when score>=50 then 2 when score>=25 then 1 else 0 end lv from s),
 p as (select *, lag(lv) over (partition by incident_id order by acquired_at, event_id) pv from l)
 select event_id, lv>=2 and not (event_id%5=0) and (pv is null or pv<2 or lv>pv) notify, hour(acquired_at + interval 3 hours) between 7 and 20 awake, epoch(timestamp '{AS_OF}'-acquired_at)/3600.0>48 stale,
 strftime(acquired_at + interval 3 hours,'%Y-%m-%d') local_day, floor((epoch(acquired_at)+10800)/86400)::bigint day_no from p"""


def local_days(spark, sf):
    d = detections(spark, sf).groupBy("incident_id").agg(F.min("acquired_at").alias("a"), F.max("acquired_at").alias("b"))
    return d.where(rules.half_open_days("a", "b", "2024-01-05", "2024-01-06", "Europe/Istanbul")).select("incident_id", secs("a").alias("first_at"))


LOCAL_SQL = f"""with {DET}, s as (select incident_id, min(acquired_at) a, max(acquired_at) b from det group by 1) select incident_id, floor(epoch(a))::bigint first_at from s where a < timestamp '2024-01-06 21:00:00' and b >= timestamp '2024-01-04 21:00:00'"""


def geometry(spark, sf):
    p = places(spark, sf)
    x, y = geo.laea_xy("lat", "lng")
    sx, sy = geo.sinusoidal_xy("lat", "lng")
    back = geo.sinusoidal_lat_lng(sx, sy)
    return p.select(
        "place_id", F.round(geo.haversine_km("lat", "lng", F.lit(39.0), F.lit(35.0)), 4).alias("km"), F.round(geo.initial_bearing("lat", "lng", F.lit(39.0), F.lit(35.0)), 4).alias("bearing"),
        F.round(geo.planar_azimuth("lng", "lat", F.lit(35.003), F.lit(39.003)), 4).alias("azimuth"), F.round(sx, 2).alias("sx"), F.round(sy, 2).alias("sy"), F.round(back[0], 6).alias("lat_back"), F.round(back[1], 6).alias("lng_back"),
        geo.compass8(geo.initial_bearing("lat", "lng", F.lit(39.0), F.lit(35.0))).alias("compass"), geo.tile_name("lat", "lng").alias("tile"), geo.grid_key("lat", "lng", 1).alias("cell"), F.round(x, 1).alias("ex"), F.round(y, 1).alias("ey"),
        F.round(geo.cross_track_km(F.lit(36.0), F.lit(26.0), F.lit(42.0), F.lit(44.0), "lat", "lng"), 3).alias("xt"),
    )


_E2 = "0.0066943800229007875e0"
_E = "0.08181919104281579e0"
_q = lambda s: f"((1-{_E2})*({s}/(1-{_E2}*{s}*{s})-ln((1-{_E}*{s})/(1+{_E}*{s}))/(2*{_E})))"
_bear = lambda a, o, b, p: f"((degrees(atan2(sin(radians({p}-({o})))*cos(radians({b})), cos(radians({a}))*sin(radians({b}))-sin(radians({a}))*cos(radians({b}))*cos(radians({p}-({o})))))+360)-360*floor((degrees(atan2(sin(radians({p}-({o})))*cos(radians({b})), cos(radians({a}))*sin(radians({b}))-sin(radians({a}))*cos(radians({b}))*cos(radians({p}-({o})))))+360)/360))"
GEOMETRY_SQL = f"""with {PLACES}, a as (select *, {_bear('lat', 'lng', '39.0e0', '35.0e0')} b, {_q('1e0')} qp, sin(radians(52e0)) s0, radians(lng-10) dl, sin(radians(lat)) s, 6371007.181e0 r from places),
 c as (select *, 6378137e0*sqrt(qp/2) rq, asin({_q('s0')}/qp) b0, asin({_q('s')}/qp) bb from a),
 d as (select *, 6378137e0*cos(radians(52e0))/sqrt(1-{_E2}*s0*s0)/(rq*cos(b0)) dd, rq*sqrt(2/(1+sin(b0)*sin(bb)+cos(b0)*cos(bb)*cos(dl))) k from c)
 select place_id, round({geo.haversine_sql('lat', 'lng', '39.0e0', '35.0e0')},4) km, round(b,4) bearing, round(case when degrees(atan2(35.003e0-lng,39.003e0-lat))<0 then degrees(atan2(35.003e0-lng,39.003e0-lat))+360 else degrees(atan2(35.003e0-lng,39.003e0-lat)) end,4) azimuth,
 round(r*radians(lng)*cos(radians(lat)),2) sx, round(r*radians(lat),2) sy, round(lat,6) lat_back, round(lng,6) lng_back, ['N','NE','E','SE','S','SW','W','NW'][(round(b/45)::int%8)+1] compass,
 'N'||lpad((floor(lat/3)*3)::int::varchar,2,'0')||'E'||lpad((floor(lng/3)*3)::int::varchar,3,'0') tile, printf('%.1f',round(lat,1))||','||printf('%.1f',round(lng,1)) cell,
 round(4321000+k*dd*cos(bb)*sin(dl),1) ex, round(3210000+k/dd*(cos(b0)*sin(bb)-sin(b0)*cos(bb)*cos(dl)),1) ey,
 round(abs(asin(sin({geo.haversine_sql('36e0', '26e0', 'lat', 'lng')}/6371.0e0)*sin(radians({_bear('36e0', '26e0', 'lat', 'lng')}-{_bear('36e0', '26e0', '42e0', '44e0')})))*6371.0e0),3) xt from d"""


def shares(spark, sf):
    """Percent of items per part class; the line items meet the parts by key."""
    li, p = table(spark, sf, "lineitem").select("l_partkey", "l_quantity"), table(spark, sf, "part").select("p_partkey", "p_type")
    return reporting.shares(li.join(p, F.col("l_partkey") == F.col("p_partkey")), "p_type")


def monthly(spark, sf):
    return reporting.monthly(table(spark, sf, "lineitem"), "l_shipdate", "1991-11-01", "1999-02-01", {"items": F.count("*"), "hectares": F.round(F.count("*") * 21.4659, 2), "quantity": F.sum("l_quantity")}).withColumn("month", F.date_format("month", "yyyy-MM-dd")).withColumn("hectares", F.col("hectares").cast("double"))


def histogram(spark, sf):
    return reporting.histogram(table(spark, sf, "orders"), "o_totalprice", 0, 500000, 5)


def median(spark, sf):
    """Median of each priority's prices as the upper middle one.

    One sort by range numbers all rows; what a priority has in each range is counted, and the counts tell which row is the middle one.
    """
    from pyspark.sql import Window

    o = table(spark, sf, "orders").select("o_orderpriority", "o_totalprice")
    placed = cut(o.orderBy("o_orderpriority", "o_totalprice").withColumn("m", F.monotonically_increasing_id()))
    counts = placed.groupBy("o_orderpriority", F.shiftright("m", 33).alias("range")).agg(F.count("*").alias("c"), F.min("m").alias("first"))
    own = Window.partitionBy("o_orderpriority")
    told = counts.withColumns({"n": F.sum("c").over(own), "before": F.sum("c").over(own.orderBy("range")) - F.col("c")}).withColumn("skip", F.expr("n div 2 - before"))
    middle = told.where("skip >= 0 and skip < c").select((F.col("first") + F.col("skip")).alias("m"), "n")
    return placed.join(middle, "m").select("o_orderpriority", "n", F.round("o_totalprice", 2).alias("median"))


def summary(spark, sf):
    d = detections(spark, sf)
    as_of = F.lit(AS_OF).cast("timestamp")
    e = d.groupBy("incident_id").agg(F.max("acquired_at").alias("last"), F.count("*").alias("passes"), F.max("frp").alias("peak"), F.countDistinct(F.to_date("acquired_at")).alias("days")).withColumn("age", rules.hours_between(as_of, "last"))
    sig = rules.significant("passes", "peak", F.lit("nominal"))
    return e.agg(
        F.count_if(F.col("age") <= 6).alias("active"), F.count_if((F.col("age") <= 6) & sig).alias("significant_active"), F.count_if((F.col("age") > 6) & (F.col("age") <= 30)).alias("ended_24h"),
        F.count_if(F.col("days") >= 7).alias("persistent"), F.max_by("incident_id", F.struct("peak", -F.col("incident_id"))).alias("strongest"), F.round(F.max("peak"), 4).alias("peak"),
    )


def top_entities(spark, sf):
    s = table(spark, sf, "supplier")
    return reporting.top(s.select("s_suppkey", F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("peak")), [F.desc_nulls_last("peak"), F.asc("s_suppkey")], 20)


def work_queue(spark, sf):
    c = table(spark, sf, "customer")
    return reporting.page(c.select("c_custkey", F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal")).alias("checked")), [F.asc_nulls_first("checked"), F.asc("c_custkey")], 10, 60)


def queue_cells(spark, sf):
    p = places(spark, sf).withColumn("cell", geo.grid_key("lat", "lng", 0))
    return reporting.first_cells(p, [F.col("radius_km"), F.col("place_id")], "cell", 12)


def daily_budget(spark, sf):
    return reporting.running_share(detections(spark, sf), "acquired_at", "event_id", 3000.0).select("event_id", "used", F.round("share", 4).alias("share"))


def unknown_counts(spark, sf):
    c = centres(spark, sf).select("region_id")
    n = places(spark, sf).where("radius_km > 20 and region_id % 3 <> 1").groupBy("region_id").agg(F.count("*").alias("n"))
    return reporting.count_or_unknown(n, c, "region_id", "n", F.col("region_id") != 7)


def gate_reasons(spark, sf):
    d = table(spark, sf, "documents")
    title = F.split("text", "\n")[0]
    return d.groupBy(text.gate_reason(title, F.col("text"), MUST, TITLE, BLOCKED).alias("reason"), text.first_tag(F.lower("text"), TAGS, "other").alias("tag")).agg(F.count("*").alias("n"))


_any = lambda x, ws: "(" + " or ".join(f"contains({x},'{w}')" for w in ws) + ")"
GATE_SQL = f"""with t as (select lower(split_part(text,chr(10),1)) ti, lower(text) f from documents), g as (select case when not ({_any('f', MUST)} or {_any('ti', TITLE)}) then 'no_must_have' when {_any('f', BLOCKED)} then 'blocked' when length(trim(ti))<=10 then 'too_short' else 'ok' end reason,
 case {' '.join(f"when {_any('f', ws)} then '{k}'" for k, ws in TAGS)} else 'other' end tag from t) select reason, tag, count(*) n from g group by 1,2"""


def near_titles(spark, sf):
    """Titles whose token overlap reaches 0.8, through shared tokens: common tokens of a pair can't be the rare ones only, so a prefix of the rarest ones is enough."""
    from pyspark.sql import Window

    b = table(spark, sf, "benchmark").select("item_id", text.tokens("text").alias("t"))
    freq = b.select(F.explode("t").alias("w")).groupBy("w").count()
    ranked = b.select("item_id", F.size("t").alias("n"), F.explode("t").alias("w")).join(freq, "w").withColumn("r", F.row_number().over(Window.partitionBy("item_id").orderBy("count", "w")))
    prefix = ranked.where(F.col("r") <= F.col("n") - F.ceil(0.8 * F.col("n")) + 1).select("w", "item_id")
    pairs = prefix.alias("a").join(prefix.alias("b"), "w").where("a.item_id < b.item_id").select(F.col("a.item_id").alias("i"), F.col("b.item_id").alias("j")).distinct()
    both = pairs.join(b.select(F.col("item_id").alias("i"), F.col("t").alias("ta")), "i").join(b.select(F.col("item_id").alias("j"), F.col("t").alias("tb")), "j")
    return both.select("i", "j", F.round(text.jaccard("ta", "tb"), 4).alias("likeness")).where("likeness >= 0.8")


NEAR_SQL = r"""with b as (select item_id, list_distinct(list_filter(string_split(regexp_replace(lower(text),'[^\p{L}\p{N}]+',' ','g'),' '), lambda x: x<>'')) t from benchmark)
 select a.item_id i, c.item_id j, round(len(list_intersect(a.t,c.t))/len(list_distinct(list_concat(a.t,c.t)))::double,4) likeness from b a join b c on a.item_id<c.item_id where len(list_intersect(a.t,c.t))/len(list_distinct(list_concat(a.t,c.t)))::double>=0.8"""


def redacted(spark, sf):
    d = table(spark, sf, "documents")
    url = F.concat(F.lit("/p?lat=38."), F.col("doc_id"), F.lit("&lng=-27.5&q="), F.col("lang"))
    return d.select("doc_id", text.redact_coordinates(url).alias("url"), F.sha2("text", 256).alias("digest"), text.clean_name(F.split("text", "\n")[0]).alias("name"), rules.version_or_zero(F.concat(F.col("doc_id"), F.lit(".1"))).alias("version"), rules.older_build(F.concat(F.lit("app 1.0+"), F.col("doc_id")), 500).alias("old"))


def links(spark, sf):
    return feeds.page_links(table(spark, sf, "pages"), "html").groupBy("page_id").agg(F.count("*").alias("links"), F.min("href").alias("first_href"))


def calendar(spark, sf):
    o = table(spark, sf, "orders")
    d = F.col("o_orderdate").cast("timestamp")
    return o.select("o_orderkey", F.date_format(times.ordinal_date(F.year(d), F.dayofyear(d)), "yyyy-MM-dd").alias("day"), F.size(times.eligible_months(d, 3)).cast("long").alias("months"), F.floor(F.unix_micros(times.mid_time(d, F.lit(AS_OF).cast("timestamp"))) / 1_000_000).cast("long").alias("mid"))


def land_cover(spark, sf):
    p = table(spark, sf, "part")
    m = F.create_map(F.lit("built"), (F.col("p_size") % 40).cast("int"), F.lit("crop"), (F.col("p_partkey") % 60).cast("int"), F.lit("tree"), (F.col("p_partkey") % 45).cast("int"), F.lit("grass"), (F.col("p_partkey") % 50).cast("int"))
    c = rules.land_cover(m)
    return p.select("p_partkey", c.alias("cover"), rules.natural_or_confirmed(c, F.when(F.col("p_partkey") % 4 == 0, 1)).alias("counted"), rules.source_reason(F.col("p_size"), F.col("p_retailprice") / 1000, F.col("p_size") / 4.0).alias("reason"))


def burned(spark, sf):
    """Pixels of one row-major tile per part class."""
    p = table(spark, sf, "part").groupBy(F.col("p_size").alias("tile")).agg(F.array_sort(F.collect_list(F.col("p_partkey"))).alias("k"))
    t = p.select("tile", F.transform("k", lambda x: (x % 372 - 3).cast("int")).alias("v"), F.lit(4).alias("w"))
    return feeds.burn_pixels(t, "v", "w").groupBy("tile", "kind").agg(F.count("*").alias("pixels"), F.max("row").alias("last_row"), F.round(F.count("*") * 463.31271653**2 / 10000, 2).alias("hectares"))


QUERIES = {
    "p1_parsed_times": parsed_times, "p8_regions": regions, "c13_risk_score": risk, "p24_alert_transitions": transitions, "p11_local_days": local_days, "g3_geometry": geometry, "a22_type_shares": shares, "c20_monthly": monthly,
    "a25_histogram": histogram, "a25_median": median, "c18_summary": summary, "o2_top_entities": top_entities, "o3_work_queue": work_queue, "o10_queue_cells": queue_cells, "a26_daily_budget": daily_budget, "c17_unknown_counts": unknown_counts,
    "t3_gate_reasons": gate_reasons, "t13_near_titles": near_titles, "t16_redacted": redacted, "s12_page_links": links, "p12_calendar": calendar, "p21_land_cover": land_cover, "s13_burn_pixels": burned,
}
ORACLE = {
    "p1_parsed_times": PARSED_SQL, "p8_regions": REGIONS_SQL, "c13_risk_score": RISK_SQL, "p24_alert_transitions": TRANSITIONS_SQL, "p11_local_days": LOCAL_SQL, "g3_geometry": GEOMETRY_SQL,
    "a22_type_shares": "with c as (select p_type, count(*) n from lineitem join part on l_partkey=p_partkey group by 1) select p_type, n, round(100.0e0*n/(select sum(n) from c),2) percent from c",
    "c20_monthly": """with m as (select unnest(generate_series(date '1991-11-01', date '1999-02-01', interval 1 month))::date as mo), s as (select date_trunc('month',l_shipdate)::date as mo, count(*) items, sum(l_quantity) q from lineitem where l_shipdate>=timestamp '1991-11-01' and l_shipdate<timestamp '1999-03-01' group by 1)
 select strftime(m.mo,'%Y-%m-%d') "month", coalesce(items,0) items, coalesce(round(items*21.4659e0,2),0e0) hectares, coalesce(q,0e0) quantity from m left join s on m.mo=s.mo""",
    "a25_histogram": "select case when o_totalprice<0 then 0 when o_totalprice>=500000 then 6 else floor(o_totalprice/100000)::int+1 end bucket, count(*) n from orders group by 1",
    "a25_median": "with r as (select o_orderpriority, o_totalprice, count(*) over (partition by o_orderpriority) n, row_number() over (partition by o_orderpriority order by o_totalprice) r from orders) select o_orderpriority, n, round(o_totalprice,2) median from r where r = n//2+1",
    "c18_summary": f"""with {DET}, e as (select incident_id, max(acquired_at) l, count(*) passes, max(frp) peak, count(distinct acquired_at::date) as days from det group by 1), a as (select *, epoch(timestamp '{AS_OF}'-l)/3600.0 age from e)
 select count(*) filter (where age<=6) active, count(*) filter (where age<=6 and passes>=2 and peak>=8) significant_active, count(*) filter (where age>6 and age<=30) ended_24h, count(*) filter (where "days">=7) persistent, arg_max(incident_id,(peak,-incident_id)) strongest, round(max(peak),4) peak from a""",
    "o2_top_entities": "select s_suppkey, case when s_acctbal>0 then s_acctbal end peak from supplier order by peak desc nulls last, s_suppkey limit 20",
    "o3_work_queue": "select c_custkey, case when c_custkey%9<>0 then c_acctbal end checked from customer order by checked asc nulls first, c_custkey limit 60 offset 10",
    "o10_queue_cells": f"with {PLACES}, c as (select printf('%.0f',round(lat,0))||','||printf('%.0f',round(lng,0)) cell, min((radius_km, place_id)) k from places group by 1) select cell from c order by k limit 12",
    "a26_daily_budget": f"with {DET}, u as (select event_id, sum(event_id) over (partition by acquired_at::date order by acquired_at range between unbounded preceding and current row)::bigint used from det) select event_id, used, round(used/3000.0e0,4) share from u",
    "c17_unknown_counts": f"with {CENTRES}, {PLACES}, n as (select region_id, count(*) n from places where radius_km>20 and region_id%3<>1 group by 1) select c.region_id, case when c.region_id<>7 then coalesce(n,0) end n from centres c left join n using (region_id)",
    "t3_gate_reasons": GATE_SQL, "t13_near_titles": NEAR_SQL,
    "t16_redacted": """select doc_id, '/p?lat=[redacted]&lng=[redacted]&q='||lang url, sha256(text) digest, (select case when length(x) between 1 and 60 then x end from (select trim(regexp_replace(regexp_replace(split_part(text,chr(10),1),'[\\p{Cc}\\p{Cf}]','','g'),'\\s+',' ','g')) x)) as name, doc_id||'.1' as version, doc_id<500 old from documents""",
    "s12_page_links": """with m as (select page_id, unnest(regexp_extract_all(html,'<a[^>]*\\bhref="([^"]*)"[^>]*>([^<]*)</a>',1)) href from pages) select page_id, count(*) links, min(href) first_href from m group by 1""",
    "p12_calendar": f"""select o_orderkey, strftime(o_orderdate,'%Y-%m-%d') as day, (select count(*) from unnest([1,2,3,4,5]) k(k) where last_day((date_trunc('month',o_orderdate) - to_months(k))::date) + 32 <= o_orderdate::date)::bigint as months, floor((epoch_us(o_orderdate)+epoch_us(timestamp '{AS_OF}'))/2/1000000.0)::bigint mid from orders""",
    "p21_land_cover": """with c as (select *, p_size%40 b, p_partkey%60 c, p_partkey%45 t, p_partkey%50 g from part), k as (select *, case when b>=30 then 'built' when c>=35 and t<35 then 'agriculture' when t+g>=60 then 'natural' else 'other' end cover from c)
 select p_partkey, cover, cover in ('natural','unknown') or p_partkey%4=0 counted, 'seen on '||p_size||' distinct days (≥7), mean FRP '||printf('%.1f',round((p_retailprice/1000)::decimal(20,6),1)::double)||' MW (<5), peak FRP '||printf('%.1f',round((p_size/4.0e0)::decimal(20,6),1)::double)||' MW (<20)' reason from k""",
    "s13_burn_pixels": """with p as (select p_size tile, (p_partkey%372-3)::int v, row_number() over (partition by p_size order by p_partkey)-1 i from part), k as (select *, case when v between 1 and 366 then 'burned' when v in (0,-1,-2) then 'skipped' else 'unexpected' end kind from p)
 select tile, kind, count(*) pixels, max(i//4) last_row, round(count(*)*463.31271653e0*463.31271653e0/10000,2) hectares from k group by 1,2""",
}
