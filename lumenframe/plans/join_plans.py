"""Joins, spatial joins, clusters, upserts and notices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import alerts, reporting, spatial, state
from ..sources.tables import table
from .stand_ins import AS_OF, CENTRES, DET, EDGES, PLACES, SITES, centres, detections, places, secs, shapes, sites

_KM = geo.haversine_sql


def dimension_joins(spark, sf):
    """Left joins to small dimensions, the size counted before a broadcast is asked for."""
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    dims = spatial.small(n.join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left"))
    return c.join(dims, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


def without_orders(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_mktsegment")


def not_cited(spark, sf):
    """Parts that no order's list of parts holds: the lists are unnested, then anti-joined."""
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    lists = li.where("l_quantity > 45").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("ids"))
    return p.join(lists.select(F.explode("ids").alias("id")), F.col("p_partkey") == F.col("id"), "left_anti").select("p_partkey")


def bounds_join(spark, sf):
    d = detections(spark, sf)
    b = d.agg(F.min("acquired_at").alias("lo"), F.max("acquired_at").alias("hi"))
    return d.crossJoin(F.broadcast(b)).groupBy("event_type").agg(F.count_if(F.col("acquired_at") < F.timestamp_micros(((F.unix_micros("lo") + F.unix_micros("hi")) / 2).cast("long"))).alias("first_half"), F.count("*").alias("n"))


def later_passes(spark, sf):
    """Purchases of the same user after an error, by key and range; each error takes the nearest one."""
    d = detections(spark, sf)
    e = d.where("event_type = 'error'").select("incident_id", "event_id", F.col("acquired_at").alias("at"))
    p = d.where("event_type = 'purchase'").select("incident_id", F.col("acquired_at").alias("later"), F.col("event_id").alias("next_id"))
    return e.join(p, "incident_id").where("later > at and later <= at + interval 2 days").groupBy("event_id").agg(F.count("*").alias("n"), F.min_by("next_id", F.struct("later", "next_id")).alias("next_id"))


def pass_windows(spark, sf):
    """Detections within five minutes of a window of their kind, and the windows without any.

    Kind and 20-minute bin are the join key, a window stands in every bin it reaches; the range is checked behind it.
    """
    bins = lambda at: F.floor(F.unix_seconds(at) / 1200)
    reach = F.expr("interval 5 minutes")
    d = detections(spark, sf)
    w = d.where("event_id % 10 = 0").select("event_type", F.col("event_id").alias("window_id"), F.col("acquired_at").alias("a"), (F.col("acquired_at") + F.expr("interval 10 minutes")).alias("b"))
    spread = w.withColumn("bin", F.explode(F.sequence(bins(F.col("a") - reach), bins(F.col("b") + reach))))
    seen = d.where("event_id % 10 <> 0").select("event_type", "acquired_at", bins(F.col("acquired_at")).alias("bin"))
    hit = seen.join(spread, ["event_type", "bin"]).where(F.col("acquired_at").between(F.col("a") - reach, F.col("b") + reach))
    n = hit.groupBy("window_id").agg(F.count("*").alias("n"))
    return w.join(n, "window_id", "left").select("window_id", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("silent"))


def place_matches(spark, sf):
    m = spatial.within_distance(places(spark, sf), sites(spark, sf), 25.0, row_radius_km="radius_km")
    return m.select(F.col("l.place_id").alias("place_id"), F.col("r.site_id").alias("site_id"), F.round("km", 4).alias("km"))


def near_counts(spark, sf):
    p, s = places(spark, sf), sites(spark, sf)
    return spatial.counts_within(p, s, 50.0).select("place_id", "n", (F.col("n") > 0).alias("any"))


def nearest_site(spark, sf):
    s = sites(spark, sf)
    return spatial.nearest_within(places(spark, sf), s, "place_id", "site_id", 60.0).withColumn("km", F.round("km", 4))


def nearest_centre(spark, sf):
    return spatial.nearest_of_few(places(spark, sf), centres(spark, sf), "region_id").select("place_id", "nearest_id", F.round("nearest_km", 4).alias("km"))


def within_parent(spark, sf):
    """Nearest child inside the parent already assigned: the nearest within a growing radius among those of the same parent."""
    return spatial.nearest_within(places(spark, sf), sites(spark, sf), "place_id", "site_id", spatial.HALF_ROUND_KM, apart=("region_id",)).withColumn("km", F.round("km", 4))


def polygon_assignment(spark, sf):
    edges = spatial.polygon_edges(shapes(spark, sf), "region_id", "rings")
    p = places(spark, sf).drop("region_id")
    return spatial.assign_polygon(p, edges, "place_id", "region_id")


def polygon_hits(spark, sf):
    edges = spatial.polygon_edges(shapes(spark, sf), "region_id", "rings")
    return spatial.points_in_polygons(places(spark, sf).drop("region_id"), edges, "place_id", "region_id").select("place_id", "region_id", F.round("depth_km", 4).alias("depth_km"))


def clusters(spark, sf):
    return spatial.density_clusters(sites(spark, sf), "site_id", 30000.0)


def hulls(spark, sf):
    h = spatial.convex_hulls(places(spark, sf), "region_id")
    return h.select("region_id", F.size("ring").cast("long").alias("corners"), F.round(F.array_min(F.transform("ring", lambda p: p[0])), 4).alias("west"))


def insert_ignore(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    new = o.where("o_orderkey % 3 = 0").select(F.col("o_custkey") + 5, "o_orderkey", "o_totalprice").toDF("o_custkey", "o_orderkey", "o_totalprice")
    _, fresh = state.insert_ignore(o.where("o_orderkey % 2 = 0"), new, ["o_custkey"], [F.asc("o_orderkey")])
    return fresh.select("o_custkey", "o_orderkey", F.round("o_totalprice", 2).alias("price"))


def upserted(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.round("c_acctbal", 2).alias("balance"))
    new = c.where("c_custkey % 2 = 0").select((F.col("c_custkey") + 100).alias("c_custkey"), F.when(F.col("c_custkey") % 4 == 0, "NEW").alias("c_mktsegment"), F.col("balance"))
    return state.upsert(c, new, ["c_custkey"])


def undo(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    new = c.select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, F.lit(None)).when(F.col("c_custkey") % 5 == 1, "MOVED").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    return state.undo_log(c, new, ["c_custkey"], ["c_mktsegment"])


def patched(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name", F.round("s_acctbal", 2).alias("balance"))
    ch = s.where("s_suppkey % 4 = 0").select("s_suppkey", F.lit(None).cast("string").alias("s_name"), F.lit(0.0).alias("balance"))
    return state.patch(s, ch, "s_suppkey")


#: Rows from which on a source is enough.
ENOUGH = 1500


def source_ladder(spark, sf):
    d = detections(spark, sf)
    n = d.groupBy("event_type").agg(F.count("*").alias("n")).join(spark.createDataFrame([("signup", 1), ("error", 2), ("view", 3), ("click", 4), ("purchase", 5)], "event_type string, pos int"), "event_type")
    return state.first_acceptable_source(n, "event_type", "n", "pos", ENOUGH)


def retained(spark, sf):
    d = detections(spark, sf)
    as_of = F.lit(AS_OF).cast("timestamp")
    kept, gone = state.retention(d, {"old": F.col("acquired_at") < as_of - F.expr("interval 20 days"), "weak": (F.col("tier") == "low") & (F.col("frp") < 20), "null": F.col("frp").isNull()})
    return gone.union(kept.groupBy().count().select(F.lit("kept").alias("rule"), "count")).withColumnRenamed("count", "n")


def push_plan(spark, sf):
    d = detections(spark, sf)
    as_of = F.lit(AS_OF).cast("timestamp")
    sent = d.where("event_type = 'click'").select(F.col("incident_id").alias("device"), F.col("event_id").alias("push_id"), F.col("acquired_at").alias("sent_at"))
    pending = d.where("event_type = 'error'").select(F.col("incident_id").alias("device"), F.col("event_id").alias("ref"), (F.col("event_id") % 97 / 4.0).alias("km"))
    return alerts.plan_pushes(pending, sent, "device", as_of, hours=24)


def fetch_states(spark, sf):
    d = detections(spark, sf)
    pick = lambda xs, k: F.element_at(F.array(*map(F.lit, xs)), (F.floor(F.col("event_id") / k) % len(xs) + 1).cast("int"))
    s = pick(["awaiting", "submitted", "downloaded", "failed"], 1)
    return d.select("event_id", alerts.next_fetch_state(s, F.col("event_id") % 3, pick(["done", "error", "pending"], 4)).alias("next"))


def scope_targets(spark, sf):
    """Devices that a notice of one region reaches: all, that region, or a listed place."""
    p = places(spark, sf).withColumn("scope", F.element_at(F.array(F.lit("all"), F.lit("region"), F.lit("place")), (F.col("place_id") % 3 + 1).cast("int")))
    muted = p.where("place_id % 10 = 0").select("place_id")
    hit = (F.col("scope") == "all") | ((F.col("scope") == "region") & (F.col("region_id") == 3)) | ((F.col("scope") == "place") & F.col("place_id").isin(5, 8, 11))
    return p.where(hit).join(muted, "place_id", "left_anti").groupBy("scope").agg(F.count("*").alias("n"))


def deviation(spark, sf):
    """Keys whose backfilled count strays over five percent from the stored one."""
    d = detections(spark, sf)
    a = d.groupBy("incident_id").agg(F.count("*").alias("old"))
    b = d.where("event_id % 17 <> 0 or incident_id % 2 = 0").groupBy("incident_id").agg(F.count("*").alias("new"))
    return a.join(b, "incident_id", "left").where(F.abs(F.col("new") - F.col("old")) > 0.05 * F.col("old")).select("incident_id", "old", "new")


def ordered_lookup(spark, sf):
    """An array of keys looked up in one join, order kept by position."""
    n = table(spark, sf, "nation")
    q = spark.range(1).select(F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(39)), lambda x: (x * 7 % 31).cast("int"))).alias("pos", "k"))
    return q.join(spatial.small(n), F.col("k") == F.col("n_nationkey"), "left").select(F.col("pos").cast("long").alias("pos"), F.coalesce("n_name", F.lit("outside")).alias("name"))


def latest_list(spark, sf):
    return reporting.top(table(spark, sf, "orders").select("o_orderkey", secs("o_orderdate").alias("at"), "o_orderpriority"), [F.desc("at"), F.desc("o_orderkey")], 50)


def top_districts(spark, sf):
    """Largest totals per region with the rest folded in; ranks within a partition by key."""
    from pyspark.sql import Window

    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    t = c.join(spatial.small(n), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "n_name").agg(F.round(F.sum("c_acctbal"), 2).alias("total"))
    return t.withColumn("r", F.row_number().over(Window.partitionBy("n_regionkey").orderBy(F.desc("total"), "n_name"))).where("r <= 2").withColumn("r", F.col("r").cast("long"))


QUERIES = {
    "j2_dimensions": dimension_joins, "j3_without_orders": without_orders, "j4_not_cited": not_cited, "j6_bounds": bounds_join, "j19_later_passes": later_passes, "j29_pass_windows": pass_windows,
    "j7_place_matches": place_matches, "j25_near_counts": near_counts, "j9_nearest_site": nearest_site, "j14_nearest_centre": nearest_centre, "j16_within_parent": within_parent,
    "j15_polygon_assignment": polygon_assignment, "j12_polygon_hits": polygon_hits, "c1_density_clusters": clusters, "a15_hulls": hulls, "s18_insert_ignore": insert_ignore, "s19_upsert": upserted,
    "s25_undo_log": undo, "s29_patch": patched, "s5_source_ladder": source_ladder, "c31_retention": retained, "c28_push_plan": push_plan, "c22_fetch_states": fetch_states, "p23_scope_targets": scope_targets,
    "c33_deviation": deviation, "j21_ordered_lookup": ordered_lookup, "o9_latest_list": latest_list, "o7_top_per_region": top_districts,
}
_PIP = f"""pe as (select p.place_id, e.region_id, p.lat, p.lng, (x1-p.lng)*cos(radians(p.lat))*6371e0*pi()/180 ax, (y1-p.lat)*6371e0*pi()/180 ay, (x2-x1)*cos(radians(p.lat))*6371e0*pi()/180 dx, (y2-y1)*6371e0*pi()/180 dy,
 case when (y1>p.lat)<>(y2>p.lat) then p.lng < (x2-x1)*(p.lat-y1)/nullif(y2-y1,0)+x1 else false end x from places p, edges e),
 ps as (select *, greatest(0e0,least(1e0,coalesce(-(ax*dx+ay*dy)/nullif(dx*dx+dy*dy,0),0))) t from pe),
 pp as (select place_id, region_id, count(*) filter (where x)%2=1 inside, min(sqrt(power(ax+t*dx,2)+power(ay+t*dy,2))) d from ps group by 1,2)"""
ORACLE = {
    "j2_dimensions": "select r_name, n_name, count(*) n, round(sum(c_acctbal),2) balance from customer left join nation on c_nationkey=n_nationkey left join region on n_regionkey=r_regionkey group by 1,2",
    "j3_without_orders": "select c_custkey, c_mktsegment from customer where not exists (select 1 from orders where o_custkey=c_custkey)",
    "j4_not_cited": "select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_quantity>45)",
    "j6_bounds": f"with {DET}, b as (select (epoch_us(min(acquired_at))+epoch_us(max(acquired_at)))//2 m from det) select event_type, count(*) filter (where epoch_us(acquired_at)<m) first_half, count(*) n from det, b group by 1",
    "j19_later_passes": f"with {DET} select e.event_id, count(*) n, arg_min(p.event_id,(p.acquired_at,p.event_id)) next_id from det e join det p on p.incident_id=e.incident_id and p.event_type='purchase' and p.acquired_at>e.acquired_at and p.acquired_at<=e.acquired_at+interval 2 days where e.event_type='error' group by 1",
    "j29_pass_windows": f"with {DET}, w as (select * from det where event_id%10=0), h as (select w.event_id, count(*) n from w join det d on d.event_type=w.event_type and d.event_id%10<>0 and d.acquired_at between w.acquired_at - interval 5 minutes and w.acquired_at + interval 15 minutes group by 1) select w.event_id window_id, coalesce(n,0) n, n is null silent from w left join h using (event_id)",
    "j7_place_matches": f"with {PLACES}, {SITES}, m as (select place_id, site_id, radius_km, {_KM('p.lat', 'p.lng', 's.lat', 's.lng')} km from places p, sites s where abs(p.lat-s.lat)<0.3) select place_id, site_id, round(km,4) km from m where km<=radius_km",
    "j25_near_counts": f"with {PLACES}, {SITES}, m as (select place_id, count(*) n from places p, sites s where abs(p.lat-s.lat)<0.5 and {_KM('p.lat', 'p.lng', 's.lat', 's.lng')}<=50 group by 1) select place_id, coalesce(n,0) n, n is not null \"any\" from places left join m using (place_id)",
    "j9_nearest_site": f"with {PLACES}, {SITES}, m as (select place_id, site_id, {_KM('p.lat', 'p.lng', 's.lat', 's.lng')} km from places p, sites s where abs(p.lat-s.lat)<0.6), r as (select *, row_number() over (partition by place_id order by km, site_id) n from m where km<=60) select place_id, site_id, round(km,4) km from r where n=1",
    "j14_nearest_centre": f"with {PLACES}, {CENTRES}, r as (select place_id, c.region_id nearest_id, {_KM('p.lat', 'p.lng', 'c.lat', 'c.lng')} km, row_number() over (partition by place_id order by {_KM('p.lat', 'p.lng', 'c.lat', 'c.lng')}, c.region_id) n from places p, centres c) select place_id, nearest_id, round(km,4) km from r where n=1",
    "j16_within_parent": f"with {PLACES}, {SITES}, r as (select place_id, site_id, {_KM('p.lat', 'p.lng', 's.lat', 's.lng')} km, row_number() over (partition by place_id order by {_KM('p.lat', 'p.lng', 's.lat', 's.lng')}, site_id) n from places p join sites s using (region_id)) select place_id, site_id, round(km,4) km from r where n=1",
    "j15_polygon_assignment": f"with {PLACES}, {CENTRES}, {EDGES}, {_PIP}, a as (select place_id, region_id, inside, row_number() over (partition by place_id order by inside desc, case when inside then -d else d end, region_id) n from pp) select place_id, region_id, inside from a where n=1",
    "j12_polygon_hits": f"with {PLACES}, {CENTRES}, {EDGES}, {_PIP} select place_id, region_id, round(d,4) depth_km from pp where inside",
    "a15_hulls": "",
    "s18_insert_ignore": "with r as (select o_custkey+5 as k, o_orderkey, o_totalprice, row_number() over (partition by o_custkey+5 order by o_orderkey) n from orders where o_orderkey%3=0) select k o_custkey, o_orderkey, round(o_totalprice,2) price from r where n=1 and k not in (select o_custkey from orders where o_orderkey%2=0)",
    "s19_upsert": "with n as (select c_custkey+100 k, case when c_custkey%4=0 then 'NEW' end s, round(c_acctbal,2) b from customer where c_custkey%2=0) select coalesce(k,c_custkey) c_custkey, coalesce(s,c_mktsegment) c_mktsegment, coalesce(b,round(c_acctbal,2)) balance from customer full join n on k=c_custkey",
    "s25_undo_log": "select c_custkey, c_mktsegment old_c_mktsegment, case when c_custkey%5=1 then 'MOVED' end new_c_mktsegment from customer where c_custkey%5 in (0,1)",
    "s29_patch": "select s_suppkey, s_name, case when s_suppkey%4=0 then 0.0e0 else round(s_acctbal,2) end balance from supplier",
    "s5_source_ladder": f"with {DET}, n as (select event_type, count(*) n from det group by 1), o(event_type,pos) as (values ('signup',1),('error',2),('view',3),('click',4),('purchase',5)) select event_type, n from n join o using (event_type) order by n>={ENOUGH} desc, case when n>={ENOUGH} then pos else -n end, pos limit 1",
    "c31_retention": f"with {DET}, t as (select case when acquired_at < timestamp '{AS_OF}' - interval 20 days then 'old' when tier='low' and frp<20 then 'weak' when frp is null then 'null' else 'kept' end \"rule\" from det) select \"rule\", count(*) n from t group by 1",
    "c28_push_plan": f"with {DET}, s as (select incident_id, count(distinct event_id) n from det where event_type='click' and acquired_at > timestamp '{AS_OF}' - interval 24 hours and acquired_at <= timestamp '{AS_OF}' group by 1), p as (select incident_id device, arg_min(event_id,(event_id%97/4.0e0,event_id)) nearest, min(event_id%97/4.0e0) km, count(distinct event_id)-1 more from det where event_type='error' group by 1) select device, nearest, km, more, coalesce(n,0) recent, case when coalesce(n,0)<3 then 'push' else 'hold' end decision from p left join s on s.incident_id=device",
    "c22_fetch_states": f"with {DET}, s as (select event_id, ['awaiting','submitted','downloaded','failed'][event_id%4+1] s, event_id%3 a, ['done','error','pending'][event_id//4%3+1] t from det) select event_id, case when s in ('downloaded','failed') then s when s='awaiting' then 'submitted' when t='done' then 'downloaded' when t='error' then case when a+1>=3 then 'failed' else 'awaiting' end else s end \"next\" from s",
    "p23_scope_targets": f"with {PLACES}, s as (select *, ['all','region','place'][place_id%3+1] \"scope\" from places) select \"scope\", count(*) n from s where place_id%10<>0 and (\"scope\"='all' or (\"scope\"='region' and region_id=3) or (\"scope\"='place' and place_id in (5,8,11))) group by 1",
    "c33_deviation": f"with {DET}, a as (select incident_id, count(*) o, count(*) filter (where event_id%17<>0 or incident_id%2=0) n from det group by 1) select incident_id, o as \"old\", n as \"new\" from a where abs(n-o)>0.05*o",
    "j21_ordered_lookup": "with q as (select i as pos, (i*7%31)::int k from range(40) t(i)) select pos, coalesce(n_name,'outside') as name from q left join nation on k=n_nationkey",
    "o9_latest_list": "select o_orderkey, floor(epoch(o_orderdate))::bigint \"at\", o_orderpriority from orders order by o_orderdate desc, o_orderkey desc limit 50",
    "o7_top_per_region": "with t as (select n_regionkey, n_name, round(sum(c_acctbal),2) total from customer join nation on c_nationkey=n_nationkey group by 1,2), r as (select *, row_number() over (partition by n_regionkey order by total desc, n_name) r from t) select * from r where r<=2",
}
del ORACLE["a15_hulls"]
