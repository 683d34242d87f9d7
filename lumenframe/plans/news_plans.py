"""Queries of the headline rules, over headlines put together from parts by document."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import news
from ..functions.geo import haversine_sql
from ..operators import stories
from ..sources.tables import table
from .stand_ins import AS_OF, DET, SITES, detections, sites

#: Parts of the made headlines.
PLACE = ["Muğla", "İzmir", "Bursa", "Adana", "Hakkâri", "Yunanistan", "Kaliforniya", "Rodos", "Kumluca", "Isparta", "Avrupa"]
ENDING = ["'da", "’dan", " ve Antalya'da", ""]
EVENT = [
    "orman yangını çıktı", "otluk alanda yangın başladı", "ev yangını ormana sıçradı", "fabrika deposunda alevler", "anız yangını söndürüldü", "sıcaklık artıyor", "orman ürünleri fuarı açıldı", "fidan dikimi yapıldı",
    "yangın tatbikatı düzenlendi", "milli park gezisi", "tarlada çıkan yangın kontrol altına alındı", "seçim haberi", "evde olası bir orman yangını riski",
]
BODY = [
    "Söndürme çalışmaları sürüyor.", "Yangın tamamen söndürüldü.", "Kontrol altına alınamıyor, makilik alanda ilerliyor.", "Soğutma çalışmaları başladı.", "Müdahale sürüyor; 20 hektar orman yandı.",
    "Söndürülemedi, rüzgârla büyüyor.", "Türkiye sınırına yaklaştı.", "Afrika sıcakları geliyor.", "Kontrol altında değil.", "",
]
CITIES = ["Muğla", "İzmir", "Bursa", "Adana", "Hakkâri", "Antalya", "Isparta"]
LOOKBACK_DAYS, LOOKAHEAD_HOURS, RADIUS_KM, DAY_WINDOW = 7, 24, 15.0, 1


def _part(words, step):
    return F.element_at(F.array(*map(F.lit, words)), (F.floor(F.col("doc_id") / step) % len(words) + 1).cast("int"))


def headlines(spark, sf):
    published = F.timestamp_seconds(F.unix_timestamp(F.lit(AS_OF).cast("timestamp")) - F.col("doc_id") % 300 * 3600)
    title = F.concat(_part(PLACE, 1), _part(ENDING, 7), F.lit(" "), _part(EVENT, 3))
    return table(spark, sf, "documents").select("doc_id", title.alias("title"), _part(BODY, 11).alias("body"), published.alias("published_at"))


def _q(word):
    return "'" + word.replace("'", "''") + "'"


def _sql_part(words, step):
    return f"[{', '.join(map(_q, words))}][(doc_id//{step})%{len(words)}+1]"


HEADLINES = f"""h0 as (select doc_id, {_sql_part(PLACE, 1)}||{_sql_part(ENDING, 7)}||' '||{_sql_part(EVENT, 3)} title, {_sql_part(BODY, 11)} body, timestamp '{AS_OF}' - to_hours((doc_id%300)::int) published_at from documents),
 h as (select *, lower(replace(title,'İ','i')) t, lower(replace(title||' '||body,'İ','i')) x from h0)"""


def _has(column, pattern):
    """One search in DuckDB's dialect, which knows no look-ahead."""
    return f"regexp_matches({column}, {_q(pattern)})"


def _names(column, words, pattern=lambda w: news.whole([w])):
    return "list_filter([" + ", ".join(f"case when {_has(column, pattern(w))} then {_q(w)} end" for w in words) + "], lambda w: w is not null)"


def wildfire(spark, sf):
    return headlines(spark, sf).select("doc_id", news.wildfire_basis("title", "body").alias("basis"))


WILDFIRE_SQL = f"""with {HEADLINES}, s as (select doc_id, t, regexp_replace(x,{_q(news.NOT_A_SIGNAL)},' ','g') x from h),
 m as (select doc_id, {_has('t', news.WEATHER)} and not {_has('t', news.FIRE_WORD)} weather, {_has('x', news.FIRE_WORD)} fire, {_has('t', news.BUILDING_IN_TITLE)} building, {_has('x', news.begins(news.STRONG))} strong, {_has('x', news.begins(news.WEAK))} weak,
 {_has(f"regexp_replace(x,{_q(news.PREVENTED)},' ','g')", news.VEGETATION_BURNED)} burned from s)
 select doc_id, case when weather then 'weather_forecast' when strong and not fire then 'no_fire_word' when strong and building and not burned then 'building_or_vehicle_title' when strong then 'strong'
 when not weak then 'no_signal' when building then 'building_or_vehicle_title' when not fire then 'no_fire_word' else 'weak' end basis from m"""


def turkey(spark, sf):
    g = news.geography("title", "body")
    return headlines(spark, sf).select("doc_id", g.alias("g")).select("doc_id", "g.turkey", "g.basis", F.array_join("g.matched", ", ").alias("places"))


_BORDER = f"(^|[^{news.WORD}]){news.BORDER}($|[^ls])"
TURKEY_SQL = f"""with {HEADLINES}, s as (select doc_id, regexp_replace(x,{_q(news.NOT_A_PLACE)},' ','g') x from h),
 m as (select doc_id, {_names('x', news.FAR)} far, {_names('x', news.NEIGHBOURS, lambda c: news.whole(news.NEIGHBOURS[c]))} near, list_concat({_names('x', news.HOME + news.PROVINCES)}, case when {_has('x', _BORDER)} then ['{news.BORDER}'] else []::varchar[] end) home from s)
 select doc_id, len(far)=0 and (len(near)=0 or len(home)>0) turkey, case when len(far)>0 then 'far_country' when len(near)=0 then 'no_foreign_place' when len(home)>0 then 'neighbour_reaching_turkey' else 'neighbour_only' end basis,
 case when len(far)>0 then array_to_string(far,', ') when len(near)>0 then array_to_string(list_concat(near,home),', ') else '' end places from m"""


def provinces(spark, sf):
    return headlines(spark, sf).select("doc_id", news.province_in_title("title").alias("province"))


PROVINCE_SQL = f"""with {HEADLINES}, w as (select unnest([{', '.join(map(_q, news.PROVINCES))}]) w), d as (select distinct t from h),
 m as (select t, w, regexp_extract(t, '(?:^|[^{news.WORD}])'||w||'($|[^{news.WORD}].{{0,4}})', 1) rest from d, w where regexp_matches(t, '(^|[^{news.WORD}])'||w||'($|[^{news.WORD}])')),
 n as (select t, list_distinct(list(case w {' '.join(f"when {_q(a)} then {_q(b)}" for a, b in news.PROVINCE_NAMES.items())} else w end)) names from m where not regexp_matches(rest, {_q(news.FROM_ENDING)}) group by t)
 select doc_id, case when len(names)=1 then case names[1][1] when 'i' then 'İ' when 'ı' then 'I' else upper(names[1][1]) end || substr(names[1],2) end province from h left join n using (t)"""


def claims(spark, sf):
    text = F.concat_ws(" ", "title", "body")
    c = news.status_claim(text)
    return headlines(spark, sf).select("doc_id", news.relevance(text).alias("relevance"), c.alias("c")).select("doc_id", "relevance", "c.state", "c.rule", F.coalesce(F.array_join("c.suppressed", ", "), F.lit("")).alias("suppressed"))


#: The two rules that look ahead, said without it: one matches what follows too, the other counts what isn't denied.
_HELD, _DENIED = r"kontrol\s+alt[ıi]nda", r"kontrol\s+alt[ıi]nda\s+de[ğg]il"
_PLAIN = {
    "pos:sondurulu": _has("x", "s[öo]nd[üu]r[üu]l(?:d[üu]|m[üu][şs]t[üu]r|m[üu][şs])($|[^a-zçğıöşü])"),
    "pos:kontrol-altinda": f"len(regexp_extract_all(x, {_q(_HELD)})) > len(regexp_extract_all(x, {_q(_DENIED)}))",
}
_RULES = [(n, _PLAIN.get(n, _has("x", p)), s) for n, p, s in news.POSITIVE]
_NEG = " or ".join(_has("x", p) for _, p, _ in news.NEGATIVE)
_vetoed = lambda r: "(" + (" or ".join(_has("x", p) for _, p, targets in news.NEGATIVE if r in targets) or "false") + ")"
_pick = lambda state, free: " ".join(f"when {found}{f' and not {_vetoed(n)}' if free else ''} then {_q(n)}" for n, found, s in _RULES if s == state)
_LOST = ", ".join(f"case when {found} and {_vetoed(n)} then '{n} (vetoed)' end" for n, found, _ in _RULES)
CLAIM_SQL = f"""with {HEADLINES}, m as (select doc_id, x, {_NEG} negated,
 case {_pick('ongoing', False)} {' '.join(f"when {_has('x', p)} then {_q(n)}" for n, p, _ in news.NEGATIVE)} end going, case {_pick('extinguished', True)} {_pick('contained', True)} end done,
 array_to_string(list_filter([{_LOST}], lambda w: w is not null), ', ') lost,
 case when not {_has('x', news.FLAMES)} then 'no_fire_word' when {_has('x', news.FOREIGN)} then 'foreign_country' when {_has('x', news.VEGETATION)} then 'vegetation_fire' when {_has('x', news.STRUCTURE)} then 'structure_or_vehicle_fire' else 'no_vegetation_context' end relevance from h),
 r as (select *, case when negated or done is null then going else done end rule from m)
 select doc_id, relevance, rule, case when rule is null then null when rule=going then 'ongoing' when rule in ({', '.join(_q(n) for n, _, s in news.POSITIVE if s == 'extinguished')}) then 'extinguished' else 'contained' end state,
 case when rule is null then '' else concat_ws(', ', nullif(lost,''), case when negated and done is not null then done||' (contradicted)' end) end suppressed from r"""


def kinds(spark, sf):
    h = headlines(spark, sf)
    return h.select("doc_id", news.kind("title").alias("kind"), news.green("title").alias("green"), news.stage("title").alias("stage"), F.array_join(news.places_in_title("title", F.lit("Muğla")), ", ").alias("places"))


_K = {k: _has("t", p) for k, p in news.KINDS.items()}
KINDS_SQL = f"""with {HEADLINES}, k as (select *, case when {_K['blocked']} then null when {_K['recovery']} then 'recovery' when {_K['preparation']} then 'preparation' when {_K['field']} and {_K['fire']} and not contains(t,'orman yangın') then 'field'
 when contains(t,'orman') and {_K['fire']} then 'fire' when {_K['nature']} or ({_K['forester']} and {_K['forester_topic']}) then 'nature' when {_K['fire']} then 'fire' end kind, regexp_replace(t,{_q(news.NOT_A_PLACE)},' ','g') y from h)
 select doc_id, kind, coalesce(kind in ('recovery','preparation','nature'),false) and not {_has('y', news.whole(news.FAR))} and (not {_has('y', news.NEAR)} or {_has('y', news.REACHES_HOME)}) green,
 case {' '.join(f"when {_has('t', p)} then '{n}'" for n, p in news.STAGES)} end stage,
 array_to_string(list_filter(list_transform(regexp_extract_all(title,{_q(news.CASED_NAME)},1), lambda p: lower(replace(p,'İ','i'))), lambda p: p<>'muğla'), ', ') places from k"""


def incidents(spark, sf):
    """Incidents of the month of events, each in a city; every third has an official state."""
    city = F.element_at(F.array(*map(F.lit, CITIES)), (F.col("incident_id") % len(CITIES) + 1).cast("int"))
    return detections(spark, sf).groupBy("incident_id").agg(F.min("acquired_at").alias("first_at"), F.max("acquired_at").alias("last_at")).select("*", city.alias("city"), (F.col("incident_id") % 3 == 0).alias("official"))


INCIDENTS = f"{DET}, inc as (select incident_id, min(acquired_at) first_at, max(acquired_at) last_at, [{', '.join(map(_q, CITIES))}][incident_id%{len(CITIES)}+1] city, incident_id%3=0 official from det group by 1)"


def verdicts(spark, sf):
    text = F.concat_ws(" ", "title", "body")
    h = headlines(spark, sf).select("doc_id", "published_at", news.relevance(text).alias("reason"), news.status_claim(text).isNotNull().alias("claimed"), news.named_places(text, CITIES).alias("cities"))
    # few incidents stay open, so that a city has none, one or several
    left = incidents(spark, sf).where(~F.col("official") & (F.col("incident_id") % 89 == 1))
    asked = h.where(F.size("cities") == 1).select("doc_id", F.element_at("cities", 1).alias("city"), "published_at")
    found = stories.open_incidents(asked, left, "doc_id", LOOKBACK_DAYS, LOOKAHEAD_HOURS)
    age = (F.unix_timestamp(F.lit(AS_OF).cast("timestamp")) - F.unix_timestamp("published_at")) / 3600
    outcome = news.claim_outcome("reason", "claimed", "cities", "candidates", age, LOOKAHEAD_HOURS)
    return h.join(found, "doc_id", "left").select("doc_id", outcome.alias("outcome"), "incident_id").select("doc_id", "outcome", F.when(F.col("outcome") == "matched", F.col("incident_id")).alias("incident_id"))


VERDICT_SQL = f"""with {CLAIM_SQL.removeprefix('with ').replace(' select doc_id, relevance, rule, case', ', claims as (select doc_id, relevance, rule, case', 1)}), {INCIDENTS},
 c as (select doc_id, published_at, relevance, rule, {_names('x', CITIES, lambda n: f"(^|[^a-z0-9ğüşıöç]){n.replace('İ', 'i').lower()}")} cities from h join claims using (doc_id)),
 n as (select doc_id, count(*) n, min(incident_id) one from c join inc on len(cities)=1 and inc.city=cities[1] and not official and incident_id%89=1 and last_at >= published_at - interval {LOOKBACK_DAYS} day and first_at <= published_at + interval {LOOKAHEAD_HOURS} hour group by 1),
 o as (select doc_id, one, case when relevance<>'vegetation_fire' then 'irrelevant' when rule is null then 'no_claim' when len(cities)=0 then 'no_city' when len(cities)>1 then 'multiple_cities'
 when n is null and published_at > timestamp '{AS_OF}' - interval {LOOKAHEAD_HOURS} hour then 'deferred' when n is null then 'no_incident' when n=1 then 'matched' else 'multiple_incidents' end outcome from c left join n using (doc_id))
 select doc_id, outcome, case when outcome='matched' then one end incident_id from o"""


def confirmed(spark, sf):
    """Suppliers as the places that stories name, with the story's city from its number."""
    i = incidents(spark, sf).select("incident_id", "city", "first_at", "last_at", (36 + F.col("incident_id") * 53 % 600 / 100.0).alias("lat"), (26 + F.col("incident_id") * 37 % 1800 / 100.0).alias("lng"))
    city = F.element_at(F.array(*map(F.lit, CITIES)), (F.col("site_id") % len(CITIES) + 1).cast("int"))
    s = sites(spark, sf).select(F.col("site_id").alias("story_id"), city.alias("city"), F.timestamp_seconds(F.unix_timestamp(F.lit(AS_OF).cast("timestamp")) - F.col("site_id") % 40 * 43200).alias("published_at"), "lat", "lng")
    return stories.confirmed_incidents(i, s, RADIUS_KM, DAY_WINDOW).select("incident_id", "story_id", F.round("km", 6).alias("km"))


CONFIRMED_SQL = f"""with {INCIDENTS}, {SITES}, i as (select *, 36+incident_id*53%600/100.0e0 lat, 26+incident_id*37%1800/100.0e0 lng from inc),
 s as (select site_id story_id, [{', '.join(map(_q, CITIES))}][site_id%{len(CITIES)}+1] city, timestamp '{AS_OF}' - to_hours((site_id%40*12)::int) published_at, lat, lng from sites),
 p as (select incident_id, story_id, {haversine_sql('s.lat', 's.lng', 'i.lat', 'i.lng')} km from s join i on s.city=i.city
 and (published_at+interval 3 hour)::date between (first_at+interval 3 hour)::date-{DAY_WINDOW} and (last_at+interval 3 hour)::date+{DAY_WINDOW}),
 r as (select *, rank() over (partition by story_id order by km) r from p where km<={RADIUS_KM}), u as (select story_id, min(incident_id) incident_id, min(km) km from r where r=1 group by 1 having count(*)=1)
 select incident_id, story_id, round(km,6) km from (select *, row_number() over (partition by incident_id order by km, story_id) k from u) where k=1"""

QUERIES = {"t4_wildfire": wildfire, "t5_geography": turkey, "t6_provinces": provinces, "t8_status_claims": claims, "t11_kinds": kinds, "c27_verdicts": verdicts, "j24_confirmed": confirmed}
ORACLE = {"t4_wildfire": WILDFIRE_SQL, "t5_geography": TURKEY_SQL, "t6_provinces": PROVINCE_SQL, "t8_status_claims": CLAIM_SQL, "t11_kinds": KINDS_SQL, "c27_verdicts": VERDICT_SQL, "j24_confirmed": CONFIRMED_SQL}
