"""District mentions: nations as districts of their regions, some in two, and texts that name them.

A text is a made headline, which may name a region, followed by the whole text of its document.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import matching
from ..functions.text import turkish_lower
from ..operators import mentions
from ..sources.tables import table

#: What stands behind a nation's name in a headline, and behind that.
ENDING = ["'da", "’daki", " ilçesinde", "de", "", " ile", "ndaki", "'nde", "'dan"]
SECOND = ["", "", "", " ve Nation3'te", " ve Nation7", ""]
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


def _name():
    """Every fourth nation has a name of two words."""
    joined = F.replace("n_name", F.lit("_"), F.when(F.col("n_nationkey") % 4 == 1, " ").otherwise(""))
    return F.initcap(joined).alias("name")


def districts(spark, sf):
    """Nations as districts of their region; every fifth one's name also belongs to the next region."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("province"))
    twin = n.where("n_nationkey % 5 = 0").select((F.col("n_nationkey") + 100).alias("district_id"), _name(), ((F.col("n_regionkey") + 1) % 5).alias("k"))
    own = n.select(F.col("n_nationkey").alias("district_id"), _name(), F.col("n_regionkey").alias("k"))
    return own.union(twin).join(r, "k").select("district_id", "name", "province")


def texts(spark, sf):
    d = table(spark, sf, "documents")
    names = table(spark, sf, "nation").select((F.col("n_nationkey") % 25).alias("m"), _name())
    part = lambda words, by: F.element_at(F.array(*map(F.lit, words)), (F.floor(F.col("doc_id") / by) % len(words) + 1).cast("int"))
    province = F.when(F.col("doc_id") % 3 == 0, F.concat(F.initcap(part(REGIONS, 5)), F.lit(" bölgesi: "))).otherwise("")
    title = F.concat(province, "name", part(ENDING, 25), part(SECOND, 7), F.lit(" orman yangını. "))
    provinces = matching.whole_words(turkish_lower(title), [r.lower() for r in REGIONS])
    return d.withColumn("m", F.col("doc_id") % 25).join(F.broadcast(names), "m").select("doc_id", F.concat(title, F.coalesce("text", F.lit(""))).alias("text"), provinces.alias("provinces"))


def mentioned(spark, sf):
    return mentions.single_district(texts(spark, sf), districts(spark, sf), "doc_id", "text", "provinces")


_L = "a-zçğıöşüâîû0-9"
MENTION_SQL = f"""with n as (select n_nationkey, n_regionkey, lower(replace(n_name,'_',case when n_nationkey%4=1 then ' ' else '' end)) low from nation),
 g0 as (select n_nationkey id, n_regionkey k, low from n union all select n_nationkey+100, (n_regionkey+1)%5, low from n where n_nationkey%5=0),
 g as (select id, low, lower(r_name) province from g0 join region on r_regionkey=k),
 h as (select doc_id, lower((case when doc_id%3=0 then ['Africa','America','Asia','Europe','Middle East'][(doc_id//5)%5+1]||' bölgesi: ' else '' end)||low||
  ['''da','’daki',' ilçesinde','de','',' ile','ndaki','''nde','''dan'][(doc_id//25)%9+1]||['','','',' ve Nation3''te',' ve Nation7',''][(doc_id//7)%6+1]||' orman yangını. ') t, coalesce(text,'') text from documents join n on n_nationkey=doc_id%25),
 p as (select doc_id, t||lower(replace(text,'İ','i')) x, list_filter([{', '.join(f"case when regexp_matches(t,'(^|[^{_L}]){r.lower()}($|[^{_L}])') then '{r.lower()}' end" for r in REGIONS)}], lambda r: r is not null) provinces from h),
 u as (select distinct low from g), f as (select doc_id, provinces, u.low from p join u on contains(x, u.low) and regexp_matches(x, '(^|[^{_L}])'||u.low||'([''’]?n?[dt][ae](ki)?|\\s+il[çc]esi(n?[dt][ae](ki)?)?)($|[^{_L}])')),
 c as (select doc_id, id, provinces, len(provinces)=1 and g.province=provinces[1] there from f join g using (low)),
 k as (select doc_id, id from (select *, bool_or(there) over (partition by doc_id) anywhere from c) where there or not anywhere),
 s as (select doc_id, count(distinct id) n, min(id) id from k group by 1)
 select doc_id, coalesce(n,0)::bigint mentions, case when n=1 then id end district_id, case when n=1 then 'district' when n>1 then 'ambiguous_district' when len(provinces)=1 then 'province_only' else 'no_place' end place from p left join s using (doc_id)"""

QUERIES = {"t10_district_mention": mentioned}
ORACLE = {"t10_district_mention": MENTION_SQL}
