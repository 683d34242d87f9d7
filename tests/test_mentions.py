"""District mentions and the one-pass matcher, held against known answers and against a pattern a word."""

import random
import re

from pyspark.sql import functions as F

from lumenframe.functions import matching, news
from lumenframe.operators import mentions

DISTRICTS = [("Kaş", "Antalya"), ("Kemer", "Antalya"), ("Kemer", "Burdur"), ("Edremit", "Balıkesir"), ("Edremit", "Van"), ("Araç", "Kastamonu"), ("Akdeniz", "Mersin"), ("Silivri", "İstanbul"), ("Bodrum", "Muğla"), ("Merkez", "Burdur"), ("On Dokuz Mayıs", "Samsun"), (None, "Muğla"), ("Kaş", "Antalya")]
PROVINCES = ["Antalya", "Balıkesir", "Van", "Burdur", "Kastamonu", "Mersin", "İstanbul", "Muğla", "Samsun"]
# the places that reporters' headlines stand for, or why there is none
ANSWERS = {
    "Antalya'nın Kaş ilçesinde orman yangını": "Kaş", "Kaş'ta orman yangınıyla mücadele": "Kaş", "Kaş'taki orman yangını": "Kaş", "Silivri'de otluk alanda yangın": "Silivri", "Bodrumda makilik alanda yangın": "Bodrum",
    "Balıkesir'de yangın: Edremit'te alevler": "Edremit", "Edremit'te orman yangını": "ambiguous_district", "Antalya Kemer'de orman yangını": "Kemer", "Kaş'ta ve Kemer'de orman yangını": "ambiguous_district",
    "13 araç birbirine girdi": "no_place", "Araç'ta anız yangını": "Araç", "yangın riski Ege ve Akdeniz ile sınırlı değil": "no_place", "Merkez'de otluk alanda yangın": "no_place", "Muğla'da orman yangını": "province_only",
    "On Dokuz Mayıs’ta yangın": "On Dokuz Mayıs", "KAŞ İLÇESİ": "Kaş", "": "no_place", None: "no_place", "Kaş'tan haber": "no_place", "aKaş'ta": "no_place", "Kaş'tane": "no_place",
}


def test_known_mentions(spark):
    texts = spark.createDataFrame(list(enumerate(ANSWERS)), "id long, text string")
    texts = texts.withColumn("provinces", F.coalesce(news.named_places("text", PROVINCES), F.array().cast("array<string>"))).withColumn("name", F.lit(1)).withColumn("province", F.lit(2))
    ids = [(7 if n == "Kaş" else k, n, p, "x") for k, (n, p) in enumerate(DISTRICTS, 10)]
    districts = spark.createDataFrame(ids, "district_id long, name string, province string, text string")
    names = {i: n for i, n, *_ in ids}
    found = {r["id"]: names.get(r["district_id"]) or r["place"] for r in mentions.single_district(texts, districts, "id", "text", "provinces").collect()}
    assert {t: found[i] for i, t in enumerate(ANSWERS)} == ANSWERS
    assert mentions.single_district(texts.limit(0), districts, "id", "text", "provinces").count() == 0
    assert {r["mentions"] for r in mentions.single_district(texts, districts.limit(0), "id", "text", "provinces").collect()} == {0}


def test_gate(spark):
    text = spark.createDataFrame([("Kaş'ta orman yangını kontrol altına alındı",), ("Kaş'ta orman yangınına müdahale ediliyor",), ("Kaş'ta ormanlık alanda yangın çıktı",), ("Tunus'ta orman yangınları",), ("Kaş'ta pazar",)], "t string")
    gate = mentions.sighting_gate(news.relevance("t"), news.status_claim("t")["state"], F.lit("district"))
    assert [r[0] for r in text.select(gate).collect()] == ["status_claim_excluded", "pass", "pass", "irrelevant", "irrelevant"]


def test_sets_find_what_patterns_find(spark):
    rng = random.Random(2)
    words = ["a", "an", "ana", "new york", "york", "new", "çin", "in", "ana an a", "x9"]
    texts = ["".join(rng.choice(["a", "n", "new", " york", " ", "çin", "'", "-", "x9", "\n", "ana an a"]) for _ in range(rng.randrange(1, 12))) for _ in range(400)] + ["", None, "a new york " * 50_000, "n" * 300_000, "a  new york", " ana an a ", "new  york", "new\tyork"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", matching.whole_words("t", words).alias("whole"), matching.at_starts("t", words).alias("starts"))
    for r in df.collect():
        if r["t"] is None:
            continue
        letters = news.WORD
        assert r["whole"] == [w for w in words if re.search(f"(^|[^{letters}]){w}($|[^{letters}])", r["t"])], r["t"]
        assert r["starts"] == [w for w in words if re.search(f"(^|[^{matching.NAME_LETTERS}]){w}", r["t"])], r["t"]
