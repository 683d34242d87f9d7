"""Quality is learned from whole texts, however far on the telling part lies."""

import random

from pyspark.sql import functions as F

from lumenframe.llm import quality


def test_tails_train_and_calibrate(spark):
    draw = random.Random(7)
    words = lambda pool, n: " ".join(draw.choice(pool) for _ in range(n))
    same, good, bad = ([f"{k}{draw.randrange(10**6)}" for _ in range(300)] for k in ("plain", "fine", "junk"))
    # every text begins with 17,000 characters or more that tell nothing
    docs = [(i, words(same, 1700) + " " + words((bad, good)[i % 2], 1700)) for i in range(120)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert all(len(t.split(" junk")[0].split(" fine")[0]) > 16_384 for _, t in docs)
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int")
    model = quality.fit(frame, labels, F.lit(True))
    assert b"junk" in model.bad and b"fine" in model.good
    found = {r["doc_id"]: r["score"] for r in quality.score(frame, model).collect()}
    assert all((found[i] >= 0.5) == bool(i % 2) for i in range(80, 120))
