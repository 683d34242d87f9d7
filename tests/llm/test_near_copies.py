"""The near-copy stage against a brute-force join on edited copies."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string"


def brute(docs):
    """One (doc_id, text) of each component of texts with a 5-word Jaccard similarity of 0.8 or more."""
    sets = []
    for _, text in docs:
        w = (text or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    out = {}
    for g, row in zip(group, docs):
        out[g] = min(out.get(g, row), row)
    return sorted(out.values())


def edited(draw, words, edits):
    words = list(words)
    for _ in range(edits):
        words[draw.randrange(len(words))] = f"new{draw.randrange(10**6)}"
    return words


def test_stage_matches_a_brute_force_join(spark):
    draw = random.Random(5)
    passage = [f"p{n}" for n in range(60)]
    docs = []
    for _ in range(40):
        base = [f"w{draw.randrange(5000)}" for _ in range(draw.randrange(20, 400))]
        for _ in range(draw.randrange(1, 6)):
            docs.append((len(docs), " ".join(edited(draw, base, draw.randrange(max(2, len(base) // 25))) + (passage if draw.random() < 0.3 else []))))
    docs += [(len(docs), ""), (len(docs) + 1, "two words"), (len(docs) + 2, "Two  words")]
    found = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(docs, SCHEMA), "").collect()
    want = brute(docs)
    assert len(want) < len(docs) * 0.8
    assert sorted(map(tuple, found)) == want


def test_simhash_tells_close_copies_by_one_pair_a_text(spark):
    from lumenframe.llm import near_copies

    draw = random.Random(8)
    base = [f"w{draw.randrange(5000)}" for _ in range(3000)]
    close = [" ".join(base[:k] + ["new"] + base[k:]) for k in range(0, 3000, 100)]
    other = [" ".join(f"v{draw.randrange(5000)}" for _ in range(300)) for _ in range(20)]
    sketched = near_copies._sketched(spark.createDataFrame(list(enumerate(close + other)), SCHEMA)).cache()
    pairs = [tuple(r) for r in near_copies._simhash_pairs(sketched).collect()]
    assert len(pairs) == len(close) - 1 and len({t for p in pairs for t in p}) == len(close)


def test_texts_on_one_passage_meet_by_their_own_words(spark):
    from lumenframe.llm import near_copies

    draw = random.Random(11)
    passage = [f"p{n}" for n in range(90)]
    texts = [" ".join(passage + [f"own{k}x{n}" for n in range(40)]) for k in range(120)]  # about 0.5 alike
    for k in range(0, 20, 2):  # 0.8 alike or somewhat below
        words = texts[k].split()
        texts.append(" ".join(edited(draw, words, 2 + k // 8)))
    rows = [(t, t, len(near_copies.shingle_set(text)), [int(x) for x in near_copies.shingle_set(text).view("int64")]) for t, text in enumerate(texts)]
    sets = spark.createDataFrame([(t, n, s) for t, _, n, s in rows], "t long, n long, shingles array<long>").cache()
    pairs, own = near_copies._across(sets.select("t", F.col("t").alias("g")), sets)
    whole = {t: set(s) for t, _, _, s in rows}
    want = {(a, b) for a in whole for b in whole if a < b and len(whole[a] & whole[b]) >= 0.8 * len(whole[a] | whole[b])}
    assert len(want) >= 5
    assert {tuple(r) for r in near_copies._confirmed(pairs, own).collect()} == want
    assert pairs.count() <= 20  # all pairs across groups are 8,385
    joined = near_copies._across(sets.select("t", F.lit(0).alias("g")), sets)[0]
    assert joined.isEmpty()
