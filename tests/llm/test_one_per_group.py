"""The near-duplicate stage decides by row and group, not by doc_id alone."""

from lumenframe.llm import simhash

SCHEMA = "doc_id long, text string"
TEXTS = ["one quiet river ran below the old mill and past the town", "seven loud engines were tested at night beside a closed road", "her garden holds late roses, beans and a row of young pears"]


def kept(spark, rows):
    return sorted(simhash.one_per_group(spark.createDataFrame(rows, SCHEMA)).collect(), key=repr)


def test_null_ids_keep_every_text(spark):
    a, b, c = TEXTS
    # a null id beside a numbered copy, and two texts that only null ids hold, one of them twice
    found = kept(spark, [(1, a), (None, a), (None, b), (None, c), (None, c)])
    assert sorted(map(tuple, found), key=repr) == sorted([(1, a), (None, b), (None, c)], key=repr)


def test_one_id_with_two_texts(spark):
    a, b, c = TEXTS
    # 5 has b of its own and a copy of 2's text; 7 has two texts that nothing else holds
    found = kept(spark, [(2, a), (5, a), (5, b), (7, c), (7, c + " and more words that make it quite another one indeed"), (5, b)])
    assert {r["text"] for r in found} == {a, b, c, c + " and more words that make it quite another one indeed"}
    assert sorted(r["doc_id"] for r in found) == [2, 5, 7, 7]
