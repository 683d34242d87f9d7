"""Fingerprints against brute force over paragraphs, retries, punctuation, and awkward rows."""

import hashlib
import re

import pytest

from lumenframe.llm import queries, sketches

SF = "/root/testdata/sf0.001"
BREAK = re.compile(r"[\n ](?:(?<=\n)|(?<=[^.!?][.!?] ))[ \t-\r]*")


def paragraphs(text):
    return {u for u in BREAK.split(text) if u.strip(" \t\n\x0b\x0c\r")}


def likeness(a, b):
    a, b = paragraphs(a), paragraphs(b)
    return 1.0 if not a and not b else 2 * len(a & b) / (len(a) + len(b))


def brute(docs):
    docs = sorted(docs, reverse=True)
    for (d, t), (_, then) in zip(docs, docs[1:] + docs[:1]):
        k = len(t) // 3
        edited = t[: len(t) - k] + then[:k]
        yield d, len(t), edited, likeness(t, edited), likeness(t, then)


def test_query_matches_brute_force(spark):
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {d: (n, hashlib.sha256(e.encode()).hexdigest(), x, y) for d, n, e, x, y in brute(docs)}
    found = queries.op9_fingerprints(spark, SF).collect()
    assert len(found) == len(docs) and len({x for *_, x, _ in want.values()}) > 20
    for r in found:
        n, sha, x, y = want[r["doc_id"]]
        assert (r["n_chars"], r["edited_sha256"]) == (n, sha)
        assert (r["near_edited"], r["near_next"]) == (pytest.approx(x), pytest.approx(y))
    by_text = {}
    for d, t in docs:
        by_text.setdefault(frozenset(paragraphs(t)), set()).add(next(r["fingerprint"] for r in found if r["doc_id"] == d))
    prints = [p for ps in by_text.values() for p in ps]
    assert all(len(ps) == 1 for ps in by_text.values()) and len(set(prints)) == len(by_text)


def test_punctuation_counts(spark):
    docs = spark.createDataFrame([(3, "Pay now. Do it!"), (2, "Pay now? Do it."), (1, "Do it; Pay now; Pay now")], "doc_id long, text string")
    found = sketches.compare_edits(docs).collect()
    assert len({r["fingerprint"] for r in found}) == 3 and {r["doc_id"]: r["near_next"] for r in found} == {3: 0.0, 2: 0.0, 1: 0.0}


def test_larger_tables_are_tried_until_they_peel(spark):
    """Sizes that can't hold the difference fail one after the other; the answer stays exact, or the query stops."""
    texts = [(2, "\n".join(f"line {n}" for n in range(60))), (1, "\n".join(f"line {n}" for n in range(30, 100)))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for sizes in (sketches.SIZES, (3, 6, 12, 24, 48, 96, 192, 384)):
        assert {r["doc_id"]: r["near_next"] for r in sketches.compare_edits(docs, sizes).collect()} == {2: pytest.approx(60 / 130), 1: pytest.approx(60 / 130)}
    with pytest.raises(Exception, match="failed to peel"):
        sketches.compare_edits(docs, (3,)).collect()


def test_awkward_rows(spark):
    rows = [(None, "a"), (None, "b"), (None, None), (5, "same"), (5, "same"), (5, "other"), (1, ""), (2, "é\x01\U0001f600 x")]
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, text string, h string, d int, edited string")
    found = sketches.compare_edits(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_chars"]) for r in found) == sorted((str(d), len(t or "")) for d, t in rows)
    assert len({r["fingerprint"] for r in found if r["n_chars"] == 4}) == 1
    assert sketches.compare_edits(docs.limit(0)).count() == 0
    one = sketches.compare_edits(docs.where("doc_id = 1").unionByName(docs.where("doc_id = 1"))).collect()
    assert [(r["near_edited"], r["near_next"], r["edited"]) for r in one] == [(1.0, 1.0, "")] * 2
