"""Texts with very many secrets: spans and redaction against plain readings."""

import re

import pytest
from pyspark.sql import functions as F

from lumenframe.llm import secrets


@pytest.mark.parametrize("op, plain", [(lambda a, b: a + b, lambda a, b: a + b), (F.greatest, max)])
def test_running_values(spark, op, plain):
    for n in (1, 2, secrets.CHUNK, secrets.CHUNK + 1, 5 * secrets.CHUNK + 7):
        values, want, so_far = [(k * 37) % 101 for k in range(n)], [], 0
        for v in values:
            want.append(so_far)
            so_far = plain(so_far, v)
        assert spark.createDataFrame([(values,)], "v array<long>").select(secrets.before(F.col("v"), op)).first()[0] == want


def redacted(text, spans):
    at, out = 0, ""
    for start, kind, stop in spans:
        if start >= at:
            out += text[at:start] + f"[{kind.upper()}]"
        at = max(at, stop)
    return out + text[at:]


def test_redaction_equals_a_plain_reading(spark):
    hexed, key = "0123456789abcdef" * 2, "AKIA" + "Q" * 17
    texts = [f"é\U0001f600 token={hexed} {key} x" * n + "ü" for n in (1, 40, 150)] + [f"secret: {key}{hexed}", hexed, "", "plain", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    spans = {r["doc_id"]: [(s["start"], s["kind"], s["stop"]) for s in r["spans"]] for r in secrets.findings(docs, secrets.scan(docs)).collect()}
    assert got == {k: t if t is None else redacted(t, spans[k]) for k, t in enumerate(texts)}
    assert len(spans[2]) == 450


def test_a_hundred_thousand_matches(spark):
    text = "".join(f"token=é{k % 10}bcdef{k:06d} " if k % 3 else f"token=abc{k:06d} " for k in range(100_000))
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    got = [(s["start"], s["stop"]) for s in secrets.findings(docs, secrets.scan(docs)).first()["spans"]]
    assert got == [m.span() for m in re.finditer(r"token=([A-Za-z0-9+/_.=-]+)", text) if len(m.group(1)) >= 6]
    assert secrets.redact(docs).first()["text"] == re.sub(r"token=([A-Za-z0-9+/_.=-]+)", lambda m: "[ASSIGN]" if len(m.group(1)) >= 6 else m.group(), text)
