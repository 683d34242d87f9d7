"""Fill-in-middle, token counts and hard negatives against plain forms, the library and SQL, and on awkward rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from compare import differences
from pyspark.sql import functions as F

from lumenframe.llm import fill_middle, hard_negatives, queries, token_counts

SF = "/root/testdata/sf0.01"
UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
DOCS = "doc_id long, text string, n string, form string, h0 string, n_tokens string"


@pytest.fixture(scope="module")
def odd(spark):
    long = "word and more words. " * 4000
    texts = [None, "", " ", "a", "\n\n", long, long, "é\x01\x02 \x1c a", "has <M> inside", "日本語 text ǅ ½", "x" * 30_000, "<|endoftext|>a <|startoftext|>"]
    rows = [(i, t, "x", "y", None, "z") for i, t in enumerate(texts)] + [(107, "same", None, None, None, None), (107, "same", None, None, None, None), (None, "no id", None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def plain_form(doc_id, text):
    """(n, form, prefix, middle, output) by lists of units."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = UNIT.findall(text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_middle_against_unit_lists_and_sql(spark, odd):
    for row in fill_middle.fill_in_middle(odd).select("*", fill_middle.restored().alias("back")).collect():
        texts = [r["text"] or "" for r in odd.where(F.col("doc_id").eqNullSafe(F.lit(row["doc_id"]))).collect()]
        assert row["back"] in texts
        assert (row["n"], row["form"], row["prefix_chars"], row["middle_chars"], row["output"]) == plain_form(row["doc_id"], row["back"])
    assert differences(queries.op11_fill_middle(spark, SF), fill_middle.oracle_sql(), SF) == []
    made = queries.op11_fill_middle(spark, SF).groupBy("form").count().collect()
    assert {r["form"] for r in made} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(odd.limit(0)).count() == 0


def test_ranked_bits():
    rng = random.Random(5)
    for width in (1, 2, 63, 64, 65, 1000):
        mask = rng.getrandbits(width)
        places = [i for i in range(width) if mask >> i & 1]
        assert [fill_middle.ranked_bit(mask, k, width) for k in range(len(places) + 1)] == [*places, width]


def test_token_counts_are_the_library_s(spark, odd):
    from tokenizers import Tokenizer

    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = queries.tokenizer_file(name)
        library = Tokenizer.from_file(path)
        counter = token_counts.MergeCounter(path)
        assert counter.by_words == (name == "word_bpe_49k.json")
        rng = random.Random(9)
        signs = "abcXYZ'sdmt ..,!?\n\t\x1c\u0085 éßÉ½²µİıΣσςǅ日本🙂ȩ́<|>{}0123​　ﬁ"
        texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(1500)]
        texts += ["<|endoftext|>x <|startoftext|><|endoftext|>", "Ã© é Ã©", "don't WON'T I'LL", "ab" * 20_000, "é" * 5000, ""]
        import pyarrow as pa

        assert counter.counts(pa.array(texts, pa.string())).tolist() == [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]
        for row in token_counts.count_tokens(odd, path).join(odd.select("doc_id", "text"), "doc_id").collect():
            assert row["n_tokens"] == len(library.encode(row["text"] or "", add_special_tokens=False).ids) and row["n_bytes"] == len((row["text"] or "").encode())
    assert token_counts.count_tokens(odd.limit(0), path).count() == 0
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    library = Tokenizer.from_file(queries.tokenizer_file("word_bpe_49k.json"))
    found = {r["doc_id"]: (r["n_tokens"], r["over_limit"]) for r in queries.op12_token_counts(spark, SF).collect()}
    rows = docs.collect()
    sizes = [len(x.ids) for x in library.encode_batch([r["text"] or "" for r in rows], add_special_tokens=False)]
    assert found == {r["doc_id"]: (n, n > 2048) for r, n in zip(rows, sizes)}
    with pytest.raises(ValueError):
        token_counts.check_model({"type": "Unigram"}, "a file")


def plain_mining(rows, anchors, positives=5, negatives=3):
    out = []
    usable = [(i, lab, [int(np.floor(256 * float(x))) for x in v]) for i, v, lab in rows if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for ai, al, av in {(i, lab, tuple(v)) for i, lab, v in usable if anchors(i)}:
        scored = sorted((-dot(av, v), i, lab) for i, lab, v in usable if len(v) == len(av))
        for ps, pi, _ in [x for x in scored if x[2] == al and x[1] != ai][:positives]:
            inside = [x for x in scored if x[2] != al and 50 * -ps <= 100 * -x[0] <= 95 * -ps][:negatives]
            out += [(ai, pi, k + 1, ni, -ps, -ns) for k, (ns, ni, _) in enumerate(inside)]
    return sorted(out)


def test_hard_negatives_against_all_pairs_and_sql(spark, monkeypatch):
    assert differences(queries.op13_hard_negatives(spark, SF), hard_negatives.ORACLE, SF) == []
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 6))
    rows = [(i, (base[i % 12] + 0.4 * rng.normal(size=6)).astype(np.float32).tolist(), int(i % 3)) for i in range(400)]
    rows += [(400 + i, base[0].astype(np.float32).tolist(), int(i % 2)) for i in range(150)]  # one very common vector
    rows += [(20, rows[20][1], rows[20][2])] * 2 + [(20, rows[21][1], 1), (None, rows[1][1], 1), (601, None, 1), (610, [], 1), (620, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (630, [float("nan")] * 6, 2), (640, [float("inf")] * 6, 2), (650, rows[3][1], None), (660, [1.0, 2.0], 1), (661, [1.0, 2.0], 1), (662, [0.9, 1.5], 2), (670, [0.0] * 6, 0), (680, [-1.0] * 6, 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("codes", F.lit(1)).withColumn("score", F.lit(2))
    want = plain_mining(rows, lambda i: i % 10 == 0)
    assert want
    for tile_anchors, tile_rows, band_rows, anchor_rows in ((256, 2048, 65536, 4096), (7, 32, 100, 9)):
        for name, value in (("TILE_ANCHORS", tile_anchors), ("TILE_ROWS", tile_rows), ("BAND_ROWS", band_rows), ("ANCHOR_ROWS", anchor_rows)):
            monkeypatch.setattr(hard_negatives, name, value)
        assert sorted(map(tuple, hard_negatives.mine(vectors, F.col("vec_id") % 10 == 0).collect())) == want
    assert hard_negatives.mine(vectors.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_bounds_hold_for_nearly_orthogonal_directions():
    rng = np.random.default_rng(1)
    x = np.rint(rng.normal(size=(200, 40)) * 300).astype(np.int64)
    rotation = hard_negatives.Rotation(x[:50].astype(float))
    rotation.directions = rotation.directions + 1e-9  # worse than any rounding
    rotation.slack += np.linalg.norm(rotation.directions.T @ rotation.directions - np.eye(rotation.directions.shape[1]))
    told, length, rest = rotation.of(x)
    exact = (x @ x.T).astype(float)
    for k, step in enumerate(rotation.steps):
        error = rest[:, k, None] * rest[None, :, k] + rotation.slack * length[:, None] * length[None, :]
        assert (np.abs(told[:, :step] @ told[:, :step].T - exact) <= error).all()


def test_percent_is_exact_at_the_ends():
    for score in (0, 1, 19, 20, 99, 100, 101, 2**62 - 1, -1, -99, -(2**62)):
        got = [int(hard_negatives.percent(np.array([score]), p, up)[0]) for p, up in ((50, True), (95, False))]
        assert got == [-((-50 * score) // 100), 95 * score // 100]
