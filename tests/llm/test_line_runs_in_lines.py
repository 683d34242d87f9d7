"""Repeated passages that start or end inside a line, the exact setting, and columns with the operator's own names."""

import random
import re
from collections import defaultdict

from lumenframe.llm import line_runs

BREAK = re.compile(r"[\n ](?:(?<=\n)|(?<=[^.!?][.!?] ))[ \t-\r]*")


def texts(frame, **kw):
    return {r["doc_id"]: r["text"] for r in line_runs.remove_repeats(frame, **kw).collect()}


def test_passage_inside_longer_lines(spark):
    passage = " ".join(f"Sentence {n} of the passage has these words." for n in range(8))
    docs = [
        (1, f"Some own words first. {passage} Then more of its own.\nlast line"),
        (2, f"title\nAnother start here! {passage} Another end."),
        (3, f"{passage}\n\nown line"),
        (4, f"No start. {passage[:120]} cut short and no more."),
        (5, f"begins {passage} ends"),
        (6, f"top\n  {passage}\nbottom"),
    ]
    found = texts(spark.createDataFrame(docs, "doc_id long, text string"))
    assert found[1] == docs[0][1] and found[4] == docs[3][1]
    assert found[2] == "title\nAnother start here! Another end."
    assert found[3] == "own line" and found[6] == "top\n  bottom"
    # a sentence that begins with other words is another unit
    assert found[5] == "begins Sentence 0 of the passage has these words. ends"


def test_any_repeated_line(spark):
    license_line = "Licensed under the terms that the authors of this file chose."
    docs = [(n, f"own text {n}\n{license_line}\nmore own {n}") for n in range(5)]
    found = texts(spark.createDataFrame(docs, "doc_id long, text string"), min_words=1)
    assert found[0] == docs[0][1] and all(found[n] == f"own text {n}\nmore own {n}" for n in range(1, 5))


def brute(docs, min_words):
    """Every stretch of min_words words that an earlier place holds loses its later places."""
    units = {d: BREAK.split(t) for d, t in docs}
    places = defaultdict(list)
    for d in sorted(units):
        own = units[d]
        for i in range(len(own)):
            for j in range(i + 1, len(own) + 1):
                words = [len(x.split()) for x in own[i:j]]
                if sum(words) >= min_words and all(words) and (sum(words[1:]) < min_words or sum(words[:-1]) < min_words):
                    places[tuple(x.strip() for x in own[i:j])].append((d, i, j))
    gone = defaultdict(set)
    for found in places.values():
        for d, i, j in sorted(found)[1:]:
            gone[d] |= set(range(i, j))
    out = {}
    for d, t in docs:
        breaks, text, last = BREAK.findall(t), "", None
        for k in (k for k in range(len(units[d])) if k not in gone[d]):
            if last is not None:
                inside = breaks[last:k]
                text += next((b for b in inside if "\n" in b), inside[0])
            text, last = text + units[d][k], k
        out[d] = text
    return out


def test_sentences_and_lines_match_brute_force(spark):
    draw = random.Random(5)
    pool = ["".join(draw.choice("ab  \t") for _ in range(draw.randrange(1, 9))).strip() + draw.choice([".", "!", "", " x?"]) for _ in range(12)]
    docs = [(d, "".join(draw.choice(pool) + draw.choice([" ", "\n", "\n \n", ". "]) for _ in range(draw.randrange(0, 14)))) for d in range(150)]
    for min_words in (1, 3, 6):
        assert texts(spark.createDataFrame(docs, "doc_id long, text string"), min_words=min_words) == brute(docs, min_words)


def test_clashing_names_repeats_and_null_ids(spark):
    passage = " ".join(f"w{n}" for n in range(60))
    rows = [(1, passage, "a", 1, "r"), (1, passage, "a", 2, "s"), (2, passage, "b", 3, None), (None, passage, "c", 4, "t"), (3, None, "d", 5, "u")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, row string, i int, cut_lines string")
    found = sorted(line_runs.remove_repeats(frame).collect(), key=lambda r: r["i"])
    assert found[0].asDict().keys() == set(frame.columns)
    # the null id comes first and keeps the passage
    assert [r["text"] for r in found] == ["", "", "", passage, None] and [r["cut_lines"] for r in found] == ["r", "s", None, "t", "u"]


def test_lines_and_texts_are_not_sorted(spark):
    """Joins of places and of texts hash the smaller side; trimming gives the lines' own digests."""
    from lumenframe.llm import line_runs

    passage = " ".join(f"w{n}" for n in range(60))
    rows = [(1, f"\t {passage} \x0b\nown one"), (2, f"own two\n{passage}"), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cut = line_runs.with_cuts(docs)
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    assert {r["row"]["doc_id"]: r["row"]["text"] for r in cut.collect()} == {1: rows[0][1], 2: "own two", 3: None, 4: ""}


def test_stretches_share_sorts_and_ranks_are_dealt_once(spark):
    draw = random.Random(9)
    lines = [f"{'w ' * draw.randrange(1, 9)}l{n}" for n in range(30)]
    docs = spark.createDataFrame([(d, "\n".join(draw.choice(lines) for _ in range(20))) for d in range(60)] + [(7, "\n".join(lines))] * 3, "doc_id long, text string")
    places = line_runs.lines_of(docs).selectExpr("d", "h", "i", "words", "x as rank")
    stretched = line_runs._stretched(places, 12)
    rows = stretched.collect()
    assert len(rows) == len({(r["d"], r["h"], r["i"]) for r in rows}) > 500
    plan = stretched._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert "Aggregate" not in plan and plan.count("Sort [") <= 3

    deleted = line_runs.deleted_lines(docs, 12)
    assert deleted.count() > 30
    assert {r["d"]: r["cut_lines"] for r in deleted.collect()}.keys() >= {7}
    # digests' ranks rise with the digests without a pass that finds ranges
    groups = line_runs.lines_of(docs).groupBy("x", "y").count().withColumnRenamed("count", "c")
    ranked = sorted((r["x"], r["y"], r["rank"]) for r in line_runs._ranked_digests(groups).collect())
    assert [r[2] for r in ranked] == sorted({r[2] for r in ranked}) and len(ranked) == 30
