"""The composed grammar against a plain reading of the clauses, and decisions that hang on the clause."""

import random

import pytest
from pyspark.sql import functions as F

from lumenframe.llm import toxicity

WORDS = {"I": "idiot", "T": "kill", "Y": "you", "N": "not", "R": "said", "Q": '"', "E": ".", "o": "lamp"}


def plain_reading(symbols):
    """Clause by clause, word by word, with the rules as sentences."""
    out = {}
    quoted = False
    clause, clauses = [], []
    for s in symbols:
        if s == "E":
            clauses.append(clause)
            clause = []
        else:
            clause.append(s)
    for clause in [*clauses, clause]:
        reach, told, heads, framed, aimed = 0, False, {"insult": set(), "threat": set()}, {"insult": False, "threat": False}, False
        for s in clause:
            if s == "Q":
                if quoted:
                    quoted = told = False
                elif told:
                    quoted, told = True, False
                continue
            head = {"I": "insult", "T": "threat"}.get(s)
            if head:
                heads[head].add("reported" if quoted or told else "negated" if reach else "plain")
            else:
                framed = {"insult": True, "threat": True}
            reach = 3 if s == "N" else max(0, reach - 1)
            aimed |= s == "Y"
            if s == "R" and not quoted:
                told = True
        for kind, how in heads.items():
            if how and framed[kind]:
                best = next(h for h in ("plain", "negated", "reported") if h in how)
                name = f"aimed_{kind}" if best == "plain" and aimed else kind if best == "plain" else f"{best}_{kind}"
                out[name] = out.get(name, 0) + 1
    return out


def test_composition_equals_a_plain_reading():
    draw, grammar = random.Random(8), toxicity.Grammar({"idiot"})
    met = set()
    for _ in range(4000):
        symbols = draw.choices("ITYNRQEo", [3, 2, 2, 2, 2, 2, 3, 5], k=draw.randrange(14))
        counts = grammar.counts(" ".join(WORDS[s] for s in symbols))
        found = {p: int(c) for p, c in zip(toxicity.PATTERNS, counts) if c}
        assert found == plain_reading(symbols), symbols
        met |= set(found)
    assert met == set(toxicity.PATTERNS)


@pytest.fixture(scope="module")
def model(spark):
    tables = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.fit(*tables, ~toxicity.held_out("doc_id", 4, 2))


def test_the_clause_decides(spark, model):
    """The same head word in clauses of different structure, by the fitted model."""
    toxic = ["You are an idiot and they know it.", "What an idiot that man is.", "Someone will kill you tonight.", "We talked. You idiot are wrong."]
    clean = ["idiot", "Idiot.\nIdiot.", "She is not an idiot at all.", 'He wrote "you are an idiot" once.', "He said they were idiot people.", "They never kill you here.", "It took an hour to kill the process."]
    docs = spark.createDataFrame(list(enumerate(toxic + clean)), "doc_id int, text string")
    found = {r["doc_id"]: r["score"] >= toxicity.THRESHOLD for r in toxicity.score(docs, model).collect()}
    assert [found[n] for n in range(len(found))] == [True] * len(toxic) + [False] * len(clean)


def test_long_words_and_many_clauses(spark, model):
    word = "q" * 60
    rows = [(n, f"some lamp{'abcdefghij'[n % 10]} {word} stands by it {word} again.", 1) for n in range(40)] + [(100 + n, f"a calm lamp stands by {n}.", 0) for n in range(40)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, toxic int")
    own = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), F.lit(True))
    assert word in own.insults
    scores = [r["score"] for r in toxicity.score(spark.createDataFrame([(n, "What an idiot that is.\n" * k) for n, k in enumerate((1, 9, 900))], "doc_id int, text string"), model).orderBy("doc_id").collect()]
    assert scores[0] < scores[1] <= scores[2]
