"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols (insult, threat, target, negation, reported speech, quote, clause
end, other) and five transducers are composed: negation rewrites the insults and
threats in its reach, reported speech those behind a verb of saying or in quotation
marks it opened, and insult, threat and target read what comes out. A clause matches
where the insult or the threat machine ends in an accepting state: it holds a head in
a frame of other words, so that a word by itself matches nothing. Its pattern is what
the machines say together: plain or aimed at a target, negated or reported; of several
heads the plainest counts. Every pattern has a weight, and a document's score is a
logistic function of the weighted numbers of its matched clauses.

The insult lexicon is a short list of seeds plus words learned from labelled texts:
words met in at least `min_docs` toxic texts and `min_contexts` different left
neighbours there (copies of one text don't make an insult of its words), and
`min_odds` times likelier in toxic than in clean texts; it is part of the model that
goes to the tasks and holds the LEXICON_WORDS strongest at most. Pattern weights are
fitted by ridge regression towards priors. Fitting uses a sample of about `fit_rows`
labelled rows, chosen by a hash of the id; fitting and scoring read every text whole,
however long it is: its tokens are in memory at once, its clauses one after the other.

Defined cases: null text counts as empty and scores the base rate; rows without a
label or text don't train; repeated rows score alike; no labels leave seeds and
priors; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .batches import map_batches, texts_of

# Seed words of each symbol.
INSULTS = """idiot moron stupid loser scum trash clown pathetic worthless disgusting imbecile bastard
idiota estúpido imbécil basura asqueroso idiot trottel dumm abschaum versager widerlich
imbécile stupide ordure minable dégoûtant connard""".split()
THREATS = """kill hurt destroy beat burn shoot murder matar golpear destruir töten umbringen schlagen
tuer frapper détruire""".split()
TARGETS = """you your yours yourself u he she they him her them people tú usted vosotros ustedes te du dich dir
ihr euch tu toi vous""".split()
NEGATIONS = "not no never n't isn't aren't don't nicht kein keine nie niemals ne jamais nunca jamás tampoco".split()
REPORTS = """said says say saying called calls wrote writes claimed quoted told reportedly alleged dijo dice
sagte sagt schrieb dit disait écrit""".split()

FIT_ROWS = 20_000
LEXICON_WORDS = 5_000
PATTERNS = ["insult", "aimed_insult", "negated_insult", "reported_insult", "threat", "aimed_threat", "negated_threat", "reported_threat"]
#: Weights of the patterns: log-odds that each first match of a pattern adds before labels speak; a threat without a target is often harmless.
PRIOR = np.array([6.0, 8.0, 1.5, 1.5, 0.0, 4.0, 0.0, 0.5])
BIAS = -4.0

_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?;:]+|[\n\"“”«»]")


class Transducer:
    """A finite-state transducer over symbols: moves tell (next state, symbol given out) by (state, symbol); other symbols pass as they are, the state stays."""

    def __init__(self, start, moves: dict[tuple, tuple], accepts: dict | None = None):
        self.start, self.moves, self.accepts = start, moves, accepts or {}

    def step(self, state, symbol: str) -> tuple:
        return self.moves.get((state, symbol), (state, symbol))


# Symbols: I insult, T threat, Y target, N negation, R reported speech, Q quote, E clause end, o other;
# given out by negation: i, t; by reported speech: r, s.
#: The state is the number of words left in a negation's reach.
NEGATION = Transducer(
    0,
    {(n, x): (max(0, n - 1), {"I": "i", "T": "t"}.get(x, x) if n else x) for n in range(4) for x in "ITYRo"}
    | {(n, "N"): (3, "o") for n in range(4)} | {(n, "E"): (0, "E") for n in range(4)},
)
#: 1 behind a verb of saying until the clause ends, 2 inside the quotation marks it opened.
REPORT = Transducer(
    0,
    {(n, x): (n, "r" if x in "Ii" else "s") for n in (1, 2) for x in "IiTt"}
    | {(n, "R"): (max(n, 1), "o") for n in range(3)} | {(1, "E"): (0, "E"), (1, "Q"): (2, "Q"), (2, "Q"): (0, "Q")},
)
#: 1 when the clause holds a target.
TARGET = Transducer(0, {(0, "Y"): (1, "Y")}, {1: "aimed"})


def _heads(plain: str, negated: str, reported: str) -> Transducer:
    """States: the plainest head so far (0 none, 1 reported, 2 negated, 3 plain) and whether another word frames it."""
    rank = {reported: 1, negated: 2, plain: 3}
    states = [(n, framed) for n in range(4) for framed in (0, 1)]
    moves = {((n, f), x): ((max(n, k), f), x) for n, f in states for x, k in rank.items()}
    moves |= {((n, f), x): ((n, 1), x) for n, f in states for x in "oY"}
    return Transducer((0, 0), moves, {(1, 1): "reported", (2, 1): "negated", (3, 1): "plain"})


INSULT = _heads("I", "i", "r")
THREAT = _heads("T", "t", "s")


class Grammar:
    """The composed machine: symbols of a text in, numbers of matched clauses by pattern out."""

    PARTS = (NEGATION, REPORT, TARGET, INSULT, THREAT)

    def __init__(self, insults: set[str]):
        self.symbols = {w: "R" for w in REPORTS} | {w: "Y" for w in TARGETS} | {w: "N" for w in NEGATIONS}
        self.symbols |= {w: "T" for w in THREATS} | {w: "I" for w in insults}
        # several marks in a row stress a word; they end no clause
        self.symbols |= {c: "E" for c in ".!?;:\n"} | {c: "Q" for c in "\"“”«»"}
        self.heads = {w for w, s in self.symbols.items() if s in "IT"}
        self.composed: dict[tuple, tuple] = {}

    def _step(self, state: tuple, symbol: str) -> tuple:
        """The composed machine's next state: a symbol passes negation, then reported speech, and the other three read what is left of it."""
        if (found := self.composed.get((state, symbol))) is None:
            negation, symbol_ = NEGATION.step(state[0], symbol)
            report, symbol_ = REPORT.step(state[1], symbol_)
            found = self.composed[state, symbol] = (negation, report, *(m.step(s, symbol_)[0] for m, s in zip(self.PARTS[2:], state[2:])))
        return found

    def accepted(self, state: tuple) -> list[str]:
        """Patterns of a clause that ends in this state."""
        aimed = TARGET.accepts.get(state[2])
        out = []
        for kind, machine, s in (("insult", INSULT, state[3]), ("threat", THREAT, state[4])):
            if how := machine.accepts.get(s):
                how = aimed or how if how == "plain" else how
                out.append(kind if how == "plain" else f"{how}_{kind}")
        return out

    def counts(self, text: str) -> np.ndarray:
        """Matched clauses of each of PATTERNS."""
        out = np.zeros(len(PATTERNS))
        tokens = _TOKEN.findall(text.lower())
        if self.heads.isdisjoint(tokens):
            return out
        symbols, start = self.symbols, tuple(m.start for m in self.PARTS)
        state = start
        for token in tokens:
            symbol = symbols.get(token, "o")
            if symbol == "o" and token[0] in ".!?;:":
                continue
            if symbol != "E":
                state = self._step(state, symbol)
                continue
            for pattern in self.accepted(state):
                out[PATTERNS.index(pattern)] += 1
            # what was reported in quotation marks goes on, the rest starts anew
            state = (*self._step(state, "E")[:2], *start[2:])
        for pattern in self.accepted(state):
            out[PATTERNS.index(pattern)] += 1
        return out


def held_out(doc_id: str | F.Column, modulus: int, remainder: int) -> F.Column:
    """Whether crc32 of the id as text leaves the remainder; false for a null id."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: F.Column, rows: int) -> DataFrame:
    """text, y of about `rows` training rows: all of them while they are fewer, else those whose hashed id falls in the share."""
    known = labels.where(F.col(label).isin(0, 1) & train).select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("y")).distinct()
    share = min(1.0, rows / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64(F.lit("sample"), "_id"), F.lit(1_000_000)) < round(1_000_000 * share))
    return docs.where(F.col("text").isNotNull()).select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("text")).join(known, "_id").select("text", "y")


def learn_lexicon(sample: DataFrame, min_docs: int = 4, min_contexts: int = 4, min_odds: float = 12.0, words: int = LEXICON_WORDS) -> set[str]:
    """Words of the sample's toxic texts that stand for an insult; at most `words` of them, strongest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, left, label = [], [], []
            for text, y in zip(texts_of(batch.column(0)), batch.column(1).to_pylist()):
                tokens = _TOKEN.findall(text.lower())
                first = dict(zip(reversed(tokens), [*reversed(tokens[:-1]), ""]))
                keys = [w for w in first if len(w) > 2]
                word += keys
                left += [hash_text(first[w]) for w in keys] if y else [0] * len(keys)
                label += [y] * len(keys)
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(left, pa.int64()), pa.array(label, pa.int32())], names=["word", "ctx", "y"])

    totals = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad:
        return set()
    seen = map_batches(sample, run, "word string, ctx long, y int").groupBy("word").agg(
        F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c"), F.approx_count_distinct(F.when(F.col("y") == 1, F.col("ctx")), 0.1).alias("contexts")
    )
    odds = ((F.col("t") + 0.5) / (bad + 1)) / ((F.col("c") + 0.5) / (good + 1))
    enough = min(min_docs, max(2, bad // 10))
    found = seen.where((F.col("t") >= enough) & (F.col("contexts") >= min(min_contexts, enough)) & (F.col("c") * 20 <= F.col("t")) & (odds >= min_odds))
    return {r["word"] for r in found.orderBy(F.desc(odds), "word").limit(words).collect()}


def hash_text(s: str) -> int:
    from zlib import crc32

    return crc32(s.encode())


def logistic_fit(x: np.ndarray, y: np.ndarray, prior: np.ndarray, ridge: float) -> np.ndarray:
    """Newton steps for logistic regression with a quadratic pull towards prior; the last weight is the bias's."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = prior.astype(float).copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * (w - prior)
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def features(counts: np.ndarray) -> np.ndarray:
    return np.log2(1 + counts)


def score_counts(counts: np.ndarray, weights: np.ndarray) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(features(counts) @ weights[:-1] + weights[-1])))))


class Model:
    """Lexicon and weights; bounded in size, so it travels with the tasks."""

    def __init__(self, insults: set[str], weights: np.ndarray):
        self.insults, self.weights = insults, weights


def fit(docs: DataFrame, labels: DataFrame, train: F.Column, fit_rows: int = FIT_ROWS, ridge: float = 1.0) -> Model:
    """Learns from the rows of labels (doc_id, toxic) where train holds."""
    sample = labelled_sample(docs, labels, "toxic", train, fit_rows).persist()
    try:
        insults = {w.lower() for w in INSULTS} | (learn_lexicon(sample) - set(TARGETS) - set(NEGATIONS) - set(REPORTS) - set(THREATS))
        grammar_words = frozenset(insults)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grammar = Grammar(set(grammar_words))
            for batch in batches:
                rows = [features(grammar.counts(t)).tolist() for t in texts_of(batch.column(0))]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

        seen = map_batches(sample, run, "x array<double>, y int").groupBy("x", "y").count().collect()
    finally:
        sample.unpersist()
    prior = np.append(PRIOR, BIAS)
    if not seen:
        return Model(insults, prior)
    n = np.array([r["count"] for r in seen])
    x, y = np.array([r["x"] for r in seen]).repeat(n, axis=0), np.array([r["y"] for r in seen], float).repeat(n)
    return Model(insults, logistic_fit(x, y, prior, ridge))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, patterns (matches of each pattern that occurs) for every row."""
    insults, weights = frozenset(model.insults), model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(set(insults))
        for batch in batches:
            counts = [grammar.counts(t) for t in texts_of(batch.column(1))]
            told = [{p: int(c) for p, c in zip(PATTERNS, row) if c} for row in counts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([score_counts(c, weights) for c in counts], pa.float64()), pa.array([list(t.items()) for t in told], pa.map_(pa.string(), pa.int64()))],
                names=["doc_id", "score", "patterns"],
            )

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, score double, patterns map<string,long>")


THRESHOLD = 0.3


def clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold, columns as they were; the text is not shuffled."""
    insults, weights, names = frozenset(model.insults), model.weights, docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(set(insults))
        for batch in batches:
            yield batch.filter(pa.array([score_counts(grammar.counts(t), weights) < threshold for t in texts_of(batch.column(at))], pa.bool_()))

    return map_batches(docs, run, docs.schema)
