"""Cost-balanced packing of tokenised documents into fixed-length sequences.

Each task tokenises its own rows and packs them in windows of about
`window_tokens` ids, so nothing is shuffled and memory is bounded by one window
plus the longest document. Inside a window the number of sequences is exactly
what the tokens fill: full ones of `capacity` ids and, for what is left, one of
each power of two in its binary form; documents go in descending order of
estimated cost (linear plus quadratic attention) to the cheapest sequence with
room for them, and are cut only where no sequence holds them whole.

A worker keeps the ids of words it met lately, twice CACHE_BYTES at most; a window holds the ids of
about `window_tokens` and of one text more. Words are looked up by shortcuts that one
kind of tokenizer file allows; a worker tries them on words of all shapes first and
asks the library for whole texts where they don't hold.

Defined cases: a null or empty text is one piece holding just the end id; rows
that repeat are packed once each; an empty table gives no pieces; other columns
of the input are ignored, whatever their names.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .batches import map_batches

CAPACITY = 4096
END_ID = 2
WINDOW_TOKENS = 1 << 20
#: Bytes of the words a worker met lately, about; when they are more, they become the older ones, which keep as much and of which those met again are lately met.
CACHE_BYTES = 48 << 20
#: What a cached word takes beside its characters and ids: two object heads and a place in the table.
WORD_BYTES = 200
#: Texts tokenised at once: enough that most of their words recur.
BATCH_ROWS = 1024
#: Ids of the pieces given out at once.
OUT_TOKENS = 1 << 19
#: Separators that str.split() knows and the tokenizer doesn't.
NOT_WHITE = "\x1c\x1d\x1e\x1f"
#: Up to here lower case is one to one and letters are composed.
COMPOSED = "\u0130"
#: Marks that form a token run of their own behind a letter.
MARKS = '.,!?;:#$%&*"'

#: The byte alphabet's rule: printable bytes stand for themselves, the others for the characters from 256 on.
BYTE_ALPHABET = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b < 127 or 161 <= b < 173 or 174 <= b))}


class WordEncoder:
    """Ids of whole texts by a whitespace-dropping tokenizer, looked up word by word.

    The tokenizer never lets a token cross white space, so the ids of a text are
    those of its words. A run of marks behind a letter is cut off as a token run of its
    own and lower-casing is part of the normaliser, so "Word!!" is put together from
    "word" and "!!"; each distinct one of these is encoded by the library once. A word
    of letters only is one run, which goes to the merges without the passes before.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        self.tokenizer, self.merges = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.merges.normalizer, self.merges.pre_tokenizer = None, pre_tokenizers.Sequence([])
        self.words, self.older, self.bytes = {"": b""}, {}, 0
        self.as_assumed = self._agrees()

    def _library(self, texts: list[str], only_merge: bool = False) -> list[bytes]:
        tokenizer = self.merges if only_merge else self.tokenizer
        return [array("I", x.ids).tobytes() for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    #: Words of all shapes that the shortcuts below tell apart.
    PROBES = ["Word", "word!!", "WORD?!", "don't", "Él.", "Ünïcode,", "x1:", "3.14", "a-b;", '"quoted"', "ΣΊΣΥΦΟΣ", "日本語", "e\u0301t", "naïve…", "#tag#", "<|x|>", "a__b", "...", "№5", "ǅ!"]

    def _agrees(self) -> bool:
        """Whether this tokenizer file works as the shortcuts assume; another one is asked for each whole text instead."""
        self.as_assumed = True
        probes = [*self.PROBES, " ".join(self.PROBES) + "\t" + "\n ".join(self.PROBES)]
        return self.encode(pa.array(probes)) == self._library(probes)

    @staticmethod
    def _spelt(word: str) -> str:
        """A word in the byte alphabet of the merges."""
        return word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_ALPHABET)

    @staticmethod
    def _parted(words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """What is looked up of each word, and the marks cut off behind it."""
        simple = pc.invert(pc.match_substring_regex(words, rf"[^\x{{0}}-\x{{{ord(COMPOSED) - 1:x}}}]"))
        bare = pc.utf8_rtrim(words, MARKS)
        stems = pc.if_else(pc.and_(simple, pc.match_substring_regex(bare, r"\pL$")), bare, words)
        off = pc.subtract(pc.binary_length(words), pc.binary_length(stems))  # a mark is one byte
        marks = pc.if_else(pc.equal(off, 1), pc.utf8_slice_codeunits(words, -1), "")
        several = pc.greater(off, 1)
        runs = [w[-n:] for w, n in zip(words.filter(several).to_pylist(), off.filter(several).to_pylist())]
        marks = pc.replace_with_mask(marks, several, pa.array(runs, words.type))
        # special tokens are matched as written
        return pc.if_else(pc.and_(simple, pc.invert(pc.match_substring(stems, "<|"))), pc.utf8_lower(stems), stems), marks

    def _put(self, word: str, ids: bytes) -> None:
        self.words[word] = ids
        self.bytes += WORD_BYTES + len(word) + len(ids)

    def learn(self, new: list[str]) -> None:
        """Ids of parts of words (as of _parted) that aren't at hand; those of older ones are taken over."""
        letters, others = [], []
        for word in new:
            if (ids := self.older.get(word)) is not None:
                self._put(word, ids)
            else:
                (letters if word.isalpha() and max(word) < COMPOSED else others).append(word)
        for word, ids in zip([*others, *letters], self._library(others) + self._library([self._spelt(w) for w in letters], only_merge=True)):
            self._put(word, ids)

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text.

        Arrow splits the texts, parts the distinct words and puts their ids in place; only distinct parts become Python strings.
        """
        odd = pc.match_substring_regex(texts, f"[{NOT_WHITE}]")
        if pc.any(odd).as_py():
            return [self._library([t.as_py()])[0] if o.as_py() else self.encode(pa.array([t.as_py()]))[0] for t, o in zip(texts, odd)]
        if not self.as_assumed:
            return self._library(texts.to_pylist())
        if self.bytes > CACHE_BYTES:
            self.words, self.older, self.bytes = {"": b""}, self.words, 0
        split = pc.utf8_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        parts = pa.concat_arrays(self._parted(coded.dictionary)).dictionary_encode()
        distinct = parts.dictionary.to_pylist()
        found = list(map(self.words.get, distinct))
        if new := [w for w, b in zip(distinct, found) if b is None]:
            self.learn(new)
            found = list(map(self.words.__getitem__, distinct))
        ends = np.cumsum([0, *map(len, found)], dtype=np.int64) // 4
        known = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<u4")))
        # a word's ids are those of its two parts, one behind the other
        both = known.take(pa.array(parts.indices.to_numpy().reshape(2, -1).T.ravel()))
        words = pa.LargeListArray.from_arrays(pa.array(both.offsets.to_numpy()[::2]), both.values)
        put = words.take(coded.indices)
        at = put.offsets.to_numpy()[split.offsets.to_numpy()].tolist()
        ids = put.values.to_numpy()
        return [ids[i:j].tobytes() for i, j in zip(at, at[1:])]


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    """One per Python worker, so that its words serve all tasks the worker runs."""
    return WordEncoder(path)


def estimated_cost(length: np.ndarray | int, capacity: int):
    """Linear plus quadratic attention cost of a piece, in units where both are equal at full length."""
    return length + length * (length / capacity)


def sequence_sizes(tokens: int, capacity: int) -> list[int]:
    """Lengths that the tokens fill without padding: full sequences, then the powers of two of the rest."""
    full, rest = divmod(tokens, capacity)
    return [capacity] * full + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def assign(lengths: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece of one window."""
    sizes = np.array(sequence_sizes(sum(lengths), capacity), dtype=np.int64)
    room, cost = sizes.copy(), np.zeros(len(sizes))
    pieces = []

    def put(doc: int, start: int, length: int, where: int) -> None:
        pieces.append((doc, start, length, where, int(sizes[where] - room[where])))
        room[where] -= length
        cost[where] += estimated_cost(length, capacity)

    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    for doc in order:
        start, left = 0, lengths[doc]
        while left:
            fits = room >= min(left, capacity)
            if not fits.any():
                fits = room > 0
            where = int(np.argmin(np.where(fits, cost, np.inf)))
            length = min(left, int(room[where]))
            put(doc, start, length, where)
            start, left = start + length, left - length
    return pieces


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, window_tokens: int = WINDOW_TOKENS) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    capacity must be a power of two. The tokenizer file must lie at tokenizer_path on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = word_encoder(tokenizer_path), np.array([end_id], "<u4").tobytes()
        base, held, tokens = TaskContext.get().partitionId() << 36, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal base
            lengths = [len(b) // 4 for _, b in held]
            pieces = assign(lengths, capacity)
            ends = np.cumsum([p[2] for p in pieces]) // OUT_TOKENS
            for part in np.split(np.arange(len(pieces)), np.flatnonzero(np.diff(ends)) + 1):
                part = [pieces[k] for k in part]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([held[d][0] for d, *_ in part], pa.int64()),
                        pa.array([p[1] for p in part], pa.int64()),
                        pa.array([p[2] for p in part], pa.int64()),
                        pa.array([memoryview(held[d][1])[4 * s : 4 * (s + n)] for d, s, n, _, _ in part], pa.binary()),
                        pa.array([lengths[p[0]] for p in part], pa.int64()),
                        pa.array([base + p[3] for p in part], pa.int64()),
                        pa.array([p[4] for p in part], pa.int64()),
                    ],
                    names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )
            base += max((p[3] for p in pieces), default=-1) + 1
            # the pool keeps what batches took, a quarter of a worker's memory, also while the worker waits for its next task
            pa.default_memory_pool().release_unused()

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(pc.fill_null(batch.column(1), ""))):
                held.append((doc_id, ids + end))
                tokens += len(ids) // 4 + 1
                if tokens >= window_tokens:
                    yield from flush()
                    held, tokens = [], 0
        yield from flush()

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, PIECES, rows=BATCH_ROWS)
