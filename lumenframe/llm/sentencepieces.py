"""SentencePiece encoding and decoding for merge-type vocabularies.

Encoding keeps a score-ordered agenda of adjacent symbol pairs: the best-scored
pair whose union is in the vocabulary is merged (leftmost first on ties) and the
pairs it forms with its neighbours join the agenda, until none is left; symbols
outside the vocabulary become their bytes. No piece of such a vocabulary reaches
across a space-to-word border or holds a line break, so a text is encoded unit
by unit and each distinct unit only once per task. In every Arrow batch each
newly met unit is encoded by the sentencepiece library too (each unit with a part
not merged before), and one whole text is encoded and decoded by it; a difference
stops the job.

Defined cases: a null or empty text has no ids and decodes to an empty text;
repeated rows give repeated results; an empty table gives no rows; other input
columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .batches import map_batches, texts_of

SPACE = "▁"
#: Entries a task's unit cache holds before it starts afresh.
CACHE_UNITS = 600_000


class MergeVocabulary:
    """Pieces, scores and bytes read from a model file through the library's own accessors."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        sp, n = self.library, self.library.vocab_size()
        special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.scores = [sp.get_score(i) for i in range(n)]
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.spelt = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for b, i in enumerate(self.byte_ids):
            self.spelt[i] = bytes([b])
        self.inner = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        if any(a != SPACE and b == SPACE for a, b in self.inner):
            raise ValueError("a piece reaches across a word border; units can't be told apart")

    def merge(self, text: str) -> list[int]:
        """Ids of one unit by the agenda."""
        ids, score = self.ids, self.scores
        if text in ids and len(text) == 1:
            return [ids[text]]
        n = len(text)
        symbol: list[str] = list(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            if (k := ids.get(text[i : i + 2])) is not None:
                agenda.append((-score[k], i, 2))
        heapq.heapify(agenda)
        while agenda:
            _, i, size = heapq.heappop(agenda)
            left = symbol[i]
            if not left or (j := after[i]) >= n or len(left) + len(symbol[j]) != size:
                continue
            both = left + symbol[j]
            symbol[i], symbol[j] = both, ""
            nxt = after[i] = after[j]
            if nxt < n:
                before[nxt] = i
                if (k := ids.get(both + symbol[nxt])) is not None:
                    heapq.heappush(agenda, (-score[k], i, size + len(symbol[nxt])))
            if (prev := before[i]) >= 0 and (k := ids.get(symbol[prev] + both)) is not None:
                heapq.heappush(agenda, (-score[k], prev, size + len(symbol[prev])))
        out: list[int] = []
        i = 0
        while i < n:
            s = symbol[i]
            k = ids.get(s)
            out.extend([k] if k is not None else (self.byte_ids[b] for b in s.encode()))
            i = after[i]
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of the ids, bytes joined up, without the space put before the first word."""
        text = b"".join([self.spelt[i] for i in ids]).decode(errors="replace")
        return text[1:] if text.startswith(" ") else text


class UnitCoder:
    """Encodes whole texts by their units, with a cache of each unit's ids and decoded text."""

    def __init__(self, path: str, check: bool = True):
        self.vocabulary, self.check = MergeVocabulary(path), check
        self.ids: dict[str, bytes] = {}
        self.plain: dict[str, str] = {}
        self.segments: dict[str, bytes] = {}

    def _segments(self, unit: str) -> list[str]:
        """Cuts a unit between characters that stand together in no piece: nothing merges across such a border."""
        inner, out, start = self.vocabulary.inner, [], 0
        for k in range(1, len(unit)):
            if unit[k - 1 : k + 1] not in inner:
                out.append(unit[start:k])
                start = k
        out.append(unit[start:])
        return out

    def learn(self, new: set[str]) -> None:
        merge, segments = self.vocabulary.merge, self.segments
        fresh = []
        for unit in new:
            parts = self._segments(SPACE + unit)
            known = len(segments)
            for part in parts:
                if part not in segments:
                    segments[part] = np.array(merge(part), "<i4").tobytes()
            self.ids[unit] = b"".join([segments[part] for part in parts])
            if len(segments) > known:
                fresh.append(unit)
        decode, library = self.vocabulary.decode, self.vocabulary.library
        for unit in new:
            self.plain[unit] = decode(np.frombuffer(self.ids[unit], "<i4").tolist())
        if self.check:
            fresh = [u for u in fresh if u]
            found = [np.frombuffer(self.ids[u], "<i4").tolist() for u in fresh]
            if library.encode(fresh, num_threads=1) != found:
                raise ValueError("the agenda and the sentencepiece library differ")

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """(ids as little-endian 32-bit, decoded text) of each text."""
        if len(self.ids) > CACHE_UNITS:
            self.ids.clear()
            self.plain.clear()
        if len(self.segments) > CACHE_UNITS:
            self.segments.clear()
        split = [self._split(t) for t in texts]
        if new := set().union(*split).difference(self.ids):
            self.learn(new)
        ids, plain = self.ids.__getitem__, self.plain.__getitem__
        out = [b"".join(map(ids, units)) for units in split], [" ".join(map(plain, units)) for units in split]
        if self.check:
            library, longest = self.vocabulary.library, min(range(len(texts)), key=lambda i: (abs(len(texts[i]) - 2000), i), default=None)
            if longest is not None and (library.encode(texts[longest]) != np.frombuffer(out[0][longest], "<i4").tolist() or library.decode(np.frombuffer(out[0][longest], "<i4").tolist()) != out[1][longest]):
                raise ValueError("the agenda and the sentencepiece library differ")
        return out

    @staticmethod
    def _split(text: str) -> list[str]:
        """Units between single spaces; a run of spaces stays in front of its word, as pieces of several space marks exist."""
        if not text:
            return []
        if SPACE in text:
            text = text.replace(SPACE, " ")
        units = text.split(" ")
        if "" not in units:
            return units
        out, run = [], 0
        for u in units[:-1]:
            if u:
                out.append(SPACE * run + u)
                run = 0
            else:
                run += 1
        return [*out, SPACE * run + units[-1]]


@lru_cache(maxsize=1)
def unit_coder(path: str, check: bool) -> UnitCoder:
    """One per Python worker, so that its units serve all tasks the worker runs."""
    return UnitCoder(path, check)


def encode_decode(docs: DataFrame, model_path: str, check: bool = True) -> DataFrame:
    """doc_id, ids (array of int), decoded (text) for all rows. The model file must lie at model_path on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = unit_coder(model_path, check)
        for batch in batches:
            ids, decoded = coder.encode(texts_of(batch.column(1)))
            ends = np.cumsum([0, *(len(b) // 4 for b in ids)], dtype="i4")
            values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), values), pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, ids array<int>, decoded string")
