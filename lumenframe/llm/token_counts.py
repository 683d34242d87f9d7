"""Token counts by byte-pair merging with a heap and a linked list, without identifiers.

The library's own normaliser and pre-tokenizer cut a text into pieces; a piece starts
as one symbol a byte. All adjacent pairs that may merge lie in a heap by rank, then
place; the lowest is popped again and again, its right symbol leaves the linked list,
and the pairs with its new neighbours come in. A piece has as many tokens as symbols
at first less merges, in time that grows with its length times the logarithm, so that
a text without white space is no special case. Tokens given to the tokenizer beside
its merges, as special ones, are found in the text first and count one each.

Where pieces never cross white space and lower case is all that the normaliser does to
common letters, as a worker finds out by trying words of all shapes, texts are cut at
white space by Arrow, common words are cut into pieces by a pattern, and only the
distinct words of a slice are looked at. A worker keeps the counts of words it met
lately, twice CACHE_BYTES at most. Nothing is shuffled; the file must lie at the same
path on every executor.

Defined cases: null and empty texts have no tokens; repeated rows count alike; an empty
table gives no rows; other columns are ignored, whatever their names. A file of another
kind than byte-level pair merging is refused with a ValueError before anything runs.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from .batches import map_batches

#: Bytes of the words a worker met lately, about; when they are more, they become the older ones, of which those met again are kept.
CACHE_BYTES = 48 << 20
#: What a cached word takes beside its characters: object head, count and place in the table.
WORD_BYTES = 160
#: Texts looked at together: enough that most of their words recur.
BATCH_ROWS = 1024
#: Separators that Arrow knows as white space and the tokenizer doesn't.
NOT_WHITE = "\x1c\x1d\x1e\x1f"
#: Code points below have one composed form and one lower-case letter each, and classes that don't change.
COMMON = "İ"
#: How common words are cut into pieces: the fixed pattern of the file's pre-tokenizer.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Words of all shapes that the shortcuts tell apart.
PROBES = ["Word", "word!!", "WORD?!", "don't", "he'll'd", "Él.", "Ünïcode,", "x1:", "3.14", "½²a", "a-b;", '"quoted"', "ΣΊΣΥΦΟΣ", "日本語", "ét", "naïve…", "#tag#", "<|x|>", "a__b", "...", "№5", "ǅ!", " ", "\u0085x", "ªº"]


def check_model(model: dict, path: str) -> None:
    if model.get("type") != "BPE" or any(model.get(k) for k in ("continuing_subword_prefix", "byte_fallback", "ignore_merges", "dropout")):
        raise ValueError(f"{path} holds no plain pair merges")


class MergeCounter:
    """Numbers of tokens of texts under one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        model = json.loads(self.tokenizer.to_str())["model"]
        suffix, vocabulary = model.get("end_of_word_suffix") or "", model.get("vocab")
        check_model(model, path)
        self.inner = {c: i for c, i in vocabulary.items() if len(c) == 1}
        self.final = {c: vocabulary.get(c + suffix) for c in self.inner}
        if len(self.inner) < 256 or None in self.final.values():
            raise ValueError(f"{path} has no symbol for each byte")
        #: (left, right) as one number gives rank and merged symbol as one number.
        self.table = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if not isinstance(pair, str) else pair.split(" ")
            self.table.setdefault(vocabulary[left] << 32 | vocabulary[right], rank << 32 | vocabulary[left + right])
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.words, self.older, self.bytes = {}, {}, 0
        self.by_words = self._agrees()

    def merged(self, symbols: list[int]) -> int:
        """Merges of a piece: the lowest-ranked adjacent pair first, of equal ones the leftmost."""
        n, table = len(symbols), self.table
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(found >> 32) << 32 | i for i in range(n - 1) if (found := table.get(symbols[i] << 32 | symbols[i + 1])) is not None]
        heapify(heap)
        merges = 0
        while heap:
            top = heappop(heap)
            i = top & 0xFFFFFFFF
            j = right[i]
            # a symbol that left has -1; a pair that changed since has another rank, or none
            if symbols[i] < 0 or j >= n or (found := table.get(symbols[i] << 32 | symbols[j])) is None or found >> 32 != top >> 32:
                continue
            merges += 1
            symbols[i], symbols[j] = found & 0xFFFFFFFF, -1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (found := table.get(symbols[i] << 32 | symbols[k])) is not None:
                    heappush(heap, (found >> 32) << 32 | i)
            if (h := left[i]) >= 0 and (found := table.get(symbols[h] << 32 | symbols[i])) is not None:
                heappush(heap, (found >> 32) << 32 | h)
        return merges

    def of_piece(self, piece: str) -> int:
        """Tokens of a piece in the byte alphabet."""
        if not piece:
            return 0
        symbols = list(map(self.inner.__getitem__, piece))
        symbols[-1] = self.final[piece[-1]]
        return len(symbols) - self.merged(symbols)

    def of_text(self, text: str) -> int:
        """Tokens of a text, cut by the library."""
        count = 0
        if self.added is not None:
            parts = self.added.split(text)
            count = len(parts) - 1
        else:
            parts = [text]
        normal, cutter = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        for part in filter(None, parts):
            part = normal.normalize_str(part) if normal is not None else part
            for piece, _ in cutter.pre_tokenize_str(part):
                count += self._cached(" " + piece, lambda key: self.of_piece(key[1:]))  # no word holds a space
        return count

    def of_word(self, word: str) -> int:
        """Tokens of a word without white space; common ones are cut by the pattern."""
        if max(word) >= COMMON or "<|" in word:
            return self.of_text(word)
        return sum(self.of_piece(piece if piece.isascii() and piece.isprintable() else spelt(piece)) for piece in PIECES.findall(word.lower()))

    def _cached(self, key: str, count) -> int:
        found = self.words.get(key)
        if found is None:
            found = self.older.get(key)
            if found is None:
                found = count(key)
            self.words[key] = found
            self.bytes += WORD_BYTES + len(key)
            if self.bytes > CACHE_BYTES:
                self.words, self.older, self.bytes = {}, self.words, 0
        return found

    def _agrees(self) -> bool:
        """Whether words by themselves, cut as of_word does, have the library's number of tokens, and a line of them the sum."""
        sizes = lambda texts: [len(x.ids) for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        mine = [sum(map(self.of_word, w.split())) for w in PROBES]
        return sizes(PROBES) == mine and sizes([" ".join(PROBES) + "\t" + "\n ".join(PROBES)]) == [2 * sum(mine)]

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; only distinct words become Python strings."""
        if not self.by_words:
            return np.array([self.of_text(t) for t in texts.to_pylist()], np.int64)
        odd = np.asarray(pc.match_substring_regex(texts, f"[{NOT_WHITE}]").to_numpy(zero_copy_only=False), bool)
        split = pc.utf8_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        each = np.fromiter((self._cached(w, self.of_word) if w else 0 for w in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        sums = np.concatenate([[0], np.cumsum(each[coded.indices.to_numpy()])])
        ends = split.offsets.to_numpy() - split.offsets[0].as_py()
        out = sums[ends[1:]] - sums[ends[:-1]]
        for i in np.flatnonzero(odd):
            out[i] = self.of_text(texts[i].as_py())
        return out


#: The byte alphabet's rule: printable bytes stand for themselves, the others for the characters from 256 on.
BYTE_ALPHABET = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b < 127 or 161 <= b < 173 or 174 <= b))}


def spelt(piece: str) -> str:
    return piece.encode().decode("latin-1").translate(BYTE_ALPHABET)


@lru_cache(maxsize=1)
def merge_counter(path: str) -> MergeCounter:
    """One per Python worker, so that its words serve all tasks the worker runs."""
    return MergeCounter(path)


def count_tokens(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = merge_counter(tokenizer_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.binary_length(batch.column(1)).cast(pa.int64()), pa.array(counter.counts(batch.column(1)), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    texts = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), texts.alias("text")), run, "doc_id long, n_bytes long, n_tokens long", rows=BATCH_ROWS)
