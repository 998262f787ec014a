"""Token counts by a linear longest-match automaton, without building the pieces.

The vocabulary is a trie with two starts: one for pieces that begin a word, one
for those that continue it. Each node has a failure link to the node where the
match goes on once the longest pieces before it are taken, and the number of
pieces taken then. A word is read letter by letter: where the trie has no way
on, the count of the node is added and its link followed. So a word costs time
in its length, not in its length times the longest piece.

A word that greedy matching cannot finish counts as one unknown token; so does one of more than
``max_chars`` letters, as in the common word-piece rule, if that limit is set.

Defined results: words are what ``bytes.split`` gives on the UTF-8 text; null and
empty texts have no words and no tokens; repeated rows each give a row; an empty
table gives none; columns other than id and text are not read.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import as_bytes

MEMO_WORDS = 1 << 18
_NONE = -1


class Automaton:
    """Counts greedy longest-match pieces of single words."""

    def __init__(self, starts: Iterable[str], continuations: Iterable[str], max_chars: int | None = None) -> None:
        self.max_chars = max_chars
        self._next: list[dict[str, int]] = [{}, {}]  # 0: at the start of a word; 1: after a piece
        ends = set()
        for root, pieces in ((0, starts), (1, continuations)):
            for piece in pieces:
                if piece:
                    ends.add(self._insert(root, piece))
        self._link(ends)

    def _insert(self, node: int, piece: str) -> int:
        for letter in piece:
            step = self._next[node]
            if letter not in step:
                step[letter] = len(self._next)
                self._next.append({})
            node = step[letter]
        return node

    def _link(self, ends: set[int]) -> None:
        """Failure links and counts of popped pieces, nearest nodes first."""
        self._fail = [_NONE] * len(self._next)
        self._popped = [0] * len(self._next)
        queue = deque([0, 1])
        while queue:
            parent = queue.popleft()
            for letter, node in self._next[parent].items():
                queue.append(node)
                if node in ends:  # the whole string is a piece: take it, go on after it
                    self._fail[node], self._popped[node] = 1, 1
                    continue
                popped, link = self._popped[parent], self._fail[parent]
                while link != _NONE and letter not in self._next[link]:
                    popped, link = popped + self._popped[link], self._fail[link]
                if link != _NONE:
                    self._fail[node], self._popped[node] = self._next[link][letter], popped

    def count(self, word: str) -> int:
        """Pieces of ``word``; 0 if it has no match, which is one unknown token."""
        if self.max_chars is not None and len(word) > self.max_chars:
            return 0
        follow, fail, popped = self._next, self._fail, self._popped
        node = pieces = 0
        for letter in word:
            while letter not in follow[node]:
                if fail[node] == _NONE:
                    return 0
                pieces += popped[node]
                node = fail[node]
            node = follow[node][letter]
        while node != 1:  # the end of the word: take what is still open
            if fail[node] == _NONE:
                return 0
            pieces += popped[node]
            node = fail[node]
        return pieces


def piece_vocabulary(path: str) -> tuple[list[str], list[str]]:
    """Pieces that start and that continue a word, of a sentencepiece model with word marks."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    starts, continuations = [], []
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i)
        if piece.startswith("▁"):
            starts.append(piece[1:])
        else:
            continuations.append(piece)
    return starts, continuations


@lru_cache(maxsize=2)
def automaton(path: str, max_chars: int | None) -> Automaton:
    return Automaton(*piece_vocabulary(path), max_chars)


def _count(path: str, max_chars: int | None):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(path, max_chars)
        memo: dict[bytes, int] = {}
        for batch in batches:
            rows = []
            for text in as_bytes(batch.column(1)):
                words = text.split()
                for word in set(words).difference(memo):
                    memo[word] = machine.count(word.decode())
                counts = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
                unknown = int((counts == 0).sum())
                rows.append((len(words), int(counts.sum()) + unknown, unknown))
                if len(memo) > MEMO_WORDS:
                    memo = {}
            sums = np.asarray(rows, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(sums[:, k]) for k in range(3))],
                ["doc_id", "n_words", "n_tokens", "n_unknown"],
            )

    return count


def token_counts(docs: DataFrame, vocabulary: str, max_chars: int | None = None) -> DataFrame:
    """Per document: id, words, word-piece tokens (unknown words count as one), unknown words."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return narrow.mapInArrow(_count(vocabulary, max_chars), "doc_id long, n_words long, n_tokens long, n_unknown long")
