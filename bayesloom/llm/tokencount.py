"""Token counts by a linear longest-match automaton.

A vocabulary of word starts, inner pieces and word ends becomes one trie. Each trie node has a
failure link, the node where matching goes on once the longest pieces of what was matched are
taken off, and the number of pieces that are taken off. Walking a word through the automaton
adds those numbers up, so that each symbol is looked at about once and no piece is ever built;
the count is that of greedy longest-match segmentation.

Cases: null or empty text has no words and no tokens; a word that the vocabulary cannot cover
counts as one unknown token; repeated rows and null ids are answered like others; an empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_bytes

#: Words a worker remembers.
REMEMBERED = 500_000
END = -1  # the symbol behind a word


class Automaton:
    """Greedy longest-match counts over pieces given as tuples of symbols."""

    def __init__(self, pieces: list[tuple[int, ...]]):
        self.next: list[dict[int, int]] = [{}]
        final = [False]
        for piece in pieces:
            at = 0
            for c in piece:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    final.append(False)
                at = self.next[at][c]
            final[at] = True
        # fail: where to go on, or -1 if the matched symbols cannot be cut; popped: pieces taken off on the way
        self.fail, self.popped = [-1] * len(self.next), [0] * len(self.next)
        queue = [0]
        for at in queue:
            for c, child in self.next[at].items():
                queue.append(child)
                if final[child]:
                    self.fail[child], self.popped[child] = 0, 1
                    continue
                to, n = self.fail[at], self.popped[at]
                while to >= 0 and c not in self.next[to]:
                    to, n = self.fail[to], n + self.popped[to]
                if to >= 0:
                    self.fail[child], self.popped[child] = self.next[to][c], n

    def count(self, symbols: tuple[int, ...]) -> int:
        """Pieces of a word, or -1 if it cannot be cut into pieces."""
        at, n = 0, 0
        for c in symbols:
            while c not in self.next[at]:
                n += self.popped[at]
                at = self.fail[at]
                if at < 0:
                    return -1
            at = self.next[at][c]
        while at > 0:  # take off what is left
            n += self.popped[at]
            at = self.fail[at]
        return n if at == 0 else -1


def word_end_vocabulary(path: str, end: str = "</w>") -> Automaton:
    """The automaton of a BPE file's vocabulary, whose words are spelled in byte symbols and closed by ``end``."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    return Automaton([(*map(ord, t[: -len(end)]), END) if t.endswith(end) else tuple(map(ord, t)) for t in vocabulary if t != end])


def byte_symbols() -> list[int]:
    """The printable stand-ins of all bytes in byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    later = iter(range(256, 512))
    return [b if b in own else next(later) for b in range(256)]


_loaded: dict[str, Automaton] = {}


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, n_words, n_tokens, n_unknown`` for every row: words are split at white space, ASCII letters lower-cased."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _loaded:
            _loaded[vocabulary] = word_end_vocabulary(vocabulary)
        automaton, symbols, known = _loaded[vocabulary], byte_symbols(), {}
        for batch in batches:
            rows: list[tuple[int, int, int]] = []
            for text in as_bytes(batch.column(1)):
                words = text.lower().split()
                if len(known) > REMEMBERED:
                    known.clear()
                for w in words:
                    if w not in known:
                        known[w] = automaton.count((*map(symbols.__getitem__, w), END))
                counts = list(map(known.__getitem__, words))
                unknown = counts.count(-1)
                rows.append((len(words), sum(counts) + 2 * unknown, unknown))
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return docs.select("doc_id", "text").mapInArrow(task, "doc_id long, n_words long, n_tokens long, n_unknown long")
