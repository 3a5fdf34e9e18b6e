"""Token counts by greedy longest match, found in one pass over each distinct word.

The pieces of a vocabulary form a trie. Every node has a failure link: where to go on
when the next character has no edge, after the pieces that are then certain have been
popped. How many pieces a link pops, and how many a word's end pops, is computed once for
each node, so that counting follows edges and links and never builds a piece. The work
per word is linear in its length (each link shortens what is still open).

A word (a run of non-white characters) is matched as the vocabulary's word marker followed
by the word, with pieces allowed anywhere. A character that no piece holds ends what is
open and counts as its UTF-8 bytes, as byte fallback would give.

Defined results: a null or blank text has no words and no tokens; rows with equal or null
ids stay separate rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import columns, sliced

#: Distinct words after which a task starts its table of counts anew.
TABLE_ENTRIES = 200_000


class LongestMatch:
    """Vocabulary trie with failure links and counts of popped pieces."""

    def __init__(self, pieces: Iterable[str], marker: str = "▁"):
        self.edges: list[dict[str, int]] = [{}]
        whole = [False]
        for piece in pieces:
            at = 0
            for c in piece:
                if c not in self.edges[at]:
                    self.edges[at][c] = len(self.edges)
                    self.edges.append({})
                    whole.append(False)
                at = self.edges[at][c]
            whole[at] = at > 0
        # Every character of the vocabulary must be a piece, else a link could lead nowhere.
        for c in {c for e in self.edges for c in e}:
            if c not in self.edges[0]:
                self.edges[0][c] = len(self.edges)
                self.edges.append({})
                whole.append(True)
            whole[self.edges[0][c]] = True
        self.link, self.pops, self.closes = ([0] * len(self.edges) for _ in range(3))
        level = [0]
        while level:
            below = []
            for parent in level:
                for c, node in self.edges[parent].items():
                    if whole[node]:
                        link, pops = 0, 1
                    else:
                        link, pops = self.link[parent], self.pops[parent]
                        while c not in self.edges[link]:
                            pops += self.pops[link]
                            link = self.link[link]
                        link = self.edges[link][c]
                    self.link[node], self.pops[node] = link, pops
                    self.closes[node] = pops + self.closes[link]
                    below.append(node)
            level = below
        self.begin = self.edges[0].get(marker, 0)
        self.none = 0 if self.begin else len(marker.encode())

    def count(self, word: str) -> int:
        edges, link, pops = self.edges, self.link, self.pops
        at, n, known = self.begin, self.none, self.edges[0]
        for c in word:
            if c not in known:
                n += self.closes[at] + len(c.encode("utf-8", "surrogatepass"))
                at = 0
                continue
            while c not in edges[at]:
                n += pops[at]
                at = link[at]
            at = edges[at][c]
        return n + self.closes[at]


class _Counts(dict):
    def __init__(self, automaton: LongestMatch):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self[word] = self.automaton.count(word.decode())
        return n


def count_tokens(df: DataFrame, pieces: list[str], id_col: str = "doc_id", text_col: str = "text", marker: str = "▁") -> DataFrame:
    """``doc_id``, ``n_words`` and ``n_tokens`` of every row of ``df``."""
    rows = columns(df, doc_id=id_col, text=text_col)
    rows = rows.withColumn("text", rows["text"].cast("binary"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(LongestMatch(pieces, marker))
        look = counts.__getitem__
        for batch in sliced(batches):
            n_words, n_tokens = (np.zeros(batch.num_rows, np.int64) for _ in range(2))
            for i, text in enumerate(batch.column(1).to_pylist()):
                words = (text or b"").split()
                n_words[i], n_tokens[i] = len(words), sum(map(look, words))
                if len(counts) > TABLE_ENTRIES:
                    counts.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(n_tokens)], names=["doc_id", "n_words", "n_tokens"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long")
