"""Token counts of greedy longest-match word pieces, without building the pieces.

Two tries, of pieces that begin and that continue a word, get failure links: if
no child fits, the longest pieces of what was read are popped and matching goes
on at the suffix that is left. Each node knows how many pieces its failure
pops, so a word is counted in one pass over its characters.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerscan.llm.vocabulary import PIECE_MODEL, read_wordpieces
from layerscan.llm.words import kept_model

#: Words whose counts a Python worker remembers at once.
MEMORY = 300_000


class Automaton:
    """Counts of the pieces of words."""

    def __init__(self, first: list[str], rest: list[str]):
        # Node 0 begins a word, node 1 continues it.
        self.child: list[dict[str, int]] = [{}, {}]
        whole = [False, False]
        for root, pieces in ((0, first), (1, rest)):
            for piece in pieces:
                node = root
                for c in piece:
                    if c not in self.child[node]:
                        self.child[node][c] = len(self.child)
                        self.child.append({})
                        whole.append(False)
                    node = self.child[node][c]
                whole[node] = True
        self.fail: list[int | None] = [None] * len(self.child)
        self.popped = [0] * len(self.child)
        queue = deque([0, 1])
        while queue:
            above = queue.popleft()
            for c, node in self.child[above].items():
                queue.append(node)
                if whole[node]:
                    self.fail[node], self.popped[node] = 1, 1
                    continue
                at, pops = self.fail[above], self.popped[above]
                while at is not None and c not in self.child[at]:
                    pops += self.popped[at]
                    at = self.fail[at]
                if at is not None:
                    self.fail[node], self.popped[node] = self.child[at][c], pops

    def count(self, word: str) -> int:
        """Number of pieces; 0 if the pieces cannot spell the word."""
        node, pieces = 0, 0
        child, fail, popped = self.child, self.fail, self.popped
        for c in word:
            while c not in child[node]:
                if fail[node] is None:
                    return 0
                pieces += popped[node]
                node = fail[node]
            node = child[node][c]
        while node != 1:
            if fail[node] is None:
                return 0
            pieces += popped[node]
            node = fail[node]
        return pieces


class _Counts(dict):
    """Pieces of UTF-8 words; an unknown word counts as one piece and one miss."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> complex:
        if len(self) >= MEMORY:
            self.clear()
        pieces = self.automaton.count(word.decode())
        self[word] = found = complex(pieces or 1, not pieces)
        return found


def _counts(vocabulary) -> _Counts:
    """The worker's counts for a broadcast vocabulary."""
    return kept_model("counts", vocabulary, lambda: _Counts(Automaton(*vocabulary)))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str = PIECE_MODEL) -> DataFrame:
    """``id``, ``n_words``, ``n_tokens`` and ``n_unknown`` words of each row.

    Words are the runs between spaces, tabs and line breaks, as they stand. A
    word that the pieces cannot spell is one token and one unknown word. A text
    that is null or has no words has none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_wordpieces(vocabulary))

    def run(batches):
        count = _counts(shared.value).__getitem__
        for batch in batches:
            words, tokens, misses = [], [], []
            for text in batch.column("text"):
                parts = (text.as_py() or "").encode().split()
                total = sum(map(count, parts), 0j)
                words.append(len(parts))
                tokens.append(int(total.real))
                misses.append(int(total.imag))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(pa.array(x, pa.int64()) for x in (words, tokens, misses))],
                names=["id", "n_words", "n_tokens", "n_unknown"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "id long, n_words long, n_tokens long, n_unknown long")


def count_report(docs: DataFrame) -> DataFrame:
    """``op5``: word-piece counts of each document."""
    return token_counts(docs).withColumnRenamed("id", "doc_id")
