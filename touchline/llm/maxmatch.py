"""Token counts by a linear longest-match automaton: greedy word-piece lengths without building the pieces.

The vocabulary is a trie with two roots: pieces that begin a word, and pieces that continue one. A node's failure link leads to
where matching goes on when no child fits, after popping the longest pieces that cover the node; only how many are popped is
kept. Each byte of a word is read once.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.bpe import load_ranks
from touchline.llm.common import slices, text_bytes

BEGIN, CONTINUE = 0, 1
CACHE = 200_000


class Automaton:
    def __init__(self, begin: Iterable[bytes], go_on: Iterable[bytes]):
        self.child: dict[int, int] = {}
        self.ends = [False, False]
        below: list[list[tuple[int, int]]] = [[], []]
        for root, pieces in ((BEGIN, begin), (CONTINUE, go_on)):
            for piece in pieces:
                node = root
                for c in piece:
                    key = node << 8 | c
                    if key not in self.child:
                        self.child[key] = len(self.ends)
                        below[node].append((c, len(self.ends)))
                        self.ends.append(False)
                        below.append([])
                    node = self.child[key]
                self.ends[node] = node > CONTINUE
        self.fail = [-1] * len(self.ends)
        self.popped = [0] * len(self.ends)
        queue = deque((BEGIN, CONTINUE))
        while queue:
            u = queue.popleft()
            for c, v in below[u]:
                if self.ends[v]:
                    self.fail[v], self.popped[v] = CONTINUE, 1
                else:
                    z, n = self.fail[u], self.popped[u]
                    while z >= 0 and (z << 8 | c) not in self.child:
                        n += self.popped[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.popped[v] = self.child[z << 8 | c], n
                queue.append(v)

    def count(self, word: bytes) -> int:
        """Pieces of the greedy longest match; a word that the vocabulary can't cover counts as one unknown piece."""
        u, n, child, fail, popped = BEGIN, 0, self.child, self.fail, self.popped
        for c in word:
            while (to := child.get(u << 8 | c)) is None:
                n += popped[u]
                u = fail[u]
                if u < 0:
                    return 1
            u = to
        while u > CONTINUE:
            n += popped[u]
            u = fail[u]
        return n if u == CONTINUE or not word else 1


def vocabulary(path: str) -> tuple[list[bytes], list[bytes]]:
    """Word-piece vocabulary of a byte-level token file: tokens after a space begin words, others continue them; single bytes do both."""
    tokens = list(load_ranks(path))
    single = [bytes([i]) for i in range(256)]
    return sorted({t[1:] for t in tokens if t[:1] == b" " and len(t) > 1} | set(single)), sorted({t for t in tokens if t[:1] != b" "} | set(single))


_own: dict[str, Automaton] = {}


class _Counts(dict):
    def __init__(self, own: Automaton):
        self.own = own

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        out = self.own.count(word)
        if len(word) < 64:
            self[word] = out
        return out


def count_tokens(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens of every row; words lie between ASCII white space.

    Null and empty texts have none; repeated rows stay; an empty table gives no rows.
    """

    # Only the driver reads the file; the pieces are as many as the vocabulary has.
    pieces = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _own:  # one a worker process
            _own[path] = Automaton(*pieces.value)
        counts = _Counts(_own[path])
        for batch in batches:
            words, tokens = [], []
            for part in slices(batch.column(1)):
                for text in part:
                    own = text.split()
                    words.append(len(own))
                    tokens.append(sum(map(counts.__getitem__, own)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(words, dtype=np.int64)), pa.array(np.array(tokens, dtype=np.int64))], names=["doc_id", "n_words", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("t"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_tokens long")
