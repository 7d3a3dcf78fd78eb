"""Token counts by longest match from the left, in time linear in the text.

Words are the runs between white space, each with a word mark before it; a word is cut into the longest
pieces from the left. The pieces form a trie whose nodes carry a failure link and the number of pieces that
are popped when it is taken: a node that is a piece pops itself and goes back to the root; any other node
pops what its parent pops and then follows its parent's failure until the letter fits. A scan moves down the
trie or along a link, never back in the text, and only adds up numbers: no piece is built. A letter that no
piece has counts as its UTF-8 bytes.

Defined results: null and empty texts have no words and no tokens; repeated rows count each for themselves;
there is no shuffle, and every text is read whole.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerline.llm.common import per_worker
from ledgerline.llm.vocabulary import SPACE, read_pieces

#: A worker keeps the counts of at most so many words; others are scanned again.
REMEMBERED = 400_000


class LongestMatch:
    """The automaton. Every letter of a piece must itself be a piece; pieces for which that fails are left out."""

    def __init__(self, pieces: Iterable[str]):
        single = {p for p in pieces if len(p) == 1}
        usable = [p for p in pieces if p and single.issuperset(p)]
        self.child: list[dict[str, int]] = [{}]
        piece = [False]
        for p in usable:
            at = 0
            for c in p:
                if c not in self.child[at]:
                    self.child[at][c] = len(self.child)
                    self.child.append({})
                    piece.append(False)
                at = self.child[at][c]
            piece[at] = True
        n = len(self.child)
        self.fail, self.pops, self.rest = [0] * n, [0] * n, [0] * n
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for c, v in self.child[parent].items():
                if piece[v]:
                    self.fail[v], self.pops[v] = 0, 1
                else:
                    at, popped = self.fail[parent], self.pops[parent]
                    while c not in self.child[at]:
                        popped += self.pops[at]
                        at = self.fail[at]
                    self.fail[v], self.pops[v] = self.child[at][c], popped
                queue.append(v)
        for v in range(1, n):  # pieces popped from a node to the root; links lead to shorter strings
            at, popped = v, 0
            while at:
                popped += self.pops[at]
                at = self.fail[at]
            self.rest[v] = popped

    def count(self, word: str) -> int:
        child, fail, pops = self.child, self.fail, self.pops
        at = n = 0
        for c in word:
            while (to := child[at].get(c)) is None and at:
                n += pops[at]
                at = fail[at]
            if to is None:
                n += len(c.encode("utf-8", "surrogatepass"))
            else:
                at = to
        return n + self.rest[at]


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_tokens) of every row of ``docs(doc_id, text)`` under the vocabulary at ``path``."""
    pieces, _ = read_pieces(path)
    sent = docs.sparkSession.sparkContext.broadcast(sorted(pieces))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int]
        match, known = per_worker(("longest match", path), lambda: (LongestMatch(sent.value), {}))
        for batch in batches:
            n_words, n_tokens = [], []
            for text in batch.column(1).to_pylist():
                words = (text or "").split()
                total = 0
                for w in words:
                    n = known.get(w)
                    if n is None:
                        n = match.count(SPACE + w)
                        if len(known) < REMEMBERED and len(w) < 64:
                            known[w] = n
                    total += n
                n_words.append(len(words))
                n_tokens.append(total)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, n_words long, n_tokens long")


def op9_token_counts(docs: DataFrame) -> DataFrame:
    return count_tokens(docs)
