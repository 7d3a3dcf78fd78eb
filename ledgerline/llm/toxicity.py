"""Toxicity: a learned lexicon found through misspellings, weighed by the window around each term.

The lexicon is learned from labelled rows: words that stand mostly in toxic documents. It is kept as a
trie. A text's word is turned into a Levenshtein automaton of ``errors`` edits, held as bit masks (bit
``i`` of mask ``e``: the word's first ``i`` letters are matched with ``e`` edits), and trie and automaton are
walked together; a branch ends where no mask has a bit left. Each distinct word is walked once a worker.
Terms from four letters on are found with one edit, a swap of neighbouring letters being one; hits on terms of
fewer than ``FIRM`` letters, which ordinary words come near, are a feature of their own.

A term's window (``WINDOW`` words each side, and the marks around the term) gives a context score between
quotation and abuse: quotation marks that enclose the term and words of reporting speak for quotation,
words that address somebody speak for abuse. A small logistic regression over a document's sums weighs
them; it is fitted on labelled rows that the lexicon wasn't learned from.

Both models are fitted on at most about ``sample`` labelled rows, drawn by keyed hash, at any size of the
tables. Scoring reads every text whole and once, without a shuffle.

Defined results: null and empty texts get the score of a text without terms; repeated rows are scored each
for themselves; a document with several labels counts as toxic if one says so; without labels of both
kinds every score is 0.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import materialise, per_worker, sampled
from ledgerline.llm.langid import held_out

WORD = re.compile(r"\w+")
WINDOW = 5
#: A worker forgets the words it has looked up beyond this number; it looks them up anew when they return.
REMEMBERED = 400_000
FEATURES = ("exact", "strongest", "misspelled", "quoted", "addressed", "density", "short")
#: Misspelled terms of fewer letters are weighed apart.
FIRM = 6

# Marks and words that frame quotation, and words that address somebody.
OPENING = "\"'“‘«„‹`"
CLOSING = "\"'”’»“›`"
REPORTING = frozenset("said says say wrote writes called calls quote quoted quotes cited cites reported reports term word sagte schrieb genannt zitat dit écrit appelé citation dijo escribió llamó cita".split())
ADDRESSING = frozenset("you your yours youre u ur du dich dir dein deine ihr euch tu te toi vous votre tes ton ta ti tus usted ustedes eres".split())


class Lexicon:
    """A trie of terms with weights, walked together with the automaton of a word."""

    def __init__(self, weights: dict[str, float], errors: int = 1, least: int = 4, swaps: bool = False):
        self.weights, self.errors, self.least, self.swaps = weights, errors, least, swaps
        self.root: dict = {}
        self.longest = max(map(len, weights), default=0)
        #: terms, and terms without one of their letters
        self.nearby: set[str] = set()
        for term in weights:
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node[""] = term
            if len(term) >= least:
                self.nearby.add(term)
                self.nearby.update(term[:k] + term[k + 1 :] for k in range(len(term)))

    def maybe(self, word: str) -> bool:
        """Whether the walk could find something: after a single edit, word and term are equal with a letter less on one side or on both."""
        if self.errors > 1:
            return True
        nearby = self.nearby
        if word in nearby:
            return True
        for k in range(len(word)):
            if word[:k] + word[k + 1 :] in nearby:
                return True
        return False

    def find(self, word: str) -> tuple[str, int] | None:
        """The nearest term within the edits (at equal distance the heavier, then the first), or None."""
        if word in self.weights:
            return word, 0
        n = len(word)
        if not self.errors or n < self.least - self.errors or n > self.longest + self.errors or not self.maybe(word):
            return None
        at: dict[str, int] = {}
        for i, c in enumerate(word):
            at[c] = at.get(c, 0) | 1 << i
        full, end = (1 << n + 1) - 1, 1 << n
        masks = [((1 << e + 1) - 1) & full for e in range(self.errors + 1)]
        best: tuple[int, float, str] | None = None
        # with each node, for swaps: the masks of its parent and the places of its own letter
        stack = [(self.root, masks, [0] * len(masks), 0)]
        while stack:
            node, masks, parent, came = stack.pop()
            for c, child in node.items():
                if c == "":
                    continue
                fits = at.get(c, 0)
                new = [(masks[0] & fits) << 1]
                for e in range(1, len(masks)):
                    # match | insertion in the term | substitution | deletion from the term
                    m = ((masks[e] & fits) << 1) | masks[e - 1] | masks[e - 1] << 1 | new[e - 1] << 1
                    if self.swaps:
                        m |= ((parent[e - 1] & fits) << 1 & came) << 1
                    new.append(m & full)
                if not new[-1]:
                    continue
                if (term := child.get("")) is not None and len(term) >= self.least:
                    for e, m in enumerate(new):
                        if m & end:
                            found = (e, -self.weights[term], term)
                            best = min(best, found) if best else found
                            break
                stack.append((child, new, masks, fits))
        return (best[2], best[0]) if best else None


class Scanner:
    """Features of texts; remembers the words it has looked up."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.seen, self.hits = lexicon, set(), {}

    def features(self, text: str | None) -> list[float]:
        if not text:
            return [0.0] * len(FEATURES)
        low = text.lower()
        words = WORD.findall(low)
        distinct = set(words)
        for w in distinct - self.seen:
            if got := self.lexicon.find(w):
                self.hits[w] = got
        self.seen |= distinct
        if len(self.seen) > REMEMBERED:
            self.seen, kept = set(), {w: self.hits[w] for w in distinct if w in self.hits}
        else:
            kept = self.hits
        self.hits = kept
        found = distinct & kept.keys()
        return self.weigh(low, words, found) if found else [0.0] * len(FEATURES)

    def weigh(self, low: str, words: list[str], found: set[str]) -> list[float]:
        exact = strongest = misspelled = quoted = addressed = short = 0.0
        spans = [m.span() for m in WORD.finditer(low)]
        for k in (k for k, w in enumerate(words) if w in found):
            term, edits = self.hits[words[k]]
            weight = self.lexicon.weights[term]
            near = words[max(0, k - WINDOW) : k] + words[k + 1 : k + 1 + WINDOW]
            # the window's letters reach to the words that lie next to it
            before = low[spans[k - WINDOW - 1][1] if k > WINDOW else 0 : spans[k][0]]
            after = low[spans[k][1] : spans[k + WINDOW + 1][0] if k + WINDOW + 1 < len(spans) else len(low)]
            framed = any(x in before for x in OPENING) and any(x in after for x in CLOSING)
            quotation = (0.6 if framed else 0.0) + min(0.4, 0.2 * sum(x in REPORTING for x in near))
            abuse = min(1.0, 0.5 * sum(x in ADDRESSING for x in near))
            weight *= 1 - 0.8 * quotation * (1 - abuse)
            if edits and len(term) < FIRM:
                short += weight
                continue
            quoted += quotation * (1 - abuse)
            addressed += abuse
            if edits:
                misspelled += weight
            else:
                exact += weight
                strongest = max(strongest, weight)
        return [np.log1p(exact), strongest, np.log1p(misspelled), np.log1p(quoted), np.log1p(addressed), np.log1p(1000 * (exact + misspelled) / (20 + len(words))), np.log1p(short)]


def learn_lexicon(rows: DataFrame, support: int = 3, precision: float = 0.5, ceiling: float = 4.0, lift: float = 1.0) -> dict[str, float]:
    """Weights of the words of ``rows(text, toxic)`` that stand mostly in toxic texts: smoothed log odds over those of all rows, up to a ceiling, so that a term counts by how sure it is, not by how common.

    Every word's clean and toxic texts are counted whole before any is ranked, so the lexicon doesn't depend on how the rows are
    dealt. A word that clean texts quote enters with the smaller weight that its odds give it; one under ``lift`` doesn't.
    All words that pass are terms; the bounded sample bounds them.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[int]] = {}
        total = [0, 0]
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[y] += 1
                for w in set(WORD.findall((text or "").lower())):
                    sums.setdefault(w, [0, 0])[y] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(["", *sums], pa.string()), pa.array([total[0], *(v[0] for v in sums.values())], pa.int64()), pa.array([total[1], *(v[1] for v in sums.values())], pa.int64())], ["word", "clean", "toxic"]
        )

    counts = rows.select("text", "toxic").mapInArrow(count, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = materialise(counts.where((F.col("word") == "") | (F.col("toxic") >= support) & (F.col("toxic") >= precision * (F.col("toxic") + F.col("clean")))))
    base = counts.where("word = ''").first()
    if not base or not base["clean"] or not base["toxic"]:
        return {}
    weight = F.log((F.col("toxic") + 0.5) / (F.col("clean") + 0.5)) + float(np.log((base["clean"] + 1) / (base["toxic"] + 1)))
    top = counts.where("word <> ''").withColumn("weight", weight).where(F.col("weight") >= lift)
    return {r["word"]: min(r["weight"], ceiling) for r in top.collect()}


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Logistic regression by Newton's steps; the last weight is the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-3])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _features(rows: DataFrame, lexicon: dict[str, float], carried: str) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(lexicon)
    named = hashlib.md5(repr(sorted(lexicon.items())).encode()).hexdigest()
    kind = dict(rows.dtypes)[carried]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = per_worker(("toxicity", named), lambda: Scanner(Lexicon(sent.value, swaps=True)))
        for batch in batches:
            x = [scanner.features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], [carried, "x"])

    return rows.select(carried, "text").mapInArrow(scan, f"{carried} {kind}, x array<double>")


def learn(docs: DataFrame, labels: DataFrame, sample: int = 50_000) -> tuple[dict[str, float], np.ndarray]:
    """(lexicon, weights of the regression) from the labels' rows that aren't held out."""
    marked = labels.where("toxic is not null").select("doc_id", "toxic").where(~held_out(3, 1)).where("doc_id is not null")
    n = marked.count()
    if n > sample:
        marked = marked.where(sampled("toxicity", "doc_id", sample, n))
    marked = marked.groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # about `sample` rows of 12 bytes, whatever the size of the tables
    rows = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id")
    second = F.pmod(F.xxhash64(F.lit("second"), "doc_id"), F.lit(3)) == 0
    lexicon = learn_lexicon(rows.where(~second))
    got = _features(rows.where(second), lexicon, "toxic").collect()
    x, y = np.array([r["x"] for r in got], float).reshape(-1, len(FEATURES)), np.array([r["toxic"] for r in got], float)
    weights = fit(x, y) if 0 < y.sum() < len(y) else np.array([0.0] * len(FEATURES) + [-50.0])
    return lexicon, weights


def score(docs: DataFrame, model: tuple[dict[str, float], np.ndarray]) -> DataFrame:
    """(doc_id, score, x) of every row of ``docs(doc_id, text)``; x holds the document's sums, named in FEATURES."""
    lexicon, w = model
    z = F.lit(float(w[-1]))
    for k, v in enumerate(w[:-1]):
        z = z + F.get("x", k) * float(v)
    return _features(docs, lexicon, "doc_id").select("doc_id", (1 / (1 + F.exp(-z))).alias("score"), "x")


def op1_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's row for every document."""
    scored = score(docs.select("doc_id", "text"), learn(docs, labels))
    return scored.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "x")
