"""Language-model scores by a weighted backoff automaton.

States are the words of the training texts, the start and the empty history. A state has an arc for each word that followed it,
weighted with the log of its smoothed bigram, and a failure arc to the empty history, where every word has its smoothed unigram. One
pass from left to right carries the state and adds the weights up. Counts cover all training texts and are gathered by
``corpus.counted``; each batch of texts builds the part of the automaton that its own words can reach, which gives the
weights of the whole one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfolio.llm.corpus import batches_for, counted, dealt, keyed, summed
from sparkfolio.llm.textnum import U, mixed, word_hashes

LAMBDA = 0.1  # share of the bigram in the smoothed probability
END, START = U(0x5D1E5C0DE0000001), U(0x5D1E5C0DE0000002)


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(before * U(0x9E3779B97F4A7C15) + (word ^ U(0xC2B2AE3D27D4EB4F)))


def token_stream(col) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each token of the rows (words, then one end for each row), the token before it, and the row."""
    tokens, rows = [], []
    for i, j, h, first in word_hashes(col):
        n = np.diff(first)
        out = np.full(len(h) + (j - i), END)
        row = np.repeat(np.arange(j - i), n + 1)
        ends = np.cumsum(n + 1) - 1
        inside = np.ones(len(out), bool)
        inside[ends] = False
        out[inside] = h
        tokens.append(out)
        rows.append(row + i)
    t = np.concatenate([*tokens, np.zeros(0, U)])
    r = np.concatenate([*rows, np.zeros(0, np.int64)])
    before = np.full(len(t), START)
    if len(t):
        before[1:] = np.where(r[1:] == r[:-1], t[:-1], START)
    return t, before, r


@dataclass(frozen=True)
class Automaton:
    """Weights in log10. ``words`` and ``arcs`` are sorted keys; a word unknown to training has count 0."""

    words: np.ndarray
    counts: np.ndarray  # of each word in training
    arcs: np.ndarray
    followed: np.ndarray  # count of each arc's pair in training
    total: int  # training tokens
    distinct: int  # training words
    texts: int  # training texts, the count of the start

    def unigram(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and log10 probability of words at the empty history."""
        at = np.minimum(np.searchsorted(self.words, word), max(0, len(self.words) - 1))
        c = np.where(self.words[at] == word, self.counts[at], U(0)).astype(float) if len(self.words) else np.zeros(len(word))
        return c, np.log10((c + 1) / (self.total + self.distinct + 1))

    def traverse(self, before: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts, unigram weights and weights of the steps from state ``before`` by ``word``. The state after a step is its word, so
        the steps of all texts are taken at once."""
        c, empty = self.unigram(word)
        known = np.where(before == START, float(self.texts), self.unigram(before)[0])
        pair = pair_keys(before, word)
        at = np.minimum(np.searchsorted(self.arcs, pair), max(0, len(self.arcs) - 1))
        f = np.where(self.arcs[at] == pair, self.followed[at], U(0)).astype(float) if len(self.arcs) else np.zeros(len(word))
        fail = np.where(known > 0, np.log10(1 - LAMBDA), 0.0)  # a state without training has its failure arc only
        bigram = np.divide(f, known, out=np.zeros(len(f)), where=known > 0)
        arc = np.log10(LAMBDA * bigram + (1 - LAMBDA) * 10.0 ** empty)
        return c, empty, np.where(f > 0, arc, fail + empty)


def lm_scores(docs: DataFrame, learn: Column, id_col: str = "doc_id", text: str = "text", n_batches: int | None = None) -> DataFrame:
    """Per row: id, learned, n_tokens, n_known, train_tokens, base_score (add-one unigrams), score (log10 of the whole text).

    Counts come from the rows where ``learn`` is true (null: not). Null and empty texts have one token, the end. Repeated rows
    are scored and counted each. Without training rows every word has probability 1 / 1 in the base count's formula.
    """
    own = keyed(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), F.coalesce(learn, F.lit(False)).alias("learned")))
    n = n_batches or batches_for(own)
    batched = dealt(own, n).drop("key")

    def ask(t: pa.Table):
        tokens, before, row = token_stream(t["text"])
        learned = np.asarray(t["learned"])[row].astype(U)
        return [summed(tokens, learned), summed(pair_keys(before, tokens), learned)]

    def answer(batches):
        replies: list[list[np.ndarray]] = [[] for _ in batches]
        totals = []
        for s in (0, 1):
            keys, total = summed(np.concatenate([b[s][0] for b in batches]), np.concatenate([b[s][1] for b in batches]))
            for r, b in zip(replies, batches, strict=True):
                r.append(total[np.searchsorted(keys, b[s][0])])
            if s == 0:
                end = np.searchsorted(keys, END)
                ends = int(total[end]) if end < len(keys) and keys[end] == END else 0
                totals = [int(total.sum()), int((total > 0).sum()), ends]
        return replies, totals

    def use(t: pa.Table, counts: list[np.ndarray], totals: list[int]) -> pa.Table:
        tokens, before, row = token_stream(t["text"])
        automaton = Automaton(np.unique(tokens), counts[0], np.unique(pair_keys(before, tokens)), counts[1], *totals)
        rows = t.num_rows
        sums = [np.zeros(rows) for _ in range(3)]
        for i in range(0, len(tokens), 1 << 18):  # bounded temporary arrays
            part = slice(i, i + (1 << 18))
            c, empty, step = automaton.traverse(before[part], tokens[part])
            for out, v in zip(sums, (c > 0, empty, step), strict=True):
                out += np.bincount(row[part], v, rows)
        return pa.table({"doc_id": t["doc_id"], "learned": t["learned"], "n_tokens": pa.array(np.bincount(row, minlength=rows)),
                         "n_known": pa.array(sums[0].astype(np.int64)), "train_tokens": pa.array([totals[0]] * rows, pa.int64()),
                         "base_score": pa.array(sums[1]), "score": pa.array(sums[2])})

    id_type = own.schema["doc_id"].dataType.simpleString()
    scored = counted(batched, n, ask, answer, use, f"doc_id {id_type}, learned boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
                     "base_score double, score double")
    return scored.withColumnRenamed("doc_id", id_col)
