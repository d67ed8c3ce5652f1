"""Token counts by dynamic programming over a trie of pre-tokens.

A text's pre-tokens are the units that no piece of the model spans. The distinct ones of a batch
are put in a trie, level by level; a node stands for a prefix that many of them share, and is
computed once. Each node carries the pieces still being spelled (the node they began at, and their
state in the trie of the vocabulary); a piece that is complete is an edge into the node. From the
edges come, for every prefix once,

* the unigram forward score: the best sum of piece scores, and the number of pieces of that
  segmentation (of equal scores the one whose last piece is longest, as in the library), and
* the number of pieces of the model's own encoding, if it is of type BPE: there the edge is taken
  whose piece may follow the prefix's last piece by the merge rule.

What is at the node where a pre-token ends is kept for the pre-token, and a text's counts are sums.

Defined results: a null text has null counts, the empty one 0. A character without a piece counts
its UTF-8 bytes; in the unigram score it has the lowest score less 10. Whole texts are counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import batch_of, mapped, packed, slices
from .piece_codec import Merges
from .pieces import Store, Vocabulary, units_of

UNKNOWN_LESS, AT_ONCE = 10.0, 50_000


class VocabularyTrie:
    """States of the spelled pieces; transitions as one sorted array of (state, code)."""

    def __init__(self, vocabulary: Vocabulary, merges: Merges):
        texts = vocabulary.texts
        chars = sorted({c for t in texts for c in t})
        self.chars = len(chars)
        self.table = np.zeros(0x110000, dtype=np.int32)
        code = {c: k for k, c in enumerate(chars)}
        # a character without a piece: its code says how many bytes it has
        points = np.arange(0x110000)
        self.table[:] = self.chars + 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        self.table[[ord(c) for c in chars]] = np.arange(self.chars)
        self.width = self.chars + 5
        steps: dict[int, int] = {}
        piece_of = [-1]
        for i, text in enumerate(texts):
            state = 0
            for c in text:
                key = state * self.width + code[c]
                if key not in steps:
                    steps[key] = len(piece_of)
                    piece_of.append(-1)
                state = steps[key]
            if text:
                piece_of[state] = i
        self.keys = np.array(sorted(steps), dtype=np.int64)
        self.next = np.array([steps[k] for k in self.keys.tolist()], dtype=np.int64)
        self.piece_of = np.array(piece_of, dtype=np.int64)
        self.scores = vocabulary.scores
        self.unknown = float(min((s for s, t in zip(vocabulary.scores, texts) if t), default=0.0)) - UNKNOWN_LESS
        self.merges = merges

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The next state, or -1."""
        key = state * self.width + code
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[k] == key, self.next[k], -1)

    def counts(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """((own count, unigram count, ...), 2 of them for each unit); a trie for so many units at a time."""
        found = [self.forward(units[k:k + AT_ONCE])[:2] for k in range(0, len(units), AT_ONCE)]
        own, unigram = (np.concatenate(x) for x in zip(*found))
        return np.stack((own, unigram), axis=1).ravel().astype(np.int32), np.full(len(units), 2)

    def forward(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each unit the pieces of its own encoding, those of its best segmentation, and the best score."""
        sizes = np.array([len(u) for u in units], dtype=np.int64)
        codes = self.table[np.frombuffer("".join(units).encode("utf-32-le", "replace"), dtype="<u4")].astype(np.int64)
        begin = np.cumsum(sizes) - sizes
        # by node, of all levels: best score, its pieces, pieces of the own encoding, last piece of it
        score, pieces, own, last = np.zeros(1), np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, -1)
        at = np.zeros(len(units), dtype=np.int64)           # the node each unit has reached
        spelled = (np.zeros(0, np.int64),) * 3              # node (of the level before), began at, state: sorted by node
        depth, base = 0, 0                                  # base: the first node of the level before
        alive = np.flatnonzero(sizes > 0)
        while len(alive):
            known, back = np.unique(at[alive] * self.width + codes[begin[alive] + depth], return_inverse=True)
            parent, code = known // self.width, known % self.width
            first = len(score)
            at[alive] = first + back
            # every piece being spelled at the parent, and one that begins there, is tried with the new character
            node, started, state = spelled
            low, high = np.searchsorted(node, parent), np.searchsorted(node, parent, side="right")
            n = high - low
            new = np.repeat(np.arange(len(known)), n)
            where = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
            new, started, state = (np.concatenate(x) for x in (
                (new, np.arange(len(known))), (started[where], parent), (state[where], np.zeros(len(known), np.int64))))
            state = self.step(state, code[new])
            new, started, state = new[state >= 0], started[state >= 0], state[state >= 0]
            order = np.lexsort((started, new))              # a node's longest piece first
            new, started, state = new[order], started[order], state[order]
            spelled = (new + first, started, state)
            piece = self.piece_of[state]
            done = piece >= 0
            into, source, piece = new[done], started[done], piece[done]

            reached = score[source] + self.scores[piece]
            best = np.full(len(known), -np.inf)
            np.maximum.at(best, into, reached)
            wins = np.flatnonzero(reached == best[into])
            wins = wins[np.concatenate(([True], into[wins][1:] != into[wins][:-1]))] if len(wins) else wins
            level_pieces, level_own, level_last = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64), np.full(len(known), -1)
            level_pieces[into[wins]] = pieces[source[wins]] + 1
            before = last[source]
            ok = before < 0
            ask = np.flatnonzero(~ok)
            ok &= self.merges.reachable[piece]
            ok[ask] = self.merges.reachable[piece[ask]] & self.merges.may_follow(before[ask], piece[ask])
            level_own[into[ok]], level_last[into[ok]] = own[source[ok]] + 1, piece[ok]
            odd = np.flatnonzero(code >= self.chars)        # bytes; what follows them is not bound by the merge rule
            size = code[odd] - self.chars
            best[odd] = score[parent[odd]] + self.unknown
            level_pieces[odd], level_own[odd] = pieces[parent[odd]] + size, own[parent[odd]] + size
            score, pieces, own, last = (np.concatenate(x) for x in (
                (score, best), (pieces, level_pieces), (own, level_own), (last, level_last)))
            depth += 1
            alive = alive[sizes[alive] > depth]
        return own[at], pieces[at], score[at]


def _counter(vocabulary: Vocabulary, merges: Merges):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, store, words = VocabularyTrie(vocabulary, merges), Store(), vocabulary.words
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            index, distinct, ends = units_of(vocabulary, texts, words)
            rows = store.look_up(distinct, trie.counts)
            filled = np.array([u != "" for u in distinct], dtype=np.int64)
            each = np.column_stack((store.values.reshape(-1, 2)[rows], filled))
            sums = np.concatenate((np.zeros((1, 3), np.int64), np.cumsum(each[index], axis=0, dtype=np.int64)))[ends]
            sums = sums[1:] - sums[:-1]
            missing = np.array([t is None for t in texts], dtype=bool)
            yield batch_of(batch.column("row"), **{
                name: pa.array(values, pa.int64(), mask=missing)
                for name, values in (("n_pretokens", sums[:, 2]), ("n_tokens", sums[:, 0]), ("n_unigram", sums[:, 1]))})
    return count


def counted(docs: DataFrame, vocabulary: Vocabulary, keep: list[str]) -> DataFrame:
    """row (the columns ``keep``), n_pretokens, n_tokens (the model's own encoding), n_unigram (best segmentation)."""
    return mapped(packed(docs, keep), _counter(vocabulary, Merges(vocabulary)), "n_pretokens long, n_tokens long, n_unigram long")
