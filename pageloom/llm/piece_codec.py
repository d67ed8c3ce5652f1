"""SentencePiece encoding and decoding, by suffix-array matching.

A task cuts its texts into units that no piece spans, and encodes each distinct unit once:

1. The units of a batch are one sequence of character codes. Its suffixes are ranked by their first
   16 characters (the longest piece), by doubling: ranks of 4, 8, 16 characters; sorted, they are
   the suffix array.
2. Every piece is searched in it by bisection; the suffixes that begin with it are one range.
3. All occurrences are edges (start, end, piece). They are sorted by the end's place in its unit.
4. Edges are relaxed in this order, place by place, for all units at a time. The encoding of a prefix
   ends with exactly one piece: the edge whose piece can follow the last piece of the encoding of
   what is before it. Whether one piece can follow another is settled by the merge rule: encoding
   the two together must give the two again. Walking back from the end gives the pieces.

So ids equal those of the SentencePiece library for models of type BPE: best score first, leftmost
first among equals, bytes for characters without a piece.

Defined results: null gives null, the empty text no ids; decoding gives the text again, but that a
character U+2581 comes back as a blank, as in the library. Texts of any length are encoded whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .batches import batch_of, mapped, packed, slices
from .pieces import SPACE, Store, Vocabulary, units_of

BLOCK, DEPTH, BATCH_CODES = 4, 16, 200_000
UNKNOWN = -2


class Merges:
    """The merge rule of a vocabulary as arrays: which pieces join to which, and how each piece comes to be."""

    def __init__(self, vocabulary: Vocabulary):
        texts = vocabulary.texts
        self.n = len(texts)
        self.rank = np.unique(-vocabulary.scores, return_inverse=True)[1].astype(np.int64)     # equal scores, equal ranks
        of = {t: i for i, t in enumerate(texts) if t}
        self.reachable = np.zeros(self.n, dtype=bool)
        left_spines, right_spines = [()] * self.n, [()] * self.n
        joins: dict[int, int] = {}
        for text, i in of.items():
            for k in range(1, len(text)):
                if (a := of.get(text[:k])) is not None and (b := of.get(text[k:])) is not None:
                    joins[a * self.n + b] = i
        for i in sorted(of.values(), key=lambda i: len(texts[i])):
            parts, built = [of[c] for c in texts[i]], {}
            while len(parts) > 1:
                options = [(self.rank[j], k, j) for k in range(len(parts) - 1)
                           if (j := joins.get(parts[k] * self.n + parts[k + 1])) is not None]
                if not options:
                    break
                _, k, j = min(options)
                built[j] = (parts[k], parts[k + 1])
                parts[k:k + 2] = [j]
            if parts == [i]:
                self.reachable[i] = True
                a, b = built.get(i, (None, None))
                left_spines[i] = (*left_spines[a], i) if a is not None else (i,)
                right_spines[i] = (*right_spines[b], i) if a is not None else (i,)
        deep = 1 + max(map(len, [*left_spines, *right_spines]), default=1)
        # from the single character up to the piece, then -1
        self.left = np.array([(*s, *[-1] * (deep - len(s))) for s in left_spines], dtype=np.int32).reshape(-1, deep)
        self.right = np.array([(*s, *[-1] * (deep - len(s))) for s in right_spines], dtype=np.int32).reshape(-1, deep)
        self.keys = np.array(sorted(joins), dtype=np.int64)
        self.joined = np.array([joins[k] for k in self.keys.tolist()], dtype=np.int64)
        self.seen_keys = np.full(1 << 20, -1, dtype=np.int64)
        self.seen = np.zeros(1 << 20, dtype=bool)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("seen")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.seen_keys, self.seen = np.full(1 << 20, -1, dtype=np.int64), np.zeros(1 << 20, dtype=bool)

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether encoding the pieces ``a`` and ``b`` together leaves the two; verdicts are kept in a table of fixed size."""
        key = a.astype(np.int64) * self.n + b
        slot = ((key * 0x9E3779B1) >> 7) & (len(self.seen) - 1)
        new = np.flatnonzero(self.seen_keys[slot] != key)
        out = self.seen[slot]
        if len(new):
            distinct, back = np.unique(key[new], return_inverse=True)
            verdict = self._judge(distinct // self.n, distinct % self.n)
            out[new] = verdict[back]
            place = ((distinct * 0x9E3779B1) >> 7) & (len(self.seen) - 1)
            self.seen_keys[place], self.seen[place] = distinct, verdict
            # of two keys for one place the later one stays, in both arrays alike
            kept = self.seen_keys[place] == distinct
            self.seen[place[kept]] = verdict[kept]
        return out

    def _judge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Both pieces grow as they would alone; the answer is no if, on the way, the parts at the border join first."""
        good, at = np.ones(len(a), dtype=bool), np.arange(len(a))
        i, j = np.zeros(len(a), dtype=np.int64), np.zeros(len(a), dtype=np.int64)
        never = np.int64(1 << 60)
        while len(at):
            x, y = self.right[a[at], i[at]], self.left[b[at], j[at]]
            x_next, y_next = self.right[a[at], i[at] + 1], self.left[b[at], j[at] + 1]
            x_when = np.where(x_next >= 0, self.rank[x_next], never)
            y_when = np.where(y_next >= 0, self.rank[y_next], never)
            key = x.astype(np.int64) * self.n + y
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            cross = np.where(self.keys[k] == key, self.rank[self.joined[k]], never)
            # among equals the leftmost goes first: the left piece's own step, then the border, then the right piece's
            bad = (cross < x_when) & (cross <= y_when) & (cross < never)
            good[at[bad]] = False
            left_first = x_when <= y_when
            i[at] += left_first
            j[at] += ~left_first
            at = at[~bad & ((x_when < never) | (y_when < never))]
        return good


class Encoder:
    def __init__(self, vocabulary: Vocabulary, merges: Merges):
        self.vocabulary, self.merges, self.words = vocabulary, merges, vocabulary.words
        pieces = [i for i in np.flatnonzero(merges.reachable).tolist() if len(vocabulary.texts[i]) <= DEPTH]
        if len(pieces) < merges.reachable.sum():
            raise ValueError(f"pieces of more than {DEPTH} characters")
        chars = sorted({c for i in pieces for c in vocabulary.texts[i]})
        self.table = np.full(0x110000, len(chars) + 1, dtype=np.uint16)        # characters without a piece
        self.table[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.unknown = len(chars) + 1
        self.sizes = np.array([len(t) for t in vocabulary.texts], dtype=np.int32)
        self.pieces = np.array(pieces, dtype=np.int32)
        codes = np.zeros((len(pieces), DEPTH), dtype=np.uint64)
        filled = np.zeros((len(pieces), DEPTH), dtype=bool)
        for row, i in enumerate(pieces):
            own = self.table[[ord(c) for c in vocabulary.texts[i]]]
            codes[row, :len(own)], filled[row, :len(own)] = own, True
        # each block of four characters as the lowest and highest key that begins with them
        shape = (len(pieces), DEPTH // BLOCK, BLOCK)
        self.low = self._pack(codes.reshape(shape))
        self.high = self._pack(np.where(filled, codes, np.uint64(0xFFFF)).reshape(shape))
        self.blocks = -(-filled.sum(axis=1) // BLOCK)
        spelled = [t.replace(SPACE, " ").encode() for t in vocabulary.texts]
        for value, i in enumerate(vocabulary.byte_ids.tolist()):
            spelled[i] = bytes([value])
        self.byte_text = pa.array(spelled, pa.large_binary())

    @staticmethod
    def _pack(codes: np.ndarray) -> np.ndarray:
        out = np.zeros(codes.shape[:-1], dtype=np.uint64)
        for k in range(BLOCK):
            out = out << np.uint64(16) | codes[..., k].astype(np.uint64)
        return out

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, piece) of all occurrences of all pieces; 0 in ``codes`` ends a unit."""
        n = len(codes)
        padded = np.concatenate((codes, np.zeros(DEPTH, dtype=np.uint16))).astype(np.uint64)
        key, alive = np.zeros(n, dtype=np.uint64), np.ones(n, dtype=bool)
        for k in range(BLOCK):      # nothing is compared beyond the unit's end
            own = padded[k:k + n]
            alive &= own != 0
            key = key << np.uint64(16) | np.where(alive, own, np.uint64(0))
        known, rank = np.unique(key, return_inverse=True)
        # for each piece and block the ranks that begin with it; an empty block admits all
        low = np.searchsorted(known, self.low)
        high = np.searchsorted(known, self.high, side="right")
        used = np.arange(DEPTH // BLOCK)[None, :] < self.blocks[:, None]
        low, high = np.where(used, low, 0), np.where(used, high, len(known))
        width = BLOCK
        while True:
            base = len(known)
            ahead = np.zeros(n, dtype=np.int64)
            ahead[:max(0, n - width)] = rank[width:]
            gap = np.minimum.accumulate(np.where(codes == 0, np.arange(n), n)[::-1])[::-1] if width == BLOCK else gap
            ahead[gap < np.arange(n) + width] = 0       # the unit ends within the first half
            pair = rank.astype(np.int64) * base + ahead
            half = used[:, 1::2]
            a_low, a_high, b_low, b_high = low[:, ::2], high[:, ::2], low[:, 1::2], high[:, 1::2]
            first, last = np.where(half, a_low * base + b_low, a_low * base), np.where(half, a_low * base + b_high, a_high * base)
            last = np.where(half & (a_high <= a_low), first, last)      # the whole first block doesn't occur
            used = used[:, ::2]
            width *= 2
            if width == DEPTH:
                order = np.argsort(pair)
                pair = pair[order]
                begin, end = np.searchsorted(pair, first[:, 0]), np.searchsorted(pair, last[:, 0])
                n_each = np.maximum(end - begin, 0)
                at = np.repeat(begin - (np.cumsum(n_each) - n_each), n_each) + np.arange(n_each.sum())
                return order[at].astype(np.int32), np.repeat(self.pieces, n_each)
            known, rank = np.unique(pair, return_inverse=True)
            low, high = np.searchsorted(known, first), np.searchsorted(known, last)
            low, high = np.where(used, low, 0), np.where(used, high, len(known))

    def encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, how many each unit has)."""
        out, start = [], 0
        sizes = np.array([len(u) for u in units])
        while start < len(units):       # about so many codes at a time
            end = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:] + 1), BATCH_CODES, side="right")))
            out.append(self._encode(units[start:end], sizes[start:end]))
            start = end
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])

    def _encode(self, units: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        points = np.frombuffer(("\x00".join(units) + "\x00").encode("utf-32-le", "replace"), dtype="<u4")
        codes = self.table[points]
        ends = np.cumsum(sizes + 1) - 1
        codes[ends] = 0
        begin = ends - sizes
        start, piece = self.edges(codes)
        odd = np.flatnonzero(codes == self.unknown).astype(np.int32)
        start, piece = np.concatenate((start, odd)), np.concatenate((piece, np.full(len(odd), UNKNOWN, dtype=np.int32)))
        end = start + np.where(piece >= 0, self.sizes[piece], np.int32(1))
        place = end - np.repeat(begin.astype(np.int32), sizes + 1)[start]        # how far the end is in its unit
        # places are small numbers in all but giant units, and those are sorted without comparing
        order = np.argsort(place.astype(np.uint16) if sizes.max(initial=0) < 1 << 16 else place, kind="stable")
        start, end, piece, place = start[order], end[order], piece[order], place[order]
        last = np.full(len(codes) + 1, -1, dtype=np.int32)      # the last piece of the encoding of what is before
        bounds = np.searchsorted(place, np.arange(1, (place[-1] if len(place) else 0) + 2))
        for p in range(len(bounds) - 1):
            s = slice(bounds[p], bounds[p + 1])
            before, own = last[start[s]], piece[s]
            open_ = (before < 0) | (own < 0)        # the unit begins here, or bytes are beside it
            ok = open_.copy()
            ask = np.flatnonzero(~open_)
            ok[ask] = self.merges.may_follow(before[ask], own[ask])
            last[end[s][ok]] = own[ok]
        # back from the ends
        at, unit, steps = ends.copy(), np.arange(len(units)), []
        going = sizes > 0
        at, unit = at[going], unit[going]
        while len(at):
            token = last[at]
            steps.append((unit, token, at))
            at = at - np.where(token >= 0, self.sizes[token], 1)
            more = at > begin[unit]
            at, unit = at[more], unit[more]
        counts = np.bincount(np.concatenate([u for u, _, _ in steps]) if steps else np.zeros(0, np.int64), minlength=len(units))
        close = np.cumsum(counts) - 1
        token, at = np.zeros(counts.sum(), dtype=np.int64), np.zeros(counts.sum(), dtype=np.int64)
        for back, (own, found, place) in enumerate(steps):
            token[close[own] - back], at[close[own] - back] = found, place
        unit = np.repeat(np.arange(len(units)), counts)
        if (bytes_of := np.flatnonzero(token == UNKNOWN)).size:
            spelled = [self.vocabulary.byte_ids[list(chr(points[k - 1]).encode("utf-8", "replace"))] for k in at[bytes_of]]
            more = np.array([len(s) for s in spelled])
            width = np.ones(len(token), dtype=np.int64)
            width[bytes_of] = more
            wide = np.repeat(token, width)
            wide[np.repeat(token == UNKNOWN, width)] = np.concatenate(spelled)
            counts = np.bincount(np.repeat(unit, width), minlength=len(units))
            token = wide
        return token.astype(np.int32), counts

    def decode(self, ids: pa.ListArray) -> list[str | None]:
        """The texts of the ids; what can't be read as UTF-8 becomes U+FFFD."""
        spelled = self.byte_text.take(ids.flatten())
        places = spelled.buffers()[1]
        at = np.frombuffer(places, dtype=np.int64)[spelled.offset:spelled.offset + len(spelled) + 1] if len(spelled) else np.zeros(1, np.int64)
        data = memoryview(spelled.buffers()[2] or b"")
        ends = at[np.cumsum([0, *pc.list_value_length(ids).fill_null(0).to_pylist()])].tolist()
        texts = [str(data[s:e], "utf-8", "replace") for s, e in zip(ends, ends[1:])]
        if self.vocabulary.prefix:
            texts = [t[1:] if t.startswith(" ") else t for t in texts]
        return [t if ok else None for t, ok in zip(texts, ids.is_valid().to_pylist())]


def _coder(vocabulary: Vocabulary, merges: Merges, back: bool):
    """Encodes; with ``back`` it decodes the ids, too, in the same worker."""
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, store = Encoder(vocabulary, merges), Store()
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            index, distinct, ends = units_of(vocabulary, texts, encoder.words)
            ids, sizes = store.gather(store.look_up(distinct, encoder.encode)[index])
            ends = np.concatenate(([0], np.cumsum(sizes)))[ends]
            missing = pa.array([t is None for t in texts])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()), mask=missing)
            more = {"decoded": pa.array(encoder.decode(lists), pa.string())} if back else {}
            yield batch_of(batch.column("row"), ids=lists, **more)
    return code


def _decoder(vocabulary: Vocabulary, merges: Merges):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary, merges)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                yield batch_of(part.column("row"), ids=part.column("ids"), decoded=pa.array(encoder.decode(part.column("ids")), pa.string()))
    return decode


def encoded(docs: DataFrame, vocabulary: Vocabulary, keep: list[str]) -> DataFrame:
    """row (the columns ``keep``) and ids."""
    return mapped(packed(docs, keep), _coder(vocabulary, Merges(vocabulary), False), "ids array<int>")


def decoded(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``rows`` (row, ids) with the text of the ids as ``decoded``."""
    return mapped(rows.select("row", "ids"), _decoder(vocabulary, Merges(vocabulary)), "ids array<int>, decoded string")


def there_and_back(docs: DataFrame, vocabulary: Vocabulary, keep: list[str]) -> DataFrame:
    """row (the columns ``keep``), ids, and the text decoded from them; in one pass, as ids needn't leave the worker."""
    return mapped(packed(docs, keep), _coder(vocabulary, Merges(vocabulary), True), "ids array<int>, decoded string")
