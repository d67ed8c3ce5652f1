"""Encoding and decoding by byte-pair merges with word ends, by an index of pair occurrences.

A text is cut at special tokens and white space; each distinct chunk of a task is normalised and split
once, each distinct word encoded once. The new words of a slice are encoded together: every adjacent pair that has a rule
is filed under the rule's rank with all its places, the ranks are taken in ascending order, and each
merge files the two pairs it makes. As every rule outranks those that make its parts (checked when the
file is read), this is what taking the lowest pair of each word, leftmost first, gives.

Defined results: a null text is read as empty; a text without tokens has no ids and decodes to the
empty text; special tokens in a text are tokens; rows with equal ids or texts are rows of their own.
Nothing is shuffled; a slice of some two megabytes, or one text, is held at a time.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .batches import batch_of, mapped, packed, slices
from .pieces import Store

NAME = "word_bpe_49k.json"
# white space as Unicode has it; a fixed value
SPACES = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
PART = 1 << 17
LINE = 256      # chunks that are split in one call


def byte_letters() -> list[str]:
    """The letter that stands for each byte in such vocabularies: itself if printable, else the next free one from 256 on."""
    printable = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    free = iter(range(256, 512))
    return [chr(b if b in printable else next(free)) for b in range(256)]


@dataclass
class Rules:
    """What a vocabulary file says, read once on the driver; some megabytes, so it travels to tasks."""

    tokens: list[str]                   # by id
    special: dict[str, int]
    first: np.ndarray                   # id of a byte within a word, and as its end
    last: np.ndarray
    pairs: np.ndarray                   # left id << 20 | right id, sorted
    ranks: np.ndarray                   # of the sorted pairs
    parts: list[int]                    # the pair of each rank
    made: list[int]                     # what it becomes
    joined: np.ndarray                  # 65,536 flags: two bytes stand side by side in some token
    file: str = ""                      # normaliser and splitter, as the file states them


def load(path: str | None = None) -> Rules:
    with open(path or public_tokenizers.path(NAME), encoding="utf-8") as f:
        said = json.load(f)
    model, end = said["model"], said["model"]["end_of_word_suffix"] or ""
    ids = model["vocab"]
    special = {t["content"]: t["id"] for t in said["added_tokens"]}
    tokens = [""] * (1 + max([*ids.values(), *special.values()]))
    for text, i in [*ids.items(), *special.items()]:
        tokens[i] = text
    letters = byte_letters()
    first = np.array([ids[c] for c in letters], dtype=np.int32)
    last = np.array([ids[c + end] for c in letters], dtype=np.int32)
    rules = [(ids[a], ids[b], ids[a + b]) for a, b in model["merges"]]
    born = {i: -1 for i in (*first.tolist(), *last.tolist())}
    for rank, (a, b, new) in enumerate(rules):
        if a not in born or b not in born or new in born:
            raise ValueError(f"rule {rank} uses a token made by a later rule, or makes one again")
        born[new] = rank
    keys = np.array([a << 20 | b for a, b, _ in rules], dtype=np.int64)
    order = np.argsort(keys)
    joined = np.zeros(65536, dtype=bool)
    value = {c: b for b, c in enumerate(letters)}
    for text in ids:
        spelled = [value[c] for c in text.removesuffix(end)]
        for x, y in zip(spelled, spelled[1:]):
            joined[x << 8 | y] = True
    return Rules(tokens, special, first, last, keys[order], order.astype(np.int32), keys.tolist(), [n for _, _, n in rules], joined,
                 json.dumps(said | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": []}))


def sides(rules: Rules) -> tuple[dict[int, dict[int, int]], dict[int, dict[int, int]]]:
    """Ranks of the pairs, by their left id and then the right one, and the other way round."""
    left, right = {}, {}
    for rank, key in enumerate(rules.parts):
        a, b = key >> 20, key & 0xFFFFF
        left.setdefault(a, {})[b] = right.setdefault(b, {})[a] = rank
    return left, right


def merge(rules: Rules, known: tuple[dict, dict], symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Apply all rules to words that lie one after the other and end at ``ends``: the ids, and the place where each begins."""
    n = len(symbols)
    after = np.arange(1, n + 1, dtype=np.int32)
    after[ends - 1] = -1
    before = np.arange(-1, n - 1, dtype=np.int32)
    before[ends[:-1]] = -1
    if n:
        before[0] = -1
    at = np.flatnonzero(after >= 0)
    keys = symbols[at].astype(np.int64) << 20 | symbols[at + 1]
    found = np.minimum(np.searchsorted(rules.pairs, keys), len(rules.pairs) - 1)
    has = rules.pairs[found] == keys
    rank, at = rules.ranks[found[has]], at[has]
    order = np.argsort(rank, kind="stable")
    rank, at = rank[order], at[order]
    active, begins = np.unique(rank, return_index=True)
    given = dict(zip(active.tolist(), np.split(at, begins[1:])))    # rank -> places, ascending
    later: dict[int, list[int]] = {}                                # rank -> places that merges have made
    heap = active.tolist()
    # lists are faster, arrays smaller: for a giant word
    sym, nxt, prv = (x.tolist() if n <= 32 * PART else array("i", x.astype(np.int32).tobytes()) for x in (symbols, after, before))
    none: dict[int, int] = {}
    while heap:
        r = heapq.heappop(heap)
        places = given.pop(r, None)
        places = [] if places is None else places.tolist()
        if r in later:
            places += later.pop(r)
            places.sort()
        key, new = rules.parts[r], rules.made[r]
        a, b = key >> 20, key & 0xFFFFF
        before_next, after_last = known[0].get(new, none).get, known[1].get(new, none).get
        for i in places:
            j = nxt[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue        # an earlier merge took one of the two
            k = nxt[j]
            sym[i], sym[j], nxt[i] = new, -1, k
            if k >= 0:
                prv[k] = i
                q = before_next(sym[k])
                if q is not None:
                    if q in later:
                        later[q].append(i)
                    else:
                        later[q] = [i]
                        if q not in given:
                            heapq.heappush(heap, q)
            h = prv[i]
            if h >= 0:
                q = after_last(sym[h])
                if q is not None:
                    if q in later:
                        later[q].append(h)
                    else:
                        later[q] = [h]
                        if q not in given:
                            heapq.heappush(heap, q)
    result = np.array(sym, dtype=np.int32)
    stay = np.flatnonzero(result >= 0)
    return result[stay], stay


class Codec:
    """Encodes chunks and decodes ids; one for each task."""

    def __init__(self, rules: Rules):
        self.rules = rules
        self.known = sides(rules)
        self.file = Tokenizer.from_str(rules.file)
        # the splitter's pattern over lower-case ASCII; a fixed value
        self.split = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|\n|[^a-z0-9\n]+")
        self.specials = re.compile("|".join(map(re.escape, sorted(rules.special, key=len, reverse=True))) or r"(?!)")
        self.bytes_of = str.maketrans({c: chr(b) for b, c in enumerate(byte_letters())})
        self.met = Store()      # words, as chunks that differ share most of them
        self.spelled = pa.array(rules.tokens, pa.string())

    def chunks(self, texts: pa.Array) -> pa.ListArray:
        """The chunks of each text; a special token is a chunk, and is in no other. Empty ones may stand among them."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        has = pa.array(np.logical_or.reduce([pc.match_substring(texts, t).to_numpy(zero_copy_only=False) for t in self.rules.special], axis=0)
                       if self.rules.special else np.zeros(len(texts), bool))
        if pc.any(has).as_py():
            apart = [self.specials.sub(r" \g<0> ", t) for t in texts.filter(has).to_pylist()]
            texts = pc.replace_with_mask(texts, has, pa.array(apart, pa.large_string()))
        return pc.split_pattern_regex(texts, SPACES)

    def words(self, chunks: list[str]) -> tuple[list[bytes], np.ndarray]:
        """The words of all chunks, as bytes, and the chunk of each."""
        plain = [k for k, chunk in enumerate(chunks) if chunk.isascii() and chunk not in self.rules.special]
        # one search for all plain chunks; a line feed is in no chunk and stands alone
        found = self.split.findall("\n".join([chunks[k] for k in plain]).lower().encode())
        ends = np.fromiter((w == b"\n" for w in found), bool, len(found))
        owners = np.array(plain, dtype=np.int64)[np.cumsum(ends)[~ends]] if plain else np.zeros(0, np.int64)
        words = [w for w in found if w != b"\n"]
        other = [k for k, chunk in enumerate(chunks) if not chunk.isascii() and chunk not in self.rules.special]
        for start in range(0, len(other), LINE):
            # the library's own rules, over many chunks with blanks between them, which no rule crosses and no word holds
            some = other[start:start + LINE]
            normal = [self.file.normalizer.normalize_str(chunks[k]) for k in some]
            parts = self.file.pre_tokenizer.pre_tokenize_str(" ".join(normal))
            begins = np.cumsum([0] + [len(n) + 1 for n in normal[:-1]])
            places = np.fromiter((at for _, (at, _) in parts), np.int64, len(parts))
            words += [w.translate(self.bytes_of).encode("latin-1") for w, _ in parts]
            owners = np.concatenate((owners, np.array(some, dtype=np.int64)[np.searchsorted(begins, places, side="right") - 1]))
        return words, owners

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks, one after the other, and how many each has."""
        words, owners = self.words(chunks)
        distinct = list(dict.fromkeys(words))
        place = dict(zip(distinct, self.met.look_up(distinct, self.merged).tolist()))
        rows = np.fromiter((place[w] for w in words), np.int64, len(words))
        order = np.argsort(owners, kind="stable")
        ids, sizes = self.met.gather(rows[order])
        owner = np.repeat(owners[order], sizes)
        if special := {k: self.rules.special[c] for k, c in enumerate(chunks) if c in self.rules.special}:
            owner = np.concatenate((owner, np.fromiter(special, np.int64)))
            order = np.argsort(owner, kind="stable")
            ids = np.concatenate((ids, np.fromiter(special.values(), np.int32)))[order]
        return ids.astype(np.int32), np.bincount(owner, minlength=len(chunks))

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one after the other, and how many each has."""
        ids, sizes, start = [], [], 0
        while start < len(words):       # some words at a time, so that the index stays small
            stop, size = start, 0
            while stop < len(words) and (not size or size + len(words[stop]) <= PART):
                size += len(words[stop])
                stop += 1
            own, counts = self._merged(words[start:stop])
            ids.append(own)
            sizes.append(counts)
            start = stop
        return (np.concatenate(ids), np.concatenate(sizes)) if ids else (np.zeros(0, np.int32), np.zeros(0, np.int64))

    def _merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        spelled = np.frombuffer(b"".join(words), dtype=np.uint8)
        ends = np.cumsum([len(w) for w in words], dtype=np.int64)
        symbols = self.rules.first[spelled]
        symbols[ends - 1] = self.rules.last[spelled[ends - 1]]
        # words are cut where no token could join the two bytes; what is left of a giant word is merged by itself
        alone = np.flatnonzero(~self.rules.joined[spelled[:-1].astype(np.int32) << 8 | spelled[1:]]) + 1
        ids, begins = merge(self.rules, self.known, symbols, np.union1d(ends, alone))
        return ids, np.bincount(np.searchsorted(ends, begins, side="right"), minlength=len(words))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Tokens as they are spelled, a blank between two."""
        spelled = self.spelled.take(ids.flatten())
        offsets = np.concatenate(([0], np.cumsum(pc.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False))))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spelled), " ")


def _coder(rules: Rules, back: bool):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, store = Codec(rules), Store(600_000)
        for batch in slices(batches):
            lists = codec.chunks(batch.column("text"))
            coded = lists.flatten().dictionary_encode()
            rows = store.look_up(coded.dictionary.to_pylist(), codec.encode)
            ids, sizes = store.gather(rows[coded.indices.to_numpy(zero_copy_only=False)])
            ends = np.concatenate(([0], np.cumsum(sizes)))[lists.offsets.to_numpy()]
            found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            yield batch_of(batch.column("row"), ids=found, **({"decoded": codec.decode(found)} if back else {}))
    return code


def _decoder(rules: Rules):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(rules)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                yield batch_of(part.column("row"), ids=part.column("ids"), decoded=codec.decode(part.column("ids")))
    return decode


def encoded(docs: DataFrame, rules: Rules, keep: list[str]) -> DataFrame:
    """row (the columns ``keep``) and ids."""
    return mapped(packed(docs, keep), _coder(rules, False), "ids array<int>")


def decoded(rows: DataFrame, rules: Rules) -> DataFrame:
    """``rows`` (row, ids) with the text of the ids as ``decoded``."""
    return mapped(rows.select("row", "ids"), _decoder(rules), "ids array<int>, decoded string")


def there_and_back(docs: DataFrame, rules: Rules, keep: list[str]) -> DataFrame:
    """row (the columns ``keep``), ids, and the text decoded from them, in one pass."""
    return mapped(packed(docs, keep), _coder(rules, True), "ids array<int>, decoded string")
