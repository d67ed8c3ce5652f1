"""Toxicity scores by a factorization machine over hashed terms.

Terms of a text are its lower-cased words and the first four, five and six letters of each, by
64-bit hash; a text either has a term or not. The model gives every term a weight and a vector
of ``RANK`` factors; the product of two vectors is the weight of the pair, so that two terms can
say together what neither says alone, such as an insult with the mention of a group.

Fitting uses a bounded sample: about ``PER_CLASS`` labelled rows of each label, chosen by a hash of
the id. Spark counts the terms of the sample by label. The ``TERMS`` that tell the labels apart
best by themselves (at least ``LEAST`` rows, a score of the difference of shares over ``CLEAR``) enter the
model, and the ``COMMON`` ones that vary most from row to row, whatever they say by themselves, as they may
say something in pairs. It is fitted in numpy on the rows' indexes of these terms. Its size is bounded by ``TERMS``, ``COMMON`` and
``RANK``. Scoring reads every whole text once, without a shuffle.

Defined results: several labels of one document: toxic if one says so; null labels are none; null
and empty texts have no term and get the base rate; with no labelled rows every score is 0, with
rows of one label only every score is that label. Repeated rows get equal scores.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .batches import batch_of, mapped, packed, slices

PER_CLASS, TERMS, COMMON, RANK = 5_000, 4_096, 128, 8
LEAST, CLEAR, PREFIXES = 3, 5.0, (4, 5, 6)
HELD = 100.0
TRAIN_TASKS = 8
KNOWN_WORDS = 150_000
_WORD = re.compile(r"[^\W\d_]+")


def terms_of(token: str) -> list[int]:
    """Hashed terms of one lower-cased, blank-separated token."""
    out = []
    for word in _WORD.findall(token):
        out.append(xxhash.xxh64_intdigest("w " + word))
        out += [xxhash.xxh64_intdigest(f"{n} {word[:n]}") for n in PREFIXES if len(word) >= n]
    return out


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(document, index of the distinct token) of each token, and the distinct tokens."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(texts.fill_null("").cast(pa.large_string())))
    offsets = lists.offsets.to_numpy()
    coded = lists.flatten().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    docs = np.repeat(np.arange(len(texts)), np.diff(offsets))
    return docs, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each term the rows with either label, for one task's share of the sample."""
    for batch in slices(batches, limit=1_000_000):
        docs, index, tokens = tokens_of(batch.column("text"))
        toxic = np.array(batch.column("toxic").to_pylist(), dtype=np.int64)
        own = [terms_of(t) for t in tokens]
        sizes = np.array([len(x) for x in own], dtype=np.int64)
        flat = np.array([h for x in own for h in x], dtype=np.uint64)
        distinct, number = np.unique(flat, return_inverse=True)
        begin = np.cumsum(sizes) - sizes
        pairs = np.unique(docs * len(tokens) + index)
        docs, index = pairs // max(len(tokens), 1), pairs % max(len(tokens), 1)
        n = sizes[index]
        where = np.repeat(begin[index] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        pairs = np.unique(np.repeat(docs, n) * max(len(distinct), 1) + number[where])
        docs, term = pairs // max(len(distinct), 1), pairs % max(len(distinct), 1)
        every = np.bincount(term, minlength=len(distinct))
        bad = np.bincount(term, weights=toxic[docs], minlength=len(distinct)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(bad), pa.array(every - bad)],
                                         ["term", "toxic", "clean"])


class Terms:
    """Indexes of the chosen terms in texts; keeps what it knows of a bounded number of tokens."""

    def __init__(self, chosen: np.ndarray):
        self.index = {int(h): k for k, h in enumerate(chosen.view(np.uint64))}
        self.known: dict[str, tuple[int, ...]] = {}

    def of(self, token: str) -> tuple[int, ...]:
        if (found := self.known.get(token)) is None:
            if len(self.known) >= KNOWN_WORDS:
                self.known.clear()
            found = self.known[token] = tuple({self.index[h] for h in terms_of(token) if h in self.index})
        return found

    def pairs(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(document, chosen term) once for each, sorted."""
        docs, index, tokens = tokens_of(texts)
        own = [self.of(t) for t in tokens]
        sizes = np.array([len(x) for x in own], dtype=np.int64)
        flat = np.array([k for x in own for k in x], dtype=np.int64)
        begin = np.cumsum(sizes) - sizes
        hit = sizes[index] > 0 if len(index) else np.zeros(0, dtype=bool)
        docs, index = docs[hit], index[hit]
        n = sizes[index]
        where = np.repeat(begin[index] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        width = max(len(self.index), 1)
        pairs = np.unique(np.repeat(docs, n) * width + flat[where])
        return pairs // width, pairs % width


def _index(chosen: np.ndarray):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(chosen)
        for batch in slices(batches):
            docs, term = terms.pairs(batch.column("text"))
            ends = np.searchsorted(docs, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(term, pa.int32()))],
                ["toxic", "terms"])
    return index


def machine(docs: np.ndarray, term: np.ndarray, n: int, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """(log odds, sums of factors) of ``n`` texts with the given (document, term) pairs."""
    linear = np.bincount(docs, weights=model["w"][term], minlength=n)
    sums = np.stack([np.bincount(docs, weights=model["v"][term, k], minlength=n) for k in range(model["v"].shape[1])], axis=1)
    squares = np.bincount(docs, weights=(model["v"] ** 2).sum(axis=1)[term], minlength=n)
    return model["w0"] + linear + 0.5 * ((sums * sums).sum(axis=1) - squares), sums


def fit(docs: np.ndarray, term: np.ndarray, label: np.ndarray, terms: int, rank: int = RANK, steps: int = 300,
        rate: float = 0.05, decay: float = 2e-5, pair_decay: float = 1e-4, held: np.ndarray | float = 1.0) -> dict:
    """Logistic loss by Adam over the whole sample; equal in every run. ``held`` times the decay holds for each term."""
    n = len(label)
    model = {"w0": np.zeros(1), "w": np.zeros(terms), "v": np.random.default_rng(7).normal(0, 0.05, (terms, rank))}
    first = {k: np.zeros_like(x) for k, x in model.items()}
    second = {k: np.zeros_like(x) for k, x in model.items()}
    for step in range(1, steps + 1):
        odds, sums = machine(docs, term, n, model)
        error = (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - label) / n
        per_pair = error[docs]
        own = np.bincount(term, weights=per_pair, minlength=terms)
        pull = np.stack([np.bincount(term, weights=per_pair * sums[docs, k], minlength=terms) for k in range(rank)], axis=1)
        slope = {"w0": np.array([error.sum()]), "w": own + decay * held * model["w"],
                 "v": pull - own[:, None] * model["v"] + pair_decay * np.reshape(held, (-1, 1)) * model["v"]}
        for k in model:
            first[k] = 0.9 * first[k] + 0.1 * slope[k]
            second[k] = 0.999 * second[k] + 0.001 * slope[k] ** 2
            model[k] = model[k] - rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    return model


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> dict:
    """The model, from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}    # two rows
    if not sizes.get(0) or not sizes.get(1):
        return {"constant": float(bool(sizes.get(1)))}
    share = F.when(F.col("toxic") == 1, min(1.0, per_class / sizes[1])).otherwise(min(1.0, per_class / sizes[0]))
    chosen = marks.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity sample")), F.lit(1 << 20)) < share * (1 << 20))
    # about 2 * per_class rows of an id and a label, whatever the input
    sample = stored(docs.select("doc_id", F.col("text")).join(F.broadcast(chosen), "doc_id").select("toxic", "text").repartition(TRAIN_TASKS), "sample")
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return {"constant": float(sizes[1] >= sizes[0])}
    counted = sample.mapInArrow(_count, "term long, toxic long, clean long").groupBy("term").agg(
        F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    rate = (F.col("t") + F.col("c")) / (n[0] + n[1])
    clear = F.abs(F.col("t") / n[1] - F.col("c") / n[0]) / F.sqrt(rate * (1 - rate + 1e-6) * (1 / n[0] + 1 / n[1]))
    counted = stored(counted.where(F.col("t") + F.col("c") >= LEAST), "terms")
    telling = counted.withColumn("clear", clear).where(F.col("clear") >= CLEAR).orderBy(F.desc("clear"), "term").limit(TERMS).select("term")
    # in most rows, but not in all: what varies most
    common = counted.orderBy(F.desc(rate * (1 - rate)), "term").limit(COMMON).select("term")
    telling, common = (t.toArrow()["term"].to_numpy() for t in (telling, common))
    best = np.unique(np.concatenate((telling, common)))
    rows = sample.mapInArrow(_index(best), "toxic int, terms array<int>").toArrow()
    lists = rows["terms"].combine_chunks()
    label = rows["toxic"].to_numpy().astype(np.float64)
    docs_of = np.repeat(np.arange(len(label)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    term = lists.flatten().to_numpy()
    # what tells nothing by itself must earn its weight
    model = fit(docs_of, term, label, max(len(best), 1), held=np.where(np.isin(best, telling), 1.0, HELD) if len(best) else 1.0)
    # the sample has more toxic rows than the labels have
    model["w0"] = model["w0"] + np.log(sizes[1] / sizes[0]) - np.log(n[1] / n[0])
    return model | {"chosen": best}


def _scorer(model: dict):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = None if "constant" in model else Terms(model["chosen"])
        for batch in slices(batches):
            if terms is None:
                scores = np.full(batch.num_rows, model["constant"])
            else:
                odds, _ = machine(*terms.pairs(batch.column("text")), batch.num_rows, model)
                scores = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            yield batch_of(batch.column("row"), score=pa.array(scores))
    return score


def scored(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """row (the columns ``keep``) and score."""
    return mapped(packed(docs, keep), _scorer(model), "score double")
