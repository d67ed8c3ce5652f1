"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of character 1-, 2- and 3-grams, hashed into 2^16 buckets, are taken per language from a
bounded sample of labelled rows: about ``PER_LANGUAGE`` documents of each language, chosen by a
hash of the id. The matrix of log probabilities (languages x 2^16 floats) goes to every task;
its size depends on the number of languages only. Scoring gathers a row of it per n-gram and
sums the gathered values per document, in numpy, over whole texts.

Letters are lower-cased; every run of other characters is one blank. N-grams of blanks only
say nothing and count for no language.

Defined results: ``und`` with score 0 for a null text or one without a letter, and for any text
if nothing was learned; ties go to the language that sorts first. The score is the posterior
probability of the answer under equal priors. Repeated rows get equal answers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import batch_of, mapped, packed, slices

BITS = 16
PER_LANGUAGE = 4_000
TRAIN_TASKS = 8
SLICE_BYTES = 1_000_000
_KEYS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


_TABLE_END = 0x3400


def letters(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, lower-cased, each run of other than letters as one 32; where each text begins."""
    lowered = [t.lower() + "\x00" for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "replace"), dtype="<u4")
    alpha = table[np.minimum(codes, _TABLE_END)]
    if (beyond := np.flatnonzero(codes >= _TABLE_END)).size:
        kinds, inverse = np.unique(codes[beyond], return_inverse=True)
        alpha[beyond] = np.array([chr(c).isalpha() for c in kinds])[inverse]
    keep = alpha.copy()
    keep[1:] |= alpha[:-1]    # the first of a run of other characters stays, as a blank
    starts = np.cumsum([0, *map(len, lowered)])[:-1]
    keep[starts] = True       # no text is without a place of its own
    return np.where(alpha, codes, 32)[keep].astype(np.uint64), np.concatenate(([0], np.cumsum(keep)))[starts]


def gram_buckets(codes: np.ndarray, starts: np.ndarray, bits: int = BITS) -> Iterator[np.ndarray]:
    """For n = 1, 2, 3 the bucket of the n-gram that ends at each place; 0 stands for blanks only."""
    place = np.arange(len(codes)) - np.repeat(starts, np.diff(np.append(starts, len(codes))))
    mixed, seen = np.zeros(len(codes), dtype=np.uint64), np.zeros(len(codes), dtype=bool)
    for n in range(3):
        back = np.full(len(codes), 32, dtype=np.uint64)
        back[n:] = codes[:len(codes) - n]
        back[place < n] = 32
        mixed = mixed + (back + np.uint64(n + 1)) * _KEYS[n]
        seen = seen | (back != 32)
        hashed = mixed ^ (mixed >> np.uint64(29))
        hashed = (hashed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)
        yield np.where(seen, hashed | np.uint64(1), np.uint64(0)).astype(np.int64)


def alpha_table() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(_TABLE_END + 1)])


def _counter(bits: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, counts = alpha_table(), {}
        for batch in slices(batches, limit=SLICE_BYTES):
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for lang in set(langs):
                codes, starts = letters([t for t, x in zip(texts, langs) if x == lang], table)
                total = counts.setdefault(lang, np.zeros(1 << bits, dtype=np.int64))
                for buckets in gram_buckets(codes, starts, bits):
                    total += np.bincount(buckets, minlength=1 << bits)
        for lang, total in counts.items():
            total[0] = 0
            filled = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(filled), pa.string()), pa.array(filled.astype(np.int32)), pa.array(total[filled])],
                ["lang", "bucket", "n"])
    return count


def learn(labelled: DataFrame, bits: int = BITS, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """(languages in order, log probabilities language x bucket) from ``doc_id, lang, text``."""
    rows = labelled.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).toLocalIterator()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((0, 1 << bits), dtype=np.float32)
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, per_language / sizes[k])))])
    chosen = rows.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("language sample")), F.lit(1 << 20))
                        < share[F.col("lang")] * (1 << 20))
    counted = chosen.select("lang", "text").repartition(TRAIN_TASKS).mapInArrow(
        _counter(bits), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros((len(langs), 1 << bits))
    at = {k: i for i, k in enumerate(langs)}
    n[[at[k] for k in counted["lang"].to_pylist()], counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    n += 0.5
    logs = np.log(n / n.sum(axis=1, keepdims=True))
    logs[:, 0] = 0.0
    return langs, logs.astype(np.float32)


def _scorer(langs: list[str], logs: np.ndarray, bits: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = alpha_table()
        for batch in slices(batches, limit=SLICE_BYTES):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            codes, starts = letters(texts, table)
            sums = np.zeros((len(langs), len(texts)))
            for buckets in gram_buckets(codes, starts, bits):
                for i in range(len(langs)):
                    sums[i] += np.add.reduceat(logs[i].take(buckets), starts, dtype=np.float64)
            has_letter = np.add.reduceat((codes != 32).astype(np.int64), starts) > 0
            if langs:
                best = sums.argmax(axis=0)
                chance = 1.0 / np.exp(sums - sums.max(axis=0)).sum(axis=0)
                answers = [langs[b] if ok else "und" for b, ok in zip(best, has_letter)]
                scores = np.where(has_letter, chance, 0.0)
            else:
                answers, scores = ["und"] * len(texts), np.zeros(len(texts))
            yield batch_of(batch.column("row"), lang_pred=pa.array(answers, pa.string()), score=pa.array(scores))
    return score


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str], bits: int = BITS) -> DataFrame:
    """row (the columns ``keep``), lang_pred, score."""
    return mapped(packed(docs, keep), _scorer(*model, bits), "lang_pred string, score double")
