"""Secret scan: patterns, and a battery of randomness tests for what no pattern names.

Patterns give the base spans (kinds ``assign``, ``access``, ``hex``). The battery looks at every
run of 20 and more characters of one base-64 alphabet (plain or for URLs, padding aside) that
holds a digit and a letter and isn't within a base span, and at every piece of so many characters
between two of ``/``, ``-``, ``_`` and ``+``, so that a token is tested apart from a path or prefix
that it is joined to. Of overlapping ones that could be random the longest is kept. The smallest fitting encoding is inferred
(hex, base 32, 36 in one case, 62, 64), its characters are numbered, and four tests ask whether the run could
be random: chi-squared uniformity over the alphabet, Wald-Wolfowitz runs above and below its middle, the
number of runs of one kind of character (small, capital, digit, mark), and serial correlation at lag 1.
Fisher's method makes one p-value of them.

A short run that isn't rejected needn't be random, so what is reported is settled from the other side. The
null is the ordinary run: names, paths and numbers made of the corpus's own most frequent words, in the same
battery, give the share of ordinary runs that look as random, by encoding and length. With these shares the
rule of Benjamini and Hochberg over all candidates of the corpus bounds the ordinary runs among those
reported by ``RATE``, in each stratum. Below a fiftieth the share is carried on by an exponential tail. What
is reported is a span of kind ``random``. P-values are counted in bins of 1/20 of a power of ten, down to
1e-20, so that the driver sees a bounded table and not the candidates. Texts are read once for spans, which
are written to the shared folder and judged from there, and once for words, if there are candidates.

Defined results: a null text is the empty one and has no spans; spans count code points, end
exclusive; repeated rows get equal spans.
"""

from __future__ import annotations

import random
import re
from bisect import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .batches import batch_of, mapped, packed, slices

# The patterns of the base spans, with the least length of what counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_VALUE, ACCESS_ALL = 6, 20
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "random")

LEAST_RUN, RATE, BIN, LOWEST = 20, 0.05, 20, 20
VOCABULARY, MADE, TAIL = 2_000, 1_500, 0.02     # frequent words; ordinary runs made for each style and size class
LOWER, UPPER, DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
# smallest first; a run belongs to the first that holds all its characters
ENCODINGS = (("hex", DIGIT + "abcdef"), ("hex", DIGIT + "ABCDEF"), ("base32", UPPER + "234567"),
             ("base36", DIGIT + LOWER), ("base36", DIGIT + UPPER), ("base62", UPPER + LOWER + DIGIT),
             ("base64", UPPER + LOWER + DIGIT + "+/"), ("base64", UPPER + LOWER + DIGIT + "-_"))
_NUMBERED = [(name, frozenset(chars), {c: i for i, c in enumerate(chars)}) for name, chars in ENCODINGS]
# bits: 0 plain base 64, 1 lower-case hex, 2 base 64 for URLs, and letters and digits with each set of marks besides
MARKS = ("", "+", "/", "-", "_")
_RUN_CLASS = np.zeros(129, dtype=np.uint8)
for _c in LOWER + UPPER + DIGIT + "+/-_":
    for _bit, _marks in ((0, "+/"), (2, "-_"), *enumerate(MARKS, 3)):
        if _c.isalnum() or _c in _marks:
            _RUN_CLASS[ord(_c)] |= 1 << _bit
for _c in DIGIT + "abcdef":
    _RUN_CLASS[ord(_c)] |= 2
CANDIDATE = "struct<start: int, end: int, encoding: string, size: int, bin: int>"
SPAN = "struct<kind: string, start: int, end: int>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_ALL]
    return out


def runs_of(classes: np.ndarray, bit: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs that have the bit, of at least so many places."""
    has = np.concatenate(([0], (classes >> bit) & 1, [0])).astype(np.int8)
    edges = np.flatnonzero(np.diff(has))
    starts, ends = edges[::2], edges[1::2]
    keep = ends - starts >= least
    return starts[keep], ends[keep]


def battery(run: str) -> tuple[str, float] | None:
    """(encoding, combined p-value that the run is random), or None if no encoding fits."""
    chars = set(run)
    if not (chars & set(DIGIT) and chars - set(DIGIT)):
        return None
    for name, alphabet, number in _NUMBERED:
        if chars <= alphabet:
            break
    else:
        return None
    x, k, n = np.array([number[c] for c in run], dtype=np.float64), len(alphabet), len(run)
    counts = np.bincount(x.astype(np.int64), minlength=k)
    chi = (counts * counts).sum() * k / n - n
    spread = np.sqrt(2 * (k - 1) * (n - 1) / n)
    z_uniform = (chi - (k - 1)) / spread
    above = x >= k / 2
    a, b = int(above.sum()), n - int(above.sum())
    if a and b:
        mean = 2 * a * b / n + 1
        var = max((mean - 1) * (mean - 2) / (n - 1), 1e-9)
        z_runs = (1 + int((above[1:] != above[:-1]).sum()) - mean) / np.sqrt(var)
    else:
        z_runs = np.sqrt(n)      # all on one side
    shares = np.bincount([kind_of(c) for c in alphabet], minlength=4) / k
    change = 1 - (shares * shares).sum()
    kinds = np.array([kind_of(c) for c in run])
    z_kinds = ((kinds[1:] != kinds[:-1]).sum() - change * (n - 1)) / np.sqrt((n - 1) * change * (1 - change))
    centred = x - (k - 1) / 2
    z_serial = (centred[1:] * centred[:-1]).sum() / ((k * k - 1) / 12 * np.sqrt(n - 1))
    p = [upper_tail(z_uniform), min(1.0, 2 * upper_tail(abs(z_runs))), min(1.0, 2 * upper_tail(abs(z_serial))),
         min(1.0, 2 * upper_tail(abs(z_kinds)))]
    half = -sum(np.log(max(v, 1e-300)) for v in p)
    return name, float(np.exp(-half) * (1 + half + half ** 2 / 2 + half ** 3 / 6))


def upper_tail(z: float) -> float:
    from math import erfc
    return 0.5 * erfc(z / 2 ** 0.5)


def kind_of(c: str) -> int:
    return 0 if c in LOWER else 1 if c in UPPER else 2 if c in DIGIT else 3


def bin_of(p: float) -> int:
    return int(min(-np.log10(max(p, 1e-300)), LOWEST) * BIN)


def size_class(n: int) -> int:
    """0: under 32 characters, 1: under 64, 2: more."""
    return (n >= 32) + (n >= 64)


def scan(texts: list[str]) -> tuple[list[list[tuple]], list[list[tuple]]]:
    """For each text its base spans (start, kind, end), sorted, and its candidates with their bins of p."""
    joined = "\n".join(texts)
    codes = np.minimum(np.frombuffer(joined.encode("utf-32-le", "replace"), dtype="<u4"), 128)
    classes = _RUN_CLASS[codes]
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    spans, candidates = [base_spans(t) for t in texts], [[] for _ in texts]
    starts, ends = runs_of(classes, 1, 24)
    for i, s, e in zip((np.searchsorted(begins, starts, side="right") - 1).tolist(), starts.tolist(), ends.tolist()):
        spans[i].append((s - int(begins[i]), 2, e - int(begins[i])))
    for own in spans:
        own.sort()
    found = {x for bit in (0, *range(2, 3 + len(MARKS))) for x in zip(*(a.tolist() for a in runs_of(classes, bit, LEAST_RUN)))}
    places = sorted(found)
    for i, (s, e) in zip((np.searchsorted(begins, [s for s, _ in places], side="right") - 1).tolist(), places):
        if (judged := battery(joined[s:e])) is None:
            continue
        s, e = s - int(begins[i]), e - int(begins[i])
        if not any(a <= s and e <= z for a, _, z in spans[i]):
            candidates[i].append((s, e, judged[0], size_class(e - s), bin_of(judged[1])))
    return spans, candidates


def _scanner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    candidate = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("encoding", pa.string()), ("size", pa.int32()),
                           ("bin", pa.int32())])
    for batch in slices(batches, limit=1_000_000):
        spans, candidates = scan([t or "" for t in batch.column("text").to_pylist()])
        yield batch_of(
            batch.column("row"),
            spans=pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in own] for own in spans], pa.list_(span)),
            candidates=pa.array([[dict(zip(("start", "end", "encoding", "size", "bin"), c)) for c in own] for own in candidates],
                                pa.list_(candidate)))


STYLES = ("camel", "small", "capital", "path", "kebab", "snake", "uuid", "number")
SIZES = ((20, 31), (32, 63), (64, 100))     # lengths of each size class


def ordinary_run(k: int, words: list[str]) -> str:
    """The k-th made run: a name, a path, an identifier or a number, of the style and size class that go by k."""
    draw = random.Random(k)
    style, (least, most) = STYLES[k % len(STYLES)], SIZES[k // len(STYLES) % len(SIZES)]
    length, parts, size = draw.randint(least, most), [], 0

    def number() -> str:
        return str(draw.choice((draw.randrange(10), draw.randrange(100), draw.randrange(1990, 2030), draw.randrange(10 ** 6))))
    while size < length + 1:
        if style == "uuid":
            part = "%0*x" % (w := draw.choice((4, 8, 12)), draw.randrange(16 ** w))
        elif style == "number":
            part = draw.choice(("%04d%02d%02d" % (draw.randrange(1990, 2030), draw.randrange(1, 13), draw.randrange(1, 29)), "0" * draw.randrange(1, 6), number()))
        else:
            part = draw.choice(words) if words else "name"
            part = {"camel": part.capitalize(), "capital": part.upper()}.get(style, part)
            if style == "path" and draw.random() < 0.3:
                part = part.capitalize()
            if draw.random() < 0.2:
                part += number()
        parts.append(part)
        size += len(part) + 1
    run = {"path": "/", "kebab": "-", "snake": "_", "uuid": "-"}.get(style, "").join(parts)[:length]
    tail = number()
    if not set(run) & set(DIGIT):
        run = run[:length - len(tail)] + tail
    if set(run) <= set(DIGIT):
        run = draw.choice("abcdef") + run[1:]
    return run.strip("/-_")


def vocabulary(docs: DataFrame, most: int = VOCABULARY) -> list[str]:
    """The most frequent words of all texts, also those within names."""
    words = docs.select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z][a-z]{2,11}"), F.lit(0))).alias("w"))
    counts = words.groupBy(F.lower("w").alias("w")).agg(F.count("*").alias("n")).where("n > 1")
    return [r["w"] for r in counts.orderBy(F.desc("n"), "w").limit(most).collect()]


def strata_of(rows: DataFrame) -> dict[str, dict[int, int]]:
    """Counts of (encoding, size, bin) by stratum; at most 5 * 3 * 401 rows."""
    out: dict[str, dict[int, int]] = {}
    for r in rows.groupBy("encoding", "size", "bin").agg(F.count("*").alias("n")).toLocalIterator():
        out.setdefault(f"{r['encoding']} {r['size']}", {})[r["bin"]] = r["n"]
    return out


def ordinary(docs: DataFrame) -> dict[str, dict[int, int]]:
    """How random ordinary runs look: counts by stratum and bin."""
    words = vocabulary(docs)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k in batch.column("id").to_pylist():
                run = ordinary_run(k, words)
                judged = battery(run) if len(run) >= LEAST_RUN else None
                if judged:
                    rows.append((judged[0], size_class(len(run)), bin_of(judged[1])))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()),
                                              pa.array([r[2] for r in rows], pa.int32())], ["encoding", "size", "bin"])
    made = docs.sparkSession.range(0, MADE * len(STYLES) * len(SIZES), 1, 8)
    return strata_of(made.mapInArrow(judge, "encoding string, size int, bin int"))


def share_as_random(made: dict[int, int], place: int) -> float:
    """The share of ordinary runs that look as random as those of this bin, or more so; 1 if there is no ordinary run to go by."""
    total = sum(made.values())
    if not total:
        return 1.0
    bins = np.repeat(*(np.array(x) for x in zip(*sorted(made.items()))))
    edge = bins[int(TAIL * total)]
    if place >= edge:
        return float((1 + (bins <= place).sum()) / (1 + total))
    excess = max((edge - bins[bins < edge]).mean(), 1.0) if (bins < edge).any() else 1.0
    return float(TAIL * np.exp(-(edge - place) / excess))


def reported_bins(counts: dict[int, int], made: dict[int, int], rate: float = RATE) -> int:
    """The greatest bin of -log10 p such that runs in it and below are reported, by Benjamini and Hochberg; -1 if none is."""
    total, found, most = sum(counts.values()), 0, -1
    for place in sorted(counts):
        found += counts[place]
        if share_as_random(made, place) * total <= rate * found:
            most = place
    return most


def longest(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of overlapping (start, end) the longest (then the first), by falling length."""
    out: list[tuple[int, int]] = []     # sorted; none overlap
    for place in sorted(places, key=lambda x: (x[0] - x[1], x[0])):
        k = bisect(out, place)
        if (not k or out[k - 1][1] <= place[0]) and (k == len(out) or place[1] <= out[k][0]):
            out.insert(k, place)
    return out


def find_secrets(docs: DataFrame, keep: list[str], rate: float = RATE) -> DataFrame:
    """row (the columns ``keep``), base (array of kind, start, end) and spans (base and random ones, sorted)."""
    found = stored(mapped(packed(docs, keep), _scanner, f"spans array<{SPAN}>, candidates array<{CANDIDATE}>"), "secrets")
    counted = strata_of(found.select(F.explode("candidates").alias("c")).select("c.encoding", "c.size", "c.bin"))
    made = ordinary(docs) if counted else {}
    most = {k: reported_bins(counts, made.get(k, {}), rate) for k, counts in counted.items()}

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("spans").to_pylist(), batch.column("candidates").to_pylist())
            every = [own + [{"kind": "random", "start": s, "end": e} for s, e in longest(
                [(c["start"], c["end"]) for c in candidates if c["bin"] <= most[f"{c['encoding']} {c['size']}"]])] for own, candidates in rows]
            for own in every:
                own.sort(key=lambda x: (x["start"], KINDS.index(x["kind"]), x["end"]))
            yield batch_of(batch.column("row"), base=batch.column("spans"), spans=pa.array(every, batch.column("spans").type))

    return mapped(found, choose, f"base array<{SPAN}>, spans array<{SPAN}>")


def joined(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
