"""What the operators must return, said the plain way; for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def crc(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())


def simhash(text):
    words = re.findall("[^\x20\x09-\x0D]+", lower(text))
    shingles = [" ".join(words[k:k + 4]) for k in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps, near=4):
    """The index of the smallest member of each one's component."""
    f, root = np.array(fps, dtype=np.uint64), list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i] ^ f) <= near):
            a, b = sorted((find(i), find(int(j))))
            root[b] = a
    return [find(i) for i in range(len(f))]


ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def windows(items, size=13):
    wins = defaultdict(set)
    for item, text in items:
        words = bench_words(text)
        m = min(size, len(words))
        for s in range(len(words) - m + 1 if words else 0):
            wins[tuple(words[s:s + m])].add("" if item is None else str(item))
    return wins


def bench_words(text):
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def contamination(text, wins):
    words, hit, items = bench_words(text), set(), set()
    for m in {len(w) for w in wins}:
        for p in range(len(words) - m + 1):
            if own := wins.get(tuple(words[p:p + m])):
                hit |= set(range(p, p + m))
                items |= own
    return len(words), len(hit), len(items), sha(",".join(sorted(items))), bool(hit) and 20 * len(hit) >= len(words)


def edited(text, following):
    text, following = text or "", following or ""
    k = len(text) // 2
    return text[:len(text) - k] + following[:k]


def hard_negatives(rows):
    """rows: (vec_id, label, vector or None) -> (anchor, positive, rank, negative, positive score, negative score)."""
    kept = []
    for place, (i, label, v) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((place, i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    out = []
    for place, i, label, v in kept:
        if i is None or i % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), math.inf if j is None else j, at, j, other) for at, j, other, w in kept if at != place)
        for minus, _, _, j, _ in [x for x in scored if x[4] == label][:5]:
            near = [x for x in scored if x[4] != label and 50 * -minus <= 100 * -x[0] <= 95 * -minus][:3]
            out += [(i, j, k + 1, x[3], -minus, -x[0]) for k, x in enumerate(near)]
    return out


def collocations(docs, least=30, top=2000):
    """docs: (lang, text) -> (lang, rank, phrase, a, l, r, n, score)."""
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, 5):
                f.update((lang, *words[k:k + size]) for k in range(len(words) - size + 1))
    candidates = {p: a for p, a in f.items() if a >= least and len(p) > 2}
    gone = {(p[0], *p[s:s + m]) for p, a in candidates.items() for m in range(2, len(p) - 1) for s in range(1, len(p) - m + 1)
            if 100 * a >= 80 * f[(p[0], *p[s:s + m])]}
    found = defaultdict(list)
    for (lang, *words), a in candidates.items():
        if (lang, *words) in gone:
            continue
        cuts = [(2000000 * a // (f[(lang, *words[:k])] + f[(lang, *words[k:])]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        found[lang].append((-score, -a, " ".join(words).encode(), f[(lang, *words[:k])], f[(lang, *words[k:])]))
    return [(lang, rank, p.decode(), -a, le, r, n[lang], -score)
            for lang, own in found.items() for rank, (score, a, p, le, r) in enumerate(sorted(own)[:top], 1)]


_M, _ALL = 0x9E3779B97F4A7C15, (1 << 64) - 1


def _h(text):
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace"))


def _word_runs(text, letters):
    """Where a long line is cut within: after words (letters) whose hash of three is the least within a window on both sides."""
    units = list(text) if letters else re.findall(r"\S+", text, re.A)
    ends = list(range(1, len(text) + 1)) if letters else [m.end() for m in re.finditer(r"\S+\s*", text, re.A)]
    width, least = (16, 16) if letters else (6, 32)
    hashes = [ord(u) if letters else _h(u) for u in units]
    if len(units) < 2 * width:
        return []
    rolled = []
    for k, h in enumerate(hashes):
        r = h * _M & _ALL
        for back in (1, 2):
            if k >= back:
                r = (r * _M + hashes[k - back]) & _ALL
        rolled.append((r ^ r >> 29) * 0xBF58476D1CE4E5B9 & _ALL)
    out, at = [], 0
    for k in range(width - 1, len(units) - width):
        around = rolled[max(0, k - width):k]
        if all(rolled[k] < x for x in around) and all(rolled[k] <= x for x in rolled[k + 1:k + width + 1]):
            if ends[k] - at >= least and len(text) - ends[k] >= least:
                out.append(ends[k])
                at = ends[k]
    return out


def line_chunks(text):
    """(start, end) of every chunk of lines that may be removed, said line by line."""
    lines, at = [], 0       # text, whether a line feed (or the text's end) ends it
    for m in re.finditer(r"\n+|[.!?]+ +|[。！？।]+ *", text):
        lines.append([text[at:m.end()], m[0][0] == "\n"])
        at = m.end()
    if at < len(text):
        lines.append([text[at:], True])
    if not lines:
        return []
    lines[-1][1] = True
    n, hashes = len(lines), [_h(x) for x, _ in lines]
    letters = [x.count(" ") * 20 < len(x) and not x.isascii() for x, _ in lines]
    long = [len(x) >= 100 and (len(x) >= 300 or x.count(" ") >= 49 or odd) for (x, _), odd in zip(lines, letters)]
    paragraph, last_of = [], []     # of each line: lines in its paragraph, and its last line
    for k in range(n):
        first = next((j + 1 for j in range(k - 1, -1, -1) if lines[j][1]), 0)
        last = next(j for j in range(k, n) if lines[j][1])
        paragraph.append(last - first + 1)
        last_of.append(last)
    hard = [k == n - 1 or long[k] or long[k + 1] or lines[k][1] and (paragraph[k] > 1 or paragraph[k + 1] > 1) for k in range(n)]
    lone = [k + 1 < n and (last_of[k] == k + 1 and paragraph[k] > 1) or k + 2 < n and long[k + 2] for k in range(n)]
    if any(long):
        was = list(hard)
        for k in range(n):
            if not long[k] and was[k] and (k == 0 or was[k - 1]):
                if not lines[k][1] and long[k + 1]:
                    hard[k], lone[k] = False, True
                elif k and not lines[k - 1][1] and long[k - 1]:
                    hard[k - 1], lone[k - 1] = False, True
    out, begin, first, end = [], 0, 0, 0
    for k, (line, _) in enumerate(lines):
        start, end = end, end + len(line)
        rolled = (hashes[k] + (hashes[k - 1] * _M if k else 0)) & _ALL
        soft = (rolled ^ rolled >> 32) % 2 == 0
        if long[k]:
            for stop in _word_runs(line, letters[k]):
                out.append((begin, start + stop))
                begin = start + stop
        if hard[k] or soft and k > first and end - begin >= 40 and not lone[k]:
            if long[k] or k > first and end - begin >= 32:
                out.append((begin, end))
            begin, first = end, k + 1
    return out
