"""Plain versions of the corpus operators, for small fixtures."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import xxhash

WHITE_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WHITE_WORD.findall(text or "")


def lower_ascii(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def simhash(text):
    own = words(lower_ascii(text))
    if not own:
        return 0
    shingles = [" ".join(own[i:i + 4]) for i in range(max(1, len(own) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_duplicates(rows, radius=4):
    """{(doc_id, fingerprint, component_id)} as a sorted list; ``rows`` are (doc_id, text)."""
    prints = [simhash(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(d)
    lowest = {r: min((d for d in own if d is not None), default=None) for r, own in ids.items()}
    return [(d, f"{p:016x}", lowest[find(i)]) for i, ((d, _), p) in enumerate(zip(rows, prints))]


def removed(rows, length=50):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of (doc_id, text)."""
    rows = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in rows:
        for k in range(len(b) - length + 1 if i is not None else 0):
            w = b[k:k + length]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, b in rows:
        gone = [False] * len(b)
        for k in range(len(b) - length + 1 if i is not None else 0):
            if first[b[k:k + length]] < i:
                gone[k:k + length] = [True] * length
        spans = sum(gone[k] and (k == 0 or not gone[k - 1]) for k in range(len(b)))
        left = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


CODE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(docs, items, size=13):
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    windows = {}
    for item, text in items:
        own = CODE_WORD.findall(lower_ascii(text))
        for k in range(max(1, len(own) - size + 1) if own else 0):
            windows.setdefault(tuple(own[k:k + size]), set()).add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for d, text in docs:
        own, hit, found = CODE_WORD.findall(lower_ascii(text)), set(), set()
        for k in range(len(own)):
            for n in sizes:
                if tuple(own[k:k + n]) in windows and k + n <= len(own):
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(own[k:k + n])]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((d, len(own), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(own)))
    return out


def base_counts(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    own = words(text)
    lines = [line for line in (text or "").split("\n") if words(line)]
    windows = Counter(tuple(own[i:i + 5]) for i in range(len(own) - 4))
    covered = {k for i in range(len(own) - 4) if windows[tuple(own[i:i + 5])] > 1 for k in range(i, i + 5)}
    failed = len(own) < 10 or 100 * len(covered) > 20 * len(own)
    return (len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)),
            len(covered), failed)


def ratio_scores(rows, trusted, buckets, grams=(1,)):
    """Mean log-likelihood ratio of each (doc_id, text), None without words."""
    def features(text):
        hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words(text)]
        out = []
        for n in grams:
            for i in range(len(hashes) - n + 1):
                h = hashes[i]
                if n > 1:
                    h = 42
                    for x in hashes[i:i + n]:
                        h = xxhash.xxh64_intdigest(x.to_bytes(8, "little"), h)
                out.append((h - 2 ** 64 if h >= 2 ** 63 else h) % buckets)
        return out

    raw, good = Counter(), Counter()
    for d, t in rows:
        raw.update(features(t))
        if d is not None and d in trusted:
            good.update(features(t))
    n_raw, n_good = sum(raw.values()) + buckets, sum(good.values()) + buckets
    weight = lambda b: math.log((good[b] + 1) / n_good) - math.log((raw[b] + 1) / n_raw)
    return [np.mean([weight(b) for b in f]) if (f := features(t)) else None for _, t in rows]


def distinct_scores(rows, trusted, buckets):
    """The same with each distinct text counted once, as trusted where one of its copies is."""
    good = {t for d, t in rows if d in trusted}
    once = list({t: (-1 if t in good else None, t) for _, t in rows}.values())
    score = {t: s for (_, t), s in zip(once, ratio_scores(once, {-1}, buckets))}
    return [score[t] for _, t in rows]


def token_rows(rows, encode, end=1):
    """(doc_id, start, n_tokens, ids_crc32) in ascending doc_id order."""
    out, start = [], 0
    for d, text in rows:
        ids = [*encode(text or ""), end]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def licenses(rows, templates, share=0.8):
    """{(doc_id, license)} by sliding over whole texts: stretches as long as the template, compared by shingles."""
    def shingles(text):
        own = [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]
        return [tuple(own[i:i + 5]) for i in range(len(own) - 4)]

    known = [(name, set(shingles(t)), len(shingles(t))) for name, t in templates]
    apart = [[wanted - other for of, other, _ in known if of != name and share <= len(wanted & other) / len(wanted) < 1]
             for name, wanted, _ in known]
    out = set()
    for d, text in rows:
        own = shingles(text)
        every = set(own)
        for (name, wanted, n), differences in zip(known, apart):
            if len(wanted & every) < share * len(wanted):
                continue
            for k in range(max(1, len(own) - n + 1)):
                part = set(own[k:k + n])
                if len(wanted & part) >= share * len(wanted) and all(x & part for x in differences):
                    out.add((d, name))
                    break
    return out


def runs(own, least=24, times=3):
    """(start, length, period) of all runs of a list of words, by trying every period."""
    found = {}
    for q in range(1, len(own) // times + 1):
        i = 0
        while i + q < len(own):
            if own[i] != own[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(own) and own[j] == own[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)
            i = j
    return sorted((s, n, q) for (s, n), q in found.items())


def periodic(rows):
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256)."""
    out = []
    for d, text in rows:
        own = words(text)
        h = zlib.crc32(str(d).encode()) if d is not None else 1
        if h % 10 == 0 and own:
            n, g = len(own), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            own = [own[i] if i < a else own[a + (i - a) % p] for i in range(n)]
        found = runs(own)
        best = min(found, key=lambda r: (Fraction(-r[1], r[2]), r[0], r[2]), default=(None,) * 3)
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        left = " ".join(w for i, w in enumerate(own) if i not in gone)
        out.append((d, len(found), *best, 1000 * best[1] // best[2] if found else None,
                    hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest()))
    return out


def spelling_counts(rows, signs=6, times=5):
    """{word: n} of (doc_id, text), one in 199 distinct runs of a document with a code point less."""
    counts = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower_ascii(run)
            h = zlib.crc32(f"{d}:{run}".encode()) if d is not None else 1
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= signs and n >= times}


def near(a, b):
    """One inserted, deleted or replaced sign turns one word into the other."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def spelling(counts, times=5):
    """(word, form, root, n, n_near, form_n) by comparing every pair of words."""
    forms, lines = {}, {}
    for w, n in counts.items():
        close = [v for v in counts if near(w, v)]
        best = min(close, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best is not None and counts[best] >= times * n else None
        lines[w] = (n, len(close))
    out = []
    for w, (n, n_near) in lines.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, forms[w], root, n, n_near, counts.get(forms[w])))
    return out
