"""The pipeline once more, in plain Python over lists: slow, and written from the definitions."""

import collections
import math
import re
import zlib

import numpy as np
import regex
import xxhash

WORD = r"[^\x20\x09-\x0D]+"


def quality(text):
    w = re.findall(WORD, text)
    n = len(w)
    chars = sum(map(len, w))
    symbols = sum(c in "#*$%&|<>" for c in text)
    alpha = sum(any(c.isascii() and c.isalpha() or ord(c) > 127 for c in x) for x in w)
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    dup = len(lines) - len(set(lines))
    count = collections.Counter(tuple(w[i : i + 8]) for i in range(n - 7))
    cover = {j for i in range(n - 7) if count[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    fails = [n < 20, 100 * len(cover) > 30 * n, symbols * 10 > 5 * n, chars < 2 * n or chars > 20 * n, 10 * alpha < 6 * n, len(lines) >= 4 and 10 * dup > 5 * len(lines)]
    return not any(fails)


def fingerprint(text):
    w = text.encode().lower().split()
    grams = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_duplicates(docs):
    ids = sorted(docs)
    prints = {i: fingerprint(docs[i]) for i in ids}
    top = {i: i for i in ids}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return {i: docs[i] for i in ids if find(i) == i}


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]


def grams(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def decontaminate(docs, items):
    sets = [grams(t) for t in items]
    bad = lambda t: any(q and len(q & grams(t)) >= 0.8 * len(q) for q in sets)
    return {i: t for i, t in docs.items() if not bad(t)}


DOMAINS = ("high", "low", "toxic")


def runs(text):
    return [w for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w]


def features(text):
    own = runs(text)
    loud = len(regex.sub(r"[\p{Ll}\p{N} \t\n\x0B\f\r]+", "", text))
    return {*own, f" loud {8 * loud // max(len(text), 1)}", f" fresh {8 * len(set(own)) // max(len(own), 1)}"}


def telling(have, lack):
    """Weights of the features that tell the documents of ``have`` from those of ``lack``."""
    n, m = len(have), len(lack)
    if not n:
        return {}
    a, b = (collections.Counter(w for x in side for w in x) for side in (have, lack))
    out = {}
    for w, c in a.items():
        t, share = c + b[w], n / (n + m)
        z = (c - t * share) / math.sqrt(max(t * share * (1 - share), 1e-9))
        weight = math.log((c + 0.5) / (n + 1)) - math.log((b[w] + 0.5) / (m + 1))
        if c >= 3 and z >= 4 and weight >= math.log(3):
            out[w] = weight
    return out


def posteriors(texts, kind, fold):
    """texts: id -> text; kind: id -> domain and fold: id -> 0 or 1 of the labelled ones. Returns id -> [p of DOMAINS]."""
    own = {i: features(t or "") for i, t in texts.items()}
    left, out, yes = {i for i in kind if i in own}, {i: [0.0] * 3 for i in own}, {i: 1.0 for i in own}
    if not left:
        return {i: [1 / 3] * 3 for i in own}
    for k, step in ((2, "toxic"), (1, "low")):
        def model(ids):
            a, b = [[own[i] for i in ids if (kind[i] == step) == side] for side in (True, False)]
            return (telling(a, b), 1) if len(a) <= len(b) else (telling(b, a), -1)

        place = lambda i, m: min(int(max([m[w] for w in own[i] if w in m], default=0.0) / 0.75), 13)
        halves = [model([i for i in left if fold[i] != f])[0] for f in range(4)]
        whole, sign = model(left)
        hits, all_ = [0] * 14, [0] * 14
        for i in left:
            at = place(i, halves[fold[i]])
            all_[at] += 1
            hits[at] += kind[i] == step
        a, n = sum(hits), sum(all_)
        if a in (0, n):
            curve = [float(a > 0)] * 14
        else:
            odds = [a / (n - a) * math.exp(sign * (i + 0.5) * 0.75 * (i > 0)) for i in range(14)]
            top = [h + o / (1 + o) for h, o in zip(hits, odds)]
            size = [x + 1.0 for x in all_]
            # The best monotone curve, by its min-max formula.
            mean = lambda i, j: sum(top[i : j + 1]) / sum(size[i : j + 1])
            inner, outer = (min, max) if sign > 0 else (max, min)
            curve = [outer(inner(mean(u, v) for v in range(i, 14)) for u in range(i + 1)) for i in range(14)]
        for i in own:
            p = curve[place(i, whole)]
            out[i][k], yes[i] = p * yes[i], yes[i] * (1 - p)
        left = {i for i in left if kind[i] != step}
    for i in own:
        out[i][0] = yes[i]
    return out


def rates(n, p, want, slack):
    """The minimum of sum gap**2 / B + slack * sum n (r - 1)**2 over r >= 0, by plain projected gradient in many small steps."""
    n, p, want = np.asarray(n, float), np.asarray(p, float), np.asarray(want, float)
    before = (n[:, None] * p).sum(axis=0)
    share = np.where(before > 0, 1 / np.where(before > 0, before, 1), 0)
    r = y = np.ones(len(n))
    t = 1.0
    for _ in range(20_000):
        gap = (n[:, None] * p * y[:, None]).sum(axis=0) - want
        new = np.maximum(0, y - (p @ (share * gap) + slack * (y - 1)) / (1 + slack))
        after = (1 + math.sqrt(1 + 4 * t * t)) / 2
        y, r, t = new + (t - 1) / after * (new - r), new, after
    return r


def tokens(docs, encode):
    out, start = [], 0
    for i in sorted(docs):
        ids = encode(docs[i]) + [0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out
