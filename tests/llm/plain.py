"""Plain Python versions of what the operators decide, from their contracts alone."""

import collections
import functools
import itertools
import math
import re
import zlib


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def bag(text):
    w = text.split()
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def similar(a, b):
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def classes(texts):
    """The least id of each text's class: equal texts, and all pairs of multisets that are similar to 0.8 or more."""
    bags = {d: bag(t) for d, t in texts.items()}
    size = {d: sum(b.values()) for d, b in bags.items()}
    parent = {d: d for d in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(texts), 2):
        small, large = sorted((size[a], size[b]))
        if texts[a] == texts[b] or (10 * small >= 8 * large and small and similar(bags[a], bags[b]) >= 0.8):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in texts}


def contaminated(texts, items):
    """The ids whose words in windows of items are a twentieth of all or more."""
    windows = collections.defaultdict(set)
    for t in items:
        w = words_of(t)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[n].add(tuple(w[i : i + n]))
    out = set()
    for d, t in texts.items():
        w, hit = words_of(t), set()
        for n, known in windows.items():
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in known:
                    hit.update(range(i, i + n))
        if hit and 20 * len(hit) >= len(w):
            out.add(d)
    return out


def kneser_ney(texts, order, start):
    """Interpolated modified Kneser-Ney over bytes, as a recursive function of a gram."""
    grams = collections.Counter()
    for t in texts:
        s = [start] * (order - 1) + list(t.encode())
        grams.update(tuple(s[i - order + 1 : i + 1]) for i in range(order - 1, len(s)))
    counts = {order: grams}
    for n in range(order - 1, 0, -1):
        counts[n] = collections.Counter(g[1:] for g in counts[n + 1])
    below = {n: collections.defaultdict(dict) for n in counts}
    for n, c in counts.items():
        for g, k in c.items():
            below[n][g[:-1]][g] = k

    def discount(n):
        k = collections.Counter(counts[n].values())
        if not all(k[i] for i in range(1, 5)):
            return 0.5, 1.0, 1.5
        y = k[1] / (k[1] + 2 * k[2])
        return tuple(min(max(i - (i + 1) * y * k[i + 1] / k[i], 0.05), i - 0.05) for i in (1, 2, 3))

    d = {n: discount(n) for n in counts}

    @functools.cache
    def left_over(n, context):
        seen = below[n].get(context, {})
        return sum(seen.values()), sum(d[n][min(c, 3) - 1] for c in seen.values())

    @functools.cache
    def p(g):
        if not g:
            return 1 / 256
        total, taken = left_over(len(g), g[:-1])
        if not total:
            return p(g[1:])
        c = counts[len(g)].get(g, 0)
        return ((c - d[len(g)][min(c, 3) - 1] if c else 0) + taken * p(g[1:])) / total

    return p


def quality(docs, good, order, start, prior, part, held_prior):
    """(perplexity, threshold, accepted) by id, of (id, text, lang); good are the trusted ids."""
    held = {d for d in good if zlib.crc32(str(d).encode()) % 5 == 0}
    p = kneser_ney([t or "" for d, t, _ in docs if d in good - held], order, start)
    nll, size = {}, {}
    for d, t, _ in docs:
        s = [start] * (order - 1) + list((t or "").encode())
        size[d] = len(s) - order + 1
        nll[d] = -sum(math.log(p(tuple(s[i - order + 1 : i + 1]))) for i in range(order - 1, len(s)))
    of = collections.defaultdict(list)
    for d, _, lang in docs:
        if d in held and size[d]:
            of[lang or ""].append(d)
    mean = lambda rows: sum(nll[d] for d in rows) / sum(size[d] for d in rows)
    bits = lambda rows, m: sorted((nll[d] + prior * m) / (size[d] + prior) for d in rows)
    q = lambda xs, at: xs[math.ceil(at * len(xs)) - 1]
    own = {x: bits(rows, mean(rows)) for x, rows in of.items()}
    apart = q(sorted(b - q(xs, 0.5) for xs in own.values() for b in xs), part)
    limits = {x: (mean(of[x]), (len(xs) * q(xs, part) + held_prior * (q(xs, 0.5) + apart)) / (len(xs) + held_prior)) for x, xs in own.items()}
    everyone = [d for rows in of.values() for d in rows]
    every = mean(everyone), q(bits(everyone, mean(everyone)), part)
    out = {}
    for d, _, lang in docs:
        m, limit = limits.get(lang or "", every)
        value = (nll[d] + prior * m) / (size[d] + prior)
        out[d] = math.exp(value), math.exp(limit), size[d] == 0 or value <= limit + 1e-9
    return out
