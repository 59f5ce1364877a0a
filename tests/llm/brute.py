"""Plain versions of the operators, for small fixtures."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

SPACE = b" \t\n\x0b\x0c\r"


def word_list(text):
    return (text or "").encode().lower().split()


def simhash(text):
    words = word_list(text)
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hs) > len(hs))


def groups(links, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def near(prints, radius=3):
    ids = sorted(prints)
    return groups([(a, b) for i, a in enumerate(ids) for b in ids[:i] if any((x ^ y).bit_count() <= radius for x, y in zip(prints[a], prints[b]))], ids)


def topk(rows, k=10):
    use = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            use[i] = [math.floor(1024 * x) for x in v]
    out = []
    for q in use:
        if q % 100 == 0:
            s = sorted((-sum(a * b for a, b in zip(use[q], use[i])), i) for i in use if i != q)[:k]
            out += [(q, r, i, -x) for r, (x, i) in enumerate(s, 1)]
    return sorted(out)


def fingerprint(text, samples=32):
    words = text.strip(" \t\n\x0b\x0c\r")
    import re

    words = re.split(r"[\x20\x09-\x0D]+", words)
    runs = [words[i : i + 5] for i in range(len(words) - 4)] if len(words) >= 5 else [(words + [""] * 5)[:5]]
    weights = Counter()
    for r in runs:
        h = 42
        for w in r:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        weights[h] += 1
    out = []
    for k in range(samples):
        best = None
        for term, w in weights.items():
            h1, h2 = (xxhash.xxh64_intdigest(n.to_bytes(4, "little"), xxhash.xxh64_intdigest(term.to_bytes(8, "little"), 42)) for n in (2 * k, 2 * k + 1))
            bits = lambda h, at: ((h >> at & (1 << 21) - 1) + 0.5) / (1 << 21)
            r = -math.log(bits(h1, 43) * bits(h1, 22))
            c = math.log(-math.log(bits(h1, 0) * bits(h2, 43)))
            b = bits(h2, 22)
            t = math.floor(math.log(w) / r + b)
            a = math.floor((c - r * (t + 1.0 - b) + 100.0) * 16777216.0)
            name = (h2 ^ (t * 0x9E3779B1)) & 0xFFFFFFFF
            if best is None or (a, name) < best:
                best = (a, name)
        out.append(best[1])
    return "".join(f"{x:08x}" for x in out)


def spans(docs, least=16):
    """docs: (id, text) in any order. Returns kept texts by id: of all runs of two sentences and `least` words or more, those whose first occurrence (by id, then place) is another one go, unless they overlap it."""
    from heddle.llm.spans import sentences

    cut = {i: sentences(t or "") for i, t in docs}
    runs = {}
    for i, (parts, sizes, hashes) in cut.items():
        n = len(parts)
        runs[i] = []
        for a in range(n):
            for b in range(a + 2, n + 1):
                words = sum(sizes[a:b])
                if words >= least:
                    runs[i].append((a, b, hashes[8 * a : 8 * b]))
                if words > least + 40:  # longer runs are made of these
                    break
    first = {}
    for i in sorted(runs):
        for a, b, h in runs[i]:
            first.setdefault(h, (i, b))
    kept = {}
    for i, own in runs.items():
        gone = set()
        for a, b, h in own:
            if first[h][0] != i or a >= first[h][1]:
                gone |= set(range(a, b))
        kept[i] = "".join(p for n, p in enumerate(cut[i][0]) if n not in gone)
    return kept


def mixing(docs):
    """(id, source, size) -> copies, by following the rule document by document."""
    from hashlib import md5

    size = defaultdict(int)
    for _, s, n in docs:
        size[s] += n
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + ([None] if None in size else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left = {}, float(sum(size.values()))
    free = set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if 3 * size[s] <= level * weight[s]}
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        for s in full:
            target[s] = 3.0 * size[s]
            left -= 3 * size[s]
        free -= full
    out = {}
    for s in order:
        u = int(md5((("n" if s is None else "s" + s) + "|0").encode()).hexdigest()[:6], 16) / (1 << 24)
        rate = target[s] / size[s] if size[s] else 0
        own = sorted((n, i) for i, t, n in docs if t == s)
        for k, (n, i) in enumerate(own, 1):
            out[i] = min(3, math.floor(k * rate + u) - math.floor((k - 1) * rate + u))
    return out, {s: target[s] for s in order}, dict(size)


def remainder(i, mod):
    return zlib.crc32(str(i).encode()) % mod


def auc(score, label):
    score, label = np.array(score), np.array(label)
    rank = np.empty(len(score))
    rank[np.argsort(score, kind="stable")] = np.arange(len(score))
    n = label.sum()
    return (rank[label == 1].mean() - (n - 1) / 2) / (len(label) - n)
