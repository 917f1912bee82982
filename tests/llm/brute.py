"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash


class Sets:
    """Union-find with the least member as root."""

    def __init__(self):
        self.parent = {}

    def root(self, x):
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def repeats(texts, length):
    """texts: list of bytes -> (removed mask as list of spans, kept bytes) for each."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        covered = np.zeros(len(t) + 1, dtype=int)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                covered[i] += 1
                covered[i + length] -= 1
        mask = np.cumsum(covered)[: len(t)] > 0
        edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(int), [0]])))
        spans = [tuple(x) for x in edges.reshape(-1, 2).tolist()]
        out.append((spans, bytes(b for b, m in zip(t, mask) if not m)))
    return out


def fingerprint(text):
    found = words(text)
    if not found:
        return 0
    shingles = [" ".join(found[i : i + 4]) for i in range(len(found) - 3)] or [" ".join(found)]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode("utf-8"), 42)
        for i in range(64):
            counts[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * counts[i] > len(shingles))


def base_scores(rows):
    """rows: (key, text, learn) -> list of (n_tokens, n_known, N, score)."""
    counts = Counter(t for _, text, learn in rows if learn for t in [*words(text), None])
    total, distinct = sum(counts.values()), len(counts)
    out = []
    for _, text, _ in rows:
        tokens = [*words(text), None]
        score = sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in tokens)
        out.append((len(tokens), sum(counts[t] > 0 for t in tokens), total, score))
    return out


def tree_scores(rows, depth, least, discount=0.75, cost=0.5):
    """rows: (key, text, learn) -> score of each by a plain suffix tree: dictionaries of whole sequences."""
    texts = [[*words(text), None] for _, text, _ in rows]
    counts = Counter()
    for tokens, (_, _, learn) in zip(texts, rows):
        if learn:
            counts.update(tuple(tokens[i : i + k]) for k in range(1, depth + 2) for i in range(len(tokens) - k + 1))
    total = sum(n for s, n in counts.items() if len(s) == 1)
    distinct = sum(len(s) == 1 for s in counts)
    follow = defaultdict(dict)
    for s, n in counts.items():
        if len(s) > 1 and n >= least:
            follow[s[:-1]][s[-1]] = n
    kept = {}

    def p(context, symbol):
        if not context:
            return (counts[(symbol,)] + 1) / (total + distinct + 1)
        lower = p(context[1:], symbol)
        if context not in kept:
            return lower
        return max(follow[context].get(symbol, 0) - discount, 0) / counts[context] + kept[context] * lower

    for d in range(1, depth + 1):
        found = {}
        for context, entries in follow.items():
            if len(context) == d:
                size, stored, mass = counts[context], sum(entries.values()), sum(p(context[1:], s) for s in entries)
                gain = sum(n * math.log(n / size / p(context[1:], s)) for s, n in entries.items())
                rest = size - stored
                if rest > 0 and mass < 1:
                    gain += rest * math.log(rest / size / (1 - mass))
                if gain >= cost * len(entries) * math.log(size + 1):
                    found[context] = (rest + discount * len(entries)) / size
        kept.update(found)
        if not found:
            break
    return [sum(math.log10(p(tuple(tokens[max(i - depth, 0) : i]), s)) for i, s in enumerate(tokens)) for tokens in texts]


def similar_groups(texts, width=5, similarity=0.8):
    """Number of the group of each text, by Jaccard similarity of all pairs' shingles."""
    sets, groups = [], Sets()
    for text in texts:
        found = words(text)
        sets.append(frozenset(" ".join(found[i : i + width]) for i in range(max(len(found) - width + 1, min(len(found), 1)))))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b) if min(len(a), len(b)) >= similarity * max(len(a), len(b)) else -1
            if both >= similarity * (len(a) + len(b) - both):
                groups.join(i, j)
    return [groups.root(i) for i in range(len(texts))]


def discriminant(stats, labels, shrink, ridge):
    """Scores of a quadratic discriminant by the formula: densities with the shrunk covariances' own inverses."""
    x = np.array(stats)
    learnt = [x[[i for i, y in enumerate(labels) if y == k]] for k in (0, 1)]
    own = [np.cov(c.T, bias=True) for c in learnt]
    pooled = sum(len(c) * v for c, v in zip(learnt, own)) / sum(map(len, learnt))
    density = []
    for rows, cov in zip(learnt, own):
        cov = (1 - ridge) * ((1 - shrink) * cov + shrink * pooled) + ridge * np.diag(np.diag(pooled)) + 1e-6 * np.eye(len(cov))
        z = x - rows.mean(axis=0)
        density.append(-0.5 * (np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z) + np.linalg.slogdet(cov)[1]))
    odds = density[1] - density[0] + math.log((len(learnt[1]) + 1) / (len(learnt[0]) + 1))
    return (1 / (1 + np.exp(-np.clip(odds, -700, 700)))).tolist()


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def grouped(rows, key):
    out = defaultdict(list)
    for r in rows:
        out[r[key]].append(r)
    return out
