"""Plain versions of the operators."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

WORD = re.compile("[0-9a-z\x80-\U0010ffff]+")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def edit_distance(x: list, y: list) -> int:
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]


def near_groups(docs: dict[int, str | None], similarity: float) -> dict[int, int]:
    """Each document's group, by all pairs; only groups of two or more."""
    own = {i: words(t) for i, t in docs.items() if i is not None and words(t)}
    root = {i: i for i in own}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(own)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            longest = max(len(own[i]), len(own[j]))
            if edit_distance(own[i], own[j]) <= math.floor((1 - similarity) * longest + 1e-9):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    groups = {i: find(i) for i in ids}
    size = Counter(groups.values())
    return {i: g for i, g in groups.items() if size[g] > 1}


def repeated_lines(docs: list[tuple[int, str | None]], num: int = 4, den: int = 5) -> set[tuple[int, int]]:
    lines = sorted((i, n, frozenset(words(line))) for i, t in docs if t is not None for n, line in enumerate(t.split("\n")) if words(line))
    out = set()
    for k, (i, n, s) in enumerate(lines):
        for j, m, r in lines[:k]:
            if (j, m) != (i, n) and len(s & r) * den >= num * len(s | r):
                out.add((i, n))
                break
    return out


def spans(docs: dict[int, str | None], items: dict[int, str | None], least: int) -> set[tuple]:
    """Maximal shared token runs of at least so many tokens."""
    out = set()
    for d, text in docs.items():
        x = words(text)
        for b, other in items.items():
            y = words(other)
            for i in range(len(x)):
                for j in range(len(y)):
                    if x[i] == y[j] and (not i or not j or x[i - 1] != y[j - 1]):
                        n = 0
                        while i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n]:
                            n += 1
                        if n >= least:
                            out.add((d, b, i, j, n))
    return out


def code_lengths(texts: list[bytes], half: list[int], order: int) -> list[float]:
    """PPM with escapes of method C and exclusion; each half by the other's counts."""
    counts = [defaultdict(Counter), defaultdict(Counter)]
    for text, h in zip(texts, half):
        padded = bytes(order) + text
        for at in range(order, len(padded)):
            for k in range(order + 1):
                counts[h][padded[at - k : at]][padded[at]] += 1
    out = []
    for text, h in zip(texts, half):
        padded, bits = bytes(order) + text, 0.0
        for at in range(order, len(padded)):
            excluded: set[int] = set()
            for k in range(order, -1, -1):
                seen = {s: n for s, n in counts[1 - h].get(padded[at - k : at], {}).items() if s not in excluded}
                if not seen:
                    continue
                total, kinds = sum(seen.values()), len(seen)
                if padded[at] in seen:
                    bits += math.log2((total + kinds) / seen[padded[at]])
                    break
                bits += math.log2((total + kinds) / kinds)
                excluded |= set(seen)
            else:
                bits += math.log2(256 - len(excluded))
        out.append(bits)
    return out


def chain(rows: list, labels: dict, trained: dict, model) -> list[list[float]]:
    """Probabilities of a chain of classifiers for the rows (id, text), on dense matrices. labels: id -> values, None where unknown; trained: id -> the text that trains."""
    import numpy as np
    import pyarrow as pa

    def features(text: str | None) -> set[int]:
        if not text:
            return set()
        return set(model.features(pa.array([text]))[1].tolist())

    def sigmoid(z):
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def logit(p):
        p = np.clip(p, 1e-4, 1 - 1e-4)
        return np.log(p / (1 - p))

    ids = sorted(trained)
    own = [features(trained[i]) for i in ids]
    names = sorted(set().union(*own))
    x = np.array([[float(f in s) for f in names] for s in own])
    other = np.array([[float(f in s) for f in names] for s in (features(t) for _, t in rows)])
    y = np.array([[np.nan if v is None else float(v) for v in labels[i]] for i in ids])
    fold = (model.K.mix(np.array(ids, np.uint64)) % np.uint64(model.FOLDS)).astype(int)

    def fit(on, earlier, t):
        a, e, t = x[on], earlier[on], t[on]
        n, share = len(t), (t.sum() + 1) / (len(t) + 2)
        if not n or t.min() == t.max():
            return np.zeros(len(names)), np.zeros(e.shape[1]), float(logit(np.array([share]))[0])
        df, pull = a.sum(axis=0), a.T @ (t - t.mean())
        with np.errstate(divide="ignore", invalid="ignore"):
            z = np.where(df >= model.RARE, np.abs(pull) / np.sqrt(df * (1 - df / (n + 1))), 0)
        chosen = np.sort(np.argsort(-z, kind="stable")[: model.FEATURES])
        chosen = chosen[z[chosen] > 0]
        design = np.hstack([a[:, chosen], e, np.ones((n, 1))])
        m = len(chosen)
        weight = np.where(t > 0, np.sqrt((n - t.sum()) / t.sum()), 1.0)
        weight *= n / weight.sum()
        v = np.ones(design.shape[1])
        for _ in range(15):
            v = design.T @ (weight * (design @ v)) / n
            size = np.linalg.norm(v)
            v /= size
        step = 1 / (0.25 * size * 1.05 + 1e-9)
        w = np.zeros(design.shape[1])
        w[-1] = np.log(share / (1 - share))
        ahead, s = w.copy(), 1.0
        for _ in range(model.STEPS):
            g = ahead - step * (design.T @ (weight * (sigmoid(design @ ahead) - t)) / n)
            new = g.copy()
            new[:m] = np.sign(g[:m]) * np.maximum(np.abs(g[:m]) - step * model.L1, 0)
            u = (1 + np.sqrt(1 + 4 * s * s)) / 2
            ahead, w, s = new + (s - 1) / u * (new - w), new, u
        words_ = np.zeros(len(names))
        words_[chosen] = w[:m]
        return words_, w[m:-1], w[-1]

    def predict(found, a, e):
        return sigmoid(a @ found[0] + e @ found[1] + found[2])

    earlier, before = np.zeros((len(ids), 0)), np.zeros((len(rows), 0))
    out = []
    for t in y.T:
        known = ~np.isnan(t)
        whole = fit(known, earlier, t)
        p = predict(whole, x, earlier)
        for f in range(model.FOLDS):
            held = known & (fold == f)
            if held.any() and (known & ~held).any():
                p[held] = predict(fit(known & ~held, earlier, t), x, earlier)[held]
        out.append(predict(whole, other, before))
        earlier, before = np.column_stack([earlier, logit(p)]), np.column_stack([before, logit(out[-1])])
    return np.array(out).T.tolist()
