"""Warping, similarities and matching in plain loops, written apart from the library."""

import math
from collections import Counter


def table(x, y, cells=None):
    """{(i, j): (sum, cell before)} over the given cells, and the cheapest path."""
    n, m = len(x), len(y)
    cells = cells or [(i, j) for i in range(n) for j in range(m)]
    cost, none = {(0, 0): (0.0, None)}, (math.inf, None)
    for i, j in ((i + 1, j + 1) for i, j in sorted(cells)):
        best = min(((cost.get(c, none)[0], c) for c in ((i - 1, j), (i, j - 1), (i - 1, j - 1))), key=lambda b: b[0])
        cost[i, j] = (best[0] + abs(x[i - 1] - y[j - 1]), best[1])
    path, at = [], (n, m)
    while at != (0, 0):
        path.append((at[0] - 1, at[1] - 1))
        at = cost[at][1]
    return cost[n, m][0], path


def warped(x, y, radius=1):
    def fast(x, y):
        if min(len(x), len(y)) < radius + 2:
            return table(x, y)
        half = lambda v: [(v[i] + v[i + 1]) / 2 for i in range(0, len(v) - 1, 2)]
        near = {(i + a, j + b) for i, j in fast(half(x), half(y))[1] for a in range(-radius, radius + 1) for b in range(-radius, radius + 1)}
        return table(x, y, [(2 * i + a, 2 * j + b) for i, j in near for a in (0, 1) for b in (0, 1) if 0 <= 2 * i + a < len(x) and 0 <= 2 * j + b < len(y)])

    return fast(list(x), list(y))[0]


def distance(x, y):
    if len(x) != len(y):
        return warped(x, y)
    gaps = [abs(a - b) for a, b in zip(x, y, strict=True)]
    return sum(gaps) if sum(gaps) > 0.1 else math.sqrt(sum(g * g for g in gaps))


def normalised(v):
    m = sum(v) / len(v)
    d = math.sqrt(sum((x - m) ** 2 for x in v) / len(v))
    return [(x - m) / (d + 1e-8) for x in v]


def cosine(x, y):
    norm = math.sqrt(sum(a * a for a in x)) * math.sqrt(sum(b * b for b in y))
    return sum(a * b for a, b in zip(x, y, strict=True)) / norm if norm > 1e-12 else None


def multi_metric(x, y):
    n = min(len(x), len(y))
    r = n / max(len(x), len(y))
    w = [0.3 * (1.1 if r > 0.8 else 1), 0.3 * (1.2 if r < 0.5 else 1), 0.2 * (1.1 if r < 0.5 else 1), 0.2 * (0.5 if r < 0.5 else 1.2 if r > 0.8 else 1)]
    a, b = x[:n], y[:n]
    centre = lambda v: [k - sum(v) / n for k in v]
    angle, linear = (cosine(a, b), cosine(centre(a), centre(b))) if n > 1 else (None, None)
    parts = [1 / (1 + distance(x, y)), angle or 0.0, 0.0 if linear is None else max(0.0, (linear + 1) / 2), r * r]
    return max(0.0, min(1.0, sum(p * q for p, q in zip(w, parts, strict=True)) / sum(w)))


def early_match(values, label, cache, now, threshold, least):
    """(shapelet, label, similarity, confidence) of a normalised prefix's best match in the cache (rows as dicts), or None."""
    n = len(values)
    first = sorted(cache, key=lambda c: (-c["success_rate"], -c["confidence"], -c["discriminative_score"], c["shapelet_id"]))[:40]
    latest = sorted(cache, key=lambda c: (c["created_at"], c["shapelet_id"]), reverse=True)[:20]
    own = sorted((c for c in cache if label is not None and c["label"] == label), key=lambda c: (-c["success_rate"], -c["confidence"], -c["last_accessed"].timestamp(), c["shapelet_id"]))[:50]
    held = {c["shapelet_id"]: c for c in [*first, *latest, *own] if math.floor(n * 0.7) <= c["length"] <= math.floor(n * 1.3)}

    def score(c):
        age = (now - c["last_accessed"]).total_seconds()
        return 0.3 * c["success_rate"] + 0.2 * c["confidence"] + 0.2 * c["discriminative_score"] + 0.15 / (1 + age / 3600) + (0.15 if c["label"] == label else 0)

    tried = sorted((c for c in held.values() if score(c) > 0.1), key=lambda c: (-round(score(c), 9), c["shapelet_id"]))[:10]
    best = None
    for c in tried:
        sim = multi_metric(values, c["values"])
        if best is None or round(sim, 9) > round(best[0], 9):
            best = (sim, c)
    if best is None:
        return None
    sim, c = best
    sure = max(0.0, min(1.0, sim * (0.7 + 0.3 * (0.4 * c["confidence"] + 0.3 * c["success_rate"] + 0.3 * c["discriminative_score"]))))
    return (c["shapelet_id"], c["label"], sim, sure) if sim >= threshold and sure >= least else None


def entropy(labels):
    return -sum(c / len(labels) * math.log2(c / len(labels)) for c in Counter(labels).values())


def grown(drawn, held, far=distance):
    """Nodes (tree, node, parent, side, shapelet, threshold, label) of trees from drawn ids {tree: [id]} of shapelets {id: (label, values)}."""
    made = []

    def grow(tree, ids, parent, side, depth):
        labels = [held[i][0] for i in ids]
        best = (0.0, None, None)
        own = sum(n[0] == tree for n in made)
        if len(set(labels)) > 1 and len(ids) >= 4 and depth < 5:
            sims = [1 / (1 + far(held[i][1], held[ids[0]][1])) for i in ids]
            for t in range(1, 10):
                parts = [[i for i, s in zip(ids, sims, strict=True) if (s < t / 10) == left] for left in (True, False)]
                if min(map(len, parts)) >= 2:
                    gain = entropy(labels) - sum(len(p) / len(ids) * entropy([held[i][0] for i in p]) for p in parts)
                    if gain > best[0] + 1e-12:
                        best = (gain, t / 10, parts)
        if best[1] is None:
            made.append((tree, own, parent, side, None, None, min(Counter(labels).items(), key=lambda c: (-c[1], c[0]))[0]))
            return
        made.append((tree, own, parent, side, ids[0], best[1], None))
        grow(tree, best[2][0], own, "left", depth + 1)
        grow(tree, best[2][1], own, "right", depth + 1)

    for tree, ids in drawn.items():
        grow(tree, ids, -1, "root", 0)
    return sorted(made, key=lambda m: m[:2])
