"""Small numpy kernels for what array expressions cannot do well."""

from __future__ import annotations

import numpy as np


def strided_starts(n: int, length: int, rule: str) -> np.ndarray:
    """Window starts: all, or by the length of the series (over 200 points about 20 windows, over 100 every fifth)."""
    step = 1
    if rule == "strided":
        step = max(1, (n - length) // 20) if n > 200 else 5 if n > 100 else 1
    return np.arange(0, n - length + 1, step)


def znorm_min_dist(shapelets: np.ndarray, series: np.ndarray, rule: str = "full") -> np.ndarray:
    """Least distance of each z-normalised shapelet to a z-normalised window of one series.

    ``full`` looks at every window, skips constant ones and gives 0 where no
    window is left; ``strided`` uses wider steps, skips deviations below 0.001
    and gives 10. A shapelet longer than the series is infinitely far.
    """
    count, length = shapelets.shape
    if length > len(series):
        return np.full(count, np.inf)
    windows = np.lib.stride_tricks.sliding_window_view(series, length)[strided_starts(len(series), length, rule)]
    centred = windows - windows.mean(1, keepdims=True)
    deviation = np.sqrt((centred * centred).mean(1))
    good = deviation >= 0.001 if rule == "strided" else deviation > 0
    if not good.any():
        return np.full(count, 10.0 if rule == "strided" else 0.0)
    z = centred[good] / deviation[good, None]
    square = (shapelets * shapelets).sum(1)[:, None] + (z * z).sum(1)[None, :] - 2 * shapelets @ z.T
    best = square.argmin(1)
    # near zero the difference of large sums is inexact, so the winner is measured anew
    return np.sqrt(((shapelets - z[best]) ** 2).sum(1))


def prefix_normalised(x: np.ndarray) -> np.ndarray:
    """Less the mean, over the population deviation + 1e-8."""
    return (x - x.mean()) / (x.std() + 1e-8)


#: Cells of cost tables that are held together.
CELLS = 2_000_000


def _costs(a: np.ndarray, b: np.ndarray, allowed: np.ndarray | None, ends: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Least sums of absolute differences up to each cell, for pairs of columns, as [row + column, row, pair]; rows and columns count from 1.

    Cells of one falling diagonal do not depend on each other and are filled at once.
    With ``ends``, only the sums up to each pair's own last cell: three diagonals are held.
    """
    n, m, count = len(a), len(b), a.shape[1]
    cost = np.full((n + m + 1 if ends is None else 3, n + 1, count), np.inf)
    held = len(cost)
    cost[0, 0] = 0.0
    back = b[::-1]
    out = np.empty(count)
    if ends is not None:
        last = ends[0] + ends[1]
        done = {int(d): np.flatnonzero(last == d) for d in np.unique(last)}
    if allowed is not None:
        # the cells of a falling diagonal are as far apart as a row is long, less one
        flat, step, some = ~allowed.reshape(n * m, count), max(1, m - 1), allowed.any(2)
        d = np.add.outer(np.arange(n), np.arange(m))[some] + 2
        least, most = np.full(n + m + 1, n + 1), np.zeros(n + m + 1, int)
        np.minimum.at(least, d, np.nonzero(some)[0] + 1)
        np.maximum.at(most, d, np.nonzero(some)[0] + 1)
    for d in range(2, n + m + 1):
        low, high = (max(1, d - m), min(n, d - 1)) if allowed is None else (int(least[d]), int(most[d]))
        now, before, third = cost[d % held], cost[(d - 1) % held], cost[(d - 2) % held]
        if ends is not None:
            now.fill(np.inf)
        if low <= high:
            best = np.minimum(before[low - 1 : high], before[low : high + 1])
            np.minimum(best, third[low - 1 : high], out=best)
            cell = a[low - 1 : high] - back[m - d + low : m - d + high + 1]
            np.abs(cell, out=cell)
            cell += best
            if allowed is not None:
                first = (low - 1) * m + d - low - 1
                np.copyto(cell, np.inf, where=flat[first : first + (high - low) * step + 1 : step])
            now[low : high + 1] = cell
        if ends is not None and d in done:
            out[done[d]] = now[ends[0][done[d]], done[d]]
    return cost if ends is None else out


def _path(cost: np.ndarray, n: np.ndarray, m: np.ndarray, columns: int) -> np.ndarray:
    """The cells, as [row, column, pair], of the cheapest path of each pair to its own last cell; of equal steps the first of down, right, both."""
    rows, count = cost.shape[1], cost.shape[2]
    on, flat, k = np.zeros((rows - 1, columns, count), bool), cost.reshape(-1), np.arange(count)
    i, j = n.copy(), m.copy()
    while len(k):
        on[i - 1, j - 1, k] = True
        at = ((i + j - 1) * rows + i) * count + k
        right, down, both = flat[at], flat[at - count], flat[at - (rows + 1) * count]
        goes_down = (down <= right) & (down <= both)
        goes_right = ~goes_down & (right <= both)
        i, j = i - ~goes_right, j - ~goes_down
        there = (i > 0) & (j > 0)
        if not there.all():
            k, i, j = k[there], i[there], j[there]
    return on


def _around(path: np.ndarray, n: int, m: int, radius: int) -> np.ndarray:
    """Cells of a table of twice the size that lie at most ``radius`` coarse cells from the path."""
    rows, columns, count = path.shape
    wide = np.zeros((rows + 2 * radius, columns + 2 * radius, count), bool)
    for x in range(2 * radius + 1):
        for y in range(2 * radius + 1):
            wide[x : x + rows, y : y + columns] |= path
    return wide[radius:, radius:].repeat(2, 0).repeat(2, 1)[:n, :m]


def _halved(x: np.ndarray) -> np.ndarray:
    even = x[:, : x.shape[1] // 2 * 2]
    return (even[:, ::2] + even[:, 1::2]) / 2


def _halvings(n: np.ndarray, m: np.ndarray, radius: int) -> np.ndarray:
    """How often the sides of each pair are halved until one has fewer than ``radius`` + 2 points."""
    least, out = np.minimum(n, m), np.zeros(len(n), int)
    while (more := least >= radius + 2).any():
        out += more
        least = least // 2
    return out


def _fast_costs(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, radius: int, halvings: int, last: bool = False) -> np.ndarray:
    """``_costs`` of pairs of columns with ``n`` and ``m`` points of their own, from coarse to fine; what comes after their points is not looked at."""
    near, ends = None, (n, m) if last else None
    if halvings:
        coarse = _fast_costs(_halved(a.T).T, _halved(b.T).T, n // 2, m // 2, radius, halvings - 1)
        near = _around(_path(coarse, n // 2, m // 2, len(b) // 2), len(a), len(b), radius)
    return _costs(a, b, near, ends)


def _table_distances(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, radius: int | None) -> np.ndarray:
    """Warping distances of rows that have ``n`` and ``m`` points, anything behind them; pairs of like lengths are worked on together."""
    out, depth = np.empty(len(a)), np.zeros(len(a), int) if radius is None else _halvings(n, m, radius)
    order = np.lexsort((m, n, depth))
    k = 0
    while k < len(order):
        # the longest sides of as many pairs as tables hold together
        ahead = order[k : k + CELLS]
        ahead = ahead[: np.searchsorted(depth[ahead], depth[ahead[0]], "right")]
        cells = (np.maximum.accumulate(n[ahead]) + np.maximum.accumulate(m[ahead]) + 1) * (np.maximum.accumulate(n[ahead]) + 1) * np.arange(1, len(ahead) + 1)
        at = ahead[: max(1, int(np.searchsorted(cells, CELLS, "right")))]
        x, y = (np.ascontiguousarray(side[at, : size[at].max()].T) for side, size in ((a, n), (b, m)))
        out[at] = _fast_costs(x, y, n[at], m[at], radius or 0, int(depth[at[0]]), True)
        k += len(at)
    return out


#: Cells of a table that is held whole on the way down; of larger ones only the window's cells are.
DENSE = 1 << 14
_INF = np.inf


def _whole_window(n: int, m: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last row) of every falling diagonal of a whole table, for ``count`` pairs."""
    d = np.arange(n + m - 1)[:, None]
    return np.broadcast_to(np.maximum(0, d - m + 1), (n + m - 1, count)), np.broadcast_to(np.minimum(n - 1, d), (n + m - 1, count))


def _path_window(path: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, m: int, count: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last row) on each diagonal of the cells that lie at most ``radius`` coarse cells from a path of half the size.

    A coarse cell is a square here; the squares of a path overlap, so that what they
    cover of a diagonal has no holes.
    """
    pair, i, j = path
    low, high = np.full((n + m - 1, count), n), np.full((n + m - 1, count), -1)
    x0, y0, side = 2 * (i - radius), 2 * (j - radius), 4 * radius + 2
    for off in range(2 * side - 1):
        d = x0 + y0 + off
        there = (d >= 0) & (d < n + m - 1)
        first, last = np.maximum(x0, d - y0 - side + 1), np.minimum(x0 + side - 1, d - y0)
        np.minimum.at(low, (d[there], pair[there]), first[there])
        np.maximum.at(high, (d[there], pair[there]), last[there])
    whole = _whole_window(n, m, count)
    return np.maximum(low, whole[0]), np.minimum(high, whole[1])


def _window_costs(a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray, steps: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """(least sums at the last cells, the steps to each cell of the window: 0 down, 1 right, 2 both, if asked for).

    Only three diagonals of sums are held.
    """
    count, n, m = len(a), a.shape[1], b.shape[1]
    width = int((high - low).max()) + 1
    across, rows = np.arange(width), np.arange(count)[:, None]
    taken = np.zeros((n + m - 1, count, width), np.int8) if steps else None
    empty = np.full((count, width + 4), _INF)
    # sums of a diagonal lie from place 2 on, with unreachable cells around them
    before, last = (empty, np.zeros(count, int)), (empty, np.zeros(count, int))
    for d in range(n + m - 1):
        first = low[d]
        i = first[:, None] + across
        inside = i <= high[d][:, None]
        gap = np.abs(a[rows, np.minimum(i, n - 1)] - b[rows, np.clip(d - i, 0, m - 1)])
        look = lambda held, row: held[0][rows, np.clip(row - held[1][:, None] + 2, 0, width + 3)]
        if d == 0:
            best = np.zeros((count, width))
        else:
            down, right, both = look(last, i - 1), look(last, i), look(before, i - 1)
            best = np.minimum(np.minimum(down, right), both)
            if steps:
                taken[d] = np.where(down == best, 0, np.where(right == best, 1, 2))
        now = empty.copy()
        now[:, 2 : width + 2] = np.where(inside, gap + best, _INF)
        before, last = last, (now, first)
    return last[0][:, 2], taken


def _window_path(taken: np.ndarray, low: np.ndarray, n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, row, column) of the cells of the cheapest path of each pair."""
    k = np.arange(taken.shape[1])
    i, j, out = np.full(len(k), n - 1), np.full(len(k), m - 1), []
    while len(k):
        out.append((k, i, j))
        step = taken[i + j, k, i - low[i + j, k]]
        there = (i > 0) | (j > 0)
        k, i, j = k[there], (i - (step != 1))[there], (j - (step != 0))[there]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _fast_path(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The path that goes with ``_fast_distances``."""
    n, m = a.shape[1], b.shape[1]
    if min(n, m) < radius + 2:
        window = _whole_window(n, m, len(a))
    else:
        window = _path_window(_fast_path(_halved(a), _halved(b), radius), n, m, len(a), radius)
    return _window_path(_window_costs(a, b, *window, True)[1], window[0], n, m)


def _distances(a: np.ndarray, b: np.ndarray, radius: int | None) -> np.ndarray:
    n, m = a.shape[1], b.shape[1]
    if n * m <= DENSE:
        return _table_distances(a, b, np.full(len(a), n), np.full(len(a), m), radius)
    if radius is None or min(n, m) < radius + 2:
        window = _whole_window(n, m, len(a))
    else:
        window = _path_window(_fast_path(_halved(a), _halved(b), radius), n, m, len(a), radius)
    return _window_costs(a, b, *window, False)[0]


def warped(a: np.ndarray, b: np.ndarray, radius: int | None = 1) -> np.ndarray:
    """Dynamic time warping distances, by absolute difference, of each row of ``a`` to the same row of ``b``.

    With a radius (1 or more) from coarse to fine: the path of both sides at half
    their points, and what is at most ``radius`` coarse cells from it, is all that
    is looked at; time and memory grow with the points. None is exact: time grows
    with the product, memory with the points. Infinite for an empty side.
    """
    if not a.shape[1] or not b.shape[1]:
        return np.full(len(a), np.inf)
    together = len(a) if a.shape[1] * b.shape[1] <= DENSE else max(1, CELLS // (32 * (a.shape[1] + b.shape[1])))
    parts = [(a[k : k + together], b[k : k + together]) for k in range(0, len(a), max(1, together))]
    return np.concatenate([_distances(x, y, radius) for x, y in parts] or [np.zeros(0)])


def dtw(a: np.ndarray, b: np.ndarray, radius: int | None = None) -> float:
    """The warping distance of two series (None: exact). Infinite for an empty side."""
    return float(warped(np.asarray(a, float)[None], np.asarray(b, float)[None], radius)[0])


def row_distances(a: np.ndarray, b: np.ndarray, threshold: float = 0.1, radius: int = 1) -> np.ndarray:
    """Of each row of ``a`` to the same row of ``b``: the Minkowski distance of the first order of 1 and 2 above the
    threshold (else 2); the warping distance for unequal lengths."""
    if a.shape[1] != b.shape[1]:
        return warped(a, b, radius)
    gap = np.abs(a - b)
    first = gap.sum(1)
    return np.where(first > threshold, first, np.sqrt((gap * gap).sum(1)))


def distance(a: np.ndarray, b: np.ndarray, threshold: float = 0.1, radius: int = 1) -> float:
    """``row_distances`` of two series."""
    return float(row_distances(np.asarray(a, float)[None], np.asarray(b, float)[None], threshold, radius)[0])


def by_lengths(a: list, b: list):
    """(places, rows of a, rows of b) for each two lengths that the pairs of two lists have."""
    shapes: dict[tuple[int, int], list[int]] = {}
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        shapes.setdefault((len(x), len(y)), []).append(k)
    for at in shapes.values():
        yield np.array(at), *(np.array([side[k] for k in at], float).reshape(len(at), -1) for side in (a, b))


def distances(a: list, b: list, threshold: float = 0.1, radius: int = 1) -> np.ndarray:
    """The distance of each series of ``a`` to the same one of ``b``, lengths as they come."""
    out = np.empty(len(a))
    for at, x, y in by_lengths(a, b):
        out[at] = row_distances(x, y, threshold, radius)
    return out


def _other_metrics(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weight of the distance's similarity, weighted sum of cosine, Pearson and length similarity) of rows with ``n`` and ``m`` points, zeros behind them."""
    common = np.minimum(n, m)
    r = common / np.maximum(1, np.maximum(n, m))
    low, high = r < 0.5, r > 0.8
    weights = np.stack([0.3 * np.where(high, 1.1, 1.0), 0.3 * np.where(low, 1.2, 1.0), 0.2 * np.where(low, 1.1, 1.0), 0.2 * np.where(low, 0.5, np.where(high, 1.2, 1.0))])
    weights /= weights.sum(0)
    across = int(common.max(initial=0))
    inside = np.arange(across) < common[:, None]
    x, y = np.where(inside, a[:, :across], 0.0), np.where(inside, b[:, :across], 0.0)

    def cosine(u: np.ndarray, v: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        norm = np.sqrt((u * u).sum(1)) * np.sqrt((v * v).sum(1))
        # a norm that is no number passes, so that the similarity is none either
        good = ~(norm <= least) & (common > 1)
        return np.where(good, (u * v).sum(1) / np.where(good, norm, 1.0), 0.0), good

    def centred(u: np.ndarray) -> np.ndarray:
        return np.where(inside, u - (u.sum(1) / np.maximum(1, common))[:, None], 0.0)

    angle, _ = cosine(x, y, 0.0)
    linear, good = cosine(centred(x), centred(y), 1e-12)
    return weights[0], weights[1] * angle + weights[2] * np.where(good, np.maximum(0.0, (linear + 1) / 2), 0.0) + weights[3] * r * r


def multi_metric(a: np.ndarray, b: np.ndarray, radius: int = 1) -> np.ndarray:
    """Weighted sum, clipped to [0, 1], of distance, cosine, Pearson and length similarity of rows; cosine and Pearson on
    the common prefix. As ``scalars.multi_metric_similarity``, with warping for unequal lengths."""
    if not min(a.shape[1], b.shape[1]):
        return np.zeros(len(a))
    weight, rest = _other_metrics(a, b, np.full(len(a), a.shape[1]), np.full(len(b), b.shape[1]))
    return np.nan_to_num(np.clip(weight / (1 + row_distances(a, b, radius=radius)) + rest, 0.0, 1.0))


def rows_of(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Rows of a table, one point wide at least, from their places in ``flat``, zeros behind each."""
    across = np.arange(int(length.max(initial=1)))
    inside = across < length[:, None]
    out = np.zeros(inside.shape)
    out[inside] = flat[(start[:, None] + across)[inside]]
    return out


#: Points of pairs that are looked at together.
POINTS = 250_000
#: By how much a bound must fall short: similarities are compared to nine digits.
SLACK = 1e-8


def most_similar(left: tuple, right: tuple, owner: np.ndarray, least: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owners, place of the most similar pair of each by ``multi_metric``, its similarity), the first place where several are.

    Sides are (flat values, start, length) of each pair; ``owner`` rises. An owner that
    no pair brings to ``least`` may be left out, or come with a smaller similarity.
    A path warps at least the first and the last points, which bounds the similarity
    of a pair; pairs that cannot be the best are not warped.
    """
    found = [[], [], []]
    ends = np.append(np.flatnonzero(np.diff(owner)) + 1, len(owner))
    wide = int(max([1, *(x[2].max(initial=0) for x in (left, right))]))
    k = 0
    while k < len(owner):
        # whole owners, one at least
        to = int(ends[max(np.searchsorted(ends, k, "right"), np.searchsorted(ends, k + POINTS // wide, "right") - 1)])
        for into, part in zip(found, _most_similar([(x[0], x[1][k:to], x[2][k:to]) for x in (left, right)], owner[k:to], least), strict=True):
            into.append(part + k if into is found[1] else part)
        k = to
    return tuple(np.concatenate(x) if x else np.zeros(0, int) for x in found)


def _most_similar(sides: list[tuple], owner: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    (a, n), (b, m) = ((rows_of(*side), side[2]) for side in sides)
    weight, rest = _other_metrics(a, b, n, m)
    places, first = np.arange(len(owner)), np.flatnonzero(np.diff(owner, prepend=owner[0] - 1))
    own = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(owner))))
    similarity = lambda at, d: np.nan_to_num(np.clip(weight[at] / (1 + d) + rest[at], 0.0, 1.0))
    same, some = n == m, np.minimum(n, m) > 0
    bound = np.zeros(len(owner))
    equal = np.flatnonzero(same & some)
    across = min(a.shape[1], b.shape[1])
    bound[equal] = similarity(equal, row_distances(a[equal, :across], b[equal, :across]))
    free = np.flatnonzero(~same & some)
    bound[free] = similarity(free, np.abs(a[free, 0] - b[free, 0]) + np.abs(a[free, n[free] - 1] - b[free, m[free] - 1]))
    # what no warping changes is known
    known = same | ~some
    sims = np.where(known, bound, -1.0)
    for top in (True, False):
        best = np.maximum(np.maximum.reduceat(bound if top else sims, first)[own], least)
        at = np.flatnonzero(~known & (bound + (0.0 if top else SLACK) >= best))
        sims[at], known[at] = similarity(at, _row_warped(a[at], b[at], n[at], m[at])), True
    digits = np.round(sims, 9)
    hit = places[digits == np.maximum.reduceat(digits, first)[own]]
    which, at = np.unique(own[hit], return_index=True)
    best = hit[at]
    there = sims[best] >= 0
    return owner[first[which]][there], best[there], sims[best][there]


def _row_warped(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, radius: int = 1) -> np.ndarray:
    """Warping distances of rows with ``n`` and ``m`` points: of short ones many lengths at once."""
    out, short = np.empty(len(a)), n * m <= DENSE
    out[short] = _table_distances(a[short], b[short], n[short], m[short], radius)
    rest = np.flatnonzero(~short)
    for at, x, y in by_lengths([a[k, : n[k]] for k in rest], [b[k, : m[k]] for k in rest]):
        out[rest[at]] = warped(x, y, radius)
    return out


def pair_distances(a: np.ndarray, b: np.ndarray, threshold: float = 0.1) -> np.ndarray:
    """``distance`` of every row of ``a`` to every row of ``b``, all of one length."""
    first = np.empty((len(a), len(b)))
    second = np.empty_like(first)
    for i, row in enumerate(a):
        gap = np.abs(b - row)
        first[i], second[i] = gap.sum(1), np.sqrt((gap * gap).sum(1))
    return np.where(first > threshold, first, second)
