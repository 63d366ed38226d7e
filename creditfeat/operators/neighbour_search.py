"""Exact nearest neighbours of a block of points, in NumPy. Runs inside Spark tasks on
bounded blocks; it knows nothing about Spark."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SLICE = 256  # queries handled together
SPAN = 8192  # reference points compared at once
DECIMALS = 9  # squared distances equal to this many decimals are ties, broken by key
FULL = 3  # times k: held rows at which those beyond the bound are dropped
FIRST = 16  # times k: nearest rows that give the first bound on the k-th distance


@dataclass
class Reference:
    """Scaled reference points, sorted by cell. Cell c holds rows starts[c]:starts[c + 1],
    all within ``radii[c]`` of ``centres[c]``."""

    points: np.ndarray
    keys: np.ndarray
    labels: np.ndarray
    starts: np.ndarray
    centres: np.ndarray
    radii: np.ndarray

    @classmethod
    def build(cls, raw, keys, labels, folds, cells, fold, mean, scale, centres, radii) -> Reference:
        """Scale raw points with one fold's moments and leave out the rows of that fold."""
        use = np.flatnonzero(folds != fold)
        use = use[np.argsort(cells[use], kind="stable")]
        starts = np.searchsorted(cells[use], np.arange(len(centres) + 1))
        return cls(
            (raw[use] - mean) / scale,
            keys[use],
            labels[use],
            starts,
            (centres - mean) / scale,
            radii,
        )


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0.0))


def chain(centres: np.ndarray) -> np.ndarray:
    """An order of the centres in which neighbours in the order are near in space."""
    left = np.ones(len(centres), bool)
    order, at = [], 0
    for _ in range(len(centres)):
        order.append(at)
        left[at] = False
        gap = ((centres - centres[at]) ** 2).sum(1)
        gap[~left] = np.inf
        at = int(gap.argmin())
    return np.array(order, dtype=np.int64)


def _error(dims: int) -> float:
    """The largest error of a squared distance in single precision, as a share of the squared lengths."""
    return 8 * (dims + 8) * float(np.finfo(np.float32).eps)


def _lower_bounds(a: np.ndarray, points: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """Squared distances in single precision, lowered by the largest possible error and by what the query alone
    gives. ``a``: queries less ``middle``, in single precision, and a last column of ones."""
    b = np.empty((len(points), a.shape[1]), np.float32)
    np.subtract(points, middle, out=b[:, :-1], casting="same_kind")
    np.einsum("ij,ij->i", b[:, :-1], b[:, :-1], out=b[:, -1])
    b[:, :-1] *= -2
    b[:, -1] *= np.float32(1 - _error(len(middle)))
    return a @ b.T


def _true(mask: np.ndarray) -> np.ndarray:
    """Flat numbers of the true places; words of eight places without one are passed over at once."""
    flat = mask.ravel()
    whole = len(flat) // 8 * 8
    words = np.flatnonzero(flat[:whole].view(np.uint64) != 0)
    places = (words[:, None] * 8 + np.arange(8)).ravel()
    return np.concatenate([places[flat[places]], whole + np.flatnonzero(flat[whole:])])


def _below(low: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Column numbers per row with low <= limit, padded; and which of them are real."""
    rows, cols = np.divmod(_true(low <= limit[:, None]), max(1, low.shape[1]))
    counts = np.bincount(rows, minlength=len(low))
    place = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    chosen = np.zeros((len(low), int(counts.max(initial=0))), np.int64)
    real = np.zeros(chosen.shape, bool)
    chosen[rows, place] = cols
    real[rows, place] = True
    return chosen, real


def _keep(dist: np.ndarray, rows: np.ndarray, keys: np.ndarray, k: int) -> tuple:
    """The k smallest by (distance, key) of every row, in no order."""
    if dist.shape[1] <= k:
        return dist, rows
    order = np.argpartition(dist, [k - 1, k], axis=1)
    edge = np.take_along_axis(dist, order[:, k - 1 : k + 1], axis=1)
    tied = np.flatnonzero((edge[:, 0] == edge[:, 1]) & np.isfinite(edge[:, 0]))
    order = order[:, :k]
    if len(tied):
        order[tied] = np.lexsort((keys[rows[tied]], dist[tied]), axis=1)[:, :k]
    return np.take_along_axis(dist, order, axis=1), np.take_along_axis(rows, order, axis=1)


def _merge(q, ref, picked, real, best, k) -> tuple:
    """Add the ``picked`` points with exact distances to the k best."""
    exact = np.empty(picked.shape)
    step = max(1, 2**18 // max(1, picked.shape[1] * q.shape[1]))
    for i in range(0, len(q), step):  # bounds the memory of the differences
        diff = ref.points[picked[i : i + step]]
        diff -= q[i : i + step, None, :]
        exact[i : i + step] = np.einsum("ijk,ijk->ij", diff, diff)
    np.round(exact, DECIMALS, out=exact)
    exact[~real] = np.inf
    dist, near = (np.concatenate(p, axis=1) for p in zip(best, (exact, picked), strict=True))
    return _keep(dist, near, ref.keys, k)


class _Held:
    """The reference rows that can be among the k nearest of a slice of queries, by bounds in single precision, and
    an upper bound of each query's k-th squared distance. Exact distances are left to the rows held at the end."""

    def __init__(self, q: np.ndarray, ref: Reference, k: int, known: np.ndarray):
        """``known``: squared distances that the k-th of each query doesn't exceed."""
        self.q, self.ref, self.k = q, ref, k
        self.middle = q.mean(0)
        self.error = _error(q.shape[1])
        self.a = np.ones((len(q), q.shape[1] + 1), np.float32)
        self.a[:, :-1] = q - self.middle
        self.own = np.square(self.a[:, :-1], dtype=float).sum(1)
        self.low, self.rows = np.empty((len(q), 0)), np.empty((len(q), 0), np.int64)
        self.limit = known + 2 * 10.0**-DECIMALS  # they are rounded

    def add(self, rows: np.ndarray) -> None:
        """Look at reference ``rows``, nearest cells first."""
        own = (self.own * (1 - self.error))[:, None]
        for at in range(0, len(rows), SPAN):
            part = rows[at : at + SPAN]
            low = _lower_bounds(self.a, self.ref.points[part], self.middle)
            if np.isinf(self.limit).all():
                found, where = low + own, np.broadcast_to(part, low.shape)
            else:
                up = np.nextafter((self.limit - own[:, 0]).astype(np.float32), np.float32(np.inf))
                chosen, real = _below(low, up)
                if not chosen.shape[1]:
                    continue
                found, where = np.where(real, np.take_along_axis(low, chosen, axis=1) + own, np.inf), part[chosen]
            self.low, self.rows = np.concatenate([self.low, found], axis=1), np.concatenate([self.rows, where], axis=1)
            if np.isinf(self.limit).all() or self.low.shape[1] >= FULL * self.k:
                self.drop()

    def drop(self) -> None:
        """Lower the bound to what the held rows give, and keep the rows within it."""
        if self.low.shape[1] < self.k:
            return
        # With lengths a, b and distance d, b^2 <= 2 a^2 + 2 d^2 and d^2 <= low + 2 error (a^2 + b^2).
        far = np.partition(self.low, self.k - 1, axis=1)[:, self.k - 1]
        far = (far + 6 * self.error * self.own) / (1 - 4 * self.error) + 2 * 10.0**-DECIMALS
        self.limit = np.minimum(self.limit, far)
        chosen, real = _below(self.low, self.limit)
        self.low = np.where(real, np.take_along_axis(self.low, chosen, axis=1), np.inf)
        self.rows = np.take_along_axis(self.rows, chosen, axis=1)


def nearest(queries: np.ndarray, ref: Reference, k: int, found: tuple[np.ndarray, ...] | None = None) -> tuple[np.ndarray, ...]:
    """(squared distances, keys, labels), each queries x k, sorted by (distance, key).
    Places beyond the number of reference points hold an infinite distance. ``found``: such lists of other
    reference points, which are merged."""
    n = len(queries)
    if found is None:
        found = np.full((n, k), np.inf), np.zeros((n, k), np.int64), np.zeros((n, k), ref.labels.dtype if len(ref.points) else np.int32)
    if n == 0 or len(ref.points) == 0:
        return found
    dist, keys, labels = found
    sizes = np.diff(ref.starts)
    filled = np.flatnonzero(sizes)
    far = distances(queries, ref.centres[filled])
    order = np.argsort(far.argmin(1), kind="stable")  # neighbours in space share a slice
    for at in range(0, n, SLICE):
        mine = order[at : at + SLICE]
        q, gap = queries[mine], far[mine]
        near = np.argsort(gap.mean(0))
        held = _Held(q, ref, k, dist[mine, k - 1])
        # Without a bound, the nearest cells are looked at first.
        enough = 0 if np.isfinite(held.limit).all() else int(np.searchsorted(np.cumsum(sizes[filled][near]), FIRST * k)) + 1
        held.add(_rows(ref, filled[near[:enough]]))
        rest = near[enough:]
        # A cell can matter only if its ball comes nearer than the k-th neighbour so far.
        reach = np.sqrt(held.limit)
        lower = gap[:, rest] - ref.radii[filled[rest]]
        rest = rest[(lower * (1 - 1e-9) - 1e-6 <= reach[:, None]).any(0)]
        held.add(_rows(ref, filled[rest]))
        held.drop()
        none = np.full((len(q), 0), np.inf), np.zeros((len(q), 0), np.int64)
        gap, near = _merge(q, ref, held.rows, np.isfinite(held.low), none, k)
        both = [gap, ref.keys[near], ref.labels[near]]
        if gap.shape[1] < k or np.isfinite(dist[mine]).any():
            both = [np.concatenate(p, axis=1) for p in zip((dist[mine], keys[mine], labels[mine]), both, strict=True)]
        last = np.lexsort((both[1], both[0]), axis=1)[:, :k]
        dist[mine], keys[mine], labels[mine] = (np.take_along_axis(v, last, axis=1) for v in both)
    return dist, keys, labels


def _rows(ref: Reference, cells: np.ndarray) -> np.ndarray:
    if len(cells) == 0:
        return np.empty(0, np.int64)
    return np.concatenate([np.arange(ref.starts[c], ref.starts[c + 1]) for c in cells])


def rates(dist: np.ndarray, labels: np.ndarray, ks) -> np.ndarray:
    """Share of positive labels among the first k neighbours, one column per k."""
    real = np.isfinite(dist)
    hits = np.cumsum(np.where(real, labels, 0), axis=1)
    seen = np.cumsum(real, axis=1)
    cut = [min(k, dist.shape[1]) - 1 for k in ks]
    with np.errstate(invalid="ignore"):
        return np.stack([hits[:, c] / seen[:, c] for c in cut], axis=1)
