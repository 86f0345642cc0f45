"""Sequential selection and grid kernels in numpy; operators run them on bounded blocks."""

from __future__ import annotations

import numpy as np


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, exact differences."""
    return np.sqrt(((x - y) ** 2).sum(-1))


def pairwise(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T
    return np.sqrt(np.maximum(d, 0))


def farthest_first(x: np.ndarray, k: int) -> np.ndarray:
    """Rows in order of selection: the one farthest from the mean, then always the one farthest
    from those chosen (ties: the lowest). With k rows or fewer, all in their order. Chosen rows
    are not masked, so a row may repeat where fewer than k differ."""
    n = len(x)
    if k >= n:
        return np.arange(n)
    pick = int(np.argmax(distances(x, x.mean(0))))
    out, near = [pick], distances(x, x[pick])
    while len(out) < k:
        pick = int(np.argmax(near))
        out.append(pick)
        near = np.minimum(near, distances(x, x[pick]))
    return np.array(out)


def farthest_from(x: np.ndarray, pool: np.ndarray, k: int) -> np.ndarray:
    """Like farthest_first, seeded by the distances to a pool; chosen rows are masked."""
    if not len(pool):
        return farthest_first(x, k)
    k = min(k, len(x))
    near = pairwise(x, pool).min(1) if len(x) else np.zeros(0)
    out: list[int] = []
    while len(out) < k:
        pick = int(np.argmax(near))
        out.append(pick)
        near = np.minimum(near, distances(x, x[pick]))
        near[out] = -np.inf
    return np.array(out, int)


class Budgeted:
    """Online k-center: the first k rows are centers; a later row takes the place of the more
    redundant end of the closest pair of centers if it is farther from all than the threshold,
    which is the closest pair's distance unless given."""

    def __init__(self, k: int, threshold: float | None = None):
        self.k, self.threshold, self.c = k, threshold, np.zeros((0, 0))
        self._near: np.ndarray | None = None

    def update(self, rows: np.ndarray) -> None:
        for r in rows:
            if len(self.c) < self.k:
                self.c = np.concatenate([self.c, r[None]]) if len(self.c) else r[None].copy()
                continue
            if self._near is None:
                d = np.sqrt(((self.c[:, None] - self.c[None]) ** 2).sum(-1))
                np.fill_diagonal(d, np.inf)
                self._near = d.min(1) if self.k > 1 else np.zeros(1)
            bar = self.threshold if self.threshold is not None else float(self._near.min())
            if distances(self.c, r).min() > bar:
                self.c[int(np.argmin(self._near))] = r
                self._near = None


def greedy_picks(x: np.ndarray, anchor: np.ndarray, k: int) -> np.ndarray:
    """k rows in order: always the one of the largest anchor (ties: the lowest), which its distance to a pick bounds."""
    out = []
    for _ in range(k):
        pick = int(np.argmax(anchor))
        out.append(pick)
        anchor = np.minimum(anchor, distances(x, x[pick]))
    return np.array(out, int)


class Kept:
    """Rows that stay when each within eps of a kept earlier row goes. The kept ones lie sorted by their first
    coordinate, as only those within eps there can be near; new ones wait in a short unsorted tail."""

    def __init__(self, eps: float):
        self.eps, self.x, self.tail = eps, None, []

    def add(self, rows: np.ndarray) -> np.ndarray:
        """Numbers of the rows that stay."""
        keep: list[int] = []
        if self.x is None:
            self.x = np.zeros((0, rows.shape[1]))
        for i, r in enumerate(rows):
            near = self.eps * (1 + 1e-9)
            lo, hi = np.searchsorted(self.x[:, 0], r[0] - near, "left"), np.searchsorted(self.x[:, 0], r[0] + near, "right")
            if hi > lo and distances(self.x[lo:hi], r).min() <= self.eps or self.tail and distances(np.array(self.tail), r).min() <= self.eps:
                continue
            keep.append(i)
            self.tail.append(r)
            if len(self.tail) >= 256:
                self._sort()
        self._sort()
        return np.array(keep, int)

    def _sort(self) -> None:
        if self.tail:
            x = np.concatenate([self.x, np.array(self.tail)])
            self.x, self.tail = x[np.argsort(x[:, 0], kind="stable")], []


def tolerance_kept(x: np.ndarray, eps: float, kept: np.ndarray | None = None) -> np.ndarray:
    """Rows that stay when each within eps of a kept earlier row goes."""
    state = Kept(eps)
    if kept is not None and len(kept):
        state.x, state.tail = np.zeros((0, kept.shape[1])), list(kept)
        state._sort()
    return state.add(x)


def regions(mask: np.ndarray) -> np.ndarray:
    """Labels of 4-connected regions of a boolean grid, 1 up in row-major order; 0 outside."""
    h, w = mask.shape
    label = np.where(mask, np.arange(1, h * w + 1).reshape(h, w), 0)
    while True:
        p = np.pad(label, 1)
        big = h * w + 1
        near = np.where(p == 0, big, p)
        new = np.minimum.reduce([near[1:-1, 1:-1], near[:-2, 1:-1], near[2:, 1:-1], near[1:-1, :-2], near[1:-1, 2:]])
        new = np.where(mask, new, 0)
        if (new == label).all():
            break
        label = new
    return np.searchsorted(np.unique(label[mask]), label) * mask + mask if mask.any() else label


def bilinear_weights(n: int, m: int) -> np.ndarray:
    """m x n weights of linear resizing without aligned corners."""
    src = np.maximum((np.arange(m) + 0.5) * n / m - 0.5, 0)
    lo = np.minimum(src.astype(int), n - 1)
    hi = np.minimum(lo + 1, n - 1)
    w = np.zeros((m, n))
    w[np.arange(m), lo] += 1 - (src - lo)
    w[np.arange(m), hi] += src - lo
    return w


def gaussian_weights(n: int, sigma: float) -> np.ndarray:
    """n x n weights of a Gaussian filter truncated at 4 sigma, borders mirrored with the edge repeated."""
    radius = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    k /= k.sum()
    w = np.zeros((n, n))
    for i in range(n):
        for o, v in zip(range(-radius, radius + 1), k):
            j = (i + o) % (2 * n)
            w[i, j if j < n else 2 * n - 1 - j] += v
    return w


def smooth_resize(grid: np.ndarray, out: tuple[int, int], sigma: float) -> np.ndarray:
    """Bilinear resize of grids (..., h, w), then the Gaussian filter."""
    h, w = grid.shape[-2:]
    a, b = bilinear_weights(h, out[0]), bilinear_weights(w, out[1])
    if sigma > 0:
        a, b = gaussian_weights(out[0], sigma) @ a, gaussian_weights(out[1], sigma) @ b
    return np.einsum("ij,...jk,lk->...il", a, grid, b)


def patchify(maps: np.ndarray, k: int, stride: int) -> np.ndarray:
    """(B, C, H, W) to (B, P, C, k, k): zero-padded neighbourhoods, row-major."""
    p = (k - 1) // 2
    b, c, h, w = maps.shape
    x = np.pad(maps, ((0, 0), (0, 0), (p, p), (p, p)))
    win = np.lib.stride_tricks.sliding_window_view(x, (k, k), axis=(2, 3))[:, :, ::stride, ::stride]
    return win.transpose(0, 2, 3, 1, 4, 5).reshape(b, -1, c, k, k)


def adaptive_mean(x: np.ndarray, out: int) -> np.ndarray:
    """Rows of length L to out means over floor/ceil bins."""
    n = x.shape[-1]
    return np.stack([x[..., i * n // out : -(-(i + 1) * n // out)].mean(-1) for i in range(out)], -1)
