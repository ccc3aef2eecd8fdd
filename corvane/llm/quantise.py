"""Score-aware quantisation of vectors for maximum inner product search.

A vector is its cell's centroid plus a residual, whose subspaces of a few dimensions are each one of sixteen centres. Assignment and
centres minimise an anisotropic loss: error parallel to the vector, which shifts the scores that matter, weighs more than error
across it. A query scores a cell by a table of its products with all centres and one table look-up per subspace.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

CENTRES = 16


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Spherical k-means; an emptied cell restarts at a random row."""
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1)
        empty = norm < 1e-9
        total[empty] = x[rng.choice(len(x), int(empty.sum()))]
        norm[empty] = 1
        c = total / norm[:, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray, block: int = 4096) -> np.ndarray:
    return np.concatenate([(x[i : i + block] @ c.T).argmax(1) for i in range(0, len(x), block)]) if len(x) else np.empty(0, np.int64)


def closest(x: np.ndarray, c: np.ndarray, block: int = 4096) -> np.ndarray:
    """The nearest centre by distance."""
    half = (c * c).sum(1) / 2
    return np.concatenate([(x[i : i + block] @ c.T - half).argmax(1) for i in range(0, len(x), block)]) if len(x) else np.empty(0, np.int64)


def lloyd(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Plain k-means; an emptied cell restarts at a random row."""
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = closest(x, c)
        total, n = np.zeros_like(c), np.bincount(near, minlength=k)
        np.add.at(total, near, x)
        empty = n == 0
        total[empty] = x[rng.choice(len(x), int(empty.sum()))]
        c = total / np.maximum(n, 1)[:, None]
    return c


@dataclass
class Quantiser:
    """Centroids of cells, the centres of each subspace, and the weight of parallel error.

    A cell is a coarse centroid and a fine one, of what is left of a vector beside it: few training rows so make
    as many cells as the product. With one fine centroid, the origin, cells are the coarse ones.
    """

    coarse: np.ndarray
    fine: np.ndarray
    centres: np.ndarray  # subspaces x 16 x width
    eta: float
    slack: float = 0.0

    def centroid(self, cell: int) -> np.ndarray:
        return self.coarse[cell // len(self.fine)] + self.fine[cell % len(self.fine)]

    def nearest_cells(self, x: np.ndarray, n: int) -> np.ndarray:
        """``(rows, n)`` cells nearest to unit vectors; fewer where there are fewer cells."""
        c, f = self.coarse.astype(np.float32), self.fine.astype(np.float32)
        top = min(n if len(f) == 1 else 4, len(c))
        near = np.argpartition(-(x @ c.T), top - 1, axis=1)[:, :top] if top < len(c) else np.tile(np.arange(top), (len(x), 1))
        if len(f) == 1:
            return near
        each = min(n, len(f))
        cells, away = [], []
        for k in range(top):
            r = x - c[near[:, k]]
            d = (r * r).sum(1)[:, None] - 2 * (r @ f.T) + (f * f).sum(1)[None, :]
            best = np.argpartition(d, each - 1, axis=1)[:, :each] if each < len(f) else np.tile(np.arange(each), (len(x), 1))
            cells.append(near[:, k, None] * len(f) + best)
            away.append(np.take_along_axis(d, best, 1))
        cells, away = np.concatenate(cells, 1), np.concatenate(away, 1)
        return np.take_along_axis(cells, np.argsort(away, axis=1, kind="stable")[:, :n], 1)

    @classmethod
    def fit(cls, x: np.ndarray, cells: int, *, fine: int = 1, width: int = 4, threshold: float = 0.5, rounds: int = 8, seed: int = 7) -> Quantiser:
        """From unit vectors; ``threshold`` is the score from which on errors matter, it fixes the loss's weight."""
        rng = np.random.default_rng(seed)
        d = x.shape[1]
        parts = -(-d // width)
        cells = max(1, min(cells, len(x)))
        coarse = kmeans(x, cells, rounds, rng)
        left = x - coarse[nearest(x, coarse)]
        second = lloyd(left, min(fine, len(x)), rounds, rng) if fine > 1 else np.zeros((1, d))
        eta = max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))
        some = rng.permutation(len(x))[:16384]
        rows, left = x[some], left[some]
        if fine > 1:
            left = left - second[closest(left, second)]
        r = cls._pad(left, parts * width).reshape(-1, parts, width)
        picks = rng.choice(len(r), CENTRES, replace=len(r) < CENTRES)
        q = cls(coarse, second, np.ascontiguousarray(r[picks].transpose(1, 0, 2)), eta)
        u = cls._pad(rows, parts * width).reshape(-1, parts, width)
        for _ in range(rounds):
            codes = q._codes(r, u)
            q._update(r, u, codes)
        return q

    @staticmethod
    def _pad(x: np.ndarray, d: int) -> np.ndarray:
        return x if x.shape[1] == d else np.pad(x, ((0, 0), (0, d - x.shape[1])))

    def _codes(self, r: np.ndarray, u: np.ndarray, passes: int = 2) -> np.ndarray:
        """Coordinate descent on the loss: each subspace in turn takes the centre best for the whole vector."""
        n, parts, _ = r.shape
        cross = np.empty((parts, n, CENTRES), np.float32)
        along = np.empty((parts, n, CENTRES), np.float32)
        for m in range(parts):
            diff = r[:, m, None, :] - self.centres[m][None]
            cross[m] = (diff * diff).sum(2)
            along[m] = np.einsum("nkw,nw->nk", diff, u[:, m])
        codes = cross.argmin(2).T.copy()
        at = np.arange(n)
        par = sum(along[m][at, codes[:, m]] for m in range(parts))
        for _ in range(passes):
            for m in range(parts):
                rest = par - along[m][at, codes[:, m]]
                loss = cross[m] + (self.eta - 1) * (rest[:, None] + along[m]) ** 2
                codes[:, m] = loss.argmin(1)
                par = rest + along[m][at, codes[:, m]]
        return codes.astype(np.uint8)

    def _update(self, r: np.ndarray, u: np.ndarray, codes: np.ndarray) -> None:
        n, parts, width = r.shape
        at = np.arange(n)
        residual = r - self.centres[np.arange(parts)[None, :], codes]
        par_m = (residual * u).sum(2)
        par = par_m.sum(1)
        for m in range(parts):
            other = par - par_m[:, m]
            for k in range(CENTRES):
                i = at[codes[:, m] == k]
                if not len(i):
                    continue
                um, rm = u[i, m], r[i, m]
                left = len(i) * np.eye(width) + (self.eta - 1) * um.T @ um
                right = rm.sum(0) + (self.eta - 1) * (um * ((rm * um).sum(1) + other[i])[:, None]).sum(0)
                self.centres[m, k] = np.linalg.solve(left, right)
            residual[:, m] = r[:, m] - self.centres[m][codes[:, m]]
            par_m[:, m] = (residual[:, m] * u[:, m]).sum(1)
            par = other + par_m[:, m]

    def encode(self, x: np.ndarray, cell: int) -> np.ndarray:
        """``(rows, subspaces)`` four-bit codes of unit vectors stored in a cell."""
        parts, _, width = self.centres.shape
        d = parts * width
        r = self._pad(x - self.centroid(cell), d).reshape(-1, parts, width)
        return self._codes(r.astype(np.float32), self._pad(x, d).reshape(-1, parts, width).astype(np.float32))

    def scan(self, queries: np.ndarray, codes: np.ndarray, cell: int) -> np.ndarray:
        """``(rows, queries)`` scores of stored codes: a table look-up per subspace, for a block of queries at once."""
        parts, _, width = self.centres.shape
        q = self._pad(queries, parts * width).reshape(-1, parts, width).astype(np.float32)
        out = np.broadcast_to((queries @ self.centroid(cell)).astype(np.float32), (len(codes), len(queries))).copy()
        for m in range(parts):
            table = self.centres[m].astype(np.float32) @ q[:, m].T
            out += table[codes[:, m]]
        return out

    def measure(self, x: np.ndarray, quantile: float) -> None:
        """Sets ``slack``: by how much a score near the vector itself is understated at the quantile, on training rows."""
        home = self.nearest_cells(x.astype(np.float32), 1)[:, 0]
        under = []
        for c in np.unique(home):
            own = x[home == c]
            codes = self.encode(own, c)
            parts = np.arange(self.centres.shape[0])
            back = self.centroid(c) + self.centres[parts[None, :], codes].reshape(len(own), -1)[:, : x.shape[1]]
            noise = np.random.default_rng(int(c)).normal(size=own.shape)
            noise -= (noise * own).sum(1, keepdims=True) * own
            near = 0.95 * own + np.sqrt(1 - 0.95**2) * unit(noise)
            under.append((near * (own - back)).sum(1))
        self.slack = float(np.quantile(np.concatenate(under), quantile)) if under else 0.0
