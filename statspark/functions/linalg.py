"""Small dense linear algebra on the driver: least squares from moments, eigenvectors, rotations."""

from __future__ import annotations

from typing import Any

import numpy as np

from ..model import data_error


def fixed_signs(vectors: np.ndarray) -> np.ndarray:
    """Columns turned so that the entry of largest size is positive."""
    top = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
    return vectors * np.where(top < 0, -1.0, 1.0)


def inverse_root(matrix: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh(matrix)
    if values.min() <= max(values.max(), 0) * 1e-12:
        raise data_error("columns of a set are linearly dependent")
    return vectors @ np.diag(values**-0.5) @ vectors.T


def canonical_correlations(found: Any, p: int, standardize: bool, ridge: float, k: int) -> dict[str, Any]:
    """Correlations, loadings and redundancies from a covariance matrix whose first p columns are x."""
    n = found.n
    cov = found.cross / (n - 1)
    if standardize:
        scale = np.sqrt(np.diag(found.cross) / n)
        cov = cov / np.outer(scale, scale)
    xx, yy, xy = cov[:p, :p], cov[p:, p:], cov[:p, p:]
    rx, ry = inverse_root(xx + ridge * np.eye(p)), inverse_root(yy + ridge * np.eye(len(yy)))
    u, r, vt = np.linalg.svd(rx @ xy @ ry, full_matrices=False)
    turn = np.where(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])] < 0, -1.0, 1.0)
    a, b = rx @ (u * turn), ry @ (vt.T * turn)

    def loadings(s: np.ndarray, w: np.ndarray, own: np.ndarray, sd: np.ndarray) -> np.ndarray:
        """Correlations of columns (covariances s with the other side's scores) with scores."""
        spread = np.sqrt(np.einsum("ij,ik,kj->j", w, own, w))
        return s @ w / np.outer(sd, spread)

    sx, sy = np.sqrt(np.diag(xx)), np.sqrt(np.diag(yy))
    x_own, y_own = loadings(xx, a, xx, sx)[:, :k], loadings(yy, b, yy, sy)[:, :k]
    x_cross, y_cross = loadings(xy, b, yy, sx)[:, :k], loadings(xy.T, a, xx, sy)[:, :k]
    r = np.clip(r, 0, 1)
    return {
        "r": [float(v) for v in r[:k]], "all_r": r, "x_loadings": x_own, "y_loadings": y_own, "x_cross": x_cross, "y_cross": y_cross,
        "x_redundancy": [float(v) for v in (x_own**2).mean(axis=0) * r[:k] ** 2], "y_redundancy": [float(v) for v in (y_own**2).mean(axis=0) * r[:k] ** 2],
        "x_weights": a[:, :k], "y_weights": b[:, :k],
    }


def varimax(loadings: np.ndarray, rounds: int = 50, tolerance: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Rotated loadings and the rotation."""
    p, k = loadings.shape
    rotation, before = np.eye(k), 0.0
    for _ in range(rounds):
        turned = loadings @ rotation
        u, s, vt = np.linalg.svd(loadings.T @ (turned**3 - turned * (turned**2).sum(axis=0) / p))
        rotation = u @ vt
        if before and s.sum() < before * (1 + tolerance):
            break
        before = s.sum()
    return loadings @ rotation, rotation


class Gram:
    """Normal equations of y on columns, from their joint second moments (y last)."""

    def __init__(self, found: Any, intercept: bool) -> None:
        self.n = float(found.n)
        self.mean = found.mean
        self.intercept = intercept
        if intercept:
            self.xx, self.xy, self.yy = found.cross[:-1, :-1], found.cross[:-1, -1], float(found.cross[-1, -1])
        else:
            raw = found.cross + self.n * np.outer(found.mean, found.mean)
            self.xx, self.xy, self.yy = raw[:-1, :-1], raw[:-1, -1], float(raw[-1, -1])

    def subset(self, keep: list[int]) -> Gram:
        out = object.__new__(Gram)
        out.n, out.intercept = self.n, self.intercept
        out.mean = np.append(self.mean[keep], self.mean[-1])
        out.xx, out.xy, out.yy = self.xx[np.ix_(keep, keep)], self.xy[keep], self.yy
        return out

    def scaled(self, scale: np.ndarray, centre: np.ndarray) -> Gram:
        """The equations after centring and scaling the columns; needs the centred form or a zero centre."""
        out = object.__new__(Gram)
        out.n, out.intercept = self.n, self.intercept
        out.mean = np.append((self.mean[:-1] - centre) / scale, self.mean[-1])
        if self.intercept:
            xx, xy = self.xx, self.xy
        else:
            m = self.mean[:-1]
            xx = self.xx - self.n * (np.outer(centre, m) + np.outer(m, centre) - np.outer(centre, centre))
            xy = self.xy - self.n * centre * self.mean[-1]
        out.xx, out.xy, out.yy = xx / np.outer(scale, scale), xy / scale, self.yy
        return out

    def solve(self, ridge: float = 0.0, names: list[str] | None = None) -> tuple[np.ndarray, float]:
        """Coefficients and intercept."""
        matrix = self.xx + ridge * np.eye(len(self.xx))
        scale = np.sqrt(np.maximum(np.diag(matrix), 1e-300))
        unit = matrix / np.outer(scale, scale)
        if np.linalg.eigvalsh(unit).min() < 1e-11:
            raise data_error("columns are linearly dependent", columns=names)
        w = np.linalg.solve(unit, self.xy / scale) / scale
        return w, float(self.mean[-1] - self.mean[:-1] @ w) if self.intercept else 0.0

    def residual_square(self, w: np.ndarray) -> float:
        return max(0.0, self.yy - 2 * float(w @ self.xy) + float(w @ self.xx @ w))

    def inverse(self) -> np.ndarray:
        """Inverse of the full cross product with the intercept first."""
        inner = np.linalg.inv(self.xx)
        if not self.intercept:
            return inner
        m = self.mean[:-1]
        side = -inner @ m
        top = 1 / self.n + m @ inner @ m
        return np.block([[np.array([[top]]), side[None, :]], [side[:, None], inner]])
