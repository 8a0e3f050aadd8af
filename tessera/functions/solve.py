"""Small dense solvers, run on one matrix at a time inside group functions."""

from __future__ import annotations

import numpy as np

from tessera.errors import OptimizationError


def psd(cov: np.ndarray) -> np.ndarray:
    """The symmetric part with negative eigenvalues cut to 0."""
    sym = (cov + cov.T) / 2
    values, vectors = np.linalg.eigh(sym)
    return sym if values[0] >= 0 else (vectors * np.maximum(values, 0)) @ vectors.T


def condition(cov: np.ndarray) -> float:
    values = np.linalg.eigvalsh(cov)
    return float(values[-1] / max(values[0], 1e-18))


def quadratic(p: np.ndarray, q: np.ndarray, g: np.ndarray, h: np.ndarray, a: np.ndarray, b: np.ndarray, tol: float = 1e-9, rounds: int = 200) -> np.ndarray:
    """argmin of x'px/2 + q'x with gx <= h and ax = b: a primal-dual interior-point method with Mehrotra's corrector.

    p may be 0 (a linear program). Raises unless the residuals of the optimality
    conditions all come below tol, so infeasible and unbounded problems end there.
    """
    n, m, k = len(q), len(h), len(b)
    scale = max(1.0, float(np.abs(p).max(initial=0)), float(np.abs(q).max(initial=0)))
    p, q = p / scale, q / scale
    x, y, z, s = np.zeros(n), np.zeros(k), np.ones(m), np.maximum(h, 1.0)
    for _ in range(rounds):
        rx, ry, rz = p @ x + q + g.T @ z + a.T @ y, a @ x - b, g @ x + s - h
        mu = float(s @ z) / m if m else 0.0
        if max(np.abs(rx).max(initial=0), np.abs(ry).max(initial=0), np.abs(rz).max(initial=0), mu) < tol:
            return x
        if not (np.isfinite(z).all() and (s > 0).all()):
            break
        kkt = np.block([[p + (g.T * (z / s)) @ g + 1e-13 * np.eye(n), a.T], [a, -1e-13 * np.eye(k)]])

        def step(comp: np.ndarray) -> tuple[np.ndarray, ...]:
            right = np.concatenate([-rx - g.T @ ((z * rz - comp) / s), -ry])  # noqa: B023
            d = np.linalg.solve(kkt, right)  # noqa: B023
            dx = d[:n]
            ds = -rz - g @ dx  # noqa: B023
            return dx, d[n:], (-comp - z * ds) / s, ds  # noqa: B023

        def longest(*pairs: tuple[np.ndarray, np.ndarray]) -> float:
            return min([1.0, *[float((-v[d < 0] / d[d < 0]).min()) for v, d in pairs if (d < 0).any()]])

        try:
            _, _, dz, ds = step(s * z)
            far = longest((s, ds), (z, dz))
            sigma = (float((s + far * ds) @ (z + far * dz)) / m / mu) ** 3 if mu else 0.0
            dx, dy, dz, ds = step(s * z + ds * dz - sigma * mu)
        except np.linalg.LinAlgError as e:
            raise OptimizationError(f"singular system: {e}") from e
        far = 0.99 * longest((s, ds), (z, dz)) if m else 1.0
        x, y, z, s = x + far * dx, y + far * dy, z + far * dz, s + far * ds
        if not np.isfinite(x).all() or np.abs(x).max(initial=0) > 1e12:
            break
    raise OptimizationError("the solver didn't converge: infeasible or unbounded")


def linkage_order(distance: np.ndarray, method: str = "single") -> list[int]:
    """Leaves of the agglomerative tree from left to right; of two merged clusters the older one is on the left."""
    n = len(distance)
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, number, leaves = np.ones(n), list(range(n)), [[i] for i in range(n)]
    alive = np.ones(n, bool)
    for made in range(n, 2 * n - 1):
        held = np.where(alive[:, None] & alive[None, :], d, np.inf)
        i, j = np.unravel_index(int(held.argmin()), d.shape)
        dij = d[i, j]
        left, right = (i, j) if number[i] < number[j] else (j, i)
        if method == "single":
            new = np.minimum(d[i], d[j])
        elif method == "complete":
            new = np.maximum(d[i], d[j])
        elif method == "average":
            new = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        else:
            t = size[i] + size[j] + size
            new = np.sqrt(np.maximum(((size[i] + size) * d[i] ** 2 + (size[j] + size) * d[j] ** 2 - size * dij**2) / t, 0))
        leaves[i] = leaves[left] + leaves[right]
        number[i] = made
        size[i] += size[j]
        alive[j] = False
        d[i, :] = d[:, i] = new
        d[i, i] = np.inf
    return leaves[int(np.flatnonzero(alive)[0])]
