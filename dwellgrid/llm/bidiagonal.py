"""Singular values and leading right singular vectors of a small square matrix by way of its bidiagonal form."""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(np.float64).eps)
# Squares of neighbouring singular values nearer than this share of the larger one are solved as a group.
GROUP_GAP = 1e-3


def bidiagonalised(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(a, b, v)``: diagonal and upper diagonal of ``uᵀ r v`` by Householder reflections from either side, and ``v``."""
    m = np.array(r, np.float64)
    n = m.shape[1]
    v = np.eye(n)
    for k in range(n):
        mirror = _mirror(m[k:, k])
        if mirror is not None:
            m[k:, k:] -= 2.0 * np.outer(mirror, mirror @ m[k:, k:])
        if k < n - 2:
            mirror = _mirror(m[k, k + 1 :])
            if mirror is not None:
                m[k:, k + 1 :] -= 2.0 * np.outer(m[k:, k + 1 :] @ mirror, mirror)
                v[:, k + 1 :] -= 2.0 * np.outer(v[:, k + 1 :] @ mirror, mirror)
    return np.diagonal(m).copy(), np.diagonal(m, 1).copy(), v


def _mirror(x: np.ndarray) -> np.ndarray | None:
    """Unit vector whose reflection maps ``x`` to a multiple of the first axis; None where nothing is to be done."""
    if not np.any(x[1:]):
        return None
    scaled = x / np.abs(x).max()
    u = scaled.copy()
    u[0] += np.copysign(np.linalg.norm(scaled), scaled[0])
    return u / np.linalg.norm(u)


def squared_singular_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squares of the singular values of the bidiagonal matrix, descending, by differential qd steps with shifts.

    Each shift is a lower bound of the smallest value that is left, so no step loses positivity but by rounding; such a
    step is done again without a shift.  A split or a deflation needs a coupling that is negligible at double precision.
    """
    found: list[float] = []
    work = [(np.square(a).tolist(), np.square(b).tolist(), 0.0)]
    tiny = (EPS * EPS) * max([*np.square(a), *np.square(b), 0.0]) * EPS
    while work:
        q, e, moved = work.pop()
        while q:
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= EPS * EPS * (moved + q[i + 1]) + tiny), None)
            if len(q) == 1:
                found.append(moved + q[0])
                break
            if cut is not None:
                work.append((q[: cut + 1], e[:cut], moved))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if q[0] < q[-1] / 2:
                q, e = q[::-1], e[::-1]
            shift = _lower_bound(q, e)
            step = _qd_step(q, e, shift) if shift > 0 else None
            if step is None:
                shift, step = 0.0, _qd_step(q, e, 0.0)
            moved += shift
            q, e = step
    return np.array(sorted(found, reverse=True))


def _lower_bound(q: list[float], e: list[float]) -> float:
    """One over the trace of the inverse, from positive terms only: at most the smallest value."""
    if min(q) <= 0.0:
        return 0.0
    term = total = 1.0 / q[0]
    for i in range(1, len(q)):
        term = (1.0 + e[i - 1] * term) / q[i]
        total += term
    return (1.0 - 8 * EPS * len(q)) / total


def _qd_step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One differential qd step; None if a value that must be positive is not."""
    new_q, new_e, d = [], [], q[0] - shift
    for i in range(len(e)):
        if d < 0.0:
            return None
        total = d + e[i]
        ratio = q[i + 1] / total
        new_q.append(total)
        new_e.append(e[i] * ratio)
        d = d * ratio - shift
    return None if d < 0.0 else (new_q + [d], new_e)


def _twisted(a: np.ndarray, b: np.ndarray, value: float) -> np.ndarray:
    """Unit eigenvector of ``Bᵀ B`` for an eigenvalue, from the factorisation twisted where its pivot is smallest."""
    n, d = len(a), np.square(a)
    d = np.where(d > 0.0, d, EPS * EPS * max(d.max(), 1e-300))
    link = b / np.where(a != 0.0, a, np.sqrt(d))[: n - 1]
    least = EPS * EPS * max(value, d.max())
    down, s = np.empty(n - 1), np.empty(n)
    s[0] = -value
    for i in range(n - 1):
        pivot = s[i] + d[i]
        pivot = pivot if abs(pivot) > least else -least
        down[i] = d[i] * link[i] / pivot
        s[i + 1] = down[i] * link[i] * s[i] - value
    up, p = np.empty(n - 1), np.empty(n)
    p[-1] = d[-1] - value
    for i in range(n - 2, -1, -1):
        pivot = d[i] * link[i] ** 2 + p[i + 1]
        pivot = pivot if abs(pivot) > least else -least
        up[i] = link[i] * d[i] / pivot
        p[i] = p[i + 1] * (d[i] / pivot) - value
    twist = int(np.argmin(np.abs(s + p + value)))
    z = np.zeros(n)
    z[twist] = 1.0
    for i in range(twist - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(twist, n - 1):
        z[i + 1] = -up[i] * z[i]
    return z / np.linalg.norm(z)


def _group_vectors(t: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Orthonormal eigenvectors for values that lie close together: inverse iteration on all of them at once."""
    n, m = len(t), len(values)
    scale = max(float(np.abs(t).max()), 1e-300)
    x = np.linalg.qr(np.random.default_rng(0).normal(size=(n, m)))[0]
    shift = values.mean() + 4 * EPS * scale
    for _ in range(4):
        x = np.linalg.qr(np.linalg.solve(t - shift * np.eye(n) + EPS * scale * np.diag(np.linspace(0, 1, n)), x))[0]
    weights, turn = np.linalg.eigh(x.T @ t @ x)
    return x @ turn[:, ::-1]


def leading_directions(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """``(squares, vectors)``: all squared singular values of ``r`` descending, and unit right singular vectors of the
    first ``most`` of them as columns.

    Blocks between zero couplings are solved on their own.  Values that are alone get their vector from a twisted
    factorisation, values close together, or all but zero, get theirs as one subspace.
    """
    a, b, v = bidiagonalised(r)
    n = len(a)
    top = max(float(np.abs(a).max()), float(np.abs(b).max()) if n > 1 else 0.0)
    if top == 0.0:
        return np.zeros(n), v[:, :most]
    a, b = a / top, b / top  # keeps squares in range
    cuts = [0, *(i + 1 for i in range(n - 1) if abs(b[i]) <= EPS * (abs(a[i]) + abs(a[i + 1]))), n]
    pairs: list[tuple[float, np.ndarray]] = []
    for first, end in zip(cuts, cuts[1:]):
        own_a, own_b = a[first:end], b[first : end - 1]
        squares = squared_singular_values(own_a, own_b)
        t = np.diag(own_a**2 + np.r_[0.0, own_b**2]) + np.diag(own_a[:-1] * own_b, 1) + np.diag(own_a[:-1] * own_b, -1)
        at = 0
        while at < len(squares):
            to = at + 1
            while to < len(squares) and (
                squares[to - 1] - squares[to] <= GROUP_GAP * squares[to - 1] or squares[to - 1] <= (4 * n * EPS) ** 2
            ):
                to += 1
            alone = to - at == 1 and len(squares) > 1
            vectors = _twisted(own_a, own_b, squares[at])[:, None] if alone else (
                np.ones((1, 1)) if len(squares) == 1 else _group_vectors(t, squares[at:to])
            )
            for i in range(at, to):
                whole = np.zeros(n)
                whole[first:end] = vectors[:, i - at]
                pairs.append((squares[i], whole))
            at = to
    pairs.sort(key=lambda pair: -pair[0])
    chosen = np.stack([z for _, z in pairs[:most]], axis=1)
    return np.array([s for s, _ in pairs]) * top**2, v @ chosen
