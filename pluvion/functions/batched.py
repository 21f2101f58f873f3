"""Small fits of many cells at once: the first axis of every array is the cell."""

from __future__ import annotations

import math


def normal_cdf(z):
    import numpy as np

    return np.asarray(np.frompyfunc(lambda v: 0.5 * math.erfc(-v / math.sqrt(2)), 1, 1)(z), float)


def crps_normal(mu, sigma, seen):
    """The continuous ranked probability score of normal forecasts, in closed form."""
    import numpy as np

    s = np.maximum(sigma, 1e-12)
    z = (seen - mu) / s
    return s * (z * (2 * normal_cdf(z) - 1) + 2 * np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi) - 1 / math.sqrt(math.pi))


def simplex(cost, start, tolerance: float = 1e-9, rounds: int = 600):
    """The minima of cells' costs by downhill simplices (Nelder and Mead, 1965), all moved together.

    ``cost(points, cells)`` takes one point for each of the listed cells. A cell rests once the corners of its
    simplex and their costs lie within ``tolerance``; the others go on. Each round a cell's worst corner is
    reflected, stretched or contracted through the others' middle, or all corners shrink towards the best.
    """
    import numpy as np

    start = np.asarray(start, float)
    n, d = start.shape
    corners = np.repeat(start[:, None, :], d + 1, axis=1)
    for k in range(d):
        x = corners[:, k + 1, k]
        corners[:, k + 1, k] = np.where(x != 0, 1.05 * x, 2.5e-4)
    everyone = np.arange(n)
    values = np.stack([cost(corners[:, k], everyone) for k in range(d + 1)], axis=1)
    for _ in range(rounds):
        order = np.argsort(values, axis=1, kind="stable")
        corners, values = np.take_along_axis(corners, order[:, :, None], 1), np.take_along_axis(values, order, 1)
        wide = np.abs(corners[:, 1:] - corners[:, :1]).max(axis=(1, 2)) > tolerance
        at = np.flatnonzero(wide | (np.abs(values[:, 1:] - values[:, :1]).max(axis=1) > tolerance))
        if not len(at):
            break
        middle, worst = corners[at, :-1].mean(axis=1), corners[at, -1]
        reflected = 2 * middle - worst
        low = cost(reflected, at)
        best, second, last = values[at, 0], values[at, -2], values[at, -1]
        # Where to look next: beyond the reflection, between it and the middle, or between worst and middle.
        ahead, outside = low < best, (low >= second) & (low < last)
        inside = low >= last
        other = np.where(ahead[:, None], 3 * middle - 2 * worst, np.where(outside[:, None], 1.5 * middle - 0.5 * worst, 0.5 * (middle + worst)))
        tried = np.full(len(at), np.inf)
        look = ahead | outside | inside
        if look.any():
            tried[look] = cost(other[look], at[look])
        use_other = (ahead & (tried < low)) | (outside & (tried <= low)) | (inside & (tried < last))
        use_reflected = ~use_other & ~outside & ~inside
        moved = use_other | use_reflected
        corners[at[moved], -1] = np.where(use_other[moved, None], other[moved], reflected[moved])
        values[at[moved], -1] = np.where(use_other[moved], tried[moved], low[moved])
        shrunk = at[~moved]
        if len(shrunk):
            corners[shrunk, 1:] = 0.5 * (corners[shrunk, 1:] + corners[shrunk, :1])
            for k in range(1, d + 1):
                values[shrunk, k] = cost(corners[shrunk, k], shrunk)
    best = values.argmin(axis=1)
    return corners[everyone, best], values[everyone, best]


def fit_spread(mu, sigma, seen, constrained: bool = True, least: int = 3):
    """Factors (a, b) of each cell so that a mu and b sigma describe what was seen; missing values are nan.

    constrained: a is the slope, and b makes up the variance that a leaves. Else both minimise the mean
    CRPS, from there on. Missing with fewer than ``least`` values or where forecasts or spreads do not vary.
    """
    import numpy as np

    ok = np.isfinite(mu) & np.isfinite(sigma) & np.isfinite(seen)
    n = np.maximum(ok.sum(1), 1)
    mean = lambda x: np.where(ok, x, 0.0).sum(1) / n
    dm, do = mu - mean(mu)[:, None], seen - mean(seen)[:, None]
    var_m, var_o, spread = mean(dm * dm), mean(do * do), mean(sigma * sigma)
    fine = (ok.sum(1) >= least) & (var_m >= 1e-12) & (spread >= 1e-12)
    with np.errstate(invalid="ignore", divide="ignore"):
        a = np.where(fine, mean(dm * do) / var_m, np.nan)
        b = np.where(fine, np.sqrt(np.maximum(var_o - a * a * var_m, 0.0) / spread), np.nan)
    if constrained or not fine.any():
        return a, b
    at = np.flatnonzero(fine)
    m, s, o, used = (np.where(ok, x, 0.0)[at] for x in (mu, sigma, seen, ok))
    used = used.astype(bool)

    def cost(p, cells):
        score = crps_normal(p[:, :1] * m[cells], np.abs(p[:, 1:]) * s[cells], o[cells])
        return np.where(used[cells], score, 0.0).sum(1) / used[cells].sum(1)

    best, _ = simplex(cost, np.stack([a[at], np.maximum(b[at], 1e-3)], axis=1))
    a[at], b[at] = best[:, 0], np.abs(best[:, 1])
    return a, b


def softmax_fit(x, label, classes: int, ridge: float = 1e-6, rounds: int = 300):
    """Intercepts and slopes (cells, classes, 2) of a multinomial logit of ``label`` (-1: missing) on ``x``, by
    Newton steps, and which classes a cell has. ``ridge`` holds slopes and, far less, intercepts, so
    that separable cells end at large but finite slopes. A class that a cell lacks has no part.
    """
    import numpy as np

    x = np.broadcast_to(np.asarray(x, float), label.shape)
    known = label >= 0
    y = (label[:, :, None] == np.arange(classes)) & known[:, :, None]
    has = y.any(1)
    n = np.maximum(known.sum(1), 1)
    centre = np.where(known, x, 0.0).sum(1) / n
    scale = np.sqrt(np.where(known, (x - centre[:, None]) ** 2, 0.0).sum(1) / n)
    scale = np.where(scale > 0, scale, 1.0)
    u = np.where(known, (x - centre[:, None]) / scale[:, None], 0.0)
    design = np.stack([np.ones_like(u), u], axis=-1) * known[:, :, None]
    theta = np.zeros((len(u), classes, 2))
    held = np.stack([np.full(len(u), 1e-9), ridge / scale**2], axis=-1)[:, None, :] * np.ones((1, classes, 1))
    absent = np.where(has, 0.0, -np.inf)[:, None, :]

    def shares(theta, at):
        """Probabilities, and the held likelihood that the steps raise."""
        eta = np.einsum("ctk,cgk->ctg", design[at], theta) + absent[at]
        eta = eta - eta.max(-1, keepdims=True)
        p = np.exp(eta)
        total = p.sum(-1, keepdims=True)
        told = np.where(y[at], eta, 0.0).sum((1, 2)) - (np.log(total[..., 0]) * known[at]).sum(1)
        return p / total, told - 0.5 * (held[at] * theta**2).sum((1, 2))

    live = np.flatnonzero(has.sum(1) > 1)
    for _ in range(rounds):
        if not len(live):
            break
        d, w = design[live], known[live]
        p, level = shares(theta[live], live)
        p = p * w[:, :, None]
        slope = np.einsum("ctg,ctk->cgk", y[live] - p, d) - held[live] * theta[live]
        slope[~has[live]] = 0.0
        weight = np.einsum("ctg,gh->ctgh", p, np.eye(classes)) - p[..., :, None] * p[..., None, :]
        bend = np.einsum("ctgh,ctk,ctl->cgkhl", weight, d, d).reshape(len(live), 2 * classes, 2 * classes)
        held_flat = np.where(has[live][:, :, None], held[live], 1.0).reshape(len(live), -1)
        bend += np.eye(2 * classes) * held_flat[:, None, :]
        step = np.linalg.solve(bend, slope.reshape(len(live), -1, 1))[..., 0].reshape(slope.shape)
        for _ in range(40):  # a step that lowers the likelihood is halved
            worse = shares(theta[live] + step, live)[1] < level - 1e-12 * np.maximum(1.0, np.abs(level))
            if not worse.any():
                break
            step[worse] *= 0.5
        theta[live] += step
        live = live[np.abs(step).max(axis=(1, 2)) > 1e-10]
    out = theta.copy()
    out[..., 1] = theta[..., 1] / scale[:, None]
    out[..., 0] = theta[..., 0] - out[..., 1] * centre[:, None]
    return out, has


def softmax_at(theta, has, at: float):
    """Probabilities of the classes of each cell at a value of x."""
    import numpy as np

    eta = np.where(has, theta[..., 0] + theta[..., 1] * at, -np.inf)
    eta = eta - np.where(has.any(1, keepdims=True), eta.max(1, keepdims=True), 0.0)
    p = np.where(has, np.exp(np.where(has, eta, 0.0)), 0.0)
    total = p.sum(1, keepdims=True)
    return np.where(total > 0, p / np.where(total > 0, total, 1.0), np.nan)


def wald_p(x, label, theta):
    """Two-sided p of the slope between two classes 0 and 1, from the information of the fit."""
    import numpy as np

    x = np.broadcast_to(np.asarray(x, float), label.shape)
    known = label >= 0
    beta = theta[:, 1] - theta[:, 0]
    p = 1 / (1 + np.exp(-np.clip(beta[:, :1] + beta[:, 1:] * np.where(known, x, 0.0), -30, 30)))
    w = p * (1 - p) * known
    s0, s1 = w.sum(1), (w * np.where(known, x, 0.0)).sum(1)
    with np.errstate(invalid="ignore", divide="ignore"):
        s2 = (w * (np.where(known, x, 0.0) - (s1 / s0)[:, None]) ** 2).sum(1)
        z = np.abs(beta[:, 1]) * np.sqrt(s2)
    return np.array([math.erfc(v / math.sqrt(2)) if np.isfinite(v) else np.nan for v in z])


def loo_correlation(x, y, least: int = 5):
    """The correlation of leave-one-out predictions of a line with y, in closed form; y may have rows."""
    import numpy as np

    x, y = np.asarray(x, float), np.atleast_2d(np.asarray(y, float))
    n, dx = len(x), x - x.mean()
    sxx = (dx * dx).sum()
    if n < least or sxx == 0:
        return np.full(len(y), np.nan)
    lever = 1 / n + dx * dx / sxx
    my = y.mean(1, keepdims=True)
    fit = my + ((y - my) @ dx / sxx)[:, None] * dx
    with np.errstate(invalid="ignore", divide="ignore"):
        told = y - (y - fit) / (1 - lever)
        dt, dy = told - told.mean(1, keepdims=True), y - my
        r = (dt * dy).sum(1) / np.sqrt((dt * dt).sum(1) * (dy * dy).sum(1))
    return np.where((dt * dt).sum(1) > 0, r, np.nan)


def _mixed(v):
    """64 bits stirred (the finaliser of Stafford's variant 13); numbers wrap."""
    import numpy as np

    with np.errstate(over="ignore"):
        v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


def orders(seed: int, cell: int, first: int, count: int, n: int):
    """Random orders of n things for draws first … first + count - 1 of a cell. An order hangs on
    seed, cell and draw alone, so any task makes the same."""
    import numpy as np

    with np.errstate(over="ignore"):
        base = _mixed(np.array([(seed ^ (cell * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF], np.uint64))
        draw = _mixed(base + np.arange(first + 1, first + count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        keys = _mixed(draw[:, None] + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    return np.argsort(keys, axis=1, kind="stable")
