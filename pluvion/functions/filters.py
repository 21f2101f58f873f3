"""Filters along an axis of which a part is at hand, with mirrored edges (… b a | a b … y z | z y …)."""

from __future__ import annotations


def mirrored(at, n: int):
    """Positions on an axis of ``n`` cells, those beyond its ends reflected."""
    import numpy as np

    k = np.mod(at, 2 * n)
    return np.where(k < n, k, 2 * n - 1 - k)


def running_max(x, window: int):
    """Maxima of all runs of ``window`` along the last axis, in linear time: maxima from block starts
    and to block ends meet in every run."""
    import numpy as np

    n = x.shape[-1]
    size = -(-n // window) * window
    padded = np.full((*x.shape[:-1], size), -np.inf)
    padded[..., :n] = x
    blocks = padded.reshape(*x.shape[:-1], -1, window)
    ahead = np.maximum.accumulate(blocks, axis=-1).reshape(padded.shape)
    back = np.maximum.accumulate(blocks[..., ::-1], axis=-1)[..., ::-1].reshape(padded.shape)
    return np.maximum(back[..., : n - window + 1], ahead[..., window - 1 : n])


class Part:
    """Values of a grid's cells [start, stop) by axis, in a grid of ``shape`` cells."""

    def __init__(self, values, start: tuple[int, int], shape: tuple[int, int]):
        self.values, self.start, self.shape = values, start, shape

    def reach(self, axis: int, lo: int, hi: int, before: int, after: int):
        """Values at lo - before … hi - 1 + after of an axis, which becomes the last."""
        import numpy as np

        at = mirrored(np.arange(lo - before, hi + after), self.shape[axis]) - self.start[axis]
        return np.moveaxis(np.take(self.values, at, axis=axis), axis, -1)

    def along(self, axis: int, lo: int, hi: int, before: int, after: int, run) -> "Part":
        """``run`` of the windows of cells lo … hi - 1 of an axis."""
        import numpy as np

        values = np.moveaxis(run(self.reach(axis, lo, hi, before, after)), -1, axis)
        start = list(self.start)
        start[axis] = lo
        return Part(values, tuple(start), self.shape)


def smoothed_closing(part: Part, box: tuple[int, int, int, int], size: int, sigma: float):
    """Grey closing with a square of ``size`` and a Gaussian of ``sigma`` (cut at four deviations, in single
    precision per axis) of the cells (r0, r1, c0, c1) of a grid, from a part that holds them and
    ``size`` plus the Gaussian's radius around. An even square lies one cell further back for the erosion,
    one further ahead for the dilation."""
    import numpy as np

    radius, back = int(4 * sigma + 0.5), size // 2
    ahead = size - back - 1
    ranges = [(box[0], box[1]), (box[2], box[3])]
    grow = lambda r, axis, before, after: (max(0, r[0] - before), min(part.shape[axis], r[1] + after))
    smooth = [grow(r, a, radius, radius) for a, r in enumerate(ranges)]
    wide = [grow(r, a, back, ahead) for a, r in enumerate(smooth)]
    for axis in (0, 1):
        part = part.along(axis, *wide[axis], ahead, back, lambda x: running_max(x, size))
    for axis in (0, 1):
        part = part.along(axis, *smooth[axis], back, ahead, lambda x: -running_max(-x, size))
    if radius:
        w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
        w /= w.sum()
        weigh = lambda x: (np.lib.stride_tricks.sliding_window_view(x, len(w), axis=-1) @ w).astype(np.float32).astype(float)
        for axis in (0, 1):
            part = part.along(axis, *ranges[axis], radius, radius, weigh)
    return part.values


def bilinear(values, start: tuple[int, int], shape: tuple[int, int], r, c):
    """Values between cells at grid positions (r, c); missing outside the grid or beside a missing cell that counts."""
    import numpy as np

    inside = (r >= 0) & (c >= 0) & (r <= shape[0] - 1) & (c <= shape[1] - 1)
    r, c = np.where(inside, r, start[0]), np.where(inside, c, start[1])
    r0, c0 = np.floor(r).astype(int), np.floor(c).astype(int)
    fr, fc = r - r0, c - c0
    # A neighbour of no weight is replaced by the cell itself, so that it need not be there.
    r1, c1 = np.where(fr > 0, r0 + 1, r0) - start[0], np.where(fc > 0, c0 + 1, c0) - start[1]
    r0, c0 = r0 - start[0], c0 - start[1]
    out = (values[r0, c0] * (1 - fc) + values[r0, c1] * fc) * (1 - fr) + (values[r1, c0] * (1 - fc) + values[r1, c1] * fc) * fr
    return np.where(inside, out, np.nan)
