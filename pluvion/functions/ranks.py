"""Rank correlation of many short series at once."""

from __future__ import annotations


def inversions(a):
    """Pairs of a row (last axis) whose first is larger than its second: merge sort from the bottom
    up, all rows at once. Before two runs are merged, a stable sort of both tells how many of the left run
    each of the right run overtakes."""
    import numpy as np

    n = a.shape[-1]
    size = 1 << max(0, n - 1).bit_length()
    runs = np.full((*a.shape[:-1], size), np.inf)
    runs[..., :n] = a
    count, width = np.zeros(a.shape[:-1], np.int64), 1
    while width < size:
        pairs = runs.reshape(*a.shape[:-1], -1, 2 * width)
        order = np.argsort(pairs, axis=-1, kind="stable")
        # Left runs come first among equals, so an element of the right run at merged place m, being the
        # k-th of its run, has m - k of the left run at or below it.
        place = np.broadcast_to(np.arange(2 * width), order.shape)
        right = order >= width
        count += (width * width - (np.where(right, place, 0).sum(-1) - width * (width - 1) // 2)).sum(-1)
        runs = np.take_along_axis(pairs, order, axis=-1)
        width *= 2
    return count


def _tied(ordered, valid):
    """Pairs of equal neighbours in sorted rows: an element adds its place within its run."""
    import numpy as np

    place = np.arange(ordered[0].shape[-1])
    new = np.ones(ordered[0].shape, bool)
    new[..., 1:] = np.any([x[..., 1:] != x[..., :-1] for x in ordered], axis=0)
    start = np.maximum.accumulate(np.where(new, place, 0), axis=-1)
    return ((place - start) * valid).sum(-1)


def kendall(x, y, least: int = 2):
    """Kendall's tau-b along the last axis, without pairs of which either is missing; missing with fewer than
    ``least`` pairs or where a side is constant."""
    import numpy as np

    x, y = np.broadcast_arrays(np.asarray(x, float), np.asarray(y, float))
    known = np.isfinite(x) & np.isfinite(y)
    m = known.sum(-1)
    x, y = np.where(known, x, np.inf), np.where(known, y, np.inf)
    order = np.lexsort((y, x), axis=-1)
    xs, ys, valid = np.take_along_axis(x, order, -1), np.take_along_axis(y, order, -1), np.take_along_axis(known, order, -1)
    all_pairs, tied_x, both = m * (m - 1) // 2, _tied([xs], valid), _tied([xs, ys], valid)
    tied_y = _tied([np.sort(y, axis=-1)], valid)  # valid ones come first there too
    apart = all_pairs - tied_x - tied_y + both - 2 * inversions(ys)
    scale = np.sqrt((all_pairs - tied_x).astype(float) * (all_pairs - tied_y))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where((m >= least) & (scale > 0), apart / scale, np.nan)
