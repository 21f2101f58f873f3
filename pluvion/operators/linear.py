"""Dense linear algebra per model or cell: canonical correlation, logistic and cyclic regression.

A group is one model's (or one cell's) years, which is small; groups run apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvion.cube import Cube
from pluvion.functions.special import phi


def cca_fit(x, y, x_modes: int, y_modes: int, modes: int):
    """Canonical correlation of (years, cells) arrays without missing values.

    EOFs of both sides, singular values of the crossed amplitudes, and a regression of y's
    canonical amplitudes on x's. Returns (predict, leverage, correlations).
    """
    import numpy as np

    mx, my = x.mean(0), y.mean(0)
    if not np.any(np.abs(x - mx) > 0):
        raise ValueError("the predictor does not vary")

    def eofs(a, k):
        u, s, v = np.linalg.svd(a, full_matrices=False)
        keep = s[: min(k, len(s))] > 1e-10 * max(s[0], 1e-300)
        k = int(keep.sum())
        return u[:, :k], s[:k], v[:k]

    ux, sx, vx = eofs(x - mx, x_modes)
    uy, sy, vy = eofs(y - my, y_modes)
    a, r, b = np.linalg.svd(ux.T @ uy, full_matrices=False)
    k = min(modes, len(r))

    def project(new):
        return ((new - mx) @ vx.T / sx) @ a[:, :k]

    def predict(new):
        return my + (project(new) * r[:k]) @ (b[:k] * sy) @ vy

    def leverage(new):
        return np.minimum(1 / len(x) + project(new).sum(1) ** 2, 100.0)

    return predict, leverage, r[:k]


def _grams(cells: DataFrame, sides: tuple[str, ...], n: int) -> dict:
    """Sums over cells of the products of all pairs of years: {(model, side): n x n array}.

    ``cells`` holds model and an array of n numbers per side and cell. A task adds its cells up
    before anything is shuffled, so n squared numbers a task, model and side are all that moves.
    """
    import numpy as np

    def part(batches):
        import pandas as pd

        sums = {}
        for pdf in batches:
            for model, g in pdf.groupby("model"):
                for side in sides:
                    a = np.stack(g[side].to_numpy())
                    sums[model, side] = sums.get((model, side), 0.0) + a.T @ a
        for (model, side), v in sums.items():
            yield pd.DataFrame({"model": model, "side": side, "i": np.repeat(np.arange(n), n), "j": np.tile(np.arange(n), n), "v": v.ravel()})

    parts = cells.select("model", *sides).mapInPandas(part, "model string, side string, i int, j int, v double")
    out: dict = {}
    for r in parts.groupBy("model", "side", "i", "j").agg(F.sum("v").alias("v")).collect():  # years squared, by model
        out.setdefault((r["model"], r["side"]), np.zeros((n, n)))[r["i"], r["j"]] = r["v"]
    return out


def _by_year(years: list[int], value: str):
    """The values of a group's years as an array, in order; missing where there is none."""
    return F.array(*(F.max(F.when(F.col("year") == y, F.col(value))) for y in years))


def _eofs(gram, k: int):
    """The first k left vectors and singular values of the centred matrix that a Gram matrix stands for."""
    import numpy as np

    centred = gram - gram.mean(0) - gram.mean(1)[:, None] + gram.mean()
    e, u = np.linalg.eigh((centred + centred.T) / 2)
    e, u = e[::-1], u[:, ::-1]
    k = int((e[: min(k, len(e))] > 1e-13 * max(e[0], 1e-300)).sum())
    return u[:, :k], np.sqrt(e[:k])


def cca_folds(gx, gy, train, at: int, combos: list[tuple[int, int, int]]):
    """For each (x, y, canonical) number of modes the weights of all years in the prediction of year
    ``at`` by a CCA of the training years, and its leverage, from the years x years Gram matrices of
    predictor and predictand alone. Fields are decomposed once; combinations truncate."""
    import numpy as np

    xx = gx[np.ix_(train, train)]
    ux, sx = _eofs(xx, max(c[0] for c in combos))
    if not len(sx) or sx[0] ** 2 <= 1e-14 * max(float(np.abs(np.diag(gx)).max()), 1e-300):
        raise ValueError("the predictor does not vary")
    uy, _ = _eofs(gy[np.ix_(train, train)], max(c[1] for c in combos))
    n, out, crossed = len(xx), [], {}
    amplitude = (gx[at, train] - gx[at, train].mean() - xx.mean(0) + xx.mean()) @ ux / sx**2
    for kx, ky, kc in combos:
        kx, ky = min(kx, ux.shape[1]), min(ky, uy.shape[1])
        weights = np.zeros(len(gx))
        weights[train] = 1 / n
        lever = 1 / n
        if ky:
            if (kx, ky) not in crossed:
                crossed[kx, ky] = np.linalg.svd(ux[:, :kx].T @ uy[:, :ky], full_matrices=False)
            a, r, b = crossed[kx, ky]
            k = min(kc, len(r))
            score = amplitude[:kx] @ a[:, :k]
            weights[train] += (score * r[:k]) @ b[:k] @ uy[:, :ky].T
            lever = float(min(1 / n + score.sum() ** 2, 100.0))
        out.append((weights, lever))
    return out


def _cca_cells(predictor: DataFrame, observed: Cube, now: DataFrame | None = None):
    """What a cross-validated CCA needs: the years, each model's own years (with values on both
    sides), one row per model and predictand cell with its values by year (missing ones filled with the side's
    mean), and Gram matrices of both sides, whose grids may differ. Cells are weighted by the root of the cosine of
    latitude; those wholly missing weigh nothing. ``now`` (model, lat, lon, value) is a predictor field beyond the
    years, the last row of the Gram matrices.
    """
    spark = predictor.sparkSession
    told = predictor.where("model IS NOT NULL").select("model", "year", "lat", "lon", F.col("value").alias("v"))
    seen = observed.df.select("year", "lat", "lon", F.col(observed.value).alias("v"))
    own: dict = {}
    with_x, with_y = told.groupBy("model", "year").agg(F.count("v").alias("n")).where("n > 0"), seen.groupBy("year").agg(F.count("v").alias("n")).where("n > 0")
    for r in with_x.join(with_y, "year", "left_semi").select("model", "year").collect():  # a row per model and year
        own.setdefault(r["model"], []).append(r["year"])
    years = sorted({y for v in own.values() for y in v})
    if not years:
        return [], own, None, {}
    mine = F.broadcast(spark.createDataFrame([(m, y) for m, v in own.items() for y in v], "model string, year int"))

    def cells(kept: DataFrame) -> DataFrame:
        fill = F.broadcast(kept.groupBy("model").agg(F.avg("v").alias("_fill")))  # a row per model
        each = kept.groupBy("model", "lat", "lon").agg(_by_year(years, "v").alias("own"), F.avg("v").alias("_mean")).join(fill, "model")
        return each.withColumn("_filled", F.transform("own", lambda v: F.coalesce(v, F.col("_fill"))))

    weight = F.sqrt(F.cos(F.radians("lat")))
    level = lambda v: F.coalesce((v - F.col("_mean")) * weight, F.lit(0.0))
    x, y = cells(told.join(mine, ["model", "year"], "left_semi")), cells(seen.join(mine, "year"))
    rows_x, rows_y, size = F.transform("_filled", level), F.transform("_filled", level), len(years)
    if now is not None:
        x, size = x.join(now.select("model", "lat", "lon", F.col("value").alias("_now")), ["model", "lat", "lon"], "left"), size + 1
        rows_x, rows_y = F.concat(rows_x, F.array(level(F.coalesce("_now", "_fill")))), F.concat(rows_y, F.array(F.lit(0.0)))
    grams = _grams(x.select("model", rows_x.alias("x")), ("x",), size) | _grams(y.select("model", rows_y.alias("y")), ("y",), size)
    return years, own, y.select("model", "lat", "lon", F.col("own").alias("y"), F.col("_mean").alias("_cy"), "_filled"), grams


def _plan(years: list[int], mine: list[int], window: int):
    """(held-out position, training positions) for each of a model's years."""
    import numpy as np

    half, at = (window - 1) // 2, {y: i for i, y in enumerate(years)}
    spots = np.array(sorted(at[y] for y in mine))
    return [(spot, spots[np.abs(np.arange(len(spots)) - i) > half]) for i, spot in enumerate(spots)]


def cca_cv(predictor: DataFrame, observed: Cube, modes: tuple[int, int, int] = (2, 2, 1), window: int = 1) -> DataFrame:
    """Leave-years-out CCA predictions of the observed cells: model, year, lat, lon, value and leverage.

    ``predictor`` holds model, year, lat, lon, value, on a grid of its own; see ``_cca_cells`` for missing values.
    Predictions are weighted sums over years, and the weights follow from products summed over
    cells: the fields stay in Spark, and the driver sees years squared numbers a model.
    """
    spark, kinds = predictor.sparkSession, dict(predictor.dtypes)
    years, own, cells, grams = _cca_cells(predictor, observed)
    if not years:
        return spark.createDataFrame([], f"model string, year int, lat {kinds['lat']}, lon {kinds['lon']}, value double, leverage double")
    rows = []
    for model, mine in own.items():
        for spot, train in _plan(years, mine, window):
            ((w, leverage),) = cca_folds(grams[model, "x"], grams[model, "y"], train, spot, [modes])
            rows.append((model, years[spot], w.tolist(), leverage))
    folds = spark.createDataFrame(rows, "model string, year int, w array<double>, leverage double")  # years squared, by model
    told = F.aggregate(F.zip_with("_filled", "w", lambda v, w: v * w), F.lit(0.0), lambda s, v: s + v)
    seen = cells.where("_cy IS NOT NULL").join(F.broadcast(folds), "model")
    return seen.select("model", "year", "lat", "lon", told.alias("value"), "leverage")


def mode_combos(n: int, window: int, x: tuple[int, int], y: tuple[int, int], canonical: tuple[int, int]) -> list[tuple[int, int, int]]:
    """Numbers of modes to search: ranges cut to what n years less a window determine, no more
    canonical modes than either side has."""
    most = max(1, n - max(window, 1) - 2)
    (x0, x1), (y0, y1), (c0, c1) = ((min(a, most), min(b, most)) for a, b in (x, y, canonical))
    return [(i, j, k) for i in range(x0, x1 + 1) for j in range(y0, y1 + 1) for k in range(c0, min(c1, i, j) + 1)]


def search_modes(predictor: DataFrame, observed: Cube, window: int = 1, x: tuple[int, int] = (1, 10), y: tuple[int, int] = (1, 10), canonical: tuple[int, int] = (1, 10), fallback: tuple[int, int, int] | None = None) -> DataFrame:
    """The goodness of every combination of modes: the mean over cells of Kendall's tau between
    observations and leave-years-out CCA predictions. model, x_modes, y_modes, modes, tau, cells, best.

    Each fold is decomposed once and truncated; the cells are read once for all combinations, each
    giving a tau a combination, added up in the tasks. Of equally good combinations the first is best. A cell
    counts with four pairs at least and where neither side is constant. Where no combination has a tau
    the ``fallback`` is best, or the search raises.
    """
    import numpy as np

    spark = predictor.sparkSession
    years, own, cells, grams = _cca_cells(predictor, observed)
    schema = "model string, x_modes int, y_modes int, modes int, tau double, cells long, best boolean"
    if not years:
        return spark.createDataFrame([], schema)
    combos, weights = {}, {}
    for model, mine in own.items():
        combos[model] = mode_combos(len(mine), window, x, y, canonical)
        w = np.full((len(combos[model]), len(years), len(years)), np.nan)
        for spot, train in _plan(years, mine, window):
            try:
                found = cca_folds(grams[model, "x"], grams[model, "y"], train, spot, combos[model])
            except (ValueError, np.linalg.LinAlgError):
                continue  # this fold predicts nothing
            w[:, spot] = [f[0] for f in found]
        weights[model] = w
    shared = spark.sparkContext.broadcast(weights)  # combinations x years squared, by model

    def run(batches):
        import pandas as pd

        from pluvion.functions.ranks import kendall

        sums: dict = {}
        for pdf in batches:
            for model, g in pdf.groupby("model"):
                w = shared.value[model]
                seen, told = np.stack(g["y"].to_numpy()).astype(float), np.stack(g["_filled"].to_numpy()).astype(float)
                total, count = sums.setdefault(model, (np.zeros(len(w)), np.zeros(len(w), np.int64)))
                for at in range(0, len(seen), 64):
                    o = np.broadcast_to(seen[at : at + 64], (len(w), *seen[at : at + 64].shape))
                    tau = kendall(np.einsum("kij,cj->kci", w, told[at : at + 64]), o, least=4)
                    total += np.nansum(tau, axis=1)
                    count += np.isfinite(tau).sum(axis=1)
        for model, (total, count) in sums.items():
            yield pd.DataFrame({"model": model, "combo": np.arange(len(total)), "t": total, "c": count})

    rows = cells.where("_cy IS NOT NULL").select("model", "y", "_filled").mapInPandas(run, "model string, combo int, t double, c long")
    found: dict = {}
    for r in rows.groupBy("model", "combo").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).collect():  # a row per combination
        found[r["model"], r["combo"]] = (r["t"] / r["c"] if r["c"] else None, r["c"])
    out = []
    for model, tried in combos.items():
        tau = [found.get((model, i), (None, 0)) for i in range(len(tried))]
        known = [t for t, _ in tau if t is not None]
        if known:
            best = next(i for i, (t, _) in enumerate(tau) if t is not None and t >= max(known) - 1e-12)
        elif fallback is None:
            raise ValueError("no combination of modes has a tau; give fallback=(x, y, canonical)")
        elif tuple(fallback) not in tried:
            raise ValueError(f"fallback {fallback} is not among the combinations searched")
        else:
            best = tried.index(tuple(fallback))
        out += [(model, *c, t, n, i == best) for i, (c, (t, n)) in enumerate(zip(tried, tau))]
    return spark.createDataFrame(out, schema)


def select_modes(predictor: DataFrame, observed: Cube, window: int = 1, **search) -> tuple[DataFrame, DataFrame]:
    """The best combination of each model (model, x_modes, y_modes, modes, tau), and the
    leave-years-out predictions and leverages made with it."""
    best = search_modes(predictor, observed, window, **search).where("best").select("model", "x_modes", "y_modes", "modes", "tau")
    chosen: dict = {}
    for r in best.collect():  # a row per model
        chosen.setdefault((r["x_modes"], r["y_modes"], r["modes"]), []).append(r["model"])
    parts = [cca_cv(predictor.where(F.col("model").isin(models)), observed, modes, window) for modes, models in chosen.items()]
    predictions = parts[0] if parts else cca_cv(predictor, observed, window=window)
    for p in parts[1:]:
        predictions = predictions.unionByName(p)
    return best, predictions


def north_modes(field: Cube, ceiling: int = 10, least_share: float = 1.0) -> int:
    """How many EOFs of a (year, lat, lon) field to keep, 1 at least: leading ones that hold more
    than the average share of the variance, up to the first that the sampling error of its
    eigenvalue does not tell from the next. Members are averaged first; cells with a missing year
    are left out.
    """
    import numpy as np

    extra = [d for d in field.dims if d not in ("year", "lat", "lon")]
    cube = field.mean(*extra) if extra else field
    years = sorted(r[0] for r in cube.df.select("year").distinct().collect())
    n = len(years)
    cells = cube.df.groupBy("lat", "lon").agg(_by_year(years, cube.value).alias("x"), F.avg(cube.value).alias("_c")).where(F.forall("x", lambda v: v.isNotNull()))
    weight = F.sqrt(F.cos(F.radians("lat")))
    level = cells.select(F.lit("m").alias("model"), F.transform("x", lambda v: (v - F.col("_c")) * weight).alias("x"))
    gram = _grams(level, ("x",), n).get(("m", "x"))
    if gram is None:
        return 1
    size = min(n, cells.count())
    lam = np.clip(np.linalg.eigvalsh((gram + gram.T) / 2)[::-1][:size], 0.0, None)
    if lam.sum() <= 0:
        return 1
    strong = lam[:-1] >= least_share * lam.mean()
    apart = lam[:-1] - lam[1:] > lam[:-1] * np.sqrt(2 / n)
    # Mode k + 1 is kept if it is strong and all before it are strong and told from their next.
    kept = np.cumprod(strong & np.append(True, apart[:-1])[: len(strong)])
    return int(max(1, min(kept.sum(), ceiling)))


def modes_north(predictor: Cube, observed: Cube, x_ceiling: int = 10, y_ceiling: int = 10) -> tuple[int, int, int]:
    """Numbers of EOFs of predictor and predictand, and of canonical modes (the smaller)."""
    x, y = north_modes(predictor, x_ceiling), north_modes(observed, y_ceiling)
    return x, y, min(x, y)


def logit_fit(x, label, ridge: float = 1e-6, rounds: int = 50):
    """Intercept and slope of a binomial logit by reweighted least squares, and the slope's
    two-sided Wald p; a label of one class gives its rate (an infinite intercept), no slope and no p."""
    import math

    import numpy as np

    if label.min() == label.max():
        return math.inf if label[0] else -math.inf, 0.0, None
    a = np.column_stack((np.ones_like(x), x))
    beta, pen = np.zeros(2), np.diag([0.0, ridge])
    for _ in range(rounds):
        eta = np.clip(a @ beta, -30, 30)
        p = 1 / (1 + np.exp(-eta))
        h = a.T @ (a * (p * (1 - p))[:, None]) + pen + 1e-12 * np.eye(2)
        step = np.linalg.solve(h, a.T @ (label - p) - pen @ beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-10:
            break
    z = beta[1] / math.sqrt(max(np.linalg.inv(h)[1, 1], 1e-300))
    return float(beta[0]), float(beta[1]), math.erfc(abs(z) / math.sqrt(2))


def logit(index: DataFrame, observed: Cube, at: float, least_years: int = 10, ridge: float = 1e-6) -> DataFrame:
    """Tercile probabilities at an index value by three binomial logits a cell; see ``solvers.logistic``."""
    from pluvion.operators.solvers import logistic

    return logistic(index, observed, at, least_years=least_years, ridge=ridge)


def cyclic_weights(n: int, sigma: float) -> list[tuple[int, float]]:
    """Offsets and weights of a Gaussian over a ring of n, cut at four deviations."""
    import math

    radius = int(4 * sigma + 0.5)
    raw = {d: math.exp(-0.5 * (d / sigma) ** 2) for d in range(-radius, radius + 1)} if sigma > 0 else {0: 1.0}
    total = sum(raw.values())
    ring: dict[int, float] = {}
    for d, w in raw.items():
        ring[d % n] = ring.get(d % n, 0.0) + w / total
    return sorted(ring.items())


def smooth_cyclic(df: DataFrame, season: str, value: str, keep: list[str], n: int = 12, sigma: float = 1.0) -> DataFrame:
    """Values smoothed over a cyclic season index: an equi-join with a table of n weights each.
    Missing where a season of the window is missing, as a value or as a row."""
    table = df.sparkSession.createDataFrame([(s, (s + d) % n, w) for s in range(n) for d, w in cyclic_weights(n, sigma)], "_to int, _from int, _w double")
    j = df.join(F.broadcast(table), F.col(season) == F.col("_from"))
    whole = F.count(value) == F.lit(len(cyclic_weights(n, sigma)))
    return j.groupBy(*keep, F.col("_to").alias(season)).agg(F.when(whole, F.sum(F.col(value) * F.col("_w"))).alias(value))


def smoothed_coefficients(hindcast: Cube, observed: Cube, season: str = "season", axis: str = "year", sigma: float = 1.0, n: int = 12) -> DataFrame:
    """The slope of observations on the hindcast per season and cell, smoothed over seasons, from
    the years that have both, three at least."""
    extra = [d for d in hindcast.dims if d not in observed.dims]
    h = hindcast.mean(*extra) if extra else hindcast
    key = observed.key(axis)
    pairs = h.df.select(*h.dims, F.col(h.value).alias("x")).join(observed.df.select(*observed.dims, F.col(observed.value).alias("y")), list(observed.dims))
    pairs = pairs.where("x IS NOT NULL AND y IS NOT NULL")
    slope = pairs.groupBy(*key).agg(F.when((F.count(F.lit(1)) >= 3) & (F.var_pop("x") > 0), F.covar_pop("x", "y") / F.var_pop("x")).alias("a"))
    return smooth_cyclic(slope, season, "a", [k for k in key if k != season], n, sigma)


def smoothed_tercile(hindcast: Cube, observed: Cube, forecast: Cube, season: str = "season", axis: str = "year", member: str = "member") -> DataFrame:
    """Constrained normal calibration per season and cell: the mean follows the regression and
    the deviation makes up the observed variance; the middle probability is cut to [0, 1]."""
    key = observed.key(axis)
    spread = hindcast.df.groupBy(*[d for d in hindcast.dims if d != member]).agg(F.avg(hindcast.value).alias("x"), F.var_pop(hindcast.value).alias("s2"))
    pairs = spread.join(observed.df.select(*observed.dims, F.col(observed.value).alias("y")), list(observed.dims)).where("x IS NOT NULL AND s2 IS NOT NULL AND y IS NOT NULL")
    fit = pairs.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("cxy"), F.avg("s2").alias("ms2"),
        F.percentile("y", F.lit(1 / 3)).alias("t33"), F.percentile("y", F.lit(2 / 3)).alias("t67"),
    ).withColumn("a", F.when((F.col("n") >= 3) & (F.col("vx") > 0), F.col("cxy") / F.col("vx")))
    b2 = F.when(F.col("ms2") > 0, F.greatest(F.col("vy") - F.col("a") * F.col("a") * F.col("vx"), F.lit(0.0)) / F.col("ms2"))
    now = forecast.df.groupBy(*key).agg(F.avg(forecast.value).alias("f"), F.var_pop(forecast.value).alias("fs2")).join(fit, key)
    now = now.withColumn("mu", F.col("my") + F.col("a") * (F.col("f") - F.col("mx"))).withColumn("sd", F.greatest(F.sqrt(b2 * F.col("fs2")), F.lit(1e-12)))
    hi = F.when(F.col("t67") > F.col("t33"), F.col("t67")).otherwise(F.col("t33") + 1e-6)
    z = now.withColumn("_a", (F.col("t33") - F.col("mu")) / F.col("sd")).withColumn("_b", (hi - F.col("mu")) / F.col("sd"))
    return z.select(*key, "mu", "sd", phi("_a").alias("p_bn"), F.greatest(F.least(phi("_b") - phi("_a"), F.lit(1.0)), F.lit(0.0)).alias("p_nn"), (1 - phi("_b")).alias("p_an"))
