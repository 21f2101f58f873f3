"""Climate indices, analog years, and completion of a season from them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pluvion.cube import Cube


def in_box(lon: Column, lat: Column, south: float, north: float, west: float, east: float) -> Column:
    """Whether a point lies in a box; longitudes are taken modulo 360. A box whose west lies
    east of its east wraps; equal sides (after the modulo) are the whole circle."""
    w, e = west % 360, east % 360
    at = F.pmod(lon.cast("double"), F.lit(360.0))
    inside = F.lit(True) if w == e else at.between(w, e) if w < e else (at >= w) | (at <= e)
    return lat.between(south, north) & inside


@dataclass(frozen=True)
class Index:
    """Boxes (south, north, west, east), how each is standardised, and how they combine."""

    name: str
    boxes: dict[str, tuple[float, float, float, float]]
    combine: Callable[..., Column]
    transform: str = "anomaly"
    #: None for plain box means, "cos_lat" for means weighted by the cosine of latitude.
    weights: str | None = None

    def reduce(self, field: Cube, axis: str = "year", baseline: tuple[int, int] | None = None) -> DataFrame:
        """The index per year: box means over space and member in one scan, standardised
        (population deviation, at least 1e-12), as anomalies, or raw."""
        if self.transform not in ("standardize", "anomaly", "raw"):
            raise ValueError(f"unknown transform {self.transform!r}")
        v = F.col(field.value)
        area = F.cos(F.radians("lat")) if self.weights == "cos_lat" else F.lit(1.0)

        def mean(box) -> Column:
            inside = in_box(F.col("lon"), F.col("lat"), *box) & v.isNotNull()
            total = F.sum(F.when(inside, area))
            return F.when(total > 0, F.sum(F.when(inside, area * v)) / F.greatest(total, F.lit(1e-300)))

        means = field.df.groupBy(axis).agg(*(mean(box).alias(b) for b, box in self.boxes.items()))
        if self.transform == "raw":
            return means.select(axis, self.combine(*(F.col(b) for b in self.boxes)).alias("value"))
        ref = means.where(F.col(axis).between(*baseline)) if baseline else means
        stats = ref.agg(*(F.avg(b).alias(f"_m_{b}") for b in self.boxes), *(F.greatest(F.stddev_pop(b), F.lit(1e-12)).alias(f"_s_{b}") for b in self.boxes))
        part = lambda b: F.col(b) - F.col(f"_m_{b}") if self.transform == "anomaly" else (F.col(b) - F.col(f"_m_{b}")) / F.col(f"_s_{b}")
        return means.crossJoin(F.broadcast(stats)).select(axis, self.combine(*map(part, self.boxes)).alias("value"))  # one row of statistics


#: Boxes of the named indices, in degrees: south, north, west, east (fixed values).
BOXES = {
    "nino12": (-10, 0, 270, 280), "nino3": (-5, 5, 210, 270), "nino34": (-5, 5, 190, 240), "nino4": (-5, 5, 160, 210),
    "wep": (-15, 20, 120, 160), "wnp": (20, 35, 160, 210), "wsp": (-30, -15, 155, 210),
    "wtio": (-10, 10, 50, 70), "setio": (-10, 0, 90, 110), "tropics": (-20, 20, 0, 360), "wpac": (-9, 4, 103, 140),
}
#: Named indices: boxes, transform, weights (fixed values). Several boxes are the first less the mean of the others.
NAMED = {
    "wvg": (("nino34", "wnp", "wep", "wsp"), "standardize", None), "wvg2": (("nino34", "wnp", "wep"), "standardize", None),
    "nino12": (("nino12",), "standardize", None), "nino3": (("nino3",), "standardize", None), "nino34": (("nino34",), "standardize", None), "nino4": (("nino4",), "standardize", None),
    "oni": (("nino34",), "anomaly", "cos_lat"), "roni": (("nino34", "tropics"), "anomaly", "cos_lat"),
    "dmi": (("wtio", "setio"), "anomaly", "cos_lat"), "wtio": (("wtio",), "anomaly", "cos_lat"), "setio": (("setio",), "anomaly", "cos_lat"),
    "wio": (("wtio",), "raw", "cos_lat"), "wpac": (("wpac",), "standardize", None),
}


def list_named() -> list[str]:
    return sorted(NAMED)


def named(name: str) -> Index:
    key = "dmi" if name == "iod" else name
    if key not in NAMED:
        raise KeyError(f"unknown index {name!r}; known: {list_named()}")
    boxes, transform, weights = NAMED[key]
    less = lambda first, *others: first - sum(others[1:], others[0]) / len(others) if others else first
    return Index(key, {b: BOXES[b] for b in boxes}, less, transform, weights)


def analogs_from_index(index: DataFrame, target: float, n: int, metric: str = "absolute", axis: str = "year") -> DataFrame:
    """Years by nearness of an index (columns year, value): year, score, rank (null beyond n)."""
    d = F.col("value") - F.lit(target)
    score = {"absolute": F.abs(d), "squared": d * d, "signed": -d}[metric]
    return ranked(index.select(axis, score.alias("score")), n, axis)


def ranked(scores: DataFrame, n: int, axis: str = "year") -> DataFrame:
    """Ranks of the n smallest scores; the earlier year first among equals. A global order of years."""
    known = scores.where(F.col("score").isNotNull()).withColumn("rank", F.row_number().over(W.orderBy("score", axis)))
    return scores.join(known.select(axis, "rank"), axis, "left").select(axis, "score", F.when(F.col("rank") <= n, F.col("rank")).alias("rank"))


def analogs_from_field(field: Cube, target: DataFrame, n: int, metric: str = "rmse", axis: str = "year") -> DataFrame:
    """Years by distance of their field from a target (lat, lon, value), weighted by the cosine of latitude."""
    t = target.select("lat", "lon", F.col("value").alias("_t"))
    j = field.df.join(t, ["lat", "lon"]).withColumn("_w", F.greatest(F.cos(F.radians("lat")), F.lit(0.0)))
    x, w = F.col(field.value), F.col("_w")
    total = F.when(F.sum("_w") > 0, F.sum("_w"))  # at the poles alone there is no weight, and no score
    if metric in ("rmse", "mae"):
        d = x - F.col("_t")
        err = F.sum(w * (d * d if metric == "rmse" else F.abs(d))) / total
        scores = j.groupBy(axis).agg((F.sqrt(err) if metric == "rmse" else err).alias("score"))
    else:
        if metric == "pattern":
            m = j.groupBy(axis).agg((F.sum(w * x) / total).alias("_mx"), (F.sum(w * F.col("_t")) / total).alias("_mt"))
            j = j.join(m, axis)
        elif metric == "anomaly":
            j = j.withColumns({"_mx": F.lit(0.0), "_mt": F.lit(0.0)})
        else:
            raise ValueError(f"unknown metric {metric!r}")
        a, b = x - F.col("_mx"), F.col("_t") - F.col("_mt")
        s = j.groupBy(axis).agg(F.sum(w * a * b).alias("_ab"), F.sum(w * a * a).alias("_aa"), F.sum(w * b * b).alias("_bb"))
        den = F.sqrt(F.col("_aa") * F.col("_bb"))
        scores = s.select(axis, F.when(den >= 1e-12, 1 - F.col("_ab") / den).alias("score"))
    return ranked(scores, n, axis)


def both(a: DataFrame, b: DataFrame, n: int, axis: str = "year", either: bool = False) -> DataFrame:
    """Years selected by both (or either): scores averaged without missing ones, ranked again."""
    j = a.select(axis, F.col("score").alias("_s"), F.col("rank").alias("_r")).join(b.select(axis, F.col("score").alias("_t"), F.col("rank").alias("_q")), axis)
    mean = F.coalesce((F.col("_s") + F.col("_t")) / 2, F.col("_s"), F.col("_t"))
    keep = F.col("_r").isNotNull() | F.col("_q").isNotNull() if either else F.col("_r").isNotNull() & F.col("_q").isNotNull()
    return ranked(j.select(axis, F.when(keep, mean).alias("score")), n, axis)


def analog_weights(analogs: DataFrame, kind: str = "uniform", scale: float | None = None, axis: str = "year") -> DataFrame:
    """Weights of the selected years, summing to 1: uniform, s / (x + s), or exp(-(x / s)^2 / 2);
    s is the median of the positive selected scores, or 1. A year whose formula divides by 0 has none."""
    chosen = analogs.where("rank IS NOT NULL")
    s = chosen.agg(F.coalesce(F.lit(scale).cast("double"), F.percentile(F.when(F.col("score") > 0, F.col("score")), F.lit(0.5)), F.lit(1.0)).alias("_s"))
    x = F.col("score")
    over = lambda a, b: a / F.when(b != 0, b)
    raw = {"uniform": F.lit(1.0), "inverse": over(F.col("_s"), x + F.col("_s")), "gaussian": F.exp(-0.5 * F.pow(over(x, F.col("_s")), 2))}[kind]
    w = chosen.crossJoin(F.broadcast(s)).withColumn("_w", raw)  # one row
    return w.crossJoin(F.broadcast(w.agg(F.sum("_w").alias("_t")))).select(axis, over(F.col("_w"), F.col("_t")).alias("weight"))


def complete(seasons: Cube, analogs: DataFrame, observed: DataFrame, forecast: DataFrame | None = None, overlap: str = "observed") -> DataFrame:
    """Scenarios of a season under way: each analog year's steps, overwritten by the forecast
    and the observed part; where both exist ``overlap`` tells which holds.

    Returns scenario (the analog year), step, segment, the other dims and value.
    """
    key = seasons.key("year", "step")
    base = seasons.df.join(analogs.where("rank IS NOT NULL").select("year"), "year", "left_semi").select(F.col("year").alias("scenario"), *key, "step", F.col(seasons.value).alias("_a"))
    df = base.join(observed.select(*key, "step", F.col("value").alias("_o")), [*key, "step"], "left")
    if forecast is not None:
        df = df.join(forecast.select(*key, "step", F.col("value").alias("_f")), [*key, "step"], "left")
    else:
        df = df.withColumn("_f", F.lit(None).cast("double"))
    order = ("_o", "_f") if overlap == "observed" else ("_f", "_o")
    names = {"_o": "observed", "_f": "forecast"}
    segment = F.when(F.col(order[0]).isNotNull(), names[order[0]]).when(F.col(order[1]).isNotNull(), names[order[1]]).otherwise("analog")
    return df.select("scenario", *key, "step", segment.alias("segment"), F.coalesce(*order, "_a").alias("value"))


def scenario_totals(completed: DataFrame, *key: str) -> DataFrame:
    """Totals per scenario; missing if any step is."""
    return completed.groupBy("scenario", *key).agg(F.when(F.count("value") == F.count(F.lit(1)), F.sum("value")).alias("total"))


def weighted_quantile(totals: DataFrame, weights: DataFrame, q: float, *key: str) -> DataFrame:
    """The quantile of scenario totals at mid-cumulative weights, clamped; missing if a total is."""
    j = totals.join(weights.select(F.col("year").alias("scenario"), "weight"), "scenario")
    w = W.partitionBy(*key) if key else W.partitionBy(F.lit(1))
    run = w.orderBy("total", "scenario").rowsBetween(W.unboundedPreceding, 0)
    p = j.withColumn("_p", (F.sum("weight").over(run) - F.col("weight") / 2) / F.sum("weight").over(w))
    return p.groupBy(*key).agg(
        F.when(F.count("total") == F.count(F.lit(1)), F.max(F.when(F.col("_p") <= q, F.struct("_p", "total")))).alias("_lo"), F.min(F.when(F.col("_p") >= q, F.struct("_p", "total"))).alias("_hi"), F.count("total").alias("_c"), F.count(F.lit(1)).alias("_n")
    ).select(
        *key,
        F.when(F.col("_c") < F.col("_n"), None).when(F.col("_lo").isNull(), F.col("_hi.total")).when(F.col("_hi").isNull(), F.col("_lo.total"))
        .when(F.col("_hi._p") == F.col("_lo._p"), F.col("_lo.total"))
        .otherwise(F.col("_lo.total") + (F.lit(q) - F.col("_lo._p")) / (F.col("_hi._p") - F.col("_lo._p")) * (F.col("_hi.total") - F.col("_lo.total"))).alias("total"),
    )


def analogs_from_years(years: list[int], candidates: DataFrame, axis: str = "year") -> DataFrame:
    """Given years as analogs, ranked in the order given: year, score (0, missing for the other
    candidates) and rank."""
    if not years:
        raise ValueError("no year given")
    order = candidates.sparkSession.createDataFrame([(y, i) for i, y in enumerate(dict.fromkeys(years), 1)], f"{axis} int, rank int")
    pool = candidates.select(F.col(axis).cast("int").alias(axis)).unionByName(order.select(axis)).distinct()
    return pool.join(F.broadcast(order), axis, "left").select(axis, F.when(F.col("rank").isNotNull(), 0.0).alias("score"), "rank")


def analogs_where(condition: DataFrame, axis: str = "year") -> DataFrame:
    """The years whose condition holds (missing: it does not), all equally good, in order of time."""
    if condition.where(F.col("condition")).isEmpty():
        raise ValueError("the condition selects no year")
    return _again(condition.select(axis, F.when(F.col("condition"), 0.0).alias("score"), F.when(F.col("condition"), F.col(axis)).alias("_o")), axis)


def _again(analogs: DataFrame, axis: str) -> DataFrame:
    """Ranks from 1 in the order of ``_o``, missing where that is. A row per year."""
    kept = analogs.where("_o IS NOT NULL").select(axis, F.row_number().over(W.orderBy("_o")).alias("rank"))
    return analogs.drop("_o").join(F.broadcast(kept), axis, "left").select(axis, "score", "rank")


def keep_years(analogs: DataFrame, mask: DataFrame, axis: str = "year") -> DataFrame:
    """Drops selected years unless (year, keep) says true; the others keep their order."""
    j = analogs.join(mask.where(F.col("keep")).select(axis, F.lit(True).alias("_k")).distinct(), axis, "left")
    return _again(j.select(axis, "score", F.when(F.col("_k"), F.col("rank")).alias("_o")), axis)


def top(analogs: DataFrame, n: int) -> DataFrame:
    """The first n of the selected years."""
    have = analogs.where("rank IS NOT NULL").count()
    if not 1 <= n <= have:
        raise ValueError(f"{n} of {have} selected years")
    return analogs.withColumn("rank", F.when(F.col("rank") <= n, F.col("rank")))


def accumulation(completed: DataFrame, *key: str) -> DataFrame:
    """Season-to-date totals of each scenario; a missing step adds nothing."""
    run = W.partitionBy("scenario", *key).orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    return completed.withColumn("accumulation", F.sum(F.coalesce("value", F.lit(0.0))).over(run))
