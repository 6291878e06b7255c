"""Parametric tails of residuals, solved for all scopes, candidates and replicates at once.

*Samples* are rows of values in arrays: (scope, candidate_id, block, base, slope, w, t, y, n, half). Value i of a row
stands for n[i] rows of quantity y[i]; replicate r of the block draws them w[r] times and predicts
base[r] + slope[r] * t[i]. A point estimate is one replicate of weight 1. Every step is a round: each sample
row is read once, with what is known so far of its scope and candidate (one row, ``state``), and yields
partial sums for all replicates; the sums of a round make the next state. So no task holds a scope, and a
round costs one pass over the samples whatever the number of replicates.

The values of a key that has many rows are *condensed*: dealt to bins, narrow in the middle, and each bin's values
replaced by fixed nodes whose weights n give every polynomial of degree under ``NODES`` the same sum over the bin
(Chebyshev interpolation). Moments stay as they are, and the sums of a Student fit, which are analytic, change by
less than 1e-12 of themselves as long as a bin's half width (``half``) is small against its distance from
the nearest singularity, location +- i * scale * sqrt(df). That is tested after the fit, and what fails the test
is fitted on all its values. So a round's work does not grow with the rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from operator import add, and_
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import special
from plumbline.session import written

KEYS = ["scope", "candidate_id", "block"]
CHUNK = 2000  # values to a sample row
ROWS_PER_FILE = 8  # sample rows to a file, so that a round runs on all cores
DEGENERATE = 1e-12
MIN_DF, MAX_DF, DF_EDGE = 2.1, 100.0, 1e-3
ROUNDS = 60
BINS, BIN_REACH = 512, 60.0
CONDENSED_FROM = 1000  # rows of a key
NODES, BIN_STEP, FINEST = 16, 0.4, 8.0  # nodes of a bin; its width in asinh(FINEST * (y - mean) / deviation)
WIDEST = 0.35  # a bin's half width by its distance from the nearest singularity


def chunked(counts: DataFrame, keys: list[str], chunk: int = CHUNK) -> DataFrame:
    """(keys, t, y, n): the counted values of each key in arrays of about ``chunk``, however many there are."""
    sizes = counts.groupBy(*keys).agg(F.ceil(F.count("*") / chunk).cast("int").alias("parts"))
    named = sizes.select(*[F.col(c).alias(f"__{c}") for c in keys], "parts")
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    dealt = counts.join(named, same).drop(*[f"__{c}" for c in keys]).withColumn("part", F.pmod(F.xxhash64("t", "y"), F.col("parts")))
    lists = dealt.groupBy(*keys, "part").agg(F.collect_list(F.struct("t", "y", "n")).alias("v")).drop("part")
    return lists.select(*keys, F.col("v.t").alias("t"), F.col("v.y").alias("y"), F.col("v.n").alias("n"))


def compacted(values: DataFrame, keys: list[str], x: str) -> DataFrame:
    """(keys, x, n): distinct values with counts."""
    return values.groupBy(*keys, x).agg(F.count("*").alias("n"))


def _same(keys: list[str]) -> Column:
    return reduce(and_, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys])


def condensed(values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, t, y, n, half): rows (keys, t, y) as counted values, or as nodes where a key has many of them."""
    cell = [*keys, "t"]
    stats = values.groupBy(*cell).agg(F.count("*").alias("rows"), F.avg("y").alias("mean"), (F.stddev_samp("y") / FINEST).alias("unit"))
    many = stats.filter((F.col("rows") > CONDENSED_FROM) & (F.col("unit") > 0) & (F.col("unit") < float("inf")))
    many = written(many.select(*[F.col(c).alias(f"__{c}") for c in cell], "mean", "unit"), "many")
    few = chunked(compacted(values.join(many, _same(cell), "left_anti"), cell, "y"), keys)
    place = F.asinh((F.col("y") - F.col("mean")) / F.col("unit")) / BIN_STEP
    edge = lambda by: F.col("mean") + F.col("unit") * F.sinh((F.col("bin") + by) * BIN_STEP)
    middle, half = (edge(0.5) + edge(-0.5)) / 2, (edge(0.5) - edge(-0.5)) / 2
    dealt = values.join(many, _same(cell)).select(*cell, "y", "mean", "unit", F.floor(place + 0.5).alias("bin"))
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("y") - middle) / half)))
    angles = dealt.select(*cell, "mean", "unit", "bin", angle.alias("angle"))
    sums = angles.groupBy(*cell, "mean", "unit", "bin").agg(F.count("*").cast("double").alias("a0"), *[F.sum(F.cos(k * F.col("angle"))).alias(f"a{k}") for k in range(1, NODES)])
    at = [(i + 0.5) * math.pi / NODES for i in range(NODES)]
    weight = lambda x: (F.col("a0") + 2 * reduce(add, [F.col(f"a{k}") * math.cos(k * x) for k in range(1, NODES)])) / NODES
    nodes = sums.select(*cell, F.array(*[middle + half * math.cos(x) for x in at]).alias("y"), F.array(*[weight(x) for x in at]).alias("n"), F.array_repeat(half, NODES).alias("half"))
    lists = nodes.groupBy(*cell).agg(F.collect_list(F.struct("y", "n", "half")).alias("v")).withColumn("y", F.flatten("v.y"))
    lists = lists.select(*keys, F.transform("y", lambda _: F.col("t")).alias("t"), "y", F.flatten("v.n").alias("n"), F.flatten("v.half").alias("half"))
    return lists.unionByName(few.select(*keys, "t", "y", F.col("n").cast("array<double>").alias("n"), F.lit(None).cast("array<double>").alias("half")))


def whole(values: DataFrame, keys: list[str]) -> DataFrame:
    """Like ``condensed``, but all values as they are."""
    lists = chunked(compacted(values, [*keys, "t"], "y"), keys)
    return lists.select(*keys, "t", "y", F.col("n").cast("array<double>").alias("n"), F.lit(None).cast("array<double>").alias("half"))


def point_samples(crossfit: DataFrame, gather: Callable[[DataFrame, list[str]], DataFrame] = condensed) -> DataFrame:
    """Samples of scored rows (scope, candidate_id, y, yhat): one replicate, which predicts yhat."""
    lists = gather(crossfit.select("scope", "candidate_id", F.col("yhat").alias("t"), "y"), ["scope", "candidate_id"])
    one = lambda x: F.array(F.lit(x))
    return lists.select("scope", "candidate_id", F.lit(0).alias("block"), one(0.0).alias("base"), one(1.0).alias("slope"), one(1.0).alias("w"), "t", "y", "n", "half")


class Sample:
    """One sample row as arrays: ``pred`` and ``e`` are values by replicates, ``weight`` likewise."""

    def __init__(self, row: dict):
        self.n = np.asarray(row["n"], float)
        self.y = np.asarray(row["y"], float)
        self.base, self.w = np.asarray(row["base"], float), np.asarray(row["w"], float)
        self.slope = None if row["slope"] is None else np.asarray(row["slope"], float)
        self.t = None if self.slope is None else np.asarray(row["t"], float)
        self.half = None if row["half"] is None else np.asarray(row["half"], float)

    def predictions(self) -> tuple[np.ndarray, np.ndarray]:
        """(predictions, rows of each): all values of a row have one prediction unless it has a slope."""
        if self.slope is None:
            return self.base[None], np.array([self.n.sum()])
        return self.base[None] + self.slope[None] * self.t[:, None], self.n

    def residuals(self) -> np.ndarray:
        return self.y[:, None] - (self.base[None] if self.slope is None else self.base[None] + self.slope[None] * self.t[:, None])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(len(batch)):
            yield batch.slice(k, 1).to_pylist()[0]


def summed(samples: DataFrame, state: DataFrame | None, sums: Callable[[Sample, dict], np.ndarray]) -> DataFrame:
    """(scope, candidate_id, block, sums): for each key the total over its samples of what ``sums`` yields, an
    array of one length per key, added up in the tasks first and then by position."""
    joined = samples if state is None else samples.join(state, KEYS)

    def run(batches):
        held: dict[tuple, np.ndarray] = {}
        for row in _rows(batches):
            key = (row["scope"], row["candidate_id"], row["block"])
            part = sums(Sample(row), row)
            held[key] = held[key] + part if key in held else part
        if held:
            cols = list(zip(*held))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array([v.tolist() for v in held.values()], pa.list_(pa.float64()))], names=[*KEYS, "part"])

    partial = joined.mapInArrow(run, "scope string, candidate_id string, block int, part array<double>")
    flat = partial.select(*KEYS, F.posexplode("part").alias("i", "x")).groupBy(*KEYS, "i").agg(F.sum("x").alias("x"))
    return flat.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s")).select(*KEYS, F.col("s.x").alias("sums"))


def stepped(state: DataFrame, sums: DataFrame, step: Callable[[dict, np.ndarray], dict], schema: str, name: str) -> DataFrame:
    """The next state: ``step`` over each key's state and sums. Written; a key is one row of bounded size."""
    joined = state.join(sums, KEYS)

    def run(frames):
        for pdf in frames:
            rows = []
            for row in pdf.to_dict("records"):
                found = step({k: (np.asarray(v, float) if isinstance(v, np.ndarray) else v) for k, v in row.items()}, np.asarray(row["sums"], float))
                rows.append({k: row[k] for k in KEYS} | {k: (v.tolist() if isinstance(v, np.ndarray) else v) for k, v in found.items()})
            if rows:
                yield pd.DataFrame(rows)

    columns = [c.strip().split(" ")[0] for c in schema.split(", ")]
    return written(joined.mapInPandas(lambda frames: (f[columns] for f in run(frames)), schema), name)


# --- moments ----------------------------------------------------------------------------------------

MOMENTS = "scope string, candidate_id string, block int, total array<double>, location array<double>, scale array<double>, middle array<double>"


def moments(samples: DataFrame) -> DataFrame:
    """Per key and replicate: rows, mean and sample scale of the residuals, mean of the quantity; a replicate
    without a fit (its base is not a number) has no scale."""

    def sums(s: Sample, row: dict) -> np.ndarray:
        e = s.residuals()
        return np.stack([s.w * s.n.sum(), s.w * (s.n @ e), s.w * (s.n @ (e * e)), s.w * (s.n @ s.y)]).ravel()

    def step(row: dict, s: np.ndarray) -> dict:
        n, first, second, y = s.reshape(4, -1)
        with np.errstate(all="ignore"):
            mean = first / n
            return {"total": n, "location": mean, "scale": np.sqrt(np.maximum(second - n * mean * mean, 0) / (n - 1)), "middle": y / n}

    found = summed(samples, None, sums)
    return stepped(found.select(*KEYS), found, step, MOMENTS, "moments")


# --- the largest shift --------------------------------------------------------------------------------

SEARCH = "scope string, candidate_id string, block int, total array<double>, location array<double>, scale array<double>, df array<double>, at array<double>, low array<double>, high array<double>, base_risk array<double>, moving double"
#: Trial shifts of the first round: both ends and a guess. Then there is one a round.
FIRST = 3


def largest_shifts(samples: DataFrame, fits: DataFrame, lower_limit: float, alpha: float, most: float) -> DataFrame:
    """(KEYS, headroom, baseline_risk arrays): per replicate the largest shift in [0, most] at which the share
    of rows below the limit is at most alpha; NaN without a scale. ``fits``: KEYS, total, location, scale, df (null
    for the normal distribution), start (a guess at the shift).

    The logarithm of the risk is nearly a line in its tail, so Newton steps on it, kept inside the
    bracket, take a few rounds.
    """
    fill = lambda v: F.transform("location", lambda _: F.lit(float(v)))
    near = F.transform("start", lambda x: F.when((x > 0) & (x < most), x).otherwise(F.lit(most / 2)))
    trials = F.flatten(F.array(fill(0.0), fill(most), near))
    state = fits.select(*KEYS, "total", "location", "scale", "df", trials.alias("at"), fill(0.0).alias("low"), fill(most).alias("high"), fill(float("nan")).alias("base_risk"), F.lit(1.0).alias("moving"))
    state = written(state, "search")

    def sums(s: Sample, row: dict) -> np.ndarray:
        location, scale = np.asarray(row["location"], float), np.asarray(row["scale"], float)
        df = None if row["df"] is None else np.asarray(row["df"], float)
        pred, n = s.predictions()
        out = []
        for at in np.asarray(row["at"], float).reshape(-1, len(location)):
            with np.errstate(all="ignore"):
                z = (lower_limit + at - location - pred) / scale
                cdf, pdf = special.tail(z, df)
            out += [s.w * (n @ cdf), s.w * (n @ pdf) / scale]
        return np.concatenate(out)

    def step(row: dict, s: np.ndarray) -> dict:
        total, low, high, base = row["total"], row["low"], row["high"], row["base_risk"]
        at = row["at"].reshape(-1, len(total))
        s = s.reshape(len(at), 2, -1) / total
        with np.errstate(all="ignore"):
            if len(at) == FIRST:
                base = s[0, 0]
                done = ~(base <= alpha)  # no fit, or too much below as it is
                censored = s[1, 0] <= alpha
                low, high = np.where(~done & censored, most, 0.0), np.where(done, 0.0, most)
                at, s = at[2], s[2]
            else:
                at, s = at[0], s[0]
            inside = high > low
            fits = s[0] <= alpha
            low, high = np.where(inside & fits, np.maximum(low, at), low), np.where(inside & ~fits, np.minimum(high, at), high)
            newton = at - np.log(s[0] / alpha) * s[0] / s[1]
            closed = inside & (np.abs(newton - at) <= 1e-11 * (1 + np.abs(at)))
            middle = low + (high - low) / 2
            good = np.isfinite(newton) & (newton > low) & (newton < high)
            # a bracket that closes on one side only ends where Newton's steps end
            low, high = np.where(closed, np.clip(newton, low, high), low), np.where(closed, np.clip(newton, low, high), high)
            nxt = np.where(good, newton, middle)
        moving = float(np.any(high - low > 1e-10 * (1 + np.abs(high))))
        return {c: row[c] for c in ("total", "location", "scale")} | {"df": row["df"], "at": nxt, "low": low, "high": high, "base_risk": base, "moving": moving}

    for k in range(ROUNDS):
        state = stepped(state, summed(samples, state, sums), step, SEARCH, "search")
        if k > 1 and state.filter("moving > 0").isEmpty():
            break
    return state.select(*KEYS, "total", "location", "scale", "df", F.col("low").alias("headroom"), "base_risk")


# --- Student's distribution ---------------------------------------------------------------------------

FIT = (
    "scope string, candidate_id string, block int, total array<double>, location array<double>, scale array<double>, df array<double>, change array<double>, moving double"
)


def student_sums(z: np.ndarray, df: np.ndarray) -> list[np.ndarray]:
    """What the likelihood's slopes and curvatures are made of, value by value."""
    z2 = z * z
    q = df + z2
    r = 1 / q
    r2 = r * r
    return [z * r, z2 * r, np.log1p(z2 / df), (df - z2) * r2, z * r2, z2 * r2, z * (z2 - 1) * r2, z2 * (z2 - 1) * r2, z2 * (df * q - (df + 1) * (2 * df + z2)) * r2 / (df * df)]


def student_step(n: np.ndarray, s: np.ndarray, df: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(step of the location in scales, of the log scale, of the log degrees of freedom) per replicate: Newton
    where the likelihood is concave and the step short, else reweighting with a slope step of the degrees."""
    out = np.full((3, len(n)), np.nan)
    for k in np.flatnonzero(np.isfinite(s).all(0) & (n > 0)):
        a, v, m = df[k] + 1, df[k], n[k]
        z, z2, log, dm, zr, zz, mn, ln, nn = s[:, k]
        curve = m * (special.trigamma((v + 1) / 2) / 4 - special.trigamma(v / 2) / 4 + 1 / (2 * v * v))
        slope = m * (special.digamma((v + 1) / 2) / 2 - special.digamma(v / 2) / 2 - 1 / (2 * v)) - log / 2 + a * z2 / (2 * v)
        g = np.array([a * z, a * z2 - m, v * slope])
        h = np.array([
            [-a * dm, -2 * a * v * zr, v * mn],
            [-2 * a * v * zr, -2 * a * v * zz, v * ln],
            [v * mn, v * ln, v * v * (curve + z2 / (2 * v) + nn / 2) + v * slope],
        ])
        low, high = math.log(MIN_DF), math.log(MAX_DF)
        u = math.log(v)
        held = (u <= low and g[2] < 0) or (u >= high and g[2] > 0)
        free = 2 if held else 3
        part = h[:free, :free]
        step = np.zeros(3)
        if np.linalg.eigvalsh(part)[-1] < 0 and np.abs(found := np.linalg.solve(part, -g[:free])).max() < 0.7:
            step[:free] = found
        else:
            mass = a * (m - z2) / v  # the sum of weights (df + 1) / (df + z * z)
            step[0] = g[0] / mass
            step[1] = math.log(max(math.sqrt(max(0.0, a * z2 / mass - step[0] ** 2)), 1e-6))
            if not held:
                step[2] = float(np.clip(-g[2] / h[2, 2] if h[2, 2] < 0 else math.copysign(0.5, g[2]), -0.5, 0.5))
        step[2] = min(max(u + step[2], low), high) - u
        out[:, k] = step
    return out[0], out[1], out[2]


def student_fits(samples: DataFrame, found: DataFrame) -> DataFrame:
    """(KEYS, total, location, scale, df, change): the maximum-likelihood fit of every replicate.

    A fit of one counted histogram of all replicates' standardised residuals, bounded in size, is where all
    start; then rounds of Newton steps on exact sums. ``change`` is the last step's size: a fit holds
    if it is tiny, and unless df lies at a bound.
    """

    def sums(s: Sample, row: dict) -> np.ndarray:
        location, scale = np.asarray(row["location"], float), np.asarray(row["scale"], float)
        ok = np.isfinite(scale) & (scale > DEGENERATE) & (s.w > 0)
        z = np.clip((s.residuals()[:, ok] - location[ok]) / scale[ok], -BIN_REACH, BIN_REACH)
        # bins even in asinh(4 z): fine in the middle, wide in the tails
        place = ((np.arcsinh(4 * z) / np.arcsinh(4 * BIN_REACH) + 1) / 2 * (BINS - 1)).round().astype(np.int64)
        return np.bincount(place.ravel(), (s.n[:, None] * s.w[ok][None]).ravel(), minlength=BINS)

    def begin(row: dict, s: np.ndarray) -> dict:
        s = np.maximum(s, 0)  # nodes may have weights below zero
        kept = np.flatnonzero(s)
        middle = np.sinh((kept / (BINS - 1) * 2 - 1) * np.arcsinh(4 * BIN_REACH)) / 4
        df, where, spread = 10.0, 0.0, 1.0
        if len(kept) > 3:
            _, df, where, spread = special.fit_student(middle, s[kept], MIN_DF, MAX_DF, DF_EDGE)
        if not (np.isfinite([df, where, spread]).all() and spread > 1e-6):
            df, where, spread = 10.0, 0.0, 1.0
        df = min(max(df, 2.2), 90.0)
        location, scale = row["location"] + where * row["scale"], spread * row["scale"]
        return {"total": row["total"], "location": location, "scale": scale, "df": np.full(len(location), df), "change": np.full(len(location), np.inf), "moving": 1.0}

    state = stepped(found, summed(samples, found, sums), begin, FIT, "student")

    def slopes(s: Sample, row: dict) -> np.ndarray:
        location, scale, df = (np.asarray(row[c], float) for c in ("location", "scale", "df"))
        with np.errstate(all="ignore"):
            z = (s.residuals() - location) / scale
            return np.concatenate([s.w * (s.n @ x) for x in student_sums(z, df)])

    def step(row: dict, s: np.ndarray) -> dict:
        done = row["change"] <= 1e-11
        with np.errstate(all="ignore"):
            a, b, c = student_step(row["total"], np.where(done, np.nan, s.reshape(9, -1)), row["df"])
            move = lambda x: np.where(np.isfinite(x) & ~done, x, 0.0)
            change = np.where(done, row["change"], np.max(np.abs([a, b, c]), axis=0))
            location, scale, df = row["location"] + move(a) * row["scale"], row["scale"] * np.exp(move(b)), row["df"] * np.exp(move(c))
        return {"total": row["total"], "location": location, "scale": scale, "df": df, "change": change, "moving": float(np.any(change > 1e-11))}

    for k in range(ROUNDS):
        state = stepped(state, summed(samples, state, slopes), step, FIT, "student")
        if k > 1 and state.filter("moving > 0").isEmpty():
            break
    return state.drop("moving")


TAILS = "scope string, candidate_id string, replicate int, failure_code string, headroom double, baseline_risk double, feasible boolean, censored boolean, df double, location double, scale double"


def _too_wide(samples: DataFrame, fits: DataFrame) -> DataFrame:
    """(scope, candidate_id) of fits with bins too wide for the precision of their sums."""

    def sums(s: Sample, row: dict) -> np.ndarray:
        location, scale, df = (np.asarray(row[c], float) for c in ("location", "scale", "df"))
        if s.half is None:
            return np.zeros(1)
        with np.errstate(all="ignore"):
            wide = s.half[:, None] > WIDEST * np.sqrt((s.residuals() - location) ** 2 + df * scale**2)
        return np.array([float((wide & (s.w > 0)).sum())])

    return summed(samples, fits, sums).filter(F.col("sums")[0] > 0).select("scope", "candidate_id").distinct()


def tail_headroom(samples: DataFrame, lower_limit: float, alpha: float, most: float, student: bool, per_block: int = 1, found: DataFrame | None = None, exact: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row per scope, candidate and replicate (block * per_block + place): the headroom, or a failure.

    ``exact`` gives the samples of some (scope, candidate_id) with all values as they are; it is needed where
    ``samples`` are condensed.
    """
    found = moments(samples) if found is None else found
    z = NormalDist().inv_cdf(alpha)
    # where a normal tail of the whole quantity would end
    start = F.zip_with("middle", "scale", lambda m, s: m + z * s - lower_limit)
    found = found.withColumn("start", start)
    size = F.size("location")
    if student:
        fits = student_fits(samples, found)
        if exact is not None:
            wide = written(_too_wide(samples, fits), "wide")
            if not wide.isEmpty():
                own = ["scope", "candidate_id"]
                again = written(exact(wide), "exact", rows_per_file=ROWS_PER_FILE)
                fits = fits.join(wide, own, "left_anti").unionByName(student_fits(again, found.join(wide, own, "left_semi")))
        code = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.when(~(F.get("first_scale", i) > DEGENERATE) | F.isnan(F.get("first_scale", i)), F.lit("PARAMETRIC_DEGENERATE_SCALE"))
            .when(~(F.get("change", i) <= 1e-9) | F.isnan(F.get("change", i)), F.lit("STUDENT_T_FIT_NONCONVERGENCE"))
            .when(F.get("scale", i) <= DEGENERATE, F.lit("PARAMETRIC_DEGENERATE_SCALE"))
            .when((F.get("df", i) - MIN_DF <= DF_EDGE) | (MAX_DF - F.get("df", i) <= DF_EDGE), F.lit("STUDENT_T_DF_BOUNDARY")))
        fits = fits.join(found.select(*KEYS, F.col("scale").alias("first_scale"), "start"), KEYS).withColumn("code", code)
    else:
        fits = found.withColumn("df", F.lit(None).cast("array<double>"))
        fits = fits.withColumn("code", F.transform("scale", lambda s: F.when(~(s > DEGENERATE) | F.isnan(s), F.lit("PARAMETRIC_DEGENERATE_SCALE"))))
    # what has failed is not searched
    lost = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.when(F.get("code", i).isNull(), F.get("scale", i)).otherwise(F.lit(float("nan"))))
    fits = written(fits.withColumn("scale", lost), "fits")
    solved = largest_shifts(samples, fits, lower_limit, alpha, most).select(*KEYS, "headroom", "base_risk")
    both = solved.join(fits, KEYS)
    each = both.select("scope", "candidate_id", "block", F.posexplode("headroom").alias("i", "h"), "code", "base_risk", "df", "location", "scale")
    failed = F.get("code", F.col("i"))
    shown = lambda c: F.when(failed.isNull(), c)
    risk = F.get("base_risk", F.col("i"))
    return each.select(
        "scope", "candidate_id", (F.col("block") * per_block + F.col("i")).cast("int").alias("replicate"), failed.alias("failure_code"), shown(F.col("h")).alias("headroom"), shown(risk).alias("baseline_risk"),
        shown(risk <= alpha).alias("feasible"), shown((risk <= alpha) & (F.col("h") >= most)).alias("censored"), F.get("df", F.col("i")).alias("df"), F.get("location", F.col("i")).alias("location"), shown(F.get("scale", F.col("i"))).alias("scale"),
    )
