"""U1: whole groups drawn with replacement, as integer weights on group statistics.

A replicate is a multiplicity per group; rows are never copied. All replicates of all scopes share the
same jobs.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.fixed_values import H1, H2, H3, U1
from plumbline.operators import tails
from plumbline.operators.models import FACTORS, RANK_TOLERANCE
from plumbline.operators.prepare import Policy, decimal
from plumbline.session import written

VALUES = "scope string, replicate int, protocol_id string, value double"


def bootstrap_draws(groups: DataFrame, replicates: int, seed: int, mode: str = "hashed") -> DataFrame:
    """(scope, replicate, group_token, w): how often each replicate draws each group.

    ``compatible`` draws like Python's generator over the sorted tokens, a scope in one task
    because its draws are one stream; ``hashed`` draws by a hash, in SQL.
    """
    tokens = groups.select("scope", "group_token").distinct()
    if mode == "compatible":
        held = tokens.groupBy("scope").agg(F.array_sort(F.collect_list("group_token")).alias("tokens"))

        def draw(batches):
            for scope, own in ((s, list(t)) for pdf in batches for s, t in zip(pdf["scope"], pdf["tokens"])):
                rng = random.Random(seed)
                for r in range(replicates):
                    drawn: dict[str, int] = {}
                    for _ in own:
                        t = rng.choice(own)
                        drawn[t] = drawn.get(t, 0) + 1
                    yield pd.DataFrame({"scope": scope, "replicate": r, "group_token": list(drawn), "w": list(drawn.values())})

        return held.mapInPandas(draw, "scope string, replicate int, group_token string, w int")
    ranked = tokens.withColumn("i", F.row_number().over(Window.partitionBy("scope").orderBy("group_token")) - 1)
    size = tokens.groupBy("scope").agg(F.count("*").alias("g"))
    slots = size.select("scope", "g", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    slots = slots.select("scope", "g", "replicate", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)).alias("d"))
    drawn = slots.select("scope", "replicate", F.pmod(F.xxhash64(F.lit(seed), "replicate", "d"), F.col("g")).cast("int").alias("i"))
    counted = drawn.groupBy("scope", "replicate", "i").agg(F.count("*").cast("int").alias("w"))
    return counted.join(ranked, ["scope", "i"]).select("scope", "replicate", "group_token", "w")


TAIL_BINS, REST_BINS, FINE_BINS = 96, 31, 63


def _dealt(df: DataFrame, name: str, halvings: int) -> DataFrame:
    """``df`` with the number of ``cuts`` below its margin, by halving: a column for each step, which Spark
    compiles (a fold over an array it interprets)."""
    df = df.withColumn(name, F.lit(0))
    for step in (1 << k for k in range(halvings - 1, -1, -1)):
        df = df.withColumn(name, F.col(name) + F.when(F.get("cuts", F.col(name) + (step - 1)) < F.col("margin"), step).otherwise(0))
    return df


def bootstrap_h1(rows: DataFrame, draws: DataFrame, policy: Policy) -> DataFrame:
    """H1 of every replicate: a weighted order statistic of the groups' histograms of margins.

    In three levels. Margins are dealt to bins between approximate quantiles, narrow in the lower tail, and the
    replicates are counted on the groups' bins, of which there are 128 whatever the rows. The bins that
    a replicate's rank lies in are cut into 64 again, and so on; in the end each replicate is counted on the margins
    of the one small bin that its rank lies in. Rows are never shuffled but for those of the first bins hit.
    """
    margins = rows.select("scope", "group_token", (F.col("y") - F.lit(policy.lower_limit)).alias("margin"))
    # a replicate's rank seldom lies above four times its share; bins reach all the same to the end
    knee = min(0.9, 4 * policy.alpha + 0.02)
    points = [knee * (k + 1) / TAIL_BINS for k in range(TAIL_BINS)] + [knee + (1 - knee) * (k + 1) / (REST_BINS + 1) for k in range(REST_BINS)]
    cuts = written(margins.groupBy("scope").agg(F.percentile_approx("margin", points, 10_000).alias("cuts")), "cuts")
    binned = _dealt(margins.join(cuts, "scope"), "bin", 7)
    bins = written(binned.groupBy("scope", "group_token", "bin").agg(F.count("*").alias("n"), F.count_if(F.col("margin") < 0).alias("under")), "bins")
    drawn = draws.join(bins, ["scope", "group_token"]).groupBy("scope", "replicate", "bin").agg(F.sum(F.col("w") * F.col("n")).alias("n"), F.sum(F.col("w") * F.col("under")).alias("under"))
    each = Window.partitionBy("scope", "replicate")
    drawn = drawn.withColumns({"upto": F.sum("n").over(each.orderBy("bin")), "n_rows": F.sum("n").over(each), "under": F.sum("under").over(each)})
    drawn = drawn.withColumn("k", F.floor(decimal(policy.alpha) * F.col("n_rows")).cast("long"))
    met = (F.col("upto") > F.col("k")) & (F.col("upto") - F.col("n") <= F.col("k"))
    left = F.col("k") - F.col("upto") + F.col("n")
    n_groups = draws.groupBy("scope", "replicate").agg(F.sum("w").alias("n_groups"))
    hit = written(drawn.filter(met).select("scope", "replicate", "bin", "n_rows", "under", "k", left.alias("left")).join(n_groups, ["scope", "replicate"]), "hit")
    wanted = written(hit.select("scope", "bin").distinct(), "wanted")
    # one comparison keeps most rows from being dealt again: none outside the bins hit is wanted
    ends = (F.coalesce(F.get("cuts", F.col("bin") - 1), F.lit(float("-inf"))), F.coalesce(F.get("cuts", F.col("bin")), F.lit(float("inf"))))
    span = written(wanted.join(cuts, "scope").groupBy("scope").agg(F.min(ends[0]).alias("low"), F.max(ends[1]).alias("high"), F.first("cuts").alias("cuts")), "span")
    near = margins.join(span, "scope").filter((F.col("margin") > F.col("low")) & (F.col("margin") <= F.col("high")))
    counts = written(_dealt(near, "bin", 7).join(wanted, ["scope", "bin"]).groupBy("scope", "group_token", "bin", "margin").agg(F.count("*").alias("n")), "counts")
    # the second level; a bin of few margins, or of one that is met often, stays as it is
    finer = written(counts.groupBy("scope", "bin").agg(F.percentile_approx("margin", [(k + 1) / (FINE_BINS + 1) for k in range(FINE_BINS)], 10_000).alias("cuts")), "finer")
    fine = written(_dealt(counts.join(finer, ["scope", "bin"]), "part", 6).select("scope", "group_token", "bin", "margin", "n", "part"), "fine")
    parts = fine.groupBy("scope", "group_token", "bin", "part").agg(F.sum("n").alias("n"))
    drawn = hit.select("scope", "replicate", "bin", F.col("left").alias("k")).join(draws, ["scope", "replicate"]).join(parts, ["scope", "group_token", "bin"])
    drawn = drawn.groupBy("scope", "replicate", "bin", "part", "k").agg(F.sum(F.col("w") * F.col("n")).alias("n")).withColumn("upto", F.sum("n").over(each.orderBy("part")))
    inner = written(drawn.filter(met).select("scope", "replicate", "bin", "part", left.alias("left")), "inner")
    inside = fine.join(inner, ["scope", "bin", "part"]).join(draws, ["scope", "replicate", "group_token"])
    values = inside.groupBy("scope", "replicate", "margin").agg(F.sum(F.col("w") * F.col("n")).alias("n"), F.first("left").alias("left"))
    upto = F.sum("n").over(each.orderBy("margin"))
    at = values.withColumn("upto", upto).groupBy("scope", "replicate").agg(F.min(F.when(F.col("upto") > F.col("left"), F.col("margin"))).alias("boundary"))
    out = hit.join(at, ["scope", "replicate"])
    eligible = (
        (F.col("n_rows") >= policy.min_rows)
        & (F.col("n_groups") >= policy.min_groups_exploratory)
        & ((decimal(policy.alpha) * F.col("n_rows")).cast("double") >= policy.min_tail_count)
        & (F.col("under") <= F.col("k"))
    )
    return out.select("scope", F.col("replicate").cast("int").alias("replicate"), F.lit(H1).alias("protocol_id"), F.when(eligible, F.greatest(F.lit(0.0), F.col("boundary"))).alias("value"))


PREDICTORS = "scope string, candidate_id string, group_token string, product string, stream string, shift string, base array<double>, slope array<double>, w array<double>"
GROUP_PART = 1000


def _refits(pdf: pd.DataFrame, terms: list[str]) -> pd.DataFrame:
    """The predictions of one candidate for the cells of a part of a scope's groups, in every replicate.

    Rows with ``w`` are the cells of these groups; those without hold the cells' sums over all groups, each
    group as often as it was drawn. A drawn copy is held out alone: its siblings stay in the training.
    A replicate in which a fit fails predicts NaN.
    """
    factors, timed = [f for f in FACTORS if f in terms], "time" in terms
    own, whole = pdf[pdf["w"].notna()].reset_index(drop=True), pdf[pdf["w"].isna()]
    replicates = len(own["w"].iloc[0])
    levels = {f: np.unique(whole[f].to_numpy(str)) for f in factors}
    starts = dict(zip(factors, 1 + np.cumsum([0, *(len(levels[f]) for f in factors)])))
    p = 1 + sum(map(len, levels.values())) + timed
    groups, group = np.unique(own["group_token"].to_numpy(str), return_inverse=True)

    def normal(frame: pd.DataFrame, at: np.ndarray, size: int, many: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Normal equations (size, many, p, p) and right sides of the frame's cells, summed by ``at``."""
        columns = [np.zeros(len(frame), np.int64), *(starts[f] + np.searchsorted(levels[f], frame[f].to_numpy(str)) for f in factors)]
        n, sy, st, stt, sty = (np.stack([np.asarray(v, float) for v in frame[c]]) for c in ("n", "sy", "st", "stt", "sty"))
        gram, right = np.zeros((size, many, p, p)), np.zeros((size, many, p))
        every = np.arange(many)[None]
        for a in columns:
            np.add.at(right, (at[:, None], every, a[:, None]), sy)
            for b in columns:
                np.add.at(gram, (at[:, None], every, a[:, None], b[:, None]), n)
            if timed:
                np.add.at(gram, (at[:, None], every, a[:, None], p - 1), st)
                np.add.at(gram, (at[:, None], every, p - 1, a[:, None]), st)
        if timed:
            np.add.at(gram, (at[:, None], every, p - 1, p - 1), stt)
            np.add.at(right, (at[:, None], every, p - 1), sty)
        return gram, right, columns

    gram, right, _ = normal(whole, np.zeros(len(whole), np.int64), 1, replicates)
    held, held_right, columns = normal(own, group, len(groups), 1)
    w = np.zeros((len(groups), replicates))
    w[group] = np.stack([np.asarray(v, float) for v in own["w"]])
    g, r = np.nonzero(w)
    beta = np.full((len(groups), replicates, p), np.nan)
    a, b = gram[0][r] - held[g, 0], right[0][r] - held_right[g, 0]
    here = np.einsum("kii->ki", a) > 0.5
    sound, keep = np.ones(len(g), bool), np.zeros((len(g), p), bool)
    keep[:, 0] = True
    for f in factors:
        span = slice(starts[f], starts[f] + len(levels[f]))
        present = here[:, span]
        sound &= present.sum(1) >= 2
        sound &= ~((np.einsum("kii->ki", held[g, 0])[:, span] > 0.5) & ~present).any(1)
        keep[:, span] = present & (np.cumsum(present, 1) > 1)  # the first one present is the baseline
    if timed:
        keep[:, p - 1] = True
    patterns, which = np.unique(keep[sound], axis=0, return_inverse=True)
    for k, pattern in enumerate(patterns):
        rows, at = np.flatnonzero(sound)[which.ravel() == k], np.flatnonzero(pattern)
        part, side = a[rows][:, at[:, None], at], b[rows][:, at]
        with np.errstate(all="ignore"):
            scale = np.sqrt(np.maximum(np.einsum("kii->ki", part), 0))
            c = part / (scale[:, :, None] * scale[:, None])
        fine = (scale > 0).all(1) & np.isfinite(c).all((1, 2))
        fine[fine] = np.linalg.eigvalsh(c[fine])[:, 0] >= RANK_TOLERANCE * len(at)
        solved = np.zeros((int(fine.sum()), p))
        solved[:, at] = np.linalg.solve(c[fine], (side[fine] / scale[fine])[:, :, None])[:, :, 0] / scale[fine]
        beta[g[rows[fine]], r[rows[fine]]] = solved
    y_mean, t_mean = float(own["y_mean"].iloc[0]), float(own["t_mean"].iloc[0]) if timed else 0.0
    base = y_mean + beta[group, :, 0]
    for c in columns[1:]:
        base = base + beta[group, :, c]
    slope = beta[group, :, p - 1] if timed else None
    if timed:
        base = base - slope * t_mean
    drawn = w[group] > 0
    shown = own[["scope", "candidate_id", "group_token", *FACTORS]].copy()
    shown["base"] = np.where(drawn, base, 0.0).tolist()
    shown["slope"] = np.where(drawn, slope, 0.0).tolist() if timed else None
    shown["w"] = w[group].tolist()
    return shown


def replicate_predictors(cells: DataFrame, draws: DataFrame, chosen: DataFrame, replicates: int, part: int = GROUP_PART) -> DataFrame:
    """(scope, candidate_id, group_token, factors, base, slope, w): what every replicate predicts for each cell
    without its group, refitted from the cells' sums alone.

    A task gets the cells of about ``part`` groups of a scope and the sums over all groups by replicate: as
    many as there are combinations of factors.
    """
    slots = F.sequence(F.lit(0), F.lit(replicates - 1))
    drawn = draws.groupBy("scope", "group_token").agg(F.map_from_entries(F.collect_list(F.struct("replicate", "w"))).alias("m"))
    vectors = drawn.select("scope", "group_token", F.transform(slots, lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)).cast("double")).alias("w"))
    weighted = cells.join(vectors, ["scope", "group_token"])
    sums = ("n", "sy", "st", "stt", "sty")
    each = weighted.select("scope", *FACTORS, F.posexplode("w").alias("i", "times"), *sums, "y_mean", "t_mean")
    each = each.groupBy("scope", *FACTORS, "i").agg(*[F.sum(F.col("times") * F.coalesce(c, F.lit(0.0))).alias(c) for c in sums], F.first("y_mean").alias("y_mean"), F.first("t_mean").alias("t_mean"))
    ordered = each.groupBy("scope", *FACTORS).agg(F.array_sort(F.collect_list(F.struct("i", *sums))).alias("s"), F.first("y_mean").alias("y_mean"), F.first("t_mean").alias("t_mean"))
    totals = ordered.select("scope", F.lit("").alias("group_token"), *FACTORS, *[F.col(f"s.{c}").alias(c) for c in sums], "y_mean", "t_mean", F.lit(None).cast("array<double>").alias("w"))
    own = weighted.select("scope", "group_token", *FACTORS, *[F.array(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(c) for c in sums], "y_mean", "t_mean", "w")
    sizes = cells.groupBy("scope").agg(F.ceil(F.count_distinct("group_token") / part).cast("int").alias("parts"))
    wanted = written(chosen.select("scope", "candidate_id", "terms").join(sizes, "scope"), "wanted")
    dealt = own.join(wanted, "scope").withColumn("part", F.pmod(F.xxhash64("group_token"), F.col("parts")).cast("int"))
    shared = totals.join(wanted, "scope").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["w"].isna().all():  # no group fell into this part
            return pd.DataFrame(columns=[c.split(" ")[0] for c in PREDICTORS.split(", ")])
        return _refits(pdf, list(pdf["terms"].iloc[0]))

    return dealt.unionByName(shared).groupBy("scope", "candidate_id", "part").applyInPandas(run, PREDICTORS)


def replicate_samples(rows: DataFrame, predictors: DataFrame, chosen: DataFrame, per_block: int, gather: Callable[[DataFrame, list[str]], DataFrame] = tails.condensed) -> DataFrame:
    """Samples of all replicates: each cell's values, condensed or counted, once for ``per_block`` replicates, with
    what all of them predict."""
    # written, so that its size is known: it must not send all rows of a scope to one task
    timed = written(chosen.groupBy("scope").agg(F.bool_or(F.array_contains("terms", "time")).alias("timed")), "timed")
    y = rows.join(timed, "scope").select("scope", "group_token", *FACTORS, F.when(F.col("timed"), F.col("time_h")).alias("t"), "y")
    cell = ["scope", "group_token", *FACTORS]
    lists = gather(y, cell)
    block = F.explode(F.sequence(F.lit(0), F.ceil(F.size("w") / per_block).cast("int") - 1)).alias("block")
    cut = lambda c: F.slice(c, F.col("block") * per_block + 1, F.lit(per_block)).alias(c)
    named = predictors.select("*", block).select(*[F.col(c).alias(f"__{c}") for c in cell], "candidate_id", "block", cut("base"), cut("slope"), cut("w"))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in cell])
    return lists.join(named, same).select("scope", "candidate_id", "block", "base", "slope", "w", "t", "y", "n", "half")


def bootstrap_parametric(rows: DataFrame, cells: DataFrame, draws: DataFrame, chosen: DataFrame, policy: Policy, student: bool = True, blocks: int = 1) -> DataFrame:
    """H2 and H3 of every replicate over the frozen equivalence set ``chosen(scope, candidate_id, terms)``.

    A boolean column ``student`` of ``chosen`` says in which scopes H3 is asked for; without it ``student``
    holds for all. Replicates are a vector beside every value: rows are read once a round for all of them, or
    ``blocks`` times where there are too many replicates for one vector.
    """
    replicates = 1 + (draws.agg(F.max("replicate")).first()[0] or 0)
    per_block = -(-replicates // blocks)
    predictors = written(replicate_predictors(cells, draws, chosen, replicates), "predictors")
    samples = written(replicate_samples(rows, predictors, chosen, per_block), "samples", rows_per_file=tails.ROWS_PER_FILE)
    found = tails.moments(samples)
    some = lambda keys: replicate_samples(rows.join(keys.select("scope").distinct(), "scope", "left_semi"), predictors.join(keys, ["scope", "candidate_id"], "left_semi"), chosen, per_block, tails.whole)
    solve = lambda s, f, t: tails.tail_headroom(s, policy.lower_limit, policy.alpha, policy.maximum_shift, t, per_block, f, some)
    least = lambda out, p: out.groupBy("scope", "replicate").agg(F.min("headroom").alias("value")).select("scope", "replicate", F.lit(p).alias("protocol_id"), "value")
    values = least(solve(samples, found, False), H2)
    asked = chosen.filter(F.col("student") if "student" in chosen.columns else F.lit(student)).select("scope").distinct()
    if asked.isEmpty():
        return values
    own = samples.join(asked, "scope", "left_semi")
    return values.unionByName(least(solve(own, found.join(asked, "scope", "left_semi"), True), H3))


def group_bootstrap(values: DataFrame, groups: DataFrame, policy: Policy) -> DataFrame:
    """Lower bounds from replicate values (scope, replicate, protocol_id, value).

    ``values`` holds the requested protocols only; a replicate succeeds if all of them have a value. The
    bound is the order statistic of rank ceil(p * successes), p = 1 - confidence, without interpolation.
    """
    values = written(values, "replicates")
    wanted = values.groupBy("scope").agg(F.count_distinct("protocol_id").alias("wanted"), F.count_distinct("replicate").alias("requested"))
    good = values.filter(F.col("value") >= 0).join(wanted, "scope").withColumn("have", F.count("*").over(Window.partitionBy("scope", "replicate"))).filter(F.col("have") == F.col("wanted"))
    n_groups = groups.groupBy("scope").agg(F.count_distinct("group_token").alias("n_groups"))
    done = good.groupBy("scope").agg(F.count_distinct("replicate").alias("successful"))
    state = wanted.join(done, "scope", "left").join(n_groups, "scope").withColumn("successful", F.coalesce("successful", F.lit(0)))
    failed = (F.col("requested") - F.col("successful")) / F.col("requested")
    code = (
        F.when(F.col("n_groups") < policy.min_groups_action, "BOOTSTRAP_INSUFFICIENT_GROUPS")
        .when(F.col("successful") < policy.min_success, "BOOTSTRAP_INSUFFICIENT_SUCCESS")
        .when(failed > policy.max_failed_fraction, "BOOTSTRAP_FAILURE_FRACTION")
    )
    state = state.withColumn("failure_code", code).withColumn("valid", code.isNull())
    rank = F.greatest(F.ceil((F.lit(1) - decimal(policy.confidence)) * F.col("successful")).cast("long"), F.lit(1))
    ranked = good.withColumn("r", F.row_number().over(Window.partitionBy("scope", "protocol_id").orderBy("value"))).join(state.select("scope", "successful", "valid"), "scope")
    bounds = ranked.filter(F.col("valid") & (F.col("r") == rank)).select("scope", "protocol_id", F.col("value").alias("lower_bound"))
    status = F.when(~F.col("valid"), "ineligible").when(F.col("successful") < F.col("requested"), "warning").otherwise("ok")
    summary = state.select("scope", F.lit(U1).alias("u1_id"), status.alias("u1_status"), "valid", "requested", "successful", "failure_code")
    return summary.join(bounds, "scope", "left")


def evaluate_replicates(statistics: DataFrame, draws: DataFrame, evaluator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A caller's estimator on all replicates at once: it gets the group statistics with ``replicate`` and
    ``w`` and returns (scope, replicate, protocol_id, value)."""
    return evaluator(statistics.join(draws, ["scope", "group_token"]))
