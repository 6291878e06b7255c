"""How far could the process move down before its lower tail breaches the limit?

D0 the mean, H1 the exact empirical boundary, H2 and H3 the Gaussian and Student-t tails of
cross-fitted residuals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.fixed_values import D0, H1, H2, H3
from plumbline.operators import tails
from plumbline.operators.prepare import Policy, decimal
from plumbline.operators.tails import DEGENERATE, compacted  # noqa: F401
from plumbline.session import written

SKEWNESS, KURTOSIS, SCALE_RATIO = 1.0, 3.0, 2.0
QUANTILE_ACCURACY = 10_000


def codes(*pairs: tuple[Column, str]) -> Column:
    """The codes whose conditions hold, in order."""
    return F.array_compact(F.array(*[F.when(condition, F.lit(code)) for condition, code in pairs])) if pairs else F.array().cast("array<string>")


def mean_diagnostic(rows: DataFrame, policy: Policy) -> DataFrame:
    """D0: mean, overfill against nominal, margin above the limit, strict underfills."""
    low = F.col("y") < F.lit(policy.lower_limit)
    s = rows.groupBy("scope").agg(F.count("*").alias("n_rows"), F.avg("y").alias("mean"), F.count_if(low).alias("underfill_count"))
    return s.select(
        "scope", F.lit(D0).alias("protocol_id"), "n_rows", "mean",
        (F.col("mean") - policy.nominal).alias("overfill"), (F.col("mean") - policy.lower_limit).alias("margin"),
        "underfill_count", (F.col("underfill_count") / F.col("n_rows")).alias("underfill_rate"),
    )


def empirical_headroom(rows: DataFrame, policy: Policy, accuracy: int = QUANTILE_ACCURACY) -> DataFrame:
    """H1: the (k+1)-th smallest margin, k = floor(alpha * n) in decimals, clamped at 0.

    Approximate quantiles with a guaranteed rank error bracket the rank; only the margins inside the
    bracket are sorted, after counting those below it. The result is exact for any number of rows.
    """
    margin = F.col("y") - F.lit(policy.lower_limit)
    base = rows.select("scope", "group_token", margin.alias("margin"))
    slack = 2.0 / accuracy
    near = [max(0.0, policy.alpha - slack), min(1.0, policy.alpha + slack)]
    # quantiles beside a distinct count would be kept for each group, and rows sorted where these are many
    each = base.groupBy("scope", "group_token").agg(F.count("*").alias("n"), F.count_if(F.col("margin") < 0).alias("under"), F.min("margin").alias("least"), F.max("margin").alias("most"))
    s = each.groupBy("scope").agg(
        F.sum("n").alias("n_rows"),
        F.count("group_token").alias("n_groups"),
        F.sum("under").alias("baseline_underfills"),
        F.min("least").alias("least"),
        F.max("most").alias("most"),
    )
    s = s.join(base.groupBy("scope").agg(F.percentile_approx("margin", near, accuracy).alias("near")), "scope")
    tail = decimal(policy.alpha) * F.col("n_rows")
    s = s.withColumns({"expected_tail_count": tail.cast("double"), "k": F.floor(tail).cast("long")})
    # few rows: a rank error of a row matters, so take everything
    wide = F.col("n_rows") <= accuracy * 4
    s = s.withColumns({"low": F.when(wide, F.col("least")).otherwise(F.col("near")[0]), "high": F.when(wide, F.col("most")).otherwise(F.col("near")[1])})
    s = written(s, "brackets")  # computed once, and of a size that Spark knows
    # one pass: the rows below the bracket as a number, those inside by value
    met = base.join(s.select("scope", "low", "high"), "scope").filter(F.col("margin") <= F.col("high"))
    inside = F.when(F.col("margin") >= F.col("low"), F.col("margin"))
    tally = written(met.groupBy("scope", inside.alias("margin")).agg(F.count("*").alias("n")), "tally")
    below = tally.filter(F.col("margin").isNull()).select("scope", F.col("n").alias("below"))
    counts = tally.filter(F.col("margin").isNotNull())
    running = F.sum("n").over(Window.partitionBy("scope").orderBy("margin"))
    at = counts.join(below, "scope", "left").join(s.select("scope", "k"), "scope").withColumn("upto", F.coalesce("below", F.lit(0)) + running)
    hit = at.filter((F.col("upto") > F.col("k")) & (F.col("upto") - F.col("n") <= F.col("k"))).select("scope", F.col("margin").alias("raw_boundary"), F.col("n").alias("tie_multiplicity"), (F.col("upto") - F.col("n")).alias("underfills_at_boundary"))
    out = s.join(hit, "scope", "left")
    missed = F.raise_error(F.lit("the rank lies outside the quantiles that bracket it")).cast("double")
    out = out.withColumn("raw_boundary", F.coalesce("raw_boundary", missed))
    blocked = [
        (F.col("n_rows") < policy.min_rows, "EMPIRICAL_INSUFFICIENT_ROWS"),
        (F.col("n_groups") < policy.min_groups_exploratory, "EMPIRICAL_INSUFFICIENT_GROUPS"),
        (F.col("expected_tail_count") < policy.min_tail_count, "EMPIRICAL_INSUFFICIENT_TAIL_SUPPORT"),
        (F.col("baseline_underfills") > F.col("k"), "EMPIRICAL_BASELINE_EXCEEDS_TAIL_LIMIT"),
    ]
    tie = [(F.col("tie_multiplicity") > 1, "EMPIRICAL_BOUNDARY_TIE")]
    status = F.when(F.size(codes(*blocked)) > 0, "ineligible").when(F.size(codes(*tie)) > 0, "warning").otherwise("ok")
    return out.select(
        "scope", F.lit(H1).alias("protocol_id"), status.alias("status"), F.greatest(F.lit(0.0), F.col("raw_boundary")).alias("point_estimate"),
        "n_rows", "n_groups", "expected_tail_count", "k", "raw_boundary", "tie_multiplicity", "underfills_at_boundary", "baseline_underfills",
        codes(*blocked, *tie).alias("warnings"),
    )


def residual_moments(crossfit: DataFrame) -> DataFrame:
    """Location, sample scale and bias-adjusted skewness and excess kurtosis of the residuals."""
    e = F.col("y") - F.col("yhat")
    s = crossfit.groupBy("scope", "candidate_id").agg(F.count("*").alias("n"), F.avg(e).alias("location"), F.stddev_samp(e).alias("scale"), F.skewness(e).alias("g1"), F.kurtosis(e).alias("g2"))
    n = F.col("n").cast("double")
    return s.select(
        "scope", "candidate_id", "n", "location", "scale",
        F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)).alias("skewness"),
        F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6)).alias("excess_kurtosis"),
    )


def scale_ratio(crossfit: DataFrame) -> DataFrame:
    """Largest over smallest within-group residual scale; ``unbounded`` if one is degenerate or fewer
    than two are positive."""
    groups = crossfit.groupBy("scope", "candidate_id", "group_token").agg(F.count("*").alias("n"), F.stddev_samp(F.col("y") - F.col("yhat")).alias("s")).filter(F.col("n") >= 2)
    sound = F.when(F.col("s") > DEGENERATE, F.col("s"))
    out = groups.groupBy("scope", "candidate_id").agg(F.max(sound).alias("hi"), F.min(sound).alias("lo"), F.count(sound).alias("positive"), F.count("*").alias("all"))
    return out.select("scope", "candidate_id", F.when(F.col("positive") >= 2, F.col("hi") / F.col("lo")).alias("scale_ratio"), ((F.col("positive") < F.col("all")) | (F.col("positive") < 2)).alias("unbounded"))


def residual_groups(crossfit: DataFrame) -> DataFrame:
    """Per scope, candidate and group: rows, mean and second to fourth central sums of the residuals."""
    e = F.col("y") - F.col("yhat")
    s = crossfit.groupBy("scope", "candidate_id", "group_token").agg(F.count("*").alias("n"), F.avg(e).alias("mean"), F.var_pop(e).alias("v"), F.skewness(e).alias("g1"), F.kurtosis(e).alias("g2"))
    m2, spread = F.col("v") * F.col("n"), F.col("v") > 0
    return s.select("scope", "candidate_id", "group_token", "n", "mean", m2.alias("m2"), F.when(spread, F.col("g1") * F.sqrt(m2 * m2 * m2 / F.col("n"))).otherwise(0.0).alias("m3"), F.when(spread, (F.col("g2") + 3) * m2 * m2 / F.col("n")).otherwise(0.0).alias("m4"))


def _diagnostics(groups: DataFrame) -> DataFrame:
    """``residual_moments``, ``scale_ratio`` and the number of groups, put together from ``residual_groups``."""
    keys = ["scope", "candidate_id"]
    centre = groups.groupBy(*keys).agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("location"))
    n, d = F.col("n"), F.col("mean") - F.col("location")
    m2, m3, m4 = F.col("m2") + n * d**2, F.col("m3") + 3 * d * F.col("m2") + n * d**3, F.col("m4") + 4 * d * F.col("m3") + 6 * d**2 * F.col("m2") + n * d**4
    own = F.when(n >= 2, F.sqrt(F.col("m2") / (n - 1)))
    sound = F.when(own > DEGENERATE, own)
    s = groups.join(centre, keys).groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum(m2).alias("s2"), F.sum(m3).alias("s3"), F.sum(m4).alias("s4"), F.count("*").alias("n_groups"),
        F.max(sound).alias("hi"), F.min(sound).alias("lo"), F.count(sound).alias("positive"), F.count(own).alias("all"),
    )
    n, spread = F.col("n").cast("double"), F.col("s2") > 0
    g1, g2 = F.sqrt(n) * F.col("s3") / F.sqrt(F.col("s2") * F.col("s2") * F.col("s2")), n * F.col("s4") / (F.col("s2") * F.col("s2")) - 3
    return s.select(
        *keys, "n", "n_groups",
        F.when(spread & (n > 2), g1 * F.sqrt(n * (n - 1)) / (n - 2)).alias("skewness"),
        F.when(spread & (n > 3), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)).alias("excess_kurtosis"),
        F.when(F.col("positive") >= 2, F.col("hi") / F.col("lo")).alias("scale_ratio"),
        F.when(F.col("all") > 0, (F.col("positive") < F.col("all")) | (F.col("positive") < 2)).alias("unbounded"),
    )


def residual_tables(crossfit: DataFrame) -> dict[str, DataFrame]:
    """What both parametric headrooms start from: two passes over the rows."""
    samples = written(tails.point_samples(crossfit), "samples", rows_per_file=tails.ROWS_PER_FILE)
    return {"groups": written(residual_groups(crossfit), "residuals"), "samples": samples, "found": tails.moments(samples)}


def parametric_headroom(crossfit: DataFrame, policy: Policy, student: bool, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """H2 (or H3, ``student``) per scope: the least headroom over the scope's equivalence set.

    ``crossfit`` holds the candidates of the equivalence set only. A candidate without a sound fit is
    left out, never replaced. ``tables``: its ``residual_tables``, if they are there already.
    """
    tables = tables or residual_tables(crossfit)
    exact = lambda keys: tails.point_samples(crossfit.join(keys, ["scope", "candidate_id"], "left_semi"), tails.whole)
    solved = tails.tail_headroom(tables["samples"], policy.lower_limit, policy.alpha, policy.maximum_shift, student, found=tables["found"], exact=exact).drop("location", "scale", "df", "replicate")
    joined = _diagnostics(tables["groups"]).join(solved, ["scope", "candidate_id"])
    sound = F.col("failure_code").isNull() & (F.col("n") >= 4) & (F.col("n_groups") >= 2)
    s = joined.withColumn("sound", sound).groupBy("scope").agg(
        F.min(F.when(F.col("sound"), F.col("headroom"))).alias("point_estimate"),
        F.count_if("sound").alias("eligible"),
        F.count_if(~F.col("sound")).alias("failed"),
        F.array_sort(F.collect_set("failure_code")).alias("failures"),
        F.max(F.when(F.col("sound"), F.abs("skewness"))).alias("skewness"),
        F.max(F.when(F.col("sound"), F.col("excess_kurtosis"))).alias("kurtosis"),
        F.max(F.when(F.col("sound"), F.col("scale_ratio"))).alias("ratio"),
        F.bool_or(F.col("sound") & F.coalesce("unbounded", F.lit(True))).alias("unbounded"),
        F.count_if(F.col("sound") & ~F.col("feasible")).alias("infeasible"),
        F.count_if(F.col("sound") & F.col("censored")).alias("censored"),
    )
    material = [(F.col("failed") > 0, "PARAMETRIC_FIT_EXCLUDED"), (F.col("infeasible") > 0, "PARAMETRIC_INSUFFICIENT_SUPPORT")]
    if not student:
        material += [
            (F.col("skewness") > SKEWNESS, "RESIDUAL_SKEW_DIAGNOSTIC"),
            (F.col("kurtosis") > KURTOSIS, "HEAVY_TAIL_DIAGNOSTIC"),
            (F.col("unbounded") | (F.col("ratio") > SCALE_RATIO), "GROUPWISE_SCALE_DIAGNOSTIC"),
        ]
    light = [(F.col("censored") > 0, "PARAMETRIC_SEARCH_CENSORED")]
    status = F.when(F.col("eligible") == 0, "ineligible").when(F.size(codes(*material, *light)) > 0, "warning").otherwise("ok")
    return s.select(
        "scope", F.lit(H3 if student else H2).alias("protocol_id"), status.alias("status"), "point_estimate",
        (F.size(codes(*material)) > 0).alias("material_warning"), F.concat(codes(*material, *light), F.col("failures")).alias("warnings"),
    )
