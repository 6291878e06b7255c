"""G1: four run rules on the ordered rows of each product and stream.

A stream is cut into range parts, and no task holds more of it than one. What a part's end means for
the next (its last value, the run that is open, rows so far, segments so far) is one row per part; these
rows are put together in order by windows over the parts, not over the rows.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.fixed_values import G1
from plumbline.operators.headroom import codes
from plumbline.operators.prepare import Policy
from plumbline.session import written

D2 = 1.128
STREAM = ["scope", "product", "stream"]


def ordered_segments(rows: DataFrame) -> DataFrame:
    """Rows in order with their segment. Ties with blank or repeated keys are dropped and split the
    sequence; ``resolved`` says which rows stay. ``part`` and ``at``: the range part and the place in it.
    """
    blank = (F.size("tie_key") == 0) | F.exists("tie_key", lambda k: k.isNull() | (k == ""))
    keys = rows.groupBy(*STREAM, "time_h", "tie_key").agg(F.count("*").alias("n"), F.max(blank.cast("int")).alias("blank"))
    ties = keys.groupBy(*STREAM, "time_h").agg(F.sum("n").alias("n_tied"), F.max("blank").alias("any_blank"), F.count("tie_key").alias("n_keys"))
    ties = ties.select(*[F.col(c).alias(f"__{c}") for c in (*STREAM, "time_h")], "n_tied", "any_blank", "n_keys")
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*STREAM, "time_h")])
    marked = rows.select(*STREAM, "y", "time_h", "tie_key").join(ties, same)
    resolved = (F.col("n_tied") == 1) | ((F.col("any_blank") == 0) & (F.col("n_keys") == F.col("n_tied")))
    order = [*STREAM, "time_h", "tie_key"]
    spread = marked.select(*order, "y", resolved.alias("resolved")).repartitionByRange(*order).sortWithinPartitions(*order)
    parts = written(spread.withColumn("at", F.monotonically_increasing_id()), "ordered").withColumn("part", F.shiftright("at", 33))
    lost = (~F.col("resolved")).cast("long")
    before = Window.partitionBy(*STREAM).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy("part", *STREAM).agg(F.sum(lost).alias("lost"))
    counts = counts.select("part", *STREAM, F.coalesce(F.sum("lost").over(before), F.lit(0)).alias("earlier"))
    upto = Window.partitionBy("part", *STREAM).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _met(parts, counts, ["part", *STREAM]).withColumn("segment", F.col("earlier") + F.sum(lost).over(upto)).drop("earlier")


def _met(rows: DataFrame, states: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the state of their part, null keys included."""
    named = states.select(*[F.col(c).alias(f"__{c}") for c in keys], *[c for c in states.columns if c not in keys])
    return rows.join(named, reduce(and_, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys])).drop(*[f"__{c}" for c in keys])


def ordered_coverage(segments: DataFrame, policy: Policy) -> DataFrame:
    """Per scope: rows in segments that are long enough, and their share of all rows."""
    sizes = segments.groupBy(*STREAM, "segment").agg(F.count_if("resolved").alias("n"), F.count_if(~F.col("resolved")).alias("dropped"))
    long = F.col("n") >= policy.min_points
    return sizes.groupBy("scope").agg(
        F.sum(F.col("n") + F.col("dropped")).alias("n_rows"),
        F.sum("dropped").alias("unresolved_rows"),
        F.coalesce(F.sum(F.when(long, F.col("n"))), F.lit(0)).alias("eligible_rows"),
        F.count_distinct(F.when(long, F.struct("product", "stream"))).alias("eligible_streams"),
        (F.coalesce(F.sum(F.when(long, F.col("n"))), F.lit(0)) / F.sum(F.col("n") + F.col("dropped"))).alias("coverage"),
    )


def piece_states(kept: DataFrame) -> DataFrame:
    """One row for each part of a segment: its rows, first and last value, the sum of its steps; and from
    the parts before it the rows so far and the last value."""
    key = [*STREAM, "segment"]
    order = Window.partitionBy("part", *key).orderBy("at")
    steps = kept.withColumn("step", F.abs(F.col("y") - F.lag("y").over(order)))
    pieces = steps.groupBy("part", *key).agg(F.count("*").alias("size"), F.min_by("y", "at").alias("first"), F.max_by("y", "at").alias("last"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("moved"))
    over = Window.partitionBy(*key).orderBy("part")
    pieces = pieces.withColumns({"previous": F.lag("last").over(over), "offset": F.coalesce(F.sum("size").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    return pieces.withColumn("moved", F.col("moved") + F.coalesce(F.abs(F.col("first") - F.col("previous")), F.lit(0.0)))


def long_runs(rows: DataFrame, sign: str, least: int) -> DataFrame:
    """(segment's key, hits): the runs of one sign, not zero, of at least ``least`` rows.

    Runs are found part by part. Those that touch an end of their part go on in the next one if its first
    run has their sign; only they are looked at across parts.
    """
    key = [*STREAM, "segment"]
    order = Window.partitionBy("part", *key).orderBy("at")
    fresh = (~F.col(sign).eqNullSafe(F.lag(sign).over(order)) | (F.row_number().over(order) == 1)).cast("int")
    numbered = rows.select("part", *key, "at", F.col(sign).alias("sign"), fresh.alias("fresh")).withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = numbered.groupBy("part", *key, "run").agg(F.first("sign").alias("sign"), F.count("*").alias("length"))
    runs = runs.withColumn("last", F.max("run").over(Window.partitionBy("part", *key)))
    inner = runs.filter((F.col("run") > 1) & (F.col("run") < F.col("last"))).select(*key, "sign", "length")
    over = Window.partitionBy(*key).orderBy("part", "run")
    ends = runs.filter((F.col("run") == 1) | (F.col("run") == F.col("last")))
    # a part's last run opens a new one unless it is its first as well
    opens = (F.col("run") > 1) | ~F.col("sign").eqNullSafe(F.lag("sign").over(over))
    joined = ends.withColumn("island", F.sum(opens.cast("int")).over(over.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    across = joined.groupBy(*key, "island").agg(F.first("sign").alias("sign"), F.sum("length").alias("length")).drop("island")
    return inner.unionByName(across).filter((F.col("sign") != 0) & (F.col("length") >= least)).groupBy(*key).agg(F.count("*").alias("hits"))


def segment_rules(segments: DataFrame, policy: Policy) -> DataFrame:
    """Per eligible segment: size, scale and the hits of each rule."""
    key = [*STREAM, "segment"]
    x = F.col("y")
    kept = segments.filter("resolved")
    stats = kept.groupBy(*key).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd")).filter(F.col("n") >= policy.min_points)
    pieces = written(_met(piece_states(kept), stats, key), "pieces")
    moved = pieces.groupBy(*key).agg(F.sum("moved").alias("moved"), F.max("n").alias("n"), F.max("mean").alias("mean"), F.max("sd").alias("sd"))
    mr_sigma = F.col("moved") / (F.col("n") - 1) / D2
    first = written(moved.withColumns({"fallback": ~(mr_sigma > 0), "sigma": F.when(mr_sigma > 0, mr_sigma).otherwise(F.col("sd"))}).drop("moved"), "scales")
    states = _met(pieces.select("part", *key, "previous", "offset", "n", "mean"), first.select(*key, "sigma"), key)
    order = Window.partitionBy("part", *key).orderBy("at")
    rows = _met(kept.select("part", *key, "at", "y"), states, ["part", *key])
    step = x - F.coalesce(F.lag(x).over(order), F.col("previous"))
    rows = written(rows.select("part", *key, "at", "y", "n", "mean", "sigma", (F.col("offset") + F.row_number().over(order)).alias("pos"), F.signum(x - F.col("mean")).alias("side"), F.signum(step).alias("way")), "signs")
    quarter = F.greatest(F.lit(1), F.floor(F.col("n") / 4))
    sums = rows.groupBy(*key).agg(
        F.count_if((F.col("sigma") > 0) & (F.abs(x - F.col("mean")) > 3 * F.col("sigma"))).alias("beyond"),
        F.avg(F.when(F.col("pos") <= quarter, x)).alias("early"), F.avg(F.when(F.col("pos") > F.col("n") - quarter, x)).alias("late"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    hits = {name: long_runs(rows, sign, least).withColumnRenamed("hits", name) for name, sign, least in (("side", "side", 8), ("way", "way", 5))}
    out = _met(first, sums, key)
    for found in hits.values():
        named = found.select(*[F.col(c).alias(f"__{c}") for c in key], found.columns[-1])
        out = out.join(named, reduce(and_, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key]), "left").drop(*[f"__{c}" for c in key])
    return out.select(
        *key, "n", "mean", "sd", "sigma", "fallback",
        zero("beyond").alias("beyond_3sigma"), zero("side").alias("one_side_runs"), zero("way").alias("monotone_runs"),
        ((F.col("sd") > 0) & (F.abs(F.col("early") - F.col("late")) > 1.5 * F.col("sd"))).cast("long").alias("quartile_shift"),
    )


def stability_screen(rows: DataFrame, policy: Policy) -> DataFrame:
    """One row per scope: state, coverage, summed rule counts, warnings."""
    located = rows.filter(F.col("stream").isNotNull() & F.col("time_h").isNotNull())
    if not policy.order_confirmed:
        located = located.limit(0)
    located = located.withColumn("product", F.coalesce("product", F.lit("ALL")))
    segments = ordered_segments(located)
    coverage = ordered_coverage(segments, policy).drop("n_rows")
    rules = segment_rules(segments, policy).groupBy("scope").agg(*[F.sum(c).alias(c) for c in ("beyond_3sigma", "one_side_runs", "monotone_runs", "quartile_shift")], F.count_if("fallback").alias("fallbacks"))
    all_rows = rows.groupBy("scope").agg(F.count("*").alias("n_rows"), F.count_if(F.col("stream").isNull()).alias("no_stream"), F.count_if(F.col("time_h").isNull()).alias("no_time"))
    out = all_rows.join(coverage, "scope", "left").join(rules, "scope", "left")
    covered = F.coalesce(F.col("coverage"), F.lit(0.0))
    unconfirmed = (F.col("no_time") > 0) | F.lit(not policy.order_confirmed)
    enough = covered >= policy.min_coverage
    hit = lambda c: enough & (F.coalesce(F.col(c), F.lit(0)) > 0)
    material = [(hit("beyond_3sigma"), "STABILITY_POINT_BEYOND_3SIGMA"), (hit("one_side_runs"), "STABILITY_EIGHT_ONE_SIDE"), (hit("monotone_runs"), "STABILITY_SIX_MONOTONE"), (hit("quartile_shift"), "STABILITY_QUARTILE_SHIFT")]
    warnings = codes(
        (unconfirmed, "ORDER_UNCONFIRMED"),
        (~unconfirmed & (F.col("no_stream") > 0), "ORDER_STREAM_UNAVAILABLE"),
        (F.coalesce(F.col("unresolved_rows"), F.lit(0)) > 0, "ORDER_TIE_UNRESOLVED"),
        (~unconfirmed & (F.col("no_stream") == 0) & ~enough, "ORDERED_COVERAGE_INSUFFICIENT"),
        (hit("fallbacks"), "MR_SCALE_FALLBACK"),
        *material,
    )
    ineligible = unconfirmed | (F.col("no_stream") > 0) | ~enough
    state = F.when(ineligible, "ineligible").when(F.size(codes(*material)) > 0, "material_warning").otherwise("pass")
    count = lambda c: F.when(enough, F.coalesce(F.col(c), F.lit(0))).otherwise(0).alias(c)
    return out.select(
        "scope", F.lit(G1).alias("protocol_id"), state.alias("state"), "n_rows", F.coalesce("eligible_rows", F.lit(0)).alias("eligible_rows"), covered.alias("coverage"),
        count("beyond_3sigma"), count("one_side_runs"), count("monotone_runs"), count("quartile_shift"), warnings.alias("warnings"),
    )
