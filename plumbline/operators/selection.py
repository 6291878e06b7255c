"""Scores, ties and switching boundaries over the candidate ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.prepare import Policy

BASELINE = "M0_intercept"


def score(ledger: DataFrame, c: float) -> DataFrame:
    """Adds xpe, lambda and c_score; null where a risk is missing or the scope's baseline failed."""
    base = ledger.filter((F.col("candidate_id") == BASELINE) & (F.col("status") == "ok") & (F.col("grouped_risk") > 0)).select("scope", F.col("grouped_risk").alias("baseline_risk"))
    out = ledger.join(base, "scope", "left")
    usable = (F.col("status") == "ok") & (F.col("grouped_risk") > 0) & F.col("baseline_risk").isNotNull()
    xpe = F.when(usable, F.col("baseline_risk") / F.col("grouped_risk"))
    lam = F.when(usable, F.lit(float(c)) / F.log("n_rows"))
    return out.withColumns({"xpe": xpe, "lambda": lam}).withColumn("c_score", F.col("bic_eff") - F.col("lambda") * F.log("xpe"))


def rank_candidates(scored: DataFrame, policy: Policy) -> DataFrame:
    """Rank, gap to the next, and near-tie membership, by score and then library order."""
    w = Window.partitionBy("scope").orderBy("c_score", "ordinal")
    best = F.first("c_score").over(w)
    threshold = F.greatest(F.lit(policy.abs_tolerance), policy.rel_tolerance * F.greatest(F.lit(1.0), F.abs(best)))
    return scored.filter(F.col("c_score").isNotNull()).select(
        "scope", "candidate_id", "ordinal", "c_score",
        F.row_number().over(w).alias("rank"),
        (F.lead("c_score").over(w) - F.col("c_score")).alias("gap_to_next"),
        (F.col("c_score") - best <= threshold).alias("equivalent"),
    )


def select_candidate(scored: DataFrame, policy: Policy) -> DataFrame:
    """One row per scope: raw winner, winner (null in a near tie), runner-up, gap, equivalence set."""
    ranked = rank_candidates(scored, policy)
    out = ranked.groupBy("scope").agg(
        F.min_by("candidate_id", "rank").alias("raw_winner"),
        F.min_by("candidate_id", F.when(F.col("rank") == 2, F.col("rank"))).alias("runner_up"),
        F.min_by("gap_to_next", "rank").alias("gap"),
        F.array_sort(F.collect_list(F.when(F.col("equivalent"), F.struct("ordinal", "candidate_id")))).alias("e"),
    )
    near = F.size("e") > 1
    return out.select("scope", "raw_winner", F.when(~near, F.col("raw_winner")).alias("winner"), "runner_up", "gap", near.alias("near_tie"), F.transform("e", lambda x: x["candidate_id"]).alias("equivalence_set"))


def pairwise_switches(scored: DataFrame, c: float) -> DataFrame:
    """For each pair of candidates the weight c at which their order switches."""
    pick = lambda s: scored.select("scope", "n_rows", F.col("ordinal").alias(f"o{s}"), F.col("candidate_id").alias(f"candidate_{s}"), F.col("bic_eff").alias(f"bic_{s}"), F.when(F.col("grouped_risk") > 0, F.col("grouped_risk")).alias(f"risk_{s}"))
    pairs = pick("a").join(pick("b").drop("n_rows"), "scope").filter(F.col("oa") < F.col("ob"))
    delta = F.col("bic_b") - F.col("bic_a")
    ratio = F.log("risk_a") - F.log("risk_b")
    whole = F.col("bic_a").isNotNull() & F.col("bic_b").isNotNull() & F.col("risk_a").isNotNull() & F.col("risk_b").isNotNull()
    same = F.col("risk_a") == F.col("risk_b")
    at = F.when(whole & ~same, delta * F.log("n_rows") / ratio)
    pairs = pairs.withColumn("switch_c", F.when(F.abs(at) < float("inf"), at + 0.0))
    status = (
        F.when(~whole, "not_available")
        .when(same & (delta == 0), "coincident")
        .when(same, "parallel_no_switch")
        .when(F.col("switch_c").isNull(), "not_available")
        .when(F.col("switch_c") < 0, "outside_nonnegative_domain")
        .otherwise("finite")
    )
    pairs = pairs.withColumn("status", status)
    steady = F.when(delta < 0, F.col("candidate_b")).otherwise(F.col("candidate_a"))
    crossing = F.col("status").isin("finite", "outside_nonnegative_domain")
    below = F.when(crossing, F.when(ratio > 0, F.col("candidate_a")).otherwise(F.col("candidate_b"))).when(F.col("status") == "parallel_no_switch", steady)
    above = F.when(crossing, F.when(ratio > 0, F.col("candidate_b")).otherwise(F.col("candidate_a"))).when(F.col("status") == "parallel_no_switch", steady)
    now = F.when(crossing, F.when(F.lit(c) < F.col("switch_c"), below).when(F.lit(c) > F.col("switch_c"), above)).otherwise(below)
    return pairs.select("scope", "candidate_a", "candidate_b", "status", "switch_c", below.alias("preference_below"), above.alias("preference_above"), now.alias("preference_at_current"))
