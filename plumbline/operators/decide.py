"""From protocol results to one bounded, reason-coded action per scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.fixed_values import H2, H3
from plumbline.operators.headroom import codes
from plumbline.operators.prepare import Policy


def as_decimal(x: Column) -> Column:
    """A double as the decimal that it prints as."""
    return x.cast("string").try_cast("decimal(38,18)")


def attach_bounds(protocols: DataFrame, bounds: DataFrame) -> DataFrame:
    """Headroom rows with the bootstrap's lower bound, where both are sound."""
    b = bounds.filter("valid").select("scope", "protocol_id", "lower_bound")
    return protocols.join(b, ["scope", "protocol_id"], "left").withColumn("lower_bound", F.when(F.col("status") != "ineligible", F.col("lower_bound")))


def safe_headroom(protocols: DataFrame) -> DataFrame:
    """The least conservative value (bound, else point) over eligible protocols, its basis and spread.

    ``protocols``: scope, protocol_id, status, point_estimate, lower_bound, material_warning.
    """
    fit = (F.col("status") != "ineligible") & F.col("point_estimate").isNotNull()
    value = F.when(fit, F.coalesce("lower_bound", "point_estimate"))
    s = protocols.groupBy("scope").agg(
        F.min(value).alias("safe_headroom"),
        (F.max(value) - F.min(value)).alias("spread"),
        F.count(value).alias("eligible"),
        F.count("*").alias("protocols"),
        F.bool_and(F.when(fit, F.col("lower_bound").isNotNull())).alias("bounded"),
        F.coalesce(F.bool_or(F.col("protocol_id").isin(H2, H3) & F.col("material_warning")), F.lit(False)).alias("parametric_warning"),
    )
    basis = F.when(F.col("eligible") == 0, "none").when(F.col("bounded"), "lower_bounds").otherwise("point_estimates_without_bound")
    return s.select(
        "scope", "safe_headroom", basis.alias("basis"), F.when(F.col("eligible") >= 2, F.col("spread")).alias("protocol_spread"), "eligible",
        ((F.col("eligible") > 0) & (F.col("eligible") < F.col("protocols"))).alias("mixed_states"), "parametric_warning",
    )


def pilot_range(df: DataFrame, supported: Column, policy: Policy) -> DataFrame:
    """Adds pilot_lower, pilot_upper and pilot_guard to rows with safe_headroom: floors to the resolution
    in decimals; a guard means there is no range."""
    h, low, high = as_decimal(F.col("safe_headroom")), as_decimal(F.lit(float(policy.minimum_shift))), as_decimal(F.lit(float(policy.maximum_shift)))
    share = lambda s: F.col("__h") * F.lit(s).cast("decimal(4,2)")
    df = df.withColumns({"__h": h, "__low": low, "__high": high})
    lower = F.when(supported, F.greatest(F.col("__low"), share("0.30").cast("decimal(38,18)"))).otherwise(F.col("__low"))
    upper = F.least(F.col("__high"), F.when(supported, share("0.80").cast("decimal(38,18)")).otherwise(share("0.50").cast("decimal(38,18)")))
    if policy.resolution is None or not policy.resolution > 0:
        floor = lambda x: F.lit(None).cast("decimal(38,18)")
    else:
        step = as_decimal(F.lit(float(policy.resolution)))
        floor = lambda x: (F.floor(x / step).cast("decimal(20,0)") * step.cast("decimal(18,12)")).cast("decimal(38,18)")
    df = df.withColumns({"__l": floor(lower), "__u": floor(upper)})
    guard = (
        F.when(F.col("safe_headroom").isNull() | F.isnan("safe_headroom"), "NO_ELIGIBLE_HEADROOM")
        .when(F.col("__u").isNull(), "MEASUREMENT_RESOLUTION_UNAVAILABLE")
        .when(F.col("__u") <= 0, "PILOT_RANGE_NONPOSITIVE")
        .when((F.col("__l") < F.col("__low")) | (F.col("__u") < F.col("__low")), "PILOT_RANGE_SUBMINIMUM")
        .when(F.col("__u") < F.col("__l"), "PILOT_RANGE_INVERTED")
    )
    df = df.withColumn("pilot_guard", guard)
    return df.withColumns({"pilot_lower": F.when(F.col("pilot_guard").isNull(), F.col("__l").cast("double")), "pilot_upper": F.when(F.col("pilot_guard").isNull(), F.col("__u").cast("double"))}).drop("__h", "__low", "__high", "__l", "__u")


def action_state(table: DataFrame, policy: Policy) -> DataFrame:
    """The six-state machine over one row per scope, first trigger wins.

    ``table``: scope, contract_valid, action_supported, g1_state, near_tie and what ``safe_headroom``
    returns.
    """
    h = F.col("safe_headroom")
    headroom_reason = F.when(h.isNull() | F.isnan(h), "NO_ELIGIBLE_HEADROOM").when(h <= 0, "HEADROOM_NONPOSITIVE").when(h < policy.minimum_shift, "HEADROOM_BELOW_MINIMUM_ACTIONABLE")
    spread = F.coalesce(F.col("protocol_spread") > policy.spread_tolerance, F.lit(False))
    conflict = spread | F.col("mixed_states") | F.col("parametric_warning")
    unbounded = F.col("basis") == "point_estimates_without_bound"
    conservative = conflict | F.col("near_tie") | F.col("parametric_warning") | unbounded
    t = table.withColumns({"headroom_reason": headroom_reason, "spread_material": spread, "conflict": conflict, "conservative": conservative})
    t = pilot_range(t, ~F.col("conservative"), policy)
    blocked = (
        F.when(~F.col("contract_valid"), "invalid_contract")
        .when(~F.col("action_supported"), "insufficient_evidence")
        .when(F.col("headroom_reason").isNotNull(), "no_actionable_headroom")
        .when(F.col("g1_state") == "material_warning", "diagnose_process_first")
    )
    state = F.coalesce(blocked, F.when(F.col("pilot_guard").isNotNull(), "no_actionable_headroom").when(F.col("conservative"), "pilot_only_conservative").otherwise("pilot_range_supported"))
    t = t.withColumn("state", state)
    pilot = F.col("state").isin("pilot_only_conservative", "pilot_range_supported")
    detail = codes(
        (F.col("spread_material"), "PROTOCOL_SPREAD_MATERIAL"),
        (F.col("mixed_states"), "PROTOCOL_STATE_OR_ASSUMPTION_CONFLICT"),
        (F.col("near_tie"), "SELECTION_NEAR_TIE"),
        (F.col("parametric_warning"), "PARAMETRIC_DIAGNOSTIC_MATERIAL"),
        (F.col("basis") == "point_estimates_without_bound", "UNCERTAINTY_BOUND_UNAVAILABLE"),
        (F.lit(True), "CONSERVATIVE_PILOT_REFERENCE"),
    )
    reasons = (
        F.when(F.col("state") == "invalid_contract", F.array(F.lit("CONTRACT_INVALID")))
        .when(F.col("state") == "insufficient_evidence", F.array(F.lit("EVIDENCE_INSUFFICIENT")))
        .when(F.col("state") == "no_actionable_headroom", F.array(F.coalesce("headroom_reason", "pilot_guard")))
        .when(F.col("state") == "diagnose_process_first", F.array(F.lit("ORDERED_STABILITY_MATERIAL_WARNING")))
        .when(F.col("state") == "pilot_only_conservative", detail)
        .otherwise(F.array(F.lit("SUPPORTED_PILOT_REFERENCE")))
    )
    return t.select(
        "scope", "state", reasons.alias("reason_codes"), "safe_headroom", "basis", "protocol_spread", F.col("conflict").alias("material_protocol_conflict"), "near_tie",
        F.when(pilot, F.col("pilot_lower")).alias("pilot_lower"), F.when(pilot, F.col("pilot_upper")).alias("pilot_upper"), "contract_valid", "action_supported", "g1_state",
        F.lit("retrospective screening reference; requires a controlled pilot and engineering review; not a production setpoint").alias("claim_boundary"),
    )
