"""G2: is there enough evidence, for exploring and for acting?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.fixed_values import G2
from plumbline.operators.headroom import codes
from plumbline.operators.prepare import Policy, decimal


def product_support(rows: DataFrame) -> DataFrame:
    """(scope, product, n_rows, n_groups)."""
    return rows.groupBy("scope", F.coalesce("product", F.lit("ALL")).alias("product")).agg(F.count("*").alias("n_rows"), F.count_distinct("group_token").alias("n_groups"))


def sufficiency_gate(support: DataFrame, coverage: DataFrame, bootstrap: DataFrame, policy: Policy, ordered_required: bool = True) -> DataFrame:
    """One row per scope from the least supported product, ``coverage(scope, coverage)`` and
    ``bootstrap(scope, valid)``."""
    least = support.groupBy("scope").agg(F.min("n_rows").alias("rows"), F.min("n_groups").alias("groups"), F.count("*").alias("products"))
    out = least.join(coverage.select("scope", "coverage"), "scope", "left").join(bootstrap.select("scope", F.col("valid").alias("bootstrap_valid")).distinct(), "scope", "left")
    tail = (decimal(policy.alpha) * F.col("rows")).cast("double")
    boot = F.coalesce("bootstrap_valid", F.lit(False))
    measured = F.lit(policy.resolution is not None and policy.resolution > 0)
    ordered = F.lit(not ordered_required) | (F.coalesce("coverage", F.lit(-1.0)) >= policy.min_coverage)
    reasons = codes(
        (F.col("rows") < policy.min_rows, "EVIDENCE_ROWS_INSUFFICIENT"),
        (F.col("groups") < policy.min_groups_exploratory, "EVIDENCE_GROUPS_EXPLORATORY_INSUFFICIENT"),
        (F.col("groups") < policy.min_groups_action, "EVIDENCE_GROUPS_ACTION_INSUFFICIENT"),
        (tail < policy.min_tail_count, "EVIDENCE_TAIL_SUPPORT_INSUFFICIENT"),
        (~boot, "EVIDENCE_BOOTSTRAP_INSUFFICIENT"),
        (~ordered, "EVIDENCE_ORDER_INSUFFICIENT"),
        (~measured, "EVIDENCE_MEASUREMENT_INSUFFICIENT"),
    )
    exploratory = (F.col("groups") >= policy.min_groups_exploratory) & measured
    action = exploratory & (F.col("rows") >= policy.min_rows) & (F.col("groups") >= policy.min_groups_action) & (tail >= policy.min_tail_count) & boot & ordered
    return out.select(
        "scope", F.lit(G2).alias("protocol_id"), F.col("products").alias("product_scope_count"), F.col("rows").alias("minimum_product_rows"), F.col("groups").alias("minimum_product_groups"),
        tail.alias("expected_tail_count"), exploratory.alias("exploratory_supported"), action.alias("action_supported"), reasons.alias("reason_codes"),
    )
