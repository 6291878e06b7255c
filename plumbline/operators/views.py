"""Projections of result tables for dashboards, and drift against a recorded row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def protocol_rows(protocols: DataFrame) -> DataFrame:
    """Protocol results as shown: rounded, with the bound where there is one."""
    return protocols.select("scope", "protocol_id", "status", F.round("point_estimate", 2).alias("estimate"), F.round("lower_bound", 2).alias("lower_bound"), F.array_join("warnings", ", ").alias("warnings"))


def gate_view(g1: DataFrame, g2: DataFrame) -> DataFrame:
    """One row per scope and gate."""
    a = g1.select("scope", "protocol_id", F.col("state").alias("state"), F.array_join("warnings", ",").alias("detail"))
    b = g2.select("scope", "protocol_id", F.when(F.col("action_supported"), "pass").otherwise("ineligible").alias("state"), F.array_join("reason_codes", ",").alias("detail"))
    return a.unionByName(b)


def dataset_counts(rows: DataFrame) -> DataFrame:
    """One row per scope: how much of what an audit saw. A role that is not available counts 0."""
    of = lambda c, name: F.count_distinct(c).alias(name)
    return rows.groupBy("scope").agg(F.count("*").alias("n_rows"), of("group_token", "n_groups"), of("product", "n_products"), of("stream", "n_streams"), of("shift", "n_shifts"))


def conflict_summary(decisions: DataFrame) -> DataFrame:
    """(scope, conflict, detail): none; material, with the order's warning deciding; or material, with a careful action."""
    ordered = F.col("state") == "diagnose_process_first"
    conflict = F.when(~F.col("material_protocol_conflict"), "none").when(ordered, "order_decides").otherwise("conservative")
    detail = (
        F.when(conflict == "none", "The protocols do not differ materially.")
        .when(conflict == "order_decides", "The protocols differ materially; the warning on ordered stability decides.")
        .otherwise("The protocols differ materially; the action stays careful.")
    )
    return decisions.select("scope", conflict.alias("conflict"), detail.alias("detail"))


def benchmark_record(tables: dict[str, DataFrame]) -> DataFrame:
    """One summary row per scope of an audit."""
    d, s = tables["decisions"], tables["selection"].select("scope", "winner", "runner_up")
    p = tables["protocols"].groupBy("scope").pivot("protocol_id", ["H1_group_empirical_quantile", "H2_gaussian_residual_tail", "H3_student_t_residual_tail"]).agg(F.round(F.first("point_estimate"), 2))
    return d.select("scope", "state", "pilot_lower", "pilot_upper").join(s, "scope", "left").join(p, "scope", "left")


def drift(record: DataFrame, recorded: DataFrame, key: str = "scope") -> DataFrame:
    """(key, field, now, was) of every value that differs from the recorded row."""
    columns = [c for c in record.columns if c != key and c in recorded.columns]
    j = record.alias("a").join(recorded.alias("b"), key, "full_outer")
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"a.{c}").cast("string").alias("now"), F.col(f"b.{c}").cast("string").alias("was")) for c in columns])
    return j.select(key, F.explode(cells).alias("x")).select(key, "x.*").filter(~F.col("now").eqNullSafe(F.col("was")))
