"""Grouped linear models: leave-one-group-out by subtraction of group statistics.

Rows are aggregated once to cells (scope, group, product, stream, shift) with counts and centred sums;
all candidates and all folds are solved from the cells, since the training statistics of a fold are
the scope's less the group's. Squared errors follow from the same sums, and only where they cancel out
(a fit that is nearly exact) from scored rows. Coefficients go back to the rows by one join on the group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.fixed_values import CANDIDATES

FACTORS = ("product", "stream", "shift")
MIN_ROWS, MIN_GROUPS = 80, 4
RANK_TOLERANCE = 1e-10
FOLD_BLOCK = 1000
ALL_GROUPS = "\x01all"  # stands for all groups of a scope among its cells

COEFFICIENTS = (
    "scope string, candidate_id string, ordinal int, fold_token string, failure_code string, k int, intercept double, slope double, t_mean double, "
    "product_effects map<string,double>, stream_effects map<string,double>, shift_effects map<string,double>, n_scored long, sse double, yy double, doubtful boolean"
)
#: Below this share of the held rows' squares a sum of squared errors is taken from the rows.
CANCELLATION = 1e-6


def cell_statistics(rows: DataFrame) -> DataFrame:
    """Counts and sums per scope, group and cell, centred by the scope's means, which ``prepare`` puts on
    every row: one aggregation and no join."""
    y, t = F.col("y") - F.col("y_centre"), F.col("time_h") - F.col("t_centre")
    sums = {"sy": y, "st": t, "stt": t * t, "sty": t * y, "syy": y * y}
    return rows.groupBy("scope", "group_token", *FACTORS).agg(
        F.count("*").alias("n"), *[F.sum(x).alias(name) for name, x in sums.items()], F.first("y_centre").alias("y_mean"), F.first("t_centre").alias("t_mean")
    )


def candidate_table(spark) -> DataFrame:
    return spark.createDataFrame([(c, i, terms) for i, (c, terms) in enumerate(CANDIDATES.items())], "candidate_id string, ordinal int, terms array<string>")


def logo_grid(cells: DataFrame) -> DataFrame:
    """(scope, candidate_id, group_token, n_train, n_test): every fold of every candidate."""
    groups = cells.groupBy("scope", "group_token").agg(F.sum("n").alias("n_test"))
    totals = groups.groupBy("scope").agg(F.sum("n_test").alias("n_all"))
    spread = groups.join(totals, "scope").withColumn("candidate_id", F.explode(F.array(*[F.lit(c) for c in CANDIDATES])))
    return spread.select("scope", "candidate_id", "group_token", (F.col("n_all") - F.col("n_test")).alias("n_train"), "n_test")


def fold_levels(cells: DataFrame) -> DataFrame:
    """(scope, term, group_token, level, n_train): rows of each level that a fold's training keeps.

    A level of the held-out group with n_train = 0 is unseen in that fold.
    """
    terms = F.array(*[F.struct(F.lit(f).alias("term"), F.col(f).alias("level")) for f in FACTORS])
    held = cells.select("scope", "group_token", "n", F.explode(terms).alias("x")).select("scope", "group_token", "n", "x.*").filter(F.col("level").isNotNull())
    own = held.groupBy("scope", "term", "group_token", "level").agg(F.sum("n").alias("n_test"))
    every = held.groupBy("scope", "term", "level").agg(F.sum("n").alias("n_all"))
    return own.join(every, ["scope", "term", "level"]).select("scope", "term", "group_token", "level", (F.col("n_all") - F.col("n_test")).alias("n_train"))


def feasible(scopes: DataFrame) -> DataFrame:
    """(scope, candidate_id, ordinal, terms, reason): null reason if a candidate may be tried."""
    table = F.broadcast(candidate_table(scopes.sparkSession))
    missing = F.exists("terms", lambda t: ((t == "product") & ~F.col("has_product")) | ((t == "stream") & ~F.col("has_stream")) | ((t == "shift") & ~F.col("has_shift")) | ((t == "time") & ~F.col("has_at")))
    reason = (
        F.when(F.col("n_rows") < MIN_ROWS, "CANDIDATE_INSUFFICIENT_SUPPORT")
        .when(F.col("n_groups") < MIN_GROUPS, "SELECTION_INSUFFICIENT_GROUPS")
        .when(missing, "CANDIDATE_REQUIRED_COLUMN_MISSING")
    )
    sound = scopes.filter(F.col("failure_code").isNull())
    return sound.crossJoin(table).select("scope", "candidate_id", "ordinal", "terms", "n_rows", "n_groups", reason.alias("reason"))


class Design:
    """Normal equations of one candidate over the cells of one scope, by group."""

    def __init__(self, cells: pd.DataFrame, terms: list[str]):
        self.factors = [f for f in FACTORS if f in terms]
        self.timed = "time" in terms
        self.groups, group = np.unique(cells["group_token"].to_numpy(str), return_inverse=True)
        self.levels, columns, offset = {}, [np.zeros(len(cells), np.int64)], 1
        self.spans: dict[str, tuple[int, int]] = {}
        for f in self.factors:
            names, code = np.unique(cells[f].to_numpy(str), return_inverse=True)
            self.levels[f] = names
            self.spans[f] = (offset, offset + len(names))
            columns.append(code + offset)
            offset += len(names)
        p = offset + self.timed
        n, sy = cells["n"].to_numpy(float), cells["sy"].to_numpy(float)
        self.squares, self.sums, self.count = (np.bincount(group, cells[c].to_numpy(float), minlength=len(self.groups)) for c in ("syy", "sy", "n"))
        self.gram = np.zeros((len(self.groups), p, p))
        self.right = np.zeros((len(self.groups), p))
        for a in columns:
            np.add.at(self.right, (group, a), sy)
            for b in columns:
                np.add.at(self.gram, (group, a, b), n)
        if self.timed:
            st = cells["st"].to_numpy(float)
            for a in columns:
                np.add.at(self.gram, (group, a, np.full(len(a), p - 1)), st)
                np.add.at(self.gram, (group, np.full(len(a), p - 1), a), st)
            np.add.at(self.gram, (group, np.full(len(group), p - 1), np.full(len(group), p - 1)), cells["stt"].to_numpy(float))
            np.add.at(self.right, (group, np.full(len(group), p - 1)), cells["sty"].to_numpy(float))
        self.y_mean, self.t_mean = float(cells["y_mean"].iloc[0]), cells["t_mean"].iloc[0]

    def errors(self, beta: np.ndarray, of: np.ndarray) -> dict:
        """The squared errors over the rows of the groups ``of``, from their sums."""
        gram, right, squares = self.gram[of].sum(0), self.right[of].sum(0), self.squares[of].sum()
        n, sse = self.count[of].sum(), float(squares - 2 * beta @ right + beta @ gram @ beta)
        raw = float(squares + 2 * self.y_mean * self.sums[of].sum() + n * self.y_mean**2)
        return {"n_scored": int(n), "sse": max(sse, 0.0), "yy": raw, "doubtful": bool(sse <= CANCELLATION * squares)}

    def solve(self, gram: np.ndarray, right: np.ndarray, held: np.ndarray | None) -> dict:
        """Coefficients from training statistics; ``held``: those of the rows to predict."""
        keep = [0]
        for f in self.factors:
            a, b = self.spans[f]
            present = np.flatnonzero(np.diag(gram)[a:b] > 0.5)
            if len(present) < 2:
                return {"failure_code": "CANDIDATE_INSUFFICIENT_LEVELS"}
            keep += (a + present[1:]).tolist()
        if held is not None:
            for f in self.factors:
                a, b = self.spans[f]
                if ((np.diag(held)[a:b] > 0.5) & (np.diag(gram)[a:b] < 0.5)).any():
                    return {"failure_code": "CANDIDATE_UNSEEN_LEVEL"}
        if self.timed:
            keep.append(len(gram) - 1)
        g, r = gram[np.ix_(keep, keep)], right[keep]
        scale = np.sqrt(np.maximum(np.diag(g), 0))
        if (scale == 0).any():
            return {"failure_code": "CANDIDATE_DESIGN_RANK_DEFICIENT"}
        c = g / np.outer(scale, scale)
        if np.linalg.eigvalsh(c)[0] < RANK_TOLERANCE * len(keep):
            return {"failure_code": "CANDIDATE_DESIGN_RANK_DEFICIENT"}
        beta = np.linalg.solve(c, r / scale) / scale
        if not np.isfinite(beta).all():
            return {"failure_code": "CANDIDATE_NONFINITE_RESULT"}
        full = np.zeros(len(gram))
        full[keep] = beta
        out = {"failure_code": None, "beta": full, "k": len(keep), "intercept": full[0] + self.y_mean, "slope": full[-1] if self.timed else 0.0, "t_mean": self.t_mean if self.timed else 0.0}
        for f in self.factors:
            a, b = self.spans[f]
            out[f"{f}_effects"] = {str(n): float(full[a + i]) for i, n in enumerate(self.levels[f]) if np.diag(gram)[a + i] > 0.5}
        return out

    def folds(self) -> list[tuple[str, dict]]:
        """The fit on all groups (fold '') and on all but one."""
        whole = self.groups == ALL_GROUPS
        whole = whole if whole.any() else ~whole
        gram, right = self.gram[whole].sum(0), self.right[whole].sum(0)
        out = [("", self.solve(gram, right, None), whole)]
        if out[0][1]["failure_code"] is None:
            for i, g in enumerate(self.groups):
                if g != ALL_GROUPS:
                    out.append((g, self.solve(gram - self.gram[i], right - self.right[i], self.gram[i]), np.arange(len(self.groups)) == i))
        return [(g, fit | self.errors(fit.pop("beta"), of) if fit["failure_code"] is None else fit) for g, fit, of in out]


def fit_all(cells: DataFrame, tried: DataFrame, block: int = FOLD_BLOCK) -> DataFrame:
    """Coefficients of every feasible candidate on all rows (fold '') and without each group.

    A task gets the cells of one scope: as many as it has groups and factor combinations. Of a scope with
    more than ``block`` groups it gets those of about ``block`` groups, and the sums over all groups.
    """
    wanted = tried.filter(F.col("reason").isNull()).select("scope", "candidate_id", "ordinal", "terms", F.ceil(F.col("n_groups") / block).cast("int").alias("parts"))
    own = cells.join(wanted, "scope").withColumn("part", F.pmod(F.xxhash64("group_token"), F.col("parts")).cast("int"))
    sums = [F.sum(c).alias(c) for c in ("n", "sy", "st", "stt", "sty", "syy")]
    totals = cells.groupBy("scope", *FACTORS).agg(*sums, F.first("y_mean").alias("y_mean"), F.first("t_mean").alias("t_mean")).withColumn("group_token", F.lit(ALL_GROUPS))
    shared = totals.join(wanted.filter(F.col("parts") > 1), "scope").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    work = own.unionByName(shared)
    names = [c.strip().split(" ")[0] for c in COEFFICIENTS.replace("map<string,double>", "m").split(",")]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        fixed = {"scope": first["scope"], "candidate_id": first["candidate_id"], "ordinal": int(first["ordinal"])}
        folds = Design(pdf, list(first["terms"])).folds()
        rows = [fixed | {"fold_token": token} | result for token, result in folds if token or not first["part"]]
        if not rows:
            return pd.DataFrame(columns=names)
        out = pd.DataFrame(rows).reindex(columns=names).astype({"k": "Int32", "n_scored": "Int64", "doubtful": "boolean"})
        for c in ("failure_code", *(f"{f}_effects" for f in FACTORS)):
            out[c] = pd.Series([r.get(c) for r in rows], dtype=object)
        return out

    return work.groupBy("scope", "candidate_id", "part").applyInPandas(fit, COEFFICIENTS)


def prediction() -> Column:
    """A row's prediction; an effect that the fit does not know gives null."""
    effect = lambda f: F.when(F.col(f"{f}_effects").isNull(), F.lit(0.0)).otherwise(F.try_element_at(F.col(f"{f}_effects"), F.coalesce(F.col(f), F.lit(""))))
    timed = F.when(F.col("slope") == 0, F.lit(0.0)).otherwise(F.col("slope") * (F.col("time_h") - F.col("t_mean")))
    return F.col("intercept") + effect("product") + effect("stream") + effect("shift") + timed


def score_rows(rows: DataFrame, coefficients: DataFrame, held_out: bool) -> DataFrame:
    """Rows with ``yhat``: from the fit on all rows, or from the one without the row's group."""
    sound = coefficients.filter(F.col("failure_code").isNull())
    if held_out:
        joined = rows.join(sound.filter(F.col("fold_token") != "").withColumnRenamed("fold_token", "group_token"), ["scope", "group_token"])
    else:
        joined = rows.join(sound.filter(F.col("fold_token") == "").drop("fold_token"), "scope")
    return joined.select("scope", "group_token", "candidate_id", "ordinal", "y", "k", prediction().alias("yhat"))


def squared_errors(rows: DataFrame, coefficients: DataFrame) -> DataFrame:
    """The coefficients with ``sse`` and ``yy`` (the sum of squares of y) of what each fold was scored on.

    Sums that cancelled out are replaced by those over scored rows, of the few candidates that have any.
    """
    doubtful = coefficients.filter("doubtful").select("scope", "candidate_id").distinct()
    again = coefficients.join(doubtful, ["scope", "candidate_id"], "left_semi")
    e = F.col("y") - F.col("yhat")
    scored = [score_rows(rows, again, held).withColumn("fold_token", F.col("group_token") if held else F.lit("")) for held in (True, False)]
    exact = [x.groupBy("scope", "candidate_id", "fold_token").agg(F.sum(e * e).alias("exact")) for x in scored]
    out = coefficients.join(exact[0].unionByName(exact[1]), ["scope", "candidate_id", "fold_token"], "left")
    return out.withColumn("sse", F.coalesce("exact", "sse")).drop("exact")


def fold_metrics(errors: DataFrame) -> DataFrame:
    """SSE and MSE of every fold, failures kept, from ``squared_errors``."""
    n = F.col("n_scored")
    return errors.filter(F.col("fold_token") != "").select("scope", "candidate_id", F.col("fold_token").alias("group_token"), "failure_code", n.alias("n_test"), "sse", (F.col("sse") / n).alias("mse"))


def candidate_ledger(tried: DataFrame, errors: DataFrame) -> DataFrame:
    """One row per scope and candidate: status, criteria, risks, from ``squared_errors``."""
    full = errors.filter(F.col("fold_token") == "").select("scope", "candidate_id", F.col("failure_code").alias("full_failure"), "k", F.col("sse").alias("rss"), F.col("yy").alias("syy"))
    folds = fold_metrics(errors).groupBy("scope", "candidate_id").agg(
        F.min_by("failure_code", F.when(F.col("failure_code").isNotNull(), F.col("group_token"))).alias("fold_failure"),
        F.count_if(F.col("failure_code").isNotNull()).alias("failed_folds"),
        (F.sum("sse") / F.sum("n_test")).alias("risk"),
        F.avg("mse").alias("balanced"),
    )
    out = tried.join(full, ["scope", "candidate_id"], "left").join(folds, ["scope", "candidate_id"], "left")
    n, k = F.col("n_rows").cast("double"), F.col("k").cast("double")
    zero = F.col("rss") <= 1e-24 * F.col("syy")
    failed_full = F.col("full_failure").isNotNull()
    status = (
        F.when(F.col("reason").isNotNull(), "ineligible")
        .when(F.col("full_failure") == "CANDIDATE_INSUFFICIENT_LEVELS", "ineligible")
        .when(failed_full | zero, "fit_failed")
        .when(F.col("failed_folds") > 0, "prediction_failed")
        .otherwise("ok")
    )
    code = F.coalesce(F.col("reason"), F.col("full_failure"), F.when(zero, "CANDIDATE_FIT_FAILED"), F.col("fold_failure"))
    usable = F.col("status").isin("ok", "prediction_failed")
    aic = n * (F.log("rss") - F.log(n)) + 2 * k
    return out.withColumns({"status": status, "code": code}).select(
        "scope", "candidate_id", "ordinal", "status", F.col("code").alias("failure_code"), "n_rows", "n_groups",
        F.when(usable, F.col("k")).alias("parameter_count"),
        F.when(usable, F.col("rss")).alias("rss"),
        F.when(usable, aic).alias("aic"),
        F.when(usable & (n > k + 1), aic + 2 * k * (k + 1) / (n - k - 1)).alias("aicc"),
        F.when(usable, n * (F.log("rss") - F.log(n)) + k * F.log(n)).alias("bic_eff"),
        F.when(F.col("status") == "ok", F.col("risk")).alias("grouped_risk"),
        F.when(F.col("status") == "ok", F.col("balanced")).alias("group_balanced_risk"),
    )
