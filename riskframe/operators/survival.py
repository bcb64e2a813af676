"""Time-to-event analysis: durations, Kaplan-Meier, concordance, Brier scores, Cox regression.

Row data is reduced to one row per distinct duration (or duration x score) before anything ordered
happens; the ordered steps are ranged running sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.scalar import clip, to_number
from riskframe.operators.ordered import running_sums, sorted_position, step_lookup, trapezoid
from riskframe.session import cut_lineage

# fixed values: month length, default term, weight floor, left-limit step
DAYS_PER_MONTH = 30.44
DEFAULT_TERM = 36.0
WEIGHT_FLOOR = 1e-6
DURATION, EVENT = "duration_months", "event"
# counted tables up to this many rows may be broadcast or ordered in one task
SMALL_CURVE_ROWS = 200_000


def derive_survival(df: DataFrame, issue: str = "issue_d", end: str | None = "last_pymnt_date",
                    term: str = "term_months", outcome: str = "is_default") -> DataFrame:
    """Duration in months and event flag; rows without an outcome are left out.

    Months run from issue to the last payment, the term where that is missing, within [1, term].
    """
    rows = df.where(F.col(outcome).isNotNull())
    limit = F.coalesce(to_number(term), F.lit(DEFAULT_TERM))
    if end is not None and end in df.columns:
        months = F.datediff(F.col(end).cast("date"), F.col(issue).cast("date")) / F.lit(DAYS_PER_MONTH)
        months = F.coalesce(months, limit)
    else:
        months = limit
    return rows.withColumns({EVENT: F.col(outcome).cast("int"), DURATION: clip(months, 1.0, limit)})


# ---- Kaplan-Meier -----------------------------------------------------------------------------

def _survival_curve(counts: DataFrame, by: Sequence[str], small_groups: bool) -> DataFrame:
    """Curve from (by, t, d, n): one row per distinct time, with the step value."""
    by = list(by)
    at_risk = running_sums(counts, "t", {"n": "at_risk"}, by=by, descending=True,
                           small_groups=small_groups, keep_range=True)
    ended = F.col("d") >= F.col("at_risk")
    logs = at_risk.withColumn(
        "log_step", F.when(ended, 0.0).otherwise(F.log1p(-F.col("d") / F.col("at_risk"))))
    curve = running_sums(logs, "t", {"log_step": "log_surv"}, by=by, small_groups=small_groups)
    return curve.select(*by, "t", "d", "n", "at_risk",
                        F.when(ended, 0.0).otherwise(F.exp("log_surv")).alias("surv"))


def kaplan_meier(df: DataFrame, duration: str = DURATION, event: str = EVENT,
                 by: Sequence[str] = (), of_censoring: bool = False,
                 small_groups: bool = False) -> DataFrame:
    """Survival curve (by, t, d, n, at_risk, surv) at every distinct duration.

    ``of_censoring`` flips the event, which gives the censoring curve G.
    """
    hit = F.col(event) == (0 if of_censoring else 1)
    rows = df.where(F.col(duration).isNotNull() & F.col(event).isNotNull())
    counts = rows.groupBy(*by, F.col(duration).cast("double").alias("t")).agg(
        F.count_if(hit).alias("d"), F.count(F.lit(1)).alias("n"))
    return _survival_curve(counts, by, small_groups or not by)


# ---- Concordance ------------------------------------------------------------------------------

def concordance(df: DataFrame, duration: str = DURATION, score: str = "score",
                event: str = EVENT) -> DataFrame:
    """Exact C-index (a higher score should live longer): one row with pair counts.

    Pairs are never formed.  Every row gets an integer time key (an event at t comes before a
    censoring at t).  Two keys differ first at exactly one bit, so each comparable pair is counted
    at exactly one (level, node): event rows with bit 0 against rows with bit 1 under the same
    higher bits.  Inside a node the count of greater scores is a ranged running sum, so the work is
    rows x log(distinct times) and no node has to fit in one task.
    """
    rows = df.select(F.col(duration).cast("double").alias("t"), F.col(score).cast("double").alias("s"),
                     (F.col(event) == 1).alias("e")).na.drop()
    # written once: the input is evaluated a single time, and the plans below stay shallow
    cells = cut_lineage(rows.groupBy("t", "e", "s").agg(F.count(F.lit(1)).alias("n")))
    times = cells.groupBy("t").agg(F.lit(1).cast("bigint").alias("one"))
    n_times = times.count()
    small = n_times <= SMALL_CURVE_ROWS
    ranks = running_sums(times, "t", {"one": "rank"}).select("t", "rank")
    keyed = cells.join(F.broadcast(ranks) if small else ranks, "t").select(
        (F.col("rank") * 2 + F.when(F.col("e"), 0).otherwise(1)).alias("k"), "e", "s", "n")

    # bits of the largest key: 2 x times + 1
    levels = (2 * n_times + 1).bit_length()
    spread = keyed.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    bit = F.expr("(shiftright(k, level) & 1)")
    spread = spread.withColumn("bit", bit).where("bit = 1 or e")
    cells = cut_lineage(spread.groupBy("level", F.expr("shiftright(k, level + 1)").alias("node"), "s").agg(
        F.sum(F.when(F.col("bit") == 0, F.col("n")).otherwise(0)).alias("early"),
        F.sum(F.when(F.col("bit") == 1, F.col("n")).otherwise(0)).alias("late")))
    ranged = running_sums(cells, "s", {"late": "late_cum", "early": "early_cum"},
                          by=["level", "node"], descending=True, small_groups=False)
    big = "decimal(19,0)"
    early, late = F.col("early").cast(big), F.col("late").cast(big)
    greater = (F.col("late_cum") - F.col("late")).cast(big)
    # early rows with a greater score than a late row: the discordant pairs
    lower = (F.col("early_cum") - F.col("early")).cast(big)
    zero = F.lit(0).cast("decimal(38,0)")
    sums = ranged.agg(
        F.coalesce(F.sum(early * greater), zero).alias("concordant"),
        F.coalesce(F.sum(early * late), zero).alias("tied"),
        F.coalesce(F.sum(late * lower), zero).alias("discordant"))
    c, t, d = (F.col(x).cast("double") for x in ("concordant", "tied", "discordant"))
    return sums.select(
        c.alias("concordant"), t.alias("tied"), (c + t + d).alias("comparable"),
        F.when(c + t + d > 0, (c + t / 2) / (c + t + d)).alias("c_index"))


# ---- Brier ------------------------------------------------------------------------------------

def brier_scores(df: DataFrame, horizons: dict[float, str], duration: str = DURATION,
                 event: str = EVENT) -> DataFrame:
    """Censoring-weighted Brier score per horizon: (t, brier).

    ``horizons`` maps a horizon to the column with S(t | x).  The weights depend on the duration
    only, so squared errors are summed per duration first and the rows are never joined.
    """
    grid = sorted(horizons)
    rows = df.where(F.col(duration).isNotNull() & F.col(event).isNotNull())
    hit = F.col(event) == 1
    sums: list[Column] = []
    for i, t in enumerate(grid):
        s = F.col(horizons[t])
        sums += [F.coalesce(F.sum(F.when(hit, s * s)), F.lit(0.0)).alias(f"dead{i}"),
                 F.coalesce(F.sum((1.0 - s) * (1.0 - s)), F.lit(0.0)).alias(f"alive{i}")]
    per_time = rows.groupBy(F.col(duration).cast("double").alias("t")).agg(
        F.count_if(~hit).alias("d"), F.count(F.lit(1)).alias("n"), *sums)
    # one running pass gives the numbers at risk, a second one the censoring curve
    risk = running_sums(per_time, "t", {"n": "at_risk"}, descending=True, keep_range=True)
    ended = F.col("d") >= F.col("at_risk")
    logs = risk.withColumn("log_step", F.when(ended, 0.0).otherwise(F.log1p(-F.col("d") / F.col("at_risk"))))
    curve = running_sums(logs, "t", {"log_step": "log_g"})
    g_at = F.when(ended, 0.0).otherwise(F.exp("log_g"))
    # durations are distinct, so G just before t is the curve without the step at t
    g_before = F.exp(F.col("log_g") - F.col("log_step"))
    curve = curve.withColumns({"g_before": g_before, "g_at": g_at})
    parts = []
    for i, t in enumerate(grid):
        dead = F.sum(F.when(F.col("t") <= t, F.col(f"dead{i}") / F.greatest("g_before", F.lit(WEIGHT_FLOOR))))
        alive = F.sum(F.when(F.col("t") > t, F.col(f"alive{i}")))
        g_t = F.max_by(F.when(F.col("t") <= t, F.col("g_at")), F.when(F.col("t") <= t, F.col("t")))
        weight = F.greatest(F.coalesce(g_t, F.lit(1.0)), F.lit(WEIGHT_FLOOR))
        parts += [(F.coalesce(dead, F.lit(0.0)) + F.coalesce(alive, F.lit(0.0)) / weight).alias(f"b{i}")]
    one = curve.agg(F.sum("n").alias("n"), *parts)
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(float(t)).alias("t"), (F.col(f"b{i}") / F.col("n")).alias("brier"))
        for i, t in enumerate(grid)])))


def brier_at(df: DataFrame, t: float, surv: str, duration: str = DURATION, event: str = EVENT) -> DataFrame:
    return brier_scores(df, {t: surv}, duration, event)


def integrated_brier(df: DataFrame, horizons: dict[float, str], duration: str = DURATION,
                     event: str = EVENT) -> DataFrame:
    """Trapezoid of the Brier scores over the horizons, divided by their range."""
    if len(horizons) < 2:
        raise ValueError("at least two horizons are needed")
    span = float(max(horizons) - min(horizons))
    area = trapezoid(brier_scores(df, horizons, duration, event), "t", "brier", out="ibs")
    return area.select((F.col("ibs") / span).alias("ibs"))


# ---- Cox --------------------------------------------------------------------------------------

def _tie_sums():
    """Helpers as local functions, so that they travel to the executors with the task itself."""

    def _falling_sums(m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums over l = 0..d-1 of log(m - l), 1 / (m - l) and l / (m - l), elementwise.

        Small d adds the terms; large d uses Euler-Maclaurin, so a tie of any size costs the same.
        """
        logs, inv = np.zeros_like(m), np.zeros_like(m)
        short = d <= 64
        for l in range(int(d[short].max()) if short.any() else 0):
            on = short & (d > l)
            logs[on] += np.log(m[on] - l)
            inv[on] += 1.0 / (m[on] - l)
        if (~short).any():
            # the last 32 terms exactly (the sum may end near 0), the rest by the integral formula
            mm, dd = m[~short], d[~short]
            a, b = mm - (dd - 1 - 32), mm
            lo = np.sum([np.log(mm - (dd - 1 - j)) for j in range(32)], axis=0)
            iv = np.sum([1.0 / (mm - (dd - 1 - j)) for j in range(32)], axis=0)
            lo += (b * np.log(b) - b) - (a * np.log(a) - a) + (np.log(a) + np.log(b)) / 2 + (1 / b - 1 / a) / 12
            iv += np.log(b / a) + (1 / a + 1 / b) / 2 + (1 / a**2 - 1 / b**2) / 12
            logs[~short], inv[~short] = lo, iv
        return logs, inv, m * inv - d

    def _falling_squares(m: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Sum over l = 0..d-1 of 1 / (m - l)^2, elementwise."""
        out = np.zeros_like(m)
        short = d <= 64
        for l in range(int(d[short].max()) if short.any() else 0):
            on = short & (d > l)
            out[on] += 1.0 / (m[on] - l) ** 2
        if (~short).any():
            mm, dd = m[~short], d[~short]
            a, b = mm - (dd - 1 - 32), mm
            tail = np.sum([1.0 / (mm - (dd - 1 - j)) ** 2 for j in range(32)], axis=0)
            out[~short] = tail + (1 / a - 1 / b) + (1 / a**2 + 1 / b**2) / 2 + (1 / a**3 - 1 / b**3) / 6
        return out

    return _falling_sums, _falling_squares


_falling_sums, _falling_squares = _tie_sums()


@dataclass(frozen=True)
class CoxModel:
    """Coefficients, covariate means, log-likelihood and the baseline cumulative hazard (t, h0).

    A fit tells its Newton steps and whether they ended at the tolerance.
    """

    features: tuple[str, ...]
    beta: tuple[float, ...]
    means: tuple[float, ...]
    log_likelihood: float
    baseline: DataFrame
    baseline_rows: int
    iterations: int = 0
    converged: bool = True


def fit_cox(df: DataFrame, features: Sequence[str], duration: str = DURATION, event: str = EVENT,
            penalizer: float = 0.1, max_iter: int = 25, tol: float = 1e-7) -> CoxModel:
    """Proportional hazards by Newton steps, Efron ties, ridge penalty on standardised covariates.

    Per step: (1) rows fold into per-duration weight sums, which become risk-set sums by a ranged
    running sum; (2) per-duration terms give likelihood, gradient and the rank-one Hessian part;
    (3) the rest of the Hessian is a weighted Gram matrix of the rows.  Only p-sized vectors and
    p x p matrices reach the driver.
    """
    feats = list(features)
    p = len(feats)
    rows = df.select(F.col(duration).cast("double").alias("t"), (F.col(event) == 1).cast("int").alias("e"),
                     *[F.col(f).cast("double").alias(f"x{j}") for j, f in enumerate(feats)]).na.drop()
    stats = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"x{j}").alias(f"m{j}") for j in range(p)],
                     *[F.stddev_samp(f"x{j}").alias(f"s{j}") for j in range(p)]).first()
    n = stats["n"]
    mean = np.array([stats[f"m{j}"] for j in range(p)])
    sd = np.array([stats[f"s{j}"] or 1.0 for j in range(p)])
    sd[sd == 0] = 1.0
    z = [f"z{j}" for j in range(p)]
    std = cut_lineage(rows.select("t", "e", *[((F.col(f"x{j}") - float(mean[j])) / float(sd[j])).alias(z[j])
                                              for j in range(p)]))

    n_times = std.select("t").distinct().count()
    small = n_times <= SMALL_CURVE_ROWS

    def linear(beta: np.ndarray) -> Column:
        return sum((F.col(z[j]) * float(beta[j]) for j in range(p)), F.lit(0.0))

    def risk_table(beta: np.ndarray) -> DataFrame:
        """(t, d, event sums, risk-set sums) per distinct duration."""
        w, hit = F.exp(linear(beta)), F.col("e") == 1
        weighted = std.withColumn("w", w)
        per_t = weighted.groupBy("t").agg(
            F.sum("w").alias("w"), F.sum("e").alias("d"),
            F.sum(F.when(hit, F.col("w")).otherwise(0.0)).alias("we"),
            F.sum(F.when(hit, linear(beta)).otherwise(0.0)).alias("eta"),
            *[F.sum(F.col("w") * F.col(c)).alias(f"w_{c}") for c in z],
            *[F.sum(F.when(hit, F.col("w") * F.col(c)).otherwise(0.0)).alias(f"we_{c}") for c in z],
            *[F.sum(F.when(hit, F.col(c)).otherwise(0.0)).alias(f"e_{c}") for c in z])
        sums = {"w": "S0", **{f"w_{c}": f"S_{c}" for c in z}}
        return running_sums(per_t, "t", sums, descending=True)

    cols = ["t", "d", "we", "eta", "S0", *[f"S_{c}" for c in z], *[f"we_{c}" for c in z], *[f"e_{c}" for c in z]]

    def event_terms(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Likelihood, gradient and rank-one Hessian sums of a partition's durations."""
        total = np.zeros(1 + p + p * p)
        for pdf in it:
            pdf = pdf[pdf["d"] > 0]
            if pdf.empty:
                continue
            d, we = pdf["d"].to_numpy(float), pdf["we"].to_numpy(float)
            s0 = pdf["S0"].to_numpy(float)
            S = pdf[[f"S_{c}" for c in z]].to_numpy(float)
            E = pdf[[f"we_{c}" for c in z]].to_numpy(float)
            m = s0 * d / we
            logs, inv, _ = _falling_sums(m, d)
            total[0] += float(np.sum(pdf["eta"].to_numpy(float) - d * np.log(we / d) - logs))
            # mean covariate of the risk set with a share l/d of the tied events taken out is
            # base / (m - l) + tail: linear in 1 / (m - l)
            base = (S - (m / d)[:, None] * E) * (d / we)[:, None]
            tail = E / we[:, None]
            total[1:1 + p] += pdf[[f"e_{c}" for c in z]].to_numpy(float).sum(0)
            total[1:1 + p] -= (base * inv[:, None] + tail * d[:, None]).sum(0)
            inv2 = _falling_squares(m, d)
            h = np.einsum("i,ij,ik->jk", inv2, base, base)
            cross = np.einsum("i,ij,ik->jk", inv, base, tail)
            h += cross + cross.T + np.einsum("i,ij,ik->jk", d, tail, tail)
            total[1 + p:] += h.ravel()
        yield pd.DataFrame({"i": np.arange(total.size), "v": total})

    def hazard_terms(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Per duration: hazard step a, and the share b taken back from the tied events."""
        for pdf in it:
            d, we = pdf["d"].to_numpy(float), pdf["we"].to_numpy(float)
            ok = d > 0
            a, b = np.zeros(len(pdf)), np.zeros(len(pdf))
            if ok.any():
                m = pdf["S0"].to_numpy(float)[ok] * d[ok] / we[ok]
                _, inv, lin = _falling_sums(m, d[ok])
                a[ok] = inv * d[ok] / we[ok]
                b[ok] = lin / we[ok]
            yield pd.DataFrame({"t": pdf["t"], "a": a, "b": b})

    def gram_terms(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((p, p))
        for pdf in it:
            x = pdf[z].to_numpy(float)
            total += (x * pdf["q"].to_numpy(float)[:, None]).T @ x
        yield pd.DataFrame({"i": np.arange(p * p), "v": total.ravel()})

    def summed(parts: DataFrame, size: int) -> np.ndarray:
        out = np.zeros(size)
        for r in parts.groupBy("i").agg(F.sum("v").alias("v")).collect():
            out[r["i"]] = r["v"]
        return out

    def hazard(table: DataFrame) -> DataFrame:
        steps = table.select("t", "d", "we", "S0").mapInPandas(hazard_terms, "t double, a double, b double")
        return running_sums(steps, "t", {"a": "cum_a"}).select("t", "a", "b", "cum_a")

    def derivatives(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        table = risk_table(beta).select(*cols).persist()
        try:
            s = summed(table.mapInPandas(event_terms, "i int, v double"), 1 + p + p * p)
            steps = F.broadcast(hazard(table)) if small else hazard(table)
            q = F.exp(linear(beta)) * (F.col("cum_a") - F.when(F.col("e") == 1, F.col("b")).otherwise(0.0))
            weighted = std.join(steps, "t").select(*z, q.alias("q"))
            gram = summed(weighted.mapInPandas(gram_terms, "i int, v double"), p * p).reshape(p, p)
        finally:
            table.unpersist()
        return s[0], s[1:1 + p], gram - s[1 + p:].reshape(p, p)

    def objective(loglik: float, beta: np.ndarray) -> float:
        return loglik / n - penalizer / 2 * float(beta @ beta)

    beta = np.zeros(p)
    loglik, grad, hess = derivatives(beta)
    iterations = 0
    while True:
        g = grad / n - penalizer * beta
        step = np.linalg.solve(hess / n + penalizer * np.eye(p), g)
        converged = float(g @ step) / 2 < tol
        if converged or iterations >= max_iter:
            break
        iterations += 1
        size = 1.0
        while True:
            trial = beta + size * step
            new = derivatives(trial)
            before, after = objective(loglik, beta), objective(new[0], trial)
            if after >= before - 1e-10 * max(1.0, abs(before)) or size < 1e-3:
                break
            size /= 2
        beta, (loglik, grad, hess) = trial, new
    baseline = cut_lineage(running_sums(
        hazard(risk_table(beta).select(*cols)).select("t", "a"), "t", {"a": "h0"}).select("t", "h0"))
    return CoxModel(tuple(feats), tuple(beta / sd), tuple(mean), float(loglik), baseline, n_times, iterations, converged)


def risk_score(model: CoxModel) -> Column:
    """Partial hazard exp(beta . (x - mean))."""
    terms = (F.lit(b) * (F.col(f).cast("double") - F.lit(m))
             for f, b, m in zip(model.features, model.beta, model.means))
    return F.exp(sum(terms, F.lit(0.0)))


def predict_survival(df: DataFrame, model: CoxModel, id_col: str, times: Sequence[float] | None = None) -> DataFrame:
    """Individual curves as long rows (id, t, surv), on the given times or every baseline time."""
    scored = df.select(F.col(id_col).alias("id"), risk_score(model).alias("r"))
    if times is not None:
        grid = _hazard_at(model, times)
        points = F.array(*[F.struct(F.lit(float(t)).alias("t"), F.lit(h).alias("h0")) for t, h in grid.items()])
        long = scored.select("id", "r", F.inline(points))
    elif model.baseline_rows <= SMALL_CURVE_ROWS:
        points = model.baseline.agg(F.array_sort(F.collect_list(F.struct("t", "h0")))).scalar()
        long = scored.select("id", "r", F.inline(points))
    else:  # too many rows for one array
        long = scored.crossJoin(model.baseline.select("t", "h0"))
    return long.select("id", "t", F.exp(-F.col("h0") * F.col("r")).alias("surv"))


def _hazard_at(model: CoxModel, times: Sequence[float]) -> dict[float, float]:
    """Baseline hazard at a few times: the last step at or before each (0 before the first)."""
    one = model.baseline.agg(*[
        F.coalesce(F.max(F.when(F.col("t") <= float(t), F.col("h0"))), F.lit(0.0)).alias(f"h{i}")
        for i, t in enumerate(times)]).first()
    return {t: one[f"h{i}"] for i, t in enumerate(times)}


def survival_at(df: DataFrame, model: CoxModel, horizons: Sequence[float], keep: Sequence[str] = ()) -> DataFrame:
    """Columns ``surv_<t>`` with S(t | x) at each horizon."""
    grid = _hazard_at(model, horizons)
    r = risk_score(model)
    return df.select(*keep, *[F.exp(-F.lit(h) * r).alias(f"surv_{t:g}") for t, h in grid.items()])


def median_survival(df: DataFrame, model: CoxModel, keep: Sequence[str] = (), out: str = "median") -> DataFrame:
    """First time with S(t | x) <= 0.5, infinity when never, NULL when a covariate is NULL.

    S(t | x) <= 0.5 is h0(t) >= ln 2 / r, so each row asks the baseline hazard for the first time
    at or above its own level: a search in a small array, or an ordered lookup when it is large.
    """
    level = F.lit(math.log(2.0)) / risk_score(model)
    rows = df.withColumn("__level", level)
    # the first time of each hazard value is what is asked for
    curve = model.baseline.groupBy("h0").agg(F.min("t").alias("t"))
    if model.baseline_rows <= SMALL_CURVE_ROWS:
        pairs = F.array_sort(F.collect_list(F.struct("h0", "t")))
        arrays = curve.agg(pairs.alias("c")).select(
            F.struct(F.col("c.h0").alias("h0"), F.col("c.t").alias("t"))).scalar()
        rows = sorted_position(rows, arrays["h0"], F.col("__level"), model.baseline_rows, "__i")
        found = F.get(arrays["t"], F.col("__i"))
    else:
        mirrored = curve.select((-F.col("h0")).alias("k"), "t")
        rows = rows.withColumn("__k", -F.col("__level"))
        rows = step_lookup(rows, "__k", mirrored, "k", "t", default=float("inf"), out="__t")
        found = F.col("__t")
    # a row without a risk (NULL covariates) has no median at either curve size
    median = F.when(F.col("__level").isNotNull(), F.coalesce(found, F.lit(float("inf"))))
    return rows.select(*keep, median.alias(out))
