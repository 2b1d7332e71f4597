"""Daily rhythm plus first-order memory: a closed-form filler and forecaster."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators import cohort
from pulsegrid.operators.baselines import over_horizon


def log_grid(grid: DataFrame, period: int, value: str = "hrv", slot: str = "slot") -> DataFrame:
    """Adds y, the log value, and t, the place in the daily cycle."""
    return grid.withColumns({"y": F.ln(F.when(F.col(value) > 0, F.col(value))), "t": F.pmod(F.col(slot), F.lit(period))})


def fit(log_rows: DataFrame, keys: Sequence[str], period: int) -> DataFrame:
    return cohort.rhythm_fit(log_rows, keys, "y", "t", period)


def residuals(log_rows: DataFrame, fitted: DataFrame, keys: Sequence[str], period: int) -> DataFrame:
    return log_rows.join(fitted.drop("n"), list(keys)).withColumn("residual", F.col("y") - cohort.rhythm_mean(F.col("t"), period))


def forecast(grid: DataFrame, keys: Sequence[str], period: int, horizon: int, share: float = 0.7, value: str = "hrv", slot: str = "slot") -> DataFrame:
    """Expected value 1 … horizon slots after the last reading.

    The log residual of the last reading fades by rho per slot; half the
    observation variance comes back with the exponential.
    """
    g = log_grid(grid, period, value, slot)
    f = fit(g, keys, period)
    r = residuals(g, f, keys, period)
    memory = cohort.lag_one(r, keys, "residual", slot)
    last = r.where("residual is not null").groupBy(*keys).agg(F.max(F.struct(slot, "residual")).alias("_l"))
    s = f.join(memory, list(keys)).join(last, list(keys)).withColumn("tau2", (1 - share) * F.col("variance"))
    h = over_horizon(s, horizon)
    t = F.pmod(F.col(f"_l.{slot}") + F.col("h"), F.lit(period))
    mean = cohort.rhythm_mean(t, period) + F.pow("rho", F.col("h").cast("double")) * F.col("_l.residual")
    return h.select(*keys, "h", F.exp(mean + F.col("tau2") / 2).alias("pred"))


def fill(grid: DataFrame, near: DataFrame, keys: Sequence[str], period: int, share: float = 0.7, value: str = "hrv", slot: str = "slot") -> DataFrame:
    """Blanks filled by the rhythm and the faded residuals of the readings on both sides.

    The two one-sided expectations are blended by place in the missing run.
    """
    from pulsegrid.operators.fills import blend_two_sided

    g = log_grid(grid, period, value, slot)
    f = fit(g, keys, period)
    memory = cohort.lag_one(residuals(g, f, keys, period), keys, "residual", slot)
    n = near.join(f.drop("n"), list(keys)).join(memory, list(keys))
    here = cohort.rhythm_mean(F.pmod(F.col(slot), F.lit(period)), period)
    back = F.ln(F.when(F.col("prev") > 0, F.col("prev"))) - cohort.rhythm_mean(F.pmod(F.col(slot) - F.col("dprev"), F.lit(period)), period)
    ahead = F.ln(F.when(F.col("next") > 0, F.col("next"))) - cohort.rhythm_mean(F.pmod(F.col(slot) + F.col("dnext"), F.lit(period)), period)
    n = n.withColumns({"_f": F.pow("rho", F.col("dprev").cast("double")) * back, "_b": F.pow("rho", F.col("dnext").cast("double")) * ahead})
    n = blend_two_sided(n, "_f", "_b", how="position", out="_r")
    tau2 = (1 - share) * F.col("variance")
    return n.withColumn("filled", F.coalesce(F.col(value), F.exp(here + F.coalesce(F.col("_r"), F.lit(0.0)) + tau2 / 2))).select(*keys, slot, value, "filled")
