"""Result tables: usability, ranking against a reference, seeds, ablations, pooled splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usability(spine: DataFrame, last: DataFrame, keys: Sequence[str], blank: Sequence[str] = ("mae",), worst: float = 1000, above: float = 5) -> DataFrame:
    """A code per (model, test): why a run cannot be used, or empty; unusable runs lose their scores."""
    j = spine.join(last.withColumn("_ran", F.lit(1)), list(keys), "left")
    bad = F.isnan("mae") | (F.abs("mae") == float("inf")) | (F.col("mae") > worst) | (F.col("n_nonfinite") > 0)
    note = (F.when(F.col("_ran").isNull(), "absent").when(bad, "not_finite_or_huge")
            .when(F.col("n_nonpositive") > 0, "zero_or_less").when(F.col("pct_above") > above, "too_high").otherwise(""))
    j = j.withColumn("note", note).withColumn("usable", F.col("note") == "")
    return j.withColumns({c: F.when(F.col("usable"), F.col(c)) for c in blank}).drop("_ran")


def against_reference(results: DataFrame, test: str, model: str, reference: str, score: str = "mae", tie: float = 1.0) -> DataFrame:
    """Per test: best model, its gain over the reference, and how many beat it, are worse, or tie with the best."""
    ok = results.where(F.col(score).isNotNull())
    top = ok.groupBy(test).agg(F.min_by(model, F.struct(score, model)).alias("best"), F.min(score).alias("best_score"),
                               F.min(F.when(F.col(model) == reference, F.col(score))).alias("reference_score"))
    j = ok.join(top, test)
    other = F.col(model) != reference
    names = lambda c: F.concat_ws(",", F.array_sort(F.collect_list(F.when(c, F.col(model)))))
    return j.groupBy(test, "best", "best_score", "reference_score").agg(
        F.count_if(other & (F.col(score) < F.col("reference_score"))).alias("beat"), F.count_if(other & (F.col(score) >= F.col("reference_score"))).alias("worse"),
        F.count_if(other & (F.col(score) <= F.col("best_score") + tie)).alias("ties"),
        names(other & (F.col(score) < F.col("reference_score"))).alias("beat_list")).withColumn(
        "gain_pct", 100 * (1 - F.col("best_score") / F.col("reference_score")))


def tuned_changes(pairs: DataFrame, test: str, default: str, tuned: str, tie: float = 0.05) -> DataFrame:
    d = F.col(tuned) - F.col(default)
    return pairs.groupBy(test).agg(F.count_if(d < -tie).alias("better"), F.count_if(F.abs(d) <= tie).alias("same"), F.count_if(d > tie).alias("worse"))


def seed_summary(ledger: DataFrame, keys: Sequence[str], scores: Sequence[str], seed: str = "seed", bounds: Sequence[str] = ()) -> DataFrame:
    """Distinct seeds, mean and sample sd of each score, mean of the interval bounds. One row per (keys, seed) goes in."""
    return ledger.groupBy(*keys).agg(F.count(F.lit(1)).alias("seeds"), *[F.avg(s).alias(f"{s}_mean") for s in scores],
                                     *[F.stddev_samp(s).alias(f"{s}_sd") for s in scores], *[F.avg(b).alias(b) for b in bounds])


def parse_tag(tag):
    """(base name, days, horizon) of a model tag such as lstm_d7_h1."""
    part = lambda p: F.nullif(F.regexp_extract(tag, p, 1), F.lit("")).cast("int")
    return F.regexp_replace(F.regexp_replace(tag, r"_d\d+", ""), r"_h\d+$", ""), part(r"_d(\d+)"), part(r"_h(\d+)$")


def cross_tab(df: DataFrame, rows: Sequence[str], columns: str, values: Sequence, score: str) -> DataFrame:
    """Mean score, one column per listed value."""
    return df.groupBy(*rows).pivot(columns, list(values)).agg(F.avg(score))


def interval_cell(mean, low, high):
    return F.format_string("%.3f [%.2f-%.2f]", mean, low, high)


def importance_by_family(imp: DataFrame, keys: Sequence[str], family: str, value: str) -> DataFrame:
    """Sum of mean absolute contributions per family and its share of the total."""
    fam = imp.groupBy(*keys, family).agg(F.sum(value).alias("total"))
    whole = fam.groupBy(*keys).agg(F.sum("total").alias("_all"))
    return fam.join(whole, list(keys)).withColumn("share_pct", 100 * F.col("total") / F.col("_all")).drop("_all")


def ablation(results: DataFrame, keys: Sequence[str], dropped: str, score: str = "mae", base: str = "none") -> DataFrame:
    b = results.where(F.col(dropped) == base).select(*keys, F.col(score).alias("_base"))
    return results.join(b, list(keys), "left").withColumn("change", F.col(score) - F.col("_base")).drop("_base")


def paired_difference(per_split: DataFrame, keys: Sequence[str], split: Sequence[str], model: str, a: str, b: str, score: str) -> DataFrame:
    """Mean difference b - a over the splits both have, and in how many b is higher."""
    one = lambda m: per_split.where(F.col(model) == m)
    cols = [*keys, *split]
    j = one(a).select(*cols, F.col(score).alias("_a")).join(one(b).select(*cols, F.col(score).alias("_b")), cols)
    return j.groupBy(*keys).agg(F.count(F.lit(1)).alias("splits"), F.avg(F.col("_b") - F.col("_a")).alias("mean_diff"), F.count_if(F.col("_b") > F.col("_a")).alias("higher"))
