"""Cohort tables: presence, gaps, distributions, contrasts, blocks, categories, correlations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulsegrid.operators.core import epoch_seconds, exact_quantiles, floor_div, pieces_wanted, sweep, with_halo, with_value_piece
from pulsegrid.sources.stage import materialise


# ------------------------------------------------------------------ presence
def presence(points: DataFrame, roster: DataFrame, vitals: Sequence[str], pid: str = "pid", ts: str = "ts", vital: str = "vital",
             enrolled: str = "enrolled") -> DataFrame:
    """What each subject of the roster recorded, in all and since enrolment.

    Readings are merged per (subject, day) first, so the second step sees
    calendar-sized groups and distinct days are plain counts.
    """
    days = points.groupBy(pid, F.to_date(ts).alias("_d")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(ts).alias("_a"), F.max(ts).alias("_b"),
        *[F.count_if(F.col(vital) == v).alias(v) for v in vitals])
    j = roster.select(pid, enrolled).join(days, pid, "left")
    since = F.col("_d") >= F.col(enrolled)
    out = j.groupBy(pid, enrolled).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("readings"),
        F.coalesce(F.floor((epoch_seconds(F.max("_b")) - epoch_seconds(F.min("_a"))) / 86400) + 1, F.lit(0)).alias("span_days"),
        *[F.coalesce(F.sum(v), F.lit(0)).alias(v) for v in vitals],
        *[F.coalesce(F.sum(F.when(since, F.col(v))), F.lit(0)).alias(f"{v}_since") for v in vitals],
        F.count_if(since).alias("days_with_data"),
        F.coalesce(F.sum(F.when(~since, F.col("_n"))), F.lit(0)).alias("before_enrolment"), F.max("_b").alias("last_reading"))
    end = days.agg(F.max("_d").alias("e"))
    return out.withColumn("days_since_enrolment", F.datediff(end.scalar(), F.col(enrolled)) + 1)


def since_enrolment(points: DataFrame, roster: DataFrame, pid: str = "pid", ts: str = "ts", enrolled: str = "enrolled") -> DataFrame:
    """Readings per relative day from each subject's first to last such day, zeros filled in."""
    from pulsegrid.operators.timeline import dense

    days = points.groupBy(pid, F.to_date(ts).alias("_d")).agg(F.count(F.lit(1)).alias("n"))
    rel = days.join(roster.select(pid, enrolled), pid).where(F.col("_d") >= F.col(enrolled)).select(
        pid, F.datediff("_d", enrolled).cast("long").alias("slot"), "n")
    return dense(rel, [pid]).select(pid, F.col("slot").alias("rel_day"), F.coalesce("n", F.lit(0)).alias("n"))


# ---------------------------------------------------------------------- gaps
def missingness(gaps: DataFrame, roster: DataFrame, cadence_min: float, pid: str = "pid", ts: str = "ts") -> DataFrame:
    """Readings, days, coverage and gap quantiles per subject; fewer than two readings leave blanks."""
    days = gaps.groupBy(pid, F.to_date(ts).alias("_d")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(ts).alias("_a"), F.max(ts).alias("_b"), F.max("gap").alias("_g"))
    span = (epoch_seconds(F.max("_b")) - epoch_seconds(F.min("_a"))) / 60
    per = days.groupBy(pid).agg(F.sum("_n").alias("readings"), F.count(F.lit(1)).alias("days"),
                                (100 * F.sum("_n") / F.try_divide(span, F.lit(cadence_min))).alias("coverage"), (F.max("_g") / 60).alias("longest_gap_h"))
    q = exact_quantiles(gaps, [pid], "gap", {"median_gap": 0.5, "p90_gap": 0.9}).drop("n")
    out = roster.select(pid).join(per, pid, "left").join(q, pid, "left")
    enough = F.coalesce(F.col("readings"), F.lit(0)) >= 2
    return out.select(pid, F.coalesce("readings", F.lit(0)).alias("readings"), F.when(enough, F.col("days")).otherwise(0).alias("days"),
                      *[F.when(enough, F.col(c)).alias(c) for c in ("coverage", "median_gap", "p90_gap", "longest_gap_h")])


def histogram(df: DataFrame, keys: Sequence[str], value: str, low: float, step: float, bins: int) -> DataFrame:
    """Counts in equal bins, closed on the left; the last bin also holds its right edge. Values outside go."""
    top = low + step * bins
    inside = df.where((F.col(value) >= low) & (F.col(value) <= top))
    place = F.least(F.floor((F.col(value) - low) / step), F.lit(bins - 1)).cast("int")
    return inside.groupBy(*keys, place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def spread_histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal bins between the smallest and the largest value."""
    ends = df.agg(F.min(value).alias("a"), F.max(value).alias("b"))
    a, b = ends.select("a").scalar(), ends.select("b").scalar()
    place = F.least(F.floor((F.col(value) - a) * bins / (b - a)), F.lit(bins - 1)).cast("int")
    return df.where(F.col(value).isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def shares(df: DataFrame, value: str, thresholds: Sequence[float], cadence: float) -> DataFrame:
    """% of values at or below each threshold, above it, and exactly at the cadence, in one pass."""
    v = F.col(value)
    pct = lambda c: 100 * F.avg(c.cast("double"))
    row = df.where(v.isNotNull()).agg(pct(v == cadence).alias("exact"), *[pct(v <= t).alias(f"_{i}") for i, t in enumerate(thresholds)])
    return row.select("exact", F.explode(F.array(*[
        F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_{i}").alias("at_most")) for i, t in enumerate(thresholds)])).alias("x")).select(
        "x.threshold", "x.at_most", (100 - F.col("x.at_most")).alias("above"), "exact")


def kept_at_cuts(table: DataFrame, value: str, cuts: Sequence[float]) -> DataFrame:
    """How many subjects remain at each minimum."""
    row = table.agg(*[F.count_if(F.col(value) >= c).alias(f"_{i}") for i, c in enumerate(cuts)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(float(c)).alias("cut"), F.col(f"_{i}").alias("kept")) for i, c in enumerate(cuts)])).alias("x")).select("x.*")


# ---------------------------------------------------------- medians, contrasts
def rich_medians(df: DataFrame, keys: Sequence[str], value: str, min_n: int) -> DataFrame:
    return exact_quantiles(df, keys, value, {"median": 0.5}).where(F.col("n") >= min_n)


def two_states(df: DataFrame, keys: Sequence[str], state: str, value: str, min_each: int) -> DataFrame:
    """Medians inside and outside a state for keys with enough readings of both; a blank state is outside."""
    d = df.withColumn("_in", F.coalesce(F.col(state), F.lit(0)) == 1)
    q = exact_quantiles(d, [*keys, "_in"], value, {"m": 0.5})
    side = lambda c, s: F.max(F.when(F.col("_in") == s, F.col(c)))
    t = q.groupBy(*keys).agg(side("m", True).alias("inside"), side("m", False).alias("outside"),
                             side("n", True).alias("n_inside"), side("n", False).alias("n_outside"))
    return t.where((F.col("n_inside") >= min_each) & (F.col("n_outside") >= min_each)).withColumn("diff", F.col("inside") - F.col("outside"))


def as_of_hours(tokens: DataFrame, day_keys: Sequence[str], minute: str, value: str, hours: int = 24) -> DataFrame:
    """Last value at or before the end of each hour of a day.

    One latest token per hour is taken first, so only `hours` rows per day are ordered.
    """
    per = tokens.where(F.col(value).isNotNull()).groupBy(*day_keys, floor_div(minute, 60).alias("hour")).agg(F.max_by(value, minute).alias("_v"))
    axis = tokens.select(*day_keys).distinct().withColumn(
        "hour", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(hours - 1).cast("long"))))
    w = W.partitionBy(*day_keys).orderBy("hour").rowsBetween(W.unboundedPreceding, 0)
    return axis.join(per, [*day_keys, "hour"], "left").select(*day_keys, "hour", F.last("_v", ignorenulls=True).over(w).alias("state"))


def subject_strata(days: DataFrame, pid: str = "pid", group: str = "grp", label: str = "label") -> DataFrame:
    return days.groupBy(pid).agg(F.min(group).alias(group), F.max(label).alias("pos"))


# ------------------------------------------------------------------- categories
def yes_counts(findings: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """"k of n yes" per finding; `columns` maps a 0/1/null column to its group."""
    row = findings.agg(*[F.struct(F.sum(c).alias("yes"), F.count(c).alias("known")).alias(c) for c in columns])
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(g).alias("grp"), F.lit(c).alias("finding"), F.col(f"{c}.yes").alias("yes"), F.col(f"{c}.known").alias("known"))
        for c, g in columns.items()])).alias("x")).select("x.*")


def category_counts(df: DataFrame, value: Column, meanings: Mapping[str, str], rest: str = "not recorded") -> DataFrame:
    """Counts in the order given, blanks last as `rest`; categories without rows are left out."""
    order = {m: i for i, m in enumerate([*meanings.values(), rest])}
    v = F.upper(F.trim(value))
    name = F.lit(rest)
    for code, meaning in meanings.items():
        name = F.when(v == code, meaning).otherwise(name)
    place = F.lit(None).cast("int")
    for m, i in order.items():
        place = F.when(F.col("category") == m, i).otherwise(place)
    named = df.select(F.when(v.isNull() | v.isin("", "NAN") | v.isin(*meanings), name).alias("category")).where("category is not null")
    return named.groupBy("category").agg(F.count(F.lit(1)).alias("n")).withColumn("place", place)


def test_status(df: DataFrame, tests: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Per test: available, normal, abnormal, coded 0, blank; one pass for all tests."""
    aggs = []
    for t, (avail, result) in tests.items():
        r = F.trim(F.col(result))
        aggs.append(F.struct(
            F.count_if(F.col(avail) == 1).alias("available"), F.count_if(r == "1").alias("normal"), F.count_if(r == "2").alias("abnormal"),
            F.count_if(r == "0").alias("coded_0"), F.count_if(r.isNull() | (r == "")).alias("blank")).alias(t))
    return df.agg(*aggs).select(F.explode(F.array(*[F.struct(F.lit(t).alias("test"), F.col(t).alias("s")) for t in tests])).alias("x")).select("x.test", "x.s.*")


def items_listed(df: DataFrame, columns: Sequence[str], blanks: Sequence[str] = ("", "0", "NAN")) -> DataFrame:
    """Number of filled items per row, and the first listed one."""
    t = F.array(*[F.upper(F.trim(F.col(c))) for c in columns])
    return df.withColumns({
        "items": F.size(F.filter(t, lambda x: x.isNotNull() & ~x.isin(*blanks))), "first_listed": F.upper(F.trim(F.col(columns[0])))})


def value_counts(df: DataFrame, columns: Sequence[str], name: str = "n") -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias(name))


def events_per_subject(roster: DataFrame, events: DataFrame, pid: str = "pid") -> DataFrame:
    return roster.select(pid).join(value_counts(events, [pid], "events"), pid, "left").withColumn("events", F.coalesce("events", F.lit(0)))


# ------------------------------------------------------------------ association
def correlations(df: DataFrame, columns: Sequence[str], min_n: int = 10) -> DataFrame:
    """Pearson and Spearman for every pair of columns, each on the pair's complete rows.

    No row is copied for a pair. One order of a column's distinct values serves all its pairs: it carries, for each
    partner, how many rows with that partner filled lie at or below the value, which gives the rank within the pair. All
    pairs' co-moments are then one aggregate, merged on the map side. Neither a column's length nor a very common value
    lands in one task.
    """
    many = range(len(columns))
    pairs = [(i, j) for i in many for j in many if i < j]
    rows = materialise(df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]), "correlated")
    ranked = rows
    for i in many:
        filled = {f"p{j}": F.count_if(F.col(f"c{j}").isNotNull()) for j in many if j != i}
        counts = rows.where(F.col(f"c{i}").isNotNull()).groupBy(f"c{i}").agg(*[c.alias(n) for n, c in filled.items()])
        pieces = with_value_piece(counts, rows.where(F.col(f"c{i}").isNotNull()), f"c{i}", pieces_wanted(rows))
        order = sweep(pieces, [], f"c{i}", piece=F.col("_range"), sums={f"{n}_upto": F.col(n) for n in filled})
        rank = [(F.col(f"p{j}_upto") - (F.col(f"p{j}") - 1) / 2).alias(f"r{i}_{j}") for j in many if j != i]
        ranked = ranked.join(order.select(f"c{i}", *rank), f"c{i}", "left")

    def facts(i: int, j: int) -> Column:
        both = F.col(f"c{i}").isNotNull() & F.col(f"c{j}").isNotNull()
        at = lambda c: F.when(both, F.col(c))
        return F.struct(F.lit(columns[i]).alias("a"), F.lit(columns[j]).alias("b"), F.count_if(both).alias("n"),
                        linear(at(f"c{i}"), at(f"c{j}")).alias("pearson"), linear(at(f"r{i}_{j}"), at(f"r{j}_{i}")).alias("spearman"))

    def linear(x: Column, y: Column) -> Column:
        """Null where a side is constant; Spark's own `corr` stops there."""
        # told by the extremes: a constant's variance is rounded to a little above 0 when parts are merged
        flat = [(F.min(c) == F.max(c)) & (F.abs(F.min(c)) < float("inf")) for c in (x, y)]
        return F.when(~F.coalesce(flat[0] | flat[1], F.lit(False)), F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y))))

    found = ranked.agg(*[facts(i, j).alias(f"f{i}_{j}") for i, j in pairs])
    out = found.select(F.explode(F.array(*[F.col(f"f{i}_{j}") for i, j in pairs])).alias("p")).select("p.*").where("n > 0")
    return out.select("a", "b", "n", *[F.when(F.col("n") >= min_n, F.col(c)).alias(c) for c in ("pearson", "spearman")])


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation, number of complete pairs and median difference b - a."""
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("_d", F.col(b) - F.col(a))
    med = exact_quantiles(d, [], "_d", {"median_diff": 0.5}).select("median_diff")
    return d.agg(F.corr(a, b).alias("r"), F.count(F.lit(1)).alias("n")).withColumn("median_diff", med.scalar())


# ------------------------------------------------------------------- rhythm
def rhythm_fit(df: DataFrame, keys: Sequence[str], y: str, t: str, period: float) -> DataFrame:
    """Least squares of y on 1, cos, sin of the daily phase: nine sums and a closed 3x3 solution."""
    a = F.col(t) * F.lit(2 * 3.141592653589793 / period)
    d = df.where(F.col(y).isNotNull()).select(*keys, F.col(y).alias("_y"), F.cos(a).alias("_c"), F.sin(a).alias("_s"))
    m = lambda e: F.avg(e)
    q = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), m(F.col("_y")).alias("my"), m(F.col("_c")).alias("mc"), m(F.col("_s")).alias("ms"),
        F.covar_pop("_c", "_c").alias("cc"), F.covar_pop("_c", "_s").alias("cs"), F.covar_pop("_s", "_s").alias("ss"),
        F.covar_pop("_c", "_y").alias("cy"), F.covar_pop("_s", "_y").alias("sy"))
    # centred normal equations: the constant drops out and a 2x2 system is left
    det = F.col("cc") * F.col("ss") - F.col("cs") * F.col("cs")
    ok = F.when(F.abs(det) > 1e-9, det)
    bc = (F.col("cy") * F.col("ss") - F.col("sy") * F.col("cs")) / ok
    bs = (F.col("sy") * F.col("cc") - F.col("cy") * F.col("cs")) / ok
    q = q.select(*keys, "n", "my", "mc", "ms", F.coalesce(bc, F.lit(0.0)).alias("b_cos"), F.coalesce(bs, F.lit(0.0)).alias("b_sin"))
    return q.select(*keys, "n", (F.col("my") - F.col("b_cos") * F.col("mc") - F.col("b_sin") * F.col("ms")).alias("b0"), "b_cos", "b_sin")


def rhythm_mean(t: Column, period: float) -> Column:
    a = t * F.lit(2 * 3.141592653589793 / period)
    return F.col("b0") + F.col("b_cos") * F.cos(a) + F.col("b_sin") * F.sin(a)


def lag_one(df: DataFrame, keys: Sequence[str], residual: str, slot: str = "slot", default: float = 0.5) -> DataFrame:
    """Lag-1 autocorrelation of residuals on neighbouring observed slots, kept in 0 … 0.99."""
    h, own, part = with_halo(df.select(*keys, slot, residual), keys, slot, back=1)
    h = h.withColumn("_p", F.lag(residual).over(W.partitionBy(*part).orderBy(slot))).where(own)
    both = F.col("_p").isNotNull() & F.col(residual).isNotNull()
    a, b = F.when(both, F.col("_p")), F.when(both, F.col(residual))
    r = F.least(F.greatest(F.corr(a, b), F.lit(0.0)), F.lit(0.99))
    return h.groupBy(*keys).agg(F.when(F.count_if(both) > 3, r).otherwise(default).alias("rho"),
                                F.greatest(F.var_pop(residual), F.lit(1e-4)).alias("variance"))


def step_variance(grid: DataFrame, keys: Sequence[str], value: str = "hrv", slot: str = "slot") -> DataFrame:
    """Population variance of the change between consecutive readings."""
    from pulsegrid.operators.fills import consecutive_pairs

    p = consecutive_pairs(grid, keys, 1 << 40, value, slot)
    return p.groupBy(*keys).agg(F.count(F.lit(1)).alias("steps"), F.var_pop(F.col("next_value") - F.col(value)).alias("step_var"))
