"""The experiment grid that trains: every (task, window, horizon, model, test share, seed) fitted on its own split and entered in a ledger."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators import daystore, metrics, sampling
from pulsegrid.plans.models import Contender, fit_contender, in_threads, preparation, score_column
from pulsegrid.sources.readings import committed, read_run, run_name, write_run
from pulsegrid.sources.stage import materialise


@dataclass(frozen=True)
class Cell:
    """One run of the grid. `horizon` is 0 where the event's own day is asked for."""

    task: str
    window: int
    horizon: int
    model: str
    share: float
    seed: int

    def keys(self) -> dict[str, str]:
        return {k: str(v) for k, v in vars(self).items()}


def cells(models: Sequence[str], shares: Sequence[float], seeds: Sequence[int], windows: Sequence[int], horizons: Sequence[int]) -> list[Cell]:
    """Detection once per window, onset once per window and horizon, each for every model, share and seed."""
    tasks = [("detect", 0), *(("onset", h) for h in horizons)]
    return [Cell(t, w, h, m, s, seed) for w, (t, h), m, s, seed in product(windows, tasks, models, shares, seeds)]


def window_features(days: DataFrame, width: int, values: Sequence[str], static: DataFrame | None = None, pid: str = "pid") -> tuple[DataFrame, list[str]]:
    """(table, names): mean, least, greatest and last of each value over the `width` days that end at each day, and the days present.

    Static columns, one row per subject, are joined at the left: a subject without them keeps its days, with blanks that the preparation fills.
    """
    w = daystore.day_window(days, width, values, pid)
    of = lambda v: (F.avg(v).alias(f"{v}_mean"), F.min(v).alias(f"{v}_min"), F.max(v).alias(f"{v}_max"), F.max(F.when(F.col("place") == width - 1, F.col(v))).alias(f"{v}_last"))
    out = w.groupBy(pid, F.col("sample").alias("date")).agg(F.count_if("present").cast("double").alias("days_there"), *[c for v in values for c in of(v)])
    names = [c for c in out.columns if c not in (pid, "date")]
    if static is not None:
        extra = [c for c in static.columns if c != pid]
        out, names = out.join(static, pid, "left"), names + extra
    return out, names


def onset_labels(days: DataFrame, horizon: int, pid: str = "pid", label: str = "label") -> DataFrame:
    """(pid, date, label): does an event begin in the `horizon` days after a day without one?

    A day counts if the subject is known for `horizon` more days. Event days are copied to the days before them, so no subject is windowed whole.
    """
    last = days.groupBy(pid).agg(F.max("date").alias("_last"))
    ahead = days.where(F.col(label) == 1).select(pid, F.explode(F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda i: F.date_sub("date", i))).alias("date"))
    calm = days.where(F.col(label) == 0).join(last, pid).where(F.date_add("date", horizon) <= F.col("_last")).select(pid, "date")
    return calm.join(ahead.distinct().withColumn("_hit", F.lit(1)).hint("merge"), [pid, "date"], "left").select(pid, "date", F.coalesce("_hit", F.lit(0)).alias("label"))


def trained_grid(days: DataFrame, units: DataFrame, strata: Sequence[str], values: Sequence[str], among: Sequence[Contender], path: str, *,
                 shares: Sequence[float] = (0.2, 0.3), seeds: Sequence[int] = (0,), windows: Sequence[int] = (1, 3, 7), horizons: Sequence[int] = (1, 3, 7), held: float = 0.15,
                 static: DataFrame | None = None, pid: str = "pid", threshold: float = 0.5, threads: int = 4) -> DataFrame:
    """The ledger of the grid: one row per cell with its keys and scores of the test subjects' days.

    Subjects are split in (train, held back, test) by share and seed, stratified; blanks, scales, class weights and the model are fitted on the training
    subjects alone. Each cell is a run of its own, committed by its ledger row: a grid that was killed goes on with the cells it lacks, and one that
    is done fits nothing. Window tables and splits are written once for all cells that use them; cells without a training or test day of their
    task have no row.
    """
    spark = days.sparkSession
    todo = cells([c.name for c in among], shares, seeds, windows, horizons)
    done = {r["run"] for r in committed(spark, path).collect()}  # one name per cell
    todo = [c for c in todo if run_name(c.keys()) not in done]
    model = {c.name: c for c in among}
    split = {k: materialise(sampling.nested_draw(units, strata, k[0], held, k[1], pid).select(pid, "part"), "grid-split") for k in {(c.share, c.seed) for c in todo}}
    tables = {w: window_features(days, w, values, static, pid) for w in {c.window for c in todo}}
    features = {w: (materialise(t, "grid-window"), names) for w, (t, names) in tables.items()}
    labels = {h: materialise(onset_labels(days, h, pid) if h else days.select(pid, "date", F.col("label").cast("int").alias("label")), "grid-labels") for h in {c.horizon for c in todo}}

    def run(group: tuple, own: list[Cell]) -> None:
        window, horizon, share, seed = group
        table, names = features[window]
        # a row per subject and day, and per subject, packs well: merged, as their sizes on disk would have them broadcast
        rows = table.join(labels[horizon].hint("merge"), [pid, "date"]).join(split[share, seed].hint("merge"), pid)
        train = rows.where("part = 'train'")
        ready = preparation(names).fit(train)
        train, test = (materialise(ready.transform(rows.where(F.col("part") == p)), f"grid-{p}") for p in ("train", "test"))
        if train.isEmpty() or test.isEmpty():
            return
        for c in own:
            scored = score_column(fit_contender(train, model[c.model]).transform(test)).select(pid, "date", "label", "score")
            write_run(scored, lambda p: metrics.detection_scores(p, [], threshold), path, c.keys())

    groups: dict[tuple, list[Cell]] = {}
    for c in todo:
        groups.setdefault((c.window, c.horizon, c.share, c.seed), []).append(c)
    in_threads(spark, [lambda g=g, own=own: run(g, own) for g, own in groups.items()], threads)
    return read_run(spark, path, "ledger").drop("run", "attempt")
