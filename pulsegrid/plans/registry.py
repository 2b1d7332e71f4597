"""Named models behind three contracts, all from DataFrame to DataFrame.

* filler:     (rows with segment, slot, visible; period) -> rows with `filled`
* forecaster: (train rows, period, horizon) -> (segment or pid, h, pred)
* classifier: (test rows, train rows) -> test rows with `score`; trained ones read the columns whose name begins with `f_`
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from pulsegrid.operators import baselines, fills
from pulsegrid.plans import models, rhythm


FEATURE = "f_"


@dataclass(frozen=True)
class Entry:
    family: str
    tasks: tuple[str, ...]
    run: Callable[..., DataFrame]


def _line(rows: DataFrame, period: int) -> DataFrame:
    return fills.straight_line(fills.nearest(rows, ["segment"], value="visible"), "visible")


def _rhythm(rows: DataFrame, period: int) -> DataFrame:
    r = rows.select("segment", "slot", "visible")
    near = fills.nearest(r, ["segment"], value="visible")
    done = rhythm.fill(r, near, ["segment"], period, value="visible").select("segment", "slot", "filled")
    return rows.join(done, ["segment", "slot"], "left")


def _tree(rows: DataFrame, period: int) -> DataFrame:
    return models.predict_fill(models.fit_filler(rows, 2, period))


FILLERS = {"straight_line": Entry("reference", ("fill",), _line), "rhythm": Entry("statistical", ("fill",), _rhythm), "tree": Entry("tree", ("fill",), _tree)}
FORECASTERS = {
    "last_value": Entry("reference", ("forecast",), lambda rows, period, horizon: baselines.last_value(rows, "pid", "slot", "hrv", horizon)),
    "subject_median": Entry("reference", ("forecast",), lambda rows, period, horizon: baselines.subject_median(rows, "pid", "hrv", horizon)),
    "rhythm": Entry("statistical", ("forecast",), lambda rows, period, horizon: rhythm.forecast(rows, ["pid"], period, horizon)),
}
CLASSIFIERS = {
    "never": Entry("reference", ("detect",), lambda test, train: baselines.never(test)),
    "prior": Entry("reference", ("detect",), lambda test, train: baselines.prior(test, train, "label")),
}


def fitted_on(train: DataFrame, contender: models.Contender) -> PipelineModel:
    """Preparation and classifier as one model, fitted on the training rows; it can be saved and loaded."""
    columns = [c for c in train.columns if c.startswith(FEATURE)]
    prepared = models.preparation(columns).fit(train)
    return PipelineModel([*prepared.stages, models.fit_contender(prepared.transform(train), contender)])


def _trained(contender: models.Contender) -> Callable[..., DataFrame]:
    def run(test: DataFrame, train: DataFrame) -> DataFrame:
        return models.score_column(fitted_on(train, contender).transform(test)).select(*test.columns, "score")

    return run


CLASSIFIERS.update({c.name: Entry("trained", ("detect",), _trained(c)) for c in models.contenders()})


def register(kind: dict[str, Entry], name: str, family: str, tasks: tuple[str, ...], run: Callable[..., DataFrame]) -> None:
    if name in kind:
        raise ValueError(f"{name} is taken")
    kind[name] = Entry(family, tasks, run)


def get(kind: dict[str, Entry], name: str, task: str) -> Callable[..., DataFrame]:
    e = kind[name]
    if task not in e.tasks:
        raise ValueError(f"{name} does not {task}")
    return e.run


def names(kind: dict[str, Entry], task: str) -> list[str]:
    return [n for n, e in kind.items() if task in e.tasks]


__all__ = ["CLASSIFIERS", "FILLERS", "FORECASTERS", "Entry", "get", "names", "register"]
