"""Turning hand-typed sheet text into numbers and categories; bad input becomes null."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Missing-value tokens, ordinal grades and code meanings of the clinical sheet.
MISSING_TOKENS = ("ND", "NK", "NA", "NIL", "-", "")
GRADE_MIDPOINTS = {
    "0": 0.0, "0-I": 0.5, "I": 1.0, "I-II": 1.5, "II": 2.0,
    "II-III": 2.5, "III": 3.0, "III-IV": 3.5, "IV": 4.0,
}
CODE_MEANINGS = {
    "sex": {1: "male", 2: "female", 3: "other"},
    "control": {1: "controlled", 2: "partly", 3: "uncontrolled"},
    "smoking_form": {1: "bidi", 2: "cigarette", 3: "both", 4: "other"},
    "smoking_status": {1: "continue", 2: "cessation", 3: "modified", 4: "replacement"},
    "breath_sounds": {1: "normal", 2: "reduced", 3: "absent"},
    "result": {1: "normal", 2: "abnormal"},
    "plan": {1: "step_up", 2: "step_down", 3: "same"},
}
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def tidy(text: Column) -> Column:
    return F.upper(F.trim(text))


def numeric(text: Column) -> Column:
    """Number if the text is one, else null."""
    t = F.trim(text.cast("string"))
    return F.when(t.rlike(_NUMBER), t.try_cast("double"))


def clean_number(text: Column, tokens=MISSING_TOKENS) -> Column:
    """As `numeric`, with the sheet's missing tokens named first."""
    return F.when(~tidy(text.cast("string")).isin(*tokens), numeric(text))


def is_filled(text: Column, tokens=(*MISSING_TOKENS, "NAN")) -> Column:
    """The cell holds something other than a missing token."""
    return text.isNotNull() & ~tidy(text).isin(*tokens)


def yes_no(text: Column) -> Column:
    """1 means yes; 2 and 0 mean no; anything else is unknown."""
    v = clean_number(text)
    return F.when(v == 1, 1.0).when(v.isin(0, 2), 0.0)


def lookup(value: Column, table: Mapping) -> Column:
    """Literal map lookup; null when the key is absent."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), value)


def grade_midpoint(text: Column, table: Mapping[str, float] = GRADE_MIDPOINTS) -> Column:
    return lookup(tidy(text), table)


def decode(text: Column, field: str) -> Column:
    """Meaning of a numeric code."""
    return lookup(clean_number(text).cast("int"), CODE_MEANINGS[field])


def duration_days(text: Column) -> Column:
    """Mean of the numbers in a duration; entries in minutes are not days and become null."""
    t = tidy(text)
    found = F.transform(F.regexp_extract_all(t, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)), lambda x: x.cast("double"))
    mean = F.aggregate(found, F.lit(0.0), lambda a, x: a + x) / F.size(found)
    return F.when(t.contains("MIN"), None).when(F.size(found) > 0, mean)


def plausible(value: Column, low: float, high: float) -> Column:
    return F.when(value.between(low, high), value)


def band(value: Column, upper_bounds: list[float], scores: list[int]) -> Column:
    """Score of the right-closed band a value falls into, with one score more than bounds; null below 0."""
    out = F.lit(float(scores[-1]))
    for bound, score in reversed(list(zip(upper_bounds, scores))):
        out = F.when(value <= bound, float(score)).otherwise(out)
    return F.when(value >= 0, out)


def severity_score(bmi: Column, lung_pct: Column, grade: Column, distance: Column) -> Column:
    """Sum of four banded components; missing lung, grade or distance gives null.

    A blank body-mass index counts as "not at most 21", that is as 0.
    """
    # Published cut points of the four components.
    thin = F.coalesce((bmi <= 21).cast("double"), F.lit(0.0))
    return (
        thin
        + band(lung_pct, [34, 49, 64], [3, 2, 1, 0])
        + band(grade, [1, 2, 3], [0, 1, 2, 3])
        + band(distance, [149, 249, 349], [3, 2, 1, 0])
    )


def subject_id(text: Column) -> Column:
    return F.lower(F.trim(text))


def keyword_flags(text: Column, patterns: Mapping[str, str]) -> dict[str, Column]:
    """One 0/1 column per keyword pattern over the upper-cased text."""
    t = tidy(text)
    return {name: F.coalesce(t.rlike(p).cast("int"), F.lit(0)) for name, p in patterns.items()}


def group_label(cohort: Column, pid: Column, base: str = "base", prefix: str = "a",
                yes: str = "adult", no: str = "child") -> Column:
    return F.when(cohort == base, base).when(pid.startswith(prefix), yes).otherwise(no)


def sex_flag(text: Column) -> Column:
    return F.when(text == "male", 1.0).when(text == "female", 0.0)


def one_hot(value: Column, levels: list, prefix: str) -> list[Column]:
    """0/1 column per level; an unknown value is 0 everywhere."""
    return [F.coalesce((value == lv).cast("double"), F.lit(0.0)).alias(f"{prefix}_{lv}") for lv in levels]
