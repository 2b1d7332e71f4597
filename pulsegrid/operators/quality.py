"""Invariants as counts: every rule must come out at zero."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, violations): one pass for all row rules."""
    row = df.agg(*[F.count_if(c).alias(n) for n, c in rules.items()])
    return row.unpivot([], list(rules), "rule", "violations")


def duplicate_keys(df: DataFrame, keys: Sequence[str], rule: str = "duplicate key") -> DataFrame:
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return twice.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(rule).alias("rule"), "violations")


def shared_subjects(parts: Mapping[str, DataFrame], pid: str) -> DataFrame:
    """Subjects that two parts have in common, for every pair of parts."""
    out = None
    for a, b in combinations(parts, 2):
        one = parts[a].select(pid).intersect(parts[b].select(pid)).agg(F.count(F.lit(1)).alias("shared")).select(
            F.lit(f"{a}/{b}").alias("pair"), "shared")
        out = one if out is None else out.unionByName(one)
    return out
