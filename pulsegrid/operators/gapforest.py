"""Every segmentation of a series by its gaps at once: the merge forest of its readings.

With a longest allowed gap of X, readings on both sides of a gap of at most X belong together. As X grows, segments only merge. A segment is born at its
widest inner gap and ends at the narrower of the two gaps beside it, so all segments of all X form a forest (the Cartesian tree of the gaps), with
fewer than two nodes per reading however many X are asked for. What is kept at X is a step function: a node adds its readings where it is
born and takes them away where it ends.

No series is gathered. Readings are merged in pieces of the time axis, and a piece hands on only the gaps that are wider than all gaps before or all gaps after
them; these differ, so their number is at most about the root of twice the piece's length on either side. The next level does the same with 64 pieces together.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.core import floor_div

LEVELS = (1 << 12, 1 << 18, 1 << 24)
"""Positions per piece of each level; after the last, what is left of a series meets in one group."""

Atom = tuple[int, int, int, int]
"""First and last position, readings, and the gap at which it was born."""

NEVER = 1 << 62


class Steps:
    """The step function of one group: kept positions and readings that begin or end at each candidate."""

    def __init__(self, candidates: np.ndarray, min_slots: int) -> None:
        self.candidates, self.min_slots = candidates, min_slots
        self.slots, self.kept = [0] * (len(candidates) + 1), [0] * (len(candidates) + 1)

    def add(self, atom: Atom, death: int) -> None:
        a, b, n, birth = atom
        if birth < death and b - a + 1 >= self.min_slots:
            low, high = np.searchsorted(self.candidates, (birth, death)).tolist()
            for at, sign in ((low, 1), (high, -1)):
                self.slots[at] += sign * (b - a + 1)
                self.kept[at] += sign * n


def merge(atoms: list[Atom], steps: Steps, last: bool) -> list[Atom]:
    """Merge neighbouring atoms where the gap between them has one at least as wide on either side in this list; the atoms that are left.

    With `last`, nothing lies beyond the list, and everything is merged.
    """
    done: list[Atom] = []
    stack: list[Atom] = []
    left: list[int] = []  # gap before each atom on the stack; -1: beyond the list
    edge = NEVER if last else -1

    def join(gap: int) -> None:
        top, below = stack.pop(), stack.pop()
        left.pop()
        steps.add(top, gap)
        steps.add(below, min(gap, left[-1]))
        stack.append((below[0], top[1], below[2] + top[2], gap))

    for atom in atoms:
        gap = atom[0] - stack[-1][1] - 1 if stack else edge
        while len(stack) > 1 and left[-1] < gap:
            if left[-2] >= left[-1]:
                join(left[-1])
            else:  # wider than all gaps before it: only the next level knows
                done.append(stack.pop(0))
                left.pop(0)
        stack.append(atom)
        left.append(gap)
    if last:
        while len(stack) > 1:
            join(left[-1])
        for atom in stack:
            steps.add(atom, NEVER)
        return []
    k = 1
    while k + 1 < len(stack):  # of equal gaps towards the end the last one stays
        if left[k] == left[k + 1] and left[k - 1] >= left[k]:
            below, top = stack[k - 1], stack[k]
            steps.add(top, left[k])
            steps.add(below, min(left[k], left[k - 1]))
            stack[k - 1:k + 1] = [(below[0], top[1], below[2] + top[2], left[k])]
            del left[k]
        else:
            k += 1
    return done + stack


def _level(rows: DataFrame, keys: Sequence[str], candidates: np.ndarray, min_slots: int, piece: int | None) -> DataFrame:
    """One round of merging; rows are atoms (`x` null) and steps of the function (`a` any position of the group)."""
    groups = [*keys, "_piece"]
    cut = rows.withColumn("_piece", F.lit(0).cast("long") if piece is None else floor_div("a", piece))
    ordered = cut.repartition(*groups).sortWithinPartitions(*groups, F.col("x").asc_nulls_first(), "a")
    names = [*keys, "a", "b", "n", "birth", "x", "slots", "kept"]
    schema = rows.select(*names).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, atoms, steps, out = None, [], None, []

        def flush() -> None:
            left = merge(atoms, steps, piece is None)
            out.extend((*own[:-1], *atom, None, 0, 0) for atom in left)
            if piece is None:
                slots, kept = np.cumsum(steps.slots[:-1]).tolist(), np.cumsum(steps.kept[:-1]).tolist()
                out.extend((*own[:-1], 0, 0, 0, 0, x, s, k) for x, (s, k) in enumerate(zip(slots, kept, strict=True)))
            else:
                out.extend((*own[:-1], own[-1] * piece, 0, 0, 0, x, s, k) for x, (s, k) in enumerate(zip(steps.slots, steps.kept, strict=True)) if s or k)

        def ready() -> pa.RecordBatch:
            columns = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        types = None
        for batch in batches:
            if types is None:
                types = [batch.schema.field(c).type for c in names]
            columns = [batch.column(c).to_pylist() for c in [*groups, "a", "b", "n", "birth", "x", "slots", "kept"]]
            for row in zip(*columns, strict=True):
                group, (a, b, n, birth, x, slots, kept) = row[:len(groups)], row[len(groups):]
                if group != own:
                    if own is not None:
                        flush()
                    own, atoms, steps = group, [], Steps(candidates, min_slots)
                if x is not None:
                    steps.slots[x] += slots
                    steps.kept[x] += kept
                elif atoms and not birth and not atoms[-1][3] and a == atoms[-1][1] + 1:  # no gap between them: one atom for every candidate
                    p = atoms[-1]
                    atoms[-1] = (p[0], b, p[2] + n, 0)
                else:
                    atoms.append((a, b, n, birth))
            if len(out) >= 20_000:
                yield ready()
                out.clear()
        if own is not None:
            flush()
        if out:
            yield ready()

    return ordered.mapInArrow(run, schema)


def kept_by_gap(readings: DataFrame, keys: Sequence[str], candidates: Sequence[int], min_slots: int, slot: str = "slot") -> DataFrame:
    """(keys, x, slots, kept): for every candidate gap x, the positions and the readings of all segments of at least `min_slots` positions.

    One pass over the readings, which lie on distinct positions of their key, whatever the number of candidates. Every key with a reading has a row per candidate.
    """
    xs = sorted(set(candidates))
    if not xs or xs[0] < 0:
        raise ValueError("candidates are gaps of 0 or more")
    points = np.array(xs, dtype=np.int64)
    position = F.col(slot).cast("long")
    rows = readings.where(position.isNotNull()).select(
        *keys, position.alias("a"), position.alias("b"), F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("birth"), F.lit(None).cast("long").alias("x"),
        F.lit(0).cast("long").alias("slots"), F.lit(0).cast("long").alias("kept"))
    for piece in (*LEVELS, None):
        rows = _level(rows, keys, points, min_slots, piece)
    number = F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("x") + 1).cast("int"))
    return rows.select(*keys, number.alias("x"), "slots", "kept")
