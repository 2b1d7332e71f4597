"""Skew-safe ordered primitives the other operators share.

A window ordered over a whole series puts that series into one task. Series of
every length are therefore cut into (key, chunk) pieces: each piece is windowed
on its own, and the few facts it needs from its neighbours (last reading before
it, running totals so far) come from a table holding one row per piece. Only
that small table is windowed per key. Nothing is measured while a plan is built.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

CHUNK = 4096
"""Positions per piece: the most rows one window group holds on a dense axis."""

_PIECE = "_piece"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --------------------------------------------------------------- time axis
def epoch_seconds(ts: str | Column) -> Column:
    """Whole seconds since 1970 of a naive timestamp; no time zone takes part."""
    return F.timestamp_diff("SECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), col(ts))


def floor_div(x: str | Column, width: int) -> Column:
    """Integer quotient rounded down, also left of zero."""
    x = col(x)
    return ((x - F.pmod(x, F.lit(width))) / F.lit(width)).cast("long")


def slot_of(ts: str | Column, width_s: int) -> Column:
    """Index of the `width_s`-second slot a timestamp falls into."""
    return floor_div(epoch_seconds(ts), width_s)


def slot_start(slot: str | Column, width_s: int) -> Column:
    """Naive timestamp at which a slot starts."""
    return F.timestamp_add(
        "SECOND", col(slot) * F.lit(width_s), F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    )


# -------------------------------------------------------------- gap-free axis
def spine(df: DataFrame, keys: Sequence[str], pos: str, *, first: Column | None = None,
          last: Column | None = None, size: int = CHUNK) -> DataFrame:
    """Every integer position from the first to the last of each key.

    Pieces are exploded before positions, so a long series is spread over
    many rows before it grows.
    """
    bounds = df.groupBy(*keys).agg(
        (F.min(pos) if first is None else first).alias("_a"),
        (F.max(pos) if last is None else last).alias("_b"),
    )
    return positions(bounds, keys, "_a", "_b", pos, size=size)


def positions(spans: DataFrame, keys: Sequence[str], first: str, last: str, pos: str, *, keep: Sequence[str] = (),
              size: int = CHUNK) -> DataFrame:
    """Every integer position of each span (one row per key), with the `keep` columns on every row."""
    pieces = spans.where(F.col(first) <= F.col(last)).select(
        *keys, *keep, F.col(first).alias("_f"), F.col(last).alias("_t"),
        F.explode(F.sequence(floor_div(first, size), floor_div(last, size))).alias(_PIECE),
    )
    return pieces.select(
        *keys, *keep,
        F.explode(F.sequence(
            F.greatest(F.col("_f"), F.col(_PIECE) * size),
            F.least(F.col("_t"), F.col(_PIECE) * size + (size - 1)),
        )).alias(pos),
    )


def on_axis(spans: DataFrame, table: DataFrame, keys: Sequence[str], first: str, last: str, pos: str, *, keep: Sequence[str] = (),
            null_safe: bool = False, size: int = CHUNK) -> DataFrame:
    """Every integer position of each span (one row per key) with the table's columns there, nulls where it has no row.

    The left join of `positions` to the table, but only the table's rows and two marks per piece are shuffled: each row brings the empty positions up to the
    next row of its piece. The table's rows lie inside their key's span. A null key's positions meet its rows only if `null_safe`.
    """
    values = [c for c in table.columns if c not in (*keys, pos)]
    rows = table.where(F.col(pos).isNotNull())
    if not null_safe:
        rows = rows.dropna(subset=list(keys))
    rows = rows.select(*keys, floor_div(pos, size).alias(_PIECE), F.col(pos).cast("long").alias("_at"), F.lit(1).alias("_kind"), F.struct(*values, F.lit(1).alias("_")).alias("_row"))
    pieces = spans.where(F.col(first) <= F.col(last)).select(
        *keys, *keep, F.col(first).alias("_f"), F.col(last).alias("_t"), F.explode(F.sequence(floor_div(first, size), floor_div(last, size))).alias(_PIECE))
    low, high = F.greatest(F.col("_f"), F.col(_PIECE) * size), F.least(F.col("_t"), F.col(_PIECE) * size + (size - 1)) + 1
    marks = pieces.select(*keys, *keep, _PIECE, F.explode(F.array(
        F.struct(low.cast("long").alias("_at"), F.lit(0).alias("_kind")), F.struct(high.cast("long").alias("_at"), F.lit(2).alias("_kind")))).alias("_m"))
    both = rows.unionByName(marks.select(*keys, *keep, _PIECE, "_m._at", "_m._kind"), allowMissingColumns=True)
    w = W.partitionBy(*keys, _PIECE).orderBy("_at", "_kind")
    both = both.select("*", F.lead("_at").over(w).alias("_next"), *[F.first(c).over(w.rowsBetween(W.unboundedPreceding, 0)).alias(f"_k_{c}") for c in keep])
    empty = F.when(F.col("_next") > F.col("_at"), F.sequence(F.col("_at"), F.col("_next") - 1)).when(F.col("_kind") == 1, F.array("_at"))
    out = both.where("_kind < 2").select(*keys, *[F.col(f"_k_{c}").alias(c) for c in keep], "_at", "_row", F.explode(empty).alias(pos))
    return out.select(*keys, *keep, pos, *[F.when(F.col(pos) == F.col("_at"), F.col(f"_row.{c}")).alias(c) for c in values])


# ------------------------------------------------------------- ordered sweep
@dataclass(frozen=True)
class Seen:
    """Nearest row on one side for which `when` holds.

    `own=True` lets the row itself count. The result is a struct of the
    position (`pos`) and the payload columns.
    """

    when: Column
    payload: Sequence[str] = field(default_factory=tuple)
    own: bool = False


def _item(seen: Seen, pos: str) -> Column:
    return F.when(seen.when, F.struct(F.col(pos).alias("pos"), *[F.col(p) for p in seen.payload]))


def _frames(w):
    return {own: w.rowsBetween(W.unboundedPreceding, 0 if own else -1) for own in (True, False)}


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi join in which a null key meets a null key; the right side's keys are left out."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(named, same, how).drop(*[f"_right_{k}" for k in keys])


def sweep(df: DataFrame, keys: Sequence[str], pos: str, *, before: Mapping[str, Seen] | None = None,
          after: Mapping[str, Seen] | None = None, sums: Mapping[str, Column] | None = None,
          piece: Column | None = None, size: int = CHUNK, bounds: bool = False) -> DataFrame:
    """Add looks backward, looks forward and running sums along `pos`.

    * `before[name]` / `after[name]`: struct of the nearest qualifying row.
    * `sums[name]`: running sum up to and including the row; `name_total` is
      the sum over the whole key.
    * `bounds=True`: `pos_min` and `pos_max` of the key.

    The frame is read twice, once for the per-piece facts (pruned and
    pre-aggregated) and once for the rows: pass a stored table, not a long plan.
    The facts travel as one mark ahead of each piece's rows, so the rows are
    shuffled and sorted once, for all looks and sums together.

    `piece` must grow with `pos`; by default it is `pos div size`.
    """
    before, after, sums = before or {}, after or {}, sums or {}
    df = df.withColumn(_PIECE, floor_div(pos, size) if piece is None else piece)

    def edge(pick, s: Seen) -> Column:
        if s.payload:
            return pick(_item(s, pos))
        at = pick(F.when(s.when, F.col(pos)))  # a plain number is aggregated by hash, a struct by sorting
        return F.when(at.isNotNull(), F.struct(at.alias("pos")))

    edge_aggs = (
        [edge(F.max, s).alias(f"_e_{n}") for n, s in before.items()]
        + [edge(F.min, s).alias(f"_e_{n}") for n, s in after.items()]
        + [F.sum(e).alias(f"_e_{n}") for n, e in sums.items()]
        + ([F.min(pos).alias("_e_min"), F.max(pos).alias("_e_max")] if bounds else [])
    )
    # Spark grows a frame from its start in one pass, but recomputes a frame that ends at the last row for every row:
    # looks forward run over the reversed pieces, and inside a piece they are leads that pass over nulls
    over_pieces = W.partitionBy(*keys)
    earlier = over_pieces.orderBy(_PIECE).rowsBetween(W.unboundedPreceding, -1)
    later = over_pieces.orderBy(F.desc(_PIECE)).rowsBetween(W.unboundedPreceding, -1)
    every = over_pieces
    edges = df.groupBy(*keys, _PIECE).agg(*edge_aggs).select(
        *keys, _PIECE,
        *[F.last(f"_e_{n}", ignorenulls=True).over(earlier).alias(f"_x_{n}") for n in before],
        *[F.last(f"_e_{n}", ignorenulls=True).over(later).alias(f"_x_{n}") for n in after],
        *[F.sum(f"_e_{n}").over(earlier).alias(f"_x_{n}") for n in sums],
        *[F.sum(f"_e_{n}").over(every).alias(f"{n}_total") for n in sums],
        *([F.min("_e_min").over(every).alias("pos_min"), F.max("_e_max").over(every).alias("pos_max")] if bounds else []),
    )
    facts = [c for c in edges.columns if c not in (*keys, _PIECE)]
    marks = edges.select(*keys, _PIECE, F.lit(0).alias("_swept"), F.struct(*facts).alias("_edge"))
    both = df.withColumn("_swept", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    is_row = F.col("_swept") == 1  # a condition may hold on a mark's nulls
    both = both.select("*", *[F.when(is_row, _item(s, pos)).alias(f"_i_{n}") for n, s in [*before.items(), *after.items()]])
    inside = W.partitionBy(*keys, _PIECE).orderBy("_swept", pos)
    back = _frames(inside)
    spec = f"partition by {', '.join(f'`{k}`' for k in [*keys, _PIECE])} order by `_swept`, `{pos}`"
    ahead = {n: F.expr(f"lead(`_i_{n}`) ignore nulls over ({spec})") for n in after}
    local = both.select(
        "*", F.first("_edge").over(back[True]).alias("_facts"),
        *[F.last(f"_i_{n}", ignorenulls=True).over(back[s.own]).alias(f"_l_{n}") for n, s in before.items()],
        *[ahead[n].alias(f"_l_{n}") for n in after],
        *[F.sum(F.when(is_row, e)).over(back[True]).alias(f"_l_{n}") for n, e in sums.items()],
    ).where(is_row)
    near = {n: [f"_l_{n}", f"_facts._x_{n}"] for n in [*before, *after]}
    for n, s in after.items():
        if s.own:
            near[n].insert(0, f"_i_{n}")
    own = [c for c in df.columns if c != _PIECE]
    return local.select(
        *own,
        *[F.coalesce(*c).alias(n) for n, c in near.items()],
        *[(F.coalesce(f"_l_{n}", F.lit(0)) + F.coalesce(f"_facts._x_{n}", F.lit(0))).alias(n) for n in sums],
        *[F.coalesce(f"_facts.{n}_total", F.lit(0)).alias(f"{n}_total") for n in sums],
        *(["_facts.pos_min", "_facts.pos_max"] if bounds else []),
    )


def islands(df: DataFrame, keys: Sequence[str], pos: str, gap: Column, start: str = "a", size: int = CHUNK) -> DataFrame:
    """Give every row the position at which its stretch starts.

    A stretch ends where more than `gap` positions follow without a row. Cuts
    inside a piece are seen there; whether a piece goes on with the stretch
    before it is settled on the table of pieces.
    """
    # one struct of key and piece: it is never null, so the join keeps null keys and finds both sides already dealt by it
    df = df.withColumn(_PIECE, floor_div(pos, size)).withColumn("_dealt", F.struct(*keys, _PIECE))
    inside = W.partitionBy("_dealt").orderBy(pos)
    step = F.col(pos) - F.lag(pos).over(inside) - 1
    cut = F.when(step > gap, F.col(pos))
    local = df.withColumn("_cut", cut).withColumn("_own", F.max("_cut").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    # same partitioning as the window: this aggregation needs no further shuffle
    edges = df.select("_dealt", pos, cut.alias("_cut"), gap.alias("_gap")).groupBy("_dealt").agg(
        F.min(pos).alias("_first"), F.max(pos).alias("_last"), F.max("_cut").alias("_last_cut"), F.max("_gap").alias("_gap")).select("*", *[F.col(f"_dealt.{c}") for c in (*keys, _PIECE)])
    over_pieces = W.partitionBy(*keys).orderBy(_PIECE)
    prior = F.lag("_last").over(over_pieces)
    edges = edges.withColumn("_head", F.when(prior.isNull() | (F.col("_first") - prior - 1 > F.col("_gap")), F.col("_first")))
    known = F.coalesce("_last_cut", "_head")
    edges = edges.select("_dealt", F.coalesce(
        "_head", F.last(known, ignorenulls=True).over(over_pieces.rowsBetween(W.unboundedPreceding, -1))).alias("_lead"))
    return local.join(edges, "_dealt").withColumn(start, F.coalesce("_own", "_lead")).drop("_dealt", _PIECE, "_cut", "_own", "_lead")


# -------------------------------------------------------- fixed-width frames
def with_halo(df: DataFrame, keys: Sequence[str], pos: str, *, back: int = 0, ahead: int = 0,
              size: int = CHUNK) -> tuple[DataFrame, Column, list[str]]:
    """Copy the rows a neighbour piece needs for a frame of fixed width.

    Returns the frame, the test that marks a piece's own rows, and the window
    partition columns. Filter by the test once the windows are computed.
    """
    if max(back, ahead) > size:
        size = max(back, ahead)
    home = floor_div(pos, size)
    reach = F.sequence(floor_div(F.col(pos) - ahead, size), floor_div(F.col(pos) + back, size))
    out = df.select("*", home.alias("_home"), F.explode(reach).alias(_PIECE))
    return out, F.col("_home") == F.col(_PIECE), [*keys, _PIECE]


def drop_halo(df: DataFrame, own: Column) -> DataFrame:
    return df.where(own).drop("_home", _PIECE)


# ------------------------------------------------------ value order, not rows
def pieces_wanted(df: DataFrame, low: int = 16) -> int:
    """How many parts one key's values are cut into: twice the session's shuffle partitions."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(low, 2 * n)


def with_value_piece(df: DataFrame, rows: DataFrame, value: str, bins: int) -> DataFrame:
    """Add `_range`, the number of the value range a row falls into: how many of up to `bins` cut points lie below its value.

    The cut points spread `rows` evenly and only balance work; results do not
    depend on them. They are a scalar subquery, so nothing runs while the plan
    is built. A row's range is found by halving.
    """
    if bins < 2:
        return df.withColumn("_range", F.lit(0))
    points = rows.agg(F.array_sort(F.array_distinct(F.percentile_approx(
        col(value).cast("double"), [i / bins for i in range(1, bins)], max(2000, 10 * bins)))).alias("p")).scalar()
    # a column of its own: a subquery may not stand inside a higher-order function
    with_points = df.withColumn("_points", F.coalesce(points, F.array().cast("array<double>")))
    return with_points.withColumn("_range", bucket_by(value, F.col("_points"), max(2, round(bins ** 0.5)))).drop("_points")


def bucket_by(value: str | Column, points: Column, step: int) -> Column:
    """How many of the sorted `points` lie below the value, found by halving: up to 8,191 points, or twice `step` squared if that is more."""
    v = col(value).cast("double")
    ladder = F.array(*[F.lit(1 << i) for i in reversed(range(max(13, (2 * step * step).bit_length())))])
    # a place beyond the last point is null, and not below
    return F.aggregate(ladder, F.lit(0), lambda at, n: F.when(F.get(points, at + n - 1) < v, at + n).otherwise(at))


def by_value(df: DataFrame, keys: Sequence[str], value: str, sums: Mapping[str, Column] | None = None,
             *, bins: int | None = None) -> DataFrame:
    """One row per (keys, distinct value) with counts and running counts in value order.

    Columns: `n` (rows with the value), `upto` (rows with this or a smaller
    value), `upto_total` (rows of the key), and for every entry of `sums` its
    own sum, `<name>_upto` and `<name>_upto_total`. Equal values are merged
    before anything is ordered, so a value held by most rows costs one row.
    """
    sums = dict(sums or {})
    rows = df.where(F.col(value).isNotNull())
    distinct = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), *[F.sum(e).alias(k) for k, e in sums.items()])
    running = {"upto": F.col("n"), **{f"{k}_upto": F.col(k) for k in sums}}
    distinct = with_value_piece(distinct, rows, value, bins or pieces_wanted(df))
    return sweep(distinct, keys, value, piece=F.col("_range"), sums=running).drop("_range")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float],
                    *, bins: int | None = None) -> DataFrame:
    """Exact quantiles per key with linear interpolation, for keys of any size.

    The counts in value order find the two neighbours of the wanted place; no
    key's values are gathered.
    """
    rows = df.where(F.col(value).isNotNull())
    table = by_value(rows, keys, value, bins=bins)
    aggs = []
    for name, p in probs.items():
        at = (F.col("upto_total") - 1) * F.lit(float(p))
        # 0-based ranks either side of the wanted position
        aggs += [
            F.min(F.when(F.col("upto") > F.floor(at), F.col(value))).cast("double").alias(f"_lo_{name}"),
            F.min(F.when(F.col("upto") > F.ceil(at), F.col(value))).cast("double").alias(f"_hi_{name}"),
            F.max(at).alias(f"_at_{name}"),
        ]
    out = table.groupBy(*keys).agg(F.max("upto_total").alias("n"), *aggs)

    def between(k: str) -> Column:
        lo, hi, at = F.col(f"_lo_{k}"), F.col(f"_hi_{k}"), F.col(f"_at_{k}")
        return F.when(lo == hi, lo).otherwise((F.ceil(at) - at) * lo + (at - F.floor(at)) * hi)

    return out.where("n > 0").select(*keys, "n", *[between(k).alias(k) for k in probs])


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, rank: str = "avg_rank") -> DataFrame:
    """One row per (keys, distinct value): its average rank, ties shared."""
    return by_value(df, keys, value).select(
        *keys, value, "n", (F.col("upto") - (F.col("n") - 1) / 2).alias(rank),
        F.col("upto_total").alias("n_total"),
    )


# ------------------------------------------------------------- seeded order
def draw_key(seed: str | int, *cols: str | Column) -> Column:
    """Reproducible pseudo-random text: md5 of the seed and the row's key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(c).cast("string") for c in cols]))


def draw_order(df: DataFrame, keys: Sequence[str], draw: str, rank: str = "draw_rank", digits: int | Column | None = None) -> DataFrame:
    """Place 1, 2, … of every row in the order of a md5 text, per key.

    The leading hex digits are the piece, so even a single key is ordered in
    many parts; keys known to be short need only one digit, or none (a column
    of the frame may tell). `<rank>_total` holds the key's row count.
    """
    if digits is None:
        digits = 2 if pieces_wanted(df) <= 256 else 3
    return sweep(df, keys, draw, piece=F.substring(F.col(draw), F.lit(1), F.lit(digits)), sums={rank: F.lit(1)})


# --------------------------------------------------------------- range joins
def interval_days(df: DataFrame, start: Column, end: Column, name: str = "day") -> DataFrame:
    """One row per calendar day an interval touches: the equi key of a range join."""
    return df.withColumn(name, F.explode(F.sequence(start.cast("date"), end.cast("date"))))
