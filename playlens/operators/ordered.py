"""Ordered analysis that survives a hot key.

A window partitioned by the bare key puts a key's rows, however many, into one task. The scans here partition by the
key *and a chunk of the ordering column*, reduce each chunk to one row (with map-side combine), run the window over
those few rows, and hand each chunk what came before (or after) it. The result is the plain window's, exactly.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "__chunk"


@dataclass(frozen=True)
class Scan:
    """One scanned column: ``kind`` is sum, max or min (running), last (at or before) or first (at or after).

    ``value`` rows that are null are passed over. ``inclusive`` counts the row itself.
    """

    out: str
    kind: str
    value: Column
    inclusive: bool = True


_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def _key_match(left: str, right: str, names: Sequence[str]) -> Column:
    cond = F.lit(True)
    for n in names:
        cond = cond & F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.__{n}"))
    return cond


def scan(df: DataFrame, by: Sequence[str], order: Sequence[str], chunk: Column, specs: Sequence[Scan]) -> DataFrame:
    """Add the ``specs`` to ``df``, over ``by`` in ascending ``order``.

    ``chunk`` must be a non-decreasing function of the order, so that the chunks of a key follow one another.
    """
    by, order = list(by), list(order)
    base = df.withColumn(CHUNK, chunk)
    inner = Window.partitionBy(*by, CHUNK).orderBy(*order)
    outer = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy(CHUNK)
    position = F.struct(*order)

    totals, carries, inside = [], [], []
    for i, s in enumerate(specs):
        tot, carry, here = f"__t{i}", f"__c{i}", f"__h{i}"
        if s.kind in _AGG:
            agg = _AGG[s.kind]
            totals.append(agg(s.value).alias(tot))
            carries.append(agg(tot).over(outer.rowsBetween(Window.unboundedPreceding, -1)).alias(carry))
            frame = inner.rowsBetween(Window.unboundedPreceding, 0 if s.inclusive else -1)
            inside.append(agg(s.value).over(frame).alias(here))
        elif s.kind == "last":
            totals.append(F.max_by(s.value, F.when(s.value.isNotNull(), position)).alias(tot))
            carries.append(
                F.last(tot, ignorenulls=True).over(outer.rowsBetween(Window.unboundedPreceding, -1)).alias(carry)
            )
            frame = inner.rowsBetween(Window.unboundedPreceding, 0 if s.inclusive else -1)
            inside.append(F.last(s.value, ignorenulls=True).over(frame).alias(here))
        elif s.kind == "first":
            totals.append(F.min_by(s.value, F.when(s.value.isNotNull(), position)).alias(tot))
            carries.append(
                F.first(tot, ignorenulls=True).over(outer.rowsBetween(1, Window.unboundedFollowing)).alias(carry)
            )
            frame = inner.rowsBetween(0 if s.inclusive else 1, Window.unboundedFollowing)
            inside.append(F.first(s.value, ignorenulls=True).over(frame).alias(here))
        else:
            raise ValueError(f"unknown scan kind {s.kind!r}")

    names = [*by, CHUNK]
    carry = (
        base.groupBy(*names)
        .agg(*totals)
        .select(*[F.col(n).alias(f"__{n}") for n in names], *carries)
    )
    detail = base.select("*", *inside)
    # One row a chunk is hashed; a merge would sort every row once more.
    joined = detail.alias("d").join(carry.hint("shuffle_hash").alias("c"), _key_match("d", "c", names), "left")

    outs = []
    for i, s in enumerate(specs):
        here, before = F.col(f"d.__h{i}"), F.col(f"c.__c{i}")
        if s.kind == "sum":
            value = F.when(here.isNull() & before.isNull(), None).otherwise(
                F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0))
            )
        elif s.kind == "max":
            value = F.greatest(here, before)
        elif s.kind == "min":
            value = F.least(here, before)
        else:
            value = F.coalesce(here, before)
        outs.append(value.alias(s.out))
    return joined.select(*[F.col(f"d.{c}") for c in df.columns], *outs)


def asof(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_time: Column,
    right_time: Column,
    values: dict[str, Column],
    width: float,
    direction: str = "backward",
) -> DataFrame:
    """For every left row the values of the last right row at or before ``left_time`` (or first after, "forward").

    A union and a chunked scan, so no range blow-up: every row is shuffled once. ``width`` is the chunk's length in
    the unit of the times. Forward is strict: a right row at the very time is not "after".
    """
    by = list(by)
    cols = list(left.columns)
    struct = F.struct(*[v.alias(k) for k, v in values.items()])
    l = left.select(*by, left_time.alias("__time"), F.lit(1).alias("__side"), F.struct(*cols).alias("__left"))
    r = right.select(*by, right_time.alias("__time"), F.lit(0).alias("__side"), struct.alias("__right"))
    both = r.unionByName(l, allowMissingColumns=True)
    kind = "last" if direction == "backward" else "first"
    tie = ["__time", "__side", "__right"]
    found = scan(
        both,
        by,
        tie,
        F.floor(F.col("__time") / F.lit(float(width))),
        [Scan("__found", kind, F.col("__right"), inclusive=False)],
    ).where(F.col("__side") == 1)
    return found.select(
        *[F.col("__left")[c].alias(c) for c in cols],
        *[F.col("__found")[k].alias(k) for k in values],
    )


def flag_first(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, out: str) -> DataFrame:
    """True on the first ``n`` rows of each ``by`` group.

    Ranking keeps only ``n`` rows a group before the shuffle (Spark's window group limit); every other row is compared
    with its group's cut-off, so no group is sorted whole in one task. ``order`` must be unique within a group.
    """
    by = list(by)
    pos = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    ranked = df.select(*by, pos.alias("__pos")).withColumn(
        "__rn", F.row_number().over(Window.partitionBy(*by).orderBy("__pos"))
    )
    cut = ranked.where(F.col("__rn") <= n).groupBy(*by).agg(F.max("__pos").alias("__cut"))
    cut = cut.select(*[F.col(c).alias(f"__{c}") for c in by], "__cut")
    joined = df.withColumn("__pos", pos).alias("d").join(cut.alias("c"), _key_match("d", "c", by), "left")
    return joined.select(*[F.col(f"d.{c}") for c in df.columns], (F.col("d.__pos") <= F.col("c.__cut")).alias(out))


def top_n(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group with their rank; the limit is applied on both sides of the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= n)


def merge_intervals(
    df: DataFrame, by: Sequence[str], start: str = "start", end: str = "end", tol: float = 0.05, width: float = 3600.0
) -> DataFrame:
    """Coverage intervals, merged where the next starts no later than ``tol`` past what is covered so far."""
    rows = df.where(F.col(end) > F.col(start)).select(*by, start, end)
    chunk = F.floor(F.col(start) / F.lit(float(width)))
    seen = scan(rows, by, [start, end], chunk, [Scan("__reach", "max", F.col(end), inclusive=False)])
    opens = F.when(F.col("__reach").isNull() | (F.col(start) > F.col("__reach") + F.lit(tol)), 1).otherwise(0)
    islands = scan(
        seen.withColumn("__opens", opens), by, [start, end], chunk, [Scan("__island", "sum", F.col("__opens"))]
    )
    return islands.groupBy(*by, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_span: tuple[Column, Column],
    right_span: tuple[Column, Column],
    width: float,
) -> DataFrame:
    """Pairs whose half-open spans overlap, as an equi-join on (key, bucket).

    Each span is listed in every bucket it touches; a pair is kept only in the later of the two starting buckets, so
    it comes out once with no distinct.
    """
    by = list(by)

    def spread(df: DataFrame, span: tuple[Column, Column], side: str) -> DataFrame:
        lo, hi = F.floor(span[0] / F.lit(width)), F.floor(span[1] / F.lit(width))
        return df.select(
            *[F.col(c).alias(f"__{side}_{c}") for c in by],
            span[0].alias(f"__{side}_lo"),
            span[1].alias(f"__{side}_hi"),
            lo.alias(f"__{side}_first"),
            F.explode(F.sequence(lo, F.greatest(hi, lo))).alias(f"__{side}_bucket"),
            F.struct(*df.columns).alias(f"__{side}"),
        )

    l, r = spread(left, left_span, "l"), spread(right, right_span, "r")
    cond = F.col("__l_bucket") == F.col("__r_bucket")
    for c in by:
        cond = cond & (F.col(f"__l_{c}") == F.col(f"__r_{c}"))
    cond = cond & (F.col("__l_lo") < F.col("__r_hi")) & (F.col("__l_hi") > F.col("__r_lo"))
    cond = cond & (F.col("__l_bucket") == F.greatest("__l_first", "__r_first"))
    # Rows packed into structs are many times their estimate: merged, not broadcast.
    pairs = l.join(r.hint("merge"), cond)
    right_cols = [c for c in right.columns if c not in by]
    return pairs.select(
        *[F.col("__l")[c].alias(c) for c in left.columns],
        *[F.col("__r")[c].alias(c) for c in right_cols],
    )
