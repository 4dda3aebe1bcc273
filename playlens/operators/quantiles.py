"""Exact quantiles of groups of any size, by narrowing histograms instead of sorting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playlens.session import cut_lineage

BINS = 1024


def _same(left: str, right: str, names: Sequence[str]) -> Column:
    cond = F.lit(True)
    for n in names:
        cond = cond & F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}"))
    return cond


def exact_quantiles(rows: DataFrame, by: Sequence[str], values: Sequence[str], shares: Mapping[str, float], bins: int = BINS) -> DataFrame:
    """One row a group with ``{value}_{name}`` for each of ``values`` and of the named ``shares``: the smallest value that
    at least that share of the group's values doesn't exceed. Nulls don't count; a group without values has null.

    Each round counts the values between the known bounds in ``bins`` bins, with map-side combine, and the bin that holds
    the rank gives narrower bounds: its own least and greatest value. It ends when they are one. Rows are never sorted, a
    group of any size is spread over all tasks, and what is kept of a group is ``bins`` counts a quantile at most.
    """
    by = list(by)
    wide, names = _narrowed(rows, by, values, shares, bins), [f"{v}_{k}" for v in values for k in shares]
    groups = rows.select(*by).distinct()
    return groups.alias("g").join(wide.alias("w"), _same("g", "w", by), "left").select(*[F.col(f"g.{b}").alias(b) for b in by], *[F.col(f"w.{n}").alias(n) for n in names])


def _narrowed(rows: DataFrame, by: list[str], values: Sequence[str], shares: Mapping[str, float], bins: int = BINS) -> DataFrame:
    """The quantiles of the groups that have values; ``rows`` are read once."""
    keys = [*by, "__value", "__name"]
    pairs = F.array(*[F.struct(F.lit(v).alias("__value"), F.col(v).cast("double").alias("__x")) for v in values])
    held = rows.select(*by, F.inline(pairs)).where(F.col("__x").isNotNull() & ~F.isnan("__x"))
    held = cut_lineage(held.groupBy(*by, "__value", "__x").agg(F.count("*").alias("__n")))
    named = F.array(*[F.struct(F.lit(k).alias("__name"), F.lit(float(p)).alias("__share")) for k, p in shares.items()])
    sought = held.groupBy(*by, "__value").agg(F.sum("__n").alias("__all"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
    rank = F.greatest(F.ceil(F.col("__share") * F.col("__all")), F.lit(1)).cast("bigint")
    sought = sought.select("*", F.inline(named)).select(*keys, "__lo", "__hi", rank.alias("__rank"))
    running = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)
    done = None
    while True:
        sought = cut_lineage(sought)
        found = sought.where(F.col("__lo") == F.col("__hi"))
        done = found if done is None else done.unionByName(found)
        sought = sought.where(F.col("__lo") < F.col("__hi"))
        if sought.isEmpty():
            break
        inside = held.alias("h").join(sought.alias("s"), _same("h", "s", [*by, "__value"]) & F.col("h.__x").between(F.col("s.__lo"), F.col("s.__hi")))
        # Halves first: the difference of two large doubles of opposite sign would overflow.
        place = (F.col("h.__x") / 2 - F.col("s.__lo") / 2) / (F.col("s.__hi") / 2 - F.col("s.__lo") / 2)
        part = F.when(F.col("h.__x") == F.col("s.__hi"), bins).otherwise(F.least(F.floor(place * bins), F.lit(bins - 1))).cast("int")
        counts = inside.groupBy(*[F.col(f"s.{k}").alias(k) for k in keys], F.col("s.__rank").alias("__rank"), part.alias("__bin")).agg(
            F.sum("h.__n").alias("__n"), F.min("h.__x").alias("__lo"), F.max("h.__x").alias("__hi")
        )
        upto = counts.withColumn("__upto", F.sum("__n").over(running))
        hit = upto.where((F.col("__upto") >= F.col("__rank")) & (F.col("__upto") - F.col("__n") < F.col("__rank")))
        sought = hit.select(*keys, "__lo", "__hi", (F.col("__rank") - F.col("__upto") + F.col("__n")).alias("__rank"))
    return done.groupBy(*by).agg(
        *[F.max(F.when((F.col("__value") == v) & (F.col("__name") == k), F.col("__lo"))).alias(f"{v}_{k}") for v in values for k in shares]
    )


def with_quantiles(totals: DataFrame, rows: DataFrame, by: Sequence[str], values: Sequence[str], shares: Mapping[str, float]) -> DataFrame:
    """``totals`` (one row a group of ``by``) with the exact quantiles of ``rows``, which are read once: the groups are those of ``totals``."""
    found = _narrowed(rows, list(by), values, shares)
    names = [c for c in found.columns if c not in by]
    return totals.alias("t").join(found.alias("q"), _same("t", "q", list(by)), "left").select("t.*", *[F.col(f"q.{n}").alias(n) for n in names])
