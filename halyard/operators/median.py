"""Exact order statistics that no single task has to hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What one task counts at the end: so many values at most.
FITS = 50_000


def ranked(values: DataFrame, ranks: list[int], n: int, fits: int = FITS) -> dict[int, float]:
    """{rank: value} of ``values(v)``, ``n`` doubles without nulls, ranks from 0.

    Two values of a mergeable sketch fence the ranks in; one pass counts exactly what lies below, at, between and
    above them. A fence whose own count holds a rank is its value; else the search goes on inside the open range that
    holds it, which lacks the fences, so it ends, whatever the sketch says and however many values are equal."""
    found: dict[int, float] = {}
    open_: list[tuple[list[int], DataFrame, int, int]] = [(sorted(set(ranks)), values, 0, n)]
    while open_:
        wanted, inside, below, left = open_.pop()
        if not wanted:
            continue
        if left <= fits:
            counts = inside.groupBy("v").agg(F.count(F.lit(1)).alias("n")).orderBy("v").collect()  # at most ``fits`` numbers
            for r in counts:
                found |= {k: r["v"] for k in wanted if below <= k < below + r["n"]}
                below += r["n"]
            continue
        share = [min(max((k - below) / left + d, 0.0), 1.0) for k, d in ((wanted[0], -1e-3), (wanted[-1], 1e-3))]
        a, b = inside.agg(F.percentile_approx("v", share, 10_000).alias("p")).first()["p"]
        v = F.col("v")
        parts = [v < a, v == a, (v > a) & (v < b), (v == b) & (v != a), v > b]
        sizes = inside.agg(*[F.count_if(p).alias(f"c{k}") for k, p in enumerate(parts)]).first()
        for part, size, value in zip(parts, sizes, (None, a, None, b, None), strict=True):
            mine = [k for k in wanted if below <= k < below + size]
            if value is not None:
                found |= dict.fromkeys(mine, value)
            else:
                open_.append((mine, inside.filter(part), below, size))
            below += size
    return found


def exact_median(rows: DataFrame, column: str, fits: int = FITS) -> float | None:
    """The median of a column's values that are not null, as ``median`` gives it; None if there are none."""
    values = rows.select(F.col(column).cast("double").alias("v")).filter("v is not null")
    n = values.count()
    if not n:
        return None
    low, high = (n - 1) // 2, n // 2
    found = ranked(values, [low, high], n, fits)
    return found[low] if low == high else 0.5 * found[low] + 0.5 * found[high]
