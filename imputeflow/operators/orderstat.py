"""Exact order statistics without sorting the table.

Each pass counts the rows of the still open value intervals in bins and keeps only the
bins that hold a wanted rank, so a handful of scans with map-side partial counts replaces
a global sort, and the driver sees a bounded number of bins however large the table is.
Bins are of equal width. Where these don't narrow the intervals (values of very different
size), the next bins end at approximate quantiles, so the passes don't depend on the values.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from imputeflow.session import small_table

BIN_BUDGET = 65536
FINISH_ROWS = 20000
NARROWED = 16  # a pass that keeps more than this part of the open rows is followed by one by quantiles
SPLITTERS = 255


@dataclass(frozen=True)
class RankHit:
    """Value at a rank, the rows strictly below it and the rows equal to it."""

    value: float
    below: int
    equal: int


def stack_columns(df: DataFrame, columns: list[Column], keep: Column | None = None) -> DataFrame:
    """Long form ``(grp INT, val DOUBLE)`` of several columns; rows without a value drop out, NaN is none."""
    cells = F.array(*[F.struct(F.lit(i).alias("grp"), c.cast("double").alias("val"))
                      for i, c in enumerate(columns)])
    src = df if keep is None else df.where(keep)
    return src.select(F.inline(cells)).where(F.col("val").isNotNull() & ~F.isnan("val"))


def _quantile_bins(spark, long: DataFrame, inside: DataFrame, open_parts: list) -> DataFrame:
    """Rows inside the open intervals with ``bin``: even between two approximate quantiles, odd at one of them."""
    probs = [(i + 1) / (SPLITTERS + 1) for i in range(SPLITTERS)]
    found = inside.groupBy("part").agg(F.percentile_approx("val", probs, 10000).alias("cuts")).collect()
    cuts = {r.part: sorted(set(r.cuts)) for r in found}
    rows = [(i, g, lo, hi, cuts[i]) for i, (g, lo, hi, _, _) in enumerate(open_parts)]
    table = small_table(spark, rows, "part int, grp int, lo double, hi double, cuts array<double>", 32 + 8 * SPLITTERS)
    held = long.join(table, "grp").where(F.col("val").between(F.col("lo"), F.col("hi")))
    smaller = F.size(F.filter("cuts", lambda c: c < F.col("val")))
    return held.withColumn("bin", (2 * smaller + F.array_contains("cuts", F.col("val")).cast("int")).cast("long"))


def order_statistics(long: DataFrame, ranks_of, bounds: tuple[float, float] | None = None):
    """Exact values at 0-based ranks of every group of ``long(grp, val)``.

    ``ranks_of(counts)`` maps the group sizes to the wanted ranks of each group. ``bounds``
    gives the value range when it is known beforehand (hash draws), which saves a scan.
    Returns ``({(grp, rank): RankHit}, counts)``.
    """
    spark = long.sparkSession
    hits: dict[tuple[int, int], RankHit] = {}

    if bounds is None:
        # the infinities are intervals of their own, so that every open interval has a width
        side = F.when(F.col("val") == -math.inf, -1).when(F.col("val") == math.inf, 1).otherwise(0)
        head = long.groupBy("grp", side.alias("side")).agg(
            F.count("*").alias("n"), F.min("val").alias("lo"), F.max("val").alias("hi")).collect()
        counts = defaultdict(int)
        parts = []
        for r in sorted(head, key=lambda r: (r.grp, r.side)):
            parts.append((r.grp, r.lo, r.hi, counts[r.grp], r.n))
            counts[r.grp] += r.n
        counts = dict(counts)
    else:
        lo, hi = bounds
        scaled = F.floor((F.col("val") - lo) / (hi - lo) * 4096).cast("int")
        head = (long.groupBy("grp", F.least(scaled, F.lit(4095)).alias("bin"))
                .agg(F.count("*").alias("n"), F.min("val").alias("lo"), F.max("val").alias("hi"))
                .collect())
        counts = defaultdict(int)
        parts = []
        for r in sorted(head, key=lambda r: (r.grp, r.bin)):
            parts.append((r.grp, r.lo, r.hi, counts[r.grp], r.n))
            counts[r.grp] += r.n
        counts = dict(counts)

    wanted = {g: sorted({k for k in ks if 0 <= k < counts.get(g, 0)})
              for g, ks in ranks_of(counts).items()}

    def keep_open(parts):
        """Settle the single-valued parts, return the others that hold a wanted rank."""
        still = []
        for g, lo, hi, below, n in parts:
            ranks = [k for k in wanted.get(g, ()) if below <= k < below + n and (g, k) not in hits]
            if not ranks:
                continue
            if lo == hi:
                hits.update({(g, k): RankHit(lo, below, n) for k in ranks})
            else:
                still.append((g, lo, hi, below, n))
        return still

    open_parts = keep_open(parts)
    before = None
    while open_parts:
        n_open = sum(p[4] for p in open_parts)
        rows = [(i, g, lo, hi) for i, (g, lo, hi, _, _) in enumerate(open_parts)]
        table = small_table(spark, rows, "part int, grp int, lo double, hi double", 32)
        inside = long.join(table, "grp").where(F.col("val").between(F.col("lo"), F.col("hi")))
        if n_open <= FINISH_ROWS:
            values = inside.groupBy("part", "val").count().collect()
            by_part = defaultdict(list)
            for r in values:
                by_part[r.part].append((r.val, r["count"]))
            pieces = []
            for i, (g, _, _, below, _) in enumerate(open_parts):
                for v, n in sorted(by_part[i]):
                    pieces.append((g, v, v, below, n))
                    below += n
        else:
            if before is not None and n_open > before / NARROWED:
                binned, before = _quantile_bins(spark, long, inside, open_parts), None
            else:
                bins, before = max(64, BIN_BUDGET // len(open_parts)), n_open
                # halved first: the width of an interval may pass the largest double
                place = (F.col("val") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * bins
                binned = inside.withColumn("bin", F.least(F.floor(place), F.lit(bins - 1)))
            cells = (binned.groupBy("part", "bin")
                     .agg(F.count("*").alias("n"), F.min("val").alias("lo"), F.max("val").alias("hi")).collect())
            seen = {i: p[3] for i, p in enumerate(open_parts)}
            pieces = []
            for r in sorted(cells, key=lambda r: (r.part, r.bin)):
                pieces.append((open_parts[r.part][0], r.lo, r.hi, seen[r.part], r.n))
                seen[r.part] += r.n
        open_parts = keep_open(pieces)
    return hits, counts


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> dict:
    """Linear-interpolated quantiles ``{(column, p): value}`` over the non-null values."""
    long = stack_columns(df, [F.col(c) for c in columns])

    def ranks_of(counts):
        out = {}
        for g, n in counts.items():
            spots = [p * (n - 1) for p in probs]
            out[g] = [math.floor(s) for s in spots] + [math.ceil(s) for s in spots]
        return out

    hits, counts = order_statistics(long, ranks_of)
    result = {}
    for g, name in enumerate(columns):
        n = counts.get(g, 0)
        for p in probs:
            if not n:
                result[name, p] = None
                continue
            spot = p * (n - 1)
            lo, hi = hits[g, math.floor(spot)].value, hits[g, math.ceil(spot)].value
            result[name, p] = lo if lo == hi else lo + (hi - lo) * (spot - math.floor(spot))
    return result


def exact_medians(df: DataFrame, columns: list[str]) -> dict:
    return {c: v for (c, _), v in exact_quantiles(df, columns, [0.5]).items()}


@dataclass(frozen=True)
class Cut:
    """Rows at or before a place in the order (draw, key); ``None`` value means no row."""

    value: float | None
    last_key: object = None

    def holds(self, draw: Column, key: Column) -> Column:
        if self.value is None:
            return F.lit(False)
        if self.last_key is None:
            return draw <= F.lit(self.value)
        return (draw < F.lit(self.value)) | ((draw == F.lit(self.value)) & (key <= F.lit(self.last_key)))


def draw_cuts(df: DataFrame, key: str, draws: list[tuple[Column, Column]], groups: list[int],
              sizes_of):
    """The cuts that take exactly the wanted number of rows from each group, by lowest draw.

    ``draws`` are pairs (draw, group number), each giving one cell per row. ``sizes_of(counts)``
    maps group sizes to lists of row counts. The result ``{(group, size): Cut}`` turns an
    exact-count choice into a plain per-row comparison. Equal draws at a cut are settled by
    key; there the few keys involved are read.
    """
    # named first, so that a draw is worked out once per row and not once per use
    named = df.select(F.col(key).alias("k"),
                      *[d.alias(f"d{i}") for i, (d, _) in enumerate(draws)],
                      *[g.cast("int").alias(f"g{i}") for i, (_, g) in enumerate(draws)])
    cells = F.array(*[F.struct(F.col(f"g{i}").alias("grp"), F.col(f"d{i}").alias("val"))
                      for i in range(len(draws))])
    long = named.select(F.inline(cells)).where(F.col("grp").isNotNull())
    sizes: dict[int, list[int]] = {}

    def fill(counts):
        return {g: counts.get(g, 0) for g in groups}

    def ranks_of(counts):
        counts = fill(counts)
        sizes.update({g: [min(s, counts[g]) for s in ss] for g, ss in sizes_of(counts).items()})
        return {g: [s - 1 for s in ss if s > 0] for g, ss in sizes.items()}

    hits, counts = order_statistics(long, ranks_of, bounds=(0.0, 1.0))
    cuts = {}
    for g, ss in sizes.items():
        for s in ss:
            if s <= 0:
                cuts[g, s] = Cut(None)
                continue
            hit = hits[g, s - 1]
            if hit.below + hit.equal == s:
                cuts[g, s] = Cut(hit.value)
            else:
                at_cut = F.lit(False)
                for i in range(len(draws)):
                    at_cut = at_cut | ((F.col(f"g{i}") == g) & (F.col(f"d{i}") == F.lit(hit.value)))
                tied = named.where(at_cut).select("k").orderBy("k").limit(s - hit.below).collect()
                cuts[g, s] = Cut(hit.value, tied[-1].k)
    return cuts, fill(counts)
