"""Exact k nearest neighbours as a join of row blocks.

Donors are laid into cells with a known bounding box; a row first meets the cell nearest to
it, which bounds its k-th distance, and then only the cells that can still beat that bound.
Rows meet in blocks of bounded size (cell x donor chunk x query chunk); a block returns only
its k best per row, the second time only those within the bound. Inside a block, matrix products leave out the pairs
that are surely too far, by more than their rounding; the others are worked out exactly. Copies are reduced beforehand to the k+1 lowest keys, which is all that
any neighbour list can hold of them, so a hot value cannot swell a cell.

The distance is the mean squared difference over the columns known in both rows; ties go to
the lower key.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from imputeflow.session import cut_lineage

BLOCK_ROWS = 4096
QUERY_ROWS = 4096
MANY_COLUMNS = 16  # beyond, boxes prune little, and blocks grow with the table to be met by fewer copies of a row
BLOCK_BYTES = 16 << 20
LARGEST_BLOCK = 32768
MAX_CELLS = 16384
PATTERN_CELLS = 64
SPLIT_SAMPLE = 200_000
SPLIT_BYTES = 32 << 20  # of sampled rows on the driver; they place the borders of cells only
PAIR_BUDGET = 1 << 20


@dataclass
class CellForest:
    """One split tree per stratum (group, pattern of missing columns), flattened."""

    roots: dict
    dim: np.ndarray
    thr: np.ndarray
    left: np.ndarray

    def place(self, strata, x: np.ndarray) -> np.ndarray:
        node = np.array([self.roots.get(s, -1) for s in strata], np.int64)
        rows = np.arange(len(x))
        while True:
            go = (node >= 0) & (self.dim[node] >= 0)
            if not go.any():
                return node
            d = self.dim[node]
            right = x[rows, np.maximum(d, 0)] > self.thr[node]
            node = np.where(go, self.left[node] + right, node)


def grow_forest(strata: dict, sample: dict, target: int) -> CellForest:
    """Halve the largest strata at sampled medians until cells hold about ``target`` rows."""
    dim, thr, left, roots, heap = [], [], [], {}, []

    def node():
        dim.append(-1), thr.append(0.0), left.append(-1)
        return len(dim) - 1

    for s, n in strata.items():
        roots[s] = node()
        heap.append((-n, roots[s], s, sample.get(s)))
    heapq.heapify(heap)
    leaves = len(heap)
    while heap and leaves < MAX_CELLS:
        n, at, s, pts = heapq.heappop(heap)
        if -n <= target:
            break
        if pts is None or len(pts) < 4:
            continue
        seen = ~np.isnan(pts).any(axis=0)
        if not seen.any():
            continue
        spread = np.where(seen, np.nanmax(pts, 0) - np.nanmin(pts, 0), -1.0)
        d = int(np.argmax(spread))
        cut = float(np.median(pts[:, d]))
        low = pts[:, d] <= cut
        if low.all():
            cut = float(pts[:, d][pts[:, d] < cut].max()) if (pts[:, d] < cut).any() else None
            if cut is None:
                continue
            low = pts[:, d] <= cut
        a, b = node(), node()
        dim[at], thr[at], left[at] = d, cut, a
        share = low.mean()
        heapq.heappush(heap, (n * share, a, s, pts[low]))
        heapq.heappush(heap, (n * (1 - share), b, s, pts[~low]))
        leaves += 1
    return CellForest(roots, np.array(dim), np.array(thr), np.array(left))


@dataclass
class Cells:
    """What is known of every cell: size, known cells per column, box, group."""

    ids: np.ndarray
    group: np.ndarray
    n: np.ndarray
    n_known: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    def lower_bounds(self, x: np.ndarray) -> np.ndarray:
        """Least possible distance of each row to each cell; zero where columns are mixed."""
        known = ~np.isnan(x)
        pure = ((self.n_known == 0) | (self.n_known == self.n[:, None])).all(axis=1)
        has = self.n_known > 0
        gap = np.zeros((len(x), len(self.ids)))
        shared = np.zeros_like(gap)
        for c in range(x.shape[1]):
            v = np.where(known[:, c], x[:, c], 0.0)[:, None]
            both = known[:, c][:, None] & has[:, c][None, :]
            lo = np.where(has[:, c], self.lo[:, c], 0.0)
            hi = np.where(has[:, c], self.hi[:, c], 0.0)
            away = np.maximum(np.maximum(lo - v, v - hi), 0.0)
            gap += np.where(both, away * away, 0.0)
            shared += both
        with np.errstate(divide="ignore", invalid="ignore"):
            bound = np.where(shared > 0, gap / shared, np.inf)
        # a hair lower, so that rounding can never hide a cell
        return np.where(pure[None, :], bound * (1 - 1e-12), 0.0)


def _matrix(series) -> np.ndarray:
    return np.array(list(series), float)


def list_rows(column, width: int) -> np.ndarray:
    """An Arrow column of lists as rows of a matrix, nulls as NaN."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def _places(names: list) -> dict:
    at: dict = {}
    for i, name in enumerate(names):
        at.setdefault(name, []).append(i)
    return at


class NeighbourJoin:
    """``k`` nearest donors of every query row.

    ``per_column`` asks, for each missing column of a query, for the nearest donors that know
    it; otherwise all donors count. ``group`` restricts both sides to equal groups. A donor
    with the query's own key is never its neighbour. The result carries the donor's values
    (``dx``, if asked for) and ``tag``, so that nothing has to be joined back by donor: a
    donor near very many rows would make a skewed key.
    """

    def __init__(self, key: str, cols, k: int, group: str | None = None, per_column: bool = False,
                 tag: str | None = None, carry: bool = False,
                 block_rows: int | None = None, query_rows: int | None = None):
        self.key, self.cols, self.k = key, list(cols), k
        self.tag, self.carry = tag, carry
        self.group, self.per_column = group, per_column
        self.block_rows, self.query_rows = block_rows, query_rows

    # ---- preparation ----

    def _packed(self, df: DataFrame) -> DataFrame:
        group = F.col(self.group).cast("string") if self.group else F.lit("")
        tag = F.col(self.tag).cast("string") if self.tag else F.lit(None).cast("string")
        return df.select(F.col(self.key).alias("k"), group.alias("g"), tag.alias("t"),
                         F.array(*[F.col(c).cast("double") for c in self.cols]).alias("x"))

    def _distinct_donors(self, donors: DataFrame) -> DataFrame:
        """Of rows with equal values the k+1 lowest keys; the limit works before the shuffle."""
        same = Window.partitionBy("g", "x").orderBy("k")
        return (donors.withColumn("copy", F.row_number().over(same))
                .where(F.col("copy") <= self.k + 1).drop("copy"))

    def _strata(self):
        return F.concat_ws("|", "g", F.concat_ws("", F.transform("x", lambda v: F.when(v.isNull(), "0").otherwise("1"))))

    def _block_sizes(self, n: int) -> None:
        """The rows of a block, where the caller didn't name them."""
        size = BLOCK_ROWS
        if len(self.cols) > MANY_COLUMNS:
            size = max(BLOCK_ROWS, min(LARGEST_BLOCK, BLOCK_BYTES // (8 * len(self.cols)), n // 8))
        self.block_rows, self.query_rows = self.block_rows or size, self.query_rows or max(QUERY_ROWS, size)

    def _cells(self, donors: DataFrame):
        by_pattern = donors.groupBy("g", "s").count().limit(MAX_CELLS + 1).collect()
        by_group = {r.g: r["count"] for r in donors.groupBy("g").count().collect()}
        n = sum(by_group.values())
        self._block_sizes(n)
        if len(by_pattern) > min(MAX_CELLS, len(by_group) + PATTERN_CELLS + 4 * n // self.block_rows):
            # too many patterns to tell apart: cells of mixed rows, which no bound can skip
            donors = donors.withColumn("s", F.col("g"))
            counts = {(g, g): c for g, c in by_group.items()}
        else:
            counts = {(r.g, r.s): r["count"] for r in by_pattern}
        if n <= self.block_rows:
            # everything fits one block per group: no need to tell patterns apart
            forest = CellForest({g: i for i, g in enumerate(by_group)}, np.full(len(by_group), -1),
                                np.zeros(len(by_group)), np.full(len(by_group), -1))
            stratum = "g"
        else:
            few = min(SPLIT_SAMPLE, SPLIT_BYTES // (8 * len(self.cols)))
            picked = donors.sample(min(1.0, few / n), seed=7).select("s", "x").toArrow()
            x = list_rows(picked.column("x"), len(self.cols))
            sample = {s: x[at] for s, at in _places(picked.column("s").to_pylist()).items()}
            forest = grow_forest({s: c for (_, s), c in counts.items()}, sample, self.block_rows)
            stratum = "s"

        @F.pandas_udf("long")
        def cell_of(s: pd.Series, x: pd.Series) -> pd.Series:
            return pd.Series(forest.place(s.to_numpy(), _matrix(x)))

        placed = donors.withColumn("cell", cell_of(F.col(stratum), F.col("x"))).drop("s")
        p = len(self.cols)
        stats = placed.groupBy("cell", "g").agg(
            F.count("*").alias("n"),
            F.array(*[F.count(F.col("x")[i]) for i in range(p)]).alias("known"),
            F.array(*[F.min(F.col("x")[i]) for i in range(p)]).alias("lo"),
            F.array(*[F.max(F.col("x")[i]) for i in range(p)]).alias("hi")).collect()
        cells = Cells(np.array([r.cell for r in stats], np.int64), np.array([r.g for r in stats], object),
                      np.array([r.n for r in stats]), np.array([r.known for r in stats]).reshape(-1, p),
                      _matrix([r.lo for r in stats]).reshape(-1, p), _matrix([r.hi for r in stats]).reshape(-1, p))
        return placed, cells

    # ---- routing ----

    def _router(self, cells: Cells, first: bool):
        k, per_column, p = self.k, self.per_column, len(self.cols)
        chunk = max(1, PAIR_BUDGET // max(1, len(cells.ids)))

        def route(group, x, bounds):
            lb = cells.lower_bounds(x)
            fits = np.array([cells.group == g for g in group]) if len(group) else np.zeros((0, len(cells.ids)), bool)
            out = [set() for _ in group]
            for t in range(p) if per_column else (-1,):
                wants = np.isnan(x[:, t]) if t >= 0 else np.ones(len(x), bool)
                can = fits & ((cells.n_known[:, t] > 0)[None, :] if t >= 0 else True)
                enough = can & ((cells.n_known[:, t] if t >= 0 else cells.n) > k)[None, :]
                near = np.where(enough, lb, np.inf)
                home = near.argmin(axis=1)
                has_home = np.isfinite(near[np.arange(len(x)), home]) if len(x) else np.zeros(0, bool)
                for r in np.flatnonzero(wants):
                    if first:
                        if has_home[r]:
                            out[r].add(int(cells.ids[home[r]]))
                    else:
                        bound = bounds[r][t] if t >= 0 else bounds[r][0]
                        hit = can[r] & (lb[r] <= bound) & np.isfinite(lb[r])
                        out[r].update(int(c) for c in cells.ids[hit])
            return out

        def pieces(g, x, b):
            for at in range(0, len(x), chunk):
                part = slice(at, at + chunk)
                yield from route(g[part], _matrix(x.iloc[part]).reshape(-1, p),
                                 None if b is None else b.iloc[part].tolist())

        if first:
            @F.pandas_udf("array<long>")
            def home_cells(g: pd.Series, x: pd.Series) -> pd.Series:
                return pd.Series([sorted(c) for c in pieces(g.to_numpy(), x, None)])
            return home_cells

        @F.pandas_udf("array<long>")
        def other_cells(g: pd.Series, x: pd.Series, bound: pd.Series) -> pd.Series:
            return pd.Series([sorted(c) for c in pieces(g.to_numpy(), x, bound)])
        return other_cells

    # ---- meeting ----

    def _meet(self, routed: DataFrame, placed: DataFrame, cells: Cells) -> DataFrame:
        """Neighbours found where routed rows ``(k, x, bound, cell)`` meet their cells, in blocks; none beyond a bound."""
        spark = routed.sparkSession
        k, per_column = self.k, self.per_column
        if "bound" not in routed.columns:
            routed = routed.withColumn("bound", F.lit(None).cast("array<double>"))
        if len(cells.ids) == 1:
            dn, qn = -(-int(cells.n[0]) // self.block_rows), max(1, -(-routed.count() // self.query_rows))
            sized = [t.withColumns({"dn": F.lit(dn), "qn": F.lit(qn)}) for t in (routed, placed)]
        else:
            asked = routed.groupBy("cell").agg(F.count("*").alias("asked"))
            held = spark.createDataFrame([(int(c), int(n)) for c, n in zip(cells.ids, cells.n)],
                                         "cell long, held long")
            # one row per cell, at most MAX_CELLS and the strata: small whatever the table
            plan = asked.join(F.broadcast(held), "cell").select(
                "cell", F.ceil(F.col("held") / self.block_rows).cast("int").alias("dn"),
                F.ceil(F.col("asked") / self.query_rows).cast("int").alias("qn"))
            sized = [t.join(F.broadcast(plan), "cell") for t in (routed, placed)]
        q = (sized[0].withColumn("qc", F.pmod(F.xxhash64("k"), F.col("qn")).cast("int"))
             .withColumn("dc", F.explode(F.sequence(F.lit(0), F.col("dn") - 1)))
             .select("cell", "dc", "qc", "k", "x", "bound"))
        d = (sized[1].withColumn("dc", F.pmod(F.xxhash64("k"), F.col("dn")).cast("int"))
             .withColumn("qc", F.explode(F.sequence(F.lit(0), F.col("qn") - 1)))
             .select("cell", "dc", "qc", F.col("k").alias("dk"), F.col("x").alias("dx"), F.col("t").alias("dt")))
        carry = self.carry

        def block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({c: [] for c in ("k", "target", "dk", "dist", "val", "dt", "dx")}, dtype=object)
            right = right.sort_values("dk", ignore_index=True)
            dx, dk = _matrix(right["dx"]), right["dk"].to_numpy()
            qx, qk = _matrix(left["x"]), left["k"].to_numpy()
            bound = None if left["bound"].iloc[0] is None else _matrix(left["bound"])
            best = best_in_block(qx, qk, dx, dk, k, per_column, bound)
            at = best.pop("at").to_numpy(int)
            best["dt"] = right["dt"].to_numpy()[at]
            best["dx"] = right["dx"].to_numpy()[at] if carry else None
            return best

        blocks = ["cell", "dc", "qc"]
        found = q.groupBy(*blocks).cogroup(d.groupBy(*blocks)).applyInPandas(
            block, self._schema(routed))
        return self._best(found)

    @staticmethod
    def _schema(df: DataFrame) -> str:
        key = df.schema["k"].dataType.simpleString()
        return f"k {key}, target int, dk {key}, dist double, val double, dt string, dx array<double>"

    def _best(self, found: DataFrame) -> DataFrame:
        order = Window.partitionBy("k", "target").orderBy("dist", "dk")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= self.k)

    def join(self, queries: DataFrame, donors: DataFrame) -> DataFrame:
        """Rows ``(k, target, dk, dist, val, dt, dx, rank)``; target is -1 or the column asked for."""
        q = self._packed(queries)
        placed, cells = self._cells(cut_lineage(self._distinct_donors(self._packed(donors)).withColumn("s", self._strata())))
        if not len(cells.ids):
            return q.sparkSession.createDataFrame([], self._schema(q) + ", rank int")
        if self.per_column:
            q = q.where(F.exists("x", lambda v: v.isNull()))
        home = self._router(cells, first=True)
        if len(set(cells.group)) == len(cells.ids):
            # a single cell per group: every row simply meets its group's cell
            if self.group is None:
                return self._meet(q.select("k", "x", F.lit(int(cells.ids[0])).alias("cell")), placed, cells)
            held = q.sparkSession.createDataFrame([(int(c), g) for c, g in zip(cells.ids, cells.group)],
                                                  "cell long, g string")
            return self._meet(q.join(F.broadcast(held), "g").select("k", "x", "cell"), placed, cells)
        routed = q.withColumn("cells", home("g", "x"))
        first = cut_lineage(self._meet(routed.select("k", "x", F.explode("cells").alias("cell")),
                                       placed, cells))
        n_bounds = len(self.cols) if self.per_column else 1
        reach = first.groupBy("k").agg(F.array(*[
            F.coalesce(F.max(F.when((F.col("rank") == self.k)
                                    & (F.col("target") == (t if self.per_column else -1)), F.col("dist"))),
                       F.lit(float("inf"))) for t in range(n_bounds)]).alias("bound"))
        open_end = F.array(*[F.lit(float("inf"))] * n_bounds)
        again = (routed.join(reach, "k", "left")
                 .withColumn("bound", F.coalesce("bound", open_end))
                 .withColumn("more", self._router(cells, first=False)("g", "x", "bound"))
                 .select("k", "x", "bound", F.explode(F.array_except("more", "cells")).alias("cell")))
        second = self._meet(again, placed, cells)
        both = first.drop("rank").unionByName(second.drop("rank"))
        return self._best(both)


class PairDistances:
    """Distances between the rows of a block: of all pairs by matrix products, of chosen pairs exactly, column by column."""

    def __init__(self, qx: np.ndarray, dx: np.ndarray):
        self.qx, self.dx = qx, dx
        self.q_known, self.d_known = ~np.isnan(qx), ~np.isnan(dx)
        self.whole = bool(self.q_known.all() and self.d_known.all())
        with np.errstate(all="ignore"):
            # the products take numbers around the middle, in units of their range
            values = np.where(self.d_known, dx, 0.0)
            mid = values.sum(0) / np.maximum(self.d_known.sum(0), 1)
            q, d = np.where(self.q_known, qx - mid, 0.0), np.where(self.d_known, dx - mid, 0.0)
            unit = max(np.abs(q).max(initial=0.0), np.abs(d).max(initial=0.0))
        # where squares could pass the largest double or lose digits to the smallest, all pairs are worked out exactly
        self.fine = bool(np.isfinite(unit) and (unit == 0.0 or 1e-100 < unit < 1e100))
        self.q, self.d = q, d
        if self.fine:
            self.q2, self.d2 = (q * q).sum(1), (d * d).sum(1)
            if self.whole:
                self.right = np.hstack([d, np.ones((len(d), 1)), self.d2[:, None]]).T.copy()
            else:
                self.seen = self.d_known.astype(float)
                self.right = np.hstack([self.seen, d * d, d]).T.copy()
                self.seen = self.seen.T.copy()
            self.slack = (8 * qx.shape[1] + 64) * np.finfo(float).eps * (self.q2 + self.d2.max(initial=0.0))

    def all_pairs(self, rows: slice) -> tuple[np.ndarray, np.ndarray]:
        """Distances of some queries to all donors, and by how much each query's may be off."""
        if not self.fine:
            n = len(self.qx[rows])
            at = np.indices((n, len(self.dx)))
            found = self.exact(at[0].ravel() + (rows.start or 0), at[1].ravel())
            return np.where(np.isnan(found), np.inf, found).reshape(n, -1), np.zeros(n)
        q = self.q[rows]
        if self.whole:
            p = q.shape[1]
            left = np.hstack([-2.0 / p * q, self.q2[rows][:, None] / p, np.full((len(q), 1), 1.0 / p)])
            return left @ self.right, self.slack[rows] / p
        known = self.q_known[rows].astype(float)
        out = np.hstack([q * q, known, -2.0 * q]) @ self.right
        shared = known @ self.seen
        least = np.maximum(shared.min(axis=1, initial=np.inf), 1.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            out = np.where(shared > 0, out / shared, np.inf)
        return out, self.slack[rows] / least

    def exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Distances of the pairs (i, j)."""
        dist, shared = np.zeros(len(i)), np.zeros(len(i))
        with np.errstate(all="ignore"):
            for c in range(self.qx.shape[1]):
                diff = self.qx[i, c] - self.dx[j, c]
                if self.whole:
                    dist += diff * diff
                else:
                    both = self.q_known[i, c] & self.d_known[j, c]
                    diff = np.where(both, diff, 0.0)
                    dist += diff * diff
                    shared += both
            return dist / self.qx.shape[1] if self.whole else np.where(shared > 0, dist / shared, np.inf)


def _own_pairs(qk, dk) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of equal keys."""
    at: dict = {}
    for j, key in enumerate(dk.tolist()):
        if key == key:  # NaN isn't
            at.setdefault(key, []).append(j)
    pairs = [(i, j) for i, key in enumerate(qk.tolist()) if key == key for j in at.get(key, ())]
    found = np.array(pairs, np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def _first_of_each(row: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among the first k of their row; rows are ascending."""
    if not len(row):
        return np.zeros(0, bool)
    start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    return np.arange(len(row)) - np.repeat(start, np.diff(np.r_[start, len(row)])) < k


def best_in_block(qx, qk, dx, dk, k, per_column, bound=None) -> pd.DataFrame:
    """The k best donors of each query within one block; donors come sorted by key.

    ``bound`` has a distance per query (and column, if ``per_column``) beyond which no donor is wanted.
    """
    pairs = PairDistances(qx, dx)
    own_i, own_j = _own_pairs(qk, dk)
    found = {"row": [], "target": [], "at": [], "dist": []}

    def keep(row, target, at, dist):
        for name, part in zip(found, (row, np.full(len(row), target), at, dist), strict=True):
            found[name].append(part)

    # of donors that know a column, k are wanted: some more than k are looked at first
    first = min(len(dx), k if not per_column else 4 * k + 20)
    step = max(1, PAIR_BUDGET // max(1, len(dx)))
    for a in range(0, len(qx), step):
        rows = slice(a, min(a + step, len(qx)))
        dist, slack = pairs.all_pairs(rows)
        here = (own_i >= a) & (own_i < a + step)
        dist[own_i[here] - a, own_j[here]] = np.inf
        edge = np.full(len(dist), np.inf) if bound is None else bound[rows].max(axis=1)
        unbound = np.flatnonzero(np.isinf(edge))
        if len(unbound) and first < len(dx):
            near = dist if len(unbound) == len(dist) else dist[unbound]
            edge[unbound] = np.partition(near, first - 1, axis=1)[:, first - 1] + slack[unbound]
        i, j = np.nonzero(dist <= np.minimum(edge + slack, np.finfo(float).max)[:, None])
        exact = pairs.exact(i + a, j)
        order = np.lexsort((j, exact, i))
        i, j, exact = i[order], j[order], exact[order]
        if not per_column:
            take = _first_of_each(i, k)
            if bound is not None:
                take &= exact <= bound[i + a, 0]
            keep(i[take] + a, -1, j[take], exact[take])
            continue
        for t in np.flatnonzero(~pairs.q_known[rows].all(axis=0)):
            asks = ~pairs.q_known[rows][:, t]
            able = pairs.d_known[:, t]
            at = np.flatnonzero(asks[i] & able[j])
            at = at[_first_of_each(i[at], k)]
            got = np.bincount(i[at], minlength=len(dist))
            # beyond the edge nothing was looked at
            last = np.zeros(len(dist))
            np.maximum.at(last, i[at], exact[at])
            limit = np.full(len(dist), np.inf) if bound is None else bound[rows][:, t]
            short = asks & (edge < limit) & ((got < min(k, able.sum())) | (last > edge))
            if short.any():
                at = at[~short[i[at]]]
                for r in np.flatnonzero(short):
                    near = np.flatnonzero(able & np.isfinite(dist[r]))
                    if len(near) > k:
                        cut = np.partition(dist[r][near], k - 1)[k - 1] + 2 * slack[r]
                        near = near[dist[r][near] <= cut]
                    far = pairs.exact(np.full(len(near), r + a), near)
                    top = np.lexsort((near, far))[:k]
                    top = top[far[top] <= limit[r]]
                    keep(np.full(len(top), r + a), t, near[top], far[top])
            at = at[exact[at] <= limit[i[at]]]
            keep(i[at] + a, t, j[at], exact[at])
    row, target, at, dist = (np.concatenate([np.zeros(0, float if n == "dist" else int), *found[n]]) for n in found)
    row, target, at = row.astype(int), target.astype(int), at.astype(int)
    out = {"k": qk[row].tolist(), "target": target.tolist(), "dk": dk[at].tolist(), "dist": dist.tolist(), "at": at.tolist(),
           "val": [dx[j, t] if t >= 0 else np.nan for j, t in zip(at, target, strict=True)] if per_column else [np.nan] * len(row)}
    return pd.DataFrame(out, dtype=None if out["k"] else object)
