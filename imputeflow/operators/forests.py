"""Random forests, extra trees and boosted trees of many models, grown together from binned features.

Features are binned once (``bin_edges``); a node's split is chosen from sums per feature and bin. Targets are rounded to
whole steps, so that sums are exact and don't depend on how the rows are dealt; every draw (bootstrap weight, features
tried, drawn threshold) is a hash of seed, tree and row or node. A tree is therefore the same however it was grown, and a forest of
many deep trees contains every smaller one: its first trees, cut at a depth.

A node with more than ``LOCAL_ROWS`` rows is split by scans: tasks add up sums for the open nodes of all trees, at most ``SLOT_BYTES`` of them at a
time, and pass on one small table each; the sums of a node meet in one task, which chooses its split. A node with fewer rows is moved
to one task with its rows, of bounded number, and its subtree is finished there. Models that are small from the start
begin there: their rows are sent to as many tasks as share their trees. All models of a call share the scans.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 32
LOCAL_ROWS = 1 << 17
SLOT_BYTES = 64 << 20
STEPS = 1 << 20  # a target is rounded to so many steps of its largest absolute value
# Multipliers of the splitmix64 finaliser, and the cumulative Poisson(1) probabilities of 0..5.
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
POISSON = np.array([0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582])


@dataclass(frozen=True)
class Growth:
    """How trees grow: RF (bootstrap, best cut), ET (all rows, drawn cut) or GB (best cut, each tree on what is left)."""

    kind: str
    trees: int
    depth: int
    min_leaf: int = 1
    step: float = 1.0
    seed: int = 0
    subset: int | None = None  # features tried at a node; None: all


@dataclass(frozen=True)
class ModelSpec:
    """A model of a call: column numbers of its predictors and target; ``classes`` for a class number as target."""

    model: int
    xs: tuple[int, ...]
    target: int | None = None
    classes: int = 0


def mixed(*parts) -> np.ndarray:
    """A 64-bit hash of whole numbers or arrays of them."""
    h = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for part in parts:
            h = np.asarray(part).astype(np.int64).view(np.uint64) ^ h
            h = (h ^ (h >> np.uint64(30))) * MIX1
            h = (h ^ (h >> np.uint64(27))) * MIX2
            h = h ^ (h >> np.uint64(31))
    return h


def draws(*parts) -> np.ndarray:
    return (mixed(*parts) >> np.uint64(11)) / float(1 << 53)


def weights_of(growth: Growth, tree: int, keys: np.ndarray) -> np.ndarray:
    if growth.kind != "RF":
        return np.ones(len(keys))
    return np.searchsorted(POISSON, draws(growth.seed, tree, 1, keys)).astype(float)


def bin_edges(df: DataFrame, cols) -> np.ndarray:
    """Per column, BINS - 1 cuts at about equal numbers of known values, with the least and largest value around them."""
    at = [i / BINS for i in range(1, BINS)]
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), at, 10000).alias(f"q{i}") for i, c in enumerate(cols)],
                 *[F.min(F.col(c).cast("double")).alias(f"lo{i}") for i, c in enumerate(cols)],
                 *[F.max(F.col(c).cast("double")).alias(f"hi{i}") for i, c in enumerate(cols)]).first()
    out = np.zeros((len(cols), BINS + 1))
    for i in range(len(cols)):
        if row[f"q{i}"] is not None:
            out[i] = [row[f"lo{i}"], *row[f"q{i}"], row[f"hi{i}"]]
    return out


def binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Bin of each value, column by column (p, n); a value on a cut belongs below it."""
    return np.stack([np.searchsorted(e[1:-1], x[:, f]) for f, e in enumerate(edges)]).astype(np.uint8) if len(
        edges) else np.zeros((0, len(x)), np.uint8)


# ---- one level of nodes --------------------------------------------------------------

def tried(growth: Growth, tree, heap: np.ndarray, p: int) -> np.ndarray:
    """Numbers of the features tried at each node (nodes, m), ascending."""
    m = growth.subset or p
    if m >= p:
        return np.broadcast_to(np.arange(p), (len(heap), p))
    lots = draws(growth.seed, np.asarray(tree).reshape(-1, 1), 2, heap[:, None], np.arange(p)[None, :])
    return np.sort(np.argpartition(lots, m - 1, axis=1)[:, :m], axis=1)


def tally(codes: np.ndarray, feats: np.ndarray, slot: np.ndarray, sums: list[np.ndarray]) -> np.ndarray:
    """Sums (1 + K, nodes, m, BINS) of the weights and weighted targets of the rows in each node."""
    n_nodes, m = feats.shape
    out = np.zeros((len(sums), n_nodes, m, BINS))
    plain = n_nodes > 0 and (feats == feats[0]).all()
    base = slot * BINS
    for j in range(m):
        code = codes[feats[0, j]] if plain else codes[feats[slot, j], np.arange(len(slot))]
        key = base + code
        for s, v in enumerate(sums):
            out[s, :, j] = np.bincount(key, v, n_nodes * BINS).reshape(n_nodes, BINS)
    return out


def best_cuts(hist: np.ndarray, feats: np.ndarray, total: np.ndarray, growth: Growth, tree, heap: np.ndarray,
              edges: np.ndarray):
    """For each node: the feature, cut, and sums left of it (feature -1: stays a leaf)."""
    n_nodes = len(heap)
    left = np.cumsum(hist, axis=3)[..., :-1]
    n, nl = total[0][:, None, None], left[0]
    nr = n - nl
    ok = (nl >= growth.min_leaf) & (nr >= growth.min_leaf) & (nl > 0) & (nr > 0)
    if growth.kind == "ET":  # one drawn value per feature, between the least and largest bin the node holds
        full = hist[0] > 0
        lo, hi = full.argmax(2), BINS - 1 - full[..., ::-1].argmax(2)
        u = draws(growth.seed, np.asarray(tree).reshape(-1, 1), 3, heap[:, None], feats)
        low, high = edges[feats, lo], edges[feats, hi + 1]
        value = low + u * (high - low)
        cut = (edges[feats][:, :, 1:-1] < value[..., None]).sum(2)
        cut = np.clip(np.maximum(cut, lo), 0, np.maximum(hi - 1, 0))
        only = np.zeros(ok.shape, bool)
        np.put_along_axis(only, np.minimum(cut, BINS - 2)[..., None], True, 2)
        ok &= only
    with np.errstate(divide="ignore", invalid="ignore"):
        score = sum(left[k] ** 2 / nl + (total[k][:, None, None] - left[k]) ** 2 / nr for k in range(1, len(hist)))
        here = sum(total[k] ** 2 / total[0] for k in range(1, len(hist)))
    score = np.where(ok, score, -np.inf).reshape(n_nodes, -1)
    at = score.argmax(1)
    top = score[np.arange(n_nodes), at]
    split = top > here + 1e-10 * np.maximum(np.abs(here), np.where(np.isfinite(top), np.abs(top), 0)) + 1e-9
    j, cut = at // (BINS - 1), at % (BINS - 1)
    feat = np.where(split, feats[np.arange(n_nodes), j], -1)
    return feat, cut, left.reshape(len(hist), n_nodes, -1)[:, np.arange(n_nodes), at]


def grow(codes: np.ndarray, q: np.ndarray, w: np.ndarray, edges: np.ndarray, growth: Growth, tree: int,
         root: int = 1) -> tuple[list, np.ndarray]:
    """Node records (heap, feature, cut, values) of the subtree below ``root``, and each row's place among them."""
    level, p = int(root).bit_length() - 1, len(codes)
    leaf = np.zeros(q.shape[1], np.int64)
    rows = np.flatnonzero(w > 0) if (w == 0).any() else np.arange(len(w))
    codes = codes[:, rows]
    sums = [w[rows], *(w * q)[:, rows]]
    slot, heap, hist, before, records = np.zeros(len(rows), np.intp), np.array([root], np.int64), None, 0, []
    while len(heap):
        total = np.stack([np.bincount(slot, v, len(heap)) for v in sums])
        value = (total[1:] / np.maximum(total[0], 1)).T
        leaf[rows] = before + slot
        if level == growth.depth or not len(rows):
            records.append((heap, np.full(len(heap), -1), np.zeros(len(heap), int), value))
            break
        feats = tried(growth, tree, heap, p)
        if hist is None:
            hist = tally(codes, feats, slot, sums)
        feat, cut, left = best_cuts(hist, feats, total, growth, tree, heap, edges)
        records.append((heap, feat, cut, value))
        split = feat >= 0
        if not split.any():
            break
        number = np.cumsum(split) - 1
        stays = split[slot]
        if not stays.all():
            at = np.flatnonzero(stays)
            rows, slot, codes, sums = rows[at], slot[at], codes.take(at, axis=1), [v[at] for v in sums]
        right = codes.ravel().take(feat[slot] * len(slot) + np.arange(len(slot))) > cut[slot]
        pair = number[slot]
        before += len(heap)
        parents, heap = hist[:, split], np.repeat(2 * heap[split], 2)
        heap[1::2] += 1
        slot, level, hist = 2 * pair + right, level + 1, None
        if not growth.subset and level < growth.depth:  # sums of the smaller child; the other one has the rest
            few_right = (total[0][split] - left[0][split]) < left[0][split]
            small = np.flatnonzero(right == few_right[pair])
            part = tally(codes.take(small, axis=1), np.broadcast_to(np.arange(p), (len(few_right), p)), pair[small],
                         [v[small] for v in sums])
            hist = np.empty((len(sums), len(heap), p, BINS))
            order = 2 * np.arange(len(few_right)) + few_right
            hist[:, order] = part
            hist[:, order ^ 1] = parents - part
    return records, leaf


# ---- trees that are done -------------------------------------------------------------

class Forest:
    """The trees of a model as flat arrays: feature (-1: leaf), cut, left child (the right one follows it), values."""

    def __init__(self, spec: ModelSpec, growth: Growth, edges: np.ndarray, trees: list, base: float = 0.0):
        self.spec, self.growth, self.edges, self.base = spec, growth, edges[list(spec.xs)], base
        self.roots, parts, at = [], [], 0
        trees.reverse()  # a tree is forgotten once it is here
        while trees:
            heap, feat, cut, value = trees.pop()
            order = np.argsort(heap)
            heap, feat = heap[order], feat[order]
            left = np.searchsorted(heap, 2 * heap).astype(np.int32) + at
            parts.append((feat.astype(np.int16), cut[order].astype(np.uint8), left, value[order]))
            self.roots.append(at)
            at += len(heap)
        self.feat, self.cut, self.left, self.value = (np.concatenate([p[i] for p in parts]) for i in range(4))
        self.roots = np.array(self.roots)

    def _walk(self, codes: np.ndarray, roots: np.ndarray, depth: int):
        """Places of the rows in each tree (trees, rows), after every step."""
        node = np.repeat(roots[:, None], codes.shape[1], axis=1)
        rows = np.arange(codes.shape[1])[None, :]
        yield node
        for _ in range(depth):
            feat = self.feat[node]
            inner = feat >= 0
            if not inner.any():
                break
            right = codes[np.maximum(feat, 0), rows] > self.cut[node]
            node = np.where(inner, self.left[node] + right, node)
            yield node

    def predict(self, x: np.ndarray, trees: int | None = None, depth: int | None = None) -> np.ndarray:
        """Mean of the first trees (the sum of the steps for GB), cut at a depth: (rows, K)."""
        codes = binned(x, self.edges)
        roots = self.roots[:trees]
        out = np.zeros((len(x), self.value.shape[1]))
        for a in range(0, len(roots), 64):
            for node in self._walk(codes, roots[a:a + 64], depth or self.growth.depth):
                pass
            out += self.value[node].sum(0)
        return self.base + self.growth.step * out if self.growth.kind == "GB" else out / len(roots)

    def shares(self, x: np.ndarray, members: int) -> np.ndarray:
        """Predictions of ``members`` equal shares of the trees (rows, members); boosted trees have no shares that differ."""
        if members == 1 or self.growth.kind == "GB":
            return np.repeat(self.predict(x), members, axis=1)
        codes, size = binned(x, self.edges), len(self.roots) // members
        out = np.zeros((len(x), members))
        for b in range(members):
            for a in range(b * size, (b + 1) * size, 64):
                for node in self._walk(codes, self.roots[a:min(a + 64, (b + 1) * size)], self.growth.depth):
                    pass
                out[:, b] += self.value[node][..., 0].sum(0)
        return out / size

    def votes(self, x: np.ndarray, trees, depths) -> np.ndarray:
        """Mean values for each (number of trees, depth) of a grid: (trees, depths, rows, K), in one walk per tree."""
        codes = binned(x, self.edges)
        out = np.zeros((len(trees), len(depths), len(x), self.value.shape[1]))
        done = np.zeros((len(depths), len(x), self.value.shape[1]))
        for t, root in enumerate(self.roots, 1):
            steps = list(self._walk(codes, np.array([root]), max(depths)))
            for d, depth in enumerate(depths):
                done[d] += self.value[steps[min(depth, len(steps) - 1)][0]]
            for i, size in enumerate(trees):
                if size == t:
                    out[i] = done / t
        return out


def _blob(records: list) -> tuple[bytes, bytes, bytes, bytes]:
    heap, feat, cut, value = (np.concatenate([r[i] for r in records]) for i in range(4))
    return (heap.astype(np.int64).tobytes(), feat.astype(np.int16).tobytes(), cut.astype(np.uint8).tobytes(),
            value.astype(np.float64).tobytes())


def _unblob(row, k: int):
    return (np.frombuffer(row.heap, np.int64), np.frombuffer(row.feat, np.int16), np.frombuffer(row.cut, np.uint8),
            np.frombuffer(row.value, np.float64).reshape(-1, k))


# ---- growing -------------------------------------------------------------------------

BASE = -1  # number of the record that holds where boosting starts
TREE_SCHEMA = "model int, tree int, heap binary, feat binary, cut binary, value binary"


def _arrays(batch: pa.RecordBatch):
    """keys, x (rows, p) and class numbers of an Arrow batch."""
    lists = batch.column("x")
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
    c = batch.column("c").to_numpy(zero_copy_only=False)
    return batch.column("k").to_numpy(zero_copy_only=False), x, c


def targets(spec: ModelSpec, x: np.ndarray, c: np.ndarray, scale: float) -> np.ndarray:
    """Rounded targets (K, rows): steps of a number, or 0 / 1 per class."""
    if spec.classes:
        return (c[None, :] == np.arange(spec.classes)[:, None]).astype(float)
    return np.rint(x[:, spec.target] * scale)[None, :]


def _scaled(records: list, scale: float) -> list:
    return [(h, f, c, v / scale) for h, f, c, v in records]


def _grow_local(df: DataFrame, specs: dict, scales: dict, growth: Growth, edges: np.ndarray) -> list:
    """Trees of models with few enough rows: each task grows some trees of one model from all its rows."""
    spark = df.sparkSession
    share = max(1, math.ceil(2 * spark.sparkContext.defaultParallelism / len(specs)))
    chunks = 1 if growth.kind == "GB" else min(growth.trees, share)
    order = sorted(specs)

    def pack(batches):
        """The rows of a batch that belong to a model, as one block of keys, codes and rounded targets."""
        for batch in batches:
            k, x, c = _arrays(batch)
            member = batch.column("models")
            owner = np.repeat(np.arange(batch.num_rows), np.diff(member.offsets.to_numpy()))
            number = member.flatten().to_numpy(zero_copy_only=False)
            found = []
            for place, m in enumerate(order):
                at = owner[number == m]
                if len(at):
                    own = edges[list(specs[m].xs)]
                    found.append((place * chunks, len(at), k[at].tobytes(), binned(x[at][:, list(specs[m].xs)], own).tobytes(),
                                  targets(specs[m], x[at], c[at], scales[m]).tobytes()))
            yield pa.RecordBatch.from_pydict(dict(zip(["first", "n", "k", "codes", "q"], map(list, zip(*found)), strict=True))
                                             if found else {c: [] for c in ("first", "n", "k", "codes", "q")},
                                             schema=pa.schema([("first", pa.int32()), ("n", pa.int32())] + [
                                                 (b, pa.binary()) for b in ("k", "codes", "q")]))

    blocks = df.select("k", "x", "c", "models").mapInArrow(pack, "first int, n int, k binary, codes binary, q binary")
    rows = blocks.withColumn("g", F.explode(F.sequence(F.col("first"), F.col("first") + chunks - 1)))

    def run(batches):
        held = {}
        for batch in batches:
            for one, n, k, codes, q in zip(*[batch.column(c).to_pylist() for c in ("g", "n", "k", "codes", "q")], strict=True):
                held.setdefault(one, []).append((np.frombuffer(k, np.int64), np.frombuffer(codes, np.uint8).reshape(-1, n),
                                                 np.frombuffer(q).reshape(-1, n)))
        for one, parts in held.items():
            k, codes, q = (np.concatenate([p[i] for p in parts], axis=-1) for i in range(3))
            spec, scale = specs[order[one // chunks]], scales[order[one // chunks]]
            own = edges[list(spec.xs)]
            numbers = range(growth.trees) if growth.kind == "GB" else range(one % chunks, growth.trees, chunks)
            found = []
            if growth.kind == "GB":
                so_far = np.full(q.shape[1], np.rint(q.sum() / q.shape[1]))
                found.append((spec.model, BASE, b"", b"", b"", np.array([so_far[0] / scale]).tobytes()))
            for tree in numbers:
                if growth.kind == "GB":
                    records, leaf = grow(codes, np.rint(q - so_far), np.ones(len(k)), own, growth, tree)
                    so_far = so_far + growth.step * np.concatenate([r[3] for r in records])[leaf, 0]
                else:
                    records, _ = grow(codes, q, weights_of(growth, tree, k), own, growth, tree)
                found.append((spec.model, tree, *_blob(_scaled(records, scale))))
            yield pa.RecordBatch.from_pydict(dict(zip(
                ["model", "tree", "heap", "feat", "cut", "value"], map(list, zip(*found)), strict=True)),
                schema=pa.schema([("model", pa.int32()), ("tree", pa.int32())] + [
                    (b, pa.binary()) for b in ("heap", "feat", "cut", "value")]))

    return rows.repartitionById(chunks * len(order), "g").mapInArrow(run, TREE_SCHEMA).collect()


def _grow_large(df: DataFrame, spec: ModelSpec, scale: float, growth: Growth, edges: np.ndarray, numbers: list[int],
                local_rows: int, prior: Forest | None = None, base: float = 0.0) -> dict:
    """Records of some trees of a model with many rows, level by level; small nodes are finished in tasks of their own."""
    own, width = edges[list(spec.xs)], spec.classes or 1
    rows = df.where(F.array_contains("models", spec.model)).select("k", "x", "c")
    records: dict[int, list] = {t: [] for t in numbers}
    cuts: dict[int, dict] = {t: {} for t in numbers}
    open_nodes, small = [(t, 1) for t in numbers], []
    tried_m = growth.subset or len(spec.xs)
    slots = max(1, SLOT_BYTES // (tried_m * BINS * 8 * (1 + width)))

    def prepared(batch):
        k, x, c = _arrays(batch)
        q = targets(spec, x, c, scale)
        if growth.kind == "GB":
            pred = np.full(len(k), base) if prior is None else prior.predict(x[:, list(spec.xs)])[:, 0]
            q = np.rint(q - pred * scale)
        return k, x, c, binned(x[:, list(spec.xs)], own), q

    def places(codes, tree, known):
        """Heap number of each row's node in the tree so far."""
        heap = np.ones(codes.shape[1], np.int64)
        if known:
            ids = np.array(sorted(known))
            feat, cut = np.array([known[i] for i in ids]).T
            while True:
                at = np.minimum(np.searchsorted(ids, heap), len(ids) - 1)
                inner = ids[at] == heap
                if not inner.any():
                    break
                right = codes[feat[at], np.arange(len(heap))] > cut[at]
                heap = np.where(inner, 2 * heap + right, heap)
        return heap

    while open_nodes:
        nxt = []
        for first in range(0, len(open_nodes), slots):
            now = open_nodes[first:first + slots]
            by_tree: dict[int, list] = {}
            for s, (t, h) in enumerate(now):
                by_tree.setdefault(t, []).append((h, s))
            known = {t: dict(cuts[t]) for t in by_tree}

            def partial(batches):
                acc = np.zeros((1 + width, len(now), tried_m, BINS))
                for batch in batches:
                    k, _, _, codes, q = prepared(batch)
                    for t, nodes in by_tree.items():
                        heap = places(codes, t, known[t])
                        ids = np.array([h for h, _ in nodes])
                        at = np.minimum(np.searchsorted(ids, heap), len(ids) - 1)
                        w = weights_of(growth, t, k)
                        here = (ids[at] == heap) & (w > 0)
                        feats = tried(growth, t, ids, len(own))
                        got = tally(codes[:, here], feats, at[here], [w[here], *(w * q)[:, here]])
                        acc[:, [s for _, s in nodes]] += got
                full = np.flatnonzero(acc[0].any(axis=(1, 2)))
                yield pa.RecordBatch.from_pydict({"slot": pa.array(full, pa.int32()), "sums": pa.array(
                    [acc[:, s].tobytes() for s in full], pa.binary())})

            def choose(key, pdf):
                t, h = now[key[0]]
                hist = sum(np.frombuffer(b).reshape(1 + width, 1, tried_m, BINS) for b in pdf["sums"])
                total = hist[:, :, 0].sum(2)
                heap = np.array([h])
                feats = tried(growth, t, heap, len(own))
                feat, cut, left = best_cuts(hist, feats, total, growth, t, heap, own)
                return pd.DataFrame({"slot": [key[0]], "feat": feat, "cut": cut, "total": [total[:, 0].tolist()],
                                     "left": [left[:, 0].tolist()]})

            got = rows.mapInArrow(partial, "slot int, sums binary").groupBy("slot").applyInPandas(
                choose, "slot int, feat int, cut int, total array<double>, left array<double>").collect()
            for r in sorted(got, key=lambda r: r.slot):
                t, h = now[r.slot]
                total, left = np.array(r.total), np.array(r.left)
                level = h.bit_length() - 1
                if level == 0 and total[0] <= local_rows:
                    small.append((t, h))
                    continue
                feat = r.feat if level < growth.depth else -1
                records[t].append((np.array([h]), np.array([feat]), np.array([r.cut if feat >= 0 else 0]),
                                   (total[1:] / total[0])[None, :]))
                if feat < 0:
                    continue
                cuts[t][h] = (feat, r.cut)
                for child, part in ((2 * h, left), (2 * h + 1, total - left)):
                    if level + 1 == growth.depth:
                        records[t].append((np.array([child]), np.array([-1]), np.array([0]), (part[1:] / part[0])[None, :]))
                    elif part[0] <= local_rows:
                        small.append((t, child))
                    else:
                        nxt.append((t, child))
        open_nodes = nxt
    if small:
        wanted: dict[int, np.ndarray] = {}
        for t in {t for t, _ in small}:
            wanted[t] = np.array(sorted(h for u, h in small if u == t))

        def send(batches):
            """The rows of a batch that sit in a small node, as one block per node."""
            for batch in batches:
                k, _, _, codes, q = prepared(batch)
                found = []
                for t, ids in wanted.items():
                    heap = places(codes, t, cuts[t])
                    at = np.minimum(np.searchsorted(ids, heap), len(ids) - 1)
                    w = weights_of(growth, t, k)
                    here = np.flatnonzero((ids[at] == heap) & (w > 0))
                    here = here[np.argsort(at[here], kind="stable")]
                    stops = np.flatnonzero(np.diff(at[here])) + 1
                    for part in np.split(here, stops) if len(here) else []:
                        found.append((t, int(heap[part[0]]), len(part), w[part].tobytes(), codes.take(part, axis=1).tobytes(),
                                      q.take(part, axis=1).tobytes()))
                yield pa.RecordBatch.from_pylist([dict(zip(("tree", "heap", "n", "w", "codes", "q"), f, strict=True))
                                                  for f in found], schema=block)

        block = pa.schema([("tree", pa.int32()), ("heap", pa.int64()), ("n", pa.int32())] + [
            (c, pa.binary()) for c in ("w", "codes", "q")])

        def finish(key, pdf):
            codes = np.concatenate([np.frombuffer(b, np.uint8).reshape(-1, n) for b, n in zip(pdf["codes"], pdf["n"])], 1)
            q = np.concatenate([np.frombuffer(b).reshape(-1, n) for b, n in zip(pdf["q"], pdf["n"])], 1)
            w = np.concatenate([np.frombuffer(b) for b in pdf["w"]])
            got, _ = grow(codes, q, w, own, growth, int(key[0]), int(key[1]))
            return pd.DataFrame([(spec.model, key[0], *_blob(got))],
                                columns=["model", "tree", "heap", "feat", "cut", "value"])

        for r in rows.mapInArrow(send, "tree int, heap long, n int, w binary, codes binary, q binary").groupBy(
                "tree", "heap").applyInPandas(finish, TREE_SCHEMA).collect():
            records[r.tree].append(_unblob(r, width))
    return {t: tuple(np.concatenate([r[i] for r in got]) for i in range(4)) for t, got in records.items()}


def _boost_large(df, spec, scale, growth, edges, local_rows) -> Forest:
    base = df.where(F.array_contains("models", spec.model)).agg(
        F.sum(F.rint(F.element_at("x", spec.target + 1) * scale)), F.count("*")).first()
    base = float(np.rint(base[0] / base[1])) / scale
    trees, prior = [], None
    for t in range(growth.trees):
        heap, feat, cut, value = _grow_large(df, spec, scale, growth, edges, [t], local_rows, prior, base)[t]
        trees.append((heap, feat, cut, value / scale))
        prior = Forest(spec, growth, edges, [*trees], base)
    return prior


def model_sizes(df: DataFrame, specs: list[ModelSpec]) -> dict[int, tuple[int, float]]:
    """Rows and largest absolute target of each model, in one scan."""
    at = F.array(*[F.lit((s.target if s.target is not None else 0) + 1) for s in specs])
    names = F.array(*[F.lit(s.model) for s in specs])
    rows = df.select("x", F.explode("models").alias("m"))
    y = F.element_at("x", F.element_at(at, F.array_position(names, F.col("m")).cast("int")))
    return {r.m: (r.n, r.most) for r in rows.groupBy("m").agg(
        F.count("*").alias("n"), F.max(F.abs(y)).alias("most")).collect()}


def fit_models(df: DataFrame, specs: list[ModelSpec], growth: Growth, edges: np.ndarray, sizes: dict | None = None,
               local_rows: int = LOCAL_ROWS) -> dict[int, Forest]:
    """Forests of all models that have rows. ``df`` has k (long), x (array of doubles), c (class number), models (array of ints)."""
    sizes = sizes or model_sizes(df, specs)
    specs = [s for s in specs if s.model in sizes and sizes[s.model][0]]
    scales = {s.model: 1.0 if s.classes else STEPS / (sizes[s.model][1] or 1.0) for s in specs}
    out = {}
    local = {s.model: s for s in specs if sizes[s.model][0] <= local_rows}
    if local:
        found: dict[int, dict] = {}
        for r in _grow_local(df, local, scales, growth, edges):
            found.setdefault(r.model, {})[r.tree] = (float(np.frombuffer(r.value)[0]) if r.tree == BASE
                                                     else _unblob(r, local[r.model].classes or 1))
        for m in list(found):
            trees = found.pop(m)
            out[m] = Forest(local[m], growth, edges, [trees.pop(t) for t in range(growth.trees)], trees.get(BASE, 0.0))
    for s in specs:
        if s.model in local:
            continue
        if growth.kind == "GB":
            out[s.model] = _boost_large(df, s, scales[s.model], growth, edges, local_rows)
        else:
            trees = _grow_large(df, s, scales[s.model], growth, edges, list(range(growth.trees)), local_rows)
            done = [(*trees[t][:3], trees[t][3] / scales[s.model]) for t in range(growth.trees)]
            out[s.model] = Forest(s, growth, edges, done)
    return out



# ---- frames --------------------------------------------------------------------------

def forest_rows(df: DataFrame, cols, key=None, models=None, label=None) -> DataFrame:
    """The input of ``fit_models``: a hash of the key (or else of the row), the columns as an array, class number, models."""
    return df.select(F.xxhash64(*([key] if key else cols)).alias("k"),
                     F.array(*[F.col(c).cast("double") for c in cols]).alias("x"),
                     (F.col(label).cast("int") if label else F.lit(0)).alias("c"),
                     (F.array(F.lit(0)) if models is None else models).alias("models"))


def predicted(spark, forests: dict, cols, number, where, members: int = 1):
    """A column of structs (mean, std): what the members of the forest ``forests[number]`` say of the rows in ``where``.

    A member is an equal share of a forest's trees. Other rows are null and are not looked at.
    """
    shared = spark.sparkContext.broadcast(forests)

    @F.pandas_udf("mean double, std double")
    def vote(x: pd.Series, number: pd.Series) -> pd.DataFrame:
        out = np.full((len(x), 2), np.nan)
        asked = x.notna().to_numpy()
        numbers = number.to_numpy()
        for m, forest in shared.value.items():
            at = np.flatnonzero(asked & (numbers == m))
            if len(at):
                said = forest.shares(np.asarray(x.iloc[at].tolist(), float)[:, list(forest.spec.xs)], members)
                out[at, 0] = said.mean(1)
                out[at, 1] = said.std(1, ddof=1) if members > 1 and forest.growth.kind != "GB" else 0.0
        return pd.DataFrame(out, columns=["mean", "std"])

    return vote(F.when(where, F.array(*[F.col(c).cast("double") for c in cols])), number)
