"""Most similar vectors for every vector: hierarchical k-means trees, best bin first.

A tree is fitted on a bounded sample of directions and every vector is put into
the leaf at the end of its nearest centres. A search walks the tree from the
root through a priority queue: the node is taken out whose path has left the
nearest centres by the smallest gaps, a leaf is opened, an inner node puts its
children in. Below the upper levels, which a batch of queries is compared with at
once, only what is taken out is compared, so a query costs its visits times the
depth and not the size of the tree; the queues of a batch of queries run side by
side as arrays. How many leaves a query opens is not guessed: for a
bounded set of calibration queries the true neighbours are found by brute force
against all vectors, and the visits are widened until the wanted share of them
lies in an opened leaf. Where that takes many leaves, further trees from other
starts are added: a pair that one tree parts early is close together in another.
Where all vectors are queries, a pair is found from either end, which finds
more than calibrated.

Leaves grow in number with the collection up to ``LEAVES``. Up to 64 leaves in
a row are a cell, a task's work: a vector travels once to each cell in which it
opens leaves, with a bit a leaf. Where vectors crowd, a cell is cut into blocks
and its queries into parts. Each keeps ``k`` a query. Trees are searched one
after another, so the shuffled vectors of one lie on disk at a time.

Vectors of the same direction form one class, so copies neither crowd a leaf
nor each other's lists. Vectors are read anew from the table by every step
instead of being written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.plans.lookup import bucket_of
from gridloom.plans.materialize import materialize, sweep

#: Vectors the tree is fitted on: the first number, or so many a leaf up to the second.
FIT_SAMPLE = 32768
FIT_LEAF = 8
FIT_MOST = 262_144
#: Vectors a leaf should hold, and leaves at most (with 64 elements 17 MB of centres).
LEAF = 256
LEAVES = 65_536
BRANCH = 16
#: Vectors of a leaf and queries that visit it, that meet in one group.
BLOCK_ROWS = 4096
PART_ROWS = 32768
#: Queries that calibrate the visits at most.
CALIBRATE = 1024
RECALL = 0.97
#: Nodes of the upper levels, that a batch of queries is compared with in one product.
UPPER = 1024
#: Queries that meet a leaf at once.
BLOCK = 1024
#: Leaves of a cell at most, a bit each of a bigint.
CELL = 64
#: Trees at most; what one more costs, in opened leaves a query, for every vector has to travel.
TREES = 4
TRAVEL = 4
#: Items that are broadcast at most.
FEW_ITEMS = 1 << 20


def _matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """Rows x ``width``: lists that end early and elements that are no finite number as 0."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    lens = lists.value_lengths().to_numpy(zero_copy_only=False)
    x = np.zeros((len(lists), width))
    x[np.arange(width) < lens[:, None]] = flat
    x[~np.isfinite(x)] = 0
    return x


def _units(src: DataFrame, width: int, kind: str) -> DataFrame:
    """(item, v) of (item, vals): unit vectors as little-endian float64 or float32 bytes, or ``print``: 16 bytes by which a direction is told at 12 digits."""

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vals"), width)
            top = np.abs(x).max(1, initial=0)
            x = x[top > 0] / top[top > 0][:, None]
            x /= np.sqrt((x * x).sum(1))[:, None]
            if kind == "print":
                rounded = memoryview((np.round(x, 12) + 0.0).tobytes())
                v = pa.array([hashlib.blake2b(rounded[at : at + width * 8], digest_size=16).digest() for at in range(0, len(rounded), max(width * 8, 1))], pa.binary())
            else:
                v = _binary(x.astype(kind))
            yield pa.RecordBatch.from_arrays([batch.column("item").filter(pa.array(top > 0)), v], ["item", "v"])

    return src.select("item", "vals").mapInArrow(unit, "item bigint, v binary")


def _binary(x: np.ndarray) -> pa.Array:
    """A row's bytes each."""
    x = np.ascontiguousarray(x)
    size = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(0, size * len(x) + 1, max(size, 1), dtype=np.int32)[: len(x) + 1]), pa.py_buffer(x)])


def _vectors(col: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of float32 out of their bytes."""
    parts = col.chunks if isinstance(col, pa.ChunkedArray) else [col]
    rows = []
    for part in parts:
        if len(part):
            first = np.frombuffer(part.buffers()[1], np.int32, 1, part.offset * 4)[0]
            rows.append(np.frombuffer(part.buffers()[2], np.float32, len(part) * width, first).reshape(-1, width))
    return np.concatenate(rows) if len(rows) > 1 else rows[0] if rows else np.zeros((0, width), np.float32)


class Tree:
    """Centres level by level: ``levels[d]`` holds a row a node, ``parent[d]`` its parent's row on the level above; a node's children are consecutive rows."""

    def __init__(self, levels: list[np.ndarray], parent: list[np.ndarray]):
        self.levels, self.parent = levels, parent
        self.centres = np.concatenate(levels)
        starts = np.cumsum([0] + [len(x) for x in levels])
        self.leaf0 = int(starts[-2])
        self.first = np.full(len(self.centres), -1)
        self.kids = np.zeros(len(self.centres), dtype=int)
        for d, up in enumerate(parent[1:]):
            own, at, n = np.unique(up, return_index=True, return_counts=True)
            self.first[starts[d] + own] = starts[d + 1] + at
            self.kids[starts[d] + own] = n
        self.roots = len(levels[0])
        # an only child leaves no gap, so a walk by gaps passes on to where a path forks or ends
        self.deep = np.arange(len(self.centres))
        for at in range(len(self.centres) - 1, -1, -1):
            if self.kids[at] == 1:
                self.deep[at] = self.deep[self.first[at]]
        self.upper = int(max(x for x in starts if x <= max(UPPER, self.roots)))

    @property
    def leaves(self) -> int:
        return len(self.levels[-1])

    def priority(self, q: np.ndarray, gaps: bool = False) -> np.ndarray:
        """Queries x leaves: the order of which ``walk`` opens leaves; for calibration, and where most leaves are opened."""
        path = None
        for centres, up in zip(self.levels, self.parent):
            sims = q @ centres.T
            if gaps:
                start = np.unique(up, return_index=True)[1]
                sims = -((np.maximum.reduceat(sims, start, axis=1)[:, up] - sims) ** 2)
                path = sims if path is None else path[:, up] + sims
            else:
                path = sims if path is None else np.minimum(sims, path[:, up])
        return path

    def walk(self, q: np.ndarray, visits: int, gaps: bool = False) -> np.ndarray:
        """Queries x ``visits``: the leaves each query opens, best bin first; -1 where there are no more.

        A bin is as good as the smallest similarity on its path. That leaves
        all leaves below a node of small similarity alike, so the search goes by
        ``gaps``: the sum of squares of how much less similar each node of the
        path is than the most similar of its siblings.
        """
        n, rows = len(q), np.arange(len(q))
        out, got = np.full((n, visits), -1), np.zeros(n, dtype=int)
        keys = np.full((n, self.roots + 4 * BRANCH), -np.inf, dtype=np.float32)
        node = np.zeros(keys.shape, dtype=np.int32)
        deep = self.deep if gaps else np.arange(len(self.centres))
        upper = q @ self.centres[: self.upper].T
        sims = upper[:, : self.roots]
        keys[:, : self.roots], node[:, : self.roots] = -((sims.max(1, keepdims=True) - sims) ** 2) if gaps else sims, deep[: self.roots]
        top = self.roots
        while len(rows):
            at = (keys[:, :top] if len(rows) == n else keys[rows, :top]).argmax(1)
            best, taken = keys[rows, at], node[rows, at]
            keys[rows, at] = -np.inf
            leaf = (taken >= self.leaf0) & (best > -np.inf)
            r = rows[leaf]
            out[r, got[r]] = taken[leaf] - self.leaf0
            got[r] += 1
            inner = (taken < self.leaf0) & (best > -np.inf)
            if inner.any():
                if top + BRANCH > keys.shape[1]:
                    keys = np.concatenate([keys, np.full(keys.shape, -np.inf, dtype=np.float32)], 1)
                    node = np.concatenate([node, np.zeros_like(node)], 1)
                r, p = rows[inner], taken[inner]
                kid = np.minimum(self.first[p][:, None] + np.arange(BRANCH), len(self.centres) - 1)
                low = kid[:, 0] >= self.upper
                sims = upper[r[:, None], np.minimum(kid, self.upper - 1)]
                if low.any():
                    sims[low] = np.matmul(self.centres[kid[low]], q[r[low]][:, :, None])[:, :, 0]
                sims[np.arange(BRANCH) >= self.kids[p][:, None]] = -np.inf
                up = best[inner][:, None]
                sims = up - (sims.max(1, keepdims=True) - sims) ** 2 if gaps else np.minimum(sims, up)
                keys[r, top : top + BRANCH], node[r, top : top + BRANCH] = sims, deep[kid]
                top += BRANCH
            rows = rows[(best > -np.inf) & (got[rows] < visits)]
        return out

    def opened(self, q: np.ndarray, visits: int) -> np.ndarray:
        """Queries x ``visits``: the leaves that a search opens, a vector's own first; most leaves of a tree are told without a walk."""
        visits = min(visits, self.leaves)
        if visits * BRANCH < self.leaves:
            return self.walk(q, visits, gaps=True)
        out = np.empty((len(q), visits), dtype=int)
        for at in range(0, len(q), 64):
            far = -self.priority(q[at : at + 64], gaps=True)
            some = np.argpartition(far, visits - 1, axis=1)[:, :visits] if visits < self.leaves else np.broadcast_to(np.arange(visits), far.shape)
            out[at : at + 64] = np.take_along_axis(some, np.take_along_axis(far, some, 1).argsort(1, kind="stable"), 1)
        return out


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means; returns non-empty unit centres and each row's centre."""
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        at = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        norm = np.linalg.norm(sums, axis=1)
        c = sums[norm > 1e-9] / norm[norm > 1e-9][:, None]
    return c, (x @ c.T).argmax(1)


def fit_tree(x: np.ndarray, leaves: int, seed: int = 5) -> Tree:
    """A tree over sample rows ``x`` with about ``leaves`` leaves, split by share of the sample so that dense regions get more."""
    rng = np.random.default_rng(seed)
    target = max(2.0, len(x) / max(leaves, 1))
    nodes, levels, parent = [np.arange(len(x))], [], []
    while True:
        centres, up, nxt, split = [], [], [], False
        for p, rows in enumerate(nodes):
            k = min(BRANCH, round(len(rows) / target))
            if k < 2 or len(rows) < 4:
                m = x[rows].mean(0) if len(rows) else x[0]
                centres.append(m / max(np.linalg.norm(m), 1e-9))
                up.append(p)
                nxt.append(rows)
                continue
            c, at = _kmeans(x[rows], k, rng)
            split |= len(c) > 1
            for j in range(len(c)):
                centres.append(c[j])
                up.append(p)
                nxt.append(rows[at == j])
        if levels and not split:
            return Tree(levels, parent)
        levels.append(np.array(centres, dtype=np.float32))
        parent.append(np.array(up))
        nodes = nxt
        if not split:
            return Tree(levels, parent)


def _best(sims: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's ``k`` largest from ``least`` on, all ties at the edge included."""
    bar = np.full(len(sims), least)
    if sims.shape[1] > k:
        bar = np.maximum(np.partition(sims, sims.shape[1] - k, axis=1)[:, -k] - 1e-6, least)
    return np.nonzero(sims >= bar[:, None])


def _near(s: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """``_best``, without sorting where hardly anything is as similar as ``least``."""
    near = s >= least
    if np.count_nonzero(near) <= near.size >> 6:
        r, j = np.divmod(np.flatnonzero(near.ravel()), max(s.shape[1], 1))
        if np.bincount(r, minlength=1).max(initial=0) <= k:
            return r, j
    return _best(s, k, least)


class _Calibration:
    """True neighbours of the calibration queries, and how many leaves of each tree lead to them."""

    def __init__(self, classes: Callable, qid: np.ndarray, qx: np.ndarray, k: int, least: float):
        order = np.argsort(qid)
        self.qx = qx[order]
        bq, width = classes().sparkSession.sparkContext.broadcast((qid[order], self.qx)), qx.shape[1]

        def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, x32 = bq.value
            q, sim, v = np.zeros(0, int), np.zeros(0, np.float32), np.zeros((0, width), np.float32)
            bar = np.full(len(ids), least, np.float32)  # what is below is not among the k best of this task's vectors
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(at, BLOCK)
                    x, c = _vectors(part.column("v"), width), part.column("c").to_numpy()
                    s = x32 @ x.T
                    own = np.minimum(np.searchsorted(ids, c), len(ids) - 1)
                    same = np.flatnonzero(ids[own] == c)
                    s[own[same], same] = -3
                    near = s >= bar[:, None]
                    r, j = np.divmod(np.flatnonzero(near.ravel()), near.shape[1]) if np.count_nonzero(near) <= near.size >> 4 else _best(s, k, least)
                    if len(r):
                        q, sim, v = np.concatenate([q, r]), np.concatenate([sim, s[r, j]]), np.concatenate([v, x[j]])
                        by = np.lexsort((-sim, q))
                        nth = np.arange(len(by)) - np.searchsorted(q[by], q[by])
                        full = by[nth == k - 1]
                        bar[q[full]] = np.maximum(bar[q[full]], sim[full])
                        by = by[nth < k]
                        q, sim, v = q[by], sim[by], v[by]
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(sim.astype(float)), _binary(v)], ["q", "sim", "v"])

        top = W.partitionBy("q").orderBy(F.desc("sim"))
        near = classes().mapInArrow(brute, "q int, sim double, v binary").withColumn("r", F.row_number().over(top)).where(F.col("r") <= k).select("q", "v").toPandas()  # at most k a calibration query
        self.q = near["q"].to_numpy()
        self.x = np.frombuffer(b"".join(near["v"]), np.float32).reshape(len(near), width)

    def __len__(self) -> int:
        return len(self.q)

    def need(self, tree: Tree) -> np.ndarray:
        """How many leaves each query must open to reach the leaf of the neighbour beside it."""
        out = np.zeros(len(self), int)
        for lo in range(0, len(self), 64):
            pr = tree.priority(self.qx[self.q[lo : lo + 64]], gaps=True)
            home = tree.walk(self.x[lo : lo + 64], 1, gaps=True)
            out[lo : lo + 64] = (pr >= np.take_along_axis(pr, home, 1)).sum(1)
        return out


def neighbours(classes: Callable[..., DataFrame], n: int, asked: int, k: int, least: float = -2.0, recall: float = RECALL) -> tuple[DataFrame, dict]:
    """((q, c, sim), report): each asked class's ``k`` most similar other classes with ``sim >= least``, and farther ones.

    ``classes(where)``: (c, v float32 bytes, ask), of the classes whose number
    fulfils a condition; ``n`` in all, ``asked`` of them queries. Similarities are
    those of the vectors in single precision, summed in double. ``report``:
    leaves, visits of a tree, trees, the recall on the calibration queries' true
    neighbours (None if it was not measured, 1 if all leaves are opened) and the
    number of these neighbours.
    """
    spark = classes().sparkSession
    if n < 2 or not asked:
        return spark.createDataFrame([], "q bigint, c bigint, sim double"), {"leaves": n, "visits": n, "trees": 1, "recall": 1.0, "known": 0}

    def drawn(where: Callable[[Column], Column] | None, most: int, *need: str) -> tuple[np.ndarray, np.ndarray]:
        rows = classes(where).where(" AND ".join(["true", *need])).select("c", "v").limit(most).toPandas()
        return rows["c"].to_numpy(), np.frombuffer(b"".join(rows["v"]), np.float32).reshape(len(rows), -1)

    share = lambda m, salt: None if m >= n else lambda c: bucket_of(1_000_003, c, F.lit(salt)) < int(1_000_003 * m / n) + 1
    leaves = min(LEAVES, max(1, n // LEAF))
    sample = min(FIT_MOST, max(FIT_SAMPLE, FIT_LEAF * leaves))
    _, fit = drawn(share(sample * 0.95, 3) if sample < n else None, sample)
    width, leaves = fit.shape[1], min(leaves, max(1, len(fit) // 4))
    trees, both = [fit_tree(fit, leaves)], asked == n
    known, got, visits = 0, 1.0, trees[0].leaves
    if visits > 1:
        qid, qx = drawn(share(CALIBRATE * 0.9 * n / asked, 9), CALIBRATE, "ask")
        # fewer neighbours than this and the quantile is just the largest of them
        enough = lambda at: len(at) * (1 - recall) >= 1 - 1e-9
        # the sample may be luckier than the whole: its standard error is added to the share
        surely = lambda need: min(1.0, recall + (recall * (1 - recall) / len(need)) ** 0.5)
        quantile = lambda need: int(np.sort(need)[int(np.ceil(surely(need) * len(need))) - 1])
        truth = nearest = None
        if len(qid):
            truth = _Calibration(classes, qid, qx, k, least)
            known = len(truth)
            nearest = truth if enough(truth) else _Calibration(classes, qid, qx, 1, -2.0)
        if nearest is not None and enough(nearest):
            # the need of each neighbour in the trees so far, the smallest counts
            needs = [(nearest.need(trees[0]), truth.need(trees[0]))]

            def wanted() -> int:
                near, true = (np.min(x, axis=0) for x in zip(*needs))
                return quantile(near) if nearest is truth else max(quantile(near), int(true.max(initial=1)))

            visits = wanted()
            while len(trees) < TREES and visits > 1:
                more = fit_tree(fit, leaves, 5 + len(trees))
                needs.append((nearest.need(more), truth.need(more)))
                fewer, cost = wanted(), lambda m, v: m * (TRAVEL + v * asked / n)
                if cost(len(trees) + 1, fewer) >= cost(len(trees), visits):
                    needs.pop()
                    break
                trees.append(more)
                visits = fewer
            if visits < trees[0].leaves:
                got = float((np.min([x[1] for x in needs], axis=0) <= visits).mean()) if known else None
    if visits >= trees[0].leaves:
        trees, visits, got = trees[:1], trees[0].leaves, 1.0
    report = {"leaves": trees[0].leaves, "visits": visits, "trees": len(trees), "recall": got, "known": known}

    some = fit[:FIT_SAMPLE]
    found = []
    for tree in trees:
        pairs = _search(classes, tree, visits, some, n, asked, width, k, least)
        if len(trees) > 1:  # one tree's shuffle after the other's
            pairs = materialize(pairs)
            sweep(spark)
        found.append(pairs)
    every = found[0]
    for pairs in found[1:]:
        every = every.unionByName(pairs)
    if both:  # each pair once, from either end
        every = every.groupBy("q", "c").agg(F.max("sim").alias("sim"))
        ends = F.explode(F.array(F.struct("q", "c"), F.struct(F.col("c").alias("q"), F.col("q").alias("c"))))
        every = every.select(ends.alias("e"), "sim").select("e.q", "e.c", "sim")
    elif len(trees) > 1:
        every = every.groupBy("q", "c").agg(F.max("sim").alias("sim"))
    return every, report


def _search(classes: Callable[..., DataFrame], tree: Tree, visits: int, some: np.ndarray, n: int, asked: int, width: int, k: int, least: float) -> DataFrame:
    """(q, c, sim): the ``k`` best in each opened leaf of one tree; where all are queries, a pair once, with q < c."""
    sc = classes().sparkSession.sparkContext
    per = min(CELL, max(1, tree.leaves // 64))  # leaves of a cell
    cells, both = -(-tree.leaves // per), asked == n

    def cell_rows(leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, bits) of the leaves that each row opens."""
        cell = np.sort(leaf, 1)
        row, cell = np.repeat(np.arange(len(leaf)), leaf.shape[1]), cell.ravel()
        row, cell = row[cell >= 0], cell[cell >= 0]
        if not len(row):
            return row, cell, np.zeros(0, np.int64)
        bit = np.left_shift(np.uint64(1), (cell % per).astype(np.uint64))
        cell = cell // per
        start = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (cell[1:] != cell[:-1])])
        return row[start], cell[start], np.bitwise_or.reduceat(bit, start).view(np.int64)

    # rows of each cell, from the share of a sample
    held, met = np.zeros(cells), np.zeros(cells)
    for at in range(0, len(some), BLOCK):
        held += np.bincount(tree.walk(some[at : at + BLOCK], 1, gaps=True)[:, 0] // per, minlength=cells)
    asking = some[:2048]
    for at in range(0, len(asking), 64):
        met += np.bincount(cell_rows(tree.opened(asking[at : at + 64], visits))[1], minlength=cells)
    blocks = np.maximum(1, np.ceil(held * (n / len(some)) / (BLOCK_ROWS * min(per, 16)))).astype(int)
    parts = np.maximum(1, np.ceil(met * (asked / len(asking)) / (PART_ROWS * min(per, 4)))).astype(int)
    shared = sc.broadcast((tree.levels, tree.parent, blocks, parts))  # at most LEAVES * 17 / 16 centres and their parents

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, parent, blocks, parts = shared.value
        t = Tree(levels, parent)
        step = max(1, min(BLOCK, (1 << 20) // visits))

        def sent(x: np.ndarray, c: np.ndarray, leaf: np.ndarray, ask: bool) -> pa.RecordBatch:
            row, cell, bits = cell_rows(leaf)
            bits = bits if ask else np.zeros_like(bits)
            own = leaf[row, 0]
            home = np.where(own // per == cell, own % per, -1)
            block, part = np.zeros(len(row), int), np.zeros(len(row), int)
            b, p = blocks[cell], parts[cell]
            if (b > 1).any() or (p > 1).any():
                # as a vector into its block with all parts, as a query into its part with all blocks
                times = b + p - 1
                nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                row, cell, bits, home, b, p = (np.repeat(a, times) for a in (row, cell, bits, home, b, p))
                mix = (c[row] * 2654435761 >> 7) & 0x7FFFFFFF
                block, part = mix % b, mix // 1009 % p
                other = nth - p
                home, bits = np.where(other < 0, home, -1), np.where((other >= 0) | (nth == part), bits, 0)
                block, part = np.where(other < 0, block, other + (other >= block)), np.where(other < 0, nth, part)
                keep = (home >= 0) | (bits != 0)
                row, cell, bits, home, block, part = (a[keep] for a in (row, cell, bits, home, block, part))
            key = cell.astype(np.int64) << 42 | block << 21 | part  # one number, which the shuffle sorts by at once
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(home.astype(np.int32)), pa.array(bits), pa.array(c[row]), _binary(x[row])], ["key", "home", "bits", "c", "v"])

        for batch in batches:
            x, c, ask = _vectors(batch.column("v"), width), batch.column("c").to_numpy(), batch.column("ask").to_numpy(zero_copy_only=False).astype(bool)
            for rows, n in ((np.flatnonzero(ask), step), (np.flatnonzero(~ask), BLOCK)):
                for at in range(0, len(rows), n):
                    r = rows[at : at + n]
                    yield sent(x[r], c[r], t.opened(x[r], visits) if ask[r[0]] else t.walk(x[r], 1, gaps=True), bool(ask[r[0]]))

    def search(table: pa.Table) -> pa.Table:
        x, c = _vectors(table.column("v"), width), table.column("c").to_numpy()
        home, bits = table.column("home").to_numpy(), table.column("bits").to_numpy()
        out_q, out_c, out_s = [], [], []
        by_home = np.argsort(home, kind="stable")
        of = np.searchsorted(home[by_home], np.arange(per + 1))
        for leaf in np.flatnonzero(np.diff(of)):
            h, q = by_home[of[leaf] : of[leaf + 1]], np.flatnonzero(bits & np.uint64(1 << int(leaf)).astype(np.int64))
            xh = x[h]
            for at in range(0, len(q), BLOCK):
                qq = q[at : at + BLOCK]
                s = x[qq] @ xh.T
                r, j = _near(s, k + 1, least - 1e-5)
                found = [(r, j)]
                # from the other end nothing is left to find where the rows have given all that is near
                if both and (np.bincount(r, minlength=1).max() > k or np.bincount(j, minlength=1).max() > k + 1):
                    j, r = _near(s.T, k + 1, least - 1e-5)
                    found.append((r, j))
                for r, j in found:
                    a, b = qq[r], h[j]
                    keep = c[a] != c[b]
                    out_q.append(a[keep])
                    out_c.append(b[keep])
        a, b = (np.concatenate([*o, np.zeros(0, int)]).astype(int) for o in (out_q, out_c))
        if both:
            a, b = np.where(c[a] < c[b], a, b), np.where(c[a] < c[b], b, a)
        if both and len(a):
            code = np.unique(a * len(c) + b)
            a, b = np.divmod(code, len(c))
        for at in range(0, len(a), 65536):
            out_s.append(np.einsum("ij,ij->i", x[a[at : at + 65536]].astype(float), x[b[at : at + 65536]].astype(float)))
        sim = np.concatenate([*out_s, np.zeros(0)])
        keep = sim >= least - 1e-7
        return pa.table({"q": c[a[keep]], "c": c[b[keep]], "sim": sim[keep]})

    placed = classes().mapInArrow(place, "key bigint, home int, bits bigint, c bigint, v binary")
    return placed.groupBy("key").applyInArrow(search, "q bigint, c bigint, sim double")


def _bounded(df: DataFrame) -> DataFrame:
    """A written table, by broadcast where it is counted as small."""
    return F.broadcast(df) if df.count() <= FEW_ITEMS else df


def most_similar(rows: DataFrame, k: int = 10, least: float = -2.0, every: int = 1, recall: float = RECALL) -> tuple[DataFrame, dict]:
    """((item, other, sim, rank), report): the ``k`` most similar other items of every item whose id ``every`` divides.

    A null, NaN or infinite element counts as 0, and so do the elements a list
    is shorter by than the longest; null lists, empty lists, null items and
    all-zero vectors have no direction. Of an item loaded with different lists
    the one with the smaller bytes stays. Items of one direction, told at 12
    digits, form a class named by the smallest item.

    Ties go to the smaller id, items of one direction are each other's most
    similar at 1. Only pairs with a cosine of at least ``least``. Empty tables
    give an empty result, further columns are ignored.
    """
    src = rows.select(F.col("item").cast("bigint").alias("item"), F.col("vals").cast("array<double>").alias("vals")).where("item IS NOT NULL AND vals IS NOT NULL")
    width = src.agg(F.max(F.size("vals"))).first()[0] or 0
    prints = materialize(_units(src, width, "print"))
    # items loaded more than once, then classes with copies: only these go through joins
    twice = materialize(prints.groupBy("item").agg(F.count("*").alias("n")).where("n > 1").select("item"))
    again = _bounded(twice)
    one = _units(src.join(again, "item", "left_semi"), width, "float64").groupBy("item").agg(F.min("v").alias("v"))
    chosen = materialize(one)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = [np.frombuffer(b) for b in batch.column("v").to_pylist()]
            digest = [hashlib.blake2b((np.round(x, 12) + 0.0).tobytes(), digest_size=16).digest() for x in v]
            yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(digest, pa.binary()), pa.array([x.astype(np.float32).tobytes() for x in v], pa.binary())], ["item", "v", "x"])

    chosen = chosen.mapInArrow(unpack, "item bigint, v binary, x binary")
    told = prints.join(again, "item", "left_anti").unionByName(chosen.select("item", "v"))
    firsts = materialize(told.groupBy("v").agg(F.min("item").alias("c"), F.count("*").alias("size")).where("size > 1"))
    shared = materialize(told.join(_bounded(firsts), "v").select("item", "c"))
    copies = shared.where("item <> c").select("item")
    special = _bounded(materialize(twice.unionByName(copies).distinct()))
    copied = _bounded(materialize(copies))
    # classes asked for: by their own number, or by that of a copy
    asks = lambda item: F.pmod(item, F.lit(every)) == 0
    also = materialize(shared.where(asks(F.col("item")) & ~asks(F.col("c"))).select(F.col("c").alias("ac")).distinct()) if every > 1 else None
    counted = told.agg(F.count("*").alias("n"), F.count_if(asks(F.col("item"))).alias("a")).first()
    n = counted.n - copies.count()
    asked = n if every == 1 else counted.a - copies.where(asks(F.col("item"))).count() + also.count()
    also = _bounded(also) if every > 1 else None

    def classes(where: Callable[[Column], Column] | None = None) -> DataFrame:
        own = (lambda df: df.where(where(F.col("item")))) if where else lambda df: df
        main = _units(own(src).join(special, "item", "left_anti"), width, "float32")
        rest = own(chosen.select("item", F.col("x").alias("v"))).join(copied, "item", "left_anti")
        out = main.unionByName(rest).withColumnRenamed("item", "c")
        if every == 1:
            return out.withColumn("ask", F.lit(True))
        return out.join(also, F.col("c") == F.col("ac"), "left").select("c", "v", (asks(F.col("c")) | F.col("ac").isNotNull()).alias("ask"))

    near, report = neighbours(classes, n, asked, k, least, recall)
    nearest = F.row_number().over(W.partitionBy("q").orderBy(F.desc("sim"), F.asc("c")))
    near = near.withColumn("nth", nearest).where(F.col("nth") <= k).select("q", "c", "sim")
    # of each class of copies only its first k + 1 items can be on anyone's list
    firsts = shared.withColumn("nth", F.row_number().over(W.partitionBy("c").orderBy("item"))).where(F.col("nth") <= k + 1).select(F.col("c").alias("fc"), F.col("item").alias("fi"))
    listed = near.join(firsts, F.col("c") == F.col("fc"), "left").select("q", F.coalesce("fi", "c").alias("other"), "sim")
    same = firsts.select(F.col("fc").alias("q"), F.col("fi").alias("other"), F.lit(1.0).alias("sim")) if least <= 1 else listed.limit(0)
    best = F.row_number().over(W.partitionBy("q").orderBy(F.desc("sim"), F.asc("other")))
    listed = listed.unionByName(same).withColumn("b", best).where(F.col("b") <= k + 1)
    # a class's items: its copies, or itself
    members = shared.where(asks(F.col("item"))).select(F.col("item").alias("si"), F.col("c").alias("sc"))
    alone = listed.join(shared.select(F.col("c").alias("sc")).distinct(), F.col("q") == F.col("sc"), "left_anti").select(F.col("q").alias("item"), "other", "sim")
    pairs = alone.unionByName(listed.join(members, F.col("q") == F.col("sc")).select(F.col("si").alias("item"), "other", "sim")).where("item <> other")
    rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("sim"), F.asc("other")))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k), report
