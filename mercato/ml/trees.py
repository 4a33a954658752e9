"""What a task of the boosting does: bins, blocks of rows, trees over bins,
histograms and splits. Apart from :mod:`boosting`, so that a worker that
starts loads little."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

BAG_TENTHS = 9
BUNDLE_CELLS = 1 << 13  # (node, combination of bins) that rows are counted by at once
BLOCK = 1 << 17  # rows that a task looks at together


def squared_gradient(label: np.ndarray, margin: np.ndarray) -> np.ndarray:
    return 2.0 * (label - margin)


def residual(label: np.ndarray, margin: np.ndarray) -> np.ndarray:
    return label - margin


def logistic_gradient(label: np.ndarray, margin: np.ndarray) -> np.ndarray:
    """For labels of 0 and 1; the probability is 1 / (1 + exp(-2 margin))."""
    sign = 2.0 * label - 1.0
    return 4.0 * sign / (1.0 + np.exp(np.clip(2.0 * sign * margin, None, 700.0)))


@dataclass
class Bins:
    """The thresholds of each numeric feature (None for a nominal one) and the
    number of bins of each feature."""

    thresholds: list
    sizes: list[int]

    @property
    def dtype(self) -> type:
        """The smallest numbers that hold any feature's bins."""
        most = max(self.sizes, default=1)
        return np.uint8 if most <= 1 << 8 else np.uint16 if most <= 1 << 16 else np.uint32

    def of(self, x: np.ndarray) -> np.ndarray:
        """Bins of ``x`` (rows x features), one line per feature. A value is in
        the bin of the first threshold that it doesn't exceed; NaN is in the
        last one, as it goes right at every split."""
        out = np.empty((x.shape[1], x.shape[0]), self.dtype)
        for f, cuts in enumerate(self.thresholds):
            col = x[:, f]
            out[f] = np.clip(np.nan_to_num(col), 0, self.sizes[f] - 1) if cuts is None else np.searchsorted(cuts, col, "left")
        return out


def packed(bins: Bins) -> Callable:
    """Packs rows (features, label, weight, row) into blocks of arrays. Every
    level of every round reads a block, so it holds no more than it must:
    consecutive row numbers are their first one, weights that are all 1 are
    left out."""
    dtype = "float64", "float64", "int64"

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        x = t.column(0).combine_chunks()
        x = np.asarray(x.flatten(), float).reshape(len(x), len(bins.sizes))
        label, weight, row = (np.asarray(t.column(1 + i)).astype(d) for i, d in enumerate(dtype))
        if (weight == 1.0).all():
            weight = weight[:0]
        if (np.diff(row) == 1).all():
            row = row[:1]
        cells = [bins.of(x).tobytes(), label.tobytes(), weight.tobytes(), row.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int64()), *[pa.array([c], pa.binary()) for c in cells]],
                                          ["n", "bins", "label", "weight", "row"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= BLOCK:
                yield block(held)
                held, n = [], 0
        if n:
            yield block(held)
    return blocks


def unpacked(bins: Bins) -> Callable:
    """Reads a stored block: (bins by feature, label, weight, row number)."""
    dtype = bins.dtype

    def read(r):
        return (np.frombuffer(r["bins"], dtype).reshape(len(bins.sizes), r["n"]), np.frombuffer(r["label"]),
                np.frombuffer(r["weight"]), np.frombuffer(r["row"], np.int64))
    return read


class Tree:
    """A regression tree over bins. Node 0 is the root; ``split`` of a node is
    (feature, which bins go left, gain), None for a leaf. ``l2`` is added to
    the weight of a leaf."""

    def __init__(self, totals: tuple[float, float, float], l2: float = 0.0):
        self.totals, self.split, self.left, self.right, self.depth = [totals], [None], [0], [0], [0]
        self.parent, self.l2 = [0], l2

    def grow(self, node: int, feature: int, goes_left: np.ndarray, gain: float, left: tuple, right: tuple) -> None:
        self.split[node] = (feature, goes_left, gain)
        for side, totals in ((self.left, left), (self.right, right)):
            side[node] = len(self.totals)
            self.totals.append(totals)
            self.split.append(None)
            self.left.append(len(self.left))
            self.right.append(len(self.right))
            self.depth.append(self.depth[node] + 1)
            self.parent.append(node)

    def sibling(self, node: int) -> int:
        above = self.parent[node]
        return self.left[above] + self.right[above] - node

    def values(self) -> np.ndarray:
        return np.array([s / (w + self.l2) if w else 0.0 for _, w, s in self.totals])

    def pruned(self, kept: set[int]) -> tuple[Tree, np.ndarray]:
        """The tree with the splits of ``kept`` alone, and the node of it that
        stands for each node of this one."""
        out, stands = Tree(self.totals[0], self.l2), np.zeros(len(self.totals), np.int64)
        for node in range(len(self.totals)):  # parents come first
            if node and self.parent[node] not in kept:
                stands[node] = stands[self.parent[node]]
            if node in kept:
                at = int(stands[node])
                out.grow(at, *self.split[node], self.totals[self.left[node]], self.totals[self.right[node]])
                stands[self.left[node]], stands[self.right[node]] = out.left[at], out.right[at]
        return out, stands

    def walk(self, bins: np.ndarray) -> np.ndarray:
        """The last node that each row comes to."""
        return self.onward(np.zeros(bins.shape[1], np.int64), bins, max(self.depth))

    def onward(self, at: np.ndarray, bins: np.ndarray, steps: int) -> np.ndarray:
        """The nodes that rows at ``at`` come to in so many steps."""
        if steps < 1 or self.split[0] is None:
            return at
        # one table says where a bin leads from a node; leaves lead to themselves
        n, width = bins.shape[1], max(len(s[1]) for s in self.split if s)
        table = np.repeat(np.arange(len(self.split))[:, None], width, 1)
        first = np.zeros(len(self.split), np.int64)
        for node, s in enumerate(self.split):
            if s:
                table[node, :len(s[1])] = np.where(s[1], self.left[node], self.right[node])
                first[node] = s[0] * n
        flat, place, table = bins.reshape(-1), np.arange(n), table.reshape(-1)
        for _ in range(steps):
            cell = first.take(at)
            cell += place
            key = at * width
            # a leaf's row looks at feature 0, whose bins may be more than the table is wide
            key += np.minimum(flat.take(cell), width - 1)
            at = table.take(key)
        return at


def in_bag(row: np.ndarray, seed: int) -> np.ndarray:
    z = row.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, mul in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(mul)
    return (z ^ (z >> np.uint64(31))) % np.uint64(10) < BAG_TENTHS


@lru_cache(256)
def bundles(sizes: tuple[int, ...], most: int) -> list[list[int]]:
    """Features put together as long as their bins have up to ``most``
    combinations, large ones first."""
    out = []
    for f in sorted(range(len(sizes)), key=lambda f: (-sizes[f], f)):
        for held in out:
            if held[0] * sizes[f] <= most:
                held[0] *= sizes[f]
                held.append(f)
                break
        else:
            out.append([sizes[f], f])
    return [held[1:] for held in out]


class Sums:
    """The number of rows, their weight (if ``weighted``) and target by (node,
    bin) of each feature. Rows are counted by the combinations of a bundle's
    bins, which costs as much as one feature, and a feature's sums are read
    off at the end."""

    def __init__(self, sizes: list[int], n_nodes: int, weighted: bool):
        self.sizes, self.n_nodes, self.bundles = sizes, n_nodes, bundles(tuple(sizes), BUNDLE_CELLS // n_nodes)
        self.held = [np.zeros((3 if weighted else 2, n_nodes * math.prod(sizes[f] for f in held))) for held in self.bundles]

    def add(self, bins: np.ndarray, slot: np.ndarray, chosen: np.ndarray | None, target: np.ndarray, w: np.ndarray | None) -> None:
        for features, s in zip(self.bundles, self.held):
            cell = slot
            for f in features:
                cell = cell * self.sizes[f]
                cell += bins[f] if chosen is None else bins[f].take(chosen)
            count = np.bincount(cell, minlength=s.shape[1])
            s[0] += count
            s[-1] += np.bincount(cell, target, minlength=s.shape[1])
            if len(s) > 2:
                s[1] += count if w is None else np.bincount(cell, w, minlength=s.shape[1])

    def by_feature(self) -> list[np.ndarray]:
        """(sum, node and bin) for each feature."""
        out = [None] * len(self.sizes)
        for features, s in zip(self.bundles, self.held):
            grid = s.reshape(len(s), self.n_nodes, *[self.sizes[f] for f in features])
            for i, f in enumerate(features):
                others = tuple(2 + j for j in range(len(features)) if j != i)
                out[f] = grid.sum(axis=others).reshape(len(s), -1) if others else s
        return out


def _numbered(row: np.ndarray, n: int) -> np.ndarray:
    return row[0] + np.arange(n) if len(row) < n else row


def histograms(blocks: Iterator, tree: Tree, nodes: list[int], sizes: list[int], gradient: Callable, seed: int | None,
               weighted: bool) -> Iterator[tuple[int, np.ndarray]]:
    """Rows, weight and weighted target by (node, bin), for each feature;
    without a seed all rows are in the bag."""
    slot_of = np.full(len(tree.totals), -1)
    slot_of[nodes] = np.arange(len(nodes))
    sums = None
    for bins, label, weight, row, margin in blocks:
        slot = slot_of.take(tree.walk(bins))
        keep = np.flatnonzero(slot >= 0)
        if seed is not None:
            keep = keep[in_bag(_numbered(row, len(label)).take(keep), seed)]
        if not len(keep):
            continue
        sums = sums or Sums(sizes, len(nodes), weighted)
        w = weight[keep] if len(weight) else None
        target = gradient(label[keep], margin[keep])
        sums.add(bins, slot[keep], keep, target if w is None else target * w, w)
    if sums:
        yield from enumerate(sums.by_feature())


def joined(sums: list[np.ndarray], n_nodes: int) -> np.ndarray:
    """The features' sums side by side: (sum, node, bin of any feature)."""
    return np.concatenate([s.reshape(len(s), n_nodes, -1) for s in sums], axis=2)


def best_splits(f: int, sums: np.ndarray, nominal: bool, leaf_rows: int, l2: float = 0.0) -> tuple:
    """Of one feature, for all nodes of ``sums`` (sum, node, bin): totals,
    gains (-inf if there is no split), places of the best splits, the order of
    the bins and the totals of the left sides. The gain is the fall in the sum
    of squares."""
    n, w, s = sums[0], sums[1 if len(sums) > 2 else 0], sums[-1]
    order = None
    if nominal:  # categories by their mean, those without rows last
        there = w > 0
        order = np.argsort(np.where(there, s / np.where(there, w, 1), np.inf), axis=1, kind="stable")
        n, w, s = (np.take_along_axis(v, order, 1) for v in (n, w, s))
    cn, cw, cs = (np.cumsum(v, axis=1) for v in (n, w, s))
    tn, tw, ts = cn[:, -1:], cw[:, -1:], cs[:, -1:]
    least = max(leaf_rows, 1)
    ok = (cn >= least) & (tn - cn >= least) & (cw > 0) & (tw - cw > 0)
    lw, rw = np.where(ok, cw, 1) + l2, np.where(ok, tw - cw, 1) + l2
    gain = np.where(ok, cs ** 2 / lw + (ts - cs) ** 2 / rw - ts ** 2 / (np.where(tw > 0, tw, 1) + l2), -np.inf)
    at = gain.argmax(axis=1)
    pick = np.arange(len(at)), at
    return np.stack([tn, tw, ts])[:, :, 0], gain[pick], at, order, np.stack([cn[pick], cw[pick], cs[pick]])


def offer(f: int, k: int, size: int, found: tuple) -> tuple:
    """Node ``k``'s best split by feature ``f``: (totals, gain or None,
    feature, which bins go left, totals of the left side); the gain is the
    fall in variance."""
    totals, gain, at, order, left = found
    total = tuple(totals[:, k].tolist())
    if not gain[k] > 0:
        return total, None, f, None, None
    goes = np.zeros(size, bool)
    goes[(order[k] if order is not None else np.arange(size))[:at[k] + 1]] = True
    return total, float(gain[k] / total[1]), f, goes, tuple(left[:, k].tolist())


def offers(sums: np.ndarray, sizes: list[int], nominal: list[bool], leaf_rows: int, l2: float = 0.0) -> list[tuple]:
    """The best split of each node over all features, the first of equal ones."""
    found, start = [], 0
    for f, size in enumerate(sizes):
        found.append(best_splits(f, sums[:, :, start:start + size], nominal[f], leaf_rows, l2))
        start += size
    best = np.stack([x[1] for x in found]).argmax(axis=0)
    return [offer(int(f), k, sizes[f], found[f]) for k, f in enumerate(best)]


class Looks:
    """Best splits of nodes from their sums. Of two siblings only the one with
    fewer rows is summed; the other's sums are what is left of their
    parent's."""

    def __init__(self, sums_of: Callable, bins: Bins, leaf_rows: int, l2: float = 0.0):
        self.sums_of, self.held = sums_of, {}
        self.how = bins.sizes, [t is None for t in bins.thresholds], leaf_rows, l2

    def __call__(self, tree: Tree, nodes: list[int]) -> list[tuple]:
        asked = list(dict.fromkeys(min(x, tree.sibling(x), key=lambda i: (tree.totals[i][0], i)) if x else 0 for x in nodes))
        sums = self.sums_of(tree, asked)
        if sums is None:
            return []
        known = {x: sums[:, i] for i, x in enumerate(asked)}
        for x in nodes:
            if x not in known:
                rest = self.held[tree.parent[x]] - known[tree.sibling(x)]
                rest[:, rest[0] <= 0] = 0.0  # what rounding leaves in bins without rows
                known[x] = rest
        for x in nodes:
            self.held.pop(tree.parent[x], None)
        self.held.update((x, known[x]) for x in nodes)
        return offers(np.stack([known[x] for x in nodes], axis=1), *self.how)


def grown(look: Callable, leaf_rows: int, depth: int | None = None, leaves: int | None = None, l2: float = 0.0) -> tuple[Tree, np.ndarray, Tree]:
    """A tree by the best splits that ``look`` finds, the node of it that
    stands for each node that was looked at, and the tree of those. With ``leaves`` the leaf of the
    largest gain is split first until there are so many. As no more leaves can
    be split than splits are left, the children of so many are looked at
    together, ahead of their turn; those whose turn doesn't come are dropped."""
    tree, known, kept = Tree((0.0, 0.0, 0.0), l2), {}, set()
    ask, front, left = [0], [0], leaves - 1 if leaves else None

    def gain(x):  # in the sum of squares, as leaves are compared by it
        return known[x][1] * known[x][0][1]

    while ask or front:
        ask = [x for x in ask if (depth is None or tree.depth[x] < depth) and (not x or tree.totals[x][0] >= 2 * max(leaf_rows, 1))]
        for x, o in zip(ask, look(tree, ask) if ask else []):
            if not x:
                tree.totals[0] = o[0]
            if o[1] is not None and o[1] > 0:
                known[x] = o
        # splits whose turn has come and whose children have been looked at
        front = [x for x in front if x in known]
        while left and front and tree.split[(x := max(front, key=lambda i: (gain(i), -i)))] is not None:
            kept.add(x)
            left -= 1
            front = [i for i in (*front, tree.left[x], tree.right[x]) if i != x and i in known]
        if left == 0:
            break
        turn = sorted(front, key=lambda i: (-gain(i), i))[:left]
        ask = []
        for x in sorted(turn):
            if tree.split[x] is None:
                total, fall, f, goes, side = known[x]
                tree.grow(x, f, goes, fall, side, tuple(t - s for t, s in zip(total, side)))
                ask += [tree.left[x], tree.right[x]]
        if left is None:
            kept.update(front)
            front = ask
    return *tree.pruned(kept), tree


class Held:
    """All rows in one task: rounds are run without a job of their own, and a
    row's node is kept from one look to the next."""

    def __init__(self, blocks: list[tuple], bins: Bins, gradient: Callable, weighted: bool = False):
        self.blocks, self.bins, self.gradient, self.weighted = blocks, bins, gradient, weighted

    def round(self, seed: int | None, step: float, leaf_rows: int, depth: int | None = None, leaves: int | None = None,
              l2: float = 0.0) -> Tree:
        """Fits a tree and adds ``step`` times its values to the margins."""
        at = [np.zeros(len(b[1]), np.int64) for b in self.blocks]
        targets = [self.gradient(b[1], b[4]) * (b[2] if len(b[2]) else 1.0) for b in self.blocks]
        bag = [None if seed is None else in_bag(_numbered(b[3], len(b[1])), seed) for b in self.blocks]
        seen = [1]

        def sums_of(tree, nodes):
            slot_of = np.full(len(tree.totals), -1)
            slot_of[nodes] = np.arange(len(nodes))
            sums = Sums(self.bins.sizes, len(nodes), self.weighted)
            for i, (bins, _, weight, _, _) in enumerate(self.blocks):
                if len(tree.totals) > seen[0]:
                    at[i] = tree.onward(at[i], bins, 1)
                slot = slot_of.take(at[i])
                keep = np.flatnonzero(slot >= 0 if bag[i] is None else (slot >= 0) & bag[i])
                whole = len(keep) == len(slot)
                sums.add(bins, slot if whole else slot.take(keep), None if whole else keep, targets[i].take(keep),
                         weight.take(keep) if len(weight) else None)
            seen[0] = len(tree.totals)
            return joined(sums.by_feature(), len(nodes))

        tree, stands, whole = grown(Looks(sums_of, self.bins, leaf_rows, l2), leaf_rows, depth, leaves, l2)
        values = (step * tree.values()).take(stands)
        self.blocks = [(*b[:4], b[4] + values.take(whole.onward(a, b[0], 1))) for a, b in zip(at, self.blocks)]
        return tree


def fits_here(bins: Bins, margin0: float) -> Callable:
    """Fits one point of a grid, all its rounds, to blocks that are in one
    task: (number of the point, trees)."""
    def run(element: tuple) -> tuple[int, list[Tree]]:
        (number, point), blocks = element
        how = dict(point)
        rounds, step = how.pop("rounds"), how.pop("step")
        held = Held([(*b, np.full(b[0].shape[1], margin0)) for b in blocks], bins, residual)
        return number, [held.round(None, step, **how) for _ in range(rounds)]
    return run


def units_errors(fits: list[tuple[list[Tree], float]], margin0: float) -> Callable:
    """Of a block, for each fit: the sum of the absolute errors of predictions
    that are 0 at least; and the sum of the labels' sizes."""
    def run(block: tuple) -> np.ndarray:
        bins, label = block[:2]
        sums = []
        for trees, step in fits:
            margin = np.full(bins.shape[1], margin0)
            for t in trees:
                margin += (step * t.values()).take(t.walk(bins))
            sums.append(np.abs(label - np.maximum(margin, 0.0)).sum())
        return np.array([*sums, np.abs(label).sum()])
    return run


def rounds_here(bins: Bins, gradient: Callable, weighted: bool, seeds: list[int], step: float, leaf_rows: int, depth: int) -> Callable:
    """Runs so many rounds over all blocks, which are in one task: the trees,
    then the new margins of each block."""
    def run(blocks: Iterator) -> Iterator:
        held = Held(list(blocks), bins, gradient, weighted)
        yield [held.round(seed, step, leaf_rows, depth) for seed in seeds]
        yield from (b[4] for b in held.blocks)
    return run


def advanced(tree: Tree, weight: float) -> Callable:
    """The margins of a block after a round."""
    values = weight * tree.values()
    return lambda block: block[4] + values.take(tree.walk(block[0]))


def stepped(trees: list[Tree], weights: list[float], read: Callable) -> Callable:
    """Adds the margins after each of the rounds to stored blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                bins = read({**r, "weight": b"", "row": b""})[0]
                margin = np.frombuffer(r["margin"]) if r["margin"] is not None else np.zeros(r["n"])
                out = []
                for tree, weight in zip(trees, weights):
                    margin = margin + weight * tree.values()[tree.walk(bins)]
                    out.append(margin.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([r["n"]], pa.int64()), *[pa.array([v], pa.binary()) for v in (
                    r["bins"], r["label"], b"".join(out))]], ["n", "bins", "label", "margins"])
    return run


def rows_of(rounds: int) -> Callable:
    """Rows (label, margins) of judged blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for label, margins in _held(batches, rounds):
            for at in range(0, len(label), 10_000):
                part = np.ascontiguousarray(margins[at:at + 10_000])
                lists = pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * rounds, pa.array(part.reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array(label[at:at + 10_000]), lists], ["label", "margins"])
    return run


def error_sums(rounds: int) -> Callable:
    """Rows and sums of the absolute errors of each round, by block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for label, margins in _held(batches, rounds):
            sums = [float(np.abs(label - margins[:, k]).sum()) for k in range(rounds)]
            yield pa.RecordBatch.from_arrays([pa.array([len(label)], pa.int64()), pa.array([sums], pa.list_(pa.float64()))], ["n", "sums"])
    return run


# AUC --------------------------------------------------------------------------
def _held(batches: Iterator[pa.RecordBatch], rounds: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Labels and margins (rows x rounds) of judged blocks (n, label, margins),
    or of rows (label, margins), up to about BLOCK rows at a time."""
    labels, margins, n = [], [], 0
    for batch in batches:
        if batch.num_columns > 2:
            for r in batch.to_pylist():
                yield np.frombuffer(r["label"]), np.frombuffer(r["margins"]).reshape(-1, r["n"])[:rounds].T
        elif batch.num_rows:
            labels.append(np.asarray(batch.column(0), float))
            margins.append(np.asarray(batch.column(1).flatten(), float).reshape(batch.num_rows, -1)[:, :rounds])
            n += batch.num_rows
        if n >= BLOCK:
            yield np.concatenate(labels), np.concatenate(margins)
            labels, margins, n = [], [], 0
    if n:
        yield np.concatenate(labels), np.concatenate(margins)


def score_marks(rounds: int, marks: int) -> Callable:
    """A few evenly spaced scores of each block and round, and its rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for label, margin in _held(batches, rounds):
            at = np.linspace(0, len(label) - 1, marks).astype(int)
            for k in range(rounds):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([len(label)], pa.int64()),
                                                  pa.array([np.sort(margin[:, k])[at].tolist()], pa.list_(pa.float64()))],
                                                 ["round", "n", "marks"])
    return run


def _tied(score: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct scores in their order with their counts."""
    order = np.argsort(score, kind="stable")
    score = score[order]
    first = np.flatnonzero(np.r_[True, score[1:] != score[:-1]])
    return score[first], np.add.reduceat(pos[order], first), np.add.reduceat(neg[order], first)


def _small(counts: np.ndarray) -> bytes:
    """Counts in the fewest bytes that hold the largest."""
    most = int(counts.max(initial=0))
    return counts.astype(next(t for t in ("u1", "u2", "u4", "u8") if most < 1 << 8 * int(t[1]))).tobytes()


def _counts(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // n}").astype(np.int64)


def score_counts(rounds: int, cuts: list[np.ndarray]) -> Callable:
    """Counts of the distinct scores of each block, by round and range of
    scores (equal ones are in one range)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for label, margin in _held(batches, rounds):
            yes = label.astype(np.int64)
            for k in range(rounds):
                score, pos, neg = _tied(margin[:, k] + 0.0, yes, 1 - yes)
                ends = [0, *np.searchsorted(score, cuts[k], "right"), len(score)]
                rows = [(k, r, score[a:b].tobytes(), _small(pos[a:b]), _small(neg[a:b]))
                        for r, (a, b) in enumerate(zip(ends, ends[1:])) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), (
                    pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["round", "part", "score", "pos", "neg"])
    return run


def range_area(t: pa.Table) -> pa.Table:
    """Of one round's range: positives, negatives and twice the number of
    pairs in their order inside it, ties half."""
    scores = [np.frombuffer(b) for b in t.column("score").to_pylist()]
    score, pos, neg = _tied(np.concatenate(scores), *[
        np.concatenate([_counts(b, len(x)) for b, x in zip(t.column(c).to_pylist(), scores)]) for c in ("pos", "neg")])
    area = int((pos * (2 * np.cumsum(neg) - neg)).sum())
    return pa.table({"round": pa.array([t.column("round")[0].as_py()], pa.int32()), "part": pa.array([t.column("part")[0].as_py()], pa.int32()),
                     "pos": [int(pos.sum())], "neg": [int(neg.sum())], "area": [area]})
