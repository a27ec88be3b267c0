"""Permutation tests of forests on any number of rows, where they are: the trees of all permutations grow together.

A level of all trees takes one pass. Each row goes down the trees and is sent, once for each feature that a tree tries, to
that tree's task; this one meets each feature's values in order, a section of them at a time, and weighs every cut between
different values, as the local forest does. Bootstraps and the order in which nodes try features are the same for all
permutations, as those of local forests with one seed are.

Leaving out one row at a time takes no fit for each row: n - 1 draws from all n rows that happen not to draw row i are n - 1
draws from the others. So bags are drawn from all rows until each row has enough bags without it, and these are its forest.
Its class weighs as it does without the row: a tree's cuts are weighed once for each class that may miss a row. Where all
of these take the same cut, as they mostly do, the tree stays one.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import array_rows, summed
from .rowwise import fold_of, multiplicities, number_rows, permuted, rounds

#: Rows of a section of a feature's values, about; permutations that grow together, at most; rows sent down trees at once.
SECTION, TOGETHER, ROWS = 16_384, 64, 4_096
#: Values of all best cuts of one level, at most (where no two weighings agree): these come to the driver.
CUTS = 10_000_000
#: Bytes that a level's rows may take in a shuffle, about: more of them are sent for some bags after the others.
SENT = 4_000_000_000
#: Values that a task weighs at once, about; messages that it takes out of a batch at once.
WEIGHED, TAKEN = 65_536, 64
#: Losses of impurity that differ by less than this share of a node's weight are equal.
TIE = 1e-12


def _sections(dealt: DataFrame, n: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each feature the edges between sections, near its quantiles, and whether it's constant."""
    shares = [float(v) for v in np.linspace(0, 1, max(1, -(-n // SECTION)) + 1)[1:-1]] or [0.5]
    cells = dealt.select(F.posexplode("x").alias("f", "v"))
    found = cells.groupBy("f").agg(F.percentile_approx("v", shares).alias("e"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("f").collect()  # features x sections
    edges = [np.unique([v for v in r.e or [] if np.isfinite(v)]) if n > SECTION else np.zeros(0) for r in found]
    return edges, np.array([r.lo is None or r.lo == r.hi for r in found])


class Draws:
    """Rows of the training part without a fold, numbered by themselves, and how often each tree draws them."""

    def __init__(self, edges: np.ndarray, cv: int, trees: int, seed: int):
        self.edges, self.cv, self.trees, self.bags, self.parts = edges, cv, trees, cv * trees, cv
        sizes = np.diff(edges)
        self.before = np.array([np.cumsum([0, *(sizes - (sizes - f + cv - 1) // cv)]) for f in range(cv)])
        self.keys = np.random.RandomState(seed).randint(0, 1 << 31, trees)

    def bag(self, number: np.ndarray, fold: int, tree: int) -> np.ndarray:
        """How often each of the rows outside ``fold`` is drawn."""
        c = np.searchsorted(self.edges, number, "right") - 1
        place = number - self.edges[c]
        own = self.before[fold][c] + place - (place - fold + self.cv - 1) // self.cv
        return multiplicities(own, np.array([0, self.before[fold][-1]]), int(self.keys[tree]))

    def drawn(self, number: np.ndarray, fold: np.ndarray, bag: int) -> np.ndarray:
        """How often each row is drawn for a bag: those of a fold are one for each tree."""
        f, t = divmod(bag, self.trees)
        out, own = np.zeros(len(number), "int64"), np.flatnonzero(fold != f)
        out[own] = self.bag(number[own], f, t)
        return out

    def asks(self, number: np.ndarray, fold: np.ndarray, bag: int, asked: np.ndarray) -> np.ndarray:
        """Rows that a bag's trees vote on; ``asked``: how many bags each row had."""
        return np.flatnonzero(fold == bag // self.trees)

    def weights(self, labels: np.ndarray) -> np.ndarray:
        """Permutations x folds x classes, from each fold's labels: the training part's classes, weighed evenly."""
        there = labels.sum(axis=1, keepdims=True) - labels
        return np.where(there > 0, there.sum(axis=2, keepdims=True) / np.maximum((there > 0).sum(axis=2, keepdims=True) * there, 1), 0.0)

    def weighings(self, bag: int) -> slice:
        return slice(bag // self.trees, bag // self.trees + 1)


class Singles:
    """Bags of all rows, with one draw less than rows: those without a row are bags of the others. A row's forest has the
    first ``trees`` bags without it, its weights those without its class's row."""

    def __init__(self, n: int, trees: int, seed: int):
        self.n, self.trees, self.bags, self.parts = n, trees, 0, 1
        self.key = int(np.random.RandomState(seed).randint(0, 1 << 31))

    def drawn(self, number: np.ndarray, fold: np.ndarray, bag: int) -> np.ndarray:
        return multiplicities(number, np.array([0, self.n]), self.key + bag, self.n - 1)

    def asks(self, number: np.ndarray, fold: np.ndarray, bag: int, asked: np.ndarray) -> np.ndarray:
        own = np.flatnonzero(asked < self.trees)
        own = own[self.drawn(number[own], fold, bag) == 0]
        asked[own] += 1
        return own

    def weights(self, labels: np.ndarray) -> np.ndarray:
        """Permutations x classes that miss a row x classes. A class's only row meets no tree with rows of its class."""
        there = labels - np.eye(labels.shape[2]) * (labels > 1)
        return np.where(there > 0, 1 / np.maximum(there, 1), 0.0)

    def weighings(self, bag: int) -> slice:
        return slice(None)

    def draw(self, dealt: DataFrame) -> Singles:
        """As many bags as the row needs that most bags draw."""

        def need(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            most = 0
            for number, fold, _ in _slices(batches):
                asked, bag = np.zeros(len(number), "int64"), 0
                while (asked < self.trees).any():
                    self.asks(number, fold, bag, asked)
                    bag += 1
                most = max(most, bag)
            yield pa.RecordBatch.from_arrays([pa.array([most], pa.int64())], names=["bags"])

        self.bags = int(dealt.mapInArrow(need, "bags long").agg(F.max("bags")).first()[0])
        return self


class Trees:
    """Each bag's trees, for permutations and weighings that agree so far one tree; nodes as in a heap: those below i are
    2i + 1 and 2i + 2. By bag: the trees' ``perm``, ``feature``, ``limit`` and ``counts`` (draws by class), and the tree of
    each permutation and weighing (``line``)."""

    def __init__(self, counts: np.ndarray, weights: np.ndarray, dealing: Draws | Singles, depth: int):
        size, bags, q = counts.shape
        nodes = (2 << depth) - 1
        self.weights, self.q = weights, q
        self.perm = [np.arange(size) for _ in range(bags)]
        self.feature, self.limit = [np.full((size, nodes), -1) for _ in range(bags)], [np.zeros((size, nodes)) for _ in range(bags)]
        self.counts = [np.concatenate([counts[:, u, None], np.zeros((size, nodes - 1, q))], axis=1) for u in range(bags)]
        self.line = [np.repeat(np.arange(size)[:, None], weights[:, dealing.weighings(u)].shape[1], axis=1) for u in range(bags)]

    def down(self, x: np.ndarray, bag: int, levels: int, which: np.ndarray | None = None) -> np.ndarray:
        """The node that each row comes to in each of the bag's trees, or in those of each row's ``which``."""
        feature, limit = self.feature[bag], self.limit[bag]
        tree, row = np.arange(len(feature))[None, :] if which is None else which, np.arange(len(x))[:, None]
        at = np.zeros((len(x), tree.shape[1]), int)
        for _ in range(levels):
            f = feature[tree, at]
            at = np.where(f < 0, at, 2 * at + 2 - (x[row, np.maximum(f, 0)] <= limit[tree, at]))
        return at

    def open(self, bag: int, level: int) -> np.ndarray:
        """Trees x nodes of the level: those with draws of several classes."""
        return (self.counts[bag][:, (1 << level) - 1 : (2 << level) - 1] > 0).sum(axis=2) > 1

    def of(self, bags: list[int], level: int) -> Trees:
        """What a level's pass needs of some bags: of ``counts`` this level's nodes alone."""
        out = copy(self)
        for name in ("perm", "feature", "limit", "line"):
            setattr(out, name, {u: getattr(self, name)[u] for u in bags})
        out.counts = {u: self.counts[u][:, (1 << level) - 1 : (2 << level) - 1].astype(np.min_scalar_type(int(self.counts[u].max()))) for u in bags}
        return out

    def split(self, bag: int, old: np.ndarray, member: np.ndarray, first: int, f: np.ndarray, limit: np.ndarray, left: np.ndarray) -> None:
        """Trees that are now told apart take the place of the old ones they come from, with the cuts of a level."""
        line, perm = self.line[bag], self.perm[bag][old]
        for new, (b, own) in enumerate(zip(perm, member)):
            line[b, own] = new
        self.perm[bag], self.feature[bag], self.limit[bag], self.counts[bag] = perm, self.feature[bag][old], self.limit[bag][old], self.counts[bag][old]
        for k in range(f.shape[1]):
            own, at = np.flatnonzero(f[:, k] >= 0), first + k
            self.feature[bag][own, at], self.limit[bag][own, at] = f[own, k], limit[own, k]
            self.counts[bag][own, 2 * at + 1] = left[own, k]
            self.counts[bag][own, 2 * at + 2] = self.counts[bag][own, at] - left[own, k]


class Search:
    """The best cut of one feature for some nodes of one bag's trees, by each weighing, as the values come.

    A group is a tree's node. Cuts are weighed by the least weights first: what these gain by d, a loss of impurity
    w(a) w(b) / w |share(a) - share(b)|^2, changes by at most 9 powers of the factor by which one class weighs more. Only
    cuts that may still be the best of a weighing are weighed by it.
    """

    def __init__(self, counts: np.ndarray, weights: np.ndarray, nodes: list[int]):
        self.nodes, self.k, self.q = nodes, len(nodes), counts.shape[2]
        self.total, self.weights = counts[:, nodes].reshape(-1, self.q), weights  # groups x classes; trees x weighings x classes
        least = weights.min(axis=1)
        more = np.divide(weights, least[:, None], out=np.ones(weights.shape), where=least[:, None] > 0).max(axis=2)
        self.base, self.near = np.repeat(least, self.k, axis=0), np.repeat(more**-9.0, self.k, axis=0)
        groups, mass = len(self.total), self.total * self.base
        self.whole, self.square, self.cross = mass.sum(axis=1), (mass * mass).sum(axis=1), (mass * self.base).ravel()
        self.left, self.last, self.top = np.zeros((groups, self.q)), np.full(groups, np.inf), np.full(groups, -np.inf)
        self.best, self.limit = np.full((groups, weights.shape[1]), -np.inf), np.zeros((groups, weights.shape[1]))
        self.taken = np.zeros((groups, weights.shape[1], self.q))  # draws on the left of the best cuts
        node = np.full(counts.shape[1] + 1, self.k)
        node[nodes] = np.arange(self.k)
        self.node, self.label = np.repeat(node, self.q)[: counts.shape[1] * self.q + 1], np.arange(counts.shape[1] * self.q + 1) % self.q

    def offer(self, g: np.ndarray, left: np.ndarray, low: np.ndarray, high: np.ndarray, gain: np.ndarray) -> None:
        """Weigh cuts of groups ``g`` (in order, and in order of values) with these draws on the left; of equal cuts the
        first is kept."""
        cut, w = np.nonzero(gain[:, None] >= self.near[g] * self.top[g][:, None] - 1e-9 * self.whole[g][:, None])
        if not len(cut):
            return
        order = np.argsort(g[cut] * self.near.shape[1] + w, kind="stable")
        cut, w = cut[order], w[order]
        own = g[cut]
        weights = self.weights[own // self.k, w]
        one, sums = left[cut] * weights, self.total[own] * weights
        square, wa, whole = np.einsum("ij,ij->i", one, one), one.sum(axis=1), sums.sum(axis=1)
        both = np.einsum("ij,ij->i", sums, sums)
        drop = square / wa + (both - 2 * np.einsum("ij,ij->i", sums, one) + square) / (whole - wa) - both / whole
        starts = _starts(own * self.near.shape[1] + w)
        sizes = np.diff([*starts, len(own)])
        hit = np.flatnonzero(drop >= np.repeat(np.maximum.reduceat(drop, starts), sizes) - TIE * whole)
        hit = hit[np.unique(np.repeat(np.arange(len(starts)), sizes)[hit], return_index=True)[1]]
        hit = hit[drop[hit] > self.best[own[hit], w[hit]] + TIE * whole[hit]]
        at = own[hit], w[hit]
        self.best[at], self.limit[at], self.taken[at] = drop[hit], (low[cut[hit]] + high[cut[hit]]) / 2, left[cut[hit]]

    def rows(self, v: np.ndarray, drawn: np.ndarray, code: np.ndarray) -> None:
        """Rows whose values lie above all that came before; ``code``: node and class in each tree."""
        order = np.argsort(v, kind="stable")
        v, drawn, code = v[order], drawn[order].astype(float), np.ascontiguousarray(code[order].T)
        some = max(1, WEIGHED // len(v))
        for a in range(0, len(code), some):
            self._rows(v, drawn, code[a : a + some], a * self.k)

    def _rows(self, v: np.ndarray, drawn: np.ndarray, code: np.ndarray, first: int) -> None:
        """The same for the trees whose groups begin with ``first``."""
        q, node = self.q, self.node[code]
        at = np.flatnonzero(node < self.k)
        if not len(at):
            return
        label = self.label[code.ravel()[at]]
        if len(at) == code.size:
            tree, value, draws = np.repeat(np.arange(len(code)), len(v)), np.tile(v, len(code)), np.tile(drawn, len(code))
        else:
            tree, row = np.divmod(at.astype("u4"), np.uint32(len(v)))
            value, draws = v[row], drawn[row]
        group = (tree * self.k + node.ravel()[at]).astype("i8")
        if self.k > 1:
            order = _ordered(group)
            group, value, draws, label = group[order], value[order], draws[order], label[order]
        key, starts = group * q + label, _starts(group)
        g, sizes = group[starts] + first, np.diff([*starts, len(group)])
        order = _ordered(key)
        key += first * q
        count = draws[order]
        upto = np.cumsum(count) - count
        of = _starts(key[order])
        upto -= np.repeat(upto[of] - self.left.ravel()[key[order[of]]], np.diff([*of, len(key)]))
        before = np.empty(len(key))
        before[order] = upto  # its class's draws below each row
        weight = self.base.ravel()[key]
        one, mass = self.left[g] * self.base[g], self.total[g] * self.base[g]

        def below(added: np.ndarray, start: np.ndarray) -> np.ndarray:
            sums = np.cumsum(added)
            sums -= added
            sums -= np.repeat(sums[starts] - start, sizes)
            return sums

        more = weight * draws
        wa, cross = below(more, one.sum(axis=1)), below(self.cross[key] * draws, (one * mass).sum(axis=1))
        before *= 2
        before += draws
        square = below(more * weight * before, (one * one).sum(axis=1))
        low = np.empty(len(value))
        low[1:], low[starts] = value[:-1], self.last[g]
        gain = self._gain(np.repeat(g, sizes), wa, square, cross, value > low)
        self.top[g] = np.maximum(self.top[g], np.maximum.reduceat(gain, starts))
        least = self.near[g].min(axis=1) * self.top[g] - 1e-9 * self.whole[g]
        cuts = np.flatnonzero((gain >= np.repeat(least, sizes)) & (gain > -np.inf))
        if len(cuts):
            marks = np.zeros(len(key), bool)
            marks[starts] = marks[cuts] = True
            part = np.cumsum(marks) - 1
            sums = np.bincount(part * q + label, draws, (part[-1] + 1) * q).reshape(-1, q)
            sums = np.cumsum(sums, axis=0) - sums
            at = np.searchsorted(starts, cuts, "right") - 1
            self.offer(g[at], sums[part[cuts]] - sums[part[starts[at]]] + self.left[g[at]], low[cuts], value[cuts], gain[cuts])
        self.left += np.bincount(key, draws, self.left.size).reshape(self.left.shape)
        self.last[g] = value[starts + sizes - 1]

    def _gain(self, g: np.ndarray, wa: np.ndarray, square: np.ndarray, cross: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """Losses of impurity by the least weights, about; none where there is no ``cut``."""
        with np.errstate(divide="ignore", invalid="ignore"):
            out = square / wa + (self.square[g] - 2 * cross + square) / (self.whole[g] - wa) - (self.square / self.whole)[g]
        out[~cut] = -np.inf
        return out

    def point(self, v: float, counts: np.ndarray) -> None:
        """Rows of one value, not below any before, as draws: trees x nodes x classes."""
        own = counts[:, self.nodes].reshape(self.left.shape)
        met = own.any(axis=1)
        g = np.flatnonzero(met & self.left.any(axis=1))
        if len(g):
            one, mass = self.left[g] * self.base[g], self.total[g] * self.base[g]
            gain = self._gain(g, one.sum(axis=1), (one * one).sum(axis=1), (one * mass).sum(axis=1), self.last[g] < v)
            self.top[g] = np.maximum(self.top[g], gain)
            g, gain = g[gain > -np.inf], gain[gain > -np.inf]
            self.offer(g, self.left[g], self.last[g], np.full(len(g), v), gain)
        self.left += own
        self.last[met] = v


def _starts(key: np.ndarray) -> np.ndarray:
    """Where a run of equal ones begins."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))


def _ordered(key: np.ndarray) -> np.ndarray:
    """A stable order of whole numbers: small ones are sorted by their digits."""
    return np.argsort(key.astype("u2") if key.max() < 1 << 16 else key, kind="stable")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``number, fold, x`` of some rows at a time."""
    for whole in batches:
        for a in range(0, whole.num_rows, ROWS):
            batch = whole.slice(a, ROWS)
            yield batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def permutation_test(rows: DataFrame, trees: int = 100, depth: int = 3, seed: int = 42, n_permutations: int = 1000, min_perms: int = 50, check_every: int = 25, cv: int | None = None) -> dict:
    """Cross-validated accuracy of forests against labels in random order, in rounds that end where the early stop may.

    Trees, cuts and votes are the local forest's: sqrt(p) features at each node, constant ones not counted, classes weighed
    evenly. By default each row is left out by itself; else ``cv`` folds, those of the true labels throughout. The driver
    holds trees and one best cut for each of them.
    """
    spark = rows.sparkSession
    known = number_rows(rows, 2 * spark.sparkContext.defaultParallelism)
    n, q, edges = known.n, len(known.classes), known.edges
    dealt = known.rows.withColumn("fold", F.lit(0) if cv is None else fold_of(known, cv)).select("number", "fold", "x")
    sections, constant = _sections(dealt, n)
    dealing = Singles(n, trees, seed).draw(dealt) if cv is None else Draws(edges, cv, trees, seed)
    keys = np.random.RandomState(seed).randint(0, 1 << 31, max(1, n_permutations))
    rng, p = np.random.RandomState(seed + 1), len(sections)
    tries = [[[int(f) for f in rng.permutation(p) if not constant[f]] for _ in range((1 << depth) - 1)] for _ in range(dealing.bags if cv is None else trees)]
    most, alone = int(max(1, np.sqrt(p))), q if cv is None else 1  # features of a node, weighings of a bag

    def accuracies(which: list[int]) -> list[float]:
        size = len(which)

        def labels(number: np.ndarray) -> np.ndarray:
            return np.stack([permuted(edges, number, None if w < 0 else int(keys[w])) for w in which], axis=1)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            there, drawn = np.zeros((dealing.parts, size * q)), np.zeros((dealing.bags, size * q))
            for number, fold, _ in _slices(batches):
                label = labels(number) + np.arange(size) * q
                for f in range(dealing.parts):
                    there[f] += np.bincount(label[fold == f].ravel(), minlength=size * q)
                for u in range(dealing.bags):
                    draws = dealing.drawn(number, fold, u)
                    own = np.flatnonzero(draws)
                    drawn[u] += np.bincount(label[own].ravel(), np.repeat(draws[own], size), size * q)
            both = np.concatenate([there, drawn]).reshape(-1, size, q).transpose(1, 0, 2)
            yield array_rows({"b": np.arange(size)}, [v.ravel() for v in both])

        first = np.zeros((size, dealing.parts + dealing.bags, q))
        for r in summed(dealt.mapInArrow(count, "b long, v array<double>"), "b").toLocalIterator():  # a few numbers for each tree
            first[r.b] = np.reshape(r.v, first.shape[1:])
        grown = Trees(first[:, dealing.parts :], dealing.weights(first[:, : dealing.parts]), dealing, depth)
        for level in range(depth):
            _grow(dealt, grown, level, tries, most, sections, dealing, labels, n)
        held = spark.sparkContext.broadcast(grown)

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hits, forest, each = np.zeros(size, "int64"), held.value, np.arange(size)[None, :]
            for number, fold, x in _slices(batches):
                label, asked = labels(number), np.zeros(len(number), "int64")
                votes = np.zeros((len(number), size, q))
                for u in range(dealing.bags):
                    own = dealing.asks(number, fold, u, asked)
                    if not len(own):
                        continue
                    line, way = forest.line[u], label[own] if alone > 1 else np.zeros((len(own), size), int)
                    mass = forest.counts[u][line] * forest.weights[:, dealing.weighings(u), None]  # permutations x weighings x nodes x classes
                    share = mass / np.maximum(mass.sum(axis=-1, keepdims=True), 1e-300)
                    votes[own] += share[each, way, forest.down(x[own], u, depth, line[each, way])]
                best = votes.argmax(axis=2)
                hits += ((best == label) & (votes.max(axis=2) > 0)).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(hits)], names=["b", "hits"])

        got = {r.b: r.hits for r in dealt.mapInArrow(compare, "b long, hits long").groupBy("b").agg(F.sum("hits").alias("hits")).collect()}  # a number each
        held.destroy()
        return [got[b] / n for b in range(size)]

    some = max(1, min(TOGETHER, CUTS // (dealing.bags * alone * (2 + q) << max(0, depth - 1))))
    return rounds(lambda which: [a for k in range(0, len(which), some) for a in accuracies(which[k : k + some])], n_permutations, min_perms, check_every)


def _grow(dealt: DataFrame, grown: Trees, level: int, tries: list[list[list[int]]], most: int, sections: list[np.ndarray], dealing: Draws | Singles, labels, n: int) -> None:
    """Split the nodes of one level. Nodes whose tried features turn out constant try twice as many, by themselves, until
    enough of them aren't."""
    first, width = (1 << level) - 1, 1 << level
    open_ = {u: grown.open(u, level) for u in range(dealing.bags)}
    seen = np.zeros((dealing.bags, width), int)
    while True:
        wanted: dict[int, dict[int, list[int]]] = {}
        for u, nodes in open_.items():
            for k in np.flatnonzero(nodes.any(axis=0)):
                order = tries[u % len(tries)][first + k]
                seen[u, k] = min(len(order), max(most, 2 * seen[u, k]))
                for f in order[: seen[u, k]]:
                    wanted.setdefault(u, {}).setdefault(f, []).append(int(k))
        if not wanted:
            return
        for some in _portions({u: n * len(fs) * (16 + len(open_[u])) for u, fs in wanted.items()}):
            now = {u: wanted[u] for u in some}
            for u, v in _cuts(dealt, grown, level, now, {u: open_[u] for u in some}, tries, seen, most, sections, dealing, labels):
                f, limit, left = (v[:, a:z].reshape(len(v), width, -1) for a, z in _columns(grown, u, width)[2:])
                member, still = (v[:, a:z] > 0 for a, z in _columns(grown, u, width)[:2])
                grown.split(u, v[:, 0].astype(int), member, first, f[:, :, 0].astype(int), limit[:, :, 0], left)
                open_[u] = still


def _portions(sizes: dict[int, int]) -> Iterator[list[int]]:
    """Bags whose rows are sent together."""
    some, total = [], 0
    for u, size in sizes.items():
        if some and total + size > SENT:
            yield some
            some, total = [], 0
        some.append(u)
        total += size
    yield some


def _columns(grown: Trees, bag: int, width: int) -> list[tuple[int, int]]:
    """Where a split tree's numbers lie behind the old tree's: weighings, nodes left open, features, limits, draws."""
    edges = np.cumsum([1, grown.line[bag].shape[1], width, width, width, width * grown.q])
    return list(zip(edges[:-1], edges[1:]))


def _choose(found: dict[int, Search], grown: Trees, bag: int, weights: np.ndarray, open_: np.ndarray, tries: list[list[int]], seen: np.ndarray, most: int) -> np.ndarray:
    """The bag's trees with their cuts of a level, split where weighings differ: a row of numbers each, see ``_columns``."""
    line, (trees, width), q = grown.line[bag], open_.shape, grown.q
    ways = line.shape[1]
    feature, limit, left, still = np.full((trees, ways, width), -1.0), np.zeros((trees, ways, width)), np.zeros((trees, ways, width, q)), np.zeros((trees, width), bool)
    first = width - 1
    for k in np.flatnonzero(open_.any(axis=0)):
        order = tries[first + k][: seen[k]]
        group = [np.arange(trees) * found[f].k + found[f].nodes.index(k) for f in order]
        drop = np.stack([found[f].best[g] for f, g in zip(order, group)])  # features x trees x weighings
        some = drop > -np.inf
        still[:, k] = open_[:, k] & (some.sum(axis=0) < most).any(axis=1) & (len(order) < len(tries[first + k]))
        drop[~(some & (np.cumsum(some, axis=0) <= most))] = -np.inf
        whole = (grown.counts[bag][:, k, None] * weights).sum(axis=2)
        pick = (drop >= drop.max(axis=0) - TIE * whole).argmax(axis=0)  # of equal ones the first
        cut = (drop.max(axis=0) > -np.inf) & (open_[:, k] & ~still[:, k])[:, None]
        for i, (f, g) in enumerate(zip(order, group)):
            s, w = np.nonzero(cut & (pick == i))
            feature[s, w, k], limit[s, w, k], left[s, w, k] = f, found[f].limit[g[s], w], found[f].taken[g[s], w]
    old, way = line.ravel(), np.tile(np.arange(ways), len(line))
    _, one, new = np.unique(np.column_stack([old, feature[old, way], limit[old, way]]), axis=0, return_index=True, return_inverse=True)
    member = np.zeros((len(one), ways))
    member[new.ravel(), way] = 1
    s, w = old[one], way[one]
    return np.column_stack([s, member, still[s], feature[s, w], limit[s, w], left[s, w].reshape(len(s), -1)])


def _cuts(dealt: DataFrame, grown: Trees, level: int, wanted: dict[int, dict[int, list[int]]], open_: dict[int, np.ndarray], tries: list[list[list[int]]], seen: np.ndarray, most: int, sections: list[np.ndarray], dealing: Draws | Singles, labels) -> list[tuple[int, np.ndarray]]:
    """Each wanted bag and its trees with the cuts of a level, see ``_choose``. Only rows in open nodes are sent.

    Values equal to an edge are a section of their own; where a task has many of them, it sends their draws instead.
    """
    first, width, q = (1 << level) - 1, 1 << level, grown.q
    none = width * q  # the code of rows that came to an end above this level
    code_type = np.min_scalar_type(none)
    held = dealt.sparkSession.sparkContext.broadcast((grown.of(list(wanted), level), open_, sections, wanted))

    def record(trees: int) -> np.dtype:
        return np.dtype([("v", "<f8"), ("drawn", "<i4"), ("code", code_type, (trees,))])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, unsplit, edges, features = held.value
        for number, fold, x in _slices(batches):
            label = labels(number)
            for u, tried in features.items():
                drawn, trees = dealing.drawn(number, fold, u), len(forest.perm[u])
                bag = np.flatnonzero(drawn)
                at = forest.down(x[bag], u, level) - first
                live = (at >= 0) & unsplit[u][np.arange(trees)[None, :], np.maximum(at, 0)]
                code = np.where(live, at * q + label[bag][:, forest.perm[u]], none).astype(code_type)
                some = np.flatnonzero(live.any(axis=1))
                bag, table = bag[some], np.zeros(len(some), record(trees))
                table["drawn"], table["code"] = drawn[bag], code[some]
                out: list[tuple] = []
                for f in tried:
                    table["v"] = v = x[bag, f]
                    section = np.searchsorted(edges[f], v, "left") + np.searchsorted(edges[f], v, "right")
                    order = np.argsort(section, kind="stable")
                    ends = [0, *(np.flatnonzero(np.diff(section[order])) + 1), len(order)]
                    for a, z in zip(ends[:-1], ends[1:]):
                        if a == z:
                            continue
                        part, s = table[order[a:z]], int(section[order[a]])
                        many = s % 2 == 1 and part.nbytes > 8 * trees * none
                        out.append((u, f, s, many, _counts(part, none).tobytes() if many else part.tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()))], names=["bag", "f", "section", "many", "rows"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, unsplit, edges, features = held.value
        now, part, kept, found, weights = None, None, [], {}, None

        def settle() -> None:
            if kept:
                got = np.concatenate([np.frombuffer(r, record(len(weights))) for r in kept])
                found[part[1]].rows(got["v"], got["drawn"], got["code"])
                kept.clear()

        def end() -> pa.RecordBatch:
            settle()
            got = _choose(found, forest, now, weights, unsplit[now], tries[now % len(tries)], seen[now], most)
            return array_rows({"bag": np.full(len(got), now)}, list(got))

        for whole in batches:
            for a in range(0, whole.num_rows, TAKEN):
                for u, f, section, many, rows in zip(*(c.to_pylist() for c in whole.slice(a, TAKEN).columns)):
                    if u != now:
                        if now is not None:
                            yield end()
                        now, part, weights = u, None, forest.weights[forest.perm[u]][:, dealing.weighings(u)]
                        found = {g: Search(forest.counts[u].astype(float), weights, nodes) for g, nodes in features[u].items()}
                    if (u, f, section) != part:
                        settle()
                    part = (u, f, section)
                    if many:
                        found[f].point(float(edges[f][section // 2]), np.frombuffer(rows, "<i8").reshape(-1, width, q))
                    else:
                        kept.append(rows)
        if now is not None:
            yield end()

    sent = dealt.mapInArrow(spread, "bag long, f long, section long, many boolean, rows binary")
    parts = max(1, min(len(wanted), 8 * dealt.sparkSession.sparkContext.defaultParallelism))
    met = sent.repartition(parts, "bag").sortWithinPartitions("bag", "f", "section").mapInArrow(search, "bag long, v array<double>")
    out: dict[int, list[np.ndarray]] = {}
    for batch in met.toArrow().to_batches():  # at once, as tasks end: one best cut for each tree and node, CUTS values at most
        bags, values = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy()
        ends = batch.column(1).offsets.to_numpy() - batch.column(1).offsets[0].as_py()
        for u, a, z in zip(bags, ends[:-1], ends[1:]):
            out.setdefault(int(u), []).append(values[a:z])
    held.destroy()
    return [(u, np.stack(v)) for u, v in out.items()]


def _counts(rows: np.ndarray, none: int) -> np.ndarray:
    """Trees x codes: the rows' draws."""
    return np.stack([np.bincount(rows["code"][:, b], rows["drawn"], none + 1)[:none] for b in range(rows["code"].shape[1])]).astype("<i8")
