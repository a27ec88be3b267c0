"""Exact n-gram Jaccard join by signature trees, and its connected components.

Documents with equal shingle sets form a class. Two sets with Jaccard 0.8 share one of their first ``n - ceil(0.8 n) + 1``
shingles in any one order of all shingles; here frequent shingles (a bounded table of counts over all documents) come
last, so passages that many documents share hardly ever bring documents together. Classes that meet at a shingle are
joined by signature trees: nodes hold OR- and AND-combined token bitmaps and size ranges, and a dual traversal drops node
pairs whose largest possible overlap is too small; pairs of leaves are compared by XOR sketches, and what is left by the
sets themselves. Each class is first joined at its fullest shingle, which unites most groups of near copies; where many
classes meet, one document of each component is then joined with those of the others; after that the shingles at which
several components still meet are joined in blocks, all of them, so no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, worker_state, written

N = 5
#: Frequent shingles that are put last, at most, and those that one task reports.
HOT, REPORT = 1 << 16, 1 << 13
#: Shingles that a task gathers before it counts them.
GATHER = 1 << 21
#: Documents in a block, and shingles of a block's documents, about: more at one shingle are joined as pairs of blocks.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 22
#: Bytes of texts that are hashed together.
TOGETHER = 1 << 18
#: Bits of a bitmap or a sketch, at most.
MOST_BITS = 1 << 15
#: A class's number ends in its size's bucket (the logarithm to base 1.25): linked sets are in the same or adjacent ones.
BUCKETS = 64
#: Ids (8 bytes each) that are broadcast at most.
BROADCAST_ROWS = 500_000
LEAF, FAN = 16, 8

_R = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.random.RandomState(20240229).randint(0, 1 << 63, 256, dtype=np.int64).astype("uint64") * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype="uint8")
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64: as long as the longest text so far asked for, and kept
    only until another operator's tables take the worker's place for them."""
    powers = worker_state("powers", lambda: [np.ones(1, "uint64"), np.ones(1, "uint64")])
    if len(powers[0]) < n:
        size = 1 << n.bit_length()
        inverse = np.uint64(pow(int(_R), -1, 1 << 64))
        powers[0] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, _R)]).astype("uint64"))
        powers[1] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, inverse)]).astype("uint64"))
    return powers


def _together(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that come to about TOGETHER bytes, one text at least."""
    first = total = 0
    for i, n in enumerate(sizes):
        if i > first and total + n > TOGETHER:
            yield first, i
            first, total = i, 0
        total += n + 1
    if sizes:
        yield first, len(sizes)


def shingle_sets(texts: list[str | None], n: int = N) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its ``n``-word shingles; fewer words make one; none make none."""
    data = [(t or "").encode() for t in texts]
    for a, z in _together([len(d) for d in data]):
        b = _LOWER[np.frombuffer(b"\n".join([*data[a:z], b""]), "uint8")]
        edge = np.diff((~_BLANK[b]).astype("int8"), prepend=0)
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        up, down = _power(len(b) + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_TABLE[b] * up[: len(b)], dtype="uint64")])
        words = _mix((sums[last] - sums[first]) * down[first] + (last - first).astype("uint64"))
        h = np.full(max(0, len(words) - n + 1), np.uint64(n), "uint64")
        for i in range(n):
            h = _mix(h * np.uint64(3) + words[i : i + len(h)])
        begins = np.searchsorted(first, np.concatenate([[0], np.cumsum([len(d) + 1 for d in data[a:z]])])).tolist()
        for x, y in zip(begins, begins[1:]):
            if y - x >= n:
                s = np.sort(h[x : y - n + 1])
                same = s[1:] == s[:-1]
                yield s[np.concatenate([[True], ~same])] if same.any() else s
            elif x < y:
                one = np.full(1, y - x, "uint64")
                for i in range(x, y):
                    one = _mix(one * np.uint64(3) + words[i : i + 1])
                yield one
            else:
                yield np.empty(0, "uint64")


def shingles(text: str | None, n: int = N) -> np.ndarray:
    return next(shingle_sets([text], n))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= 80 * union, for sorted distinct hashes."""
    if not len(a) or not len(b) or 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 5 * common >= 4 * (len(a) + len(b) - common)


def signatures(s: np.ndarray) -> tuple[bytes, bytes]:
    """A bit for each remainder of the hashes: set by any of them (bitmap), and flipped by each of them (sketch)."""
    bits = min(MOST_BITS, 1 << max(6, len(s).bit_length()))
    n = np.bincount((s & np.uint64(bits - 1)).astype("int64"), minlength=bits)
    return tuple(np.packbits(x.astype("uint8"), bitorder="little").tobytes() for x in (n > 0, n & 1))


class Forest:
    """Union-find over places; ``edges`` are the unions that were made."""

    def __init__(self, groups: list):
        first: dict = {}
        self.up = [first.setdefault(g, i) for i, g in enumerate(groups)]
        self.edges: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def unite(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.edges.append((i, j))


class Node:
    """Documents ``first`` to ``last`` (excluded) of the sorted list, with combined bitmaps and the range of sizes."""

    __slots__ = ("first", "last", "any", "all", "least", "most", "children")

    def __init__(self, first: int, last: int, either: np.ndarray, every: np.ndarray, least: int, most: int, children: list):
        self.first, self.last, self.any, self.all, self.least, self.most, self.children = first, last, either, every, least, most, children


def _tree(maps: np.ndarray, sizes: np.ndarray) -> Node:
    """The root over documents sorted by size."""
    level = [Node(i, min(i + LEAF, len(maps)), np.bitwise_or.reduce(maps[i : i + LEAF]), np.bitwise_and.reduce(maps[i : i + LEAF]), int(sizes[i]), int(sizes[min(i + LEAF, len(maps)) - 1]), []) for i in range(0, len(maps), LEAF)]
    while len(level) > 1:
        level = [
            Node(c[0].first, c[-1].last, np.bitwise_or.reduce([x.any for x in c]), np.bitwise_and.reduce([x.all for x in c]), c[0].least, c[-1].most, c)
            for c in (level[i : i + FAN] for i in range(0, len(level), FAN))
        ]
    return level[0]


def _can_link(u: Node, v: Node) -> bool:
    """Whether the largest overlap of a document in u with one in v can be enough."""
    if 5 * u.most < 4 * v.least or 5 * v.most < 4 * u.least:
        return False
    overlap = min(u.most - int(np.bitwise_count(u.all & ~v.any).sum()), v.most - int(np.bitwise_count(v.all & ~u.any).sum()))
    return 9 * overlap >= 4 * (u.least + v.least)


def leaf_pairs(a: Node, b: Node, united: Callable[[Node, Node], bool]) -> Iterator[tuple[Node, Node]]:
    """Dual traversal of two trees (or of one with itself): pairs of leaves that may hold a link and aren't ``united``."""
    stack = [(a, b)]
    while stack:
        u, v = stack.pop()
        if not _can_link(u, v) or united(u, v):
            continue
        if not u.children and not v.children:
            yield u, v
        elif u is v:
            stack += [(x, y) for k, x in enumerate(u.children) for y in u.children[k:]]
        elif u.children and (not v.children or u.last - u.first >= v.last - v.first):
            stack += [(x, v) for x in u.children]
        else:
            stack += [(u, y) for y in v.children]


class _Signed:
    """Documents of one cell whose signatures have one length, sorted by size, and their tree (without bitmaps one leaf).
    Longer signatures can be folded."""

    def __init__(self, at: np.ndarray, size: np.ndarray, maps: np.ndarray, sketches: np.ndarray):
        self.at, self.size, self.maps, self.sketches = at, size, maps, sketches
        self.root = _tree(maps, size) if maps.size else Node(0, len(at), maps[0], maps[0], int(size[0]), int(size[-1]), [])

    def folded(self) -> _Signed:
        wide, half = self.maps.shape[1] // 2, self.sketches.shape[1] // 2
        return _Signed(self.at, self.size, self.maps[:, :wide] | self.maps[:, wide:], self.sketches[:, :half] ^ self.sketches[:, half:])


def may_link(sizes: list[int], maps: list[bytes] | None, sketches: list[bytes], groups: list, sides: list[int] | None = None) -> np.ndarray:
    """Which documents may link with one of another group (and another side). Trees of bitmaps drop most pairs; the rest
    are judged by sketches: sets that differ in d hashes have sketches that differ in d bits at most, and linked sets of
    a and b hashes differ in (a + b) / 9 at most. A longer signature is folded to a shorter one's length."""
    size, out = np.array(sizes), np.zeros(len(sizes), bool)
    group = np.unique(np.array(groups), return_inverse=True)[1]
    side = None if sides is None else np.array(sides)
    lengths = np.array([len(x) for x in sketches])
    trees: dict[int, _Signed] = {}
    for n in map(int, np.unique(lengths)):
        own = np.flatnonzero(lengths == n)
        own = own[np.argsort(size[own], kind="stable")]
        bits, odd = (np.frombuffer(b"".join([x[i] for i in own]) if x else b"", "uint64").reshape(len(own), -1 if x else 0) for x in (maps, sketches))
        trees[n] = _Signed(own, size[own], bits, odd)
    for n, a in trees.items():
        for b in (a, trees[2 * n].folded()) if 2 * n in trees else (a,):

            def united(u: Node, v: Node) -> bool:
                here = group[a.at[u.first : u.last]]
                return bool((here == here[0]).all() and (group[b.at[v.first : v.last]] == here[0]).all())

            for u, v in leaf_pairs(a.root, b.root, united):
                i, j = a.at[u.first : u.last][:, None], b.at[v.first : v.last][None, :]
                fit = (group[i] != group[j]) & (5 * size[i] >= 4 * size[j]) & (5 * size[j] >= 4 * size[i])
                if side is not None:
                    fit &= side[i] != side[j]
                if u is v:
                    fit = np.triu(fit, 1)
                x, y = np.nonzero(fit)
                differ = np.bitwise_count(a.sketches[u.first + x] ^ b.sketches[v.first + y]).sum(axis=1, dtype="int64")
                i, j = i[x, 0], j[0, y]
                ok = 9 * differ <= size[i] + size[j]
                out[i[ok]] = out[j[ok]] = True
    return out


def _two_may_link(a: tuple[int, bytes], b: tuple[int, bytes]) -> bool:
    """The same for two documents, each a size and a sketch."""
    (m, x), (n, y) = sorted((a, b), key=lambda d: len(d[1]))
    if 5 * m < 4 * n or 5 * n < 4 * m:
        return False
    one, two = int.from_bytes(x, "little"), int.from_bytes(y, "little")
    if len(x) < len(y):
        two = (two >> 8 * len(x)) ^ (two & ((1 << 8 * len(x)) - 1))
    return 9 * (one ^ two).bit_count() <= m + n


def join_by_tree(sets: list[np.ndarray], groups: list, sides: list[int] | None = None) -> list[tuple[int, int]]:
    """Links (as places) that unite all of the documents that links unite: documents of one group count as united.
    With ``sides``, only documents of different sides are compared."""
    forest = Forest(groups)
    if len(sets) == 2:
        if forest.find(0) != forest.find(1) and linked(*sets):
            forest.unite(0, 1)
        return forest.edges
    bits = min(MOST_BITS, 1 << max(8, (2 * max(map(len, sets), default=1)).bit_length()))
    maps = np.zeros((len(sets), bits // 8), "uint8")
    for i, s in enumerate(sets):
        flat = np.zeros(bits, "uint8")
        flat[(s & np.uint64(bits - 1)).astype("int64")] = 1
        maps[i] = np.packbits(flat)
    order = sorted((i for i in range(len(sets)) if len(sets[i])), key=lambda i: (len(sets[i]), int(sets[i][0])))
    if not order:
        return []
    maps, sizes = np.ascontiguousarray(maps[order]).view("uint64"), np.array([len(sets[i]) for i in order])
    side = np.zeros(len(order), int) if sides is None else np.array([sides[i] for i in order])
    root = _tree(maps, sizes)
    for u, v in leaf_pairs(root, root, lambda u, v: len({forest.find(order[i]) for w in (u, v) for i in range(w.first, w.last)}) == 1):
        for i in range(u.first, u.last):
            j = np.arange(max(v.first, i + 1) if u is v else v.first, v.last)
            if sides is not None:
                j = j[side[j] != side[i]]
            j = j[(5 * sizes[j] >= 4 * sizes[i]) & (4 * sizes[j] <= 5 * sizes[i])]
            if not len(j):
                continue
            most = np.minimum(sizes[i] - np.bitwise_count(maps[i] & ~maps[j]).sum(axis=1), sizes[j] - np.bitwise_count(maps[j] & ~maps[i]).sum(axis=1))
            for k in j[9 * most >= 4 * (sizes[i] + sizes[j])]:
                a, b = order[i], order[int(k)]
                if forest.find(a) != forest.find(b) and linked(sets[a], sets[b]):
                    forest.unite(a, b)
    return forest.edges


def frequent_shingles(df: DataFrame, size: int = HOT) -> np.ndarray:
    """The shingles in most documents, rarest first; each task keeps a bounded table, so what moves is bounded."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.empty(0, "uint64"), np.empty(0, "int64")
        held: list[np.ndarray] = []

        def merge() -> None:
            nonlocal keys, counts
            new, n = np.unique(np.concatenate(held), return_counts=True) if held else (keys[:0], counts[:0])
            held.clear()
            both = np.concatenate([keys, new[n > 1]])
            keys, at = np.unique(both, return_inverse=True)
            counts = np.bincount(at, weights=np.concatenate([counts, n[n > 1]]), minlength=len(keys)).astype("int64")
            top = np.argsort(-counts, kind="stable")[: 4 * REPORT]
            keys, counts = keys[np.sort(top)], counts[np.sort(top)]

        total = 0
        for batch in batches:
            for found in shingle_sets(batch.column(0).to_pylist()):
                held.append(found)
                total += len(found)
                if total > GATHER:
                    merge()
                    total = 0
        merge()
        top = np.argsort(-counts, kind="stable")[:REPORT]
        yield pa.RecordBatch.from_arrays([pa.array(keys[top].view("int64")), pa.array(counts[top])], names=["token", "n"])

    found = df.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where("n > 2")
    return np.array([r[0] for r in found.orderBy(F.desc("n"), "token").limit(size).collect()][::-1], "int64").view("uint64")


def prefix(s: np.ndarray, known: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n - ceil(0.8 n) + 1`` shingles, frequent ones (``known`` sorted, with their ``rank``) last: first those
    that aren't frequent, then the others."""
    size = len(s) - (4 * len(s) + 4) // 5 + 1 if len(s) else 0
    if not size or not len(known):
        return s[:size], s[:0]
    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
    found = known[at] == s
    if not found.any():
        return s[:size], s[:0]
    rare, often = s[~found][:size], s[found][np.argsort(rank[at[found]])]
    return rare, often[: size - len(rare)]


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype("int32")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*parts, np.empty(0, "uint64")]).view("int64")))


def scan(df: DataFrame, hot: np.ndarray) -> DataFrame:
    """``doc_id, mark, hi, lo, n, rare, frequent, bitmap, sketch``: the set's 128-bit hash, size, prefix and signatures."""
    order = np.argsort(hot)
    shared = df.sparkSession.sparkContext.broadcast((hot[order], order))
    names = ["doc_id", "mark", "hi", "lo", "n", "rare", "frequent", "bitmap", "sketch"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = shared.value
        for batch in batches:
            sets = list(shingle_sets(batch.column(2).to_pylist()))
            sums = [np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8") for s in sets]
            first = [prefix(s, known, rank) for s in sets]
            signed = [signatures(s) for s in sets]
            hi, lo = (pa.array([int(x[k]) for x in sums], pa.int64()) for k in (0, 1))
            columns = [*batch.columns[:2], hi, lo, pa.array([len(s) for s in sets], pa.int64()), *(_lists([f[k] for f in first]) for k in (0, 1)), *(pa.array([x[k] for x in signed], pa.binary()) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.select("doc_id", "mark", "text").mapInArrow(read, "doc_id long, mark long, hi long, lo long, n long, rare array<long>, frequent array<long>, bitmap binary, sketch binary")


def _by_cell(batches: Iterator[pa.RecordBatch], cell: Callable[[list], list], out: Callable[[list], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``out`` of what ``cell`` gives for the rows of each ``cell, i, j``, which stand together."""
    rows: list = []
    for batch in batches:
        found: list = []
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if rows and rows[0][:3] != row[:3]:
                found += cell(rows)
                rows = []
            rows.append(row)
        yield out(found)
    yield out(cell(rows) if rows else [])


def _dealt(df: DataFrame, *columns: str) -> DataFrame:
    return df.select("cell", "i", "j", "c", "comp", "block", *columns).repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "c")


def _candidates(df: DataFrame) -> DataFrame:
    """The rows of each cell (``n, bitmap, sketch`` besides) whose class may link with another component's of the cell.
    Cells of a tree's leaf at most need no bitmaps."""

    def cell(rows: list) -> list[tuple]:
        if len({r[4] for r in rows}) < 2:
            return []
        sides = [r[5] for r in rows] if rows[0][1] != rows[0][2] else None
        if len(rows) == 2:
            keep = [(sides is None or sides[0] != sides[1]) and _two_may_link(rows[0][6::2], rows[1][6::2])] * 2
        else:
            keep = may_link([r[6] for r in rows], [r[7] for r in rows] if len(rows) > LEAF else None, [r[8] for r in rows], [r[4] for r in rows], sides)
        return [r[:6] for r, k in zip(rows, keep) if k]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(6)], names=["cell", "i", "j", "c", "comp", "block"])

    return _dealt(df, "n", "bitmap", "sketch").mapInArrow(lambda batches: _by_cell(batches, cell, out), "cell long, i long, j long, c long, comp long, block long")


def _cells(df: DataFrame) -> DataFrame:
    """Edges that unite the components of each cell's classes (``text`` besides), by signature trees."""

    def cell(rows: list) -> list[tuple[int, int]]:
        if len({r[4] for r in rows}) < 2:
            return []
        sides = [r[5] for r in rows] if rows[0][1] != rows[0][2] else None
        return [(rows[a][4], rows[b][4]) for a, b in join_by_tree(list(shingle_sets([r[6] for r in rows])), [r[4] for r in rows], sides)]

    def out(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return _dealt(df, "text").mapInArrow(lambda batches: _by_cell(batches, cell, out), "a long, b long")


def _joined(cells: DataFrame, classes: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """Edges of ``cells`` (``m``: classes in the cell, at most): first the candidates by signatures, then exactly, by the
    texts of those alone."""
    signed = cells.join(classes.select("c", "n", "bitmap", "sketch"), "c").withColumn("bitmap", F.expr(f"if(m > {LEAF}, bitmap, null)"))
    left = written(_candidates(signed), name)
    found = left.count()
    if not found:
        return left.select(F.col("comp").alias("a"), F.col("comp").alias("b"))
    # the same classes may be left of several cells: one of those is enough
    who = F.xxhash64("c", F.expr("i < j and block = i"))
    alike = left.groupBy("cell", "i", "j").agg(F.count("*").alias("m"), F.sum(who.cast("decimal(20,0)")).alias("x"), F.bit_xor(F.xxhash64(who)).alias("y"))
    left = left.join(alike.groupBy("m", "x", "y").agg(F.min(F.struct("cell", "i", "j")).alias("k")).select("k.*"), ["cell", "i", "j"])
    owners = left.select("c").distinct().join(classes.select("c", "doc_id", "mark"), "c")
    # a small set of ids, by its counted size, is broadcast, so that the texts stay where they are; else both are shuffled
    owners = F.broadcast(owners) if found <= BROADCAST_ROWS else owners
    texts = docs.join(owners, ["doc_id", "mark"]).select("c", "text").dropDuplicates(["c"])
    return written(_cells(left.join(texts, "c")), "links")


def _capacity(c: str, block: int) -> str:
    """Classes of c's size bucket that make a block."""
    return f"cast(greatest(1, least({block}, floor({BLOCK_SHINGLES} / power(1.25, pmod({c}, {BUCKETS}) + 1)))) as long)"


def _home_cells(df: DataFrame, block: int) -> DataFrame:
    """A cell for each ``cell``; if its ``m`` classes are too many, or too large, one for each of its blocks alone."""
    size = _capacity("c", block)
    bucket = f"case when {size} < {block} then pmod(c, {BUCKETS}) + 1 else 0 end"
    part = F.expr(f"({bucket}) * {1 << 32} + pmod(xxhash64(c), cast(ceil(m / {size}) as long))")
    return df.select("cell", part.alias("i"), part.alias("j"), "c", "comp", part.alias("block"), "m")


def _all_cells(rows: DataFrame, block: int) -> DataFrame:
    """All of the rows (``token, c, comp`` with the token's ``m, top, seen``): a cell for each token, or for each pair of
    blocks of the same or adjacent size buckets where the classes are too many or too large for one."""
    whole = f"m <= {block} and {_capacity('top', block)} >= {block}"
    # a class whose size fits none of the others' can't link: no adjacent bucket is seen, and no bucket holds two
    near = f"(seen & ((shiftleft(1L, s) >>> 1) | shiftleft(1L, s + 1))) <> 0 or bit_count(seen) < m"
    rows = rows.withColumn("s", F.expr(f"cast(pmod(c, {BUCKETS}) as int)")).where(near)
    zero = F.lit(0).cast("long")
    single = rows.where(whole).select(F.col("token").alias("cell"), zero.alias("i"), zero.alias("j"), "c", "comp", zero.alias("block"), "m")
    large = rows.where(f"not ({whole})")
    parts = large.groupBy("token", "s").agg(F.expr(f"cast(ceil(count(*) / {_capacity('s', block)}) as long)").alias("parts"))
    parts = parts.groupBy("token").agg(F.map_from_entries(F.collect_list(F.struct("s", "parts"))).alias("parts"))  # BUCKETS entries at most
    own = F.expr(f"s * {1 << 32} + pmod(xxhash64(c), parts[s])")
    others = F.expr(f"flatten(transform(array(s - 1, s, s + 1), t -> if(parts[t] is null, array(), transform(sequence(0L, parts[t] - 1), h -> t * {1 << 32} + h))))")
    split = large.join(parts, "token").select("token", "c", "comp", "m", own.alias("block"), F.explode(others).alias("other"))
    split = split.select(F.col("token").alias("cell"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "c", "comp", "block", "m")
    return single.unionByName(split)


def _open(known: DataFrame) -> DataFrame:
    """The rows of ``token, c, comp`` at tokens where several components meet, of equal groups of classes one, with the
    token's number of classes, largest size bucket and a bit for each bucket."""
    bucket = F.expr(f"cast(pmod(c, {BUCKETS}) as int)")
    tokens = known.groupBy("token").agg(
        F.min("comp").alias("a"), F.max("comp").alias("b"), F.count("*").alias("m"), F.max(bucket).cast("long").alias("top"), F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(c, {BUCKETS}) as int))")).alias("seen"),
        F.sum(F.xxhash64("c").cast("decimal(20,0)")).alias("x"), F.bit_xor(F.xxhash64("c", F.lit(1))).alias("y"),
    ).where("a <> b")
    tokens = tokens.groupBy("m", "x", "y").agg(F.min(F.struct("token", "top", "seen")).alias("t")).select("t.token", "m", "t.top", "t.seen")
    return written(known.join(tokens, "token"), "open")


def components(edges: DataFrame) -> DataFrame:
    """``id, comp`` for each end of an edge: its component's smallest id. Labels spread to neighbours and then jump to
    their label's label, until nothing changes; each round is written to the shared folder."""
    pairs = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("comp")).withColumn("old", F.col("id")), "labels")
    while True:
        now = labels.select("id", "comp")
        near = both.join(now, both.b == now.id).groupBy("a").agg(F.min("comp").alias("near"))
        spread = now.join(near, now.id == near.a).select("id", F.least("comp", "near").alias("comp"), F.col("comp").alias("old"))
        jump = now.select(F.col("id").alias("comp"), F.col("comp").alias("further"))
        new = written(spread.join(jump, "comp", "left").select("id", F.least("comp", F.coalesce("further", "comp")).alias("comp"), "old"), "labels")
        forget(labels)
        if new.where("comp <> old").isEmpty():
            forget(pairs)
            return new.select("id", "comp")
        labels = new


def _same_ids(real: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges between the classes of rows that share a doc_id."""
    several = written(real.groupBy("doc_id").agg(F.min("hi").alias("a"), F.max("hi").alias("b"), F.min("lo").alias("x"), F.max("lo").alias("y")).where("a <> b or x <> y").select("doc_id"), "several")
    rows = real.join(several, "doc_id", "left_semi").select("doc_id", "hi", "lo").distinct().join(classes.select("hi", "lo", "c"), ["hi", "lo"]).select("doc_id", "c")
    return rows.join(rows.groupBy("doc_id").agg(F.min("c").alias("a")), "doc_id").select("a", F.col("c").alias("b"))


def jaccard_components(df: DataFrame, text: str = "text", doc_id: str = "doc_id", block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row: the smallest doc_id that links of Jaccard 0.8 or more reach.

    Null, empty and blank texts have no shingles and are linked with nothing. Repeated rows are in one component. A doc_id
    is one document: rows that share it share their component, and if their texts differ it has the links of each of them.
    A row without a doc_id gets its size and a null component. Texts of any length are taken whole. Other columns are left
    out, whatever their names; an empty table gives an empty result.
    """
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("mark", F.xxhash64("text"))
    sets = written(scan(docs, frequent_shingles(docs, hot)), "sets")
    real = sets.where("n > 0 and doc_id is not null")

    # equal sets have equal prefixes and signatures; one row stands for the class, and numbers are fixed by writing them
    first = real.groupBy("hi", "lo").agg(F.min(F.struct("doc_id", "mark")).alias("w"), *[F.first(x).alias(x) for x in ("n", "rare", "frequent", "bitmap", "sketch")])
    number = F.expr(f"monotonically_increasing_id() * {BUCKETS} + least({BUCKETS - 1}, cast(floor(ln(n) / ln(1.25)) as long))")
    classes = written(first.select(number.alias("c"), "hi", "lo", "w.doc_id", "w.mark", "n", "rare", "frequent", "bitmap", "sketch"), "classes")

    # classes that meet at a shingle of their prefixes, and how many do. A shingle that isn't in the table of frequent ones
    # holds a small share of all; the table's own shingles are counted without bringing their rows together
    rare = classes.select(F.explode("rare").alias("token"), "c").withColumn("m", F.count("*").over(Window.partitionBy("token"))).where("m > 1")
    often = classes.select(F.explode("frequent").alias("token"), "c")
    often = often.join(F.broadcast(often.groupBy("token").agg(F.count("*").alias("m")).where("m > 1")), "token")  # at most ``hot`` rows
    met = written(rare.unionByName(often.select(*rare.columns)), "met")

    # each class at its fullest shingle
    home = met.groupBy("c").agg(F.max(F.struct("m", "token")).alias("x")).select("c", F.col("x.token").alias("cell"), "x.m", F.col("c").alias("comp"))
    edges = _same_ids(real, classes).unionByName(_joined(_home_cells(home, block), classes, docs, "first"))
    labels = components(edges)

    # shingles at which several components meet; equal cells are joined once
    known = written(met.select("token", "c").join(labels.withColumnRenamed("id", "c"), "c", "left").select("token", "c", F.coalesce("comp", "c").alias("comp")), "known")
    open_ = _open(known)

    # where more than a block's classes meet, first one of each component with those of the others
    full = open_.where(f"m > {block}")
    if not full.isEmpty():
        one = full.groupBy(F.col("token").alias("cell"), "comp").agg(F.min(F.struct(F.xxhash64("c", "token"), "c")).alias("x")).select("cell", "comp", "x.c")
        many = one.join(one.groupBy("cell").agg(F.count("*").alias("m")), "cell")
        edges = edges.unionByName(_joined(_home_cells(many, block), classes, docs, "second"))
        labels = components(edges).withColumnRenamed("id", "c").withColumnRenamed("comp", "new")
        open_ = _open(open_.select("token", "c", "comp").join(labels, "c", "left").select("token", "c", F.coalesce("new", "comp").alias("comp")))

    # then all of them
    edges = edges.unionByName(_joined(_all_cells(open_, block), classes, docs, "third"))
    final = components(edges)

    # documents take the smallest id that their class's component holds
    of_class = classes.select("c", "hi", "lo", "doc_id").join(final.withColumnRenamed("id", "c"), "c", "left").select("hi", "lo", "doc_id", F.coalesce("comp", "c").alias("comp"))
    least = of_class.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    placed = real.select("doc_id", "n", "hi", "lo").join(of_class.drop("doc_id").join(least, "comp"), ["hi", "lo"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    rest = sets.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return placed.unionByName(rest)


def oracle() -> str:
    """The same in DuckDB, on the shingles' strings: all pairs of classes with a common shingle, then reachability."""
    return r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents),
s as (select doc_id, list_sort(list_distinct(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')] else [array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)] end)) sh from w),
c as (select sh, min(doc_id) id, len(sh) n from s where len(sh) > 0 group by sh),
t as (select id, n, unnest(sh) token from c),
l as (select a.id a, b.id b from t a join t b on a.token = b.token and a.id < b.id and 5 * a.n >= 4 * b.n and 5 * b.n >= 4 * a.n group by a.id, b.id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e as (select a, b from l union all select b, a from l),
r as (select id a, id b from c union select r.a, e.b from r join e on r.b = e.a),
m as (select a id, min(b) least from r group by a)
select s.doc_id, cast(len(s.sh) as bigint) n_shingles, coalesce(m.least, s.doc_id) component_id from s left join c on s.sh = c.sh left join m on m.id = c.id
"""
