"""Problem 2: the most similar vectors for every vector.

An inverted multi-index: both halves of the unit vectors are quantised by codebooks of their own, a pair of centroids is
a cell. A cell of more than HOT vectors is indexed once more with codebooks of its own, fitted in the tasks on bounded samples: all such
cells of a level in two passes over the vectors, one that samples and one that counts, down to LEVELS levels.

Cells beside one another are gathered into regions of bounded size. Each vector traverses the cells by the sum of its own two
centroid distances: the first is its home, and it is also sent to the regions of those that follow, up to CELLS of an index and
no further than MARGIN beyond the first; a cell with an index of its own is traversed in the same way. Each region is one group of a shuffle, in
which the vectors at home are compared exactly with all that were sent there. Lists are made for each vector and not for a cell's
centre, for where cells are crowded a vector's neighbours lie across the border next to it, which the centre does not tell.

Codebooks are fitted on a bounded sample, every vector is indexed. What the driver holds, codebooks and counts of cells, grows with
the number of crowded cells. Vectors of a region larger than HOT, as one is whose leaf is still larger than that after all levels, are dealt to
several tasks, each of which compares its share with all that the region is sent. Of a vector with very many exact copies only the smallest ids are indexed, for
they are the neighbours of all the others.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from clauseloom.session import spread, table

MODEL, DIMENSIONS, NEIGHBOURS = "clausevec-384-r2", 384, 10
SAMPLE = 20_000  # vectors, about, that the codebooks are fitted on
CENTROIDS = 256  # at most, in each codebook
INNER_SAMPLE, INNER_CENTROIDS = 4_000, 32  # the same for cells that get an index of their own
CANDIDATES = 400  # vectors, at least, that each vector is compared with
CELLS = 8  # cells of an index, at most, that a vector is sent to, its own included: neighbours lie across a cell's border, too
BESIDE = 2  # the same in the index of a crowded cell that is not the vector's own
MARGIN = 0.02  # share by which the distance of such a cell may be beyond the nearest one's
REGION = 8_000  # own vectors of a region, at most, unless one cell has more; a twelfth of all in small collections
HOT = 8_000  # vectors of a cell from which it gets an index of its own
LEVELS = 5
BITS = (17, 11, 11, 11, 11)  # of a level's part of a leaf's number: the cell's number and 1, 0 below a leaf
SHIFTS = tuple(sum(BITS[i + 1 :]) for i in range(LEVELS))
COPIES = 1000  # copies of one vector that are indexed like others; beyond, the smallest ids are


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable vectors (DIMENSIONS finite values, not all zero) and the vectors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    at = np.flatnonzero((sizes == DIMENSIONS) & column.is_valid().to_numpy(zero_copy_only=False))
    if not len(at):
        return at, np.zeros((0, DIMENSIONS), np.float32)
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    x = values[column.offsets.to_numpy()[at][:, None] + np.arange(DIMENSIONS)]
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    return at[good], x[good]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vectors: DataFrame) -> DataFrame:
    """passage_id, embedding of the current model with the right number of values; see _matrix for the values."""
    return vectors.where((F.col("model") == MODEL) & F.col("passage_id").isNotNull() & (F.size("embedding") == DIMENSIONS)).select("passage_id", "embedding")


def fit_codebook(x: np.ndarray, k: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """k centroids of x (fewer if x has fewer rows): k-means from a seeded start, for the same x always the same."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    c = x[rng.choice(len(x), k, replace=False)].copy() if len(x) else np.zeros((1, DIMENSIONS // 2), np.float32)
    for _ in range(rounds if len(x) else 0):
        near = nearest(x, c)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=k)
        c = np.where(n[:, None] > 0, total / np.maximum(1, n)[:, None], c).astype(np.float32)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c**2).sum(1)[None, :] - 2.0 * (x @ c.T)).argmin(1)


@dataclass
class Index:
    """Codebooks of the two halves."""

    first: np.ndarray
    second: np.ndarray

    def cells(self, unit: np.ndarray) -> np.ndarray:
        half = unit.shape[1] // 2
        return nearest(unit[:, :half], self.first).astype(np.int64) * len(self.second) + nearest(unit[:, half:], self.second)


def _orders(points: np.ndarray, c: np.ndarray, own: bool = False) -> tuple[list[list[int]], list[list[float]]]:
    """For each point the centroids by distance, and the distances. own: the points are the centroids."""
    d = np.maximum(0, (points**2).sum(1)[:, None] - 2 * points @ c.T + (c**2).sum(1)[None, :])
    if own:
        np.fill_diagonal(d, -1e-6)  # its own centroid comes first, also among equal ones
    order = np.argsort(d, axis=1, kind="stable")
    return order.tolist(), np.take_along_axis(d, order, 1).tolist()


def _traversed(a: list[int], da: list[float], b: list[int], db: list[float], width: int, counts: dict[int, int], candidates: int, cells: int, without: int = -1) -> list[int]:
    """Cells with vectors in the order of summed centroid distance, until they hold `candidates` vectors besides the one
    that asks and are `cells` (or are all); the cell `without` is passed over."""
    heap, held, listed, total = [(da[0] + db[0], 0, 0)], 0, [], len(counts) - (without in counts)
    done = [0] * len(a)  # how many columns of each row of the grid have been taken
    while heap and (held <= candidates or len(listed) < cells) and len(listed) < total:
        _, p, q = heapq.heappop(heap)
        done[p] = q + 1
        cell = a[p] * width + b[q]
        n = counts.get(cell)
        if n and cell != without:
            held += n
            listed.append(cell)
        # a pair is pushed when the later of the two pairs before it is taken
        if q + 1 < len(b) and (p == 0 or done[p - 1] > q + 1):
            heapq.heappush(heap, (da[p] + db[q + 1], p, q + 1))
        if p + 1 < len(a) and done[p + 1] >= q:
            heapq.heappush(heap, (da[p + 1] + db[q], p + 1, q))
    return listed


def traversals(index: Index, counts: dict[int, int], candidates: int, cells: int = CELLS) -> dict[int, list[int]]:
    """For each cell with vectors the cells with vectors, itself first, in the order of summed centroid distance, until
    they hold `candidates` vectors besides the one that asks and are `cells` (or are all)."""
    width = len(index.second)
    (o1, d1), (o2, d2) = _orders(index.first, index.first, True), _orders(index.second, index.second, True)
    return {cell: _traversed(o1[i], d1[i], o2[j], d2[j], width, counts, candidates, cells) for cell in counts for i, j in [divmod(cell, width)]}


Path = tuple[int, ...]


def key(path: Path) -> int:
    """The number of a leaf or hot cell, given by the cells that lead to it; the leaves of a hot cell follow its own number."""
    return sum((c + 1) << SHIFTS[i] for i, c in enumerate(path))


def path_of(number: int) -> Path:
    cells = [(number >> SHIFTS[i] & (1 << BITS[i]) - 1) - 1 for i in range(LEVELS)]
    return tuple(c for c in cells if c >= 0)


def end(number: int) -> int:
    """The first number beyond the leaves of a cell."""
    return number + (1 << SHIFTS[len(path_of(number)) - 1])


def leaves(tree: dict[Path, Index], unit: np.ndarray, path: Path = ()) -> np.ndarray:
    """The number of the leaf that each vector of a cell of the tree lies in."""
    cells = tree[path].cells(unit)
    out = key(path) + (cells + 1 << SHIFTS[len(path)])
    for inner in tree:
        if len(inner) == len(path) + 1 and inner[:-1] == path:
            here = np.flatnonzero(cells == inner[-1])
            if len(here):
                out[here] = leaves(tree, unit[here], inner)
    return out


@dataclass
class Cells:
    """What the cells of an index hold: 0 nothing, 1 vectors, 2 an index of their own."""

    kind: np.ndarray
    filled: np.ndarray

    @staticmethod
    def of(tree: dict[Path, Index], counts: dict[Path, dict[int, int]]) -> dict[Path, Cells]:
        out = {}
        for path, index in tree.items():
            kind = np.zeros(len(index.first) * len(index.second), np.int8)
            kind[[c for c, m in counts[path].items() if m]] = 1
            kind[[p[-1] for p in tree if len(p) == len(path) + 1 and p[:-1] == path]] = 2
            out[path] = Cells(kind, np.flatnonzero(kind))
        return out


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x**2).sum(1)[:, None] - 2 * (x @ c.T) + (c**2).sum(1)[None, :])


def probed(tree: dict[Path, Index], cells: dict[Path, Cells], unit: np.ndarray, path: Path = (), home: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of vectors, the leaves below `path` that each traverses, and whether this is its home. home: for which of the vectors the
    first leaf is. A vector's first pairs are among the first of either codebook, so a corner of the grid is enough."""
    if home is None:
        home = np.ones(len(unit), bool)
    index, held, half = tree[path], cells[path], unit.shape[1] // 2
    d, o = [], []
    for x, c in ((unit[:, :half], index.first), (unit[:, half:], index.second)):
        all_ = _distances(x, c)
        near = np.argpartition(all_, 2 * CELLS - 1, axis=1)[:, : 2 * CELLS] if len(c) > 2 * CELLS else np.tile(np.arange(len(c)), (len(x), 1))
        d.append(np.take_along_axis(all_, near, 1))
        o.append(near)
    cell = (o[0][:, :, None] * len(index.second) + o[1][:, None, :]).reshape(len(unit), -1)
    far = (d[0][:, :, None] + d[1][:, None, :]).reshape(len(unit), -1)
    far[held.kind[cell] == 0] = np.inf
    order = np.argsort(far, axis=1, kind="stable")[:, :CELLS]
    cell, far = np.take_along_axis(cell, order, 1), np.take_along_axis(far, order, 1)
    for r in np.flatnonzero(np.isinf(far[:, 0])).tolist():  # all of the corner is empty
        a, b = (_distances(x[None, :], c)[0] for x, c in ((unit[r, :half], index.first), (unit[r, half:], index.second)))
        all_ = a[held.filled // len(index.second)] + b[held.filled % len(index.second)]
        cell[r, 0], far[r, 0] = held.filled[all_.argmin()], all_.min()
    listed = far <= far[:, :1] * (1 + MARGIN)
    listed[~home, BESIDE:] = False
    row, rank = np.nonzero(listed)
    cell, first = cell[row, rank], home[row] & (rank == 0)
    hot = held.kind[cell] == 2
    rows, found, firsts = [row[~hot]], [key(path) + (cell[~hot].astype(np.int64) + 1 << SHIFTS[len(path)])], [first[~hot]]
    row, cell, first = row[hot], cell[hot], first[hot]
    by = np.argsort(cell, kind="stable")
    for at in np.split(by, np.flatnonzero(np.diff(cell[by])) + 1) if len(by) else []:
        r, f, h = probed(tree, cells, unit[row[at]], (*path, int(cell[at[0]])), first[at])
        rows.append(row[at][r])
        found.append(f)
        firsts.append(h)
    return np.concatenate(rows), np.concatenate(found), np.concatenate(firsts)


def regions(tree: dict[Path, Index], counts: dict[Path, dict[int, int]], candidates: int, most: int) -> dict[int, int]:
    """The region of each leaf: leaves are joined with those beside them, the nearest first, up to `most` vectors; regions of
    fewer than `candidates` with the nearest that is less than twice as large as that, else with the nearest."""
    size = {key((*path, c)): m for path in tree for c, m in counts[path].items() if (*path, c) not in tree}
    leaf = list(size)
    parent = {c: c for c in size}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    def join(a: int, b: int) -> None:
        parent[max(a, b)] = min(a, b)
        size[min(a, b)] = size[a] + size[b]

    # what lies beside each leaf: cells of its own index, then of those around it; of a cell with an index the leaf nearest to the asking one
    around = {path: traversals(index, counts[path], candidates, 2 * CELLS) for path, index in tree.items()}
    beside: dict[int, list[int]] = {}
    asking: dict[Path, list[tuple[int, int, Path, int]]] = {}
    for path in tree:
        for x in counts[path]:
            if (*path, x) not in tree:
                c = key((*path, x))
                listed = [(*p[:-1], y) for p in [(*path, x)[: i + 1] for i in range(len(path), -1, -1)] for y in around[p[:-1]][p[-1]][1:]]
                beside[c] = [key(y) for y in listed]
                for place, y in enumerate(listed):
                    if y in tree:
                        asking.setdefault(y, []).append((c, place, path, x))
    for at in sorted(tree, key=len):  # from the outer indexes to the inner
        asks = asking.get(at, [])
        index, there = tree[at], np.array(sorted(counts[at]), np.int64)
        for k in range(0, len(asks) if len(there) else 0, 4096):
            some = asks[k : k + 4096]
            ij = [divmod(x, len(tree[path].second)) for _, _, path, x in some]
            d = _distances(np.stack([tree[path].first[i] for (_, _, path, _), (i, _) in zip(some, ij)]), index.first)[:, there // len(index.second)]
            d += _distances(np.stack([tree[path].second[j] for (_, _, path, _), (_, j) in zip(some, ij)]), index.second)[:, there % len(index.second)]
            for (c, place, path, x), y in zip(some, there[d.argmin(1)].tolist()):
                beside[c][place] = key((*at, y))
                if (*at, y) in tree:
                    asking.setdefault((*at, y), []).append((c, place, path, x))
    for rank in range(max([len(x) for x in beside.values()], default=0)):
        for c, listed in beside.items():
            if rank < len(listed):
                a, b = root(c), root(listed[rank])
                if a != b and size[a] + size[b] <= most:
                    join(a, b)
    for c, listed in beside.items():
        if size[root(c)] < candidates:
            others = [b for b in map(root, listed) if b != root(c)]
            if others:
                join(root(c), next((b for b in others if size[b] <= 2 * most), others[0]))
    return {c: root(c) for c in leaf}


def nearest_in(queries: np.ndarray, query_ids: np.ndarray, others: np.ndarray, other_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ids, smaller first: for each query its k most similar others by cosine rounded to six decimals, of equal
    ones the smaller id. A query is not its own neighbour."""
    if len(other_ids) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    q, o = _unit(queries), _unit(others)
    exact = others.astype(np.float64)
    exact /= np.linalg.norm(exact, axis=1, keepdims=True)
    own = queries.astype(np.float64)
    own /= np.linalg.norm(own, axis=1, keepdims=True)
    keep = min(len(o), k + 1)
    left, right = [], []
    step = max(16, min(1024, 2**24 // len(o)))
    for at in range(0, len(q), step):
        s = q[at : at + step] @ o.T
        floor = np.partition(s, len(o) - keep, axis=1)[:, len(o) - keep] - 2e-6  # all that may tie with the last
        row, col = np.divmod(np.flatnonzero(s >= floor[:, None]), len(o))
        other = query_ids[at + row] != other_ids[col]
        row, col = row[other], col[other]
        sim = np.round(np.einsum("ij,ij->i", own[at + row], exact[col]), 6)
        order = np.lexsort((other_ids[col], -sim, row))
        row, col = row[order], col[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        row, col = row[rank < k], col[rank < k]
        left.append(query_ids[at + row])
        right.append(other_ids[col])
    a, b = np.concatenate(left), np.concatenate(right)
    return np.minimum(a, b), np.maximum(a, b)


def _packed(x: np.ndarray) -> pa.Array:
    """Vectors as bytes, none of which lose anything: if the values are whole multiples of a power of two, about one byte a value (a
    byte for the power, the values, then place and value of those beyond a byte), else two if that is enough, else four."""
    with np.errstate(over="ignore", invalid="ignore"):
        half = x.astype(np.float16)
        power = next((p for p in range(16) if len(x) and (x[0] * 2.0**p == np.rint(x[0] * 2.0**p)).all()), 0)
        whole = x * np.float32(2.0**power)
        small = (whole == np.rint(whole)).all(1) & (np.abs(whole) < 2**15).all(1)
    whole = np.where(small[:, None], whole, 0).astype(np.int16)
    row, place = np.nonzero((whole > 127) | (whole < -128))
    beyond = np.stack([place.astype(np.int16), whole[row, place]], axis=1)
    ends = np.cumsum(np.bincount(row, minlength=len(x)))
    head = bytes([power])
    out = []
    for i, (s, f) in enumerate(zip(small & (np.diff(ends, prepend=0) < DIMENSIONS // 4), (half.astype(np.float32) == x).all(1))):
        if s:
            out.append(head + whole[i].astype(np.int8).tobytes() + beyond[ends[i - 1] if i else 0 : ends[i]].tobytes())
        else:
            out.append(half[i].tobytes() if f else x[i].astype(np.float32).tobytes())
    return pa.array(out, pa.binary())


def _unpacked(column: pa.Array) -> np.ndarray:
    out = np.empty((len(column), DIMENSIONS), np.float32)
    for i, b in enumerate(column.to_pylist()):
        if len(b) % 2:
            out[i] = np.frombuffer(b, np.int8, DIMENSIONS, 1)
            beyond = np.frombuffer(b[1 + DIMENSIONS :], np.int16).reshape(-1, 2)
            out[i, beyond[:, 0]] = beyond[:, 1]
            out[i] *= np.float32(2.0 ** -b[0])
        else:
            out[i] = np.frombuffer(b, np.float16 if len(b) == 2 * DIMENSIONS else np.float32)
    return out


def _indexed(rows: DataFrame, tree: dict[Path, Index], counts: dict[Path, dict[int, int]], open_: dict[Path, int]) -> None:
    """Adds to the tree an index for each of the open cells (all on one level, with their numbers of vectors, about), and to the
    counts how many vectors each of its cells holds."""
    spark = rows.sparkSession
    root = () in open_
    most, centroids = (SAMPLE, CENTROIDS) if root else (INNER_SAMPLE, INNER_CENTROIDS)
    plan = spark.sparkContext.broadcast((tree, {key(p): (int(min(1.0, most / max(1, m)) * 2**53), int(min(centroids, max(1, round((m / 20) ** 0.5 * 2))))) for p, m in open_.items()}))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, shares = plan.value
        for b in batches:
            at, x = _matrix(b.column(1))
            ids = b.column(0).to_numpy()[at]
            cell = leaves(tree, _unit(x)) if tree else np.zeros(len(x), np.int64)
            share = np.array([shares.get(c, (0, 0))[0] for c in cell.tolist()], np.uint64)
            keep = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(11)) < share
            yield pa.RecordBatch.from_arrays([pa.array(cell[keep]), pa.array(ids[keep], pa.int64()), _packed(x[keep])], ["cell", "id", "v"])

    def fit(rows: pa.Table) -> pa.Table:
        cell, half = rows.column("cell")[0].as_py(), DIMENSIONS // 2
        x = _unit(_unpacked(rows.column("v").combine_chunks().take(pa.array(np.argsort(rows.column("id").to_numpy(), kind="stable")))))
        size = plan.value[1][cell][1]
        books = [fit_codebook(part, size) for part in (x[:, :half], x[:, half:])]
        return pa.table([pa.array([cell]), *[pa.array([c.astype(np.float32).tobytes()], pa.binary()) for c in books]], ["cell", "a", "b"])

    codebooks = rows.mapInArrow(sample, "cell long, id long, v binary").groupBy("cell").applyInArrow(fit, "cell long, a binary, b binary")
    for r in codebooks.toLocalIterator():
        tree[path_of(r["cell"])] = Index(*(np.frombuffer(c, np.float32).reshape(-1, DIMENSIONS // 2) for c in (r["a"], r["b"])))
    for p in open_:
        if p not in tree:  # the sample came out empty
            tree[p] = Index(*(np.zeros((1, DIMENSIONS // 2), np.float32) for _ in range(2)))
    grown = spark.sparkContext.broadcast((tree, len(next(iter(open_)))))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, level = grown.value
        for b in batches:
            c, m = np.unique(leaves(tree, _unit(_matrix(b.column(1))[1])), return_counts=True)
            new = (c >> SHIFTS[level] & (1 << BITS[level]) - 1) > 0  # on the level of the open cells
            yield pa.RecordBatch.from_arrays([pa.array(c[new], pa.int64()), pa.array(m[new], pa.int64())], ["cell", "n"])

    for p in open_:
        counts[p] = {}
    for r in rows.mapInArrow(cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toLocalIterator():
        *p, c = path_of(r["cell"])
        counts[tuple(p)][c] = r["n"]


def _places(spark: SparkSession, n: int) -> list[int]:
    """n numbers that a shuffle over n parts sends to the parts 0, 1, and so on."""
    found: dict[int, int] = {}
    start, step = 0, 8 * n + 64
    while len(found) < n:
        for r in spark.range(start, start + step).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("p")).toLocalIterator():
            found.setdefault(r["p"], r["id"])
        start += step
    return [found[i] for i in range(n)]


def _search(rows: DataFrame, n: int, k: int, candidates: int) -> DataFrame:
    """Pairs for the rows (passage_id, embedding; each id once); n: how many they are, about."""
    tree: dict[Path, Index] = {}
    counts: dict[Path, dict[int, int]] = {}
    open_: dict[Path, int] = {(): n}
    while open_:
        _indexed(rows, tree, counts, open_)
        open_ = {(*p, c): m for p in open_ if len(p) + 1 < LEVELS for c, m in counts[p].items() if m > HOT}
    cells = Cells.of(tree, counts)
    own = regions(tree, counts, candidates, min(REGION, max(2000, n // 12)))
    size: dict[int, int] = {}
    for path in tree:
        for c, m in counts[path].items():
            if (*path, c) not in tree:
                size[own[key((*path, c))]] = size.get(own[key((*path, c))], 0) + m
    tasks: dict[tuple[int, int], int] = {}  # a region, or a share of one too large for one task
    shares = {r: -(-m // HOT) for r, m in size.items()}
    for r in shares:
        for i in range(shares[r]):
            tasks[r, i] = len(tasks)
    parts = min(20_000, len(tasks))
    label = _places(rows.sparkSession, parts)
    leaf = np.array(sorted(own), np.int64)
    share = np.array([shares[own[c]] for c in leaf.tolist()], np.int64)
    start = np.array([tasks[own[c], 0] for c in leaf.tolist()], np.int64)
    plan = rows.sparkSession.sparkContext.broadcast((tree, cells, leaf, share, start, np.array(label, np.int64)))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, cells, leaf, share, start, label = plan.value
        for b in batches:
            at, x = _matrix(b.column(1))
            ids = b.column(0).to_numpy()[at].astype(np.int64)
            row, found, home = probed(tree, cells, _unit(x))
            place = np.searchsorted(leaf, found)
            n = share[place]  # what a region of several tasks is sent goes to each of these; a vector is at home in one
            row, home, first, n_ = np.repeat(row, n), np.repeat(home, n), np.repeat(start[place], n), np.repeat(n, n)
            i = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            home &= ids[row] % n_ == i
            order = np.lexsort((~home, first + i, row))
            row, task, home = row[order], (first + i)[order], home[order]
            once = np.append(True, (row[1:] != row[:-1]) | (task[1:] != task[:-1]))[: len(row)]
            row, task, home = row[once], task[once], home[once]
            yield pa.RecordBatch.from_arrays(
                [pa.array(label[task % len(label)]), pa.array(task), pa.array(home), pa.array(ids[row]), _packed(x).take(pa.array(row))],
                ["part", "task", "home", "id", "v"],
            )

    def compare(rows: pa.Table) -> pa.Table:
        home = rows.column("home").to_numpy()
        ids = rows.column("id").to_numpy()
        order = np.lexsort((~home, ids))
        order = order[np.append(True, np.diff(ids[order]) != 0)]  # equal rows once
        home, ids = home[order], ids[order]
        x = _unpacked(rows.column("v").combine_chunks().take(pa.array(order)))
        a, b = nearest_in(x[home], ids[home], x, ids, k) if home.any() else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return pa.table([pa.array(a), pa.array(b)], ["passage_id_a", "passage_id_b"])

    routed = rows.mapInArrow(route, "part long, task long, home boolean, id long, v binary")
    return routed.repartition(parts, "part").groupBy("part", "task").applyInArrow(compare, "passage_id_a long, passage_id_b long")


def most_similar(vectors: DataFrame, k: int = NEIGHBOURS, candidates: int = CANDIDATES) -> DataFrame:
    """passage_id_a < passage_id_b where one is among the other's k most similar usable vectors, each pair once.

    Vectors that are null, too short, all zero, not finite or of another model are not usable. Equal rows count once; of
    different vectors under one id, the one with the smallest hash."""
    rows = spread(usable(vectors))
    hashed = rows.select("passage_id", F.xxhash64("embedding").alias("h"))
    ids = hashed.groupBy("passage_id").agg(F.min("h").alias("h"), F.max("h").alias("_h2"))
    spark = vectors.sparkSession
    facts = ids.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((F.col("h") != F.col("_h2")).cast("long")), F.lit(0)).alias("torn")).first()
    n = facts["n"]
    if n < 2:
        return spark.createDataFrame([], "passage_id_a long, passage_id_b long")
    # vectors with very many copies: no more than n / (number of copies) of them, so the table is small
    least = max(COPIES, n // 5000)
    copies = ids.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least).select("h")
    many = [r["h"] for r in copies.collect()]
    plain = None
    if facts["torn"]:  # ids with different vectors
        kept = ids.where(F.col("h") != F.col("_h2")).select("passage_id", F.col("h").alias("_kept"))
        rows = rows.join(kept, "passage_id", "left").where(F.col("_kept").isNull() | (F.col("_kept") == F.xxhash64("embedding"))).select("passage_id", "embedding")
    if many:
        marks = F.broadcast(spark.createDataFrame([(h,) for h in many], "h long"))
        copied = ids.select("passage_id", "h").join(marks, "h")
        smallest = F.broadcast(_smallest(copied, k + 1))
        rest = copied.join(smallest, "h").where(~F.array_contains("s", F.col("passage_id")))
        plain = rest.select("passage_id", F.explode(F.slice("s", 1, k)).alias("o")).select(
            F.least("passage_id", "o").alias("passage_id_a"), F.greatest("passage_id", "o").alias("passage_id_b")
        )
        rows = rows.withColumn("h", F.xxhash64("embedding")).join(smallest, "h", "left").where(F.col("s").isNull() | F.array_contains("s", F.col("passage_id"))).select("passage_id", "embedding")
    out = _search(rows, n, k, candidates)
    return (out if plain is None else out.unionByName(plain)).distinct()


def _smallest(copied: DataFrame, k: int) -> DataFrame:
    """h, s: the k smallest ids of each hash, kept in parts of the ids first, so that no group is collected whole."""
    salted = copied.withColumn("_salt", F.pmod(F.xxhash64("passage_id"), F.lit(256)))
    for keys in (["h", "_salt"], ["h"]):
        w = Window.partitionBy(*keys).orderBy("passage_id")
        salted = salted.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    return salted.groupBy("h").agg(F.array_sort(F.collect_list("passage_id")).alias("s"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return most_similar(table(spark, sf_dir, "passage_vectors"))
