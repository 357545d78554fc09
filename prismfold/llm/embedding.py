"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors are rotated (random signs and Hadamard steps: the same bits wherever it is computed) and split into
low-dimensional blocks. A pair with cosine >= t has squared distance <= 2 - 2t; the blocks get shares of this
budget in proportion to their energy, so a linked pair is within the budget of at least one block. Each block is
range-joined: its space is cut into cells on its widest axes, a vector is at home in one cell and a guest in
those later cells that lie within the block's radius. Pairs within the block's budget are verified by cosine in
double precision, and a pair counts in the first block whose budget it meets, so no pair counts twice and no pair
table is shuffled: a task sends on, per vector, a number of links and the edges of a spanning forest.

Within a cell, vectors are swept along a further axis: only those within the radius there are held against each
other. Equal vectors are one class, with their number as weight. Cells are cut into slices of `SLICE` home vectors; the
cell's vectors stream past each slice, so one cell's population bounds no task's memory.

Null, zero, or non-finite vectors link with nothing and are their own components; so do vectors whose length
differs from the others' (each length is compared within itself). Null ids count as the smallest id. Repeated
rows are vectors of their own, one for each row, linked as copies. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, components, id_key, materialise

COSINE = 0.95
BLOCK_DIMS, SLICE = 8, 16384
#: Over the rounding of a single-precision squared distance of block parts of unit vectors.
MARGIN = 4e-6
#: Axes of a block on which cells are cut.
CELL_AXES = 2


def rotation_signs(n: int) -> np.ndarray:
    return np.where(np.random.default_rng(7).random((2, n)) < 0.5, -1.0, 1.0)


def rotate(unit: np.ndarray) -> np.ndarray:
    """Rows padded to a power of two and rotated by elementwise steps only, so results do not depend on the batch."""
    d = unit.shape[1]
    n = 1 << max(3, (d - 1).bit_length())
    x = np.zeros((len(unit), n))
    x[:, :d] = unit
    for signs in rotation_signs(n):
        x = x * signs
        h = 1
        while h < n:
            y = x.reshape(len(x), -1, 2, h)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
            h *= 2
        x = x / np.sqrt(n)
    return x


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def stack(column: pa.Array) -> np.ndarray:
    """The vectors, each times a power of two, which changes no cosine, so that its squares neither vanish nor overflow."""
    v = np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, initial=0))[1][:, None])


def cosine_of_pairs(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, y) / (nx * ny)


class Blocks:
    """Budgets, cell axes and cell widths of the blocks."""

    def __init__(self, energy: np.ndarray, spread: np.ndarray, cosine: float):
        self.count = len(energy) // BLOCK_DIMS
        total = energy.reshape(self.count, BLOCK_DIMS).sum(axis=1)
        share = np.maximum(total, total.sum() * 1e-3 + 1e-12)
        self.budget = (2 - 2 * cosine + 1e-9) * share / share.sum()
        self.radius = np.sqrt(self.budget) * (1 + 1e-9)
        self.axes = [np.sort(np.argsort(-spread[b * BLOCK_DIMS : (b + 1) * BLOCK_DIMS], kind="stable")[:CELL_AXES]) + b * BLOCK_DIMS for b in range(self.count)]
        #: Cells have twelve bits for each axis; wider ones than the radius asks for are right as well.
        self.width = np.maximum(2 * self.radius, 1 / 1024)
        #: The widest axis that cells are not cut on: within a cell, vectors are swept along it.
        self.sweep = [max((a for a in range(b * BLOCK_DIMS, (b + 1) * BLOCK_DIMS) if a not in self.axes[b]), key=lambda a: spread[a]) for b in range(self.count)]

    def cells(self, r: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Cell coordinates, and places within the cells, from 0 to the width."""
        scaled = r[:, self.axes[b]]
        cell = np.floor(scaled / self.width[b])
        return cell.astype(np.int64), scaled - cell * self.width[b]

    def key(self, cell: np.ndarray, b: int) -> np.ndarray:
        out = np.full(len(cell), b, np.int64)
        for c in cell.T:
            out = out * 4096 + (c + 2048)
        return out

    def copies(self, r: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
        """(block, rows, cell keys, home?) for the home cells and the later cells in reach."""
        for b in range(self.count):
            cell, at = self.cells(r, b)
            yield b, np.arange(len(r)), self.key(cell, b), True
            reach = self.radius[b] * (1 + 1e-9) + 1e-12
            for step in np.ndindex(*[3] * CELL_AXES):
                move = np.array(step) - 1
                if tuple(move) <= (0,) * CELL_AXES:
                    continue
                near = np.ones(len(r), bool)
                for k, m in enumerate(move):
                    near &= (at[:, k] <= reach) if m < 0 else (at[:, k] >= self.width[b] - reach) if m > 0 else True
                rows = np.flatnonzero(near)
                if len(rows):
                    yield b, rows, self.key(cell[rows] + move, b), False


class Forest:
    """Union-find over local indices; keeps the edges that joined two trees."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        root = x
        while (p := self.parent.get(root, root)) != root:
            root = p
        while (p := self.parent.get(x, x)) != root:
            self.parent[x], x = root, p
        return root

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            r, s = self.find(x), self.find(y)
            if r != s:
                self.parent[max(r, s)] = min(r, s)
                self.edges.append((x, y))


def _join_slices(blocks: Blocks, cosine: float):
    """Streams each (cell, slice): first its home vectors, then all vectors of the cell."""

    def pairs(home: dict, other: dict, b: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        lo, hi, reach = b * BLOCK_DIMS, (b + 1) * BLOCK_DIMS, blocks.radius[b] * (1 + 1e-9) + 1e-12
        along, across = home["r"][:, blocks.sweep[b]], other["r"][:, blocks.sweep[b]]  # both ascending
        # One single-precision product gives minus half the squared distances; its rounding is far below the margin.
        x, y = home["r"][:, lo:hi], other["r"][:, lo:hi]
        x = np.column_stack([x, -0.5 * (x**2).sum(axis=1), np.ones(len(x))]).astype(np.float32)
        y = np.ascontiguousarray(np.column_stack([y, np.ones(len(y)), -0.5 * (y**2).sum(axis=1)]).astype(np.float32).T)
        least = np.float32(-0.5 * blocks.budget[b] - MARGIN)
        for a in range(0, len(x), 256):
            first, last = np.searchsorted(across, along[a] - reach), np.searchsorted(across, along[min(a + 255, len(x) - 1)] + reach, "right")
            if first == last:
                continue
            i, j = np.divmod(np.flatnonzero(x[a : a + 256] @ y[:, first:last] >= least), last - first)
            j += first
            # Two home vectors of a cell meet twice, as home and as passer-by: once is enough.
            once = other["guest"][j] | (home["id"][i + a] < other["id"][j])
            i, j = i[once], j[once]
            for c in range(0, len(i), 1 << 16):
                p, q = i[c : c + (1 << 16)] + a, j[c : c + (1 << 16)]
                ok = cosine_of_pairs(home["v"][p], home["n"][p], other["v"][q], other["n"][q]) >= cosine
                p, q = p[ok], q[ok]
                gap = ((home["r"][p] - other["r"][q]) ** 2).reshape(len(p), blocks.count, BLOCK_DIMS).sum(axis=2)
                own = (gap <= blocks.budget).argmax(axis=1) == b
                yield p[own], q[own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, home, swept, forest, links = None, None, False, Forest(), {}
        out = lambda a, b, n: pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["id", "to", "n"])

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal forest, links
            if links:
                yield out(list(links), [None] * len(links), list(links.values()))
            if forest.edges:
                a, b = zip(*forest.edges, strict=True)
                yield out(a, b, [0] * len(a))
            forest, links = Forest(), {}

        def add(ids: np.ndarray, n: np.ndarray) -> None:
            u, place = np.unique(ids, return_inverse=True)
            for x, k in zip(u.tolist(), np.bincount(place, n).astype(np.int64).tolist(), strict=True):
                links[x] = links.get(x, 0) + k

        for batch in batches:
            cell, part, kind = (batch.column(i).to_numpy() for i in range(3))
            change = np.flatnonzero((np.diff(cell) != 0) | (np.diff(part) != 0) | ((np.diff(kind) != 0) & (kind[1:] == 1))) + 1
            for x, y in zip([0, *change], [*change, batch.num_rows], strict=True):
                if y == x:
                    continue
                rows = batch.slice(x, y - x)
                v = stack(rows.column(5))
                n = norms(v)
                now = {"id": rows.column(3).to_numpy(), "w": rows.column(4).to_numpy(), "v": v, "n": n, "r": rotate(v / n[:, None]), "guest": kind[x:y] == 2}
                here = (int(cell[x]), int(part[x]))
                if here != key:
                    yield from flush()
                    key, home, swept = here, None, False
                if kind[x] == 0:
                    home = now if home is None else {k: np.concatenate([home[k], now[k]]) for k in now}
                elif home is not None:
                    b = here[0] >> (12 * CELL_AXES)
                    if not swept:
                        order, swept = np.argsort(home["r"][:, blocks.sweep[b]], kind="stable"), True
                        home = {k: v[order] for k, v in home.items()}
                    order = np.argsort(now["r"][:, blocks.sweep[b]], kind="stable")
                    now = {k: v[order] for k, v in now.items()}
                    for p, q in pairs(home, now, b):
                        if len(p):
                            add(home["id"][p], now["w"][q])
                            add(now["id"][q], home["w"][p])
                            forest.add(home["id"][p], now["id"][q])
        yield from flush()

    return run


def link_vectors(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept of each vector."""
    base = vectors.select(F.col(id_col).alias("vec_id"), id_key(id_col).alias("k"), F.col(column).cast("array<double>").alias("v"))
    fine = "v IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)"
    base = base.withColumn("v", F.expr(f"CASE WHEN {fine} THEN transform(v, x -> x + 0.0D) END"))
    classes = materialise(base.where("v IS NOT NULL").groupBy("v").agg(F.min("k").alias("id"), F.count("*").alias("w")), "vector-classes")
    lengths = [r[0] for r in classes.select(F.size("v")).distinct().collect()]
    found = None
    for d in lengths:
        part = _links_of_length(classes.where(F.size("v") == d), cosine)
        found = part if found is None else found.union(part)
    if found is None:
        return base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("k").alias("component_id"), F.lit(True).alias("kept"))
    found = materialise(found, "vector-links")
    tree = components(found.where("to IS NOT NULL").select(F.col("id").alias("a"), F.col("to").alias("b")), "vector-components")
    counts = found.where("to IS NULL").groupBy("id").agg(F.sum("n").alias("others"))
    known = classes.join(counts, "id", "left").join(tree.withColumnRenamed("node", "id"), "id", "left").select("v", F.col("w").alias("__w"), F.coalesce("others", F.lit(0)).alias("others"), F.coalesce("component", "id").alias("component"))
    out = base.join(known, "v", "left")
    component = F.coalesce("component", "k")
    return out.select(
        "vec_id",
        F.coalesce(F.col("others") + F.col("__w") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.when(component != NULL_ID, component).alias("component_id"),
        (F.col("k") == component).alias("kept"),
    )


def _links_of_length(classes: DataFrame, cosine: float) -> DataFrame:
    # The bytes of a vector travel, not its array: Arrow hands them over whole.
    packed = classes.select("id", "w", "v").mapInArrow(_pack, "id long, w long, v binary")

    def energies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, 0.0, 0.0
        for b in batches:
            if b.num_rows:
                v = stack(b.column(2))
                r = rotate(v / norms(v)[:, None])
                n, s, q = n + len(r), s + r.sum(axis=0), q + (r**2).sum(axis=0)
        if n:
            yield pa.record_batch([pa.array(np.arange(len(s)), pa.int32()), pa.array([n] * len(s), pa.int64()), pa.array(s), pa.array(q)], names=["axis", "n", "s", "q"])

    sums = packed.mapInArrow(energies, "axis int, n long, s double, q double").groupBy("axis").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).orderBy("axis").collect()
    n, s, q = (np.array([r[c] for r in sums], float) for c in ("n", "s", "q"))
    blocks = Blocks(np.round(q / n - (s / n) ** 2, 6), np.round(q / n - (s / n) ** 2, 6), cosine)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = stack(b.column(2))
                u, c = np.unique(np.concatenate([k for _, _, k, home in blocks.copies(rotate(v / norms(v)[:, None])) if home]), return_counts=True)
                yield pa.record_batch([pa.array(u), pa.array(c, pa.int64())], names=["cell", "n"])

    # At most 64^axes cells a block: unit vectors end at 1, cells are wider than 1/32 for usual thresholds.
    homes = packed.mapInArrow(places, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    parts = {r["cell"]: -(-r["n"] // SLICE) for r in homes}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, v = b.column(0).to_numpy(), stack(b.column(2))
            for _, rows, cells, home in blocks.copies(rotate(v / norms(v)[:, None])):
                many = np.array([parts.get(c, 0) for c in cells.tolist()], np.int64)
                groups = [(rows, cells, (ids[rows].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % np.maximum(many, 1), 0)] if home else []
                again = np.repeat(np.arange(len(rows)), many)
                first = np.cumsum(many) - many
                groups.append((rows[again], cells[again], np.arange(len(again)) - first[again], 1 if home else 2))
                for r, c, p, kind in groups:
                    t = pa.array(r)
                    yield pa.record_batch([pa.array(c), pa.array(p, pa.int64()), pa.array(np.full(len(r), kind), pa.int32()), b.column(0).take(t), b.column(1).take(t), b.column(2).take(t)], names=["cell", "part", "kind", "id", "w", "v"])

    dealt = packed.mapInArrow(deal, "cell long, part long, kind int, id long, w long, v binary")
    ordered = dealt.repartition("cell", "part").sortWithinPartitions("cell", "part", "kind")
    return ordered.mapInArrow(_join_slices(blocks, cosine), "id long, to long, n long")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            v = np.asarray(b.column(2).flatten(), np.float64).reshape(b.num_rows, -1)
            yield pa.record_batch([b.column(0), b.column(1), pa.array([x.tobytes() for x in v], pa.binary())], names=["id", "w", "v"])
