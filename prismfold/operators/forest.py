"""Spark's random forests as arrays: votes and permuted columns for blocks of rows, as Spark's own model gives them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spectra import shared_folder
from .preprocess import rectangle

#: Pairs of a row and a tree looked at together, and numbers of a block's sums of votes.
PAIRS, SUMS = 1 << 17, 1 << 21


@dataclass
class Trees:
    """Nodes of all trees, one after another. child has left and right of each; a leaf is its own child. votes: (class, node)."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    votes: np.ndarray
    depth: int

    @classmethod
    def of(cls, spark: SparkSession, model, classes: int) -> Trees:
        """The trees of a fitted RandomForestClassificationModel on columns without categories, by way of its saved form."""
        path = f"{shared_folder(spark)}/forest-{uuid.uuid4().hex[:12]}"
        model.write().session(spark).save(path)
        node = F.col("nodeData")
        rows = spark.read.parquet(f"{path}/data").select(
            F.col("treeID").alias("tree"), node["id"].alias("id"), node["leftChild"].alias("left"), node["rightChild"].alias("right"), node["split"]["featureIndex"].alias("feature"),
            F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"), node["impurityStats"].alias("stats"),
        )
        t = rows.toArrow().combine_chunks().sort_by([("tree", "ascending"), ("id", "ascending")])
        at = lambda name: t[name].to_numpy()
        roots = np.flatnonzero(np.append(True, np.diff(at("tree")) > 0)).astype(np.int32)
        size = np.diff(np.append(roots, t.num_rows))
        if not np.array_equal(at("id"), np.arange(t.num_rows) - np.repeat(roots, size)):
            raise ValueError("a tree's nodes are not numbered from 0 without gaps")
        leaf, base, own = at("left") < 0, np.repeat(roots, size), np.arange(t.num_rows)
        child = np.stack([np.where(leaf, own, base + at(side)) for side in ("left", "right")], axis=1).astype(np.int32)
        stats = rectangle(t["stats"].combine_chunks())
        total = np.add.accumulate(stats, axis=1)[:, -1:]
        share = np.where(leaf[:, None] & (total != 0), stats / np.where(total != 0, total, 1), 0.0)
        votes = np.zeros((classes, t.num_rows))
        votes[: share.shape[1]] = share.T
        depth, front = 0, roots[~leaf[roots]]
        while len(front):
            depth += 1
            front = child[front].ravel()
            front = front[~leaf[front]]
        return cls(roots, np.where(leaf, 0, at("feature")).astype(np.int32), np.where(leaf, np.inf, at("threshold")), child.ravel(), votes, depth)

    def _step(self, node: np.ndarray, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which way each node sends its row, 1 for right, and the node there; start has the place of each row in x."""
        right = ~(x[start + self.feature[node]] <= self.threshold[node])
        return right, self.child[2 * node + right]

    def leaves(self, x: np.ndarray, roots: np.ndarray) -> np.ndarray:
        """The leaf of each row in the trees with these roots."""
        node, start, x = np.broadcast_to(roots, (len(x), len(roots))), np.arange(len(x))[:, None] * x.shape[1], np.ascontiguousarray(x).ravel()
        for _ in range(self.depth):
            node = self._step(node, x, start)[1]
        return node

    def summed(self, x: np.ndarray) -> np.ndarray:
        """(row, class): the votes of all trees, added up in their order as Spark does."""
        out, by_node = np.zeros((len(x), len(self.votes))), np.ascontiguousarray(self.votes.T)
        block = max(1, PAIRS // 64)
        for a in range(0, len(x), block):
            for t in range(0, len(self.roots), 64):
                for leaf in self.leaves(x[a : a + block], self.roots[t : t + 64]).T:
                    out[a : a + block] += by_node[leaf]
        return out

    def classes(self, x: np.ndarray) -> np.ndarray:
        """The class of most votes, the first of equal ones, from shares as Spark takes them."""
        raw = self.summed(x)
        total = np.add.accumulate(raw, axis=1)[:, -1:]
        return np.argmax(raw / np.where(total != 0, total, 1), axis=1)

    def permuted(self, x: np.ndarray, other: np.ndarray) -> np.ndarray:
        """(row, 1 + column): the class of each row as it is, and with each column's value taken from the other row.

        A column changes a tree's vote only where the row's path asks for it and would part there: such a tree's leaf
        is found anew from that node on, and the sums of votes are corrected by the difference. Where two classes are
        within rounding then, the trees are added up once more in order.
        """
        m, n = x.shape
        out, step = np.empty((m, n + 1), np.int64), max(1, min(512, SUMS // (n * len(self.votes))))
        for a in range(0, m, step):
            out[a : a + step] = self._permuted(np.ascontiguousarray(x[a : a + step]), np.ascontiguousarray(other[a : a + step]))
        return out

    def _permuted(self, x: np.ndarray, other: np.ndarray) -> np.ndarray:
        m, n = x.shape
        k, many = len(self.votes), max(1, PAIRS // m)
        flat, flat_other, start = x.ravel(), other.ravel(), np.arange(m)[:, None] * n
        base, change = np.zeros((k, m)), np.zeros((k, m * n))
        for t in range(0, len(self.roots), many):
            node = np.broadcast_to(self.roots[t : t + many], (m, len(self.roots[t : t + many])))
            parts = []  # by level: the column asked for, whether the other row would go on elsewhere, and where
            for _ in range(self.depth):
                away, there = self._step(node, flat_other, start)
                right, below = self._step(node, flat, start)
                f = self.feature[node]
                parted = away != right
                parted &= there != node  # a leaf asks for nothing
                first = parted.copy()
                for g, earlier, _ in parts:
                    first &= ~(earlier & (g == f))
                parts.append((f, parted, np.where(first, there, -1)))
                node = below
            for c in range(k):
                base[c] += self.votes[c][node].sum(axis=1)
            found = []
            for d, (f, _, there) in enumerate(parts):
                row, tree = np.nonzero(there >= 0)
                column, now, at = f[row, tree], there[row, tree], row * n
                for _ in range(d + 1, self.depth):
                    asked = self.feature[now]
                    value = np.where(asked == column, flat_other[at + asked], flat[at + asked])
                    now = self.child[2 * now + ~(value <= self.threshold[now])]
                found.append((at + column, now, node[row, tree]))
            for cell, after, before in found:
                for c in range(k):
                    change[c] += np.bincount(cell, self.votes[c][after] - self.votes[c][before], m * n)
        raw = np.concatenate([base[:, :, None], base[:, :, None] + change.reshape(k, m, n)], axis=2)
        out = np.argmax(raw, axis=0)
        row, column = np.nonzero((raw >= raw.max(axis=0) - 1e-8).sum(axis=0) > 1)
        for a in range(0, len(row), 1024):
            r, c = row[a : a + 1024], column[a : a + 1024] - 1
            again = x[r]
            swapped = np.flatnonzero(c >= 0)
            again[swapped, c[swapped]] = other[r[swapped], c[swapped]]
            out[r, c + 1] = self.classes(again)
        return out


def permuted_hits(df: DataFrame, trees: Trees, n: int) -> DataFrame:
    """(pos, accuracy) over rows of label, y and __other: -1 for rows as they are, else with the point at pos from __other."""
    sent = df.sparkSession.sparkContext.broadcast(trees)  # nodes, not rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits, rows = np.zeros(n + 1, np.int64), 0
        for b in batches:
            if b.num_rows:
                label = b.column(0).to_numpy(zero_copy_only=False)
                hits += (sent.value.permuted(rectangle(b.column(1)), rectangle(b.column(2))) == label[:, None]).sum(axis=0)
                rows += b.num_rows
        yield pa.record_batch([pa.array(np.arange(-1, n), pa.int32()), pa.array(hits), pa.array(np.full(n + 1, rows), pa.int64())], names=["pos", "hits", "rows"])

    found = df.select("label", "y", "__other").mapInArrow(run, "pos int, hits long, rows long")
    return found.groupBy("pos").agg(F.sum("hits").alias("hits"), F.sum("rows").alias("rows")).where("rows > 0").select("pos", (F.col("hits") / F.col("rows")).alias("accuracy"))


def left_out_votes(df: DataFrame, bags: list[Trees], classes: int) -> DataFrame:
    """votes instead of left and y: by class, the sum over the bags that left the row out; other bags do not look at it."""
    sent = df.sparkSession.sparkContext.broadcast(bags)  # nodes, not rows
    keep = [f for f in df.schema.fields if f.name not in ("left", "y")]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            column = lambda name: b.column(b.schema.get_field_index(name))  # noqa: B023, E731
            x, left = rectangle(column("y")), column("left").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            votes = np.zeros((b.num_rows, classes))
            for trees, out in zip(sent.value, left.T, strict=True):
                votes[out] += trees.summed(x[out])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * classes, pa.int32()), pa.array(votes.ravel()))
            yield pa.record_batch([*(column(n) for n in names), lists], names=[*names, "votes"])

    return df.mapInArrow(run, T.StructType([*keep, T.StructField("votes", T.ArrayType(T.DoubleType()))]))
