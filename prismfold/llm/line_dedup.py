"""Reversible line deduplication: sharded cuckoo filters backed by exact reference-count tables.

The state is tables in a folder, one version per change: `postings`, the exact table of line key, document and the
number of that document's lines with the key; `counts`, the documents and the largest document of each key that
reaches the threshold; and `filters`, a cuckoo filter per shard of the key space over those keys. A change touches
the keys of its documents alone: their counts are taken anew from the postings, keys that now reach the threshold
are inserted in the filters and keys that no longer do are deleted from them. Postings are kept in parts, and a
deletion adds the ids that are gone, so neither rewrites what is there. Whether a line is dropped is decided by the
counts; the filters keep the many lines that no count can reach from the exact lookup.

Filters travel to where texts are read, after a check of their size: only suspect lines are shuffled. Beyond
`BROADCAST_BYTES` the postings go to their shards' filters instead.

A key is the line stripped of [\\x20\\x09-\\x0D] with A-Z lower-cased; it counts from `min_chars` code points.
Keys in at least `min_docs` documents lose all their lines but those of the largest document that holds them.

Null or empty text: one empty line. Rows that share an id are one document for the counts, and each is written.
A null id counts as the smallest document. Extra columns are kept as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binaries, id_key, materialise, mix, new_path, slices, tidy

MIN_CHARS, MIN_DOCS = 40, 5
#: Keys that a filter is planned for; bytes of filters that are sent to all tasks.
KEYS_PER_SHARD, BROADCAST_BYTES = 200_000, 64 << 20
ADDED = ("__n_lines", "__n_dropped", "__sha256")
_SPACE = b" \t\n\x0b\x0c\r"


def line_keys(text: bytes, min_chars: int) -> list[bytes | None]:
    """The 16-byte key of every line; None where it does not count."""
    out: list[bytes | None] = []
    for line in text.lower().split(b"\n"):
        line = line.strip(_SPACE)
        if len(line) < min_chars or len(line) < 4 * min_chars and len(line.decode("utf-8", "replace")) < min_chars:
            out.append(None)
        else:
            out.append(hashlib.blake2b(line, digest_size=16).digest())
    return out


def postings(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id") -> DataFrame:
    """(k1, k2, doc, n): the lines of each key in each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__text"):
            ids, keys = [], []
            for d, text in zip(b.column(0).to_pylist(), binaries(b.column(1)), strict=True):
                found = [k for k in line_keys(text, min_chars) if k]
                keys += found
                ids += [d] * len(found)
            k = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            yield pa.record_batch([pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(ids, pa.int64())], names=["k1", "k2", "doc"])

    lines = docs.select(id_key(id_col).alias("__id"), F.col("text").alias("__text")).mapInArrow(tidy(run), "k1 long, k2 long, doc long")
    return lines.groupBy("k1", "k2", "doc").agg(F.count("*").alias("n"))


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; a key may lie in two buckets, each found from the other."""

    SLOTS, KICKS = 4, 500

    def __init__(self, capacity: int = 0, table: bytes | None = None):
        if table is not None:
            self.table = np.frombuffer(table, np.uint16).reshape(-1, self.SLOTS).copy()
        else:
            self.table = np.zeros((1 << max(1, int(np.ceil(np.log2(max(1, capacity) / self.SLOTS / 0.85)))), self.SLOTS), np.uint16)
        self.mask = np.uint64(len(self.table) - 1)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mix(keys.astype(np.uint64))
        print_ = ((h >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        first = h & self.mask
        return print_, first, first ^ (mix(print_.astype(np.uint64)) & self.mask)

    def insert(self, keys: np.ndarray) -> bool:
        """False if a key found no place: the caller builds a larger filter."""
        prints, first, second = self._places(keys)
        for f, a, b in zip(prints.tolist(), first.tolist(), second.tolist(), strict=True):
            if not self._place(f, a, b):
                return False
        return True

    def _place(self, f: int, a: int, b: int) -> bool:
        t = self.table
        for i in (a, b):
            free = np.flatnonzero(t[i] == 0)
            if len(free):
                t[i, free[0]] = f
                return True
        i = b
        for kick in range(self.KICKS):
            slot = (kick * 7 + f) % self.SLOTS
            f, t[i, slot] = int(t[i, slot]), f
            i = i ^ int(mix(np.array([f], np.uint64))[0] & self.mask)
            free = np.flatnonzero(t[i] == 0)
            if len(free):
                t[i, free[0]] = f
                return True
        return False

    def delete(self, keys: np.ndarray) -> None:
        """Remove keys that are in the filter."""
        prints, first, second = self._places(keys)
        for f, a, b in zip(prints, first.astype(np.int64), second.astype(np.int64), strict=True):
            for i in (a, b):
                at = np.flatnonzero(self.table[i] == f)
                if len(at):
                    self.table[i, at[0]] = 0
                    break

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, first, second = self._places(keys)
        return ((self.table[first.astype(np.int64)] == prints[:, None]) | (self.table[second.astype(np.int64)] == prints[:, None])).any(axis=1)

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        capacity = max(8, len(keys))
        while True:
            out = cls(capacity)
            if out.insert(keys):
                return out
            capacity *= 2


def counts(posted: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(k1, k2, docs, keeper) of the keys that reach the threshold: the exact reference counts."""
    return posted.groupBy("k1", "k2").agg(F.count("*").alias("docs"), F.max("doc").alias("keeper")).where(F.col("docs") >= min_docs)


def build_filters(counted: DataFrame, shards: int) -> DataFrame:
    """(shard, filter): a cuckoo filter over the keys of each shard."""

    def build(table: pa.Table) -> pa.Table:
        keys = np.sort(table["k1"].to_numpy().astype(np.int64))
        return pa.table({"shard": pa.array([table["shard"][0].as_py()], pa.int32()), "filter": pa.array([CuckooFilter.of(keys).table.tobytes()], pa.binary())})

    return counted.select("k1", F.pmod("k1", F.lit(shards)).cast("int").alias("shard")).groupBy("shard").applyInArrow(build, "shard int, filter binary")


def suspects(posted: DataFrame, filters: DataFrame, shards: int, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(k1, k2, doc): the postings that their shard's filter may hold."""
    spark = posted.sparkSession
    size = filters.agg(F.sum(F.octet_length("filter")).alias("n")).first()["n"] or 0
    if size <= broadcast_bytes:
        held = spark.sparkContext.broadcast({r["shard"]: bytes(r["filter"]) for r in filters.collect()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = {s: CuckooFilter(table=t) for s, t in held.value.items()}
            for b in batches:
                key, hit = b.column(0).to_numpy(), np.zeros(b.num_rows, bool)
                shard = np.mod(key, shards)
                for s in np.unique(shard).tolist():
                    if s in known:
                        at = np.flatnonzero(shard == s)
                        hit[at] = known[s].contains(key[at])
                yield b.filter(pa.array(hit))

        return posted.select("k1", "k2", "doc").mapInArrow(tidy(run), "k1 long, k2 long, doc long")

    # Filters travel ahead of the lines of their shard, which are dealt into as many shares as give each task some MB.
    salts = max(16, -(-spread(posted) // shards))
    salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    empty = [F.lit(None).cast("long").alias(c) for c in ("k1", "k2", "doc")]
    both = filters.select("shard", salt, "filter", *empty).unionByName(
        posted.select(F.pmod("k1", F.lit(shards)).cast("int").alias("shard"), F.pmod(F.xxhash64("doc", "k2"), F.lit(salts)).cast("int").alias("salt"), F.lit(None).cast("binary").alias("filter"), "k1", "k2", "doc")
    )

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int | None, CuckooFilter | None] = (None, None)
        for b in batches:
            shard = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1), b.num_rows]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if y == x:
                    continue
                part = b.slice(x, y - x)
                tables = part.column(2).drop_null()
                if len(tables):
                    held = (int(shard[x]), CuckooFilter(table=tables[0].as_py()))
                lines = part.filter(pc.is_valid(part.column(3)))
                if lines.num_rows and held[0] == shard[x]:
                    yield lines.filter(pa.array(held[1].contains(lines.column(3).to_numpy()))).select([3, 4, 5])

    dealt = both.repartition(salts * shards, "shard", "salt").sortWithinPartitions("shard", "salt", F.col("filter").isNull())
    return dealt.select("shard", "salt", "filter", "k1", "k2", "doc").mapInArrow(tidy(beside), "k1 long, k2 long, doc long")


def spread(posted: DataFrame) -> int:
    """Shares of some million postings each."""
    return -(-posted.count() // 2_000_000)


def change_filters(filters: DataFrame, changes: DataFrame, shards: int) -> DataFrame:
    """The filters with keys inserted (add = true) and deleted (add = false); shards without changes stay as they are."""

    def change(key: tuple, held: pa.Table, wanted: pa.Table) -> pa.Table:
        tables = held["filter"].to_pylist()
        keys, add = wanted["k1"].to_numpy(), wanted["add"].to_numpy(zero_copy_only=False)
        one = CuckooFilter(table=tables[0]) if tables else CuckooFilter(max(8, int(add.sum())))
        if len(keys):
            one.delete(keys[~add])
            if not one.insert(np.sort(keys[add])):
                one = None  # full: the caller builds this shard's filter from the counts
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([one.table.tobytes() if one else None], pa.binary())})

    named = changes.select("k1", "add", F.pmod("k1", F.lit(shards)).cast("int").alias("shard"))
    return filters.groupBy("shard").cogroup(named.groupBy("shard")).applyInArrow(change, "shard int, filter binary")


class LineIndex:
    """The stored state. Changes return a new version; earlier ones stay readable."""

    def __init__(self, spark: SparkSession, parts: list[DataFrame], gone: list[DataFrame], counted: DataFrame, filters: DataFrame, shards: int, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id"):
        self.spark, self.parts, self.gone, self.counted, self.filters, self.shards = spark, parts, gone, counted, filters, shards
        self.min_chars, self.min_docs, self.id_col = min_chars, min_docs, id_col

    @classmethod
    def build(cls, docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id") -> LineIndex:
        posted = materialise(postings(docs, min_chars, id_col), "line-postings")
        counted = materialise(counts(posted, min_docs), "line-counts")
        shards = max(1, -(-counted.count() // KEYS_PER_SHARD))
        return cls(docs.sparkSession, [posted], [], counted, materialise(build_filters(counted, shards), "line-filters"), shards, min_chars, min_docs, id_col)

    @property
    def posted(self) -> DataFrame:
        """All postings: the parts in order, each deletion after the parts before it."""
        out = None
        for part, gone in zip(self.parts, [*self.gone, None], strict=False):
            out = part if out is None else out.unionByName(part)
            if gone is not None:
                out = out.join(gone, "doc", "left_anti").select("k1", "k2", "doc", "n")
        return out if len(self.parts) == 1 else out.groupBy("k1", "k2", "doc").agg(F.sum("n").alias("n"))

    def _changed(self, parts: list[DataFrame], gone: list[DataFrame], touched: DataFrame) -> LineIndex:
        """The next version: counts and filters follow for the touched keys (k1, k2) alone."""
        after = LineIndex(self.spark, parts, gone, self.counted, self.filters, self.shards, self.min_chars, self.min_docs, self.id_col)
        touched = materialise(touched.select("k1", "k2").distinct(), "line-keys")
        anew = materialise(counts(after.posted.join(touched, ["k1", "k2"], "left_semi"), self.min_docs), "line-counts")
        before = self.counted.join(touched, ["k1", "k2"], "left_semi")
        key = ["k1", "k2"]
        changes = anew.select(*key).join(before.select(*key), key, "left_anti").withColumn("add", F.lit(True)).unionByName(before.select(*key).join(anew.select(*key), key, "left_anti").withColumn("add", F.lit(False)))
        after.counted = materialise(self.counted.join(touched, key, "left_anti").unionByName(anew), "line-counts")
        filters = materialise(change_filters(self.filters, changes, self.shards), "line-filters")
        full = filters.where("filter IS NULL").select("shard")
        if not full.isEmpty():
            again = after.counted.withColumn("shard", F.pmod("k1", F.lit(self.shards)).cast("int")).join(full, "shard", "left_semi")
            filters = materialise(filters.where("filter IS NOT NULL").unionByName(build_filters(again, self.shards)), "line-filters")
        after.filters = filters
        return after

    def insert(self, docs: DataFrame) -> LineIndex:
        """With more documents; an id that is there gains lines."""
        new = materialise(postings(docs, self.min_chars, self.id_col), "line-postings")
        gone = [*self.gone, *[None] * (len(self.parts) - len(self.gone))]
        return self._changed([*self.parts, new], gone, new)

    def delete(self, ids: DataFrame) -> LineIndex:
        """Without the documents of the ids in the first column of `ids`: as if they had never been inserted. A null id is that of documents without one."""
        gone = materialise(ids.select(id_key(ids.columns[0]).alias("doc")).distinct(), "line-deleted")
        empty = self.parts[0].limit(0)
        return self._changed([*self.parts, empty], [*self.gone, *[None] * (len(self.parts) - 1 - len(self.gone)), gone], self.posted.join(gone, "doc", "left_semi"))

    def save(self, path: str | None = None) -> str:
        """Write the state; postings are put together, without what was deleted."""
        path = path or new_path(self.spark, "line-index")
        for name, table in (("postings", self.posted), ("counts", self.counted), ("filters", self.filters)):
            table.write.mode("overwrite").parquet(f"{path}/{name}")
        rules = [(self.shards, self.min_chars, self.min_docs, self.id_col)]
        self.spark.createDataFrame(rules, "shards int, min_chars int, min_docs int, id_col string").write.mode("overwrite").parquet(f"{path}/rules")
        return path

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LineIndex:
        r = spark.read.parquet(f"{path}/rules").first()
        posted, counted, filters = (spark.read.parquet(f"{path}/{name}") for name in ("postings", "counts", "filters"))
        return cls(spark, [posted], [], counted, filters, r["shards"], r["min_chars"], r["min_docs"], r["id_col"])

    def dropped(self) -> DataFrame:
        """(doc, keys): the keys whose lines each document loses, 16 bytes each."""
        found = suspects(self.posted, self.filters, self.shards).join(self.counted, ["k1", "k2"]).where("doc < keeper")
        return found.groupBy("doc").agg(F.collect_list(F.struct("k1", "k2")).alias("__keys"))

    def apply(self, docs: DataFrame) -> DataFrame:
        """The documents, all columns, their text without the dropped lines, with __n_lines, __n_dropped and __sha256.

        Columns of the documents with these names give way to the new ones.
        """
        columns = [c for c in docs.columns if c not in ADDED]
        named = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
        at, key = columns.index("text"), f"c{columns.index(self.id_col)}"
        joined = named.withColumn("__doc", id_key(key)).join(self.dropped().withColumnRenamed("doc", "__doc"), "__doc", "left").select(*named.columns, "__keys")
        min_chars = self.min_chars

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, f"c{at}"):
                lost = b.column(len(columns)).to_pylist()
                texts, lines, drops, digests = [], [], [], []
                for text, there, gone in zip(binaries(b.column(at)), b.column(at).is_valid().to_pylist(), lost, strict=True):
                    n, k = text.count(b"\n") + 1, 0
                    if gone:
                        keys = {np.array([g["k1"], g["k2"]], np.int64).tobytes() for g in gone}
                        kept = [line for line, key in zip(text.split(b"\n"), line_keys(text, min_chars), strict=True) if key not in keys]
                        k, text = n - len(kept), b"\n".join(kept)
                    texts.append(text if there else None)
                    lines.append(n)
                    drops.append(k)
                    digests.append(hashlib.sha256(text).hexdigest())
                arrays = [pa.array(texts, pa.binary()).cast(pa.string()) if i == at else b.column(i) for i in range(len(columns))]
                yield pa.record_batch([*arrays, pa.array(lines, pa.int64()), pa.array(drops, pa.int64()), pa.array(digests, pa.string())], names=[*(f"c{i}" for i in range(len(columns))), *ADDED])

        schema = named.schema.add("__n_lines", "long").add("__n_dropped", "long").add("__sha256", "string")
        return joined.mapInArrow(tidy(run), schema).toDF(*columns, *ADDED)
