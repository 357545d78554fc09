"""Shared helpers: recovery-safe intermediate tables, word hashing and connected components."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id inside the operators; results carry the null again.
NULL_ID = -(2**63)
_U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where the session names none and runs on this machine alone."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = "file://" + tempfile.mkdtemp(prefix="prismfold-")
        sc.setCheckpointDir(folder)
        folder = sc.getCheckpointDir() or folder
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/prismfold-{name}-{uuid.uuid4().hex[:12]}"


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path there."""
    path = "file:///" + path[5:].lstrip("/") if path.startswith("file:/") else path
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: lineage ends here and a lost executor loses nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_key(name: str):
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


# --- bytes and words -------------------------------------------------------------------------


def binaries(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of each value; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [x if x is not None else b"" for x in column.cast(kind).to_pylist()]


def _word_table() -> bytes:
    keep = lambda c: c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A
    low = lambda c: c + 32 if 0x41 <= c <= 0x5A else c
    return bytes(low(c) if keep(low(c)) else 32 for c in range(256))


#: A-Z lower-cased; all that is no word byte becomes a space. Words: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
WORD_BYTES = _word_table()
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | _U64(1)
_powers: dict[int, np.ndarray] = {}
_PIECE = 1 << 17


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit values."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def _table(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:n]


def _hash_piece(buf: bytes, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    a = np.frombuffer(buf, np.uint8)
    word = np.zeros(len(a) + 2, np.int8)
    word[1:-1] = a != 32
    step = np.diff(word)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTE[a] * _table(_BASE, len(a)), out=total[1:])
    inverse = _table(_INVERSE, len(a))[start]
    size = lambda to, salt=0: mix((total[to] - total[start]) * inverse + (to - start + salt).astype(np.uint64))
    return start, size(end), *(np.where(end - start > k, size(np.minimum(start + k, end), 1 << 40), _U64(0)) for k in prefixes)


def hash_words(buf: bytes, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """Starts and 64-bit hashes of the space-separated words of a buffer in WORD_BYTES form.

    Every byte gets a random value, a word the polynomial of its bytes modulo 2^64, by prefix sums. A word's
    hash is the same wherever it stands, so long buffers go piece by piece, cut at spaces. For each length in
    `prefixes` follow the hashes of the words' first so many bytes, 0 for words that are no longer.
    """
    parts, at = [], 0
    while at < len(buf):
        end = len(buf)
        if end - at > _PIECE:
            cut = buf.rfind(b" ", at, at + _PIECE)
            if cut < 0:
                cut = buf.find(b" ", at + _PIECE)
            end = cut + 1 if cut >= 0 else len(buf)
        s, *h = _hash_piece(buf[at:end], prefixes)
        parts.append((s + at, *h))
        at = end
    if not parts:
        return np.zeros(0, np.int64), *(np.zeros(0, np.uint64) for _ in range(1 + len(prefixes)))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def document_words(texts: Iterable[bytes], prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """Word hashes of all texts in order, the bounds of each text in them (one more than texts), and prefix hashes."""
    bufs = [t.translate(WORD_BYTES) for t in texts]
    starts, hashes, *more = hash_words(b" ".join(bufs), prefixes)
    begins = np.concatenate([[0], np.cumsum([len(b) + 1 for b in bufs])]) if bufs else np.zeros(1, np.int64)
    return hashes, np.searchsorted(starts, begins), *more


_FACTOR = 0xD6E8FEB86659FD93


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words (none if there are fewer)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _U64(_FACTOR) + words[j : j + n]
    return mix(out ^ _U64(k))


def shingles(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's k-word shingles and the text of each; a text of 1 to k-1 words is one shingle."""
    counts = np.diff(bounds)
    owner = np.repeat(np.arange(len(counts)), counts)
    h = window_hashes(words, k)
    inside = owner[: len(h)] == owner[k - 1 : k - 1 + len(h)] if len(h) else np.zeros(0, bool)
    hs, of = [h[inside]], [owner[: len(h)][inside]]
    for j in np.flatnonzero((counts > 0) & (counts < k)):
        hs.append(window_hashes(words[bounds[j] : bounds[j + 1]], int(counts[j])))
        of.append(np.array([j]))
    h, o = np.concatenate(hs), np.concatenate(of)
    if len(hs) > 1:
        order = np.argsort(o, kind="stable")
        h, o = h[order], o[order]
    return h, o


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of about `most` bytes of text (a longer text stands alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        i = batch.schema.get_field_index(column)
        kind = batch.column(i).type
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(i)), 0)) if kind != pa.null() else np.zeros(batch.num_rows)
        group = np.cumsum(lengths) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function for mapInArrow; once a task is done, its worker gives back the memory that it no longer uses.

    Workers stay for later tasks, and both Arrow and the C library keep what was freed.
    """

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return tidied


# --- connected components --------------------------------------------------------------------


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): the smallest id reachable over `edges` (a, b); nodes without edges are absent.

    Alternates large-star and small-star steps: every node sends its larger, then its smaller neighbours to
    the smallest id it knows. A step is one grouped minimum (combined before the shuffle) and one join, so no
    neighbourhood is ever gathered; each step is written to the shared folder.
    """
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    e = materialise(e, name)
    last = None
    while True:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        e = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        down = e.select(F.col("b").alias("u"), F.col("a").alias("v"))  # each node's smaller neighbours
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        e = down.join(low, "u").select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b")).where("a < b").distinct()
        e = materialise(e, name)
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last = now
    return e.select(F.col("b").alias("node"), F.col("a").alias("component")).union(e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
