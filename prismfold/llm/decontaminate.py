"""Benchmark decontamination with a distributed positional inverted index.

Training texts are indexed in segments (a few MB of text each, the unit of distribution). A segment stores its
term dictionary and, per term, the ascending list of token positions. Positions of consecutive documents are
kept `GAP` apart, so no phrase crosses documents. A phrase is found by taking the positions of its rarest term
in the segment and intersecting them with the offset-adjusted lists of its other terms, rarer ones first;
proximity search keeps the positions of the rarest term that have each other term within a distance.

Segments need no shuffle: the benchmark's phrases, a stated query set, visit each of them in parts of bounded
size. `contamination` builds the index of a segment while its texts are read, and drops it when all phrases have
been looked up; `build_index` gives the same segments as rows to keep, and `search` looks phrases up in them.

Null or empty text: no words, never hit. Repeated rows and ids are separate documents. Items without words
match nothing; equal windows of several items count for each of them. A null item id
stands in the lists as an empty string. Words and windows are compared by 64-bit hashes. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, binaries, document_words, filesystem, new_path, slices, tidy

WINDOW = 10
#: Bytes of benchmark text in a part: its windows take some hundred times as much memory, on the driver and in a task.
PART_BYTES = 1 << 20


class Segment:
    """Term dictionary and positional postings of a run of documents."""

    def __init__(self, terms: np.ndarray, starts: np.ndarray, positions: np.ndarray, bases: np.ndarray):
        self.terms, self.starts, self.positions, self.bases = terms, starts, positions, bases

    @classmethod
    def build(cls, texts: list[bytes], gap: int) -> Segment:
        words, bounds = document_words(texts)
        counts = np.diff(bounds)
        bases = np.concatenate([[0], np.cumsum(counts + gap)])
        at = np.arange(len(words)) + np.repeat(np.arange(len(counts)) * gap, counts)
        order = np.argsort(words, kind="stable")
        ordered = words[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
        return cls(ordered[first], np.concatenate([first, [len(ordered)]]), at[order], bases)

    def lists(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each term's postings; equal for a term that does not occur."""
        if not len(self.terms):
            return np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
        i = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        found = self.terms[i] == terms
        return np.where(found, self.starts[i], 0), np.where(found, self.starts[i + 1], 0)

    def phrase(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """First positions of the phrase whose j-th term has positions[low[j]:high[j]]."""
        order = np.argsort(high - low, kind="stable")
        at = None
        for j in order:
            post = self.positions[low[j] : high[j]]
            if at is None:
                at = post - j
            else:
                i = np.minimum(np.searchsorted(post, at + j), len(post) - 1)
                at = at[post[i] == at + j]
            if not len(at):
                break
        return at

    def near(self, low: np.ndarray, high: np.ndarray, within: int) -> np.ndarray:
        """Positions of the rarest term that have every other term at most `within` words away."""
        order = np.argsort(high - low, kind="stable")
        at = self.positions[low[order[0]] : high[order[0]]]
        for j in order[1:]:
            post = self.positions[low[j] : high[j]]
            at = at[np.searchsorted(post, at + within, "right") > np.searchsorted(post, at - within, "left")]
            if not len(at):
                break
        return at

    def document_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bases, positions, "right") - 1


class Phrases:
    """The distinct windows of the benchmark items, with the items of each."""

    def __init__(self, items: list[tuple], window: int):
        words, bounds = document_words([t for _, t in items])
        of: dict[bytes, int] = {}
        self.windows: list[np.ndarray] = []
        self.items: list[set[str]] = []
        for (item, _), a, b in zip(items, bounds, bounds[1:], strict=False):
            for p in range(a, max(b - window, a) + 1 if b > a else a):
                w = words[p : min(p + window, b)]
                k = of.setdefault(w.tobytes(), len(self.windows))
                if k == len(self.windows):
                    self.windows.append(w)
                    self.items.append(set())
                self.items[k].add(str(item))
        self.terms = np.unique(np.concatenate(self.windows)) if self.windows else np.zeros(0, np.uint64)
        size = max([len(w) for w in self.windows], default=1)
        self.sizes = np.array([len(w) for w in self.windows], np.int64)
        self.index = np.zeros((len(self.windows), size), np.int64)  # short windows repeat their first term
        for k, w in enumerate(self.windows):
            self.index[k] = np.searchsorted(self.terms, np.concatenate([w, np.repeat(w[:1], size - len(w))]))


class Parts:
    """The benchmark's windows in parts of bounded size: one part is sent to the tasks, more are read from the shared folder one after the other."""

    def __init__(self, benchmark: DataFrame, window: int, item_id: str = "item_id", text: str = "text", part_bytes: int = PART_BYTES):
        spark = benchmark.sparkSession
        self.one, self.paths, waiting, held = None, [], [], 0
        for r in benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")), F.col(text).cast("binary")).toLocalIterator():
            words = bytes(r[1] or b"")
            # A long item goes in pieces that overlap by all but one word of a window.
            for piece in pieces(words, part_bytes, window):
                if held and held + len(piece) > part_bytes:
                    self._store(spark, Phrases(waiting, window))
                    waiting, held = [], 0
                waiting.append((r[0], piece))
                held += len(piece)
        if self.paths:
            self._store(spark, Phrases(waiting, window))
        else:
            self.one = spark.sparkContext.broadcast(Phrases(waiting, window))

    def _store(self, spark, phrases: Phrases) -> None:
        path = new_path(spark, "phrases")
        fs, at = filesystem(path)
        with fs.open_output_stream(at) as f:
            f.write(pickle.dumps(phrases))
        self.paths.append(path)

    def __iter__(self) -> Iterator[Phrases]:
        if self.one is not None:
            yield self.one.value
        for path in self.paths:
            fs, at = filesystem(path)
            with fs.open_input_file(at) as f:
                yield pickle.loads(f.read())


def pieces(text: bytes, most: int, window: int) -> list[bytes]:
    """The text, or pieces of about `most` bytes that hold each run of `window` words whole."""
    if len(text) <= most:
        return [text]
    words, out, at = text.translate(WORD_BYTES).split(), [], 0
    if len(words) <= window:
        return [b" ".join(words)]
    while at + window <= len(words):
        end, size = at, 0
        while end < len(words) and (end - at < window or size + len(words[end]) < most):
            size += len(words[end]) + 1
            end += 1
        out.append(b" ".join(words[at:end]))
        if end == len(words):
            break
        at = end - window + 1
    return out


def scan(texts: list[bytes], parts: Iterable[Phrases], window: int) -> list[tuple[int, int, list[str]]]:
    """(words, hit words, items) of each text."""
    segment = Segment.build(texts, gap=window)
    n = len(texts)
    span = int(segment.bases[-1]) + window + 1
    cover = np.zeros(span, np.int32)
    items: list[set[str]] = [set() for _ in range(n)]
    for phrases in parts:
        if not len(phrases.windows):
            continue
        low, high = segment.lists(phrases.terms)
        for k in np.flatnonzero((high > low)[phrases.index].all(axis=1)):
            t = phrases.index[k, : phrases.sizes[k]]
            at = segment.phrase(low[t], high[t])
            if len(at):
                np.add.at(cover, at, 1)
                np.add.at(cover, at + phrases.sizes[k], -1)
                for d in np.unique(segment.document_of(at)):
                    items[d] |= phrases.items[k]
    hit = np.concatenate([[0], np.cumsum(np.cumsum(cover) > 0)])
    counts = np.diff(segment.bases) - window
    hits = hit[segment.bases[:-1] + counts] - hit[segment.bases[:-1]]
    return [(int(counts[d]), int(hits[d]), sorted(items[d])) for d in range(n)]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", part_bytes: int = PART_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items (sorted as strings) and contaminated. One narrow pass."""
    parts = Parts(benchmark, window, part_bytes=part_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__text", 8 << 20):
            found = scan(binaries(b.column(1)), parts, window)
            yield pa.record_batch(
                [b.column(0), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.list_(pa.string()))],
                names=["doc_id", "n_words", "n_hit", "items"],
            )

    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col("text").alias("__text")).mapInArrow(tidy(run), "doc_id long, n_words long, n_hit long, items array<string>")
    return out.withColumn("n_items", F.size("items").cast("long")).withColumn("contaminated", F.col("n_hit") > 0)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, all columns, without those that hold a window of a benchmark item."""
    parts = Parts(benchmark, window)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 8 << 20):
            found = scan(binaries(b.column(at)), parts, window)
            yield b.filter(pa.array([x[1] == 0 for x in found]))

    return docs.mapInArrow(tidy(run), docs.schema)


# --- the stored index ------------------------------------------------------------------------

INDEX_SCHEMA = "segment long, doc_ids binary, terms binary, starts binary, positions binary, bases binary"


def build_index(docs: DataFrame, gap: int = 1024, id_col: str = "doc_id") -> DataFrame:
    """One row per segment; write it as Parquet to keep it. `gap` bounds phrase length and proximity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__text", 8 << 20):
            s = Segment.build(binaries(b.column(1)), gap)
            ids = np.asarray(b.column(0).fill_null(-(2**63)), np.int64)
            row = [ids, s.terms, s.starts.astype(np.int64), s.positions.astype(np.int64), s.bases.astype(np.int64)]
            name = int.from_bytes(hashlib.blake2b(b"".join(x.tobytes() for x in row[:2]), digest_size=8).digest(), "little", signed=True)
            yield pa.record_batch([pa.array([name], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in row)], names=["segment", "doc_ids", "terms", "starts", "positions", "bases"])

    return docs.select(F.col(id_col).cast("long"), F.col("text").alias("__text")).mapInArrow(tidy(run), INDEX_SCHEMA)


def search(index: DataFrame, queries: list[tuple], within: int | None = None) -> DataFrame:
    """(query_id, doc_id, position) of exact phrases, or with `within` of the rarest term where all others are near."""
    prepared = [(str(k), document_words([t.encode()])[0]) for k, t in queries]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                read = lambda c, kind=np.int64: np.frombuffer(r[c], kind)  # noqa: B023, E731
                s, ids = Segment(read("terms", np.uint64), read("starts"), read("positions"), read("bases")), read("doc_ids")
                for k, words in prepared:
                    low, high = s.lists(words)
                    if len(words) and (high > low).all():
                        at = s.phrase(low, high) if within is None else s.near(low, high, within)
                        d = s.document_of(at)
                        yield pa.record_batch([pa.array([k] * len(at), pa.string()), pa.array(ids[d]), pa.array(at - s.bases[d])], names=["query_id", "doc_id", "position"])

    return index.mapInArrow(tidy(run), "query_id string, doc_id long, position long")
