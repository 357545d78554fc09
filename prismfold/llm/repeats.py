"""Exact removal of repeated byte strings by prefix-free parsing.

A rolling hash runs over every text. In each string of `length` bytes, the smallest of its `TRIGGER`-byte hashes is
its trigger: equal strings have equal triggers at equal places, so triggers parse all texts into phrases by
content alone, and every match of `length` bytes lies whole in the phrases around one trigger. The dictionary is
the set of distinct phrases (a trigger with the bytes of all strings that it governs); phrases whose trigger
occurs in one document only hold no repeat and are left out before any text moves. The suffixes of the dictionary's
phrases are sorted by their bytes to the depth that decides a match, `length`: equal neighbours in this suffix array
are the matches, and each has the smallest document of its phrases. Phrases overlap, so that a suffix never has to
be followed into the next phrase; what the parse adds are the places of each phrase in its documents, by which the
matches go back to the texts in corpus order.

Texts lie in blobs of a few MB in a table bucketed by blob, and never move again: what is shuffled are arrays of
trigger hashes, then the distinct phrases with repeated triggers, then bit masks back to the blobs.

Null or empty text: no bytes. Texts shorter than `length`: kept. Null ids count as the smallest. Rows with equal
ids are one document: they do not remove each other's strings. Very long texts: blobs of their own. Extra columns
are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BASE, _BYTE, NULL_ID, binaries, id_key, materialise, mix, shuffle_partitions, slices

LENGTH, TRIGGER = 50, 16
BLOB_BYTES = 4 << 20
#: Text bytes for each shard of the trigger space.
SHARD_BYTES = 16 << 20
#: A shard's phrases are sorted in parts of the trigger space, so that a task holds the suffix array of one part only.
PART_BITS = 4
_U = np.uint64
_PIECE = 1 << 16


def rolling(a: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hashes of all runs of `width` bytes, by doubling."""
    out, done = None, 0
    part, k = _BYTE[a], 1
    n = len(a) - width + 1
    while True:
        if width & k:
            piece = part[done : done + n]
            out = piece.copy() if out is None else out * _U(pow(_BASE, k, 2**64)) + piece
            done += k
        if done == width:
            return mix(out)
        part = part[:-k] * _U(pow(_BASE, k, 2**64)) + part[k:]
        k *= 2


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    k = 1
    while 2 * k <= width:
        a = np.minimum(a[:-k], a[k:])
        k *= 2
    return np.minimum(a[: len(a) - (width - k)], a[width - k :]) if k < width else a


def triggers(a: np.ndarray, length: int) -> np.ndarray:
    """The trigger of the string at each position of a buffer; pieces keep the work in the processor's cache."""
    n = len(a) - length + 1
    width = min(TRIGGER, length)
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for at in range(0, n, _PIECE):
        end = min(n, at + _PIECE)
        out[at:end] = sliding_min(rolling(a[at : end + length - 1], width), length - width + 1)
    return out


class Blob:
    """Documents of a blob, the strings that lie within one document, and their triggers."""

    def __init__(self, ids: bytes, ends: bytes, text: bytes, length: int):
        self.ids, self.ends, self.length = np.frombuffer(ids, np.int64), np.frombuffer(ends, np.int64), length
        self.bytes = np.frombuffer(text, np.uint8)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        self.trigger = triggers(self.bytes, length)
        n = len(self.trigger)
        self.inside = np.zeros(n + 1, bool)
        if n:
            step = np.zeros(len(self.bytes) + 2, np.int32)
            many = np.maximum(self.ends - self.starts - length + 1, 0)
            np.add.at(step, self.starts[many > 0], 1)
            np.add.at(step, self.starts[many > 0] + many[many > 0], -1)
            self.inside = np.cumsum(step[: n + 1]) > 0
        self.inside[n] = False

    def terms(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct triggers, ascending, and whether two documents of the blob share them."""
        # Neighbouring strings mostly share a trigger; one of each run is enough.
        t, inside = self.trigger, self.inside[:-1]
        first = np.ones(len(t), bool)
        first[1:] = (t[1:] != t[:-1]) | ~inside[:-1]
        at = np.flatnonzero(first & inside)
        doc = self.ids[np.searchsorted(self.ends, at, "right")]
        order = np.lexsort((doc, t[at]))
        h, d = t[at][order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        begin = np.flatnonzero(new)
        last = np.append(begin[1:], len(h)) - 1
        return h[begin], d[begin] != d[last] if len(begin) else np.zeros(0, bool)

    def phrases(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and number of strings of each run of strings with one repeated trigger, in one document."""
        t = self.trigger
        if not len(repeated) or not len(t):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        go = self.inside[:-1].copy()
        i = np.minimum(np.searchsorted(repeated, t[go]), len(repeated) - 1)
        go[np.flatnonzero(go)] = repeated[i] == t[go]
        start, stop = go.copy(), go.copy()
        start[1:] &= ~go[:-1] | (t[1:] != t[:-1])
        stop[:-1] &= ~go[1:] | (t[1:] != t[:-1])
        a = np.flatnonzero(start)
        return a, np.flatnonzero(stop) - a + 1


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> _U(20)) % _U(shards)).astype(np.int64)


def unpack(mask: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(mask, np.uint8), count=n).astype(bool)


def repeated_terms(blob: Blob, masks: dict[int, bytes], shards: int) -> np.ndarray:
    h, local = blob.terms()
    shard = shard_of(h, shards)
    out = local.copy()
    for s in np.unique(shard):
        at = np.flatnonzero(shard == s)
        if int(s) in masks:
            out[at] |= unpack(masks[int(s)], len(at))
    return h[out]


class Dictionary:
    """Distinct phrases of a blob with their smallest documents."""

    def __init__(self, blob: Blob, repeated: np.ndarray):
        self.blob = blob
        self.at, self.many = blob.phrases(repeated)
        self.doc = blob.ids[np.searchsorted(blob.ends, self.at, "right")]
        text = blob.bytes.tobytes()
        found: dict[bytes, int] = {}
        self.of = np.zeros(len(self.at), np.int64)
        self.names: list[bytes] = []
        least: list[int] = []
        for i, (a, m, d) in enumerate(zip(self.at.tolist(), self.many.tolist(), self.doc.tolist(), strict=True)):
            phrase = text[a : a + m + blob.length - 1]
            k = found.setdefault(phrase, len(self.names))
            if k == len(self.names):
                self.names.append(phrase)
                least.append(d)
            elif d < least[k]:
                least[k] = d
            self.of[i] = k
        self.least = np.array(least, np.int64)
        first = np.zeros(len(self.names), np.int64)
        first[self.of[::-1]] = self.at[::-1]
        self.trigger = blob.trigger[first] if len(first) else np.zeros(0, np.uint64)


def suffix_order(text: np.ndarray, strings: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of a buffer to a depth: the given places in the order of their `length` bytes, and where a new string begins."""
    if not len(strings):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    # Words of eight bytes are ranked once for all places; a string is the ranks of its words, the last one overlapping.
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.ndarray((len(text),), ">u8", padded, strides=(1,)).astype(np.uint64)
    if length < 8:
        words >>= _U(8 * (8 - length))
    order = np.argsort(words)
    step = np.zeros(len(words), np.uint64)
    step[1:] = words[order][1:] != words[order][:-1]
    rank = np.empty(len(words), np.uint64)
    rank[order] = np.cumsum(step, dtype=np.uint64)
    del words, order, step
    at = sorted({*range(0, max(1, length - 7), 8), max(0, length - 8)})
    bits = max(1, int(rank.max()).bit_length())
    fit, keys = max(1, 64 // bits), []
    for i in range(0, len(at), fit):
        key = np.zeros(len(strings), np.uint64)
        for k in at[i : i + fit]:
            key = key << _U(bits) | rank[strings + k]
        keys.append(key)
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.ones(len(strings), bool)
    new[1:] = False
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    return order, new


def strings_of(size: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all strings of phrases that lie one behind the other, and the number of each phrase's."""
    many = size - length + 1
    return np.repeat(np.cumsum(size) - size - (np.cumsum(many) - many), many) + np.arange(many.sum()), many


def repeated_strings(text: bytes, size: np.ndarray, doc: np.ndarray, part: np.ndarray, length: int) -> np.ndarray:
    """Whether a smaller document has the string, for all strings of phrases that lie one behind the other.

    Equal strings are in one part. Of each part, the dictionary of distinct phrases is sorted by its suffixes, and a
    string's smallest document is that of all phrases that have it.
    """
    start = np.cumsum(size) - size
    _, many = strings_of(size, length)
    first = np.cumsum(many) - many
    out = np.zeros(int(many.sum()), bool)
    for p in np.unique(part):
        own = np.flatnonzero(part == p)
        index: dict[bytes, int] = {}
        of = np.array([index.setdefault(text[a : a + n], len(index)) for a, n in zip(start[own].tolist(), size[own].tolist(), strict=True)], np.int64)
        sizes = np.array([len(x) for x in index], np.int64)
        least = np.full(len(index), np.iinfo(np.int64).max)
        np.minimum.at(least, of, doc[own])
        strings, count = strings_of(sizes, length)
        order, new = suffix_order(np.frombuffer(b"".join(index), np.uint8), strings, length)
        begin = np.flatnonzero(new)
        low = np.empty(len(strings), np.int64)
        low[order] = np.repeat(np.minimum.reduceat(np.repeat(least, count)[order], begin), np.diff(np.append(begin, len(order))))
        inner = np.arange(many[own].sum()) - np.repeat(np.cumsum(many[own]) - many[own], many[own])
        out[np.repeat(first[own], many[own]) + inner] = low[np.repeat((np.cumsum(count) - count)[of], many[own]) + inner] < np.repeat(doc[own], many[own])
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_bytes, spans (start, length of each maximal removed run) and kept (the remaining bytes) of each document."""
    named = f"prismfold_blobs_{uuid.uuid4().hex[:12]}"
    try:
        return _remove(docs, length, id_col, named, shard_bytes)
    finally:
        docs.sparkSession.sql(f"DROP TABLE IF EXISTS {named}")


def _remove(docs: DataFrame, length: int, id_col: str, named: str, shard_bytes: int) -> DataFrame:
    spark = docs.sparkSession
    source = docs.select(id_key(id_col).alias("__id"), F.col("text").alias("__text"))
    total = docs.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    shards, buckets = max(1, -(-total // shard_bytes)), max(shuffle_partitions(spark), -(-total // (16 * BLOB_BYTES)))

    def to_blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() << 33
        for b in slices(batches, "__text", BLOB_BYTES):
            texts = binaries(b.column(1))
            row = [np.array(b.column(0).to_pylist(), np.int64).tobytes(), np.cumsum([len(t) for t in texts]).astype(np.int64).tobytes(), b"".join(texts)]
            yield pa.record_batch([pa.array([n], pa.int64()), *(pa.array([x], pa.binary()) for x in row)], names=["blob", "ids", "ends", "text"])
            n += 1

    source.mapInArrow(to_blobs, "blob long, ids binary, ends binary, text binary").write.option("compression", "zstd").bucketBy(buckets, "blob").saveAsTable(named)
    blobs = spark.table(named)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Blob, dict]]:
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(j)[i].as_py() for j, c in enumerate(b.schema.names)}
                yield r["blob"], Blob(r["ids"], r["ends"], r["text"], length), r

    def to_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, blob, _ in each(batches):
            h, _ = blob.terms()
            shard = shard_of(h, shards)
            for s in np.unique(shard):
                yield pa.record_batch([pa.array([name], pa.int64()), pa.array([s], pa.int64()), pa.array([h[shard == s].tobytes()], pa.binary())], names=["blob", "shard", "terms"])

    def shared(table: pa.Table) -> pa.Table:
        lists = [np.frombuffer(x, np.uint64) for x in table["terms"].to_pylist()]
        h = np.sort(np.concatenate(lists))
        twice = np.unique(h[1:][h[1:] == h[:-1]])
        masks = []
        for x in lists:
            i = np.minimum(np.searchsorted(twice, x), max(0, len(twice) - 1))
            masks.append(np.packbits(twice[i] == x if len(twice) else np.zeros(len(x), bool)).tobytes())
        return pa.table([table["blob"], table["shard"], pa.array(masks, pa.binary())], names=["blob", "shard", "mask"])

    terms = blobs.mapInArrow(to_terms, "blob long, shard long, terms binary")
    masks = terms.groupBy("shard").applyInArrow(shared, "blob long, shard long, mask binary").groupBy("blob").agg(F.collect_list(F.struct("shard", "mask")).alias("masks"))
    masks = materialise(masks, "phrase-masks")

    def to_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, blob, r in each(batches):
            d = Dictionary(blob, repeated_terms(blob, {m["shard"]: m["mask"] for m in r["masks"] or []}, shards))
            shard = shard_of(d.trigger, shards)
            for s in np.unique(shard):
                at = np.flatnonzero(shard == s)
                some = [d.names[k] for k in at]
                row = [np.array([len(x) for x in some], np.int32).tobytes(), d.least[at].tobytes(), (d.trigger[at] & _U((1 << PART_BITS) - 1)).astype(np.uint8).tobytes(), b"".join(some)]
                yield pa.record_batch([pa.array([name], pa.int64()), pa.array([s], pa.int64()), *(pa.array([x], pa.binary()) for x in row)], names=["blob", "shard", "sizes", "docs", "parts", "text"])

    def sort_suffixes(table: pa.Table) -> pa.Table:
        sizes = [np.frombuffer(x, np.int32).astype(np.int64) for x in table["sizes"].to_pylist()]
        doc, part = (np.concatenate([np.frombuffer(x, kind) for x in table[c].to_pylist()]) for c, kind in (("docs", np.int64), ("parts", np.uint8)))
        found = repeated_strings(b"".join(table["text"].to_pylist()), np.concatenate(sizes), doc, part, length)
        cuts = np.cumsum([(s - length + 1).sum() for s in sizes])[:-1]
        return pa.table([table["blob"], table["shard"], pa.array([np.packbits(x).tobytes() for x in np.split(found, cuts)], pa.binary())], names=["blob", "shard", "found"])

    phrases = blobs.join(masks.hint("shuffle_hash"), "blob").select("blob", "ids", "ends", "text", "masks").mapInArrow(to_phrases, "blob long, shard long, sizes binary, docs binary, parts binary, text binary")
    found = phrases.groupBy("shard").applyInArrow(sort_suffixes, "blob long, shard long, found binary").groupBy("blob").agg(F.collect_list(F.struct("shard", "found")).alias("found"))
    found = materialise(masks.join(found, "blob", "left"), "phrase-matches")

    def to_results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blob, r in each(batches):
            d = Dictionary(blob, repeated_terms(blob, {m["shard"]: m["mask"] for m in r["masks"] or []}, shards))
            shard, by = shard_of(d.trigger, shards), {m["shard"]: m["found"] for m in r["found"] or []}
            many = np.array([len(x) - length + 1 for x in d.names], np.int64)
            first = np.cumsum(many) - many
            flags = np.zeros(int(many.sum()), bool)
            for s in np.unique(shard):
                at = np.flatnonzero(shard == s)
                m = many[at]
                flags[np.repeat(first[at] - (np.cumsum(m) - m), m) + np.arange(m.sum())] = unpack(by[int(s)], int(m.sum()))
            removed = np.zeros(len(blob.bytes) + 1, np.int32)
            later = d.doc > d.least[d.of] if len(d.of) else np.zeros(0, bool)  # the same phrase stands in a smaller document of this blob
            np.add.at(removed, d.at[later], 1)
            np.subtract.at(removed, d.at[later] + d.many[later] + length - 1, 1)
            at, m, of = d.at[~later], d.many[~later], d.of[~later]
            inner = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            start = (np.repeat(at, m) + inner)[flags[np.repeat(first[of], m) + inner]]
            np.add.at(removed, start, 1)
            np.subtract.at(removed, start + length, 1)
            gone = np.cumsum(removed)[:-1] > 0
            text = blob.bytes
            rows = []
            for doc, a, b in zip(blob.ids.tolist(), blob.starts.tolist(), blob.ends.tolist(), strict=True):
                g = gone[a:b]
                turn = np.flatnonzero(np.diff(g, prepend=False, append=False)).tolist()
                spans = [{"start": x, "length": y - x} for x, y in zip(turn[::2], turn[1::2], strict=True)]
                rows.append((doc, b - a, spans, (text[a:b][~g] if spans else text[a:b]).tobytes()))
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])), pa.binary()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc", "n_bytes", "spans", "kept"])

    done = blobs.join(found.hint("shuffle_hash"), "blob", "left").select("blob", "ids", "ends", "text", "masks", "found").mapInArrow(to_results, "doc long, n_bytes long, spans array<struct<start:bigint,length:bigint>>, kept binary")
    done = materialise(done, "repeats")
    return done.select(F.when(F.col("doc") != NULL_ID, F.col("doc")).alias("doc_id"), "n_bytes", "spans", "kept")
