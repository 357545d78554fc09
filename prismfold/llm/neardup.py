"""MinHash near-dedup with ProbMinHash over shingles.

A text is the set of its five-word shingles. Each shingle is a Poisson process whose rate is its weight; its
arrivals fall on random registers, and a register keeps the shingle that came first. Arrivals are made in order
and a shingle stops once its next one is later than every register of its text, so long texts cost little more
than their shingles. All weights are 1, however often a shingle occurs: links are defined by the plain Jaccard
similarity, and only then is it the probability that a register agrees. Registers go into bands; texts that agree
on a band are candidates.

Texts with equal words are one class. Candidates are verified by the exact Jaccard similarity of their sets of
64-bit shingle hashes. A band's bucket is not expanded into pairs: its members are first compared with its leader,
the member that shares most buckets. A bucket of at most `SMALL` members that still joins different components then
has its other pairs compared. The members of larger such buckets, which may share only a passage, meet by an exact
prefix join (`prefix_pairs`). So every pair that agrees on a band is in one component, compared, or known to be too
different, and a bucket of copies costs one comparison a member.

Null text: a class of its own, linked with nothing. Texts without words: equal ones are one class, no other
links. Texts of one to four words: one shingle. Null ids count as the smallest. Rows that share an id and text
are copies; different texts that share an id are not linked by it. Extra columns are ignored, or kept by drop_near_duplicates.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, binaries, components, document_words, id_key, materialise, mix, shingles, slices, tidy

SHINGLE, SIMILARITY = 5, 0.8
#: A pair at 0.8 misses all 45 bands of 7 rows with probability 3e-5; at 0.4 it meets with 0.07.
BANDS, ROWS = 45, 7
#: Buckets of at most so many members have their pairs compared; classes of set sizes grow by this factor.
SMALL, SIZE_STEP = 32, 1.03
_U = np.uint64


def prob_minhash(h: np.ndarray, weight: np.ndarray, owner: np.ndarray, n: int, registers: int) -> np.ndarray:
    """Registers (n x registers) of n weighted sets: h are distinct within an owner."""
    first = np.full(n * registers, np.inf)
    who = np.zeros(n * registers, np.uint64)
    time = np.zeros(len(h))
    base, step = owner.astype(np.int64) * registers, 0
    seeds = mix(np.arange(1, 4097, dtype=np.uint64))
    while len(h):
        x = mix(h ^ seeds[step % 4096] ^ (_U(step // 4096) << _U(40)))
        # The upper bits give the waiting time, the lower ones the register.
        time = time - np.log(((x >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
        at = base + (mix(x) % _U(registers)).astype(np.int64)
        np.minimum.at(first, at, time)
        won = first[at] == time
        who[at[won]] = h[won]
        limit = first.reshape(n, registers).max(axis=1)
        go = np.flatnonzero(time < limit[base // registers])
        h, weight, base, time, step = h[go], weight[go], base[go], time[go], step + 1
    return who.reshape(n, registers)


def weighted_shingles(words: np.ndarray, bounds: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: hash (ascending within a text), text, number of occurrences."""
    h, owner = shingles(words, bounds, k)
    order = np.argsort(h)
    small = owner.astype(np.uint16) if len(bounds) < 65536 else owner
    order = order[np.argsort(small[order], kind="stable")]
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return h[at], owner[at], np.diff(np.append(at, len(h)))


def signatures(docs: DataFrame, id_col: str = "doc_id", bands: int = BANDS, rows: int = ROWS, row_col: str | None = None) -> DataFrame:
    """(k, row, t, c1, c2, n, bands): id, number of the row, hash of the text, key of the words, number of distinct shingles, band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__text"):
            texts = binaries(b.column(1))
            words, bounds = document_words(texts)
            h, owner, _ = weighted_shingles(words, bounds)
            size = np.bincount(owner, minlength=len(texts))
            who = prob_minhash(h, np.ones(len(h)), owner, len(texts), bands * rows)
            key = np.zeros((len(texts), bands), np.uint64)
            for r in range(rows):
                key = mix(key ^ who[:, r::rows]) + _U(r)
            key = mix(key ^ (np.arange(bands, dtype=np.uint64) << _U(32)))
            counts = np.diff(bounds)
            at = np.arange(len(words), dtype=np.uint64) - np.repeat(bounds[:-1], counts).astype(np.uint64)
            c = []
            for salt in (3, 5):
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words + mix(at * _U(8) + _U(salt))), dtype=np.uint64)])
                c.append(mix(total[bounds[1:]] - total[bounds[:-1]] + counts.astype(np.uint64)).view(np.int64).copy())
            there = b.column(1).is_valid().to_pylist()
            for d in np.flatnonzero(counts == 0):
                name = b"text" + texts[d] if there[d] else b"null%d" % b.column(0)[int(d)].as_py()
                c[0][d], c[1][d] = np.frombuffer(hashlib.blake2b(name, digest_size=16).digest(), np.int64)
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.where(size > 0, bands, 0))]).astype(np.int32), pa.array(key[size > 0].reshape(-1).view(np.int64)))
            yield pa.record_batch([b.column(0), b.column(2), b.column(3), pa.array(c[0]), pa.array(c[1]), pa.array(size, pa.int64()), lists], names=["k", "row", "t", "c1", "c2", "n", "bands"])

    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    return docs.select(id_key(id_col).alias("k"), F.col("text").alias("__text"), row.alias("row"), F.xxhash64("text").alias("t")).mapInArrow(tidy(run), "k long, row long, t long, c1 long, c2 long, n long, bands array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(cls, hashes): the distinct shingles of the wanted classes (cls, k, t), from a document with this id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__text"):
            texts = binaries(b.column(1))
            h, owner, _ = weighted_shingles(*document_words(texts))
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))]).astype(np.int32)
            yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(ends, pa.array(h.view(np.int64)))], names=["cls", "hashes"])

    text = docs.select(id_key(id_col).alias("k"), F.xxhash64("text").alias("t"), F.col("text").alias("__text"))
    # Repeated rows, alike in id and text, give a class its set more than once.
    found = text.join(wanted.select("cls", "k", "t").hint("shuffle_hash"), ["k", "t"]).select("cls", "__text")
    return found.mapInArrow(tidy(run), "cls long, hashes array<long>")


def compare(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have at least this Jaccard similarity."""
    left = sets.select(F.col("cls").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("cls").alias("b"), F.col("hashes").alias("y"))
    both = F.size(F.array_intersect("x", "y")).alias("i")
    ratio = pairs.join(left, "a").join(right, "b").select("a", "b", both, (F.size("x") + F.size("y")).alias("s"))
    return ratio.where(F.col("i") >= F.lit(similarity) * (F.col("s") - F.col("i")) - 1e-9).select("a", "b")


def prefix_pairs(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of different components that can have this similarity, by an exact prefix join.

    Shingles are ordered from rare to frequent. Two sets of sizes s <= z with Jaccard similarity t share at least
    o = t / (1 + t) * (s + z) shingles, so the first shared one has at least o - 1 others behind it in either set.
    A set whose shingle has `rest` others behind it therefore allows partners of at most `most` =
    (1 + rest) * (1 + t) / t - size shingles. The smaller set of a pair sends its shingle to each class of sizes up
    to that bound, the larger one to its own class, and a pair meets only if both bounds hold: a passage that many
    texts share leads to a pair only where it is so long in both that they are links. Sets of the component that
    fills most of a bucket meet the others only.
    """
    one = members.select("cls", "n", "comp").distinct()
    whole = one.join(sets, "cls").groupBy("cls", "n", "comp").agg(F.first("hashes").alias("hashes"))  # repeated rows give a set more than once
    tokens = materialise(whole.select("cls", "n", "comp", F.explode("hashes").alias("h")), "prefix-shingles")
    often = tokens.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    ordered = tokens.join(often, "h").groupBy("cls", "n", "comp").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("t"))
    # Shingles of one member come before all others and meet nothing.
    alone = F.col("n") - F.size("t")
    first = F.greatest(F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - 1e-9) + 1 - alone, F.lit(0)).cast("int")
    at = ordered.select("cls", "n", "comp", alone.alias("alone"), F.posexplode(F.slice("t", F.lit(1), first)).alias("pos", "x"))
    rest = F.col("n") - F.col("alone") - F.col("pos") - 1
    at = at.select(F.col("x.h").alias("h"), "cls", "n", "comp", F.floor((1 + rest) * ((1 + similarity) / similarity) - F.col("n") + 1e-6).alias("most"))
    size_class = lambda c: F.floor(F.log(c.cast("double")) / math.log(SIZE_STEP)).cast("int")
    small = at.where("most >= n").select("*", F.explode(F.sequence(size_class(F.col("n")), size_class(F.least(F.col("most"), F.floor(F.col("n") / similarity + 1e-6))))).alias("c"), F.lit(True).alias("small"))
    at = materialise(small.union(at.select("*", size_class(F.col("n")).alias("c"), F.lit(False).alias("small"))), "prefix-buckets")
    shares = at.groupBy("h", "c", "comp").agg(F.count("*").alias("k"))
    mixed = shares.groupBy("h", "c").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.count("*").alias("comps")).where("comps > 1").select("h", "c", "main")
    at = at.join(mixed, ["h", "c"])
    x = at.where("small").select("h", "c", F.col("cls").alias("a"), F.col("n").alias("an"), F.col("comp").alias("ac"), F.col("most").alias("am"), "main")
    y = at.where("NOT small").select("h", "c", F.col("cls").alias("b"), F.col("n").alias("bn"), F.col("comp").alias("bc"), F.col("most").alias("bm"), F.col("main").alias("bmain"))
    meet = (F.col("ac") != F.col("bc")) & (F.col("bn") <= F.col("am")) & (F.col("an") <= F.col("bm")) & ((F.col("an") < F.col("bn")) | ((F.col("an") == F.col("bn")) & (F.col("a") < F.col("b"))))
    others = x.where("ac <> main").join(y, ["h", "c"]).where(meet).select("a", "b")
    main = x.where("ac = main").join(y.where("bc <> bmain"), ["h", "c"]).where(meet).select("a", "b")
    return others.union(main).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _near_rows(docs: DataFrame, similarity: float, id_col: str, row_col: str | None = None) -> DataFrame:
    """k, class, row and kept of each document; one row of each component is kept, that with the smallest id and number."""
    signed = materialise(signatures(docs, id_col, row_col=row_col), "signatures")
    # Classes are numbered, and fetched by id and text: ids may be null or shared by different texts.
    classes = signed.groupBy("c1", "c2").agg(F.min(F.struct("k", "row")).alias("least"), F.min_by("t", F.struct("k", "row")).alias("t"), F.min("n").alias("n"), F.min_by("bands", F.struct("k", "row")).alias("bands"))
    classes = materialise(classes.select("c1", "c2", "least", F.col("least.row").alias("cls"), F.col("least.k").alias("k"), "t", "n", "bands"), "classes")
    exploded = classes.select("cls", "n", F.explode("bands").alias("bucket"))
    full = exploded.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = materialise(exploded.join(full, "bucket"), "bucket-members")
    popular = shared.groupBy("cls").agg(F.sum("size").alias("pop"))
    members = shared.join(popular, "cls")
    ratio = lambda x, y: F.least(x, y) >= F.lit(similarity) * F.greatest(x, y) - 1e-9

    # First each member with the leader of its bucket.
    leaders = members.groupBy("bucket").agg(F.min_by(F.struct("cls", "n"), F.struct(-F.col("pop"), F.col("cls"))).alias("m")).select("bucket", F.col("m.cls").alias("leader"), F.col("m.n").alias("ln"))
    members = materialise(shared.join(leaders, "bucket"), "bucket-members")
    sets = materialise(shingle_sets(docs, classes.join(popular, "cls", "left_semi"), id_col), "shingle-sets")
    pairs = members.where((F.col("cls") != F.col("leader")) & ratio("n", "ln")).select(F.least("cls", "leader").alias("a"), F.greatest("cls", "leader").alias("b"))
    links = materialise(compare(pairs.distinct(), sets, similarity), "links")
    tree = materialise(components(links, "near-components"), "near-components")

    # Then, where a bucket still joins different components, its other pairs.
    members = members.join(tree.withColumnRenamed("node", "cls"), "cls", "left").select("bucket", "cls", "n", "size", "leader", F.coalesce("component", "cls").alias("comp"))
    mixed = members.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket")
    members = materialise(members.join(mixed, "bucket"), "bucket-members")
    few = members.where((F.col("size") <= SMALL) & (F.col("cls") != F.col("leader")))
    other = few.select("bucket", F.col("cls").alias("b"), F.col("n").alias("bn"), F.col("comp").alias("bc"))
    pairs = few.join(other, "bucket").where((F.col("cls") < F.col("b")) & (F.col("comp") != F.col("bc")) & ratio("n", "bn")).select(F.col("cls").alias("a"), "b")
    pairs = pairs.union(prefix_pairs(members.where(F.col("size") > SMALL), sets, similarity)).distinct()
    found = materialise(compare(pairs, sets, similarity), "links")
    tree = materialise(components(links.union(found), "near-components"), "near-components")

    named = classes.select("c1", "c2", "least", "cls").join(tree.withColumnRenamed("node", "cls"), "cls", "left").select("c1", "c2", "least", F.coalesce("component", "cls").alias("cls"))
    first = named.groupBy("cls").agg(F.min("least").alias("first"))
    named = named.join(first, "cls").select("c1", "c2", "first")
    out = signed.join(named, ["c1", "c2"])
    return out.select("k", F.col("first.k").alias("class"), "row", (F.col("row") == F.col("first.row")).alias("kept"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id") -> DataFrame:
    """doc_id, class_id (the smallest id that links reach) and kept (one row of each class, of that id) of each document."""
    back = lambda c, to: F.when(F.col(c) != NULL_ID, F.col(c)).alias(to)
    return _near_rows(docs, similarity, id_col).select(back("k", "doc_id"), back("class", "class_id"), "kept")


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id") -> DataFrame:
    """The documents, all columns, of which one row in each class stays: one with the smallest id."""
    row = "__row"
    while row in docs.columns:
        row += "_"
    numbered = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "numbered-rows")
    gone = _near_rows(numbered, similarity, id_col, row).where("NOT kept").select(F.col("row").alias(row))
    return numbered.join(gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
