"""Hierarchical multi-length packing of token sequences.

A document's tokens are cut and routed to tiers of context length (2048, 1024, ... 64). Whole windows of the
longest tier leave at once; what is left of a document goes to the shortest tier that holds it. Each tier is packed
into windows of its own length, long tiers and long pieces first: a piece opens a window of its tier, and the
longest pieces of shorter tiers that fit fill the gap; if none fits, one is cut, and what is left of it is routed
anew. So every window is full. What remains at the end of a run is cut into windows whose lengths are powers of
two, which need no padding. Windows are dealt to step groups of near-equal token counts.

Packing runs where the text is read: a task packs runs of documents as they stream by, so no token is shuffled
and memory is bounded by a run. A sequence id holds the task's partition and a count, so a task that is run
again gives the same ids.

Null or empty text: a document of its end token alone. Null ids stay null. Very long texts: cut into many windows. Repeated rows
are packed each for itself. Extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, tidy

LONGEST = 2048
TIERS = (2048, 1024, 512, 256, 128, 64)
END = 1
#: Sequences of a step group.
STEP = 64
#: Words and runs of letters or marks whose token ids a worker keeps.
CACHE = 600_000
#: A run of documents holds about so many bytes of text.
RUN_BYTES = 8 << 20

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, tier int, step_group long, ids binary"

#: Strings on which the whole text goes through the tokenizer: its special tokens, and separators that only Python splits at.
_WHOLE = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")
#: A word of Latin letters, whose classes no version of Unicode changes, with marks behind it.
_SIMPLE = regex.compile(r"([a-z\xDF-\xF6\xF8-\xFF\u0100-\u024F]+)([!-&(-/:-@\[-`{-~]+)?")
#: What is not Latin letters without combining marks (and not the one whose lower case has a mark): only then does normalising do more than lower().
_BEYOND = re.compile("[^\x00-\u012F\u0131-\u024F]")
#: The normaliser and the splitter that act on each white-space-separated part alone.
_BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def _byte_characters() -> list[str]:
    """The printable character of each byte in byte-level vocabularies: bytes that print stand for themselves."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [c for c in range(256) if c not in set(shown)]
    return [chr(c if c not in hidden else 256 + hidden.index(c)) for c in range(256)]


_SHOWN = _byte_characters()


class WordTokenizer:
    """Token ids as the library gives them for a whole text, by words with a bounded cache.

    Where the tokenizer's normaliser and splitter never join across white space, the ids of a text are those of its
    white-space-separated parts in turn. Each part is normalised once, by the library, and then split and looked up
    without the normaliser: lower case can leave letters that another pass would compose. Other tokenizers get whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers

        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.model, self.normalizer = self.tokenizer.model, self.tokenizer.normalizer
        self.kind = np.uint16 if max(self.tokenizer.get_vocab().values(), default=0) < 1 << 16 else np.uint32
        rules = json.loads(self.tokenizer.to_str())
        self.by_words = all(rules[k] == v for k, v in _BY_WORDS.items())
        self.known = _Cache(self.word)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def word(self, word: str) -> bytes:
        """The ids of a part without white space."""
        normal = self.normalizer.normalize_str(word) if _BEYOND.search(word) else word.lower()
        m = _SIMPLE.fullmatch(normal) if len(normal) < 200 else None
        if not m:
            return np.array(self.plain.encode(normal, add_special_tokens=False).ids, self.kind).tobytes()
        return self.piece(m[1]) + self.piece(m[2]) if m[2] else self.model_ids(m[1])

    def piece(self, piece: str) -> bytes:
        """The ids of a normal run of letters or of marks, which as a word has the same."""
        ids = self.known.get(piece)
        if ids is None:
            ids = self.known[piece] = self.model_ids(piece)
        return ids

    def model_ids(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else "".join([_SHOWN[c] for c in piece.encode()])
        return np.array([t.id for t in self.model.tokenize(shown)], self.kind).tobytes()

    def ids(self, text: str) -> np.ndarray:
        if not self.by_words or any(x in text for x in _WHOLE):
            return np.frombuffer(self.whole(text), self.kind)
        if len(self.known) > CACHE:
            self.known.clear()
        return np.frombuffer(b"".join(map(self.known.__getitem__, (text if _BEYOND.search(text) else text.lower()).split())), self.kind)


class _Cache(dict):
    def __init__(self, find: Callable[[str], bytes]):
        self.find = find

    def __missing__(self, key: str) -> bytes:
        ids = self.find(key)
        if len(key) < 200:
            self[key] = ids
        return ids


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def pack(lengths: np.ndarray, longest: int = LONGEST, tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (document, start, length). Every token lies in exactly one piece."""
    windows: list[list[tuple[int, int, int]]] = []
    waiting: list[tuple[int, int, int]] = []  # (length, document, start), ascending
    for d, n in enumerate(lengths.tolist()):
        whole = n // longest
        windows += [[(d, i * longest, longest)] for i in range(whole)]
        if n > whole * longest:
            waiting.append((n - whole * longest, d, whole * longest))
    waiting.sort(key=lambda p: (p[0], -p[1]))
    while waiting:
        # The longest that waits opens a window of its tier; pieces of shorter tiers fill the gap.
        n, d, at = waiting.pop()
        size = min(t for t in tiers if t >= n)
        window, room = [(d, at, n)], size - n
        while room and waiting:
            i = bisect_right(waiting, room, key=lambda p: p[0]) - 1
            if i >= 0:
                n, d, at = waiting.pop(i)
            else:  # all are longer: the shortest is cut, and what is left of it goes to its own tier
                n, d, at = waiting.pop(0)
                insort(waiting, (n - room, d, at + room), key=lambda p: p[0])
                n = room
            window.append((d, at, n))
            room -= n
        if not room:
            windows.append(window)
            continue
        # Nothing waits any more: windows of powers of two, without padding.
        total = size - room
        while total:
            while size > total:
                size //= 2
            part, need = [], size
            while need:
                d, at, n = window[0]
                take = min(n, need)
                part.append((d, at, take))
                window[0] = (d, at + take, n - take)
                if take == n:
                    window.pop(0)
                need -= take
            windows.append(part)
            total -= size
    return windows


def step_groups(sizes: list[int], step: int = STEP) -> list[int]:
    """A group for each window: windows, longest first, dealt to and fro over the groups, so that groups hold about as many tokens."""
    groups = max(1, -(-len(sizes) // step))
    out = [0] * len(sizes)
    for i, k in enumerate(sorted(range(len(sizes)), key=lambda k: -sizes[k])):
        turn, place = divmod(i, groups)
        out[k] = place if turn % 2 == 0 else groups - 1 - place
    return out


def pack_documents(docs: DataFrame, path: str, longest: int = LONGEST, tiers: tuple[int, ...] = TIERS, id_col: str = "doc_id") -> DataFrame:
    """A row per piece: document, start in its ids, length, sequence, offset there, tier, step group, and the ids, little-endian unsigned 32-bit."""
    if longest & (longest - 1) or tiers[0] != longest or any(t & (t - 1) for t in tiers):
        raise ValueError("tiers are powers of two and begin with the longest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        sequence, group0 = TaskContext.get().partitionId() << 33, TaskContext.get().partitionId() << 33
        for b in slices(batches, "__text", RUN_BYTES):
            ids = b.column(0).to_numpy(zero_copy_only=False) if not b.column(0).null_count else np.array(b.column(0).to_pylist(), object)
            tokens = [np.append(tok.ids(t or ""), tok.kind(END)) for t in b.column(1).to_pylist()]
            lengths = np.array([len(t) for t in tokens], np.int64)
            windows = pack(lengths, longest, tiers)
            sizes = [sum(p[2] for p in w) for w in windows]
            groups = step_groups(sizes)
            cols: list[list] = [[] for _ in range(9)]
            for w, size, g in zip(windows, sizes, groups, strict=True):
                offset = 0
                for d, at, n in w:
                    row = (ids[d], at, n, lengths[d], sequence, offset, size if size & (size - 1) == 0 else longest, group0 + g, tokens[d][at : at + n].astype("<u4").tobytes())
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                    offset += n
                sequence += 1
            group0 += max(groups, default=-1) + 1
            kinds = [pa.int64()] * 6 + [pa.int32(), pa.int64(), pa.binary()]
            for at in range(0, len(cols[0]), 4096):
                yield pa.record_batch([pa.array(c[at : at + 4096], k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col("text").alias("__text")).mapInArrow(tidy(run), SCHEMA)
