"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of ten consecutive words of every benchmark item; an item of fewer
words is one window. Documents become arrays of word numbers (0 for words that no benchmark
item has). A block is two adjacent words. The shift table tells for each block's hash how
far the window may move on, mostly nine words; where the shift is zero, the hashes of the
window's last and first block select a bucket of patterns, which are compared word by word.
Many cursors advance together, each over its own stretch of the batch.

The benchmark is read in parts of at most ``PART_BYTES`` of text, each with its own word numbers
and windows, so the driver never holds more than one part. A benchmark of one part is
broadcast; of several, each is a file in the shared folder, loaded by the tasks in turn.

Defined cases: null texts have no words; items without words match nothing; repeated items
and windows count once each; a null item_id is the item ``null``; a very long text is one
array; an empty benchmark leaves all documents clean; other columns pass through
``keep_clean`` untouched.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from meshwright.llm.common import open_fs, shared_folder, small_arrow_batches, text_bytes

WINDOW = 10
TABLE_BITS = 16
PART_BYTES = 8 << 20
#: A-Z become a-z; 0-9, a-z and bytes from 0x80 are word bytes; all else parts words.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_BYTES).split()


class Block:
    """Windows of one length and their shift and bucket tables."""

    def __init__(self, length: int, windows: np.ndarray, items: list[np.ndarray]):
        self.m, self.windows, self.items = length, windows, items  # items[i]: item numbers that hold window i
        self.b = min(2, length)
        default = length - self.b + 1
        self.shift = np.full(1 << TABLE_BITS, default, np.uint8)
        for at in range(length - self.b + 1):  # later blocks allow smaller shifts only
            h = self._hash(*(windows[:, at + i] for i in range(self.b)))
            np.minimum.at(self.shift, h, np.uint8(length - self.b - at))
        keys = self._bucket(*(windows[:, i] for i in (0, self.b - 1, length - self.b, length - 1)))
        order = np.argsort(keys, kind="stable")
        self.order, self.keys = order, keys[order]

    @staticmethod
    def _hash(*cols: np.ndarray) -> np.ndarray:
        h = np.zeros(len(cols[0]), np.uint32)
        for c in cols:
            h = (h ^ c.astype(np.uint32)) * np.uint32(2654435761)
        return h >> np.uint32(32 - TABLE_BITS)

    @staticmethod
    def _bucket(*cols: np.ndarray) -> np.ndarray:
        h = np.zeros(len(cols[0]), np.uint64)
        for c in cols:
            h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    def find(self, text: np.ndarray, lanes: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """(end position, window number) of every occurrence in an array of word numbers."""
        n, m = len(text), self.m
        if n < m or not len(self.windows):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        edges = np.linspace(m - 1, n, min(lanes, n - m + 1) + 1).astype(np.int64)
        at, stop = edges[:-1].copy(), edges[1:].copy()
        live = at < stop
        at, stop = at[live], stop[live]
        ends: list[np.ndarray] = []
        while len(at):
            step = self.shift[self._hash(*(text[at - self.b + 1 + i] for i in range(self.b)))]
            hit = step == 0
            if hit.any():
                ends.append(at[hit])
                step = np.maximum(step, 1)
            at = at + step
            live = at < stop
            if not live.all():
                at, stop = at[live], stop[live]
        if not ends:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        e = np.concatenate(ends)
        first = e - m + 1
        key = self._bucket(text[first], text[first + self.b - 1], text[e - self.b + 1], text[e])
        lo, hi = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        count = hi - lo
        e, lo, count = e[count > 0], lo[count > 0], count[count > 0]
        if not len(e):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        rep = np.repeat(np.arange(len(e)), count)
        which = self.order[np.arange(len(rep)) - np.repeat(np.cumsum(count) - count, count) + lo[rep]]
        same = (text[e[rep][:, None] + np.arange(1 - m, 1)] == self.windows[which]).all(1)
        return e[rep][same], which[same]


class Patterns:
    """Word numbers, item names and windows of a part of a benchmark."""

    def __init__(self, rows: list[tuple[object, bytes | None]], window: int = WINDOW):
        self.names = sorted({name_of(i) for i, _ in rows})
        number = {x: k for k, x in enumerate(self.names)}
        self.vocab: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple[int, ...], set[int]]] = {}
        for item, text in rows:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)]
            m = min(window, len(ids))
            for at in range(len(ids) - m + 1 if m else 0):
                by_length.setdefault(m, {}).setdefault(tuple(ids[at : at + m]), set()).add(number[name_of(item)])
        self.blocks = [
            Block(m, np.array(keys, np.int32).reshape(-1, m), [np.array(sorted(found[k])) for k in keys])
            for m, found in sorted(by_length.items()) for keys in [sorted(found)]
        ]

    def mark(self, words: list[list[bytes]], starts: np.ndarray, hit: np.ndarray, items: dict[int, set[str]]) -> None:
        """Set the places of hit words, and add the items found to their documents."""
        flat = np.zeros(int(starts[-1]), np.int32)  # one 0 parts documents; no window holds it
        get = self.vocab.get
        for w, s in zip(words, starts, strict=False):
            flat[s : s + len(w)] = [get(x, 0) for x in w]
        edge = np.zeros(len(flat) + 1, np.int32)
        for block in self.blocks:
            end, which = block.find(flat)
            np.add.at(edge, end - block.m + 1, 1)
            np.add.at(edge, end + 1, -1)
            doc = np.searchsorted(starts, end, "right") - 1
            for d, w in set(zip(doc.tolist(), which.tolist(), strict=True)):
                items.setdefault(d, set()).update(self.names[k] for k in block.items[w].tolist())
        hit |= np.cumsum(edge[:-1]) > 0


def name_of(item: object) -> str:
    return "null" if item is None else str(item)


class Matcher:
    """Sent to the tasks: the only part of the benchmark or, where there are more, their files."""

    def __init__(self, benchmark: DataFrame, window: int = WINDOW, bound: int = PART_BYTES):
        spark = benchmark.sparkSession
        self.files: list[str] = []
        folder, rows, size = "", [], 0

        def to_file() -> None:
            nonlocal folder
            folder = folder or shared_folder(spark, "patterns")
            fs, inner = open_fs(folder)
            fs.create_dir(inner, recursive=True)
            path = f"{len(self.files)}.part"
            with fs.open_output_stream(f"{inner}/{path}", compression=None) as out:
                out.write(pickle.dumps(Patterns(rows, window)))
            self.files.append(f"{folder}/{path}")

        for r in benchmark.selectExpr("item_id", "cast(text AS binary) AS text").toLocalIterator():
            text = bytes(r["text"]) if r["text"] is not None else None
            if rows and size + len(text or b"") > bound:
                to_file()
                rows, size = [], 0
            rows.append((r["item_id"], text))
            size += len(text or b"")
        if self.files:
            to_file()
            rows = []
        self.shared = spark.sparkContext.broadcast(Patterns(rows, window))

    def _parts(self) -> Iterator[Patterns]:
        yield self.shared.value
        for path in self.files:
            fs, inner = open_fs(path)
            with fs.open_input_stream(inner, compression=None) as src:
                yield pickle.loads(src.read())

    def search(self, texts: list[bytes | None]) -> list[tuple[int, int, list[str]]]:
        """(words, words hit, item ids as strings) of each text."""
        words = [words_of(t) for t in texts]
        size = np.array([len(w) for w in words], np.int64)
        starts = np.concatenate([[0], np.cumsum(size + 1)]).astype(np.int64)
        hit, items = np.zeros(int(starts[-1]), bool), {}
        for part in self._parts():
            part.mark(words, starts, hit, items)
        total = np.concatenate([[0], np.cumsum(hit)])
        hits = total[starts[1:]] - total[starts[:-1]]
        return [(int(n), int(h), sorted(items.get(i, ()))) for i, (n, h) in enumerate(zip(size, hits, strict=True))]


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, items array<string> for every row of docs."""
    small_arrow_batches(docs.sparkSession)
    matcher = Matcher(benchmark, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = matcher.search(text_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.string()))))],
                names=["doc_id", "n_words", "n_hit", "items"])

    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_hit long, items array<string>")


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs in which no window of the benchmark occurs, all columns as they were."""
    small_arrow_batches(docs.sparkSession)
    matcher = Matcher(benchmark, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = matcher.search(text_bytes(batch.column(batch.schema.get_field_index("text"))))
            yield batch.filter(pa.array([f[1] == 0 for f in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
