"""Scoring of texts by a hierarchical Pitman-Yor model.

Tokens are lower-cased words and one end per text. Every word of the training texts is a dish of
its own and, as the context of the token after it, a restaurant of its own; all unknown words are one
more dish. Context restaurants share the unigram restaurant as parent, and that one has the uniform base.

Words are numbered in the order of their hashes. What is kept of a word (count, tables in both
restaurants) lies in files of one number a word, in the shared folder, which workers map. Cells
(context, word) are counted from every training text in ranges of contexts, those of very frequent
contexts in ranges of words, one file a range; files grow with the corpus, a range does not where
there are more of them. Gibbs sweeps re-seat all customers of a cell given the last sweep's tables of its
restaurant and of the parent: each range seats its own cells and sends the sums of tables by word and by
context to ranges of words, where the parent is seated. A cell of one customer has one table
and is sent once. The first few customers of a cell are seated one by one, later ones in blocks of at most 15 %
of those seated. Tables and the parent's predictions are averaged over the sweeps after burn-in.

A token's probability is the back-off (parent's prediction x the weight of its context, both mapped), times a
gain where the cell is known. Texts are scored in one pass that sends the cell of each token, with its
place, to the range that holds it; sums per text travel back. The cells that occur most are sent to
every worker instead.

Defined cases: a null or empty text is one end token; with no training texts every word is
unknown and has probability 1; a null doc_id belongs to the training fold;
repeated rows count as often as they occur; a very long text is a batch of its own; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.llm.common import ASCII_LOWER, WordHashes, fold_of, open_fs, shared_folder, small_arrow_batches, text_bytes

#: At most so many cells are sent to every worker.
FREQUENT = 1 << 14
LOW = (1 << 32) - 1
FLUSH_BYTES = 8 << 20
FLUSH_DOCS = 60_000  # places in a batch are 16 bits
END = b" "


def tokens(texts: list[bytes | None], table: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of the texts, and the number of tokens of each."""
    words = [(t or b"").translate(ASCII_LOWER).split() for t in texts]
    size = np.array([len(w) + 1 for w in words], np.int64)
    out = np.empty(int(size.sum()), np.uint64)
    at = 0
    for w in words:
        out[at : at + len(w)] = table.of(w)
        out[at + len(w)] = table[END]
        at += len(w) + 1
    return out, size


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes | None], list[bool]]]:
    """Rows of Arrow batches gathered into groups of bounded size: doc_ids, texts, training flags."""
    ids, texts, train, size = [], [], [], 0
    for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
        part = text_bytes(batch.column("text"))
        ids += batch.column("doc_id").to_pylist()
        texts += part
        train += batch.column("train").to_pylist()
        size += sum(len(t or b"") for t in part)
        if size >= FLUSH_BYTES or len(ids) >= FLUSH_DOCS:
            yield ids, texts, train
            ids, texts, train, size = [], [], [], 0
    if ids:
        yield ids, texts, train


def sum_by_key(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def cut_by_bucket(h: np.ndarray, bits: int) -> np.ndarray:
    """Bounds of the hash ranges in a sorted array."""
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate([[0], np.searchsorted(h, edges), [len(h)]])


def before(number: np.ndarray, size: np.ndarray, end: int) -> np.ndarray:
    """The context each token stands in: the word before, or the end where a text begins."""
    out = np.empty_like(number)
    out[1:] = number[:-1]
    out[np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)] = end
    return out


def pack(key: np.ndarray, *more: np.ndarray) -> bytes:
    """Sorted pairs of numbers and columns beside them, compressed."""
    raw = b"".join([np.diff(key >> 32, prepend=0).astype("<i4").tobytes(), (key & LOW).astype("<u4").tobytes(), *(x.tobytes() for x in more)])
    return np.array([len(key), len(raw)], "<i8").tobytes() + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    n, size = np.frombuffer(data, "<i8", 2)
    raw = pa.Codec("zstd").decompress(data[16:], int(size), asbytes=True) if size else b""
    out, at = [np.cumsum(np.frombuffer(raw, "<i4", n), dtype=np.int64) << 32 | np.frombuffer(raw, "<u4", n, 4 * n)], 8 * int(n)
    for kind in kinds:
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    return out


def put(path: str, data: bytes) -> None:
    """A whole file; a task that runs twice writes the same one."""
    with open(new := f"{path}.{uuid.uuid4().hex}", "wb") as f:
        f.write(data)
    os.replace(new, path)


def get(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


@dataclass
class Model:
    """A fit: its folder, which all workers see as a path, and its totals."""

    path: str
    ranges: int
    sweeps: int = 6
    burn_in: int = 2
    theta: float = 10.0
    seed: int = 23
    n: int = 0  # training tokens
    v: int = 0  # words in them
    d: float = 0.5
    d0: float = 0.5
    frequent_from: float = 0
    totals: dict[int, tuple[int, int]] = field(default_factory=dict)  # of a sweep: customers and tables of the parent
    frequent: tuple[np.ndarray, np.ndarray] | None = None

    @property
    def edges(self) -> np.ndarray:
        return np.array([self.v * k // self.ranges for k in range(self.ranges + 1)], np.int64)

    @property
    def parts(self) -> np.ndarray:
        """Edges of the ranges of words in which the parent is seated: fewer, so that pieces are few and not tiny."""
        n = max(16, 1 << (self.ranges.bit_length() // 2))
        return np.array([self.v * k // n for k in range(n + 1)], np.int64)

    @property
    def kept(self) -> list[int]:
        return [k for k in range(self.sweeps) if k >= self.burn_in] or [self.sweeps - 1]

    def of(self, name: str, kind: str) -> np.ndarray:
        """A file of one number a word."""
        return np.memmap(f"{self.path}/{name}", kind, "r") if self.v else np.zeros(0, kind)

    def new(self, name: str, kind: str) -> None:
        with open(f"{self.path}/{name}", "wb") as f:
            f.truncate(self.v * np.dtype(kind).itemsize)

    def fill(self, name: str, lo: int, values: np.ndarray) -> None:
        with open(f"{self.path}/{name}", "r+b") as f:
            f.seek(lo * values.itemsize)
            f.write(values.tobytes())

    def drop(self, *starts: str) -> None:
        for name in os.listdir(self.path):
            if name.startswith(starts):
                os.remove(f"{self.path}/{name}")

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of sorted hashes; -1: unknown."""
        hashes = self.of("hashes", "<u8")
        if not self.v:
            return np.full(len(h), -1, np.int64)
        at = np.minimum(np.searchsorted(hashes, h), self.v - 1)
        return np.where(hashes[at] == h, at, -1)

    def numbers(self, texts: list[bytes | None], table: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number, number of the context) of all tokens, and how many each text has."""
        h, size = tokens(texts, table)
        distinct, which = np.unique(h, return_inverse=True)
        number = self.find(distinct)[which]
        end = self.find(np.array([table[END]], np.uint64))[0]
        return number, before(number, size, end), size

    def deal(self, key: np.ndarray, *more: np.ndarray) -> list[tuple[int, bytes]]:
        """Packed pieces of sorted cells by the range that holds them; very frequent contexts are spread by word."""
        u, w = key >> 32, key & LOW
        at = np.searchsorted(self.edges, np.where(self.of("counts", "<i8")[u] * 2 * self.ranges > self.n, w, u), "right") - 1
        order = np.argsort(at.astype(np.uint16), kind="stable")
        cut = np.searchsorted(at[order], np.arange(self.ranges + 1))
        return [(p, pack(*(x[order[a:b]] for x in (key, *more)))) for p, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if b > a]

    def base(self, c0: np.ndarray, t0: np.ndarray, k: int) -> np.ndarray:
        """The parent's predictions after sweep k."""
        customers, tables = self.totals[k]
        return (c0 - self.d0 * t0 + (self.theta + self.d0 * tables) / (self.v + 1)) / (customers + self.theta)

    def gains(self, key: np.ndarray, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        """log10 of what known cells multiply the back-off by; t: their mean tables."""
        u, w = key >> 32, key & LOW
        low = 10.0 ** (self.of("log_weight", "<f8")[u] + self.of("log_base", "<f8")[w])
        return np.log10(1 + (c - self.d * t) / ((self.of("counts", "<i8")[u] + self.theta) * low))

    def many(self, p: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cells of more than one customer of a range: key, customers, tables after sweep k, their sum over kept sweeps."""
        key, c = unpack(get(f"{self.path}/many-{p}"), "<u4")
        t = np.frombuffer(get(f"{self.path}/seats{k}-{p}"), "<u4").astype(np.int64) if k >= -1 else np.ones(2 * len(key), np.int64)
        return key, c.astype(np.int64), t[: len(key)], t[len(key) :]

    def range_gains(self, p: int) -> tuple[np.ndarray, np.ndarray]:
        if not os.path.exists(f"{self.path}/many-{p}"):  # no training text has a cell here
            return np.zeros(0, np.int64), np.zeros(0)
        key, c, _, total = self.many(p, self.sweeps - 1)
        (once,) = unpack(get(f"{self.path}/once-{p}"))
        one = np.ones(len(once))
        keys = np.concatenate([key, once])
        gain = np.concatenate([self.gains(key, c, total / len(self.kept)), self.gains(once, one, one)])
        order = np.argsort(keys, kind="stable")
        return keys[order], gain[order]


def _let_go(spark: SparkSession) -> None:
    """Files of shuffles go with their plans."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def _each_range(spark: SparkSession, ranges: int) -> DataFrame:
    return spark.range(0, ranges, 1, ranges)


def _pieces(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["p", "payload"])


def count_words(docs: DataFrame, model: Model) -> None:
    """Files hashes and counts of the words of the training texts, and both totals."""
    bits = model.ranges.bit_length() - 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()
        for _, texts, train in groups(batches):
            h, _ = tokens([t for t, x in zip(texts, train, strict=True) if x], table)
            keys, counts = np.unique(h, return_counts=True)
            cut = cut_by_bucket(keys, bits)
            yield _pieces([(p, keys[a:b].tobytes() + counts[a:b].astype("<u4").tobytes()) for p, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if b > a])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for p, raw in zip(batch.column("p").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                n = len(raw) // 12
                part = held.setdefault(p, [])
                part.append((np.frombuffer(raw, "<u8", n), np.frombuffer(raw, "<u4", n, 8 * n).astype(np.int64)))
                if len(part) > 64:
                    held[p] = [sum_by_key(*(np.concatenate(x) for x in zip(*part, strict=True)))]
        for p, part in held.items():
            keys, counts = sum_by_key(*(np.concatenate(x) for x in zip(*part, strict=True)))
            put(f"{model.path}/words-{p}", keys.astype("<u8").tobytes() + counts.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([int(counts.sum())], pa.int64())], names=["p", "v", "n"])

    spread = docs.mapInArrow(count, "p int, payload binary").repartitionById(model.ranges, F.col("p"))
    with open(f"{model.path}/hashes", "wb") as hashes, open(f"{model.path}/counts", "wb") as counts:
        for r in sorted(spread.mapInArrow(merge, "p int, v long, n long").collect()):  # one small row a range
            raw = get(f"{model.path}/words-{r['p']}")
            hashes.write(raw[: 8 * r["v"]])
            counts.write(raw[8 * r["v"] :])
            model.v, model.n = model.v + r["v"], model.n + r["n"]
    model.drop("words-")


def count_cells(docs: DataFrame, model: Model) -> None:
    """Two files a range: the cells of one customer, and those of more with their customers; and the discount."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()
        for _, texts, train in groups(batches):
            number, context, _ = model.numbers([t for t, x in zip(texts, train, strict=True) if x], table)
            key, c = np.unique(context << 32 | number, return_counts=True)
            yield _pieces(model.deal(key, c.astype("<u4")))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for p, raw in zip(batch.column("p").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                key, c = unpack(raw, "<u4")
                part = held.setdefault(p, [])
                part.append((key, c.astype(np.int64)))
                if len(part) > 64:
                    held[p] = [sum_by_key(*(np.concatenate(x) for x in zip(*part, strict=True)))]
        for p, part in held.items():
            key, c = sum_by_key(*(np.concatenate(x) for x in zip(*part, strict=True)))
            put(f"{model.path}/once-{p}", pack(key[c == 1]))
            put(f"{model.path}/many-{p}", pack(key[c > 1], c[c > 1].astype("<u4")))
            yield pa.RecordBatch.from_arrays([pa.array([int((c == 1).sum())], pa.int64()), pa.array([int((c == 2).sum())], pa.int64())], names=["one", "two"])

    spread = docs.mapInArrow(count, "p int, payload binary").repartitionById(model.ranges, F.col("p"))
    found = spread.mapInArrow(merge, "one long, two long").collect()  # one small row a range
    model.d = discount_of(sum(r["one"] for r in found), sum(r["two"] for r in found))


def sweep(spark: SparkSession, model: Model, k: int) -> None:
    """Files c0, t0 (the parent) and t_u (tables of each context) after sweep k; -1: one table a cell."""
    last, edges = k - 1, model.parts
    for name in ("c0", "t0", "t_u"):
        model.new(f"{name}.{k}.u4", "<u4")
    if k < 0:
        model.new("once_w", "<u4")
        model.new("once_u", "<u4")

    def seats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in (p for b in batches for p in b.column(0).to_pylist()):
            rows: list[tuple[int, bytes]] = [(p, b"")] if p < len(edges) - 1 else []  # every range of words is seated
            if os.path.exists(f"{model.path}/many-{p}"):
                key, c, t, total = model.many(p, last)
                u, w = key >> 32, key & LOW
                if k >= 0:
                    base = model.base(model.of(f"c0.{last}.u4", "<u4")[w].astype(np.int64), model.of(f"t0.{last}.u4", "<u4")[w].astype(np.int64), last)
                    t = seat(c, model.of(f"t_u.{last}.u4", "<u4")[u].astype(np.int64) - t, base, model.theta, model.d, np.random.default_rng([model.seed, k, p]))
                total = total + t if k in model.kept and k > model.kept[0] else t
                put(f"{model.path}/seats{k}-{p}", t.astype("<u4").tobytes() + total.astype("<u4").tobytes())
                sums = [(0, w, t), (1, u, t)]
                if k < 0:
                    (once,) = unpack(get(f"{model.path}/once-{p}"))
                    sums += [(2, once & LOW, np.ones(len(once), np.int64)), (3, once >> 32, np.ones(len(once), np.int64))]
                cells, x = sum_by_key(np.concatenate([kind << 32 | number for kind, number, _ in sums]), np.concatenate([x for *_, x in sums]))
                part = np.searchsorted(edges, cells & LOW, "right") - 1
                order = np.argsort(part.astype(np.uint16), kind="stable")
                cut = np.searchsorted(part[order], np.arange(len(edges)))
                rows += [(r, pack(cells[order[a:b]], x[order[a:b]].astype("<u4"))) for r, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if b > a]
            yield _pieces(rows)

    def parent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for r, raw in zip(batch.column("p").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                dense = held.setdefault(r, np.zeros((4, edges[r + 1] - edges[r]), np.int64))
                if raw:
                    key, x = unpack(raw, "<u4")
                    dense[key >> 32, (key & LOW) - edges[r]] += x
        for r, (w, u, once_w, once_u) in held.items():
            lo, hi = edges[r], edges[r + 1]
            if k < 0:
                model.fill("once_w", lo, once_w.astype("<u4"))
                model.fill("once_u", lo, once_u.astype("<u4"))
            else:
                once_w, once_u = model.of("once_w", "<u4")[lo:hi], model.of("once_u", "<u4")[lo:hi]
            c0, t_u, t0 = w + once_w, u + once_u, np.minimum(w + once_w, 1)
            if k >= 0:
                others = model.totals[last][1] - model.of(f"t0.{last}.u4", "<u4")[lo:hi].astype(np.int64)
                t0 = seat(c0, others, np.full(len(c0), 1 / (model.v + 1)), model.theta, model.d0, np.random.default_rng([model.seed, k, r, 1]))
            for name, x in (("c0", c0), ("t0", t0), ("t_u", t_u)):
                model.fill(f"{name}.{k}.u4", lo, x.astype("<u4"))
            yield pa.RecordBatch.from_arrays([pa.array([int(c0.sum())], pa.int64()), pa.array([int(t0.sum())], pa.int64())], names=["c0", "t0"])

    spread = _each_range(spark, model.ranges).mapInArrow(seats, "p int, payload binary").repartitionById(len(edges) - 1, F.col("p"))
    found = spread.mapInArrow(parent, "c0 long, t0 long").collect()  # one small row a range
    model.totals[k] = sum(r["c0"] for r in found), sum(r["t0"] for r in found)
    model.drop(f"seats{last}-", *(f"{x}.{last}.u4" for x in ("c0", "t0", "t_u") if last not in model.kept))


def average(spark: SparkSession, model: Model) -> None:
    """Files log_base (the parent's mean prediction of a word) and log_weight (of the parent, in a context), and the frequent cells."""
    model.new("log_base", "<f8")
    model.new("log_weight", "<f8")
    edges, kept = model.edges, model.kept

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (r for b in batches for r in b.column(0).to_pylist()):
            lo, hi = edges[r], edges[r + 1]
            base, t_u = np.zeros(hi - lo), np.zeros(hi - lo)
            for k in kept:
                base += model.base(model.of(f"c0.{k}.u4", "<u4")[lo:hi].astype(np.int64), model.of(f"t0.{k}.u4", "<u4")[lo:hi].astype(np.int64), k) / len(kept)
                t_u += model.of(f"t_u.{k}.u4", "<u4")[lo:hi] / len(kept)
            model.fill("log_base", lo, np.log10(base))
            model.fill("log_weight", lo, np.log10((model.theta + model.d * t_u) / (model.of("counts", "<i8")[lo:hi] + model.theta)))
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int64())], names=["r"])

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in (p for b in batches for p in b.column(0).to_pylist()):
            if os.path.exists(f"{model.path}/many-{p}"):
                key, c, _, total = model.many(p, model.sweeps - 1)
                at = c > model.frequent_from
                yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(model.gains(key[at], c[at], total[at] / len(kept)))], names=["key", "gain"])

    _each_range(spark, model.ranges).mapInArrow(means, "r long").collect()
    model.drop(*(f"{x}.{k}.u4" for x in ("c0", "t0", "t_u") for k in kept), "once_")
    rows = sorted((r["key"], r["gain"]) for r in _each_range(spark, model.ranges).mapInArrow(frequent, "key long, gain double").collect())  # FREQUENT at most
    model.frequent = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows])


def seat(c: np.ndarray, others: np.ndarray, base: np.ndarray, theta: float, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables after seating c customers of each cell; others: tables of the rest of its restaurant."""
    t = (c > 0).astype(np.int64)
    live = np.flatnonzero(c > 1)
    n = np.ones(len(live), np.int64)
    while len(live):
        step = np.minimum(np.maximum(1, n * 15 // 100), c[live] - n)
        new = (theta + d * (others[live] + t[live])) * base[live]
        t[live] += rng.binomial(step, new / (new + n - d * t[live]))
        n += step
        more = n < c[live]
        live, n = live[more], n[more]
    return t


def discount_of(one: int, two: int) -> float:
    """n1 / (n1 + 2 n2), kept inside (0.05, 0.95)."""
    return float(np.clip(one / (one + 2 * two) if one + two else 0.5, 0.05, 0.95))


def train(codes: np.ndarray, c: np.ndarray, sweeps: int = 6, burn_in: int = 2, theta: float = 10.0, seed: int = 23, *, contexts: int, dishes: int) -> np.ndarray:
    """The same sweeps over few cells in memory: log10 of the averaged predictive probabilities, contexts x dishes (float32)."""
    rng = np.random.default_rng(seed)
    u, w = codes // dishes, codes % dishes
    d, d0 = discount_of(int((c == 1).sum()), int((c == 2).sum())), 0.5
    c_u = np.bincount(u, c, contexts)
    t = np.minimum(c, 1)
    t0 = np.minimum(np.bincount(w, t, dishes), 1).astype(np.int64)
    total = np.zeros((contexts, dishes), np.float32)
    for sweep in range(sweeps):
        c0 = np.bincount(w, t, dishes).astype(np.int64)
        p0 = (c0 - d0 * t0 + (theta + d0 * t0.sum()) / dishes) / (c0.sum() + theta)
        t_u = np.bincount(u, t, contexts)
        t = seat(c, (t_u[u] - t), p0[w], theta, d, rng)
        c0 = np.bincount(w, t, dishes).astype(np.int64)
        t0 = seat(c0, t0.sum() - t0, np.full(dishes, 1 / dishes), theta, d0, rng)
        if sweep >= burn_in:
            p0 = (c0 - d0 * t0 + (theta + d0 * t0.sum()) / dishes) / (c0.sum() + theta)
            t_u = np.bincount(u, t, contexts)
            total += (((theta + d * t_u) / (c_u + theta))[:, None] * p0[None, :]).astype(np.float32)
            total[u, w] += ((c - d * t) / (c_u[u] + theta)).astype(np.float32)
    total /= max(1, sweeps - burn_in)
    return np.log10(total, out=total)


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, log_base (without the denominator), score of every row."""
    bits = model.ranges.bit_length() - 1
    unknown = float(np.log10(np.mean([model.base(np.zeros(1), np.zeros(1), k)[0] for k in model.kept]))) if model.v else 0.0

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, table = TaskContext.get().partitionId(), WordHashes()
        for k, (ids, texts, _) in enumerate(groups(batches)):
            number, context, size = model.numbers(texts, table)
            n = len(ids)
            doc = np.repeat(np.arange(n), size)
            there, inside = number >= 0, context >= 0
            count = np.zeros(len(number), np.int64)
            count[there] = model.of("counts", "<i8")[number[there]]
            s = np.full(len(number), unknown)
            s[there] = model.of("log_base", "<f8")[number[there]]
            s[inside] += model.of("log_weight", "<f8")[context[inside]]
            known = np.bincount(doc[there], minlength=n).astype("<i8")
            base = np.bincount(doc, np.log10(count + 0.5), n)
            both = there & inside
            cell, place = context[both] << 32 | number[both], doc[both]
            order = np.argsort(cell, kind="stable")
            cell, place = cell[order], place[order]
            mine = np.bincount(doc, s, n)
            if model.frequent is not None and len(model.frequent[0]):
                keys, gain = model.frequent
                at = np.minimum(np.searchsorted(keys, cell), len(keys) - 1)
                hit = keys[at] == cell
                mine += np.bincount(place[hit], gain[at[hit]], n)
                cell, place = cell[~hit], place[~hit]
            null = np.array([i is None for i in ids], "<u1")
            own = np.array([0 if i is None else i for i in ids], "<i8")
            key = part << 32 | k
            rows = [((part * 40503 + k * 7) % (1 << bits), 2, own.tobytes() + size.astype("<i8").tobytes() + known.tobytes() + base.tobytes() + mine.tobytes() + null.tobytes())]
            if len(cell):
                rows += [(p, 1, raw) for p, raw in model.deal(cell, place.astype("<u2"))]
            for at in range(0, len(rows), 64):
                some = rows[at : at + 64]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in some], pa.int32()), pa.array([r[1] for r in some], pa.int32()), pa.array([key] * len(some), pa.int64()), pa.array([r[2] for r in some], pa.binary())],
                    names=["p", "kind", "batch", "payload"])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            out: list[tuple[int, int, bytes]] = []
            for p, kind, key, raw in zip(*(batch.column(c).to_pylist() for c in ("p", "kind", "batch", "payload")), strict=True):
                if kind == 2:
                    out.append((key, 2, raw))
                    continue
                if p not in held:
                    held = {p: model.range_gains(p)}
                keys, gain = held[p]
                cell, doc = unpack(raw, "<u2")
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, cell), len(keys) - 1)
                    hit = keys[at] == cell
                    there, which = np.unique(doc[hit], return_inverse=True)
                    if len(there):
                        out.append((key, 1, there.astype("<u2").tobytes() + np.bincount(which, gain[at[hit]]).astype("<f8").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.binary())], names=["batch", "kind", "payload"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, meta, extra = None, None, None

        def finish() -> pa.RecordBatch:
            own, size, known, base, mine, null = meta
            return pa.RecordBatch.from_arrays(
                [pa.array(own, mask=null.astype(bool)), pa.array(size), pa.array(known), pa.array(base), pa.array(mine + extra)],
                names=["doc_id", "n_tokens", "n_known", "log_base", "score"])

        for batch in batches:
            for key, kind, raw in zip(*(batch.column(c).to_pylist() for c in ("batch", "kind", "payload")), strict=True):
                if key != now:  # sorted: a batch begins with its own row
                    if now is not None:
                        yield finish()
                    now = key
                    n = len(raw) // 41
                    meta = [*(np.frombuffer(raw, t, n, 8 * n * j) for j, t in enumerate(("<i8", "<i8", "<i8", "<f8", "<f8"))), np.frombuffer(raw, "<u1", n, 40 * n)]
                    extra = np.zeros(n)
                else:
                    n = len(raw) // 10
                    extra[np.frombuffer(raw, "<u2", n)] += np.frombuffer(raw, "<f8", n, 2 * n)
        if now is not None:
            yield finish()

    n = model.ranges
    met = docs.mapInArrow(send, "p int, kind int, batch long, payload binary").repartitionById(n, F.col("p"))
    sums = met.mapInArrow(look_up, "batch long, kind int, payload binary")
    back = sums.repartitionById(n, F.pmod(F.xxhash64("batch"), F.lit(n)).cast("int")).sortWithinPartitions("batch", F.desc("kind"))
    return back.mapInArrow(gather, "doc_id long, n_tokens long, n_known long, log_base double, score double")


def fit(rows: DataFrame, sweeps: int = 6) -> Model:
    """The model of the rows with train; a row has doc_id, text, train."""
    spark = rows.sparkSession
    fs, path = open_fs(shared_folder(spark, "pitman-yor"))
    if not isinstance(fs, pafs.LocalFileSystem):
        raise RuntimeError("spark.checkpoint.dir must be a path that all workers see, since they map files there")
    os.makedirs(path)
    bits = max(4, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    model = Model(path, 1 << bits, sweeps)
    count_words(rows, model)
    if model.v:
        model.frequent_from = model.n / FREQUENT
        _let_go(spark)
        count_cells(rows, model)
        _let_go(spark)
        for k in range(-1, sweeps):
            sweep(spark, model, k)
        average(spark, model)
        _let_go(spark)
    return model


def score(docs: DataFrame, held_out_fold: int = 1, sweeps: int = 6) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    The model learns from the rows whose crc32(doc_id as text) mod 5 is not ``held_out_fold``.
    """
    small_arrow_batches(docs.sparkSession, 64)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (fold_of() != held_out_fold).alias("train"))
    model = fit(rows, sweeps)
    out = score_texts(rows, model)
    under = float(np.log10(model.n + 0.5 * (model.v + 1)))
    return out.select(
        "doc_id", (fold_of() == held_out_fold).alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("log_base") - F.col("n_tokens") * F.lit(under)).alias("base_score"), "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
