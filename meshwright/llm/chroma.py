"""Chroma audio fingerprints: packed integers per frame, and alignment of recordings.

A recording becomes frames of twelve pitch-class energies (short-time spectra folded by
octave, smoothed over time, normalised). Sixteen rectangle filters over an integral image of
the frames compare the energy of neighbouring areas; each answer is cut into four levels and
written as two Gray-coded bits, so a frame is one 32-bit integer. Two recordings are aligned
by a histogram of offsets at which halves of their integers agree; the bit errors over the
overlap at the best offsets decide.

Search: queries with equal fingerprints are one, under their least id, over the whole table of
queries; ``classes`` gives the membership. They are taken in blocks of bounded size, each sent
to all recordings; the answer does not depend on the size of a block. Only confirmed matches
leave a task.

Defined cases: a null, empty or too short recording has no codes and matches nothing; NaN
and infinite samples count as silence; equal fingerprints form a class named by its least
id; repeated rows are answered each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.llm.common import materialize, shared_folder, small_arrow_batches

RATE, FFT, HOP = 4000, 1024, 512
NOTE = 512
WIDTH = 8  # frames that one code looks at
LOW_HZ, HIGH_HZ = 60.0, 1900.0
QUERY_BLOCK = 4096
MIN_HITS, MIN_OVERLAP, MAX_BER = 3, 16, 0.25


def _fold() -> np.ndarray:
    """(bins, 12): which pitch class each bin of the spectrum feeds."""
    hz = np.arange(FFT // 2 + 1) * RATE / FFT
    out = np.zeros((len(hz), 12), np.float32)
    use = (hz >= LOW_HZ) & (hz <= HIGH_HZ)
    pitch = np.round(12 * np.log2(hz[use] / 440.0) + 69).astype(int)
    out[np.flatnonzero(use), pitch % 12] = 1
    return out


FOLD = _fold()
HANN = np.hanning(FFT).astype(np.float32)


def chroma(signals: np.ndarray) -> np.ndarray:
    """(recordings, frames, 12) of equally long recordings (recordings, samples)."""
    signals = np.nan_to_num(signals, nan=0.0, posinf=0.0, neginf=0.0).astype(np.float32)
    n = (signals.shape[1] - FFT) // HOP + 1
    if n < 1:
        return np.zeros((len(signals), 0, 12), np.float32)
    at = np.arange(n)[:, None] * HOP + np.arange(FFT)
    power = np.abs(np.fft.rfft(signals[:, at] * HANN, axis=2)).astype(np.float32) ** 2
    c = power @ FOLD
    if n >= 3:
        c[:, 1:-1] = 0.25 * c[:, :-2] + 0.5 * c[:, 1:-1] + 0.25 * c[:, 2:]
    norm = np.linalg.norm(c, axis=2, keepdims=True)
    return np.where(norm > 1e-3, c / np.maximum(norm, 1e-9), 0)


def filters() -> list[tuple[int, int, int, int]]:
    """(kind, first class, classes, frames) of the sixteen filters, by rule."""
    out = []
    for k in range(16):
        height = (2, 4, 6, 12)[k % 4]
        out.append((k % 3, (k * 5) % (13 - height), height, (2, 4, 8)[k % 3] if k < 12 else 8))
    return out


def codes(frames: np.ndarray) -> np.ndarray:
    """(recordings, codes) of packed 32-bit integers."""
    r, n, _ = frames.shape
    m = n - WIDTH + 1
    if m < 1:
        return np.zeros((r, 0), np.uint32)
    image = np.zeros((r, n + 1, 13))
    image[:, 1:, 1:] = frames.cumsum(1, dtype=float).cumsum(2)

    def area(t0: int, t1: int, y0: int, y1: int) -> np.ndarray:
        """Sum over frames t..t+(t1-t0) from each start and classes y0..y1."""
        a, b = image[:, t0 : t0 + m], image[:, t1 : t1 + m]
        return b[:, :, y1] - b[:, :, y0] - a[:, :, y1] + a[:, :, y0]

    out = np.zeros((r, m), np.uint32)
    for kind, y, h, w in filters():
        if kind == 0:  # earlier against later
            one, two = area(0, w // 2, y, y + h), area(w // 2, w, y, y + h)
        elif kind == 1:  # lower against higher classes
            one, two = area(0, w, y, y + h // 2), area(0, w, y + h // 2, y + h)
        else:  # the diagonals of four quarters
            one = area(0, w // 2, y, y + h // 2) + area(w // 2, w, y + h // 2, y + h)
            two = area(0, w // 2, y + h // 2, y + h) + area(w // 2, w, y, y + h // 2)
        ratio = np.log((one + 0.1) / (two + 0.1))
        level = (ratio > -0.7).astype(np.uint32) + (ratio > 0) + (ratio > 0.7)
        out = out << np.uint32(2) | (level ^ level >> np.uint32(1)).astype(np.uint32)
    return out


def fingerprints(signals: list[np.ndarray | None]) -> list[np.ndarray]:
    """Codes of recordings of any lengths; equal lengths go together."""
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(signals)
    by: dict[int, list[int]] = {}
    for i, s in enumerate(signals):
        if s is not None and len(s) >= FFT:
            by.setdefault(len(s), []).append(i)
    for n, group in by.items():
        step = max(1, (1 << 20) // n)
        for at in range(0, len(group), step):
            part = group[at : at + step]
            for i, c in zip(part, codes(chroma(np.array([signals[i] for i in part], np.float32))), strict=True):
                out[i] = c
    return out


def play(vectors: list[list[float] | None]) -> list[np.ndarray | None]:
    """A recording of each vector: one note a value, its pitch by the value in units of the vector's size."""
    out: list[np.ndarray | None] = []
    t = np.arange(NOTE) / RATE
    for v in vectors:
        if not v:
            out.append(None)
            continue
        x = np.nan_to_num(np.array([0.0 if a is None else a for a in v]), nan=0.0, posinf=0.0, neginf=0.0)
        size = np.sqrt((x * x).mean())
        tone = 60 + np.clip(np.round(6 * x / size if size > 0 else x * 0), -24, 24)
        hz = 440 * 2 ** ((tone - 69) / 12)
        wave = np.sin((2 * np.pi * hz)[:, None] * t) + 0.3 * np.sin((4 * np.pi * hz)[:, None] * t)
        out.append(wave.ravel().astype(np.float32) if size > 0 else np.zeros(len(x) * NOTE, np.float32))
    return out


def bit_errors(a: np.ndarray, b: np.ndarray) -> int:
    return int(np.bitwise_count(a ^ b).sum())


class QueryBlock:
    """Fingerprints of a block of queries and the places of both halves of their codes."""

    def __init__(self, ids: list[int], prints: list[np.ndarray]):
        first: dict[bytes, int] = {}
        for i, p in sorted(zip(ids, prints, strict=True), key=lambda x: x[0]):
            if len(p):
                first.setdefault(p.tobytes(), i)
        self.ids = list(first.values())
        self.prints = [np.frombuffer(p, np.uint32) for p in first]
        size = [len(p) for p in self.prints]
        flat = np.concatenate(self.prints) if self.prints else np.zeros(0, np.uint32)
        who = np.repeat(np.arange(len(size)), size)
        place = np.concatenate([np.arange(n) for n in size]) if size else np.zeros(0, np.int64)
        self.tables = []
        for half in (flat >> np.uint32(16), flat & np.uint32(0xFFFF)):
            order = np.argsort(half, kind="stable")
            self.tables.append((np.searchsorted(half[order], np.arange(65537)), who[order], place[order]))

    def match(self, codes_: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(query id, offset, overlap, bit errors) of the queries that align with a recording."""
        if not len(codes_) or not self.ids:
            return []
        keys = []
        for (start, who, place), half in zip(self.tables, (codes_ >> np.uint32(16), codes_ & np.uint32(0xFFFF)), strict=True):
            lo, hi = start[half], start[half.astype(np.int64) + 1]
            n = hi - lo
            if not n.sum():
                continue
            at = np.repeat(np.arange(len(codes_)), n)
            k = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            keys.append(who[k].astype(np.int64) << 32 | (at - place[k] + (1 << 31)))
        if not keys:
            return []
        key, hits = np.unique(np.concatenate(keys), return_counts=True)
        key, hits = key[hits >= MIN_HITS], hits[hits >= MIN_HITS]
        best: dict[int, tuple[float, int, int, int]] = {}
        for q, offset in zip((key >> 32).tolist(), ((key & 0xFFFFFFFF) - (1 << 31)).tolist(), strict=True):
            p = self.prints[q]
            a, b = max(0, offset), min(len(codes_), offset + len(p))
            if b - a < MIN_OVERLAP:
                continue
            e = bit_errors(codes_[a:b], p[a - offset : b - offset])
            if e <= MAX_BER * 32 * (b - a):
                best[q] = min(best.get(q, (2.0, 0, 0, 0)), (e / (32 * (b - a)), offset, b - a, e))
        return [(self.ids[q], o, n, e) for q, (_, o, n, e) in sorted(best.items())]


def fingerprint_table(media: DataFrame, samples: str = "samples", render: bool = False) -> DataFrame:
    """id, codes binary, n_codes, fp_crc32 of every row of (id, samples array<float>).

    With ``render`` the array is a vector to be played, not a recording.
    """
    small_arrow_batches(media.sparkSession, 256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("samples").to_pylist()
            for at in range(0, len(rows), 64):
                part = rows[at : at + 64]
                signals = play(part) if render else [None if s is None else np.array([np.nan if x is None else x for x in s], np.float32) for s in part]
                prints = fingerprints(signals)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(at, 64), pa.array([p.astype("<u4").tobytes() for p in prints], pa.binary()), pa.array([len(p) for p in prints], pa.int64()),
                     pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in prints], pa.int64())],
                    names=["id", "codes", "n_codes", "fp_crc32"])

    return media.select(F.col("id").cast("long"), F.col(samples).alias("samples")).mapInArrow(run, "id long, codes binary, n_codes long, fp_crc32 long")


def search(prints: DataFrame, queries: DataFrame, block: int = QUERY_BLOCK) -> DataFrame:
    """id, query_id, offset, overlap, bit_errors: every recording that a query aligns with.

    Equal query fingerprints answer once, under their least id.
    """
    spark = prints.sparkSession
    queries = queries.where("n_codes > 0").groupBy("codes").agg(F.min("id").alias("id"))
    schema = "id long, query_id long, offset long, overlap long, bit_errors long"
    path = shared_folder(spark, "matches")
    spark.createDataFrame([], schema).write.parquet(path)

    def answer(ids: list[int], codes_: list[np.ndarray]) -> None:
        shared = spark.sparkContext.broadcast(QueryBlock(ids, codes_))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for i, raw in zip(batch.column("id").to_pylist(), batch.column("codes").to_pylist(), strict=True):
                    out += [(i, *m) for m in shared.value.match(np.frombuffer(raw, "<u4"))]
                cols = list(zip(*out, strict=True)) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["id", "query_id", "offset", "overlap", "bit_errors"])

        prints.select("id", "codes").mapInArrow(run, schema).write.mode("append").parquet(path)
        shared.unpersist()

    ids, held = [], []
    for row in queries.select("id", "codes").toLocalIterator():
        ids.append(row["id"])
        held.append(np.frombuffer(bytes(row["codes"]), "<u4"))
        if len(ids) == block:
            answer(ids, held)
            ids, held = [], []
    if ids:
        answer(ids, held)
    return spark.read.schema(schema).parquet(path)


def classes(prints: DataFrame) -> DataFrame:
    """id, n_codes, fp_crc32, class_id: equal fingerprints share the least id; none, no class."""
    keyed = prints.select("id", "n_codes", "fp_crc32", F.xxhash64("codes").alias("k"), F.crc32(F.reverse(F.hex("codes")).cast("binary")).alias("k2"))
    keyed = materialize(keyed, "print-keys")
    many = materialize(
        keyed.where("n_codes > 0").groupBy("k", "k2").agg(F.min("id").alias("least"), F.count("*").alias("c")).where("c > 1").select("k", "k2", "least"),
        "print-classes")
    return keyed.join(many, ["k", "k2"], "left").select(
        "id", "n_codes", "fp_crc32", F.when(F.col("n_codes") > 0, F.coalesce("least", "id")).alias("class_id"))
