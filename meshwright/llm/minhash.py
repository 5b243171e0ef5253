"""Near-duplicate documents: MinHash bands, Bayesian sequential pruning, exact checks.

1. Texts become sets of hashed word shingles; equal sets are one class, held by its least id.
2. 256 minima per class; bands of rows chosen so that a pair at the threshold misses all of
   them with probability under 1e-5 (6 rows at 0.8, 7 at 0.85): pairs of half that similarity
   seldom meet. Only classes that share a bucket keep their signatures from here on.
3. Star round: every class is compared with the one that is the least member of most of its
   buckets (one candidate a class). Comparison reads the signatures in batches of 32 and prunes a
   pair once the posterior probability of reaching the threshold falls below ``miss``.
4. Survivors are confirmed on full shingle sets and linked; components are formed.
5. Rest round: buckets that still hold several components are searched whole, block against
   block inside a task, skipping pairs of one component, with the same pruning. Survivors
   whose bit sets already rule the threshold out (an exact bound) go; the others leave the
   task. Where a block has many, it gives one partner a member, and a second search follows
   that takes all survivors left between components. All are confirmed on full sets.

No bucket is dropped or capped and no pair of different components of a bucket goes
unexamined; pairs inside a component cannot change the result and are skipped. Keys that many
rows share (copies of one text, crowded buckets, hubs) are only ever aggregated with a combine
before the shuffle, written, and joined as written tables, whose partitions the engine splits.
Intermediate tables are removed once the result is written.

Defined cases: a null text, or one without words, has an empty set and is linked with nothing;
fewer words than a shingle make one shingle of them all; rows that repeat a doc_id are one
vertex; a null doc_id is linked with nothing, its component is null and it is kept; an empty
table gives no rows; other columns pass through ``keep_one`` untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshwright.llm.common import ASCII_LOWER, WordHashes, Workspace, fresh_name, materialize, mix64, sized, small_arrow_batches, text_bytes
from meshwright.llm.graph import components

PERMS = 256
SIGNATURE = 128
BATCH = 32
CHUNK = 1024
BITS = 2048
HINT_IDS = 1_000_000
P = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles of an array of word hashes."""
    if not len(words):
        return words
    m = min(n, len(words))
    h = np.full(len(words) - m + 1, m, np.uint64)
    for i in range(m):
        h = (h ^ words[i : len(words) - m + 1 + i]) * P
        h ^= h >> np.uint64(31)
    return np.unique(mix64(h))


def text_shingles(text: bytes | None, n: int, table: WordHashes) -> np.ndarray:
    return shingles(table.of((text or b"").translate(ASCII_LOWER).split()), n)


def permutations(seed: int = 11) -> np.ndarray:
    """Odd multipliers: x -> a x mod 2^32 permutes the low halves of shingle hashes."""
    return np.random.default_rng(seed).integers(0, 1 << 31, PERMS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def minima(s: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The least permuted hash per permutation."""
    best = np.full(len(a), np.iinfo(np.uint32).max, np.uint32)
    low = s.astype(np.uint32)
    for at in range(0, len(low), 256):
        np.minimum(best, np.minimum.reduce(low[at : at + 256, None] * a, axis=0), out=best)
    return best


def plan_bands(threshold: float, miss: float = 1e-5) -> tuple[int, int]:
    """(bands, rows): the longest rows whose bands all miss a pair at the threshold too rarely."""
    for rows in range(12, 0, -1):
        bands = PERMS // rows
        if (1 - threshold**rows) ** bands <= miss:
            return bands, rows
    raise ValueError("no banding reaches the miss probability")


def keep_limits(threshold: float, miss: float) -> list[tuple[int, int]]:
    """(compared, least matches): fewer matches have posterior P(similarity >= threshold) < miss.

    With a uniform prior the posterior after m of n matches is Beta(m+1, n-m+1), whose upper
    tail is a binomial sum. One byte of each minimum is compared, so chance matches (1/256)
    raise the threshold a little.
    """
    t = threshold + (1 - threshold) / 256
    out = []
    for n in range(BATCH, SIGNATURE + 1, BATCH):
        tail = 0.0
        for m in range(n + 2):
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= miss:
                out.append((n, m))
                break
    return out


def survivors(x: np.ndarray, y: np.ndarray, limits: list[tuple[int, int]]) -> np.ndarray:
    """Which rows of paired one-byte signatures pass every bound, batch after batch."""
    live = np.arange(len(x))
    count = np.zeros(len(x), np.int32)
    for n, least in limits:
        part = slice(n - BATCH, n)
        count[live] += (x[live, part] == y[live, part]).sum(1)
        live = live[count[live] >= least]
        if not len(live):
            break
    return live


def bit_set(s: np.ndarray) -> bytes:
    """BITS bits, those set that the hashes of a shingle set fall on."""
    bits = np.zeros(BITS, np.uint8)
    bits[(s >> np.uint64(40)) % np.uint64(BITS)] = 1
    return np.packbits(bits).tobytes()


def possible(x: np.ndarray, y: np.ndarray, size_x: np.ndarray, size_y: np.ndarray, percent: int) -> np.ndarray:
    """Which rows of paired bit sets (uint64 words) may reach the threshold; never wrongly no.

    Each bit in which two bit sets differ needs an element that only one of the sets has, so
    the intersection has at most (size_x + size_y - differing bits) / 2 elements.
    """
    out = np.empty(len(x), bool)
    for at in range(0, len(x), 8192):
        part = slice(at, at + 8192)
        total = size_x[part] + size_y[part]
        differ = np.bitwise_count(x[part] ^ y[part]).sum(1, dtype=np.int64)
        both = np.minimum((total - differ) // 2, np.minimum(size_x[part], size_y[part]))
        out[part] = 100 * both >= percent * (total - both)
    return out


def profile(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, set key (k1, k2), band hashes, one-byte signature, bit set of every row."""
    small_arrow_batches(docs.sparkSession)
    a = permutations()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()
        weights = mix64(np.arange(1, rows + 1, dtype=np.uint64) * P)
        for batch in batches:
            size, k1, k2, band, sig, bits = [], [], [], [], [], []
            for text in text_bytes(batch.column("text")):
                s = text_shingles(text, n, table)
                size.append(len(s))
                if not len(s):
                    k1.append(None), k2.append(None), band.append([]), sig.append(b""), bits.append(b"")
                    continue
                k1.append(int(np.bitwise_xor.reduce(mix64(s))) - (1 << 63))
                k2.append(int(np.add.reduce(mix64(s ^ P))) - (1 << 63))
                low = minima(s, a)
                cells = low[: bands * rows].reshape(bands, rows).astype(np.uint64) + np.uint64(1)
                h = mix64((mix64(cells * weights)).sum(1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * P)
                band.append(h.view(np.int64).tolist())
                sig.append(low[:SIGNATURE].astype(np.uint8).tobytes())
                bits.append(bit_set(s))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(band, pa.list_(pa.int64())), pa.array(sig, pa.binary()), pa.array(bits, pa.binary())],
                names=["doc_id", "n_shingles", "k1", "k2", "bands", "sig", "bits"])

    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(
        run, "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, sig binary, bits binary")


def prune(pairs: DataFrame, limits: list[tuple[int, int]]) -> DataFrame:
    """The (a, b) rows of (a, b, sig_a, sig_b) that the Bayesian bounds keep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SIGNATURE) for c in ("sig_a", "sig_b"))
            yield batch.select(["a", "b"]).take(pa.array(survivors(x, y, limits)))

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def only(rows: DataFrame, ids: DataFrame, most: int, how: str = "left_semi") -> DataFrame:
    """The rows whose id is (or is not) among at most so many ids: these travel if few, else both sides do."""
    return rows.join(F.broadcast(sized(ids, most)) if most <= HINT_IDS else ids, "id", how)


def confirm(pairs: DataFrame, texts: DataFrame, n: int, percent: int, work: Workspace) -> DataFrame:
    """The (a, b) of a written table whose full sets have 100 * intersection >= percent * union, written."""
    spark = pairs.sparkSession
    count = pairs.count()
    if not count:
        return pairs.select("a", "b")
    wanted = texts
    if 2 * count <= HINT_IDS:  # beyond it the joins below shuffle the texts as they are
        wanted = only(texts, pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), 2 * count)
    small_arrow_batches(spark, 200)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()
        held: dict[bytes, np.ndarray] = {}
        for batch in batches:
            keep = []
            for x, y in zip(text_bytes(batch.column("ta")), text_bytes(batch.column("tb")), strict=True):
                sets = []
                for t in (x, y):
                    if t not in held:
                        if len(held) > 64:
                            held.clear()
                        held[t] = text_shingles(t, n, table)
                    sets.append(held[t])
                both = len(np.intersect1d(*sets, assume_unique=True))
                keep.append(100 * both >= percent * (len(sets[0]) + len(sets[1]) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = pairs.select("a", "b").join(wanted.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    two = one.join(wanted.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return work.keep(two.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long"), "confirmed")


def rest_pairs(members: DataFrame, limits: list[tuple[int, int]], percent: int, thin: bool) -> DataFrame:
    """(a, b, more): surviving pairs of different components of every bucket, block against block.

    ``members``: bucket, id, comp, core (the component of the bucket's least member), n_core,
    n_other, size, sig, bits. Members of the core meet only the others; the others meet each
    other too. With ``thin`` a cell that has over four survivors a member gives one partner a
    member, marked ``more``, so that a large group is joined by a linear number of links before
    what is left is searched again.
    """
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(c / CHUNK)).cast("int")
    lot = lambda c: F.pmod(F.xxhash64("id", "bucket"), blocks(c)).cast("int")
    kc, ko = blocks(F.col("n_core")), blocks(F.col("n_other"))
    in_core = F.col("comp") == F.col("core")
    core = members.where(in_core).select(
        "bucket", "id", "comp", "size", "sig", "bits", F.lit(True).alias("left"), lot(F.col("n_core")).alias("i"),
        F.explode(F.sequence(F.lit(0), ko - 1)).alias("j"), F.lit("c").alias("kind"))
    others = members.where(~in_core)
    against = others.select(
        "bucket", "id", "comp", "size", "sig", "bits", F.lit(False).alias("left"),
        F.explode(F.sequence(F.lit(0), kc - 1)).alias("i"), lot(F.col("n_other")).alias("j"), F.lit("c").alias("kind"))
    mine = lot(F.col("n_other"))
    among = others.where("n_other > 1").select(
        "bucket", "id", "comp", "size", "sig", "bits", mine.alias("mine"), F.explode(F.sequence(F.lit(0), ko - 1)).alias("k")
    ).select("bucket", "id", "comp", "size", "sig", "bits", (F.col("mine") <= F.col("k")).alias("left"), F.least("mine", "k").alias("i"), F.greatest("mine", "k").alias("j"), F.lit("o").alias("kind"))
    cells = core.unionByName(against).unionByName(among).groupBy("bucket", "kind", "i", "j").agg(
        F.collect_list(F.struct("left", "id", "comp", "size", "sig", "bits")).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_a, out_b, out_more = [], [], []
            for kind, i, j, x in zip(*(batch.column(c).to_pylist() for c in ("kind", "i", "j", "x")), strict=True):
                ids = np.array([r["id"] for r in x])
                comp = np.array([r["comp"] for r in x])
                left = np.array([r["left"] for r in x])
                size = np.array([r["size"] for r in x])
                sig = np.frombuffer(b"".join(r["sig"] for r in x), np.uint8).reshape(-1, SIGNATURE)
                bits = np.frombuffer(b"".join(r["bits"] for r in x), np.uint64).reshape(-1, BITS // 64)
                if kind == "o" and i == j:
                    p, q = np.triu_indices(len(ids), 1)
                else:
                    l, r = np.flatnonzero(left), np.flatnonzero(~left)
                    p, q = np.repeat(l, len(r)), np.tile(r, len(l))
                apart = comp[p] != comp[q]
                p, q = p[apart], q[apart]
                ok = survivors(sig[p], sig[q], limits)
                ok = ok[possible(bits[p[ok]], bits[q[ok]], size[p[ok]], size[q[ok]], percent)]
                more = thin and len(ok) > 4 * len(ids)
                if more:
                    ok = ok[np.unique(q[ok], return_index=True)[1]]
                out_more.append(np.full(len(ok), more))
                out_a.append(np.minimum(ids[p[ok]], ids[q[ok]]))
                out_b.append(np.maximum(ids[p[ok]], ids[q[ok]]))
            if out_a:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(out_a).astype(np.int64)), pa.array(np.concatenate(out_b).astype(np.int64)), pa.array(np.concatenate(out_more))],
                    names=["a", "b", "more"])

    return cells.mapInArrow(run, "a long, b long, more boolean").groupBy("a", "b").agg(F.max("more").alias("more"))


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, miss: float = 1e-7) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs, from a written table."""
    with Workspace(docs.sparkSession, "near") as work:
        return materialize(_near(docs, n, percent, miss, work), "groups")


def _near(docs: DataFrame, n: int, percent: int, miss: float, work: Workspace) -> DataFrame:
    bands, rows = plan_bands(percent / 100)
    limits = keep_limits(percent / 100, miss)
    base = work.keep(profile(docs, n, bands, rows), "profiles")
    there = base.where("doc_id IS NOT NULL AND n_shingles > 0")
    texts = docs.selectExpr("cast(doc_id AS long) AS id", "text").where("id IS NOT NULL")

    # classes of equal sets; a repeated doc_id may belong to several classes, linked below
    shared = work.keep(there.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1"), "classes")
    copies = work.keep(there.select("doc_id", "k1", "k2").join(shared.select("k1", "k2", "rep"), ["k1", "k2"]).where("rep < doc_id").select("doc_id", "rep"), "copies")
    again = work.keep(there.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select(F.col("doc_id").alias("id")), "repeated")
    repeated, n_copies = again.count() > 0, copies.count()
    rows_of = there.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("size"), "bands", "sig", "bits")
    reps = only(rows_of, copies.select(F.col("doc_id").alias("id")).distinct(), n_copies, "left_anti")
    if repeated:  # keep every set of such ids
        reps = reps.unionByName(rows_of.join(again, "id", "left_semi")).dropDuplicates(["id", "sig"])

    entries = reps.select("id", F.explode("bands").alias("bucket"))
    crowded = work.keep(entries.groupBy("bucket").agg(F.min("id").alias("least"), F.count("*").alias("c")).where("c > 1").select("bucket", "least"), "crowded")
    entries = work.keep(entries.join(crowded, "bucket").select("bucket", "id", "least"), "entries")
    met = work.keep(entries.select("id").distinct(), "met")
    sigs = work.keep(only(rows_of.drop("bands"), met, met.count()), "signatures")

    # star round: for each id the least member that it shares most buckets with
    shares = entries.where("id > least").groupBy("id", "least").agg(F.count("*").alias("c"))
    star = shares.groupBy("id").agg(F.max_by("least", F.struct("c", -F.col("least"))).alias("a")).select("a", F.col("id").alias("b"))
    paired = (
        star.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sig_a")), "a")
        .join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sig_b")), "b"))
    links = confirm(work.keep(prune(paired, limits), "to-confirm"), texts, n, percent, work)

    # rest rounds: thinned where survivors are many, and only then all pairs left between components
    for thin in (True, False):
        placed = work.keep(
            entries.join(components(links, work), "id", "left").select("bucket", "id", "least", F.coalesce("component", "id").alias("comp")), "placed")
        mixed = work.keep(
            placed.groupBy("bucket").agg(
                F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(F.when(F.col("id") == F.col("least"), F.col("comp"))).alias("core")
            ).where("lo < hi").select("bucket", "core"), "mixed")
        inside = work.keep(placed.join(mixed, "bucket").select("bucket", "id", "comp", "core"), "inside")
        counts = work.keep(
            inside.groupBy("bucket").agg(
                F.count_if(F.col("comp") == F.col("core")).alias("n_core"), F.count_if(F.col("comp") != F.col("core")).alias("n_other")), "counts")
        pairs = work.keep(rest_pairs(inside.join(counts, "bucket").join(sigs, "id"), limits, percent, thin), "to-confirm")
        links = links.unionByName(confirm(pairs, texts, n, percent, work))
        if not pairs.agg(F.count_if("more")).first()[0]:
            break

    if repeated:  # all rows of an id are one vertex
        labels = components(links.unionByName(copies.select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))), work)
    else:
        found = components(links, work)
        labels = found.unionByName(
            copies.join(found.withColumnRenamed("id", "rep"), "rep", "left").select(F.col("doc_id").alias("id"), F.coalesce("component", "rep").alias("component")))
    out = base.select("doc_id", "n_shingles").join(
        labels.where("component < id").select(F.col("id").alias("doc_id"), F.col("component").alias("component_id")), "doc_id", "left")
    comp = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(comp == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs for each group, that of the least id, all columns as they were."""
    found = near_duplicates(docs, n, percent)
    gone, row = fresh_name(docs, "gone"), fresh_name(docs, "row")
    leave = found.where("NOT kept").select(F.col("doc_id").alias(gone)).distinct()
    most = leave.count()
    out = docs.join(F.broadcast(sized(leave, most)) if most <= HINT_IDS else leave, F.col("doc_id").cast("long") == F.col(gone), "left_anti")
    again = found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1")
    if not again.agg(F.count("*")).first()[0]:
        return out
    # rows that repeat an id are one document: the row with the least text stays
    order = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last(), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    single = out.where("doc_id IS NOT NULL").withColumn(row, F.row_number().over(order)).where(F.col(row) == 1).drop(row)
    return single.unionByName(out.where("doc_id IS NULL"))
