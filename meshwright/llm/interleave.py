"""Sharding by proportional stratified interleaving.

Rows of each source are put in a seeded random order; a row's fractional rank is
(2 * rank + 1) / (2 * rows of the source). All rows are sorted by that fraction and cut into
equal runs, so every shard holds each source in the mixture's proportion (to within one row
per source and cut) and shard counts differ by one at most (law ``rows``).

No window ever spans a source or the table: ranks come from counts of hash ranges (small
sums) plus a row number inside one range, so a source with a third of all rows is spread
over as many tasks as any other.

Defined cases: a null source is a source of its own; a null text has size 1 and the crc of
an empty text; equal rows are interchangeable; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshwright.llm.common import materialize

#: Rows that one range should hold about.
RANGE_ROWS = 2000


def interleave(docs: DataFrame, shards: int = 8, seed: int = 17, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, source, size, text_crc32, position, shard, slot for every row of docs."""
    raw = F.coalesce(F.col("text"), F.lit(""))
    base = materialize(
        docs.select(
            "doc_id",
            F.coalesce(F.col("source").cast("string"), F.lit("\u0000")).alias("source"),
            (F.octet_length(raw) + 1).cast("long").alias("size"),
            F.crc32(raw.cast("binary")).alias("text_crc32"),
            F.xxhash64(F.lit(seed), F.col("doc_id"), F.xxhash64(raw)).alias("shuffle_key"),
        ),
        "interleave-base",
    )
    n = base.count()
    bits = max(4, min(40, ((max(n, 1) // range_rows).bit_length())))
    ranges = 1 << bits

    # 1. rank inside the source: ranges of the shuffled key, their running sums, a row number inside
    keyed = base.withColumn("lot", F.shiftright(F.col("shuffle_key"), 64 - bits) + F.lit(ranges // 2))
    per_lot = keyed.groupBy("source", "lot").agg(F.count("*").alias("c"))
    in_source = Window.partitionBy("source").orderBy("lot")
    offsets = per_lot.select(
        F.col("source").alias("o_source"), F.col("lot").alias("o_lot"),
        (F.sum("c").over(in_source) - F.col("c")).alias("before"),
        F.sum("c").over(Window.partitionBy("source")).alias("n_source"),
    )
    offsets = materialize(offsets, "interleave-offsets")
    inside = Window.partitionBy("source", "lot").orderBy("shuffle_key", "doc_id", "text_crc32", "size")
    ranked = (
        keyed.withColumn("r", F.row_number().over(inside) - 1)
        .join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("lot") == F.col("o_lot")))
        .withColumn("rank", F.col("before") + F.col("r"))
    )

    # 2. the global order of fractions: ranges again; how many rows lie below a range follows from n_source
    step = ((2 * F.col("rank") + 1) * F.lit(ranges) / (2 * F.col("n_source"))).cast("long")  # double: monotone
    below = (
        offsets.select("o_source", "n_source").distinct()
        .select("o_source", "n_source", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ranges).cast("long"))).alias("k"))
    )
    placed = ranked.select(
        "doc_id", "source", "size", "text_crc32", "shuffle_key", "rank", "n_source",
        step.alias("k"), ((2 * F.col("rank") + 1) / (2 * F.col("n_source"))).alias("fraction"),
    )
    # rows of a source below range k, by the same double arithmetic: the guess is within one and then set right
    guess = F.greatest(F.lit(0), F.floor(F.col("k") * F.col("n_source") / F.lit(ranges)) - 2).cast("long")

    def is_below(rank):
        return (rank < F.col("n_source")) & (((2 * rank + 1) * F.lit(ranges) / (2 * F.col("n_source"))).cast("long") < F.col("k"))

    counted = guess + sum(F.when(is_below(guess + i), 1).otherwise(0) for i in range(5))
    starts = materialize(
        below.select("k", F.least(counted, F.col("n_source")).alias("c")).groupBy("k").agg(F.sum("c").alias("start")),
        "interleave-starts",
    ).withColumnRenamed("k", "s_k")
    order = Window.partitionBy("k").orderBy("fraction", "source", "rank")
    lined = (
        placed.withColumn("in_k", F.row_number().over(order) - 1)
        .join(starts, F.col("k") == F.col("s_k"))
        .withColumn("position", F.col("start") + F.col("in_k"))
    )

    # 3. cut: the first n mod shards shards hold one more
    q, m = n // shards, n % shards
    big = m * (q + 1)
    p = F.col("position")
    if q == 0:
        shard, slot = p, F.lit(0).cast("long")
    else:
        shard = F.when(p < big, F.floor(p / (q + 1))).otherwise(m + F.floor((p - big) / q))
        slot = F.when(p < big, p % (q + 1)).otherwise((p - big) % q)
    return lined.select(
        "doc_id", F.when(F.col("source") == "\u0000", None).otherwise(F.col("source")).alias("source"), "size", "text_crc32",
        "position", shard.cast("int").alias("shard"), slot.cast("long").alias("slot"),
    )
