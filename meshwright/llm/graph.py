"""Connected components of a link table by DataFrame joins, without grouping a hot vertex.

Each round replaces links by stars around smaller labels (the alternating large-star and
small-star steps): a vertex's neighbours are told the least label around it. Only minima are
aggregated (combined before the shuffle) and written; rows of a vertex meet the written
minimum by a plain equi-join, whose partitions the engine splits when a vertex is hot. Rounds end when the links are stars: each
vertex has one smaller neighbour or only larger ones. No links give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.llm.common import Workspace, sized


def settled(stars: DataFrame, rows: int) -> bool:
    """Whether every vertex of (u, v), u > v, has one smaller neighbour or only larger ones."""
    ends = stars.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        stars.select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    sides = sized(ends, 2 * rows).groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not sides.where("up > 1 OR (up = 1 AND down = 1)").agg(F.count("*")).first()[0]


def components(links: DataFrame, work: Workspace | None = None, max_rounds: int = 60) -> DataFrame:
    """(id, component) of every vertex that has a link; links are (a, b) longs in a written table.

    Rounds are written into ``work``, where the result is read from. The partitions of a round follow the number of links: few links take few tasks.
    """
    work = work or Workspace(links.sparkSession, "components")
    rows = links.count()
    stars = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v")
    stars = work.keep(sized(sized(stars, rows).distinct(), rows), "links")
    for _ in range(max_rounds):
        if settled(stars, rows):
            break
        # large star: every neighbour above u points at the least label around u
        both = sized(stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v"))), 2 * rows)
        least = work.keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "v"), "least")
        large = sized(stars, rows).join(least, "v").select("u", F.col("m").alias("v")).where("u > v")
        large = work.keep(sized(large.distinct(), rows), "large")
        # small star: u and its smaller neighbours point at the least of them
        low = work.keep(sized(large, rows).groupBy("u").agg(F.min("v").alias("m")), "low")
        small = sized(large, rows).join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = sized(small.unionByName(low.withColumnRenamed("m", "v")), 2 * rows)
        stars = work.keep(sized(small.distinct(), 2 * rows), "stars")
    else:
        if not settled(stars, rows):
            raise RuntimeError(f"links are not stars after {max_rounds} rounds")
    roots = stars.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
