"""Connected components of a table of links, by alternating large-star and small-star rounds.

Each round is joins and partial aggregates over the links, written to the shared folder; nothing is collected. A node with
many links (a hub) would bring them all to one task of a join. Hubs are those with more links than ``HUB_LINKS``, or than
would leave over ``HUBS`` of them: so there are at most ``HUBS``, whatever the input, and their minima are broadcast. All
other nodes' links are few, and join by a shuffle.

Defined cases: null ends and links of a node to itself count as no link; a node of no other link is not in the result.
Repeated links count once. No links give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialise

#: Links of a node above which it is a hub, and hubs that are broadcast at most (two longs each).
HUB_LINKS, HUBS = 200, 500_000


def with_least(links: DataFrame, n_links: int) -> DataFrame:
    """links (u, v) with m, the least v of each u; n_links: their number or more."""
    most = max(HUB_LINKS, -(-n_links // HUBS))
    least = links.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    hubs = F.broadcast(least.filter(F.col("n") > most).select("u", "m"))  # fewer than n_links / most, so HUBS at most
    rest = links.join(hubs.select("u"), "u", "left_anti").join(least.filter(F.col("n") <= most).select("u", "m"), "u")
    return links.join(hubs, "u").select("u", "v", "m").union(rest.select("u", "v", "m"))


def components(links: DataFrame, n_links: int | None = None) -> DataFrame:
    """(node, component): for every node of links (a, b), the smallest node that it reaches. n_links: their number or more, where known."""
    spark = links.sparkSession
    edges = links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, seen = materialise(edges, "components", n_links), None
    count = edges.count()
    while True:
        # large star: every neighbour above u links to the least of u and its neighbours
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both, 2 * count).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = materialise(large.distinct(), "components", count)
        # small star: u and its lower neighbours link to the least of them
        own = with_least(large, count)
        small = own.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(own.select("u", F.col("m").alias("v")))
        last, edges = edges, materialise(small.distinct(), "components", 2 * count)
        count, mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_table(spark, last)
        drop_table(spark, large)
        if (count, mark) == seen:
            break
        seen = (count, mark)
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
