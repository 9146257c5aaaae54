"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step is two joins on node ids over edges of two integers; a node with very many links is
aggregated before the shuffle, and no neighbour list is ever collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seismark.llm.shared import written


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
    return row[0], row[1]


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id that is linked with a smaller one; component is the smallest id reachable.

    links has two integer columns, the two ends.  Links with a null end, links of an id with itself
    and repeated links are ignored.  An id that is the smallest of its component, or has no link, has
    no row.  An empty table gives an empty result.
    """
    a, b = (F.col(f"`{c}`").cast("long") for c in links.columns[:2])
    edges = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where((a != b) & a.isNotNull() & b.isNotNull()).distinct())
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
