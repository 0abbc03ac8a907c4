"""Connected components of a link table, by alternating large and small stars (Kiveris et al., 2014).

Each round is two aggregations and two equi-joins over the links; a hub's links are joined by `attach`, so they
stay where they are. Nothing of the graph reaches the driver but a count and a checksum, which tell that a round
changed nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, drop_table, materialize


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, root for every node with a link to another; root: the smallest node reachable.

    Null ends and links of a node to itself count for nothing; repeated links are one. No links: no rows.
    """
    now = materialize(links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u < v").distinct(), "links")
    mark = _mark(now)
    while mark[0]:
        both = now.selectExpr("u AS x", "v AS y").unionAll(now.selectExpr("v AS x", "u AS y"))
        least = materialize(both.groupBy("x").agg(F.min("y").alias("m"), F.count("*").alias("c")).select("x", F.least("x", "m").alias("m"), "c"), "least")
        large = materialize(attach(both, least, ["x"], "c", 2 * mark[0]).where("y > x").selectExpr("m AS u", "y AS v").distinct(), "large")
        lower = materialize(large.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("c")), "least")
        small = attach(large, lower, ["v"], "c", mark[0]).where("u <> m").selectExpr("m AS u", "u AS v")
        small = small.unionAll(lower.selectExpr("m AS u", "v")).distinct()
        after = materialize(small, "links")
        last, mark = mark, _mark(after)
        for done in (now, least, large, lower):
            drop_table(done)
        now = after
        if mark == last:
            break
    return now.selectExpr("v AS node", "u AS root").unionAll(now.selectExpr("u AS node", "u AS root").distinct())


def _mark(t: DataFrame) -> tuple:
    return tuple(t.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
