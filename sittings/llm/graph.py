"""Connected components of a table of links, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sittings.runtime import discard, settle


def _stars(links: DataFrame) -> bool:
    """Whether each node has one smaller neighbour or only greater ones; two steps would change nothing then.

    Links are distinct, with u > v.
    """
    ends = links.selectExpr("u AS node", "1L AS smaller", "0L AS greater")
    ends = ends.unionAll(links.selectExpr("v AS node", "0L AS smaller", "1L AS greater"))
    sums = ends.groupBy("node").agg(F.sum("smaller").alias("smaller"), F.sum("greater").alias("greater"))
    return sums.filter("smaller > 1 OR smaller > 0 AND greater > 0").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(doc_id, component_id) of every end of a link (a, b): the smallest id reachable.

    Alternates two steps until all links are stars: each node hands its greater neighbours to
    the smallest neighbour, then its smaller neighbours (and itself) to the smallest. Both
    are a grouped minimum and a join, so no neighbourhood is gathered in one place; the
    number of rounds grows with the logarithm of the longest chain. Empty links give an
    empty table.
    """
    ends = [F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")]
    links = settle(links.filter("a <> b").select(*ends).distinct(), "links")
    while not _stars(links):
        both = links.unionAll(links.selectExpr("v AS u", "u AS v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").selectExpr("v AS u", "m AS v")
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        handed = large.join(least, "u").filter("v <> m").selectExpr("v AS u", "m AS v")
        small = least.select("u", F.col("m").alias("v")).unionAll(handed).distinct()
        following = settle(small, "links")
        discard(links)
        links = following
    members = links.selectExpr("u AS doc_id", "v AS component_id")
    return members.unionAll(links.selectExpr("v AS doc_id", "v AS component_id").distinct())
