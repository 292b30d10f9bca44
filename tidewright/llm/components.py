"""Connected components of a link table, by alternating star operations.

Each round hangs a node's larger neighbours, then its smaller ones, on the
least node it knows, until the links are stars around the least node of each
component. Neighbourhoods are never collected: each step is a minimum by key
(summed before the shuffle) and a join back, so a node with very many links is
no single task's work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _hung(links: DataFrame, both: bool) -> DataFrame:
    """(u, v): each v of u's neighbours (both: the larger; else u and the smaller) with the least of them and u."""
    ways = links.union(links.select("v", "u")) if both else links
    least = ways.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    rows = ways.join(least, "u")
    if both:
        return rows.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rows.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))


def components(links: DataFrame) -> DataFrame:
    """(node, component): every node of links (u, v) but the least of its component, with that least node."""
    pairs = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    pairs, before = staged(pairs, "links"), None
    while True:
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = state
        large = _hung(pairs, True).where("u <> v").distinct()
        pairs = staged(_hung(large, False).where("u <> v").distinct(), "links")
