"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star step over links (a, b): every neighbour of ``u`` on one side is
    linked to the smallest node around ``u``."""
    swapped = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    both = links.union(swapped)
    if not large:
        both = both.filter("b < a")
    low = both.groupBy("a").agg(F.min("b").alias("__low")).select("a", F.least("a", "__low").alias("__low"))
    joined = both.join(low, "a")
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("__low").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("__low").alias("b")).union(
            low.select("a", F.col("__low").alias("b"))
        )
    return out.filter("a <> b").distinct()


def component_labels(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is the smallest node
    that can be reached.  The links are written once a round; rounds grow with
    the logarithm of the longest path."""
    state = materialize(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links"
    )
    digest = None
    while True:
        now = state.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if now["n"] == 0 or (now["n"], now["x"]) == digest:
            break
        digest = (now["n"], now["x"])
        state = materialize(_star(_star(state, True), False), "links")
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
