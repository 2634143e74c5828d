"""Connected components by alternating stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotcast.sources.storage import materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The smallest member of each node's component: ``node`` and ``component``.

    Large stars hang a node's larger neighbours on its smallest one, small stars the
    smaller ones; both in turn until nothing moves. Edges are written to the
    shared folder after each round, never gathered by node, so a node may have any number.
    Nodes without a link aren't in the result; null and equal ends are passed over.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = materialize(edges.filter(F.col("u") != F.col("v")).distinct(), "edges")
    state = _state(edges)
    while True:
        edges = materialize(_small(_large(edges)), "edges")
        now = _state(edges)
        if now == state:
            break
        state = now
    own = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return own.unionByName(roots).groupBy("node").agg(F.min("component").alias("component"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = both.join(least, "u").filter(F.col("v") > F.col("u"))
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    edges = edges.filter(F.col("u") != F.col("v")).distinct()
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    hung = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return hung.filter(F.col("u") != F.col("v")).distinct()
