"""Connected components of a table of pairs, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.session import drop, settle


def connected_components(pairs: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(id, component): the least id reachable from each id that occurs in ``pairs``.

    Ids may be numbers or strings; self pairs make single-node components, rows with a null are left out. Each
    round takes partial minima a node before the shuffle and joins them back, so a node with a large share of
    all pairs is an ordinary skewed join; rounds are cut off from each other by a written table, and so is the result.
    """
    both = pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    loops = both.where("u = v").select(F.col("u").alias("id"))
    edges = settle(both.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        before, edges = edges, settle(_small_star(_large_star(edges)), "stars")
        drop(before)
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components have not settled in {max_rounds} rounds")
    found = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("id")).union(loops).distinct().withColumn("component", F.col("id"))
    out = settle(found.union(roots).groupBy("id").agg(F.min("component").alias("component")), "components")
    drop(edges)
    return out


def _large_star(edges: DataFrame) -> DataFrame:
    """Join every larger neighbour of a node to the least in the node's neighbourhood."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Join a node and its smaller neighbours to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def extend_components(known: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows (id, component) that ``pairs`` (a, b) add to ``known``, itself such rows of earlier calls.

    Components only grow and are named by their least id, so the component of an id is the least of its rows, and
    adding rows twice changes nothing. Of ``known`` only the ids in ``pairs`` and the members of components that
    lose their name are looked up; the rounds run over the names that meet, as many as there are pairs at most.
    """
    pairs = settle(pairs.select("a", "b").where("a is not null and b is not null").distinct(), "pairs")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    was = known.join(ids, "id", "left_semi").groupBy("id").agg(F.min("component").alias("old"))
    at = settle(ids.join(was, "id", "left").select("id", F.coalesce("old", "id").alias("name"), F.col("old").isNull().alias("fresh")), "names")
    ends = [at.select(F.col("id").alias(c), F.col("name").alias(f"{c}_name")) for c in ("a", "b")]
    found = connected_components(pairs.join(ends[0], "a").join(ends[1], "b"), "a_name", "b_name")
    names = found.withColumnRenamed("id", "name")
    fresh = at.where("fresh").join(names, "name").select("id", "component")
    moved = names.where("name <> component")
    again = known.withColumnRenamed("component", "name").join(moved, "name").select("id", "component")
    out = settle(fresh.union(again).groupBy("id").agg(F.min("component").alias("component")), "extended")
    drop(pairs, at, found)
    return out
