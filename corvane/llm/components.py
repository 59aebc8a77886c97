"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.shared import discard, materialise


def _is_forest(edges: DataFrame) -> bool:
    """Whether every a has one b that is no a itself: then each b is the smallest node of its component."""
    ends = edges.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up = 1 and down = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) rows of one integer type -> (node, component): the smallest node of its component.

    Both star operations are a min per node and a join back, so no adjacency list is ever held
    in a task, and each round's edges are a written table, so a lost executor costs one round.
    Rounds end when the edges are stars; edges that are stars already take none.
    Self loops and repeated edges are harmless; null ends are ignored.
    """
    spark = edges.sparkSession
    cur, path = materialise(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .filter("a is not null and b is not null and a <> b").distinct(), "cc")
    while not _is_forest(cur):
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a")
                 .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
                 .select("e.a", "e.b").filter("a <> b").distinct())
        nxt, nxt_path = materialise(small, "cc")
        discard(spark, path)
        cur, path = nxt, nxt_path
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def joined(comp: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links. comp: (node, component) as of components(); links: (a, b), whose nodes may be new.

    The links are drawn between components, so the rounds see those that still join two and no others;
    without any, comp is returned as it is.
    """
    at = lambda end: comp.select(F.col("node").alias(end), F.col("component").alias(f"{end}_comp"))
    between, path = materialise(
        links.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b"))
        .filter("a is not null and b is not null and a <> b").distinct(), "cc-between")
    if between.isEmpty():
        discard(comp.sparkSession, path)
        return comp
    new = components(between)
    discard(comp.sparkSession, path)
    moved = comp.join(new.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return moved.union(new.join(comp, "node", "left_anti"))
