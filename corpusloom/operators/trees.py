"""Category trees as tables: a row a node, with its parent's key and its place among its siblings.

Paths come from a recursive query, sizes of subtrees and the depth-first order from the pairs of nodes and ancestors, so
no tree passes the driver. Nodes that no root leads to aren't in any result but faults().
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written
from .taxonomy import flatten

NODE = "key string, parent_key string, place int, name string, description string, source string"
#: Levels that a path may have.
LEVELS = 90


def table_of(spark: SparkSession, tree: dict) -> DataFrame:
    """The rows of a tree that is written as nested dictionaries."""
    rows = [(key, parent, at, name, desc, source) for at, key, parent, _, name, desc, source, _, _ in flatten(tree)]
    return spark.createDataFrame(rows, NODE)


def paths(nodes: DataFrame) -> DataFrame:
    """key, level (from 1), path_keys and names of each node that a root leads to, written."""
    found = nodes.sparkSession.sql(
        f"""WITH RECURSIVE t (key, level, path_keys, names) MAX RECURSION LEVEL {LEVELS} AS (
          SELECT key, 1, array(key), array(name) FROM {{nodes}} WHERE parent_key IS NULL
          UNION ALL SELECT n.key, t.level + 1, concat(t.path_keys, array(n.key)), concat(t.names, array(n.name))
          FROM t JOIN {{nodes}} n ON n.parent_key = t.key WHERE NOT array_contains(t.path_keys, n.key))
        SELECT key, level, path_keys, names FROM t""",
        nodes=nodes.select("key", "parent_key", "name"),
    )
    return written(found, "paths")


def ancestors(found: DataFrame) -> DataFrame:
    """key, ancestor and its level of each node and each node of its path, itself among them. found: see paths."""
    return found.select("key", F.posexplode("path_keys").alias("_at", "ancestor")).select("key", "ancestor", (F.col("_at") + 1).alias("level"))


def flat(nodes: DataFrame) -> DataFrame:
    """ord (depth first, from 0), key, parent_key, level, name, description, source, path_keys, breadcrumb and n_below (nodes under it).

    A node's place in the order is what comes before it: its ancestors, and the subtrees of their and its own earlier siblings.
    """
    found = paths(nodes)
    above = written(ancestors(found), "ancestors")
    sizes = above.groupBy(F.col("ancestor").alias("key")).agg(F.count("*").alias("_size"))
    sized = nodes.join(sizes, "key")
    before = Window.partitionBy("parent_key").orderBy("place", "key").rowsBetween(Window.unboundedPreceding, -1)  # siblings
    sized = written(sized.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))), "sizes")
    at = above.join(sized.select(F.col("key").alias("ancestor"), "_before"), "ancestor").groupBy("key").agg((F.sum(F.col("_before") + 1) - 1).cast("int").alias("ord"))
    rows = sized.join(found, "key").join(at, "key")
    return rows.select("ord", "key", "parent_key", "level", "name", "description", "source", "path_keys", F.array_join("names", " > ").alias("breadcrumb"), (F.col("_size") - 1).alias("n_below"))


def faults(nodes: DataFrame) -> DataFrame:
    """problem and key: keys that come twice, parents that aren't there, and nodes on or below a cycle."""
    twice = nodes.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate key").alias("problem"), "key")
    known = nodes.select(F.col("key").alias("parent_key")).distinct()
    orphans = nodes.where("parent_key IS NOT NULL").join(known, "parent_key", "left_anti").select("key").distinct()
    # with its own parent forgotten an orphan is a root, and what it leads to has no other fault
    rooted = nodes.join(orphans.withColumn("_lost", F.lit(True)), "key", "left").select("key", F.when(F.col("_lost"), None).otherwise(F.col("parent_key")).alias("parent_key"), "name")
    circled = nodes.select("key").distinct().join(paths(rooted).select("key").distinct(), "key", "left_anti")
    return twice.unionByName(orphans.select(F.lit("missing parent").alias("problem"), "key")).unionByName(circled.select(F.lit("cycle").alias("problem"), "key"))


def counts(flattened: DataFrame) -> DataFrame:
    """Nodes by level and source. flattened: see flat."""
    return flattened.groupBy("level", "source").agg(F.count("*").alias("n"))


def matched_below(flattened: DataFrame, matches: DataFrame, key: str = "best_leaf") -> DataFrame:
    """key and n of every node: rows that are matched with it or a node below it."""
    own = matches.groupBy(F.col(key).alias("_leaf")).agg(F.count("*").alias("_n"))
    up = flattened.select(F.col("key").alias("_leaf"), F.explode("path_keys").alias("key")).join(own, "_leaf")
    return flattened.select("key").join(up.groupBy("key").agg(F.sum("_n").alias("n")), "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("n"))
