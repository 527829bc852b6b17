"""Rounds of discovery: what a tree doesn't take is clustered, clusters are named and grafted as nodes, and the next round matches with them.

Names are the terms that tell a cluster from the others, in place of a language model. Trees are tables (see trees) with
an anchor vector for each node; a round's tree, its measures and its pools are versions beside each other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import snake_key
from ..functions.vectors import centroids
from ..session import written
from ..sources.documents import write_versioned
from . import corpus, discovery, taxonomy, trees

#: Terms of a name, and the letters that a term has at least.
NAME_TERMS, LETTERS = 3, 3
#: Places that a round's nodes may take among their siblings.
PLACES = 1_000_000


def terms(text: Column) -> Column:
    """The words of a text that have enough letters, lower case, with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"(\\p{{L}}{{{LETTERS},}})"), F.lit(1))


def class_terms(rows: DataFrame, by: str, text: str, k: int) -> DataFrame:
    """by, term, n, score and rank: the k terms that mark a class most, ties by term.

    The score is the occurrences in the class times ln(1 + A / f), f the occurrences in all classes and A the average
    number of words of a class. Counts are made before the shuffle, so a frequent word or class is no hot spot.
    """
    counts = written(rows.select(by, F.explode(terms(F.col(text))).alias("term")).groupBy(by, "term").agg(F.count("*").alias("n")), "class-terms")
    whole = counts.groupBy("term").agg(F.sum("n").alias("f"))
    average = counts.agg((F.sum("n") / F.count_distinct(by)).alias("a")).first()["a"] or 0.0
    scored = counts.join(whole, "term").select(by, "term", "n", F.round(F.col("n") * F.log(1 + F.lit(float(average)) / F.col("f")), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "term"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def named(rows: DataFrame, by: str, text: str) -> DataFrame:
    """by, name, description and wanted (a key) of each class of rows; one without a word is a topic."""
    best = class_terms(rows, by, text, NAME_TERMS).groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("t"))
    name = F.when(F.size("t") > 0, F.initcap(F.array_join("t", " "))).otherwise("Topic")
    all_ = rows.select(by).distinct().join(best, by, "left").select(by, F.coalesce("t", F.array().cast("array<string>")).alias("t"))
    desc = F.when(F.size("t") > 0, F.concat(F.lit("Documents about "), F.array_join("t", ", "), F.lit("."))).otherwise("Documents without words.")
    return all_.select(by, name.alias("name"), desc.alias("description"), snake_key(name).alias("wanted"))


def free_keys(wanted: DataFrame, taken: DataFrame, order: list[str]) -> DataFrame:
    """The rows of wanted with a key that nothing else has: the wanted one, or with the first numbers from 2 that are free.

    Among rows that want the same the order decides. A key that another row wants is taken too.
    """
    keys = taken.select("key").unionByName(wanted.select(F.col("wanted").alias("key"))).distinct()
    numbered = keys.select(F.regexp_extract("key", r"^(.*)_(\d{1,9})$", 1).alias("wanted"), F.regexp_extract("key", r"_(\d{1,9})$", 1).try_cast("int").alias("i")).where("wanted <> '' AND i >= 2")
    plain = taken.select(F.col("key").alias("wanted"), F.lit(1).alias("i"))
    used = numbered.unionByName(plain).groupBy("wanted").agg(F.collect_set("i").alias("used"))
    rows = wanted.join(used, "wanted", "left").withColumn("used", F.coalesce("used", F.array().cast("array<int>")))
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("wanted").orderBy(*order)))
    free = F.filter(F.sequence(F.lit(1), F.size("used") + F.col("_r")), lambda i: ~F.array_contains("used", i))
    number = F.element_at(free, F.col("_r"))
    return rows.withColumn("key", F.when(number == 1, F.col("wanted")).otherwise(F.concat_ws("_", "wanted", number.cast("string")))).drop("used", "_r")


def grafted(nodes: DataFrame, found: DataFrame, version: int) -> DataFrame:
    """The nodes and those of clusters: level, parent_key, key, name, description, centroid. Above level 3 a node has general ones below it, so leaves stay there."""
    place = F.row_number().over(Window.partitionBy("parent_key").orderBy("key")) + F.lit(version * PLACES)
    parts = [found.withColumn("place", place).select("key", "parent_key", "place", "name", "description", F.lit("discovered").alias("source"), F.col("centroid").alias("vec"), "level")]
    for _ in range(2):
        above = parts[-1].where("level < 3")
        base = F.regexp_replace("name", r"( \(General\))+$", "")
        parts.append(above.select(F.concat("key", F.lit("_general")).alias("key"), F.col("key").alias("parent_key"), F.lit(0).alias("place"), F.concat(base, F.lit(" (General)")).alias("name"), F.concat(F.lit("General documents within the discovered category '"), base, F.lit("'.")).alias("description"), "source", "vec", (F.col("level") + 1).alias("level")))
    new = parts[0].unionByName(parts[1]).unionByName(parts[2]).drop("level")
    return nodes.select(*new.columns).unionByName(new.withColumn("place", F.col("place").cast("int")))


def anchors(nodes: DataFrame) -> DataFrame:
    """ord, level, key, parent_key and vec: what taxonomy.classify matches with."""
    return trees.flat(nodes.drop("vec")).select("ord", "level", "key", "parent_key").join(nodes.select("key", "vec"), "key")


def measures(classified: DataFrame, flattened: DataFrame, gates: tuple[float, float, float]) -> DataFrame:
    """measure and value of a version: rows, rows by status and by first failing level, and nodes by level and source."""
    status = taxonomy.histogram(classified).select(F.concat(F.lit("status "), "status").alias("measure"), F.col("n").alias("value"))
    level = taxonomy.pools(classified, gates).groupBy("level").agg(F.count("*").alias("value")).select(F.concat(F.lit("fails level "), F.col("level").cast("string")).alias("measure"), "value")
    size = trees.counts(flattened).select(F.concat_ws(" ", F.lit("nodes"), F.col("level").cast("string"), "source").alias("measure"), F.col("n").alias("value"))
    return status.unionByName(level).unionByName(size).unionByName(classified.agg(F.count("*").alias("value")).select(F.lit("rows").alias("measure"), "value"))


@dataclass
class Round:
    """A version of a tree (nodes with vec), its measures, and of the rows that it didn't take the pools and the clusters found (level, parent_key, key, name, size)."""

    nodes: DataFrame
    measures: DataFrame
    pools: DataFrame | None = None
    found: DataFrame | None = None


def discover(rows: DataFrame, nodes: DataFrame, gates: tuple[float, float, float], most: int = 5, path: str | None = None, key: str = "vec_id", vector: str = "embedding", text: str = "text") -> list[Round]:
    """Rounds until no pool has a cluster, or so many. With a path each version's nodes and measures are written there, from version 1.

    nodes: key, parent_key, place, name, description, source, vec. rows: key, vector and text.
    """
    rows, out = written(rows.select(key, vector, text), "rows"), []
    nodes = written(nodes.select("key", "parent_key", "place", "name", "description", "source", "vec"), "tree")
    wrong = [f"{r['problem']} {r['key']}" for r in trees.faults(nodes).limit(20).collect()]
    if wrong:
        raise ValueError(f"the tree has faults: {wrong}")
    for version in range(1, most + 2):
        tree = written(anchors(nodes), "anchors")
        classified = written(taxonomy.classify(rows, tree, gates, key, vector), "classified")
        now = Round(nodes, written(measures(classified, trees.flat(nodes.drop("vec")), gates), "measures"))
        out.append(now)
        if path:
            write_versioned(nodes, f"{path}/tree", version)
            write_versioned(now.measures, f"{path}/measures", version)
        if version > most:
            break
        left = written(taxonomy.unassigned(classified, tree.drop("vec"), gates, key).join(rows, key), "left")
        clusters = written(discovery.mass_clusters(left, "pool", key, vector), "clusters")
        now.pools = written(discovery.report(clusters, "pool"), "pool-report")
        members = clusters.where("cluster >= 0").select("pool", key, F.concat_ws("#", "pool", F.col("cluster").cast("string")).alias("cluster"))
        members = written(members.join(left.select(key, "level", "parent_key", vector, text), key), "members")
        if members.isEmpty():
            now.found = members.select("level", "parent_key", F.lit("").alias("key"), F.lit("").alias("name"), F.lit(0).cast("long").alias("size"))
            break
        sizes = members.groupBy("cluster", "level", "parent_key").agg(F.count("*").alias("size"))
        found = sizes.join(named(members, "cluster", text), "cluster").join(centroids(members, "cluster", vector).drop("n"), "cluster")
        found = written(free_keys(found, nodes, ["cluster"]), "found")
        now.found = found.select("level", "parent_key", "key", "name", "size")
        nodes = written(grafted(nodes, found, version), "tree")
    return out


def changes(old: Round, new: Round) -> DataFrame:
    """measure, old, new and change of two versions."""
    return corpus.compared(old.measures, new.measures, "measure", "value")
