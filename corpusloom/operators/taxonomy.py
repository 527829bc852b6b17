"""A three-level category tree: flattening, checks, matching with fallback, and counts."""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import matrix

#: Nodes of a tree that is matched against, and bytes of their vectors; a tree is made by hand and does not grow with the corpus.
MAX_NODES, MAX_BYTES = 100_000, 256 << 20
#: Similarities that are held at a time.
BLOCK = 1 << 22


def flatten(tree: dict) -> list[tuple]:
    """(ord, key, parent, level, name, description, source, path_keys, breadcrumb) of each node, in depth-first order."""
    out: list[tuple] = []

    def walk(nodes: dict, level: int, parent: str | None, keys: list[str], names: list[str]) -> None:
        for key, n in nodes.items():
            path, crumbs = [*keys, key], [*names, n["name"]]
            out.append((len(out), key, parent, level, n["name"], n.get("desc", ""), n.get("source", "seed"), path, " > ".join(crumbs)))
            walk(n.get("children") or {}, level + 1, key, path, crumbs)

    walk(tree, 1, None, [], [])
    return out


STATUSES = ("ASSIGNED", "PARTIAL", "FALLBACK", "UNKNOWN")
FLAT_SCHEMA = "ord int, key string, parent_key string, level int, name string, description string, source string, path_keys array<string>, breadcrumb string"


def problems(nodes: DataFrame) -> DataFrame:
    """problem and key: keys that come twice, blank names and descriptions, leaves above or below level 3."""
    twice = nodes.groupBy("key").count().where("count > 1").select(F.lit("duplicate key").alias("problem"), "key")
    blank = nodes.where(F.trim(F.coalesce("name", F.lit(""))) == "").select(F.lit("blank name").alias("problem"), "key")
    blank = blank.unionByName(nodes.where(F.trim(F.coalesce("description", F.lit(""))) == "").select(F.lit("blank description").alias("problem"), "key"))
    leaves = nodes.join(nodes.select(F.col("parent_key").alias("key")).distinct(), "key", "left_anti").where("level <> 3")
    return twice.unionByName(blank).unionByName(leaves.select(F.lit("leaf not at level 3").alias("problem"), "key"))


def classify(rows: DataFrame, anchors: DataFrame, thresholds: tuple[float, float, float], key: str = "vec_id", vector: str = "embedding", digits: int = 6) -> DataFrame:
    """Status, depth, keys and scores for each row.

    anchors: ord, level, key, parent_key, vec. The best leaf of the whole tree decides the path; its
    ancestors' scores are gated from the top. Where level 1 fails, the best node of levels 2 and 3 that reaches
    its own threshold is the fallback (level 2 first among equals). Products are made by blocks of rows with the
    anchors' matrix, whose size is bounded by MAX_NODES and MAX_BYTES.
    """
    nodes = [r.asDict() for r in anchors.orderBy("ord").limit(MAX_NODES + 1).collect()]
    if len(nodes) > MAX_NODES:
        raise ValueError("the tree has too many nodes")
    where = {(n["level"], n["key"]): i for i, n in enumerate(nodes)}
    leaf = np.array([i for i, n in enumerate(nodes) if n["level"] == 3], np.int64)
    up2 = np.array([where[2, nodes[i]["parent_key"]] for i in leaf], np.int64)
    up1 = np.array([where[1, nodes[i]["parent_key"]] for i in up2], np.int64)
    deep = np.array([i for level in (2, 3) for i, n in enumerate(nodes) if n["level"] == level], np.int64)
    if sum(len(n["vec"]) for n in nodes) * 8 > MAX_BYTES:
        raise ValueError("the tree's vectors are too large")
    vecs = np.array([n["vec"] for n in nodes], np.float64)
    vecs /= np.maximum(np.linalg.norm(vecs, axis=1, keepdims=True), 1e-12)
    gate = np.array([thresholds[nodes[i]["level"] - 1] for i in deep])
    paths: list[str] = [""] * len(nodes)
    for i in sorted(range(len(nodes)), key=lambda i: nodes[i]["level"]):
        above = where.get((nodes[i]["level"] - 1, nodes[i]["parent_key"]))
        paths[i] = nodes[i]["key"] if above is None else f"{paths[above]} > {nodes[i]['key']}"
    tree = (vecs, leaf, up1, up2, deep, gate, np.array([*paths, ""], object), np.array([n["key"] for n in nodes], object), np.array([*(n["level"] for n in nodes), 0]))
    sent = rows.sparkSession.sparkContext.broadcast(tree)  # at most MAX_NODES nodes and MAX_BYTES of vectors

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vecs, leaf, up1, up2, deep, gate, paths, names, levels = sent.value
        step = max(1, BLOCK // max(1, len(vecs)))
        for whole in parts:
            for part in (whole.slice(a, step) for a in range(0, whole.num_rows, step)):
                cos = np.round(matrix(part.column(1)) @ vecs.T, digits)
                at, best = np.arange(len(cos)), cos[:, leaf].argmax(axis=1)
                chain = np.stack([np.full(len(cos), -1), up1[best], up2[best], leaf[best]])
                s1, s2, s3 = (cos[at, x] for x in chain[1:])
                d1 = s1 >= thresholds[0]
                d2 = d1 & (s2 >= thresholds[1])
                d3 = d2 & (s3 >= thresholds[2])
                other = np.where(cos[:, deep] >= gate, cos[:, deep], -np.inf)
                pick = other.argmax(axis=1)
                found = ~d1 & np.isfinite(other[at, pick])
                node = np.where(found, deep[pick], chain[d1.astype(int) + d2 + d3, at])
                status = np.array(STATUSES, object)[np.where(d3, 0, np.where(d1, 1, np.where(found, 2, 3)))]
                columns = [pa.array(status, pa.string()), pa.array(levels[node], pa.int32()), pa.array(paths[node], pa.string()), pa.array(names[leaf[best]], pa.string()), pa.array(s1), pa.array(s2), pa.array(s3)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=[key, "status", "depth", "path", "best_leaf", "l1_score", "l2_score", "l3_score"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, vector).mapInArrow(run, f"{key} {kind}, status string, depth int, path string, best_leaf string, l1_score double, l2_score double, l3_score double")


def histogram(classified: DataFrame) -> DataFrame:
    """The number of rows of each status, 0 for those that none has."""
    known = classified.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    return known.join(classified.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def _failing(thresholds: tuple[float, float, float]) -> Column:
    """The first level whose score isn't its threshold's, null where all are; a missing score isn't."""
    level = F.lit(None).cast("int")
    for i in (3, 2, 1):
        level = F.when(~F.coalesce(F.col(f"l{i}_score") >= thresholds[i - 1], F.lit(False)), i).otherwise(level)
    return level


def pools(classified: DataFrame, thresholds: tuple[float, float, float]) -> DataFrame:
    """level and best_leaf of the rows that fail a level: the first that does."""
    return classified.select(_failing(thresholds).alias("level"), "best_leaf").where("level IS NOT NULL")


def unassigned(classified: DataFrame, anchors: DataFrame, thresholds: tuple[float, float, float], key: str = "vec_id") -> DataFrame:
    """key, level, parent_key and pool of the rows that fail a level: the first that does, and the node of their path above it.

    Level 1 has no node above; of a row that fails level 3 it is the parent of its best leaf. The path is found by joins
    with the tree's rows.
    """
    above = lambda level, child, parent: anchors.where(F.col("level") == level).select(F.col("key").alias(child), F.col("parent_key").alias(parent))
    rows = classified.select(key, _failing(thresholds).alias("level"), "best_leaf").where("level IS NOT NULL")
    rows = rows.join(F.broadcast(above(3, "best_leaf", "_l2")), "best_leaf", "left").join(F.broadcast(above(2, "_l2", "_l1")), "_l2", "left")  # at most MAX_NODES rows
    parent = F.when(F.col("level") == 2, F.col("_l1")).when(F.col("level") == 3, F.col("_l2"))
    return rows.select(key, "level", parent.alias("parent_key"), F.concat_ws("/", F.col("level").cast("string"), F.coalesce(parent, F.lit(""))).alias("pool"))


def free_key(wanted: str, taken: set[str]) -> str:
    """The key, or the first of key_2, key_3 and so on that isn't taken."""
    key, n = wanted, 1
    while key in taken:
        n += 1
        key = f"{wanted}_{n}"
    return key


def _subtree(key: str, level: int, name: str, desc: str) -> dict:
    """A discovered node; below levels 1 and 2 one general child each, so that leaves are at level 3."""
    children = {}
    if level < 3:
        children[f"{key}_general"] = _subtree(f"{key}_general", level + 1, f"{name} (General)", f"General documents within the discovered category '{name}'.")[f"{key}_general"]
    return {key: {"name": name, "desc": desc, "source": "discovered", "children": children}}


def graft(tree: dict, found: list[tuple[int, str | None, str, str, str]]) -> tuple[dict, list[str]]:
    """A tree with discovered nodes (level, parent key, wanted key, name, description), and the keys of parents that it lacks.

    Keys stay unique in the whole tree; without a parent a node is one of level 1. The tree given isn't changed.
    A tree is made by hand or by a round of discovery, so it fits the driver.
    """
    tree, nodes, missing = copy.deepcopy(tree), {}, []

    def enter(children: dict) -> None:
        for key, node in children.items():
            nodes[key] = node
            enter(node.get("children") or {})

    enter(tree)
    for level, parent, wanted, name, desc in found:
        top = level == 1 or parent is None
        if not top and parent not in nodes:
            missing.append(parent)
            continue
        new = _subtree(free_key(wanted, set(nodes)), 1 if top else level, name, desc)
        (tree if top else nodes[parent].setdefault("children", {})).update(new)
        enter(new)
    return tree, missing
