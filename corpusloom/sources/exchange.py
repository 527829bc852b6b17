"""Files for other programs: embedded chunks and labels as JSON, match results, thresholds and run summaries as versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import exists
from .documents import write_versioned

#: Columns of embedded chunks: those that each must have, and later ones with what stands for them where they are missing.
NEEDED = "chunk_id string, document_id string, title string, heading string, content string, source_path string, embedding array<double>"
LATER = "version string, chunk_index int, heading_path array<string>, content_hash string, token_count int, chunk_version string, embedding_model string, embedding_dimension int, normalized boolean, offsets array<int>, document_metadata map<string,string>"
_MISSING = {"chunk_index": 0, "content_hash": "", "token_count": 0, "chunk_version": "v1"}


def _schema(text: str) -> StructType:
    return StructType.fromDDL(text)


def _filled(rows: DataFrame) -> DataFrame:
    """Chunks with what stands for later columns; one without an identity, content or vector is an error."""
    needs = [c for c in _schema(NEEDED).names if c != "heading"]
    lost = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in needs)))
    empty = {"heading_path": F.array().cast("array<string>"), "document_metadata": F.from_json(F.lit("{}"), "map<string,string>")}
    checked = rows.withColumn("chunk_id", F.when(F.size(lost) == 0, F.col("chunk_id")).otherwise(F.raise_error(F.concat(F.lit("a chunk lacks "), F.array_join(lost, ", ")))))
    return checked.withColumns({c: F.coalesce(F.col(c), F.lit(x)) for c, x in (_MISSING | empty).items()})


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """Embedded chunks of all JSON files below a path, and ``file``, by which they may be ordered. Files hold an array, or one on each line.

    Columns that older files lack have their defaults. A folder that isn't there has none.
    """
    whole = _schema(f"{NEEDED}, {LATER}")
    if not exists(spark, path):
        return spark.createDataFrame([], whole).withColumn("file", F.lit("")).limit(0)
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("wholetext", False).text(path).select("value", F.col("_metadata.file_path").alias("file"))
    listed = lines.where(F.rlike("value", F.lit(r"^\s*\[.*\]\s*$"))).select("file", F.explode(F.from_json("value", f"array<{whole.simpleString()}>")).alias("c")).select("c.*", "file")
    files = spark.read.schema(whole).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path).select("*", F.col("_metadata.file_path").alias("file"))
    # a file whose lines are arrays of their own is read by lines, not as a whole
    by_line = lines.where(F.rlike("value", F.lit(r"^\s*\[.*\]\s*$"))).select("file").distinct()
    return _filled(files.join(by_line, "file", "left_anti").select(*whole.names, "file").unionByName(listed.select(*whole.names, "file")))


def write_embeddings(chunks: DataFrame, path: str) -> None:
    """Embedded chunks as JSON, an array for each document on a line of its own, in the order of chunks; what was there goes."""
    names = [c for c in _schema(f"{NEEDED}, {LATER}").names if c in chunks.columns]
    place = F.col("chunk_index") if "chunk_index" in names else F.lit(0)
    held = F.array_sort(F.collect_list(F.struct(place.alias("_at"), F.col("chunk_id").alias("_id"), F.struct(*names).alias("_c"))), lambda a, b: F.when(a["_at"] < b["_at"], -1).when(a["_at"] > b["_at"], 1).when(a["_id"] < b["_id"], -1).when(a["_id"] > b["_id"], 1).otherwise(0))
    rows = chunks.groupBy("document_id").agg(F.to_json(F.transform(held, lambda x: x["_c"])).alias("value"))  # a document's chunks
    rows.select("value").write.mode("overwrite").option("lineSep", "\n").format("text").save(path)


def match_rows(matches: DataFrame, anchors: DataFrame, key: str = "vec_id") -> DataFrame:
    """key, l1_row, l2_row and l3_row (places of the best path's anchors, -1 for none) and the scores: a form that fixed anchors turn back.

    matches: key, best_leaf and scores, see taxonomy.classify. anchors: ord, level, key, parent_key.
    """
    at = lambda level, child, row, parent: anchors.where(F.col("level") == level).select(F.col("key").alias(child), F.col("ord").alias(row), F.col("parent_key").alias(parent))
    rows = matches.join(at(3, "best_leaf", "_r3", "_k2"), "best_leaf", "left").join(at(2, "_k2", "_r2", "_k1"), "_k2", "left").join(at(1, "_k1", "_r1", "_k0"), "_k1", "left")
    return rows.select(key, *(F.coalesce(f"_r{i}", F.lit(-1)).cast("long").alias(f"l{i}_row") for i in (1, 2, 3)), *(F.col(f"l{i}_score").cast("float").alias(f"l{i}_score") for i in (1, 2, 3)))


def write_labels(classified: DataFrame, names: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """Writes one JSON line a document, with what names (by key: doc_id, rel_path, source, title) tells of it, and returns n and percent by status."""
    scores = F.struct(*(F.round(f"l{i}_score", 6).alias(f"L{i}") for i in (1, 2, 3)))
    rows = names.join(classified, key, "left").select(*names.columns, F.coalesce("status", F.lit("UNKNOWN")).alias("classification_status"), F.coalesce("depth", F.lit(0)).alias("category_depth"), F.when(F.col("path") != "", F.split("path", " > ")).otherwise(F.array().cast("array<string>")).alias("category_path"), scores.alias("level_scores"))
    rows.write.mode("overwrite").json(path)
    done = rows.sparkSession.read.schema("classification_status string").json(path)
    known = done.sparkSession.createDataFrame([(s,) for s in ("ASSIGNED", "PARTIAL", "FALLBACK", "UNKNOWN")], "status string")
    counts = known.join(done.groupBy(F.col("classification_status").alias("status")).agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))
    total = done.count()
    return counts.select("status", "n", F.round(F.col("n") * 100.0 / max(total, 1), 1).alias("percent"))


def write_thresholds(spark: SparkSession, found: dict[int, dict], path: str, version: int, n_documents: int, settings: dict[str, str]) -> str:
    """A version of thresholds: a row a level with its value (six digits), method, reason and number of scores, and the settings. Versions stay.

    found: what thresholds.fit gives for each level.
    """
    rows = [(level, round(f["value"], 6), f["method"], f["reason"], f["n"], n_documents, settings) for level, f in sorted(found.items())]
    return write_versioned(spark.createDataFrame(rows, "level int, value double, method string, reason string, n long, n_documents long, settings map<string,string>"), path, version)
