"""Queries over texts and vectors: search, classification, evaluation, chunks, thresholds, discovery."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import chunking, codes, corpus, discovery, evaluation, index, keyword_index, memory, rounds, search, taxonomy, thresholds, trees
from ..session import written
from .relational import query, read

TERMS = "thre onre anea"
#: Gates of the three levels.
GATES = (0.10, 0.16, 0.24)
#: Query vectors of a search: those whose id is divisible.
EVERY = 20

_SCORE = """round(least(0.6 * ((n1 > 0)::INT + (n2 > 0)::INT + (n3 > 0)::INT) / 3 + 0.2 * least((n1 + n2 + n3) / 5.0, 2.0)
 + CASE WHEN contains(lower(source), 'thre') OR contains(lower(source), 'onre') OR contains(lower(source), 'anea') THEN 0.15 ELSE 0.0 END, 1.0), 4)"""
_COUNTS = ", ".join(f"((length(t) - length(replace(t, '{w}', ''))) / {len(w)}.0) AS n{i + 1}" for i, w in enumerate(TERMS.split()))
_KEYWORD = f"SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id)::INTEGER AS rank FROM (SELECT doc_id, {_SCORE} AS score FROM (SELECT *, {_COUNTS} FROM (SELECT doc_id, source, lower(source) || ' ' || lower(text) AS t FROM documents)) WHERE n1 + n2 + n3 > 0) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20"


@query(_KEYWORD)
def keyword_topk(spark, d):
    """The 20 best documents for three terms."""
    return search.keyword_search(read(spark, d, "documents"), TERMS, 20, heading="source", content="text")


@query(_KEYWORD)
def keyword_topk_indexed(spark, d):
    """The same by an index of character runs, which looks only at texts that can be among the best."""
    return keyword_index.search(keyword_index.build(read(spark, d, "documents"), heading="source", content="text"), TERMS, 20)


_V = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
_HITS = f"WITH {_V}, s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.e, v.e), 6) AS cos, q.label AS ql, v.label AS vl FROM v q JOIN v ON q.vec_id % {EVERY} = 0 AND q.vec_id <> v.vec_id), h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, vec_id)::INTEGER AS rank FROM s QUALIFY rank <= 10) "


def _queries(spark, d, one=None):
    asked = F.col("vec_id") % EVERY == 0 if one is None else F.col("vec_id") == one
    return read(spark, d, "embeddings").where(asked).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked"))


def _hits(spark, d, k=10):
    return vectors.top_k(read(spark, d, "embeddings"), _queries(spark, d), k, skip_self=True)


@query(_HITS + "SELECT query_id, vec_id, cos, rank FROM h")
def vector_topk_batch(spark, d):
    """The ten nearest rows for every 20th vector, exactly, against all rows."""
    return _hits(spark, d)


@query()
def vector_topk_approximate(spark, d):
    """The ten nearest rows for every 20th vector by an index of lists; tests measure recall."""
    e = read(spark, d, "embeddings")
    queries = e.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked"))
    return index.search(index.build(e), queries, 10, skip_self=True)


@query(_HITS + "SELECT query_id, vec_id, cos, rank FROM h")
def vector_topk_codes(spark, d):
    """The same ten rows by codes of a byte a component, whose bounds leave few vectors to compare."""
    e = read(spark, d, "embeddings")
    return codes.search(codes.build(e), _queries(spark, d), 10, skip_self=True)


@query(f"WITH {_V} SELECT v.vec_id, round(list_cosine_similarity(q.e, v.e), 6) AS cos, round(1 - round(list_cosine_similarity(q.e, v.e), 6), 4) AS distance, row_number() OVER (ORDER BY round(list_cosine_similarity(q.e, v.e), 6) DESC, v.vec_id)::INTEGER AS rank FROM v, v q WHERE q.vec_id = 0 ORDER BY rank LIMIT 15")
def vector_topk(spark, d):
    """The 15 nearest rows for one vector."""
    return vectors.top_k(read(spark, d, "embeddings"), _queries(spark, d, 0), 15).select("vec_id", "cos", F.round(1 - F.col("cos"), 4).alias("distance"), "rank")


@query(_HITS + "SELECT q.vec_id AS query_id, coalesce(min(1 - cos) < 0.5, false) AS confident, round(min(1 - cos), 6) AS distance FROM (SELECT vec_id FROM v WHERE vec_id % 10 = 0) q LEFT JOIN h ON h.query_id = q.vec_id GROUP BY q.vec_id")
def confidence_gate(spark, d):
    """Whether a query's nearest hit is near enough to answer from; every second query has no hit."""
    asked = read(spark, d, "embeddings").where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"))
    return search.confident(_hits(spark, d), asked)


@query(_HITS + "SELECT query_id, sha256(string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS context_hash FROM h JOIN documents ON doc_id = vec_id WHERE rank <= 5 GROUP BY query_id")
def prompt_context(spark, d):
    """The five best hits' texts in order, joined, as hashes."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    return search.context(_hits(spark, d, 5), docs, "vec_id", "text").select("query_id", F.sha2("context", 256).alias("context_hash"))


@query(f"WITH {_V} SELECT a.vec_id, round(list_cosine_similarity(a.e, b.e), 6) AS cos FROM v a JOIN v b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(spark, d):
    """Cosine similarity as an expression, of neighbours by id."""
    e = read(spark, d, "embeddings").select("vec_id", "embedding")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("other")), 6).alias("cos"))


@query(f"WITH {_V} SELECT vec_id, round(list_sum(list_transform(e, lambda x: x / greatest(sqrt(list_dot_product(e, e)), 1e-12))), 6) AS total FROM v")
def l2_normalise(spark, d):
    """Vectors to unit length, as sums."""
    return read(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(vectors.normalised(F.col("embedding")), F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


_CENTRE = "c AS (SELECT label, n, list(x ORDER BY p) AS c FROM (SELECT label, p, avg(x) AS x, count(*) AS n FROM (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS p FROM v) GROUP BY label, p) GROUP BY label, n)"


@query(f"WITH {_V}, {_CENTRE} SELECT label::BIGINT AS label, n, round(c[1], 6) AS first, round(c[64], 6) AS last FROM c")
def centroid_by_label(spark, d):
    """Mean vectors by label."""
    return vectors.centroids(read(spark, d, "embeddings"), "label").select("label", "n", F.round(F.col("centroid")[0], 6).alias("first"), F.round(F.col("centroid")[63], 6).alias("last"))


def _centres(spark, d):
    return vectors.centroids(read(spark, d, "embeddings"), "label")


@query(f"WITH {_V}, {_CENTRE} SELECT v.vec_id, arg_max(c.label, (round(list_cosine_similarity(v.e, c.c), 6), -c.label))::BIGINT AS nearest, max(round(list_cosine_similarity(v.e, c.c), 6)) AS cos FROM v, c GROUP BY v.vec_id")
def nearest_centroid(spark, d):
    """The nearest mean vector of each row; labels are few and their vectors go to all tasks."""
    nodes = _centres(spark, d).select(F.col("label").cast("int").alias("ord"), F.lit(3).alias("level"), F.col("label").cast("string").alias("key"), F.lit("m").alias("parent_key"), F.col("centroid").alias("vec"))
    above = spark.createDataFrame([(-2, 1, "r", None, [0.0] * 64), (-1, 2, "m", "r", [0.0] * 64)], "ord int, level int, key string, parent_key string, vec array<double>")
    rows = taxonomy.classify(read(spark, d, "embeddings"), nodes.unionByName(above), (-2.0, -2.0, -2.0))
    return rows.select("vec_id", F.col("best_leaf").cast("long").alias("nearest"), F.col("l3_score").alias("cos"))


@query(f"WITH {_V}, {_CENTRE} SELECT v.label::BIGINT AS label, v.vec_id, round(list_cosine_similarity(v.e, c.c), 6) AS cos, row_number() OVER (PARTITION BY v.label ORDER BY round(list_cosine_similarity(v.e, c.c), 6) DESC, v.vec_id)::INTEGER AS rank FROM v JOIN c ON v.label = c.label QUALIFY rank <= 3")
def cluster_representatives(spark, d):
    """The three members nearest to each mean vector."""
    e = read(spark, d, "embeddings").select(F.col("label").cast("long").alias("label"), "vec_id", "embedding")
    near = e.join(_centres(spark, d).select("label", "centroid"), "label").select("label", "vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("centroid")), 6).alias("cos"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("cos"), "vec_id"))
    return near.withColumn("rank", rank).where("rank <= 3")


_TREE = _V + """, n AS (SELECT 'L1-' || (label // 4) AS key, NULL AS parent_key, 1 AS level, label // 4 AS ord, e FROM v
 UNION ALL SELECT 'L2-' || (label // 2), 'L1-' || (label // 4), 2, 100 + label // 2, e FROM v UNION ALL SELECT 'L3-' || label, 'L2-' || (label // 2), 3, 200 + label, e FROM v),
 a AS (SELECT key, parent_key, level, ord, list(x ORDER BY p) AS c FROM (SELECT key, parent_key, level, ord, p, avg(x) AS x FROM (SELECT key, parent_key, level, ord, unnest(e) AS x, generate_subscripts(e, 1) AS p FROM n) GROUP BY ALL) GROUP BY ALL),
 s AS (SELECT vec_id, key, parent_key, level, ord, round(list_cosine_similarity(e, c), 6) AS cos FROM v, a),
 leaf AS (SELECT * FROM s WHERE level = 3 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY cos DESC, ord) = 1),
 m AS (SELECT l3.vec_id, l1.key AS k1, l2.key AS k2, l3.key AS k3, l1.cos AS s1, l2.cos AS s2, l3.cos AS s3 FROM leaf l3 JOIN s l2 ON l2.vec_id = l3.vec_id AND l2.key = l3.parent_key JOIN s l1 ON l1.vec_id = l3.vec_id AND l1.key = l2.parent_key),
 f AS (SELECT s.vec_id, s.key, s.parent_key, s.level, p.parent_key AS grand FROM s LEFT JOIN (SELECT DISTINCT key, parent_key FROM a) p ON p.key = s.parent_key WHERE (s.level = 2 AND cos >= 0.16) OR (s.level = 3 AND cos >= 0.24) QUALIFY row_number() OVER (PARTITION BY s.vec_id ORDER BY cos DESC, s.level, s.ord) = 1),
 r AS (SELECT m.vec_id, CASE WHEN s1 >= 0.10 THEN CASE WHEN s2 >= 0.16 AND s3 >= 0.24 THEN 'ASSIGNED' ELSE 'PARTIAL' END WHEN f.key IS NOT NULL THEN 'FALLBACK' ELSE 'UNKNOWN' END AS status,
   (CASE WHEN s1 >= 0.10 THEN CASE WHEN s2 >= 0.16 AND s3 >= 0.24 THEN 3 WHEN s2 >= 0.16 THEN 2 ELSE 1 END WHEN f.key IS NOT NULL THEN f.level ELSE 0 END)::INTEGER AS depth,
   CASE WHEN s1 >= 0.10 THEN CASE WHEN s2 >= 0.16 AND s3 >= 0.24 THEN k1 || ' > ' || k2 || ' > ' || k3 WHEN s2 >= 0.16 THEN k1 || ' > ' || k2 ELSE k1 END WHEN f.level = 2 THEN f.parent_key || ' > ' || f.key WHEN f.level = 3 THEN f.grand || ' > ' || f.parent_key || ' > ' || f.key ELSE '' END AS path,
   k3 AS best_leaf, s1 AS l1_score, s2 AS l2_score, s3 AS l3_score FROM m LEFT JOIN f ON f.vec_id = m.vec_id)"""


def _anchors(spark, d):
    e = read(spark, d, "embeddings")
    parts = []
    for level, width, above in ((1, 4, None), (2, 2, 4), (3, 1, 2)):
        # the parent's number follows from the child's, as widths divide each other
        c = vectors.centroids(e.select(F.floor(F.col("label") / width).cast("long").alias("g"), "embedding"), "g")
        parent = F.concat(F.lit(f"L{level - 1}-"), F.floor(F.col("g") * width / above).cast("string")) if above else F.lit(None).cast("string")
        parts.append(c.select((F.col("g") + 100 * (level - 1)).cast("int").alias("ord"), F.lit(level).alias("level"), F.concat(F.lit(f"L{level}-"), F.col("g").cast("string")).alias("key"), parent.alias("parent_key"), F.col("centroid").alias("vec")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _classified(spark, d):
    return taxonomy.classify(read(spark, d, "embeddings"), _anchors(spark, d), GATES)


@query(f"WITH {_TREE} SELECT * FROM r")
def classify_status(spark, d):
    """Status, depth, path and scores of each row in a three-level tree, with fallback."""
    return _classified(spark, d)


@query(f"WITH {_TREE} SELECT vec_id, k1, k2, k3, s3 FROM m")
def hier_match(spark, d):
    """The best leaf and its ancestors."""
    path = _classified(spark, d).select("vec_id", "best_leaf", F.col("l3_score").alias("s3"))
    n = F.substring("best_leaf", 4, 10).cast("int")
    return path.select("vec_id", F.concat(F.lit("L1-"), F.floor(n / 4).cast("string")).alias("k1"), F.concat(F.lit("L2-"), F.floor(n / 2).cast("string")).alias("k2"), F.col("best_leaf").alias("k3"), "s3")


@query(f"WITH {_TREE} SELECT s.status, count(r.status) AS n FROM (VALUES ('ASSIGNED'), ('PARTIAL'), ('FALLBACK'), ('UNKNOWN')) s(status) LEFT JOIN r ON r.status = s.status GROUP BY s.status")
def status_histogram(spark, d):
    """Rows by status."""
    return taxonomy.histogram(_classified(spark, d))


@query(f"WITH {_TREE} SELECT (CASE WHEN NOT l1_score >= 0.10 THEN 1 WHEN NOT l2_score >= 0.16 THEN 2 ELSE 3 END)::INTEGER AS level, count(*) AS n FROM r WHERE NOT (l1_score >= 0.10 AND l2_score >= 0.16 AND l3_score >= 0.24) GROUP BY level")
def unassigned_pools(spark, d):
    """Rows by the first level that fails."""
    return taxonomy.pools(_classified(spark, d), GATES).groupBy("level").agg(F.count("*").alias("n"))


@query(f"WITH {_TREE} SELECT count(*) AS n, count(*) FILTER (WHERE l1_score >= 0.10 AND l2_score >= 0.16 AND l3_score >= 0.24) AS assigned, count(*) FILTER (WHERE status = 'FALLBACK') AS fallback FROM r")
def assigned_counts(spark, d):
    """Rows in all, assigned on all levels, and by fallback."""
    c = F.col
    return _classified(spark, d).agg(F.count("*").alias("n"), F.count_if((c("l1_score") >= GATES[0]) & (c("l2_score") >= GATES[1]) & (c("l3_score") >= GATES[2])).alias("assigned"), F.count_if(c("status") == "FALLBACK").alias("fallback"))


@query(f"WITH {_TREE} SELECT round(least(greatest(quantile_cont(l1_score, 0.3), 0.15), 0.80), 6) AS l1, round(least(greatest(quantile_cont(l2_score, 0.3), 0.15), 0.80), 6) AS l2, round(least(greatest(quantile_cont(l3_score, 0.3), 0.15), 0.80), 6) AS l3 FROM r")
def threshold_p30(spark, d):
    """Clamped 30th percentiles of the levels' scores."""
    clamp = lambda c: F.round(F.least(F.greatest(F.percentile(c, F.lit(thresholds.PERCENTILE)), F.lit(thresholds.LOW)), F.lit(thresholds.HIGH)), 6)
    return _classified(spark, d).agg(*(clamp(f"l{i}_score").alias(f"l{i}") for i in (1, 2, 3)))


@query()
def threshold_fit(spark, d):
    """Thresholds by mixtures with guards; tests check the guards."""
    rows = written(_classified(spark, d).select("l1_score", "l2_score", "l3_score"), "scores")
    found = [(i, thresholds.fit(rows.select(F.col(f"l{i}_score").alias("score")))) for i in (1, 2, 3)]
    return spark.createDataFrame([(i, f["value"], f["method"], f["reason"], f["n"]) for i, f in found], "level int, value double, method string, reason string, n long")


@query()
def discovered_clusters(spark, d):
    """Clusters among rows that fail a level, by level and node above, of most mass; tests hold these against the definition."""
    rows = written(taxonomy.unassigned(_classified(spark, d), written(_anchors(spark, d).drop("vec"), "tree"), GATES).select("vec_id", "pool"), "unassigned")
    return discovery.mass_clusters(rows.join(read(spark, d, "embeddings"), "vec_id").select("pool", "vec_id", "embedding"), "pool")


@query(f"WITH {_TREE}, u AS (SELECT (CASE WHEN NOT l1_score >= 0.10 THEN 1 WHEN NOT l2_score >= 0.16 THEN 2 ELSE 3 END)::INTEGER AS level, m.k1, m.k2 FROM r JOIN m USING (vec_id) WHERE NOT (l1_score >= 0.10 AND l2_score >= 0.16 AND l3_score >= 0.24)) SELECT level, parent_key, count(*) AS n FROM (SELECT level, CASE level WHEN 2 THEN k1 WHEN 3 THEN k2 END AS parent_key FROM u) GROUP BY level, parent_key")
def unassigned_by_parent(spark, d):
    """Rows that fail a level, by the first that does and the node of their path above it."""
    rows = taxonomy.unassigned(_classified(spark, d), _anchors(spark, d).drop("vec"), GATES)
    return rows.groupBy("level", "parent_key").agg(F.count("*").alias("n"))


@query(r"WITH c AS (SELECT label::INTEGER AS label, term, count(*) AS n FROM (SELECT label, unnest(regexp_extract_all(lower(text), '\p{L}{3,}')) AS term FROM documents JOIN embeddings ON vec_id = doc_id) GROUP BY ALL), f AS (SELECT term, sum(n) AS f FROM c GROUP BY term), a AS (SELECT sum(n) / count(DISTINCT label) AS a FROM c) SELECT label, term, n, round(n * ln(1 + a / f), 6) AS score, row_number() OVER (PARTITION BY label ORDER BY round(n * ln(1 + a / f), 6) DESC, term)::INTEGER AS rank FROM c JOIN f USING (term), a QUALIFY rank <= 5")
def cluster_terms(spark, d):
    """The terms that mark the documents of each label, from which clusters get their names."""
    rows = read(spark, d, "documents").join(read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").cast("int").alias("label")), "doc_id")
    return rounds.class_terms(rows, "label", "text", 5)


@query()
def discovery_rounds(spark, d):
    """Measures of a tree before and after rounds that cluster, name and graft what it doesn't take; tests have a planted tree."""
    rows = read(spark, d, "embeddings").join(read(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text"), "vec_id", "left")
    nodes = _nodes(spark, d).join(_anchors(spark, d).select("key", "vec"), "key").where("key <> 'L3-9' AND key <> 'L3-4'")
    made = rounds.discover(rows, nodes, GATES, 2)
    out = None
    for version, r in enumerate(made, 1):
        part = r.measures.select(F.lit(version).alias("version"), "measure", "value")
        out = part if out is None else out.unionByName(part)
    return out


def _nodes(spark, d):
    """The rows of a tree whose leaves are the labels of the vectors."""
    labels = read(spark, d, "embeddings").select("label").distinct()
    parts = []
    for level, width, above in ((1, 4, None), (2, 2, 4), (3, 1, 2)):
        g = labels.select(F.floor(F.col("label") / width).cast("int").alias("place")).distinct()
        parent = F.concat(F.lit(f"L{level - 1}-"), F.floor(F.col("place") * width / above).cast("string")) if above else F.lit(None).cast("string")
        key = F.concat(F.lit(f"L{level}-"), F.col("place").cast("string"))
        parts.append(g.select(key.alias("key"), parent.alias("parent_key"), "place", F.concat(F.lit("Node "), key).alias("name"), F.lit("of labels").alias("description"), F.when(F.col("place") % 3 == 0, "discovered").otherwise("seed").alias("source")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_NODES = """RECURSIVE l AS (SELECT DISTINCT label::INTEGER AS label FROM embeddings),
 n AS (SELECT DISTINCT 'L1-' || (label // 4) AS key, NULL AS parent_key, label // 4 AS place, 1 AS level FROM l UNION SELECT 'L2-' || (label // 2), 'L1-' || (label // 4), label // 2, 2 FROM l UNION SELECT 'L3-' || label, 'L2-' || (label // 2), label, 3 FROM l),
 t AS (SELECT key, place, level, [place] AS path, 'Node ' || key AS crumb, [key] AS keys FROM n WHERE parent_key IS NULL UNION ALL SELECT n.key, n.place, n.level, list_append(path, n.place), crumb || ' > Node ' || n.key, list_append(keys, n.key) FROM t JOIN n ON n.parent_key = t.key),
 o AS (SELECT *, (row_number() OVER (ORDER BY path) - 1)::INTEGER AS ord FROM t)"""


@query(f"WITH {_NODES} SELECT level::INTEGER AS level, count(*) AS n FROM o GROUP BY level")
def taxonomy_nodes(spark, d):
    """Nodes by level of a tree without faults."""
    nodes = written(_nodes(spark, d), "nodes")
    return trees.flat(nodes).join(trees.faults(nodes), "key", "left_anti").groupBy("level").agg(F.count("*").alias("n"))


@query(f"WITH {_NODES} SELECT ord, key, level::INTEGER AS level, crumb AS breadcrumb, (SELECT count(*) - 1 FROM t x WHERE list_contains(x.keys, o.key)) AS n_below FROM o")
def tree_order(spark, d):
    """The nodes of a tree in depth-first order, with their paths and the sizes of their subtrees."""
    return trees.flat(written(_nodes(spark, d), "nodes")).select("ord", "key", "level", "breadcrumb", "n_below")


@query(f"WITH {_NODES} SELECT level::INTEGER AS level, CASE WHEN place % 3 = 0 THEN 'discovered' ELSE 'seed' END AS source, count(*) AS n FROM o GROUP BY ALL")
def nodes_by_source(spark, d):
    """Nodes by level and source."""
    return trees.counts(trees.flat(written(_nodes(spark, d), "nodes")))


@query(f"WITH {_NODES}, m AS (SELECT key, keys, coalesce(n, 0) AS n FROM o LEFT JOIN (SELECT 'L3-' || label AS key, count(*) AS n FROM embeddings GROUP BY 1) USING (key)) SELECT a.key, sum(b.n)::BIGINT AS n FROM m a JOIN m b ON list_contains(b.keys, a.key) GROUP BY a.key")
def rows_below(spark, d):
    """Rows that have a node's label or one below it, of every node."""
    rows = read(spark, d, "embeddings").select(F.concat(F.lit("L3-"), F.col("label").cast("string")).alias("best_leaf"))
    return trees.matched_below(written(trees.flat(written(_nodes(spark, d), "nodes")), "tree"), rows)


@query(_HITS + "SELECT category, count(*) AS n, round(avg((coalesce(r, 99) <= 1)::INT), 6) AS hit_1, round(avg((coalesce(r, 99) <= 3)::INT), 6) AS hit_3, round(avg((coalesce(r, 99) <= 5)::INT), 6) AS hit_5, round(avg(coalesce(1.0 / r, 0)), 6) AS mrr FROM (SELECT vec_id AS q, label::BIGINT AS category FROM embeddings WHERE vec_id % 20 = 0) LEFT JOIN (SELECT query_id, min(rank) AS r FROM h WHERE ql = vl GROUP BY query_id) ON query_id = q GROUP BY ROLLUP (category)")
def eval_hits_mrr(spark, d):
    """Hit rates and mean reciprocal rank where rows of the query's label are relevant."""
    e = read(spark, d, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"))
    queries = e.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("label").alias("category"))
    hits = _hits(spark, d).join(e, "vec_id").join(queries, "query_id")  # at most ten rows a query
    truth = hits.where("label = category").select("query_id", "vec_id")
    return evaluation.quality(evaluation.first_hits(hits, truth, queries, "vec_id"), "category")


@query(_HITS + "SELECT query_id AS vec_id, vec_id AS nearest, round((1 + cos) / 2, 6) AS similarity, CASE WHEN round((1 + cos) / 2, 6) < 0.9 THEN 'insert' WHEN round((1 + cos) / 2, 6) >= 0.98 THEN 'skip' ELSE 'update' END AS decision FROM h WHERE rank = 1")
def memory_dedup_top1(spark, d):
    """What to do with new memories, by their nearest old one."""
    s = F.round(memory.sim01(F.col("cos")), 6)
    return _hits(spark, d, 1).select(F.col("query_id").alias("vec_id"), F.col("vec_id").alias("nearest"), s.alias("similarity"), memory.decision(s).alias("decision"))


@query("SELECT vec_id, label, CASE WHEN vec_id % 4 = 0 THEN 2 ELSE 1 END::INTEGER AS version FROM embeddings")
def vector_upsert(spark, d):
    """The latest row of each key."""
    e = read(spark, d, "embeddings").withColumn("version", F.lit(1))
    return corpus.upsert(e, e.where("vec_id % 4 = 0").withColumn("version", F.lit(2)), "vec_id", "version").select("vec_id", "label", "version")


@query("SELECT count(*) AS n, max(len(embedding))::INTEGER AS dimension, count(DISTINCT label) AS labels FROM embeddings")
def collection_stats(spark, d):
    """Rows, dimension and labels of a collection."""
    return read(spark, d, "embeddings").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dimension"), F.countDistinct("label").alias("labels"))


@query("SELECT item_id, count(d.doc_id) AS n FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id AND contains(lower(d.text), 'the') GROUP BY item_id")
def ground_truth(spark, d):
    """Evaluation items resolved to documents whose text has the evidence."""
    docs = read(spark, d, "documents").where(F.contains(F.lower("text"), F.lit("the"))).select(F.col("doc_id").alias("item_id"), F.lit(1).alias("hit"))
    return read(spark, d, "benchmark").join(docs, "item_id", "left").groupBy("item_id").agg(F.count("hit").alias("n"))


@query("SELECT doc_id, 0::INTEGER AS chunk_index, CAST(NULL AS VARCHAR) AS heading, length(trim(text, ' ' || chr(9) || chr(10) || chr(13)))::INTEGER AS n FROM documents WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '' AND NOT regexp_matches(text, '(^|\\n)#{1,6}\\s+\\S')")
def chunk_simple(spark, d):
    """Simple chunks of all documents; those without headings are one, and only these are in the SQL."""
    rows = chunking.chunk_simply(read(spark, d, "documents"))
    return rows.select("doc_id", "chunk_index", "heading", F.length("content").alias("n"))


@query()
def chunk_rich(spark, d):
    """Rich chunks; SQL can't express the packing, tests check slices, bounds and overlaps."""
    return chunking.chunk_documents(read(spark, d, "documents"))
