"""Queries over stores, memories, evaluation truth and names, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import encoders, text
from ..operators import corpus, evaluation, memory, patterns, store
from .relational import query, read
from .semantic import _HITS, _TREE, _V, EVERY, _classified, _hits


@query("SELECT lower(regexp_extract(string_split(url, '/')[-1], '(\\.[^.]*)$', 1)) AS suffix, count(*) AS n FROM pages GROUP BY 1")
def extension_counts(spark, d):
    """Files by suffix."""
    return corpus.suffix_counts(read(spark, d, "pages"), "url")


@query("SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN NULLIF(CASE WHEN vec_id % 8 = 0 THEN 'new' ELSE '' END, '') ELSE 'old' END AS heading FROM embeddings")
def none_round_trip(spark, d):
    """New rows win over old ones of equal version; headings that are null are stored blank and read back as null."""
    e = read(spark, d, "embeddings").select("vec_id", "embedding", F.lit(1).alias("version"))
    old = e.withColumn("heading", F.lit("old"))
    new = e.where("vec_id % 4 = 0").withColumn("heading", F.when(F.col("vec_id") % 8 == 0, "new"))
    return corpus.unblanked(corpus.upsert(old, new, "vec_id", "version", blank=("heading",)), "heading").select("vec_id", "heading")


@query("WITH s AS (SELECT text, min(doc_id) AS stored FROM documents WHERE doc_id % 3 = 0 GROUP BY text), b AS (SELECT doc_id, text, min(doc_id) OVER (PARTITION BY text) AS first FROM documents WHERE doc_id % 3 <> 0) SELECT doc_id, CASE WHEN stored IS NOT NULL THEN 'in_store' WHEN first < doc_id THEN 'in_batch' ELSE 'new' END AS outcome, coalesce(stored, first) AS kept FROM b LEFT JOIN s ON s.text = b.text")
def import_outcomes(spark, d):
    """What an import does with each file: already stored, a copy in the batch, or new."""
    rows = read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return store.import_outcomes(rows.where("doc_id % 3 = 0"), rows.where("doc_id % 3 <> 0"))


@query("WITH h AS (SELECT sha256(text) AS cache_key, doc_id FROM documents), o AS (SELECT cache_key, min(doc_id) AS doc_id FROM h WHERE doc_id % 3 = 0 GROUP BY 1) SELECT cache_key, doc_id FROM o UNION ALL SELECT cache_key, min(doc_id) FROM h WHERE doc_id % 3 <> 0 AND cache_key NOT IN (SELECT cache_key FROM o) GROUP BY 1")
def cache_first_write(spark, d):
    """A cache into which all rows are put: the first write of a key stays."""
    h = read(spark, d, "documents").select(F.sha2("text", 256).alias("cache_key"), "doc_id")
    old = h.where("doc_id % 3 = 0").groupBy("cache_key").agg(F.min("doc_id").alias("doc_id"))
    return store.insert_or_ignore(old, h.where("doc_id % 3 <> 0"), "cache_key", "doc_id")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) FILTER (WHERE value IS NOT NULL AND event_type <> 'view') AS value, min(ts) AS created_at, max(ts) AS updated_at, count(*) AS n_events FROM events GROUP BY user_id")
def latest_state(spark, d):
    """The state of each user that the log leaves; views don't change the value."""
    e = read(spark, d, "events").withColumn("value", F.when(F.col("event_type") != "view", F.col("value")))
    return store.latest_state(e, "user_id", ["ts", "event_id"], ["event_type", "value"], "ts")


@query("SELECT user_id, n, done, retry, failed, CASE WHEN retry > 0 THEN 'running' WHEN failed = 0 THEN 'done' WHEN done = 0 THEN 'failed' ELSE 'partial' END AS state FROM (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type <> 'error') AS done, count(*) FILTER (WHERE event_type = 'error' AND event_id % 20 < 1) AS retry, count(*) FILTER (WHERE event_type = 'error' AND event_id % 20 >= 1) AS failed FROM events GROUP BY user_id)")
def batch_states(spark, d):
    """Tasks by the attempts and failures of their files."""
    attempt = F.when(F.col("event_id") % 20 < 1, 1).otherwise(3)
    return store.batch_states(read(spark, d, "events"), "user_id", attempt, F.col("event_type") == "error")


_MEMORY = f"""WITH {_V}, m AS (SELECT doc_id AS vec_id, text, CASE WHEN doc_id % 7 = 0 THEN 'deprecated' ELSE 'active' END AS status FROM documents WHERE doc_id % 11 <> 0),
 s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.e, v.e), 6) AS cos FROM v q JOIN v ON q.vec_id % {EVERY} = 0 AND q.vec_id <> v.vec_id AND q.label = v.label),
 t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, vec_id)::INTEGER AS rank FROM s QUALIFY rank <= 5),
 r AS (SELECT query_id, t.vec_id, cos, rank FROM t JOIN m ON m.vec_id = t.vec_id AND m.status = 'active')"""


def _memories(spark, d):
    status = F.when(F.col("doc_id") % 7 == 0, "deprecated").otherwise("active")
    return read(spark, d, "documents").where("doc_id % 11 <> 0").select(F.col("doc_id").alias("vec_id"), "text", status.alias("status"))


def _recalled(spark, d):
    e = read(spark, d, "embeddings").withColumnRenamed("label", "scope")
    queries = e.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), "scope", F.col("embedding").alias("asked"))
    return memory.recall(e, queries, _memories(spark, d), 5)


@query(_MEMORY + " SELECT query_id, vec_id, cos, rank FROM r")
def memory_recall(spark, d):
    """Active memories of a user nearest to a query: scope first, status by the table of memories."""
    return _recalled(spark, d)


@query(_MEMORY + """, k AS (SELECT query_id, string_agg('- ' || text, chr(10) ORDER BY rank) AS known FROM r JOIN m USING (vec_id) GROUP BY query_id),
 c AS (SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS said FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3) GROUP BY conv_id)
 SELECT conv_id, sha256(coalesce(known, '') || chr(10) || chr(10) || said) AS prompt_hash FROM c LEFT JOIN k ON k.query_id = conv_id""")
def chat_turn(spark, d):
    """What a chat turn is answered from: recalled memories and the last turns, as hashes."""
    found = memory.prompt(_recalled(spark, d), _memories(spark, d), read(spark, d, "conversations"), 3)
    return found.select("conv_id", F.sha2("prompt", 256).alias("prompt_hash"))


@query(_HITS + """, n AS (SELECT query_id AS vec_id, vec_id AS nearest, CASE WHEN round((1 + cos) / 2, 6) < 0.70 THEN 'insert' WHEN round((1 + cos) / 2, 6) >= 0.80 THEN 'skip' ELSE 'update' END AS decision FROM h WHERE rank = 1)
 SELECT vec_id, CASE WHEN vec_id IN (SELECT nearest FROM n WHERE decision = 'update') THEN 'deprecated' ELSE 'active' END AS status FROM v WHERE vec_id NOT IN (SELECT vec_id FROM n) UNION ALL SELECT vec_id, 'active' FROM n WHERE decision <> 'skip'""")
def memory_apply(spark, d):
    """The table of memories after decisions on new ones: inserted, skipped, or in place of the one they update."""
    s = F.round(memory.sim01(F.col("cos")), 6)
    made = _hits(spark, d, 1).select(F.col("query_id").alias("vec_id"), F.col("vec_id").alias("nearest"), memory.decision(s, 0.70, 0.80).alias("decision"))
    return memory.applied(read(spark, d, "embeddings").select("vec_id", F.lit("active").alias("status")), made)


_TRUTH = """WITH q AS (SELECT CAST(item_id AS VARCHAR) AS id, item_id, 'src' || (item_id % 5) AS doc, string_split(text, ' ')[1] AS heading FROM benchmark),
 c AS (SELECT doc_id, source, lang, text FROM documents),
 t AS (SELECT id, doc_id FROM q JOIN c ON c.doc_id = item_id AND item_id % 3 = 0
   UNION SELECT id, doc_id FROM q JOIN c ON c.source = doc AND item_id % 3 = 1 AND (contains(lang, heading) OR contains(text, heading))
   UNION SELECT id, doc_id FROM q JOIN c ON item_id % 3 = 2 AND ((c.source = doc AND lang = 'en') OR (c.source = 'src1' AND contains(text, heading))))"""


def _truth(spark, d):
    b = read(spark, d, "benchmark").select("*", F.element_at(F.split("text", " "), 1).alias("_w"), F.concat(F.lit("src"), F.col("item_id") % 5).alias("_d"))
    kind = F.col("item_id") % 3
    pair = lambda doc, heading: F.struct(doc.alias("document_id"), heading.alias("heading"))
    queries = b.select(
        F.col("item_id").cast("string").alias("id"),
        F.when(kind == 0, F.array(F.col("item_id"))).otherwise(F.array().cast("array<bigint>")).alias("chunk_ids"),
        F.when(kind == 1, F.col("_d")).alias("document_id"), F.when(kind == 1, F.col("_w")).alias("heading"),
        F.when(kind == 2, F.array(pair(F.col("_d"), F.lit("en")), pair(F.lit("src1"), F.col("_w")))).alias("acceptable"),
    )
    chunks = read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), F.col("lang").alias("heading"), F.col("text").alias("content"))
    return queries, store.expected_chunks(chunks, queries)


@query(_TRUTH.replace("lang = 'en')", "(lang = 'en' OR contains(text, 'en') OR contains(lang, 'en')))") + " SELECT id, doc_id AS chunk_id FROM t")
def truth_chunks(spark, d):
    """The chunks that answer each evaluation query, by three rules."""
    return _truth(spark, d)[1]


@query(_TRUTH.replace("lang = 'en')", "(lang = 'en' OR contains(text, 'en') OR contains(lang, 'en')))") + " SELECT q.id, min(r)::INTEGER AS rank FROM q LEFT JOIN (SELECT id, 1 + doc_id % 9 AS r FROM t) x ON x.id = q.id GROUP BY q.id HAVING min(r) IS NULL OR min(r) > 1")
def miss_report(spark, d):
    """Queries without a right hit at rank 1."""
    queries, truth = _truth(spark, d)
    return store.misses(queries.select("id"), truth.select("id", (1 + F.col("chunk_id") % 9).cast("int").alias("rank")), 1)


@query(f"WITH {_TREE} SELECT k1 AS l1, count(*) AS n FROM m GROUP BY k1")
def best_l1(spark, d):
    """Rows by the first level of their best leaf, whatever the gates say."""
    n = F.substring("best_leaf", 4, 10).cast("int")
    return _classified(spark, d).groupBy(F.concat(F.lit("L1-"), F.floor(n / 4).cast("string")).alias("l1")).agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents ORDER BY md5('seed' || doc_id), doc_id LIMIT 50")
def uniform_sample(spark, d):
    """Fifty rows by a seeded hash."""
    return corpus.uniform_sample(read(spark, d, "documents"), 50, "doc_id").select("doc_id")


@query("SELECT * FROM (SELECT (row_number() OVER (ORDER BY url) - 1)::BIGINT AS doc_index, url FROM (SELECT DISTINCT url FROM pages)) WHERE doc_index < 50")
def prefix_scope(spark, d):
    """The first fifty rows of a manifest."""
    return corpus.manifest(read(spark, d, "pages"), "url").where("doc_index < 50")


_FILE = "CASE page_id % 5 WHEN 0 THEN '' ELSE 'a/' END || 'f' || page_id || CASE page_id % 4 WHEN 0 THEN '.TXT' WHEN 1 THEN '.md' WHEN 2 THEN '.exe' ELSE '' END"


def _files(spark, d):
    c = F.col("page_id")
    name = F.concat(F.when(c % 5 == 0, "").otherwise("a/"), F.lit("f"), c, F.element_at(F.array(*map(F.lit, (".TXT", ".md", ".exe", ""))), (c % 4 + 1).cast("int")))
    return read(spark, d, "pages").select("page_id", name.alias("path"), "html")


@query(f"SELECT page_id, path FROM (SELECT page_id, {_FILE} AS path, html FROM pages) WHERE lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ('txt', 'md') AND octet_length(encode(html)) >= 200 AND contains(path, '/')")
def corpus_scan(spark, d):
    """Files of a corpus: wanted types, not tiny, not at the root."""
    return corpus.candidates(_files(spark, d).withColumn("size", F.octet_length("html")), "path", "size", ["txt", "md"]).select("page_id", "path")


@query(f"SELECT page_id, CASE WHEN page_id % 13 = 0 THEN 'UNSAFE_PATH' WHEN lower(regexp_extract(path, '\\.([^./]+)$', 1)) NOT IN ('txt', 'md') THEN 'UNSUPPORTED_TYPE' WHEN octet_length(encode(html)) = 0 THEN 'EMPTY_FILE' WHEN octet_length(encode(html)) > 8000 THEN 'FILE_TOO_LARGE' WHEN page_id % 7 = 0 THEN 'HASH_MISMATCH' END AS code FROM (SELECT page_id, {_FILE} AS path, html FROM pages)")
def manifest_files(spark, d):
    """Why files of a manifest can't be loaded, their digest among the reasons."""
    f = _files(spark, d).withColumn("digest", F.when(F.col("page_id") % 7 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.sha2("html", 256)))
    f = f.withColumn("path", F.when(F.col("page_id") % 13 == 0, F.concat(F.lit("x/../"), "path")).otherwise(F.col("path")))
    return f.select("page_id", corpus.verified_files(f, "path", "html", "digest", ["txt", "md"], 8000).alias("code"))


@query(f"SELECT page_id, '/out/' || regexp_replace(path, '\\.[^./]*$', '') || '.yaml' AS mirrored, '/out/' || regexp_replace(string_split(path, '/')[-1], '\\.[^./]*$', '') || '.yaml' AS flat, path AS safe FROM (SELECT page_id, {_FILE} AS path FROM pages)")
def output_paths(spark, d):
    """Places of converted files, mirrored and flat; and paths without parts that lead elsewhere."""
    f = _files(spark, d)
    return f.select("page_id", text.output_path(F.col("path"), "/out/", ".yaml").alias("mirrored"), text.output_path(F.col("path"), "/out", ".yaml", True).alias("flat"), text.safe_path(F.concat(F.lit("..//./"), "path")).alias("safe"))


@query("SELECT doc_id, sha256(trim(string_split(t, chr(10))[1])) AS title, sha256(trim(substr(t, 1 + length(string_split(t, chr(10))[1])), ' ' || chr(9) || chr(10))) AS body FROM (SELECT doc_id, ltrim(replace(replace(replace(text, chr(10), chr(13) || chr(10)), chr(13) || chr(10), chr(10)), chr(13), chr(10)), ' ' || chr(9) || chr(10)) AS t FROM documents)")
def title_body(spark, d):
    """Titles and bodies of documents with Windows line ends, as hashes."""
    title, body = text.title_and_body(F.replace("text", F.lit("\n"), F.lit("\r\n")))
    return read(spark, d, "documents").select("doc_id", F.sha2(title, 256).alias("title"), F.sha2(body, 256).alias("body"))


@query("SELECT doc_id, sha256(source || chr(10) || coalesce(NULLIF(lang, 'en'), '') || chr(10) || text) AS h FROM documents")
def embed_text_plain(spark, d):
    """Texts given to the pipeline's encoder, which repeat the title; as hashes."""
    return read(spark, d, "documents").select("doc_id", F.sha2(text.plain_embedding_text(F.col("source"), F.nullif(F.col("lang"), F.lit("en")), F.col("text")), 256).alias("h"))


@query("SELECT sha256(string_agg(r_name || ' > ' || n_name || ': ' || n_nationkey, chr(10) ORDER BY n_nationkey)) AS fingerprint, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey")
def anchor_fingerprint(spark, d):
    """The digest of a tree's anchor texts in their order; a tree is small."""
    t = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    anchor = text.anchor_text(F.array("r_name", "n_name"), F.col("n_nationkey").cast("string"))
    rows = t.agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", anchor.alias("a")))), lambda x: x["a"]).alias("a"))
    return rows.select(text.fingerprint(F.col("a")).alias("fingerprint"), F.size("a").cast("long").alias("n"))


@query("SELECT sha256(string_agg(url, chr(10) ORDER BY url)) AS fingerprint FROM (SELECT DISTINCT url FROM pages ORDER BY url LIMIT 50)")
def manifest_fingerprint(spark, d):
    """The digest of a manifest's first fifty paths."""
    rows = corpus.manifest(read(spark, d, "pages"), "url").where("doc_index < 50").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_index", "url"))), lambda x: x["url"]).alias("a"))
    return rows.select(text.fingerprint(F.col("a")).alias("fingerprint"))


@query("SELECT p_partkey, coalesce(NULLIF(regexp_replace(regexp_replace(lower(p_name || '--' || p_partkey || '!'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'topic') AS key, CASE WHEN p_partkey >= 0 THEN 'topic' END AS none FROM part")
def snake_keys(spark, d):
    """Keys made of names."""
    return read(spark, d, "part").select("p_partkey", text.snake_key(F.concat("p_name", F.lit("--"), "p_partkey", F.lit("!"))).alias("key"), text.snake_key(F.lit(" !? ")).alias("none"))


@query("SELECT source, printf('%+.2f', a - b) AS change FROM (SELECT source, count(*) FILTER (WHERE lang = 'en') * 100.0 / count(*) AS a, count(*) FILTER (WHERE lang = 'de') * 100.0 / count(*) AS b FROM documents GROUP BY source)")
def deltas(spark, d):
    """Changes with a sign."""
    share = lambda lang: F.count_if(F.col("lang") == lang) * 100.0 / F.count("*")
    rows = read(spark, d, "documents").groupBy("source").agg(share("en").alias("a"), share("de").alias("b"))
    return rows.select("source", text.delta(F.col("a"), F.col("b")).alias("change"))


@query("SELECT CASE WHEN lang <> 'en' THEN lang END AS l1, CASE WHEN lang <> 'en' THEN source END AS l2, count(*) AS n FROM documents GROUP BY ALL")
def null_groups(spark, d):
    """Counts by levels, rows without a category among them."""
    known = F.col("lang") != "en"
    return read(spark, d, "documents").groupBy(F.when(known, F.col("lang")).alias("l1"), F.when(known, F.col("source")).alias("l2")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25 OFFSET 25")
def recent_documents(spark, d):
    """The second page of a listing, latest first, ties by id."""
    return corpus.page(read(spark, d, "documents").select("doc_id", "n_chars"), [F.desc("n_chars"), "doc_id"], 2, 25)


@query("SELECT vec_id // 64 AS shard, least(64, (SELECT count(*) FROM embeddings) - 64 * (vec_id // 64)) AS wanted, count(*) FILTER (WHERE vec_id % 100 <> 0) AS found FROM embeddings GROUP BY 1, 2 HAVING count(*) FILTER (WHERE vec_id % 100 <> 0) < least(64, (SELECT count(*) FROM embeddings) - 64 * (vec_id // 64))")
def shard_gaps(spark, d):
    """Shards that lack rows."""
    e = read(spark, d, "embeddings").select("vec_id")
    return store.shard_gaps(e.where("vec_id % 100 <> 0"), "vec_id", e.count(), 64)


@query("SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_tokens, CAST(sum(n * n) AS BIGINT) AS squares FROM (SELECT doc_id, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 128 AS place, count(*) AS n FROM (SELECT doc_id, unnest(list_concat(regexp_extract_all(lower(text), '[^\\s]+'), list_transform(range(1, length(text)), lambda i: substr(lower(text), i, 2)))) AS t FROM documents) GROUP BY ALL) GROUP BY doc_id")
def hashing_embedding(spark, d):
    """Hashed counts of words and character pairs: their sums and squares."""
    rows = encoders.hashed_counts(read(spark, d, "documents"), "doc_id", "text")
    total = lambda f: F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + f(x))
    return rows.select("doc_id", total(lambda x: x).alias("n_tokens"), total(lambda x: x * x).alias("squares"))


@query("SELECT item_id, doc_id, first FROM (SELECT item_id, doc_id, (strpos(d.text, substr(b.text, 1, 40)) - 1)::BIGINT AS first FROM benchmark b, documents d) WHERE first >= 0")
def passages_found(spark, d):
    """Where the beginnings of all benchmark texts stand in documents, by one automaton."""
    beginnings = read(spark, d, "benchmark").select(F.col("item_id").alias("name"), F.substring("text", 1, 40).alias("pattern"))
    return patterns.found(read(spark, d, "documents"), beginnings, "doc_id", F.col("text")).select(F.col("name").alias("item_id"), "doc_id", "first")


_SET = """q AS (SELECT CAST(item_id - item_id % 10 // 9 AS VARCHAR) AS id, text AS query, CASE item_id % 7 WHEN 0 THEN 'odd' ELSE 'direct' END AS category, CAST(item_id AS VARCHAR) AS doc, 'src' || (item_id % 20) AS path, substr(text, 1, 9) AS heading, ['the', substr(text, 1, 14)] AS evidence FROM benchmark),
 d AS (SELECT CAST(doc_id AS VARCHAR) AS doc, source, text FROM documents), m AS (SELECT q.*, d.doc AS there, d.source, d.text FROM q LEFT JOIN d USING (doc))"""


@query(f"""WITH {_SET} SELECT DISTINCT id, problem, what FROM (SELECT id, 'repeated id' AS problem, id AS what FROM q WHERE id IN (SELECT id FROM q GROUP BY id HAVING count(*) > 1)
 UNION ALL SELECT id, 'repeated query', query FROM q WHERE query IN (SELECT query FROM q GROUP BY query HAVING count(*) > 1) UNION ALL SELECT id, 'unknown category', category FROM q WHERE category = 'odd'
 UNION ALL SELECT id, 'missing document', doc FROM m WHERE there IS NULL UNION ALL SELECT id, 'other source path', path FROM m WHERE there IS NOT NULL AND source <> path
 UNION ALL SELECT id, 'heading not in document', heading FROM m WHERE there IS NOT NULL AND NOT contains(text, heading) UNION ALL SELECT id, 'evidence not in document', e FROM (SELECT id, text, unnest(evidence) AS e FROM m WHERE there IS NOT NULL) WHERE NOT contains(text, e))""")
def evaluation_problems(spark, d):
    """What is wrong with benchmark items taken as evaluation queries for the documents of their numbers."""
    number = F.col("item_id")
    asked = read(spark, d, "benchmark").select(
        (number - F.floor(number % 10 / 9)).cast("string").alias("id"), F.col("text").alias("query"), F.when(number % 7 == 0, "odd").otherwise("direct").alias("category"), F.lit("easy").alias("difficulty"), number.cast("string").alias("expected_document_id"),
        F.concat(F.lit("src"), (number % 20).cast("string")).alias("expected_source_path"), F.substring("text", 1, 9).alias("expected_heading"), F.array(F.lit("the"), F.substring("text", 1, 14)).alias("expected_evidence"), F.lit(None).cast("array<struct<document_id:string,heading:string>>").alias("acceptable_documents"),
    )
    docs = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.col("source").alias("source_path"), F.col("text").alias("content"))
    return evaluation.problems(asked, docs, ["direct"], ["easy"])


@query(f"WITH {_TREE}, dup AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first FROM documents) SELECT state, count(*) AS n FROM (SELECT CASE WHEN first <> doc_id THEN 'duplicate' WHEN r.status IN ('ASSIGNED', 'PARTIAL', 'FALLBACK') THEN 'classified' ELSE 'unclassified' END AS state FROM dup LEFT JOIN r ON r.vec_id = doc_id) GROUP BY state")
def import_classified(spark, d):
    """States of imported files by their copies and by how a tree takes their vectors; files without a vector aren't classified."""
    rows = corpus.exact_duplicates(read(spark, d, "documents")).join(_classified(spark, d).select(F.col("vec_id").alias("doc_id"), "status"), "doc_id", "left")
    return rows.groupBy(corpus.import_state(F.coalesce("status", F.lit("UNKNOWN")), F.col("duplicate_of")).alias("state")).agg(F.count("*").alias("n"))
