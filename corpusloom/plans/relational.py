"""Queries over the star schema, events and conversations, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers, text, vectors
from ..operators import corpus, evaluation, memory
from ..sources import documents as sources
from ..streaming import ingest

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query, and SQL for it."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the test data."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@query("SELECT doc_id, lang, source, n_chars FROM documents ORDER BY doc_id LIMIT 20 OFFSET 40")
def list_documents_page(spark, d):
    """The third page of the listing; texts aren't read."""
    return corpus.page(read(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), ["doc_id"], 3, 20)


@query("SELECT doc_id, source FROM documents WHERE lang = 'de' AND source = 'src3'")
def filter_by_lang(spark, d):
    """Rows by conjunctive equality; empty values don't filter."""
    return corpus.where_equal(read(spark, d, "documents").select("doc_id", "source", "lang"), lang="de", source="src3", x="").select("doc_id", "source")


@query("SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%a%'")
def title_filter(spark, d):
    """Names that have a letter in any case."""
    return corpus.title_contains(read(spark, d, "part"), "A", "p_name").select("p_partkey", "p_name")


@query("SELECT conv_id, list(DISTINCT role ORDER BY role)[1] AS first_role FROM conversations GROUP BY conv_id HAVING list_contains(list(lower(role)), 'user')")
def tag_filter(spark, d):
    """Conversations whose set of roles has one, in any case."""
    rows = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("tags"))
    return corpus.has_tag(rows, "USER").select("conv_id", F.col("tags")[0].alias("first_role"))


@query("SELECT count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents WHERE lang = 'en'")
def count_filtered(spark, d):
    """The count that goes with a filtered page."""
    return corpus.where_equal(read(spark, d, "documents"), lang="en").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS content_hash, CASE WHEN min(doc_id) OVER (PARTITION BY text) <> doc_id THEN min(doc_id) OVER (PARTITION BY text) END AS duplicate_of FROM documents")
def exact_dedup(spark, d):
    """The first document of each text, and those that repeat it."""
    return corpus.exact_duplicates(read(spark, d, "documents"))


@query("SELECT page_id, lower(trim(regexp_replace(translate(regexp_replace(url, '\\.[^./\\\\]+$', ''), '\\/_', '---'), '-+', '-', 'g'), '-')) AS slug FROM pages")
def doc_slug(spark, d):
    """Identifiers of paths."""
    return read(spark, d, "pages").select("page_id", text.doc_slug(F.col("url")).alias("slug"))


@query("SELECT page_id, lower(translate(regexp_replace(url, '\\.[^./\\\\]+$', ''), '/_', '--')) AS slug FROM pages")
def doc_slug_plain(spark, d):
    """The variant that keeps runs of hyphens."""
    return read(spark, d, "pages").select("page_id", text.doc_slug_plain(F.col("url")).alias("slug"))


@query("SELECT page_id, 'path_' || substr(sha1(url), 1, 24) AS derived, list_aggregate(string_split(url, '/')[1:least(2, greatest(len(string_split(url, '/')) - 1, 0))], 'string_agg', '/') AS stratum FROM pages")
def path_identity(spark, d):
    """Derived identifiers and strata of paths."""
    return read(spark, d, "pages").select("page_id", text.derived_id(F.col("url")).alias("derived"), text.stratum(F.col("url")).alias("stratum"))


@query("SELECT doc_id, printf('%03d', CAST('0x' || right(md5(CAST(doc_id AS VARCHAR)), 2) AS INTEGER)) AS shard FROM documents")
def shard_dir(spark, d):
    """One of 256 folders for each document."""
    return read(spark, d, "documents").select("doc_id", text.shard(F.col("doc_id").cast("string")).alias("shard"))


@query("SELECT doc_id, trim(regexp_replace(trim(string_split(ltrim(text, ' ' || chr(9) || chr(10) || chr(13)), chr(10))[1]), '^[# ]+', ''), ' ' || chr(9) || chr(13)) AS title FROM documents")
def title_first_line(spark, d):
    """Titles of documents."""
    return read(spark, d, "documents").select("doc_id", text.first_line(F.col("text")).alias("title"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[\\pL\\pM\\pN_]+|[^\\pL\\pM\\pN_\\s]'))::INTEGER AS n_tokens FROM documents")
def token_count(spark, d):
    """Words and other signs of each document."""
    return read(spark, d, "documents").select("doc_id", text.token_count(F.col("text")).alias("n_tokens"))


@query("SELECT doc_id, len(t)::INTEGER AS n_tokens, array_to_string(t[1:5], ' ') AS head FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents)")
def tokenize_query(spark, d):
    """Search tokens of each document."""
    rows = read(spark, d, "documents").select("doc_id", text.search_tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").alias("n_tokens"), F.array_join(F.slice("t", 1, 5), " ").alias("head"))


@query("SELECT doc_id, sha256(source || chr(10) || source || chr(10) || substr(text, 1, 2000)) AS classifier_hash, sha256(source || chr(10) || lang || chr(10) || text) AS embedding_hash, sha256(source || chr(10) || text) AS repeated_hash FROM documents")
def embed_text(spark, d):
    """Texts given to encoders, as hashes."""
    t = read(spark, d, "documents")
    c = F.col
    return t.select("doc_id", F.sha2(text.classifier_text(c("source"), c("text")), 256).alias("classifier_hash"), F.sha2(text.embedding_text(c("source"), c("lang"), c("text")), 256).alias("embedding_hash"), F.sha2(text.embedding_text(c("source"), c("source"), c("text")), 256).alias("repeated_hash"))


@query("SELECT doc_id, sha256(sha256(text) || '|model=hash;dim=64') AS cache_key, doc_id || '-chunk-007-' || substr(sha256(source || chr(0) || text), 1, 12) AS chunk_id FROM documents")
def content_keys(spark, d):
    """Cache keys and chunk identifiers."""
    t = read(spark, d, "documents")
    return t.select("doc_id", text.cache_key(F.col("text"), "model=hash;dim=64").alias("cache_key"), text.chunk_id(F.col("doc_id").cast("string"), F.lit(7), F.col("source"), F.col("text")).alias("chunk_id"))


@query("SELECT page_id, coalesce(nullif(trim(regexp_replace(string_split(url, '/')[-1], '[^A-Za-z0-9._-]', '_', 'g'), '. '), ''), 'file') AS name FROM pages")
def safe_names(spark, d):
    """File names made safe."""
    return read(spark, d, "pages").select("page_id", text.safe_name(F.col("url")).alias("name"))


@query("SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'html' WHEN 3 THEN 'text' WHEN 4 THEN 'docx' WHEN 5 THEN 'text' END AS kind FROM documents")
def file_types(spark, d):
    """Types by suffix."""
    suffix = F.element_at(F.array(*map(F.lit, ("PDF", "doc", "Htm", "md", "docx", "rst", "exe"))), (F.col("doc_id") % 7 + 1).cast("int"))
    return read(spark, d, "documents").select("doc_id", text.file_type(F.concat_ws(".", F.lit("dir.x/name"), suffix)).alias("kind"))


@query("SELECT doc_id, CASE WHEN length(text) > 400 THEN substr(text, 1, 400) || '...' ELSE text END AS cut FROM documents")
def truncate_tokens(spark, d):
    """Texts cut to a token budget."""
    return read(spark, d, "documents").select("doc_id", text.truncated(F.col("text"), 100).alias("cut"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN '{}' ELSE '{\"id\": ' || doc_id || '}' END AS json FROM documents")
def json_salvage(spark, d):
    """JSON objects found in loose answers."""
    whole = F.concat(F.lit('{"id": '), F.col("doc_id"), F.lit("}"))
    loose = F.element_at(F.array(whole, F.concat(F.lit("Here:\n```json\n"), whole, F.lit("\n```\nDone")), F.concat(F.lit("The answer is "), whole, F.lit(" I think")), F.lit("no object")), (F.col("doc_id") % 4 + 1).cast("int"))
    return read(spark, d, "documents").select("doc_id", text.salvaged_json(loose).alias("json"))


@query("SELECT page_id, array_to_string(list_distinct_ordered, ',') AS tags FROM (SELECT page_id, list_filter(['web', CASE WHEN url LIKE '%/en/%' THEN 'english' END, CASE WHEN lower(url) LIKE '%example%' THEN 'sample' END], lambda x: x IS NOT NULL) AS list_distinct_ordered FROM pages)")
def tag_rules(spark, d):
    """Tags by rules over paths."""
    return read(spark, d, "pages").select("page_id", F.array_join(text.tagged(F.col("url"), {"/en/": "english", "EXAMPLE": "sample"}, ["web"]), ",").alias("tags"))


@query("SELECT doc_id, sha256('---' || chr(10) || 'document_id: d' || doc_id || chr(10) || 'title: ' || source || chr(10) || 'author: ' || lang || chr(10) || 'source_path: x/' || doc_id || chr(10) || '---' || chr(10) || chr(10) || '# ' || source || chr(10) || chr(10) || text) AS h FROM documents")
def canonical_document(spark, d):
    """Documents written with front matter, as hashes."""
    c, s = F.col, F.col("doc_id").cast("string")
    return read(spark, d, "documents").select("doc_id", F.sha2(sources.canonical(F.concat(F.lit("d"), s), c("source"), c("lang"), F.concat(F.lit("x/"), s), c("text")), 256).alias("h"))


@query("SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def recent_turns(spark, d):
    """The last three turns of each conversation."""
    return memory.recent_turns(read(spark, d, "conversations"), 3).select("conv_id", "turn", "role", "text")


@query("SELECT conv_id, turn, coalesce(string_agg(role || ': ' || text, chr(10) ORDER BY turn) OVER w, '') AS context, count(*) OVER w AS n_context FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING)".replace("string_agg(role || ': ' || text, chr(10) ORDER BY turn) OVER w", "array_to_string(list(role || ': ' || text) OVER w, chr(10))"))
def context_frame(spark, d):
    """Each turn with the two before it."""
    return memory.context_frame(read(spark, d, "conversations"), 2).withColumn("n_context", F.col("n_context").cast("long"))


@query("SELECT m.doc_id, m.conv_id, t.role, t.text AS source_text FROM (SELECT doc_id, doc_id % 150 AS conv_id, 0 AS turn FROM documents) m LEFT JOIN conversations t ON m.conv_id = t.conv_id AND m.turn = t.turn")
def hydrate(spark, d):
    """Memories with their source turns, null where missing."""
    memories = read(spark, d, "documents").select("doc_id", (F.col("doc_id") % 150).alias("conv_id"), F.lit(0).cast("long").alias("turn"))
    return memory.hydrate(memories, read(spark, d, "conversations"), ["conv_id", "turn"]).select("doc_id", "conv_id", "role", "source_text")


@query("SELECT conv_id, count(*) AS n_messages, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def thread_state(spark, d):
    """Messages by thread."""
    return ingest.thread_counts(read(spark, d, "conversations"))


@query("SELECT r_name AS l1, n_name AS l2, t.c_mktsegment AS l3, count(c_custkey) AS n FROM (SELECT r_name, r_regionkey, n_name, n_nationkey, s.c_mktsegment FROM region JOIN nation ON n_regionkey = r_regionkey CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer) s) t LEFT JOIN customer c ON c.c_nationkey = t.n_nationkey AND c.c_mktsegment = t.c_mktsegment GROUP BY ALL")
def taxonomy_counts(spark, d):
    """Counts of all leaves of a tree, 0 for empty ones. The tree is a product of small dimension tables."""
    r, n, c = (read(spark, d, t) for t in ("region", "nation", "customer"))
    leaves = r.join(n, r.r_regionkey == n.n_regionkey).select("r_name", "n_name", "n_nationkey")
    segments = sorted(x[0] for x in c.select("c_mktsegment").distinct().collect())  # few values
    tree = leaves.select("*", F.explode(F.array(*map(F.lit, segments))).alias("c_mktsegment"))
    counts = c.groupBy(F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment").agg(F.count("*").alias("n"))
    return tree.join(counts, ["n_nationkey", "c_mktsegment"], "left").select(F.col("r_name").alias("l1"), F.col("n_name").alias("l2"), F.col("c_mktsegment").alias("l3"), F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT r_name AS l1, n_name AS l2, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def taxonomy_rollup(spark, d):
    """Counts of all inner nodes too."""
    r, n, c = (read(spark, d, t) for t in ("region", "nation", "customer"))
    counts = c.groupBy("c_nationkey").agg(F.count("*").alias("n"))
    rows = counts.join(n, F.col("c_nationkey") == n.n_nationkey).join(r, r.r_regionkey == n.n_regionkey)
    return rows.rollup(F.col("r_name").alias("l1"), F.col("n_name").alias("l2")).agg(F.sum("n").alias("n"))


@query("SELECT source, lang, n, least(n, base + down + CASE WHEN row_number() OVER (ORDER BY round(share - down, 9) DESC, source, lang) <= rest THEN 1 ELSE 0 END)::BIGINT AS quota FROM (SELECT *, l - sum(down) OVER () AS rest FROM (SELECT *, floor(share) AS down FROM (SELECT *, l * (n - base) / sum(n - base) OVER () AS share FROM (SELECT *, 200 - sum(base) OVER () AS l FROM (SELECT source, lang, count(*) AS n, least(1, count(*)) AS base FROM documents GROUP BY source, lang)))))")
def stratified_quota(spark, d):
    """Quotas by largest remainder."""
    return corpus.quotas(read(spark, d, "documents"), ["source", "lang"], 200)


@query("WITH q AS (SELECT source, n, least(n, 1 + down + CASE WHEN row_number() OVER (ORDER BY round(share - down, 9) DESC, source) <= rest THEN 1 ELSE 0 END) AS quota FROM (SELECT *, l - sum(down) OVER () AS rest FROM (SELECT *, floor(share) AS down FROM (SELECT *, l * (n - 1) / sum(n - 1) OVER () AS share FROM (SELECT *, 120 - count(*) OVER () AS l FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)))))) SELECT doc_id, d.source FROM documents d JOIN q ON q.source = d.source QUALIFY row_number() OVER (PARTITION BY d.source ORDER BY md5('seed' || doc_id), doc_id) <= quota")
def stratified_sample(spark, d):
    """A sample that meets the quotas."""
    return corpus.stratified_sample(read(spark, d, "documents"), ["source"], 120, "doc_id")


@query("SELECT (row_number() OVER (ORDER BY old DESC, url) - 1)::BIGINT AS doc_index, url FROM (SELECT url, bool_or(page_id % 2 = 0) AS old FROM pages GROUP BY url)")
def manifest_extend(spark, d):
    """A manifest of some paths, extended by the others."""
    t = read(spark, d, "pages")
    old = corpus.manifest(t.where("page_id % 2 = 0"), "url")
    return corpus.manifest(t, "url", old)


@query("SELECT count(DISTINCT url) AS n, count(DISTINCT url) AS n_distinct, count(DISTINCT url) - 1 AS last, true AS ok FROM pages")
def manifest_check(spark, d):
    """Whether a manifest's indexes have no gap."""
    return corpus.contiguous(corpus.manifest(read(spark, d, "pages"), "url"))


@query("SELECT doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0)")
def cache_misses(spark, d):
    """Rows whose content isn't cached."""
    t = read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("cache_key"))
    return corpus.cache_split(t, t.where("doc_id % 3 = 0"))[1].select("doc_id")


@query("SELECT (count(*) FILTER (WHERE hit))::BIGINT AS hits, (count(*) FILTER (WHERE NOT hit))::BIGINT AS misses FROM (SELECT sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0) AS hit FROM documents)")
def cache_rates(spark, d):
    """Hits and misses by row."""
    t = read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("cache_key"))
    known = t.where("doc_id % 3 = 0").select("cache_key").distinct().withColumn("hit", F.lit(True))
    return t.join(known, "cache_key", "left").agg(F.count_if("hit").alias("hits"), F.count_if(F.col("hit").isNull()).alias("misses"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def set_diff(spark, d):
    """Documents without a vector."""
    return read(spark, d, "documents").select("doc_id").join(read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


@query("SELECT coalesce(a.o_orderpriority, b.o_orderpriority) AS o_orderpriority, coalesce(a.n, 0) AS old, coalesce(b.n, 0) AS new, coalesce(b.n, 0) - coalesce(a.n, 0) AS change FROM (SELECT o_orderpriority, count(*) AS n FROM orders WHERE year(o_orderdate) = 1995 GROUP BY 1) a FULL JOIN (SELECT o_orderpriority, count(*) AS n FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1) b ON a.o_orderpriority = b.o_orderpriority")
def snapshot_diff(spark, d):
    """Two years' counts compared."""
    t = read(spark, d, "orders")
    a, b = (t.where(F.year("o_orderdate") == y).groupBy("o_orderpriority").agg(F.count("*").alias("n")) for y in (1995, 1996))
    return corpus.compared(a, b, "o_orderpriority", "n")


@query("SELECT user_id, count(*) AS total, count(*) FILTER (WHERE event_type IN ('purchase', 'view')) AS done, count(*) FILTER (WHERE event_type = 'error') AS failed, round(count(*) FILTER (WHERE event_type IN ('purchase', 'view', 'error')) * 100.0 / count(*), 1) AS percent FROM events GROUP BY user_id")
def task_progress(spark, d):
    """Progress of tasks by the states of their files."""
    return corpus.progress(read(spark, d, "events"), "user_id", "event_type", ["purchase", "view"], ["error"])


@query("SELECT source, n, sum(z)::BIGINT AS bytes, s[least(n * 5 // 100, n - 1) + 1] AS p5, s[least(n * 25 // 100, n - 1) + 1] AS p25, s[least(n * 50 // 100, n - 1) + 1] AS p50, s[least(n * 75 // 100, n - 1) + 1] AS p75, s[least(n * 90 // 100, n - 1) + 1] AS p90, s[least(n * 99 // 100, n - 1) + 1] AS p99 FROM (SELECT source, octet_length(encode(text))::BIGINT AS z FROM documents) JOIN (SELECT source, count(*) AS n, list_sort(list(octet_length(encode(text))::BIGINT)) AS s FROM documents GROUP BY source) USING (source) GROUP BY source, s, n")
def corpus_profile(spark, d):
    """Rows and bytes by source."""
    return corpus.profile(read(spark, d, "documents"), "source", F.octet_length("text"))


@query("SELECT doc_id, CASE WHEN n_chars % 10 = 0 THEN 'EMPTY_FILE' WHEN n_chars > 5000 THEN 'FILE_TOO_LARGE' WHEN source IN ('src1', 'src2') THEN 'UNSUPPORTED_TYPE' END AS code FROM documents")
def upload_checks(spark, d):
    """Codes of files that can't be taken."""
    t = read(spark, d, "documents")
    name = F.concat(F.lit("a."), F.when(F.col("source").isin("src1", "src2"), "exe").otherwise("MD"))
    return t.select("doc_id", corpus.upload_error(name, F.when(F.col("n_chars") % 10 == 0, 0).otherwise(F.col("n_chars")), 5000, ["md", "txt"]).alias("code"))


@query("SELECT state, count(*) AS n FROM (SELECT CASE WHEN min(doc_id) OVER (PARTITION BY text) <> doc_id THEN 'duplicate' WHEN doc_id % 5 < 3 THEN 'classified' ELSE 'unclassified' END AS state FROM documents) GROUP BY state")
def import_lifecycle(spark, d):
    """States of imported files."""
    rows = corpus.exact_duplicates(read(spark, d, "documents"))
    status = F.element_at(F.array(*map(F.lit, ("ASSIGNED", "PARTIAL", "FALLBACK", "UNKNOWN", "NONE"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return rows.groupBy(corpus.import_state(status, F.col("duplicate_of")).alias("state")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN n < 1000 THEN CAST(n AS VARCHAR) WHEN n % 1000 = 0 THEN (n // 1000) || 'k' ELSE printf('%.1f', n / 1000) || 'k' END AS label FROM (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN doc_id * 500 ELSE n_chars END AS n FROM documents)")
def count_labels(spark, d):
    """Counts as short labels, 0 and whole thousands among them."""
    n = F.when(F.col("doc_id") % 50 == 0, F.col("doc_id") * 500).otherwise(F.col("n_chars"))
    return read(spark, d, "documents").select("doc_id", text.count_label(n).alias("label"))


@query("SELECT source, coalesce(round(count(*) FILTER (WHERE lang = 'en') * 100.0 / nullif(count(*), 0), 2), 0) AS percent FROM documents GROUP BY source")
def percents(spark, d):
    """Shares in percent, 0 for nothing."""
    return read(spark, d, "documents").groupBy("source").agg(text.percent(F.count_if(F.col("lang") == "en"), F.count("*")).alias("percent"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def window_counts(spark, d):
    """Hourly counts of events, by the expression that the stream uses."""
    rows = ingest.window_counts(read(spark, d, "events"))
    return rows.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query()
def html_to_text(spark, d):
    """Pages as lines of text; SQL can't parse HTML, the tests compare golden pages."""
    return sources.html_to_text(read(spark, d, "pages"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'PASS' WHEN p_partkey % 3 = 1 THEN 'REVISE' END AS decision, p_name || '|second' AS reasons, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '' END AS missing, '' AS claims FROM part")
def review_parse(spark, d):
    """Decisions and bullets of reviewers' answers, made up from the parts' names."""
    word = F.element_at(F.array(F.lit("**Decision:** pass"), F.lit("Decision:\nRevise"), F.lit("Decision: maybe")), (F.col("p_partkey") % 3 + 1).cast("int"))
    said = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("1. '"), "p_name", F.lit("'"))).otherwise("- None.")
    answer = F.concat(word, F.lit("\n\n**Reasons:\n- "), "p_name", F.lit("\n* second\n\nUnsupported claims:\n- N/A\nMissing important information:\n"), said)
    found = read(spark, d, "part").select("p_partkey", answers.review(answer).alias("r"))
    lists = {"reasons": "reasons", "missing": "missing_information", "claims": "unsupported_claims"}
    return found.select("p_partkey", "r.decision", *(F.array_join(f"r.{c}", "|").alias(a) for a, c in lists.items()))


@query("SELECT 'repeated_key' AS problem, count(vec_id) - count(DISTINCT vec_id) AS n FROM embeddings UNION ALL SELECT 'repeated_text', count(text) - count(DISTINCT text) FROM embeddings JOIN documents ON vec_id = doc_id UNION ALL SELECT 'unknown_category', count(*) FROM embeddings WHERE label > 7 UNION ALL SELECT 'missing_document', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def eval_set_checks(spark, d):
    """Problems of a set of evaluation queries."""
    docs = read(spark, d, "documents")
    asked = read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label").join(docs.select("doc_id", "text"), "doc_id", "left")
    return evaluation.integrity(asked.withColumn("id", F.col("doc_id")), docs.where("lang = 'en'"), "id", "text", "label", "doc_id", list(range(8)))


@query("SELECT o_custkey, o_orderkey AS first_order FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def first_match(spark, d):
    """The first row of each key by time."""
    return read(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_order"))


@query("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS score, round(1 - (1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) / 2, 4) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def distance_scores(spark, d):
    """Both scores that are made of a distance, for neighbouring vectors."""
    t = read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    pairs = t.join(t.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    cos = vectors.cosine(F.col("a"), F.col("b"))
    return pairs.select("vec_id", F.round(cos, 4).alias("score"), F.round(memory.sim01(cos), 4).alias("similarity"))


@query("SELECT l_suppkey, string_agg(DISTINCT l_linenumber::VARCHAR, ',' ORDER BY l_linenumber::VARCHAR) AS numbers, count(DISTINCT l_orderkey) AS n_orders FROM lineitem GROUP BY l_suppkey")
def ids_by_source(spark, d):
    """The sorted distinct ids of each source, with a count."""
    rows = read(spark, d, "lineitem").groupBy("l_suppkey")
    return rows.agg(F.array_join(F.array_sort(F.collect_set(F.col("l_linenumber").cast("string"))), ",").alias("numbers"), F.count_distinct("l_orderkey").alias("n_orders"))


@query("SELECT doc_id // 64 AS shard, count(*) AS n, min(doc_id) AS low, max(doc_id) AS high FROM documents GROUP BY 1")
def shard_split(spark, d):
    """Shards of 64 positions, with their ranges."""
    return read(spark, d, "documents").groupBy(F.floor(F.col("doc_id") / 64).alias("shard")).agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
