"""Ingestion, chunking and vector search queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import guard, retrieval, vector_index
from ..session import table
from ..sources import ingest
from .registry import query

K = 5


@query("SELECT doc_id, CAST(1 AS BIGINT) AS page_number, text FROM documents")
def ingest_text_pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.lit(1).cast("long").alias("page_number"), "text")


@query("SELECT conv_id, count(*) AS n_pages, string_agg(text, chr(10) ORDER BY turn, text) AS body FROM conversations GROUP BY conv_id")
def pages_array(spark: SparkSession, d: str) -> DataFrame:
    pages = F.array_sort(F.collect_list(F.struct("turn", "text")))
    built = table(spark, d, "conversations").groupBy("conv_id").agg(pages.alias("pages"))
    return built.select("conv_id", F.size("pages").cast("long").alias("n_pages"), F.array_join(F.transform("pages", lambda p: p["text"]), "\n").alias("body"))


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM documents),
    s AS (SELECT doc_id, ws, unnest(range(0, CAST(greatest(0, ceil((len(ws) - 200) / 160.0)) AS BIGINT) + 1)) AS k FROM w WHERE len(ws) > 0)
    SELECT doc_id, k AS chunk_index, array_to_string(ws[k * 160 + 1 : k * 160 + 200], ' ') AS chunk FROM s""")
def chunk_text(spark: SparkSession, d: str) -> DataFrame:
    chunks = T.chunks(F.col("text"), 200, 160)
    return table(spark, d, "documents").select("doc_id", F.posexplode(chunks).alias("chunk_index", "chunk")).withColumn("chunk_index", F.col("chunk_index").cast("long"))


@query(r"""SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host,
    regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages""")
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    part = lambda p: F.regexp_extract("url", p, 1)
    return table(spark, d, "pages").select("page_id", part(r"^([a-z]+)://").alias("scheme"), part(r"^[a-z]+://([^/?#]*)").alias("host"), part(r"^[a-z]+://[^/?#]*([^?#]*)").alias("path"))


@query("SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9._-]+', '_', 'g') AS filename FROM part")
def sanitize_name(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", T.sanitize_name(F.col("p_name")).alias("filename"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS id, sha256(text) AS checksum, doc_id % 97 <> 0 AS intact FROM documents WHERE doc_id % 89 <> 0
    UNION ALL SELECT CAST(doc_id AS VARCHAR), sha256(text), false FROM documents WHERE doc_id % 89 = 0""")
def checksum(spark: SparkSession, d: str) -> DataFrame:
    """Stored bytes against the catalog's checksums; every 97th file was altered after its upload, every 89th was lost."""
    docs = table(spark, d, "documents")
    catalog = docs.select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("local://files/"), "doc_id").alias("storage_path"), T.checksum(F.col("text")).alias("checksum"))
    altered = F.when(F.col("doc_id") % 97 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text"))
    store = docs.where("doc_id % 89 <> 0").select(F.concat(F.lit("local://files/"), "doc_id").alias("storage_path"), altered.cast("binary").alias("content"))
    return ingest.verify(catalog, store).join(catalog.select("id", "checksum"), "id").select("id", "checksum", "intact")


@query("""SELECT doc_id, CASE WHEN lang = 'es' THEN 'type' WHEN n_chars > 10000 THEN 'too_large' WHEN n_chars < 200 THEN 'too_small' ELSE 'ok' END AS verdict FROM documents""")
def upload_validation(spark: SparkSession, d: str) -> DataFrame:
    """Documents as uploads of a size and a type by their language; one type is not known."""
    kinds = F.create_map(*(F.lit(x) for pair in (("en", "txt"), ("de", "html"), ("fr", "docx"), ("es", "exe")) for x in pair))
    uploads = table(spark, d, "documents").select("doc_id", F.concat_ws(".", "doc_id", kinds[F.col("lang")]).alias("filename"), F.col("n_chars").alias("size_bytes"))
    return ingest.validate(uploads, max_bytes=10_000, min_bytes=200).select("doc_id", F.coalesce("reason", F.lit("ok")).alias("verdict"))


_LINES = "list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '')"
_SAME = " OR ".join(f"(len(list_distinct(list_transform(ls, lambda x: len(x) - len(replace(x, {d}, ''))))) = 1 AND len(ls[1]) > len(replace(ls[1], {d}, '')))" for d in ("chr(9)", "';'", "'|'"))


@query(f"""WITH texts AS (SELECT 'page' AS kind, page_id AS id, html AS t FROM pages UNION ALL SELECT 'document', doc_id, text FROM documents),
    cut AS (SELECT *, {_LINES} AS ls FROM texts)
    SELECT kind, id, CASE WHEN regexp_matches(t, '<[A-Za-z!/][^>]*>') THEN 'semi' WHEN len(ls) > 1 AND ({_SAME}) THEN 'structured'
        WHEN len(ls) > 0 AND 2 * len(list_filter(ls, lambda x: regexp_matches(x, '^[A-Za-z][^:\n]{{0,40}}: '))) >= len(ls) THEN 'semi' ELSE 'unstructured' END AS class FROM cut
    UNION ALL SELECT 'conversation', conv_id, 'structured' FROM (SELECT DISTINCT conv_id FROM conversations WHERE role IS NOT NULL)""")
def structure_class(spark: SparkSession, d: str) -> DataFrame:
    """Pages and documents by what stands in them; conversations are rows of roles and turns."""
    pages = table(spark, d, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), T.structure(F.col("html")).alias("class"))
    docs = table(spark, d, "documents").select(F.lit("document"), "doc_id", T.structure(F.col("text")))
    turns = table(spark, d, "conversations").where("role is not null").select("conv_id").distinct()
    return pages.union(docs).union(turns.select(F.lit("conversation"), "conv_id", F.lit("structured")))


_SCHEMES = {"en": "minio", "de": "local", "fr": "s3", "es": "ftp"}


@query("""WITH made AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'minio' WHEN 'de' THEN 'local' WHEN 'fr' THEN 's3' ELSE 'ftp' END AS scheme, source AS bucket, 'texts/' || doc_id || '.txt' AS key FROM documents)
    SELECT doc_id, scheme, bucket, key, CASE WHEN scheme IN ('minio', 's3') THEN 's3a://' || bucket || '/' || key WHEN scheme = 'local' THEN '/store/' || bucket || '/' || key
        ELSE scheme || '://' || bucket || '/' || key END AS path FROM made""")
def storage_paths(spark: SparkSession, d: str) -> DataFrame:
    """Storage URIs, made of documents' sources and ids, in their parts, and where Spark finds them."""
    scheme = F.coalesce(F.create_map(*(F.lit(x) for pair in _SCHEMES.items() for x in pair))[F.col("lang")], F.lit("ftp"))
    made = table(spark, d, "documents").select("doc_id", F.concat(scheme, F.lit("://"), "source", F.lit("/texts/"), "doc_id", F.lit(".txt")).alias("uri"))
    return made.select("doc_id", T.storage_uri(F.col("uri")).alias("p"), T.hadoop_path(F.col("uri"), "/store").alias("path")).select("doc_id", "p.*", "path")


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Queries, every row whose id is divisible by 100, and the corpus: all rows, so that a query's own row is a hit."""
    vectors = table(spark, d, "embeddings")
    return vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), vectors


def hits(spark: SparkSession, d: str) -> DataFrame:
    queries, corpus = _vectors(spark, d)
    return retrieval.top_k(queries, corpus, K)


#: The labels of the folders below, made once a session.
_LABELS: dict[str, DataFrame] = {}


def _label_folders(spark: SparkSession) -> DataFrame:
    """Labels of one root with a folder for each of the vectors' ten labels."""
    key = spark.sparkContext.applicationId
    if key not in _LABELS:
        _LABELS[key] = guard.labelled(spark.createDataFrame([("all", None), *((f"l{k}", "all") for k in range(10))], "id string, parent_folder_id string"))
    return _LABELS[key]


def guarded_hits(spark: SparkSession, d: str) -> DataFrame:
    """The permission filter stands before the rank: a hidden chunk never takes a place among the k.

    A vector's label names its folder; the reader's role holds a grant on folders 0 to 4, which lie below one root.
    """
    queries, corpus = _vectors(spark, d)
    roles = spark.createDataFrame([("reader", "r"), ("other", "x")], "user_id string, role_id string")
    grants = spark.createDataFrame([*(("r", f"l{k}", "read") for k in range(5)), ("x", "all", "admin")], "role_id string, folder_id string, access_level string")
    mine = guard.effective_folders(roles.where("user_id = 'reader'"), grants, _label_folders(spark))
    return retrieval.top_k(queries, guard.visible(corpus.withColumn("folder_id", F.concat(F.lit("l"), "label")), mine), K)


def pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.lit(1).cast("long").alias("page_number"), "text")


def on_page_one(found: DataFrame) -> DataFrame:
    return found.select("query_id", "rank", "score", F.col("vec_id").alias("document_id"), F.lit(1).cast("long").alias("page_number"))


_HITS = """scored AS (SELECT q.vec_id AS query_id, c.vec_id,
        list_reduce(list_transform(range(1, len(q.embedding) + 1), lambda i: q.embedding[i]::DOUBLE * c.embedding[i]::DOUBLE), lambda x, y: x + y, 0.0::DOUBLE) AS score
      FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0{0}),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored),
    hits AS (SELECT query_id, vec_id, score, rank FROM ranked WHERE rank <= 5)"""
_ALL, _GUARDED = _HITS.format(""), _HITS.format(" AND c.label <= 4")


@query(f"WITH {_ALL} SELECT query_id, vec_id, score, rank FROM hits")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return hits(spark, d)


@query()
def vector_topk_approximate(spark: SparkSession, d: str) -> DataFrame:
    """The same queries through inverted lists of quantised vectors; tests measure its recall and how many vectors are scored."""
    queries, corpus = _vectors(spark, d)
    codec = vector_index.learn(corpus)
    return vector_index.search(queries, corpus, vector_index.encoded(corpus, codec), codec, K)


@query(f"WITH {_GUARDED} SELECT query_id, vec_id, score, rank FROM hits")
def rbac_vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return guarded_hits(spark, d)


@query(f"WITH {_ALL} SELECT query_id, rank, doc_id AS document_id, CAST(1 AS BIGINT) AS page_number, substr(text, 1, 80) AS excerpt FROM hits JOIN documents ON vec_id = doc_id")
def citation_lookup(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.citations(on_page_one(hits(spark, d)), pages(spark, d))


@query(f"""WITH {_ALL} SELECT query_id, rank, conv_id AS document_id, turn AS page_number, substr(text, 1, 80) AS excerpt
    FROM hits JOIN conversations ON vec_id = conv_id AND turn = rank - 1""")
def citation_pages(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as documents, turns as pages: the hit of rank r cites turn r - 1."""
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("page_number"), "text")
    return retrieval.citations(on_page_one(hits(spark, d)).withColumn("page_number", F.col("rank") - 1), turns)


@query(f"WITH {_ALL} SELECT query_id, string_agg(text, chr(10) ORDER BY rank) AS context FROM hits JOIN documents ON vec_id = doc_id GROUP BY query_id")
def rag_context(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.context(on_page_one(hits(spark, d)), pages(spark, d))


@query(rf"""WITH {_ALL}, best AS (SELECT query_id, min_by(text, rank) AS t, string_agg(vec_id || ':1', ' ' ORDER BY rank) AS cited FROM hits JOIN documents ON vec_id = doc_id GROUP BY query_id),
    cut AS (SELECT *, regexp_extract(t, '(?s)^(.*?[.!?])\s+(.*)$', 1) AS one, regexp_extract(t, '(?s)^.*?[.!?]\s+(.*)$', 1) AS rest FROM best)
    SELECT query_id, cited, CASE WHEN one = '' THEN t WHEN regexp_matches(rest, '(?s)[.!?]\s') THEN one || ' ' || regexp_extract(rest, '(?s)^(.*?[.!?])\s', 1) ELSE one || ' ' || rest END AS answer FROM cut""")
def rag_answer(spark: SparkSession, d: str) -> DataFrame:
    found = retrieval.answers(on_page_one(hits(spark, d)), pages(spark, d))
    return found.select("query_id", "answer", F.array_join(F.transform("cited", lambda x: F.concat_ws(":", x["document_id"], x["page_number"])), " ").alias("cited"))


@query(f"""WITH {_ALL}, cited AS (SELECT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n, vec_id, text FROM hits JOIN documents ON vec_id = doc_id)
    SELECT query_id, 'Answer from the sources, and name them by their numbers.' || chr(10) || string_agg('[' || n || '] document ' || vec_id || ', page 1: ' || substr(cited.text, 1, 200), chr(10) ORDER BY n)
        || chr(10) || 'Question: ' || any_value(substr(q.text, 1, 80)) AS prompt
    FROM cited JOIN documents q ON cited.query_id = q.doc_id GROUP BY query_id""")
def rag_prompt(spark: SparkSession, d: str) -> DataFrame:
    """The prompt of each question with its numbered sources; the start of a query's own document stands for the question."""
    questions = table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), F.substring("text", 1, 80).alias("text"))
    return retrieval.prompts(on_page_one(hits(spark, d)), pages(spark, d), questions, chars=200)


@query("""SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer FROM conversations u
    JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = (SELECT min(turn) FROM conversations n WHERE n.conv_id = u.conv_id AND n.turn > u.turn)
    WHERE u.role = 'user' AND a.role = 'assistant'""")
def qa_pairs(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window as W

    following = W.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, d, "conversations").withColumn("after", F.lead(F.struct("role", "text")).over(following))
    return turns.where("role = 'user' and after.role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), F.col("after.text").alias("answer"))
