"""Nearest vectors, scope gate, hit rate and full retrieval."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatflow.catalog import schools
from seatflow.catalog.registry import Catalog
from seatflow.catalog.standins import table
from seatflow.catalog.texts import LETTERS, any_of
from seatflow.operators import vectors as V
from seatflow.operators.encoding import DOCUMENT, QUERY, embed_with, letter_encoder
from seatflow.plans.advisor import ATTRIBUTE_WORDS, GENERAL_WORDS, retrieve_context, unique_sources
from seatflow.session import fresh_path
from seatflow.sources.documents import build_chunk_table

catalog = Catalog()
query, QUERIES, SQL = catalog.query, catalog.queries, catalog.sql

# Queries are the mean vector of every label: one per topic, drawn from the whole table.
DIST = """parts AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS p
        FROM embeddings),
    q AS (SELECT label AS query_id, list(m ORDER BY p) AS qv
        FROM (SELECT label, p, avg(v) AS m FROM parts GROUP BY 1, 2) GROUP BY 1),
    dist AS (SELECT query_id, vec_id, label,
        round(list_cosine_distance(qv, embedding::DOUBLE[]), 6) AS distance FROM q, embeddings)"""


def _topics(spark, sf):
    return V.mean_vectors(table(spark, sf, "embeddings"), "label").withColumnRenamed(
        "label", "query_id"
    )


@query(
    "vector_top_k",
    f"""WITH {DIST} SELECT vec_id AS id, distance, CAST(row_number() OVER (ORDER BY distance, vec_id) AS INTEGER) AS rank
      FROM dist WHERE query_id = 3 AND label = 7 ORDER BY distance, vec_id LIMIT 10""",
)
def vector_top_k(spark, sf):
    """Ten nearest vectors of topic 7 to the mean of topic 3, as one request asks for them."""
    corpus = table(spark, sf, "embeddings").filter("label = 7")
    asked = {r["query_id"]: r["embedding"] for r in _topics(spark, sf).filter("query_id = 3").collect()}
    return V.nearest_to(corpus, asked, 10, "vec_id").drop("query_id")


@query(
    "vector_top_k_batch",
    f"""WITH {DIST} SELECT query_id, vec_id AS id, distance, rank FROM (SELECT *, CAST(row_number() OVER (
        PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM dist) WHERE rank <= 5""",
)
def vector_top_k_batch(spark, sf):
    return V.top_k(table(spark, sf, "embeddings"), _topics(spark, sf), 5, "vec_id")


@query("vector_top_k_blocks", SQL["vector_top_k_batch"])
def vector_top_k_blocks(spark, sf):
    """The same answer from many small blocks."""
    return V.top_k(table(spark, sf, "embeddings"), _topics(spark, sf), 5, "vec_id", block_rows=128)


@query(
    "scope_gate",
    f"""WITH {DIST}, best AS (SELECT query_id, min(distance) AS d FROM dist
      WHERE label = 7 AND query_id <> 9 GROUP BY 1)
    SELECT query_id, coalesce(d, 1.0) AS best_distance,
      coalesce(d, 1.0) > 0.6 AND query_id % 4 <> 0 AS out_of_scope FROM q LEFT JOIN best USING (query_id)""",
)
def scope_gate(spark, sf):
    """Topic means against topic 7; topic 9 has no vector and so no hit."""
    asked = _topics(spark, sf).withColumn(
        "embedding", F.when(F.col("query_id") != 9, F.col("embedding"))
    )
    hits = V.top_k(table(spark, sf, "embeddings").filter("label = 7"), asked, 1, "vec_id")
    return V.scope_gate(asked, hits, "query_id", F.col("query_id") % 4 == 0)


@query(
    "hit_at_k",
    f"""WITH {DIST}, top AS (SELECT * FROM dist QUALIFY row_number() OVER (
        PARTITION BY query_id ORDER BY distance, vec_id) <= 3)
    SELECT query_id, max(label IN (query_id, query_id + 1)) AS hit FROM top GROUP BY 1""",
)
def hit_at_k(spark, sf):
    asked = _topics(spark, sf)
    vectors = table(spark, sf, "embeddings")
    topics = vectors.select(
        F.col("vec_id").alias("id"),
        F.concat(F.lit("Topic-"), F.col("label").cast("string"), F.lit("-End")).alias("topic"),
    )
    results = V.top_k(vectors, asked, 3, "vec_id").join(topics, "id")

    def word(n):
        return F.concat(F.lit("topic-"), n.cast("string"), F.lit("-"))

    truth = asked.select(
        "query_id", F.array(word(F.col("query_id")), word(F.col("query_id") + 1)).alias("accepted")
    )
    return V.hit_at_k(results, truth, "topic", "accepted")


BY_TOPIC = (
    "WITH bt AS ("
    + schools.SQL["text_block"]
    + "), att AS ("
    + schools.SQL["attribute_block"]
    + "), ct AS ("
    + schools.SQL["contact_block"]
    + f"""), {DIST},
    top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM dist
      WHERE query_id <> 9 QUALIFY rank <= 3),
    policy AS (SELECT query_id, min(distance) AS best, string_agg('vector ' || vec_id,
        chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS policy_context,
        string_agg('label-' || label || '.md', '|' ORDER BY rank) AS files FROM top GROUP BY 1),
    asked AS (SELECT query_id, CASE WHEN query_id % 2 = 0
        THEN 'SUPPLIER#' || lpad(query_id::VARCHAR, 9, '0') END AS name FROM q),
    context AS (SELECT a.query_id, a.name, replace(nullif(concat_ws(chr(10), ballot_text,
        CASE WHEN a.query_id % 3 = 0 THEN attribute_text END,
        CASE WHEN a.query_id % 3 = 1 THEN contact_text END), ''),
        ': ' || name || chr(10), ': ' || lower(name) || chr(10)) AS c
      FROM asked a LEFT JOIN bt ON bt.school_name_clean = name
        LEFT JOIN att ON att.school_name_clean = name LEFT JOIN ct ON ct.school_name_clean = name),
    gated AS (SELECT *, coalesce(best, 1.0) AS best_distance,
        coalesce(best, 1.0) > 0.6 AND name IS NULL AS out_of_scope
      FROM context LEFT JOIN policy USING (query_id))
    SELECT query_id, best_distance, out_of_scope,
      CASE WHEN NOT out_of_scope THEN policy_context END AS policy_context,
      CASE WHEN NOT out_of_scope THEN files END AS files,
      CASE WHEN NOT out_of_scope THEN coalesce(c, 'No specific school data requested.') END AS school_context,
      NOT out_of_scope AND c IS NOT NULL AS school_context_used
    FROM gated"""
)


@query("retrieve_by_topic", BY_TOPIC)
def retrieve_by_topic(spark, sf):
    """The whole retrieval with the vectors as chunks and one question per topic."""
    n = F.col("query_id")
    asked = _topics(spark, sf).select(
        "query_id",
        F.when(n != 9, F.col("embedding")).alias("embedding"),
        F.when(n % 3 == 0, "Which ZONE is it in?")
        .when(n % 3 == 1, "Give me a telephone number")
        .otherwise("Hello")
        .alias("question"),
        F.when(
            n % 2 == 0, F.array(F.concat(F.lit("supplier#"), F.lpad(n.cast("string"), 9, "0")))
        ).alias("school_names"),
    )
    label = F.concat(F.lit("label-"), F.col("label").cast("string"))
    chunks = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("doc_id"),
        F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("content"),
        label.alias("topic"),
        F.concat(label, F.lit(".md")).alias("source_file"),
        F.lit("https://example.com").alias("source_url"),
        "embedding",
    )
    out = retrieve_context(
        asked,
        chunks,
        schools.mart(spark, sf),
        schools.dim(spark, sf),
        schools.general(spark, sf),
        question_id="query_id",
    )
    files = F.array_join(F.transform("sources", lambda s: s["source_file"]), "|")
    return out.withColumn("files", files).drop("sources")


CONTEXT = (
    "WITH bt AS ("
    + schools.SQL["text_block"]
    + "), att AS ("
    + schools.SQL["attribute_block"]
    + "), ct AS ("
    + schools.SQL["contact_block"]
    + f"""), docs AS (SELECT 'doc' || doc_id || '.md' AS source_file, 'doc' || doc_id AS topic, text, length(text) AS n
        FROM documents WHERE lang <> 'en' AND length(text) > 0),
    cut AS (SELECT *, unnest(generate_series(0, greatest(CAST(ceil((n - 600) / 3400.0) AS BIGINT), 1) - 1)) AS i FROM docs),
    chunks AS (SELECT md5(source_file || '-' || i || '-' || content) AS id, content, topic, source_file,
        {LETTERS.format("lower(content)")} AS v
      FROM (SELECT *, substr(text, i * 3400 + 1, 4000) AS content FROM cut)),
    q AS (SELECT conv_id || '-' || turn AS query_id, lower(text) AS q, {LETTERS.format("lower(text)")} AS v,
        CASE WHEN conv_id % 3 = 0 THEN 'SUPPLIER#' || lpad((conv_id % (SELECT count(*) FROM supplier))::VARCHAR, 9, '0') END AS name
      FROM conversations WHERE role = 'user'),
    dist AS (SELECT query_id, id, content, topic, source_file, round(list_cosine_distance(q.v, c.v), 6) AS distance
      FROM q, chunks c WHERE list_sum(q.v) > 0 AND list_sum(c.v) > 0),
    top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM dist QUALIFY rank <= 3),
    policy AS (SELECT query_id, min(distance) AS best,
        md5(string_agg(content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS policy_md5,
        string_agg(source_file, '|' ORDER BY rank) AS files FROM top GROUP BY 1),
    context AS (SELECT query_id, name, replace(nullif(concat_ws(chr(10), ballot_text,
        CASE WHEN {any_of(ATTRIBUTE_WORDS)} THEN attribute_text END,
        CASE WHEN {any_of(GENERAL_WORDS)} THEN contact_text END), ''),
        ': ' || name || chr(10), ': ' || lower(name) || chr(10)) AS c
      FROM q LEFT JOIN bt ON bt.school_name_clean = name
        LEFT JOIN att ON att.school_name_clean = name LEFT JOIN ct ON ct.school_name_clean = name),
    gated AS (SELECT *, coalesce(best, 1.0) AS best_distance,
        coalesce(best, 1.0) > 0.6 AND name IS NULL AS out_of_scope
      FROM context LEFT JOIN policy USING (query_id))"""
)


_CHUNKS: dict[tuple[str, str], DataFrame] = {}


def _chunk_table(spark, sf):
    """All documents in two domains, split, encoded and stored once for a session and folder, as
    a document base is: questions come far more often than documents change."""
    place = (spark.sparkContext.applicationId, sf)
    if place not in _CHUNKS:
        _CHUNKS[place] = _build_chunks(spark, sf)
    return _CHUNKS[place]


def _build_chunks(spark, sf):
    docs = table(spark, sf, "documents").withColumn(
        "source_file", F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".md"))
    )

    def domain(condition):
        return docs.filter(condition).select("source_file", "text")

    return build_chunk_table(
        {"policy": domain("lang <> 'en'"), "other": domain("lang = 'en'")},
        lambda df: embed_with(df, "content", letter_encoder, DOCUMENT),
        fresh_path(spark, "chunks"),
        headings=False,
    )


def _question_context(spark, sf):
    """Every question of a user; each third one names a school, over all of them in turn."""
    suppliers = table(spark, sf, "supplier").agg(F.count("*")).scalar()
    number = (F.col("conv_id") % suppliers).cast("string")
    named = F.when(
        F.col("conv_id") % 3 == 0, F.array(F.concat(F.lit("supplier#"), F.lpad(number, 9, "0")))
    ).otherwise(F.array().cast("array<string>"))
    asked = table(spark, sf, "conversations").filter("role = 'user'").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("question_id"),
        F.col("text").alias("question"),
        named.alias("school_names"),
    )
    tables = schools.tables(spark, sf)
    return retrieve_context(
        embed_with(asked, "question", letter_encoder, QUERY),
        _chunk_table(spark, sf),
        tables["mart_school_analysis"],
        tables["dim_school"],
        tables["dim_school_generalinfo"],
        domain="policy",
    )


@query(
    "retrieve_context",
    CONTEXT
    + """SELECT query_id, best_distance, out_of_scope, CASE WHEN NOT out_of_scope THEN policy_md5 END AS policy_md5,
      CASE WHEN NOT out_of_scope THEN files END AS files,
      CASE WHEN NOT out_of_scope THEN coalesce(c, 'No specific school data requested.') END AS school_context,
      NOT out_of_scope AND c IS NOT NULL AS school_context_used FROM gated""",
)
def context(spark, sf):
    """The whole retrieval: every question against the chunks of one domain, and its schools."""
    out = _question_context(spark, sf)
    files = F.array_join(F.transform("sources", lambda s: s["source_file"]), "|")
    return out.select(
        "query_id", "best_distance", "out_of_scope", F.md5("policy_context").alias("policy_md5"),
        files.alias("files"), "school_context", "school_context_used",
    )


@query(
    "context_sources",
    CONTEXT
    + """SELECT query_id, (rank - 1)::INT AS place, topic, source_file FROM top JOIN gated USING (query_id)
      WHERE NOT out_of_scope QUALIFY row_number() OVER (PARTITION BY query_id, source_file ORDER BY rank) = 1""",
)
def context_sources(spark, sf):
    """The first chunk of each file among the sources of an answer."""
    found = _question_context(spark, sf).filter(F.col("sources").isNotNull())
    return unique_sources(found).select("query_id", "place", "topic", "source_file")
