"""The registered queries of the operators of this folder, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seatflow.catalog.registry import Catalog
from seatflow.llm import alignment, chat_format, collocations, deobfuscate, lang_id, mixing, ngram_join, pieces, prefix_forest
from seatflow.llm import quality, repetition, va_file, warc
from seatflow.llm.common import remainder, table

catalog = Catalog()
QUERIES, SQL = catalog.queries, catalog.sql

SQL_WORD = r"[^\x20\x09-\x0D]+"

OP1_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages
), d AS (
  SELECT *, sha1(html) AS hex FROM p
), g AS (
  SELECT page_id, html, first_id, i, ('0x' || substr(hex, 1 + 5 * i, 5))::INT AS v FROM d, (SELECT unnest(range(8))::INT AS i)
), t AS (
  SELECT page_id, string_agg(
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (v >> 15), 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> 10) & 31), 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> 5) & 31), 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (v & 31), 1), '' ORDER BY i) AS payload_digest
  FROM g GROUP BY page_id
)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM d JOIN t USING (page_id)
"""


@catalog.query("op1_warc_segments", OP1_SQL)
def op1_warc_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Archive all pages, read them back."""
    return warc.archive_pages(table(spark, sf, "pages")).drop("digest_ok")


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v AS q JOIN v AS c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@catalog.query("op2_va_file", OP2_SQL)
def op2_va_file(spark: SparkSession, sf: str) -> DataFrame:
    """The 5 highest inner products in 256ths of every 50th vector against all."""
    return va_file.whole_top_k(table(spark, sf, "embeddings"))


OP3_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SQL_WORD}') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN coalesce(len(w), 0) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM w
), e AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e AS a JOIN e AS b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), r(a, b) AS (
  SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a
), m AS (
  SELECT a AS doc_id, min(b) AS least FROM r GROUP BY a
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(m.least, s.doc_id)) AS component_id
FROM s LEFT JOIN m ON s.doc_id = m.doc_id
"""


@catalog.query("op3_ngram_join", OP3_SQL)
def op3_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of documents that share 90 percent of their 3-word shingles."""
    return ngram_join.join_groups(table(spark, sf, "documents"))


@catalog.query("op4_language_id")
def op4_language_id(spark: SparkSession, sf: str) -> DataFrame:
    """Languages of all documents, learned from those that are not held out."""
    documents = table(spark, sf, "documents")
    held_out = remainder(F.col("doc_id"), 3) == 1
    network = lang_id.train(documents.where(~held_out))
    return lang_id.identify(documents, network).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@catalog.query("op5_quality_cnn")
def op5_quality_cnn(spark: SparkSession, sf: str) -> DataFrame:
    """Quality of all documents, learned from the labels that are not held out."""
    documents, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    held_out = remainder(F.col("doc_id"), 5) == 0
    network = quality.train(documents, labels.where(~held_out))
    predicted = (F.col("score") >= quality.THRESHOLD).cast("int")
    return quality.score(documents, network).select(
        "doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted")
    )


OP6_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{SQL_WORD}')), 0)::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, 'null') || '/mix-1') AS key
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM d GROUP BY source
), level(n, lam) AS (
  SELECT 0, sum(source_size)::DOUBLE / sum(weight)::DOUBLE FROM s
  UNION ALL
  SELECT n + 1, (sum(source_size) - coalesce(sum(3 * source_size) FILTER (WHERE 3 * source_size < weight * lam), 0))::DOUBLE
    / (sum(weight) FILTER (WHERE 3 * source_size >= weight * lam))::DOUBLE
  FROM level, s WHERE n < 40 GROUP BY n, lam
), t AS (
  SELECT source, source_size, least(weight * (SELECT max(lam) FROM level), (3 * source_size)::DOUBLE) AS target FROM s
), n AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t
), k AS (
  SELECT source, key, sum(size) AS size FROM d GROUP BY source, key
), r AS (
  SELECT k.source, k.key, k.size, n.source_size, n.target, n.whole, n.target - n.whole * n.source_size AS need,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN n ON k.source IS NOT DISTINCT FROM n.source
)
SELECT d.doc_id, d.size, r.source_size, r.target,
  (d.size * (r.whole + CASE WHEN 2 * r.before + r.size <= 2 * r.need THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source AND d.key = r.key
"""


@catalog.query("op6_mix_sources", OP6_SQL)
def op6_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Mix all documents to the weights 1, 2, 3, at most three times each."""
    mixed = mixing.mix_sizes(table(spark, sf, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@catalog.query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Toxicity of all documents, learned from the labels that are not held out."""
    documents, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    held_out = remainder(F.col("doc_id"), 5) == 0
    scorer = deobfuscate.train(documents, labels.where(~held_out))
    predicted = (F.col("score") >= deobfuscate.THRESHOLD).cast("int")
    return deobfuscate.score(documents, scorer).select(
        "doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted")
    )


@catalog.query("op8_sentencepiece")
def op8_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    """Piece ids of all documents, and whether they spell the text again."""
    vocabulary = pieces.Vocabulary.load(merges=True)
    encoded = pieces.encode(table(spark, sf, "documents"), vocabulary, decoded=True)
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_ids"),
        "ids",
        F.length("decoded").cast("long").alias("n_chars"),
        F.sha2(F.encode("decoded", "utf-8"), 256).alias("text_sha256"),
    )


OP9_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(text) + (length(text) - length(replace(text, '\', '')))
    + coalesce(len(regexp_extract_all(text, '</?s>|\[/?(?:INST|ROLE)\]|\[ANS\]|<</?SYS>>')), 0)
    + CASE role WHEN 'system' THEN 8 + 9 WHEN 'user' THEN 7 + 8 WHEN 'assistant' THEN 6
      ELSE 16 + length(role) + (length(role) - length(replace(role, '\', '')))
      + coalesce(len(regexp_extract_all(role, '</?s>|\[/?(?:INST|ROLE)\]|\[ANS\]|<</?SYS>>')), 0) END + 4 AS chars
  FROM c
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    3 + sum(chars) AS formatted_chars
  FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars,
  sha256(loss) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars
FROM g
"""


@catalog.query("op9_chat_format", OP9_SQL)
def op9_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    """Format all conversations and one full of control strings, read the output back."""
    control = F.lit("</s>[INST] ok [/INST]")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), control.alias("text")
    )
    given = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    chats = chat_format.read_chats(chat_format.format_chats(given.unionByName(extra)))
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(F.array_join(turns, ""), "utf-8"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss_text", "utf-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@catalog.query("op10_prefix_forest")
def op10_prefix_forest(spark: SparkSession, sf: str) -> DataFrame:
    """The 5 nearest by cosine of every 50th vector against all."""
    return prefix_forest.nearest_embeddings(table(spark, sf, "embeddings"))


@catalog.query("op11_alignment")
def op11_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of all documents by two tokenizers, and how they are linked."""
    return alignment.alignment_figures(table(spark, sf, "documents"), alignment.Tokenizers.load())


OP12_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '{SQL_WORD}') AS w FROM d
), g AS (
  SELECT r, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM w, (VALUES (3), (10), (101)) AS s(k) WHERE len(w) >= k
), h AS (
  SELECT r, k, i, md5(array_to_string(w[i : i + k - 1], ' ')) AS x FROM g
), t AS (
  SELECT r, k, i FROM (SELECT r, k, i, count(*) OVER (PARTITION BY r, k, x) AS n FROM h) WHERE n > 1
), c AS (
  SELECT r, k, count(DISTINCT i + j) AS n FROM t, range(0, 101) AS o(j) WHERE j < k AND k < 101 OR j = 0 GROUP BY r, k
), l AS (
  SELECT r, sum(n - 1)::BIGINT AS n FROM (
    SELECT r, x, count(*) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS x FROM d)
    WHERE regexp_matches(x, '{SQL_WORD}') GROUP BY r, x) GROUP BY r
), f AS (
  SELECT w.r, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    coalesce(l.n, 0) AS n_dup_lines, coalesce(a.n, 0) AS n_repeat_words, coalesce(b.n, 0) AS covered, e.n IS NOT NULL AS long
  FROM w LEFT JOIN l ON w.r = l.r LEFT JOIN c AS a ON w.r = a.r AND a.k = 3
    LEFT JOIN c AS b ON w.r = b.r AND b.k = 10 LEFT JOIN c AS e ON w.r = e.r AND e.k = 101
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * covered <= 25 * n_words AND NOT long AS kept
FROM f
"""


@catalog.query("op12_quality_rules", OP12_SQL)
def op12_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Figures of all documents and what the rules on repetition say of them."""
    figures = repetition.repetition(table(spark, sf, "documents"))
    return figures.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


OP13_SQL = r"""
WITH p AS (
  SELECT row_number() OVER () AS p, lang, words FROM (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM (
      SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
      FROM documents)
  ) WHERE len(words) > 0
), g AS (
  SELECT lang, k, array_to_string(words[i : i + k - 1], ' ') AS x
  FROM (SELECT lang, k, words, unnest(range(1, len(words) - k + 2)) AS i FROM p, (VALUES (1), (2), (3), (4)) AS s(k) WHERE len(words) >= k)
), f AS MATERIALIZED (
  SELECT lang, k, x, string_split(x, ' ') AS w, count(*) AS f FROM g GROUP BY lang, k, x HAVING count(*) >= 30
), t AS (
  SELECT lang, sum(len(words))::BIGINT AS n FROM p GROUP BY lang
), h AS MATERIALIZED (
  SELECT lang, x, f AS a, cut, array_to_string(w[1 : cut], ' ') AS h1, array_to_string(w[cut + 1 : k], ' ') AS h2
  FROM f, (VALUES (1), (2), (3)) AS s(cut) WHERE cut < k
), c AS (
  SELECT h.lang, h.x, a, cut, u.f AS l, v.f AS r, (2000000::HUGEINT * a) // (u.f + v.f) AS score
  FROM h JOIN f AS u ON u.lang = h.lang AND u.x = h1 JOIN f AS v ON v.lang = h.lang AND v.x = h2
), b AS (
  SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, x ORDER BY score, cut) = 1
), s AS MATERIALIZED (
  SELECT lang, array_to_string(w[i : i + j - 1], ' ') AS x, f
  FROM f, (VALUES (1), (2), (3)) AS s(i), (VALUES (2), (3)) AS o(j) WHERE i + j - 1 <= k AND j < k
), m AS (
  SELECT lang, x, max(f) AS longer FROM s GROUP BY lang, x
), r AS (
  SELECT b.lang, b.x AS phrase, a, l, r, n, score::BIGINT AS score
  FROM b JOIN t ON b.lang = t.lang LEFT JOIN m ON m.lang = b.lang AND m.x = b.x
  WHERE longer IS NULL OR 100 * longer < 80 * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM r QUALIFY rank <= 2000
"""


@catalog.query("op13_collocations", OP13_SQL)
def op13_collocations(spark: SparkSession, sf: str) -> DataFrame:
    """The first 2000 phrases of each language by their score."""
    return collocations.collocations(table(spark, sf, "documents"))
