"""Queries on text functions, identities and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import ids, text
from folioscope.functions.urls import canonical_url, in_scope
from folioscope.operators.chunking import WHITE, chunk_documents, document_blocks
from folioscope.operators.crawl import resolve_url
from folioscope.operators.index import chunk_points
from folioscope.operators.sparse import document_frequency, postings, sparse_vectors, term_frequency
from folioscope.session import table

c = F.col


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored pages, a row per page_no; redeliveries are equal, so any of them."""
    return table(spark, sf_dir, "stored_pages").dropDuplicates(["page_no"])


PAGES = "pages AS (SELECT DISTINCT ON (page_no) * FROM stored_pages)"


def content_hashes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", ids.content_hash(c("text")).alias("content_hash"), text.token_estimate(c("text")).alias("tokens"))


def document_ids(spark, sf_dir):
    own = ids.artifact_document_id(c("source_id"), c("version"), c("url"))
    stored = ids.store_document_id(c("source_id"), c("url"))
    return pages(spark, sf_dir).select("page_no", own.alias("document_id"), ids.document_filename(own).alias("filename"), ids.stored_point_id(stored).alias("document_point_id"))


def point_ids(spark, sf_dir):
    chunks = table(spark, sf_dir, "chunks").dropDuplicates(["point_no"])
    digest = ids.chunk_point_id(c("source_id"), c("version"), c("url"), c("content_hash"), c("chunk_index"))
    return chunks.select("point_no", digest.alias("point_id"), ids.stored_point_id(digest).alias("stored_id"))


def embedding_inputs(spark, sf_dir):
    chunks = table(spark, sf_dir, "chunks").dropDuplicates(["point_no"])
    body = text.embedding_text(c("title"), c("heading_path"), c("url"), c("markdown"))
    return chunks.select("point_no", F.sha2(body, 256).alias("input_hash"), text.title_or_url(c("title"), c("url")).alias("shown_as"))


def normalized_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalized_text(c("text"))).alias("form"))


def word_sets(spark, sf_dir):
    words = text.word_set(c("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(words).alias("n_words"), F.md5(F.array_join(F.array_sort(words), " ")).alias("words"))


def lexical_tokens(spark, sf_dir):
    return term_frequency(table(spark, sf_dir, "documents"), "doc_id", "text")


def identifier_parts(spark, sf_dir):
    vocabulary = table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"\s+")).alias("word")).where("word <> ''").distinct()
    return vocabulary.select("word", F.array_join(text.identifier_parts(c("word")), " ").alias("parts"))


def term_hashes(spark, sf_dir):
    vocabulary = table(spark, sf_dir, "documents").select(F.explode(text.lexical_tokens(c("text"))).alias("token")).distinct()
    return vocabulary.select("token", text.fnv1a32(c("token")).alias("term"))


def sparse_vector(spark, sf_dir):
    found = sparse_vectors(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", F.size("indices").alias("n_terms"), F.element_at("indices", 1).alias("first_term"), F.element_at("indices", -1).alias("last_term"),
                        F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x.cast("double")), 3).alias("weight"))  # fmt: skip


def document_frequency_idf(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = document_frequency(postings(docs, "doc_id", "text"), docs.count())
    return found.select("term", "df", F.round("idf", 9).alias("idf"))


def url_canonical(spark, sf_dir):
    rows = table(spark, sf_dir, "page_snapshots").where("url is not null and url <> ''").select("url").distinct()
    return rows.select("url", canonical_url(c("url")).alias("canonical_url"))


def link_scope(spark, sf_dir):
    """Every stored page against the seed of its source and version."""
    seeds = table(spark, sf_dir, "sources").select("source_id", F.coalesce("version", F.lit("")).alias("v"), "seed_url")
    joined = pages(spark, sf_dir).withColumn("v", F.coalesce("version", F.lit(""))).join(seeds, ["source_id", "v"])
    return joined.select("page_no", in_scope(canonical_url(c("url")), canonical_url(c("seed_url"))).alias("in_scope"))


def url_resolved(spark, sf_dir):
    """A relative and a rooted reference on every stored page, resolved and made canonical."""
    href = F.when(c("page_no") % 2 == 0, F.concat(F.lit("../p"), c("page_no").cast("string"), F.lit("#top"))).otherwise(F.concat(F.lit("/x/./p"), c("page_no").cast("string")))
    return pages(spark, sf_dir).select("page_no", canonical_url(resolve_url(c("url"), href)).alias("target"))


def safe_names(spark, sf_dir):
    versions = table(spark, sf_dir, "sources").select("source_id", "version", "display_name", "seed_url")
    return versions.select("source_id", "version", ids.safe_name(c("display_name")).alias("name"), ids.safe_name(F.coalesce("version", F.lit(""))).alias("label"), ids.safe_path(c("seed_url")).alias("path"))


def timestamps(spark, sf_dir):
    """Times as RFC 3339 text with microseconds and back; text that is no time gives null."""
    rows = table(spark, sf_dir, "manifests").select("manifest_no", text.rfc3339(c("started_at")).alias("started"), "started_at")
    return rows.select("manifest_no", "started", (text.from_rfc3339(c("started")) == c("started_at")).alias("same"), text.from_rfc3339(F.concat(F.lit("no "), "started")).isNull().alias("refused"))


def shown_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks with their heading path as one text and their token estimate."""
    return chunks.withColumn("tokens", text.token_estimate(c("markdown"))).withColumn("headings", F.array_join("heading_path", " > ")).drop("heading_path")


def markdown_blocks(spark, sf_dir):
    """The blocks of all documents with their heading paths."""
    found = document_blocks(table(spark, sf_dir, "documents"), ["doc_id"], "text")
    return found.select("doc_id", "block_no", F.array_join("heading_path", " > ").alias("headings"), F.md5("block").alias("block"))


def chunked_pages(spark, sf_dir):
    return shown_chunks(chunk_documents(pages(spark, sf_dir), ["page_no"], "markdown"))


def document_chunks(spark, sf_dir):
    """The chunks of all documents, whatever their length, lines and script; null and blank ones give none."""
    return shown_chunks(chunk_documents(table(spark, sf_dir, "documents"), ["doc_id"], "text"))


def indexed_points(spark, sf_dir):
    """Points of all stored pages: ids, hashes and heading paths of the chunks."""
    docs = pages(spark, sf_dir).withColumnRenamed("source_id", "source")
    return chunk_points(docs).select("point_id", "url", "chunk_index", F.array_join("heading_path", " > ").alias("headings"), "input_hash")


WHITE_SQL = r"\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WHITE_CHARS_SQL = " || ".join(f"chr({ord(x)})" for x in WHITE)


def blocks_sql(source: str, key: str, column: str) -> str:
    """Common table expressions up to ``blocks``: key, block_no, block, path. A block begins at a heading or behind a blank line."""
    path = ", ".join(
        f"CASE WHEN last_level >= {j} THEN CASE WHEN h{j}.l = {j} THEN h{j}.t ELSE '' END END" for j in range(1, 7)
    )
    levels = ", ".join(f"last_value(CASE WHEN level <= {j} THEN {{'l': level, 't': heading}} END IGNORE NULLS) OVER upto AS h{j}" for j in range(1, 7))
    return rf"""
cut_lines AS (SELECT {key}, string_split(replace({column}, chr(13) || chr(10), chr(10)), chr(10)) AS parts FROM {source} WHERE {column} IS NOT NULL),
numbered AS (SELECT {key}, unnest(parts) AS line, generate_subscripts(parts, 1) AS no FROM cut_lines),
bared AS (SELECT *, trim(line, {WHITE_CHARS_SQL}) AS bare FROM numbered),
toggled AS (SELECT *, starts_with(bare, '```') OR starts_with(bare, '~~~') AS toggles FROM bared),
fenced AS (SELECT *, coalesce(sum(toggles::INT) OVER (PARTITION BY {key} ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS fenced FROM toggled),
headed AS (
  SELECT *, NOT fenced AND NOT toggles AND regexp_matches(line, '^#{{1,6}}[	
 ]+.+$') AS is_heading, bare <> '' OR fenced AS content FROM fenced
), leveled AS (
  SELECT *, CASE WHEN is_heading THEN length(regexp_extract(line, '^#+')) END AS level,
    CASE WHEN is_heading THEN trim(regexp_extract(line, '^#+[	
 ]+(.+?)[	
 ]*$', 1), {WHITE_CHARS_SQL}) END AS heading,
    content AND (is_heading OR NOT coalesce(lag(content) OVER (PARTITION BY {key} ORDER BY no), false)) AS begins FROM headed
), placed AS (
  SELECT {key}, no, line, content, sum(begins::INT) OVER upto AS nth, last_value(level IGNORE NULLS) OVER upto AS last_level, {levels}
  FROM leveled WINDOW upto AS (PARTITION BY {key} ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), blocks AS (
  SELECT {key}, nth - 1 AS block_no, trim(string_agg(line, chr(10) ORDER BY no), {WHITE_CHARS_SQL}) AS block,
    any_value(list_filter([{path}], lambda x: x IS NOT NULL)) AS path
  FROM placed WHERE content GROUP BY {key}, nth
)"""


def chunks_sql(source: str, key: str, column: str, most: int = 800, overlap: int = 100) -> str:
    """Common table expressions up to ``chunked``: key, chunk_index, path, markdown. Needs WITH RECURSIVE.

    Long blocks are cut into runs of words, one run a step, and the parts of a text are packed, one chunk a step.
    """
    estimate = "CAST(greatest(1, ceil(length({0}) / 4.0)) AS BIGINT)".format
    return rf"""
{blocks_sql(source, key, column)},
sized AS (SELECT *, {estimate('block')} > {most} AND NOT starts_with(block, '```') AND NOT starts_with(block, '~~~') AS long FROM blocks),
worded AS (SELECT {key}, block_no, path, list_filter(string_split_regex(block, '[{WHITE_SQL}]+'), lambda w: w <> '') AS words FROM sized WHERE long),
summed AS (SELECT *, list_transform(range(1, len(words) + 1), lambda i: list_sum(list_transform(words[1:i], lambda w: length(w) + 1))) AS ends FROM worded),
runs AS (
  SELECT {key}, block_no, 0 AS piece_no, 0::BIGINT AS skipped, greatest(1, len(list_filter(ends, lambda e: e <= {4 * most + 1}))) AS after FROM summed
  UNION ALL
  SELECT r.{key}, r.block_no, piece_no + 1, after, greatest(after + 1, len(list_filter(ends, lambda e: e <= ends[after] + {4 * most + 1})))
  FROM runs r JOIN summed s ON s.{key} = r.{key} AND s.block_no = r.block_no WHERE after < len(words)
), parts AS (
  SELECT {key}, block_no, 0 AS piece_no, block AS part, path FROM sized WHERE NOT long
  UNION ALL SELECT r.{key}, r.block_no, piece_no, array_to_string(words[skipped + 1:after], ' '), path FROM runs r JOIN summed s ON s.{key} = r.{key} AND s.block_no = r.block_no
), listed_parts AS (
  SELECT {key}, list(part ORDER BY block_no, piece_no) AS parts, list(path ORDER BY block_no, piece_no) AS paths, list({estimate('part')} ORDER BY block_no, piece_no) AS sizes FROM parts GROUP BY {key}
), totals AS (
  SELECT *, len(sizes) AS n, list_transform(range(0, len(sizes) + 1), lambda i: coalesce(list_sum(sizes[1:i]), 0)) AS total FROM listed_parts
), packed AS (
  SELECT {key}, -1 AS chunk_index, 0::BIGINT AS low, 0::BIGINT AS high, 0::BIGINT AS next_low, 0::BIGINT AS over_from, 0::BIGINT AS size_from FROM totals
  UNION ALL
  SELECT {key}, chunk_index + 1, low, CASE WHEN over THEN e1 WHEN e2 IS NOT NULL THEN e2 + 1 ELSE n END,
    CASE WHEN over THEN greatest(low, len(list_filter(total, lambda t: t <= total[e1 + 1] - {overlap})) - 1) WHEN e2 IS NOT NULL THEN e2 + 1 ELSE n END,
    CASE WHEN over THEN e1 + 1 WHEN e2 IS NOT NULL THEN e2 + 1 ELSE n END, CASE WHEN over THEN e1 WHEN e2 IS NOT NULL THEN e2 + 1 ELSE n END
  FROM (
    SELECT *, e1 IS NOT NULL AND (e2 IS NULL OR e1 <= e2) AS over FROM (
      SELECT p.{key}, p.chunk_index, p.next_low AS low, t.n, t.total,
        list_filter(range(p.over_from, t.n), lambda i: i > p.next_low AND t.total[i + 2] - t.total[p.next_low + 1] > {most})[1] AS e1,
        list_filter(range(p.size_from, t.n), lambda i: t.sizes[i + 1] > {most})[1] AS e2
      FROM packed p JOIN totals t ON t.{key} = p.{key} WHERE p.next_low < t.n))
), chunked AS (
  SELECT p.{key}, chunk_index, t.paths[high] AS path, trim(array_to_string(t.parts[low + 1:high], chr(10) || chr(10)), {WHITE_CHARS_SQL}) || chr(10) AS markdown
  FROM packed p JOIN totals t ON t.{key} = p.{key} WHERE chunk_index >= 0
)"""


SHOWN_CHUNKS_SQL = "SELECT {0}, CAST(chunk_index AS INT) AS chunk_index, markdown, CAST(greatest(1, ceil(length(markdown) / 4.0)) AS INT) AS tokens, array_to_string(path, ' > ') AS headings FROM chunked"
TOKENS = r"""
raw_tokens AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}][\p{L}\p{N}_.:/@-]*')) AS token FROM documents),
marked AS (
  SELECT doc_id, lower(token) AS whole, unnest(string_split_regex(
    regexp_replace(regexp_replace(token, '([\p{L}\p{Nd}])(\p{Lu}\p{Ll})', '\1' || chr(1) || '\2', 'g'), '(\p{Ll})(\p{Lu})', '\1' || chr(1) || '\2', 'g'),
    '[^\p{L}\p{Nd}]+')) AS part FROM raw_tokens
), tokens AS (
  SELECT doc_id, lower(token) AS token FROM raw_tokens
  UNION ALL SELECT doc_id, lower(part) FROM marked WHERE strlen(part) > 1 AND lower(part) <> whole
)"""
FNV = "list_reduce(list_concat([2166136261::HUGEINT], list_transform(range(strlen({0})), lambda i: ('0x' || substr(hex(encode({0})), 2 * i + 1, 2))::INT::HUGEINT)), lambda h, y: (xor(h, y) * 16777619) % 4294967296)::BIGINT"
VOCABULARY = f"vocabulary AS (SELECT token, {FNV.format('token')} AS term FROM (SELECT DISTINCT token FROM tokens))"
POSTINGS = "counted AS (SELECT doc_id, token, count(*) AS n FROM tokens GROUP BY doc_id, token), posted AS (SELECT doc_id, term, sum(n) AS n, CAST(1 + ln(sum(n)) AS FLOAT) AS weight FROM counted JOIN vocabulary USING (token) GROUP BY doc_id, term)"
SPACE = r"[\s\x0b\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
EMBEDDING_TEXT = """
  CASE WHEN coalesce(title, '') <> '' THEN 'Title: ' || title || chr(10) ELSE '' END
  || CASE WHEN array_to_string(list_transform(coalesce(heading_path, []), lambda h: coalesce(h, '')), ' > ') <> ''
     THEN 'Headings: ' || array_to_string(list_transform(heading_path, lambda h: coalesce(h, '')), ' > ') || chr(10) ELSE '' END
  || CASE WHEN coalesce(url, '') <> '' THEN 'URL: ' || url || chr(10) ELSE '' END || 'Content:' || chr(10) || coalesce(markdown, '')"""
UUID = "substr({0}, 1, 8) || '-' || substr({0}, 9, 4) || '-' || substr({0}, 13, 4) || '-' || substr({0}, 17, 4) || '-' || substr({0}, 21, 12)"

from folioscope.plans.snapshots import CANONICAL_URL_SQL  # noqa: E402

SQL = {
    content_hashes: "SELECT doc_id, sha256(text) AS content_hash, CAST(greatest(1, ceil(length(text) / 4.0)) AS INT) AS tokens FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, NULL, 1 FROM documents WHERE text IS NULL",
    document_ids: f"""
WITH {PAGES}, hashed AS (
  SELECT page_no, sha256(source_id || chr(0) || coalesce(version, '') || chr(0) || url) AS document_id, sha256('document' || chr(0) || source_id || chr(0) || url) AS d FROM pages
) SELECT page_no, document_id, 'documents/' || left(document_id, 24) || '.md' AS filename, {UUID.format('d')} AS document_point_id FROM hashed""",
    point_ids: f"""
WITH hashed AS (
  SELECT DISTINCT point_no, sha256(source_id || chr(0) || coalesce(version, '') || chr(0) || coalesce(url, '') || chr(0) || coalesce(content_hash, '') || chr(0) || coalesce(chunk_index::VARCHAR, '')) AS point_id FROM chunks
) SELECT point_no, point_id, {UUID.format('point_id')} AS stored_id FROM hashed""",
    embedding_inputs: f"SELECT DISTINCT point_no, sha256({EMBEDDING_TEXT}) AS input_hash, coalesce(nullif(title, ''), url) AS shown_as FROM chunks",
    normalized_texts: f"SELECT doc_id, md5(trim(regexp_replace(lower(text), '{SPACE}', ' ', 'g'), ' ')) AS form FROM documents",
    word_sets: r"""
WITH w AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}\p{Nd}_]+'), lambda x: strlen(x) > 1)) AS words FROM documents)
SELECT doc_id, CAST(len(words) AS INT) AS n_words, md5(array_to_string(list_sort(words), ' ')) AS words FROM w""",
    lexical_tokens: f"WITH {TOKENS} SELECT doc_id, token, count(*) AS n FROM tokens GROUP BY doc_id, token",
    identifier_parts: r"""
WITH words AS (SELECT DISTINCT word FROM (SELECT unnest(string_split_regex(text, '[\s\x0b]+')) AS word FROM documents) WHERE word <> '')
SELECT word, array_to_string(list_filter(string_split_regex(
  regexp_replace(regexp_replace(word, '([\p{L}\p{Nd}])(\p{Lu}\p{Ll})', '\1' || chr(1) || '\2', 'g'), '(\p{Ll})(\p{Lu})', '\1' || chr(1) || '\2', 'g'),
  '[^\p{L}\p{Nd}]+'), lambda x: x <> ''), ' ') AS parts FROM words""",
    term_hashes: f"WITH {TOKENS}, {VOCABULARY} SELECT token, term FROM vocabulary",
    sparse_vector: f"""
WITH {TOKENS}, {VOCABULARY}, {POSTINGS}
SELECT doc_id, CAST(count(*) AS INT) AS n_terms, min(term) AS first_term, max(term) AS last_term, round(sum(weight::DOUBLE), 3) AS weight FROM posted GROUP BY doc_id""",
    document_frequency_idf: f"""
WITH {TOKENS}, {VOCABULARY}, {POSTINGS}, n AS (SELECT count(*) AS n FROM documents)
SELECT term, count(*) AS df, round(ln(1 + (any_value(n.n) - count(*) + 0.5) / (count(*) + 0.5)), 9) AS idf FROM posted, n GROUP BY term""",
    url_canonical: f"WITH page_rows AS (SELECT DISTINCT url FROM page_snapshots WHERE url IS NOT NULL AND url <> ''), {CANONICAL_URL_SQL} SELECT url, canonical_url FROM canonical",
    link_scope: r"""
WITH p AS (SELECT DISTINCT page_no, url, source_id, coalesce(version, '') AS v FROM stored_pages),
j AS (
  SELECT page_no, lower(regexp_extract(p.url, '^([^:/?#]+://[^/?#]*)', 1)) AS o, regexp_extract(p.url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) AS path,
    lower(regexp_extract(s.seed_url, '^([^:/?#]+://[^/?#]*)', 1)) AS so, rtrim(regexp_extract(s.seed_url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '/') AS base
  FROM p JOIN sources s ON s.source_id = p.source_id AND coalesce(s.version, '') = p.v
) SELECT page_no, o = so AND (base = '' OR path = base OR starts_with(path, base || '/')) AS in_scope FROM j""",
    safe_names: r"""
SELECT source_id, version,
  left(coalesce(nullif(trim(regexp_replace(lower(display_name), '[^a-z0-9]', '_', 'g'), '_'), ''), 'source'), 24) AS name,
  left(coalesce(nullif(trim(regexp_replace(lower(coalesce(version, '')), '[^a-z0-9]', '_', 'g'), '_'), ''), 'source'), 24) AS label,
  replace(replace(replace(seed_url, '/', '_'), '\', '_'), '..', '_') AS path FROM sources""",
    timestamps: "SELECT manifest_no, strftime(started_at AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.%fZ') AS started, true AS same, true AS refused FROM manifests",
}

SQL[url_resolved] = rf"""
WITH {PAGES}, page_rows AS (
  SELECT page_no, regexp_extract(url, '^[A-Za-z]+://[^/?#]*') || CASE WHEN page_no % 2 = 0
    THEN regexp_replace(regexp_extract(regexp_replace(url, '[?#].*$', ''), '^[A-Za-z]+://[^/]*(.*)$', 1), '[^/]*$', '') || '../p' || page_no ELSE '/x/p' || page_no END AS url FROM pages
), {CANONICAL_URL_SQL} SELECT page_no, canonical_url AS target FROM canonical"""

SQL[markdown_blocks] = f"WITH {blocks_sql('documents', 'doc_id', 'text')} SELECT doc_id, CAST(block_no AS INT) AS block_no, array_to_string(path, ' > ') AS headings, md5(block) AS block FROM blocks"
SQL[chunked_pages] = f"WITH RECURSIVE {PAGES}, {chunks_sql('pages', 'page_no', 'markdown')} {SHOWN_CHUNKS_SQL.format('page_no')}"
SQL[document_chunks] = f"WITH RECURSIVE {chunks_sql('documents', 'doc_id', 'text')} {SHOWN_CHUNKS_SQL.format('doc_id')}"
SQL[indexed_points] = f"""
WITH RECURSIVE {PAGES}, {chunks_sql('pages', 'page_no', 'markdown')}, points AS (
  SELECT p.url, p.title, chunk_index, path AS heading_path, c.markdown,
    sha256(source_id || chr(0) || coalesce(version, '') || chr(0) || coalesce(p.url, '') || chr(0) || coalesce(content_hash, '') || chr(0) || chunk_index) AS d
  FROM chunked c JOIN pages p USING (page_no)
) SELECT {UUID.format('d')} AS point_id, url, CAST(chunk_index AS INT) AS chunk_index, array_to_string(heading_path, ' > ') AS headings, sha256({EMBEDDING_TEXT}) AS input_hash FROM points"""

QUERIES = tuple(SQL)


def queries():
    return {query.__name__: query for query in QUERIES}


def oracle_sql():
    return {query.__name__: sql for query, sql in SQL.items()}
