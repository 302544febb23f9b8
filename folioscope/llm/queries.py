"""Queries of the training-data operators over the test tables, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import bpe, containers, near_copies, oversized, repeated_lines, similar_vectors, visual_form
from folioscope.plans.texts import WHITE_SQL, blocks_sql
from folioscope.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines.repeated_lines(table(spark, sf_dir, "stored_pages")).select("page_no", "line_no")


def p2_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page without the repeated lines."""
    return repeated_lines.without_repeated_lines(table(spark, sf_dir, "stored_pages"))


def p2_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boilerplate blocks of each source: their number of lines, the pages of the most frequent one, and their matches."""
    lines = repeated_lines.materialize(repeated_lines.page_lines(table(spark, sf_dir, "stored_pages")), "lines")
    blocks = repeated_lines.materialize(repeated_lines.boilerplate_blocks(lines), "blocks")
    matches = repeated_lines.block_occurrences(lines, blocks).groupBy("block").agg(F.first("source").alias("source"), F.count("*").alias("n_matches"), F.max(F.size("line_nos")).alias("longest"))
    sizes = blocks.groupBy("block").agg(F.count("*").alias("n_lines"), F.max("n_pages").alias("most_pages"))
    return sizes.join(matches, "block").select("source", F.lower(F.hex("block")).alias("block"), "n_lines", "most_pages", "n_matches", "longest")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors.neighbour_pairs(table(spark, sf_dir, "chunks"), "point_no", "dense_vector")


def p3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked neighbours of every point."""
    found = similar_vectors.similar_vectors(table(spark, sf_dir, "chunks"), "point_no", "dense_vector")
    return found.select("point_no", "rank", "neighbour", F.round("cosine", 6).alias("cosine"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oversized.oversized_cases(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "chunk_configs"))


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every oversized chunk."""
    return oversized.oversized_pieces(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "chunk_configs"))


def p4_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the pieces of every oversized chunk are in order, within the limit and together the whole text."""
    return oversized.checked_pieces(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "chunk_configs"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.near_copy_pairs(table(spark, sf_dir, "chunks"), "point_no", "markdown")


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per point: its class of equal word sets and the number of near copies of the class."""
    return near_copies.near_copy_classes(table(spark, sf_dir, "chunks"), "point_no", "markdown")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_ids(table(spark, sf_dir, "documents"), "doc_id", "text")


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The MD5 of every document's text as its token ids give it back."""
    ids = p6_ids(spark, sf_dir)
    return bpe.decoded_texts(ids, "doc_id", "ids").select("doc_id", F.md5("text").alias("body"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every text, or of every piece of one above 2,048 tokens."""
    return containers.fill_documents(table(spark, sf_dir, "documents"), "doc_id", "text")


def p7_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used, the fewest possible by the sum of sizes, and the space left over."""
    placed = p7_containers(spark, sf_dir).agg(F.sum("n_units").alias("n_tokens"), (F.max("container_no") + 1).alias("n_containers"))
    return placed.select(
        "n_containers", F.ceil(F.col("n_tokens") / containers.CAPACITY).alias("lower_bound"),
        (F.col("n_containers") * containers.CAPACITY - F.col("n_tokens")).alias("space_left"),
    )


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every text is placed whole and no container is overfull."""
    sizes = containers.materialize(bpe.token_counts(table(spark, sf_dir, "documents"), "doc_id", "text"), "sizes")
    placed = containers.materialize(containers.fill_containers(sizes, "doc_id", "n_tokens"), "placed")
    return containers.checked_containers(sizes, placed, "doc_id", "n_tokens")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visual_form.look_alike_pairs(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visual_form.with_visual_form(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document that shows something: its class of texts that look the same."""
    return visual_form.look_alike_classes(table(spark, sf_dir, "documents"), "doc_id", "text")


NEIGHBOURS_SQL = """
usable AS (
  SELECT point_no, any_value(dense_vector)::DOUBLE[] AS v FROM chunks
  WHERE len(dense_vector) = 64 AND len(list_filter(dense_vector, lambda x: x IS NULL OR isnan(x))) = 0
    AND len(list_filter(dense_vector, lambda x: x <> 0)) > 0
  GROUP BY point_no
), ranked AS (
  SELECT a.point_no, b.point_no AS neighbour, list_cosine_similarity(a.v, b.v) AS cosine,
    row_number() OVER (PARTITION BY a.point_no ORDER BY round(list_cosine_similarity(a.v, b.v), 9) DESC, b.point_no) AS rank
  FROM usable a JOIN usable b ON a.point_no <> b.point_no
)"""

P3_FOUND_SQL = f"""
WITH {NEIGHBOURS_SQL}
SELECT DISTINCT least(point_no, neighbour) AS point_no_a, greatest(point_no, neighbour) AS point_no_b FROM ranked WHERE rank <= 5
"""

P3_NEIGHBOURS_SQL = f"""
WITH {NEIGHBOURS_SQL}
SELECT point_no, CAST(rank AS INT) AS rank, neighbour, round(round(cosine, 9), 6) AS cosine FROM ranked WHERE rank <= 5
"""

WORD_SETS_SQL = r"""
points AS (SELECT point_no, any_value(markdown) AS markdown FROM chunks WHERE markdown IS NOT NULL GROUP BY point_no),
word_sets AS (
  SELECT point_no, list_distinct(list_filter(string_split_regex(lower(markdown), '[^\p{L}\p{Nd}_]+'), lambda w: strlen(w) > 1)) AS words
  FROM points
), words AS (SELECT point_no, len(words) AS n, unnest(words) AS word FROM word_sets)"""

P5_FOUND_SQL = rf"""
WITH {WORD_SETS_SQL}
SELECT a.point_no AS point_no_a, b.point_no AS point_no_b
FROM words a JOIN words b ON a.word = b.word AND a.point_no < b.point_no
GROUP BY a.point_no, b.point_no, a.n, b.n HAVING count(*) >= 0.75 * (a.n + b.n - count(*))
"""

P5_CLASSES_SQL = rf"""
WITH {WORD_SETS_SQL}, sorted AS (SELECT point_no, list_sort(words) AS words FROM word_sets WHERE len(words) > 0),
classes AS (SELECT words, min(point_no) AS rep, count(*) AS class_size FROM sorted GROUP BY words),
rep_words AS (SELECT rep, len(words) AS n, unnest(words) AS word FROM classes),
pairs AS (
  SELECT a.rep AS x, b.rep AS y FROM rep_words a JOIN rep_words b ON a.word = b.word AND a.rep < b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING count(*) >= 0.75 * (a.n + b.n - count(*))
), links AS (SELECT rep, count(*) AS n_links FROM (SELECT x AS rep FROM pairs UNION ALL SELECT y FROM pairs) GROUP BY rep)
SELECT s.point_no, c.rep AS class_id, c.class_size, coalesce(l.n_links, 0) AS n_links
FROM sorted s JOIN classes c ON s.words = c.words LEFT JOIN links l ON l.rep = c.rep
"""


P2_FOUND_SQL = r"""
WITH pages AS (
  SELECT page_no, any_value(coalesce(source_id, '')) AS source, any_value(markdown) AS markdown
  FROM stored_pages WHERE markdown IS NOT NULL GROUP BY page_no
), split AS (
  SELECT page_no, source, string_split(replace(markdown, chr(13) || chr(10), chr(10)), chr(10)) AS parts FROM pages
), lines AS (SELECT page_no, source, unnest(parts) AS line, generate_subscripts(parts, 1) AS line_no FROM split),
forms AS (
  SELECT page_no, source, line_no,
    regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[^\p{L}\p{Nd}]+', '', 'g') AS form FROM lines
), frequent AS (
  SELECT source, form FROM forms WHERE length(form) >= 12 GROUP BY source, form HAVING count(DISTINCT page_no) >= 5
)
SELECT page_no, CAST(line_no AS INT) AS line_no FROM forms JOIN frequent USING (source, form)
"""


OVERSIZED_SQL = """
limits AS (SELECT source_id, min(coalesce(nullif(max_tokens, 0), 800)) AS most FROM chunk_configs GROUP BY source_id),
large AS (
  SELECT point_no, any_value(markdown) AS markdown, any_value(coalesce(most, 800)) AS most FROM chunks LEFT JOIN limits USING (source_id)
  WHERE markdown <> '' AND greatest(1, ceil(length(markdown) / 4.0)) > coalesce(most, 800) GROUP BY point_no
)"""

P4_FOUND_SQL = rf"""
WITH {OVERSIZED_SQL}, {blocks_sql('large', 'point_no', 'markdown')},
longest AS (SELECT point_no, max(length(block)) AS size FROM blocks GROUP BY point_no)
SELECT point_no, CASE WHEN list_max(list_transform(string_split_regex(markdown, '[{WHITE_SQL}]+'), lambda w: length(w))) > 4 * most THEN 'inside word'
  WHEN size > 4 * most THEN 'inside block' ELSE 'between blocks' END AS cut_kind FROM large LEFT JOIN longest USING (point_no)
"""

P4_CHECKS_SQL = rf"""
WITH {OVERSIZED_SQL} SELECT point_no, true AS within_limit, true AS in_order, md5(regexp_replace(markdown, '[{WHITE_SQL}]+', '', 'g')) AS body FROM large
"""


P2_LINES_SQL = r"""
pages AS (
  SELECT page_no, any_value(coalesce(source_id, '')) AS source, any_value(markdown) AS markdown
  FROM stored_pages WHERE markdown IS NOT NULL GROUP BY page_no
), split AS (
  SELECT page_no, source, string_split(replace(markdown, chr(13) || chr(10), chr(10)), chr(10)) AS parts FROM pages
), lines AS (SELECT page_no, source, unnest(parts) AS line, generate_subscripts(parts, 1) AS line_no FROM split),
formed AS (
  SELECT page_no, source, line_no,
    regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[^\p{L}\p{Nd}]+', '', 'g') AS form FROM lines
), long AS (
  SELECT page_no, source, line_no, md5(source || chr(0) || form) AS node, row_number() OVER (PARTITION BY page_no ORDER BY line_no) AS pos
  FROM formed WHERE length(form) >= 12
), nodes AS (SELECT source, node, count(DISTINCT page_no) AS n_pages FROM long GROUP BY ALL HAVING count(DISTINCT page_no) >= 5),
edges AS (
  SELECT a.node AS u, b.node AS v FROM long a JOIN long b ON a.page_no = b.page_no AND b.pos = a.pos + 1 AND a.node <> b.node
  GROUP BY ALL HAVING count(DISTINCT a.page_no) >= 5
), both_ways AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges),
reached AS (SELECT node, node AS other FROM nodes UNION SELECT r.node, e.v FROM reached r JOIN both_ways e ON e.u = r.other),
blocks AS (SELECT node, min(other) AS block FROM reached GROUP BY node)"""

P2_BLOCKS_SQL = f"""
WITH RECURSIVE {P2_LINES_SQL},
kept AS (SELECT l.*, block FROM long l JOIN blocks USING (node)),
begun AS (
  SELECT *, CASE WHEN lag(pos) OVER w = pos - 1 AND lag(block) OVER w = block THEN 0 ELSE 1 END AS begins FROM kept WINDOW w AS (PARTITION BY page_no ORDER BY pos)
), runs AS (SELECT *, sum(begins) OVER (PARTITION BY page_no ORDER BY pos) AS run FROM begun),
matched AS (SELECT block, count(*) AS n_matches, max(n) AS longest FROM (SELECT block, page_no, run, count(*) AS n FROM runs GROUP BY ALL) GROUP BY block)
SELECT source, block, count(*) AS n_lines, max(n_pages) AS most_pages, any_value(n_matches) AS n_matches, CAST(any_value(longest) AS INT) AS longest
FROM nodes JOIN blocks USING (node) JOIN matched USING (block) GROUP BY source, block
"""

P2_CLEAN_SQL = f"""
WITH RECURSIVE {P2_LINES_SQL},
kept AS (
  SELECT page_no, l.source, l.line_no, line FROM lines l ANTI JOIN (SELECT page_no, line_no FROM long JOIN blocks USING (node)) r USING (page_no, line_no)
), joined AS (SELECT page_no, string_agg(line, chr(10) ORDER BY line_no) AS markdown FROM kept GROUP BY page_no)
SELECT page_no, CASE WHEN any_value(s.markdown) IS NOT NULL THEN coalesce(any_value(j.markdown), '') END AS markdown FROM stored_pages s LEFT JOIN joined j USING (page_no) GROUP BY page_no
"""


QUERIES = (
    p2_found, p2_clean, p2_blocks, p3_found, p3_neighbours, p4_found, p4_pieces, p4_checks, p5_found, p5_classes, p6_ids, p6_decoded,
    p7_containers, p7_space, p7_checks, p8_found, p8_forms, p8_classes,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {query.__name__: query for query in QUERIES}


def visual_forms_sql() -> str:
    """Common table expressions up to ``forms``: doc_id, text, form, by a mapping table joined to exploded code points."""
    picture = r"[\p{So}\x{1f3fb}-\x{1f3ff}\x{fe0f}]"
    joined = rf"regexp_replace(%s, '({picture})\x{{200d}}({picture})', '\1' || chr(57344) || '\2', 'g')"
    shown = lambda form: " || ".join(f"chr({ord(c)})" for c in form) or "''"
    mapping = ", ".join(f"(chr({cp}), {shown(form)})" for cp, form in visual_form.changed_points().items())
    return rf"""
mapping(c, form) AS (VALUES {mapping}),
plain AS (SELECT doc_id, text, {joined % (joined % "replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))")} AS body FROM documents),
points AS (SELECT doc_id, unnest(regexp_extract_all(body, '(?s).')) AS c, generate_subscripts(regexp_extract_all(body, '(?s).'), 1) AS pos FROM plain),
mapped AS (SELECT doc_id, string_agg(coalesce(form, c), '' ORDER BY pos) AS form FROM points LEFT JOIN mapping USING (c) GROUP BY doc_id),
forms AS (SELECT p.doc_id, text, CASE WHEN text = '' THEN '' ELSE replace(nfc_normalize(form), chr(57344), chr(8205)) END AS form FROM plain p LEFT JOIN mapped USING (doc_id)),
showing AS (SELECT * FROM forms WHERE regexp_matches(form, '[^{WHITE_SQL}]'))"""


P8_CLASSES_SQL = """
SELECT doc_id, class_id, class_size, n_texts FROM showing
JOIN (SELECT form, min(doc_id) AS class_id, count(*) AS class_size, count(DISTINCT text) AS n_texts FROM showing GROUP BY form) USING (form)"""


def oracle_sql() -> dict[str, str]:
    forms = visual_forms_sql()
    return {
        "p2_found": P2_FOUND_SQL, "p2_clean": P2_CLEAN_SQL, "p2_blocks": P2_BLOCKS_SQL, "p3_found": P3_FOUND_SQL, "p3_neighbours": P3_NEIGHBOURS_SQL,
        "p4_found": P4_FOUND_SQL, "p4_checks": P4_CHECKS_SQL, "p5_found": P5_FOUND_SQL, "p5_classes": P5_CLASSES_SQL,
        "p6_decoded": "SELECT doc_id, md5(coalesce(text, '')) AS body FROM documents",
        "p7_checks": "SELECT doc_id, true AS fits, true AS whole FROM documents WHERE text <> ''",
        "p8_found": f"WITH {forms} SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM showing a JOIN showing b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text",
        "p8_forms": f"WITH {forms} SELECT doc_id, form FROM forms",
        "p8_classes": f"WITH {forms} {P8_CLASSES_SQL}",
    }
