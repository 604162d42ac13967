"""Queries of chunks and of the sentences that statements rest on."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import chunks
from .registry import query, table

SPACE = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"

#: Each source is a heading, each language one under it; a text's own headings stand under both. The SQL cuts by places of ends, not by a pattern.
CHUNKS = f"""WITH RECURSIVE d AS (SELECT doc_id, '# ' || source || chr(10) || '## ' || lang || chr(10) || chr(10) || text AS text FROM documents),
  l AS (SELECT doc_id, unnest(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS body, generate_subscripts(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), 1) - 1 AS line FROM d),
  f AS (SELECT *, sum(CASE WHEN regexp_matches(body, '^\\s*(```|~~~)') THEN 1 ELSE 0 END) OVER w % 2 = 1 AS fenced FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING)),
  h AS (SELECT *, CASE WHEN NOT fenced AND regexp_matches(body, '^\\s{{0,3}}(#{{1,6}})\\s+(.+?)\\s*#*\\s*$') THEN length(regexp_extract(body, '^\\s{{0,3}}(#{{1,6}})', 1)) END AS level FROM f),
  n AS (SELECT *, level IS NOT NULL OR (NOT fenced AND trim(body, {SPACE}) = '') AS ends FROM h),
  b AS (SELECT *, sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS number FROM n),
  g AS (SELECT doc_id, number, min(line) AS line, trim(string_agg(body, chr(10) ORDER BY line), {SPACE}) AS block FROM b WHERE NOT ends GROUP BY doc_id, number),
  u AS (SELECT a.doc_id, a.line, a.level, trim(regexp_extract(a.body, '^\\s{{0,3}}(#{{1,6}})\\s+(.+?)\\s*#*\\s*$', 2)) AS title, min(z.line) AS until FROM h a LEFT JOIN h z ON z.doc_id = a.doc_id AND z.line > a.line AND z.level <= a.level WHERE a.level IS NOT NULL GROUP BY ALL),
  t AS (SELECT g.doc_id, g.line, g.block, coalesce(string_agg(u.title, ' > ' ORDER BY u.level), '') AS heading FROM g LEFT JOIN u ON u.doc_id = g.doc_id AND u.line < g.line AND (u.until IS NULL OR u.until > g.line) WHERE g.block <> '' GROUP BY ALL),
  p AS (SELECT doc_id, line, heading, block AS rest, 0 AS part, NULL::VARCHAR AS chunk FROM t UNION ALL
    SELECT doc_id, line, heading, ltrim(rest[cut + 1:], {SPACE}), part + 1, rtrim(rest[:cut], {SPACE}) FROM (
      SELECT *, CASE WHEN length(rest) <= 1800 THEN length(rest) ELSE coalesce(list_max(list_filter(range(1081, 1801), lambda i: contains('。！？.!?；;' || chr(10), rest[i]))), 1800) END AS cut FROM p WHERE rest <> ''))
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line, part) AS block, part, heading, chunk FROM p WHERE chunk IS NOT NULL"""


@query("text_chunks", CHUNKS)
def text_chunks(spark, d):
    head = F.concat(F.lit("# "), "source", F.lit("\n## "), "lang", F.lit("\n\n"), "text")
    return chunks.chunks(table(spark, d, "documents").select("doc_id", head.alias("text")), "doc_id")


@query("supporting_sentences")
def supporting_sentences(spark, d):
    """Of each answer, what of the turn before it rests on; the whole answer is proposed as the quote."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = table(spark, d, "conversations").withColumn("source", before).where("source is not null")
    found = chunks.supported(rows.withColumn("proposed", F.col("text")), "text")
    return found.select("conv_id", "turn", "quote", "match")
