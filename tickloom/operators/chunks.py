"""Markdown texts in chunks: blocks under their headings, long ones cut at ends of sentences; and the sentence that a statement rests on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Characters of a chunk, the share of them after which it may end early, and characters that end a sentence.
MOST, EARLIEST, ENDS = 1800, 0.6, "。！？.!?；;"
LEVELS = range(1, 7)
HEADING = r"^\s{0,3}(#{1,6})\s+(.+?)\s*#*\s*$"
FENCE = r"^\s*(```|~~~)"
LEAST_OVERLAP = 0.4


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def pieces(block: Column, most: int = MOST) -> Column:
    """A trimmed block in pieces of at most ``most`` characters: each ends at the last end of a sentence in its last 40 %, else after ``most``."""
    early = int(most * EARLIEST)
    rule = rf"\s*(?=\S)([\s\S]{{1,{most}}}\z|[\s\S]{{{early},{most - 1}}}[{ENDS}\n]|[\s\S]{{{most}}})"
    return F.transform(F.regexp_extract_all(block, F.lit(rule), 1), trimmed)


def blocks(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line, heading, block): what stands between blank lines and headings, with the line it starts at and the headings it is under.

    A heading holds until one of its level or above. Between fences neither blank lines
    nor headings count; a fence that is never closed reaches to the end. Rows of one key
    are one document, so keys have to be distinct; null and blank texts have no blocks.
    White space is that of ASCII.
    """
    lines = F.split(F.regexp_replace(F.col(text), "\r\n?", "\n"), "\n")
    rows = docs.select(key, F.posexplode(lines).alias("line", "body"))
    so_far = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    open_ = F.count_if(F.col("body").rlike(FENCE)).over(so_far) % 2 == 1
    rows = rows.withColumn("open", open_)
    level = F.when(~F.col("open") & F.col("body").rlike(HEADING), F.length(F.regexp_extract("body", HEADING, 1)))
    rows = rows.withColumn("level", level)
    ends = F.col("level").isNotNull() | (~F.col("open") & ~F.col("body").rlike(r"\S"))
    last = lambda n: F.last(F.when(F.col("level") == n, F.struct("line", F.regexp_extract("body", HEADING, 2).alias("title"))), ignorenulls=True).over(so_far)
    rows = rows.withColumns({"ends": ends, "number": F.count_if(ends).over(so_far), **{f"h{n}": last(n) for n in LEVELS}})
    above = lambda n: F.greatest(F.lit(-1), *[F.coalesce(F.col(f"h{m}.line"), F.lit(-1)) for m in range(1, n)], F.lit(-1))
    path = F.array_join(F.filter(F.array(*[F.when(F.col(f"h{n}.line") > above(n), trimmed(F.col(f"h{n}.title"))) for n in LEVELS]), lambda t: t.isNotNull() & (t != "")), " > ")
    body = rows.where(~F.col("ends")).select(key, "number", "line", "body", path.alias("heading"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "body"))), lambda x: x["body"]), "\n")
    return body.groupBy(key, "number").agg(F.min("line").alias("line"), F.first("heading").alias("heading"), trimmed(joined).alias("block")).where("block <> ''").drop("number")


def chunks(docs: DataFrame, key: str, text: str = "text", most: int = MOST) -> DataFrame:
    """(key, block, part, heading, chunk): all chunks of each document, numbered over its blocks, with their part of the block."""
    cut = blocks(docs, key, text).select(key, "line", "heading", F.posexplode(pieces(F.col("block"), most)).alias("at", "chunk"))
    number = F.row_number().over(Window.partitionBy(key).orderBy("line", "at"))
    return cut.select(key, number.alias("block"), (F.col("at") + 1).alias("part"), "heading", "chunk")


def supported(statements: DataFrame, content: str = "content", source: str = "source", proposed: str = "proposed") -> DataFrame:
    """``statements`` with quote and match: the proposed quote if the source has it, else the sentence that shares most of the content, if it is 40 %; else null.

    Of sentences that share as much the first counts. Nulls in any of the three give null.
    """
    sentences = F.filter(F.transform(F.split(F.col(source), r"(?<=[.!?。！？])\s+|\n+"), trimmed), lambda s: s != "")
    ranked = F.transform(sentences, lambda s, i: F.struct(S.overlap(F.col(content), s).alias("share"), (-i).alias("first"), s.alias("quote")))
    best = F.array_max(ranked)
    found = F.when(F.col("best_sentence.share") >= LEAST_OVERLAP, F.col("best_sentence.quote"))
    exact = F.contains(F.col(source), F.col(proposed))
    rows = statements.withColumn("best_sentence", best)
    quote = F.when(exact, F.col(proposed)).when(F.col(content).isNotNull() & exact.isNotNull(), found)
    return rows.withColumns({"quote": quote, "match": F.when(quote.isNotNull(), F.when(exact, "exact").otherwise("sentence"))}).drop("best_sentence")
