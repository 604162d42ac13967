"""Mixing of sources to target weights with Sainte-Laguë apportionment.

1. A source's documents stand in a seeded order (by MD5 of seed, doc_id and text),
   and their words in that order are its *line*, which goes round: block j of
   ``block`` words starts ``j * block`` words after the line's start, so all blocks
   are equal, and which documents a block has depends on the seed alone.
2. Targets: the share of all words by weight, at most ``most`` times a source's
   own words, the excess shared again by weight.
3. Blocks are allocated by highest quotients ``target / (2k + 1)`` (ties: the
   source that comes first). Sainte-Laguë is monotone in the number of blocks, so
   shard i of the mix gets the blocks from ``i / shards`` on of that sequence, and
   a source's quota in a shard is the difference of two apportionments.
4. A source's blocks are handed out in line order, shard after shard. Round the
   line more than once, words are taken again, so no word is taken more often than
   another by more than one. Documents are cut only where shards and rounds end.

No block is ever listed: where a document's words go follows from its place in the
line. Places come from a sum over ranges of the order's hash and a sum within each
range, so the rows of a source of any size are spread over ``ranges`` groups. For a
number of blocks, all but about two seats a source are settled by the divisor; only
the quotients near it are ranked. The table of sources has a row a source and is
ordered in one task, with spill; nothing else is.

A block has ``block`` words, but at most a thousandth of the smallest target, so that
rounding to blocks moves no source by much more than that.

Defined results: a null text has 0 words; a null source is a source of its own that
comes last; documents without words have no parts; sources without words have
target 0; rows that repeat each other have a place each; an empty table gives no
rows. Other columns are ignored unless carried.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh_path, text_or_empty

#: Weights of the sources in the order of their names, repeating; the mix's words and a source's most, as shares.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
SEED, BLOCK, SHARDS, RANGES = 7, 1024, 16, 4096
WHITE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """How many runs of other than white space a text has."""
    bare = F.trim(F.regexp_replace(text, WHITE, " "))
    return F.when(bare == "", 0).otherwise(F.octet_length(bare) - F.octet_length(F.replace(bare, F.lit(" "), F.lit(""))) + 1).cast("long")


def sized(docs: DataFrame, seed: int, ranges: int, carried: Sequence[str]) -> DataFrame:
    """doc_id, source, name and named (its key without null), size, place (the order's hash), range and the carried columns per document, written once."""
    text = text_or_empty()
    marked = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text)
    place = F.conv(F.substring(F.md5(marked), 1, 15), 16, 10).cast("long")
    source = F.col("source").cast("string")
    key = (source.alias("source"), F.coalesce(source, F.lit("")).alias("name"), source.isNotNull().alias("named"))
    rows = docs.select("doc_id", *key, words(text).alias("size"), place.alias("place"), *[F.col(c).alias(f"carried_{c}") for c in carried])
    path = fresh_path(docs.sparkSession, "mix")
    rows.withColumn("range", F.floor(F.col("place") / F.lit(2.0**60 / ranges)).cast("int")).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def targets(sources: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """``sources`` (source, source_size) with number, weight and target.

    Sources in the order of ``most * size / weight`` fill up one after the other as
    the level rises; the level is that at the first one that doesn't fill.
    """
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (number % len(weights) + 1).cast("int"))
    rows = cut(sources.select("source", "source_size", number.cast("long").alias("number"), weight.cast("double").alias("weight")))
    total, weighed = rows.agg(F.sum("source_size"), F.sum("weight")).first()
    if total is None:
        return rows.withColumn("target", F.lit(0.0))
    most_of = F.lit(float(most)) * F.col("source_size")
    before = Window.orderBy(most_of / F.col("weight"), "number").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(share * total) - F.coalesce(F.sum(most_of).over(before), F.lit(0.0))) / (F.lit(weighed) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levels = rows.select((most_of / F.col("weight")).alias("full"), level.alias("level"), "number")
    (level,) = levels.where("full >= level").agg(F.min_by("level", F.struct("full", "number"))).first()
    return rows.withColumn("target", most_of if level is None else F.least(most_of, F.lit(level) * F.col("weight")))


def apportion(rows: DataFrame, houses: Sequence[int]) -> DataFrame:
    """number, house, seats: the seats of each of ``rows`` (number, target) in houses of these numbers of seats.

    With a divisor d, a row has ``floor(target / d + 1/2)`` seats. Two divisors, which
    give at most and at least the house, settle all but some two seats a row; these
    are ranked by their quotients.
    """
    rows = rows.where("target > 0").select("number", "target")
    n, total = rows.agg(F.count(F.lit(1)), F.sum("target")).first()
    spread = rows.withColumn("house", F.explode(F.array(*[F.lit(h).cast("long") for h in dict.fromkeys(houses)])))

    def at(seats: Column) -> Column:
        return F.floor(F.col("target") * F.greatest(seats, F.lit(0.0)) / F.lit(total or 1.0) + 0.5)

    bounds = spread.select(
        "number", "target", "house",
        F.greatest(at(F.col("house") - F.lit(n / 2)) - 1, F.lit(0)).alias("sure"),
        (at(F.col("house") + F.lit(n / 2)) + 1).alias("most"),
    )
    seats = bounds.select("number", "house", F.explode(F.expr("sequence(sure, most - 1)")).alias("k"), "target").withColumn("quotient", F.col("target") / (2 * F.col("k") + 1))
    sure = bounds.groupBy("house").agg(F.sum("sure").alias("settled"))
    rank = F.row_number().over(Window.partitionBy("house").orderBy(F.col("quotient").desc(), "number", "k"))
    won = seats.withColumn("rank", rank).join(F.broadcast(sure), "house").where(F.col("rank") <= F.col("house") - F.col("settled"))
    more = won.groupBy("number", "house").agg(F.count(F.lit(1)).alias("more"))
    return bounds.join(more, ["number", "house"], "left").select("number", "house", (F.col("sure") + F.coalesce("more", F.lit(0))).alias("seats"))


def quotas(sources: DataFrame, block: int = BLOCK, shards: int = SHARDS, most: float = MOST) -> DataFrame:
    """source, source_size, target, block, ends per source: where its blocks of each shard end, in words of its line."""
    total, least = sources.where("target > 0").agg(F.sum("target"), F.min("target")).first()
    if total is None:
        return sources.select("source", "source_size", "target", F.lit(block).cast("long").alias("block"), F.array_repeat(F.lit(0).cast("long"), shards).alias("ends"))
    block = max(1, min(block, int(least / 1000)))
    blocks = round(total / block)
    houses = [blocks * (i + 1) // shards for i in range(shards)]
    seats = apportion(sources, houses).groupBy("number").agg(F.map_from_entries(F.collect_list(F.struct("house", "seats"))).alias("by"))
    ends = F.array(*[F.least(F.coalesce(F.element_at("by", F.lit(h).cast("long")), F.lit(0)) * block, F.col("source_size") * most).cast("long") for h in houses])
    return sources.join(seats, "number", "left").select("source", "source_size", "target", F.lit(block).cast("long").alias("block"), ends.alias("ends"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED, ranges: int = RANGES, carried: Sequence[str] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, parts and ``carried_...`` columns per document.

    ``parts`` says where its words go: shard, round, first word and length.
    """
    rows = sized(docs, seed, ranges, carried)
    source, group = ["name", "named"], ["name", "named", "range"]
    held = rows.groupBy(*group).agg(F.sum("size").alias("held"))
    earlier = Window.partitionBy(*source).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    held = cut(held.withColumn("before", F.coalesce(F.sum("held").over(earlier), F.lit(0))))
    sums = held.groupBy(*source).agg(F.sum("held").alias("source_size"))
    sources = targets(sums.select(F.when(F.col("named"), F.col("name")).alias("source"), "source_size"), weights, share, most)
    known = quotas(sources, block, shards, most)
    known = known.select(F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNotNull().alias("named"), "source_size", "target", "ends")
    starts = held.drop("held").join(known, source)
    within = Window.partitionBy(*group).orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(starts, group).withColumn("start", F.col("before") + F.col("within"))
    rounds = [parts_of_round(i) for i in range(most)]
    return placed.select("doc_id", "source", "size", "source_size", "target", F.concat(*rounds).alias("parts"), *[f"carried_{c}" for c in carried])


def parts_of_round(turn: int) -> Column:
    """Parts of a document's words when the line is gone round for the ``turn``-th time."""
    begin = F.col("start") + F.lit(turn) * F.col("source_size")
    end = begin + F.col("size")

    def part(high: Column, shard: Column) -> Column:
        low = F.when(shard == 0, F.lit(0).cast("long")).otherwise(F.element_at("ends", F.greatest(shard, F.lit(1))))
        first, last = F.greatest(low, begin), F.least(high, end)
        return F.struct(shard.alias("shard"), F.lit(turn).alias("round"), (first - begin).alias("first"), (last - first).alias("length"))

    return F.filter(F.transform("ends", part), lambda p: p["length"] > 0)


def mix_digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken per document."""
    taken = F.aggregate("parts", F.lit(0).cast("long"), lambda held, p: held + p["length"])
    return mix(docs, **options).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """shard, doc_id, source, round, text: the mix itself. A part of a document has its words joined by single spaces, a whole one its text."""
    parts = mix(docs, carried=("text",), **options).select("*", F.explode("parts").alias("part"))
    listed = F.split(F.trim(F.regexp_replace("carried_text", WHITE, " ")), " ")
    some = F.array_join(F.slice(listed, (F.col("part.first") + 1).cast("int"), F.col("part.length").cast("int")), " ")
    text = F.when(F.col("part.length") == F.col("size"), F.col("carried_text")).otherwise(some)
    return parts.select("part.shard", "doc_id", "source", "part.round", text.alias("text"))


def oracle_sql(weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED) -> str:
    """DuckDB SQL for ``mix_digest``: all seats are listed and ranked, and places come from one window a source."""
    return rf"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS place
  FROM documents),
src AS (
  SELECT source, sum(size)::DOUBLE AS n, (row_number() OVER (ORDER BY source NULLS LAST) - 1)::BIGINT AS number FROM rows_ GROUP BY source),
weighed AS (SELECT *, [{", ".join(map(str, weights))}][(number % {len(weights)} + 1)::INT]::DOUBLE AS w FROM src),
-- one round: those above their most stop there
rounds AS (
  SELECT 0 AS step, ({share} * sum(n)) / sum(w) AS level FROM weighed
  UNION ALL
  SELECT step + 1, new_level FROM (
    SELECT r.step, r.level,
      (SELECT ({share} * sum(n) - coalesce(sum({most} * n) FILTER (r.level * w > {most} * n), 0)) / nullif(sum(w) FILTER (NOT r.level * w > {most} * n), 0) FROM weighed) AS new_level
    FROM rounds r) WHERE new_level > level),
aimed AS (SELECT *, least({most} * n, (SELECT max(level) FROM rounds) * w) AS target FROM weighed),
scale AS (SELECT greatest(1, least({block}, floor(min(target) / 1000)))::BIGINT AS block, sum(target) AS total FROM aimed WHERE target > 0),
house AS (SELECT block, round_even(total / block, 0)::BIGINT AS seats FROM scale),
ranked AS (
  SELECT number, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, number, k) AS place
  FROM aimed, house, LATERAL (SELECT unnest(generate_series(0, ceil(target / block)::BIGINT + 2)) AS k) WHERE target > 0),
won AS (SELECT number, count(*) AS seats FROM ranked WHERE place <= (SELECT seats FROM house) GROUP BY number),
quota AS (
  SELECT a.source, a.n, a.target, least(coalesce(won.seats, 0) * block, ({most} * a.n)::BIGINT) AS q FROM aimed a CROSS JOIN house LEFT JOIN won USING (number)),
placed AS (
  SELECT r.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY place, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM rows_ r)
SELECT p.doc_id, p.size::BIGINT AS size, q.n::BIGINT AS source_size, q.target,
  ({" + ".join(f"greatest(0, least(q.q, start + {i} * q.n::BIGINT + size) - (start + {i} * q.n::BIGINT))" for i in range(most))})::BIGINT AS taken
FROM placed p JOIN quota q ON p.source IS NOT DISTINCT FROM q.source
"""
