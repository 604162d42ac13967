"""Ranked text retrieval, weighted activation and small text tools."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.storage import once

#: Weights of record types and of the features in the built-in profiles, and the least factor of a profile.
TYPE_WEIGHT = {
    "official_data_evidence": 1.22, "paper_evidence": 1.18, "evidence_pending": 1.2, "factor_definition": 1.14, "legacy_factor_definition": 0.95,
    "factor_evidence_link": 1.12, "framework_specification": 1.1, "official_dataset": 1.08, "translation_term": 1.08, "knowledge": 1.0,
}
PROFILES = {
    "balanced": {"importance": 0.35, "sourceReliability": 0.2, "freshness": 0.15, "foundational": 0.15, "usage": 0.15},
    "authoritative": {"importance": 0.25, "sourceReliability": 0.4, "freshness": 0.1, "foundational": 0.15, "usage": 0.05},
    "current": {"importance": 0.2, "sourceReliability": 0.15, "freshness": 0.4, "foundational": 0.1, "usage": 0.1},
    "foundational": {"importance": 0.25, "sourceReliability": 0.15, "freshness": 0.1, "foundational": 0.4, "usage": 0.1},
}
FLOOR = 0.55

TOKEN = r"[\p{L}\p{N}]+"

def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def search_terms(text: Column) -> Column:
    """``scalars.terms``, by one pattern where the text has no CJK letters."""
    plain = F.regexp_extract_all(F.lower(text), F.lit(scalars.TERM), F.lit(0))
    return F.when(text.rlike(scalars.CJK), scalars.terms(text)).otherwise(plain)


def rank_weight(kind: Column, supplementary: Column, quality: Column) -> Column:
    """By record type, 0.72 for supplementary work, and 0.85 to 1 by quality (1 if unknown)."""
    types = F.create_map(*[F.lit(x) for pair in TYPE_WEIGHT.items() for x in pair])
    return F.coalesce(F.try_element_at(types, kind), F.lit(1.0)) * F.when(supplementary, 0.72).otherwise(1.0) * (0.85 + 0.15 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(quality, F.lit(1.0)))))


#: Documents and queries of one block of scores.
DOCS, QUERIES = 4096, 256


def frontier(docs: pa.Table) -> pa.Table:
    """Of copies those that can be a query's best: none of the same text and count weighs as much or more and has a smaller id."""
    order = docs.append_column("at", pa.array(np.arange(len(docs)))).sort_by([("doc_id", "ascending")])  # nulls last
    place = np.empty(len(docs), int)
    place[order["at"].to_numpy()] = np.arange(len(docs))
    content, copies, own = (docs[c].to_numpy() for c in ("content", "copies", "own"))
    by = np.lexsort((place, -own, copies, content))
    new = np.append(True, (content[by][1:] != content[by][:-1]) | (copies[by][1:] != copies[by][:-1]))[: len(by)]
    group = np.cumsum(new) - 1
    down = place[by] - group * len(docs)  # later groups are lower than all before
    least = np.minimum.accumulate(down) if len(by) else down
    return docs.take(pa.array(np.sort(by[down <= least])))


def block_scores(docs: pa.Table, asked: pa.Table, k: int, k1: float, b: float) -> pa.Table:
    """(query_id, doc_id, own, content, sum) of a block's documents that can be among the ``k`` best texts of a query of a block."""
    docs = frontier(docs)
    queries = pc.unique(asked["query_id"])
    words = pc.unique(asked["token"]).sort()
    of_query, of_word = pc.index_in(asked["query_id"], value_set=queries).to_numpy(), pc.index_in(asked["token"], value_set=words).to_numpy()
    times = np.zeros((len(words), len(queries)))
    times[of_word, of_query] = asked["times"].to_numpy()
    idf = np.zeros(len(words))
    idf[of_word] = asked["idf"].to_numpy()
    lists = docs["terms"].combine_chunks()
    sizes, terms = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten()
    word = pc.index_in(terms.field("token"), value_set=words).fill_null(-1).to_numpy(zero_copy_only=False)
    doc, tf = np.repeat(np.arange(len(docs)), sizes), terms.field("tf").to_numpy(zero_copy_only=False).astype(float)
    held = np.lexsort((word, doc))
    held = held[word[held] >= 0]
    doc, word, tf = doc[held], word[held], tf[held]
    length, average = docs["len"].to_numpy()[doc], (asked["avg_len"][0].as_py() if len(asked) else 1.0)
    part = idf[word] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))
    ends = np.searchsorted(doc, np.arange(len(docs) + 1))
    sums = np.zeros((len(docs), len(queries)))
    for d in range(len(docs)):
        own = slice(ends[d], ends[d + 1])
        sums[d] = part[own] @ times[word[own]]
    scores = sums * docs["own"].to_numpy()[:, None]
    _, text = np.unique(docs["content"].to_numpy(), return_inverse=True)
    best = np.zeros((text.max(initial=-1) + 1, len(queries)))
    np.maximum.at(best, text, scores)
    least = np.partition(best, len(best) - k, axis=0)[len(best) - k] if len(best) > k else np.zeros(len(queries))
    row, column = np.nonzero((scores > 0) & (scores >= least - 2e-9))  # scores are compared after rounding
    chosen = docs.select(["doc_id", "own", "content"]).take(pa.array(row))
    return chosen.append_column("sum", pa.array(sums[row, column])).add_column(0, "query_id", queries.take(pa.array(column)))


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75, weights: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best documents of each query; of equal texts the best, then the smallest id.

    ``weights`` (doc_id, weight) has factors of the score. Texts are taken apart once,
    before they meet anything, and only terms that some query has are counted. Blocks of documents meet blocks of
    queries: each pair of blocks is a matrix of scores of fixed size, of which only
    what can be among the best is shuffled.
    """
    spark = docs.sparkSession
    asked = queries.select("query_id", F.explode(search_terms(F.col("text"))).alias("token")).groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("times"))
    sized = docs.select("doc_id", F.xxhash64("text").alias("content"), search_terms(F.col("text")).alias("tokens"))
    # an empty term stands for the document itself, so that those without other terms are counted as well
    every = F.concat(F.coalesce("tokens", F.array().cast("array<string>")), F.array(F.lit("")))
    vocabulary = asked.select("token").union(spark.createDataFrame([("",)], "token string")).distinct()
    key = ["doc_id", "content", "len"]
    tf = sized.select("doc_id", "content", F.size("tokens").alias("len"), F.explode(every).alias("token")).join(vocabulary, "token").groupBy(*key, "token").agg(F.count(F.lit(1)).alias("tf"))
    copies = F.max(F.when(F.col("token") == "", F.col("tf"))).alias("copies")
    whole = tf.groupBy(*key).agg(copies, F.collect_list(F.when(F.col("token") != "", F.struct("token", "tf"))).alias("terms"))
    whole = whole.withColumn("weight", F.lit(1.0)) if weights is None else whole.join(weights.select("doc_id", "weight"), "doc_id", "left")
    whole = once(whole.withColumn("own", F.coalesce(F.col("weight").cast("double"), F.lit(1.0))).drop("weight"), "terms")
    n_docs, avg_len = whole.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.sum(F.col("len") * F.col("copies")) / F.sum(F.when(F.col("len").isNotNull(), F.col("copies"))), F.lit(0.0))).first()
    df = whole.select(F.explode("terms.token").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = once(asked.join(df, "token").select("query_id", "token", "times", idf.alias("idf"), F.lit(float(avg_len)).alias("avg_len")), "asked")
    blocks, parts = n_docs // DOCS + 1, asked.agg(F.count_distinct("query_id")).first()[0] // QUERIES + 1
    left = whole.where(F.size("terms") > 0).withColumn("block", F.pmod(F.xxhash64("doc_id", "content"), F.lit(blocks))).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    right = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts))).crossJoin(spark.range(blocks).withColumnRenamed("id", "block"))
    fields = {**dict(queries.dtypes), **dict(docs.dtypes)}
    kind = f"query_id {fields['query_id']}, doc_id {fields['doc_id']}, own double, content bigint, sum double"
    pairs = left.groupBy("block", "part").cogroup(right.groupBy("block", "part"))
    scored = pairs.applyInArrow(lambda docs, asked: block_scores(docs, asked, k, k1, b), kind)
    scored = scored.withColumn("score", F.round(F.col("sum") * F.col("own"), 9)).where("score > 0")
    one = F.row_number().over(Window.partitionBy("query_id", "content").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return scored.withColumn("copy", one).where("copy = 1").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank")


def preference(features: Mapping[str, float], weights: Mapping[str, float]) -> float:
    """The weighted mean of an item's features, 0.5 where one isn't known."""
    total = sum(w for w in weights.values() if w > 0)
    return sum(w * features.get(name, 0.5) for name, w in weights.items() if w > 0) / total


def multiplier(item: Mapping, profile: str) -> float:
    """A profile's preference for an item against the balanced one, within the floor and its mirror."""
    known = {"importance": item["weight"]} | dict(item.get("features", {}))
    ratio = preference(known, PROFILES[profile]) / (preference(known, PROFILES["balanced"]) or 1.0)
    return max(FLOOR, min(2 - FLOOR, ratio))


def activate(texts: DataFrame, items: Sequence[Mapping], least: float = 0.2, top: int = 5, penalty: float = 0.25, profile: str = "balanced") -> DataFrame:
    """(text_id, item_id, score, rank): items whose triggers stand in a text.

    weight * (1 - exp(-sum of trigger weights)) * profile - penalty * negative weights, 0 to 1.
    The items are a configuration: their phrases, with plurals and any dashes, become
    predicates of one projection, so texts are read once and nothing is joined.
    """

    def total(phrases: Sequence[tuple[str, float]]) -> Column:
        out = F.lit(0.0)
        for phrase, weight in phrases:
            out = out + F.when(scalars.matches_term(F.col("text"), phrase), float(weight)).otherwise(0.0)
        return out

    hits = []
    for item in items:
        up = total(item["triggers"])
        score = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), item["weight"] * multiplier(item, profile) * (1 - F.exp(-up)) - penalty * total(item.get("negatives", [])))), 4)
        hits.append(F.when(up > 0, F.struct(F.lit(item["item_id"]).alias("item_id"), F.lit(float(item["weight"])).alias("weight"), score.alias("score"))))
    found = texts.select("text_id", F.explode(F.array_compact(F.array(*hits))).alias("h")).select("text_id", "h.*").where(F.col("score") >= least)
    rank = F.row_number().over(Window.partitionBy("text_id").orderBy(F.col("score").desc(), F.col("weight").desc(), "item_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("text_id", "item_id", "score", "rank")


def text_quality(text: Column) -> Column:
    """Share of readable characters, one percent less for each replacement character."""
    readable = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}\p{P}\s]", ""))
    return F.greatest(F.lit(0.0), F.try_divide(readable, F.length(text)) - 0.01 * F.length(F.regexp_replace(text, "[^�]", "")))


def merge_atoms(atoms: DataFrame) -> DataFrame:
    """Atoms with the same letters and digits become one: smallest id, all sources."""
    key = F.lower(F.regexp_replace("text", r"[^\p{L}\p{N}]", ""))
    return atoms.groupBy(F.sha2(key, 256).alias("key")).agg(F.min("atom_id").alias("atom_id"), F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("origin")).alias("origins"))


def glossary(texts: DataFrame, terms: Sequence[tuple[str, Sequence[str]]], most: int = 8) -> DataFrame:
    """(text_id, term, place): the first ``most`` terms, in the order given, that stand in a text by themselves or by an alias."""
    hits = [F.when(F.greatest(*[F.col("text").rlike(scalars.phrase_pattern(p)).cast("int") for p in (term, term, *aliases)]) == 1, F.lit(term)) for term, aliases in terms]
    found = F.slice(F.array_compact(F.array(*hits)), 1, most)
    return texts.select("text_id", F.posexplode(found).alias("place", "term")).select("text_id", "term", (F.col("place") + 1).alias("place"))
