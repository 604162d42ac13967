"""Symbols, sources, disclosures, audits, rules, feedback, votes and links: work on keyed records."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The benchmark of each market prefix and the one of all others.
BENCHMARKS = {"sh": "sh000300", "sz": "sh000300", "bj": "sh000300", "hk": "hkhsi", "us": "usspy"}
OTHER_BENCHMARK = "sh000300"
COMMODITIES = ("comgold", "comoil", "comsilver")


def normal_symbol(value: Column) -> Column:
    """The canonical symbol; null for a text that is none."""
    raw = F.lower(F.regexp_replace(value, r"\s", ""))
    return (
        F.when(raw.rlike("^((sh|sz|bj)[0-9]{6}|hk[0-9]{5}|us[a-z0-9^=._-]{1,24}|hkhsi|fx[a-z]{6})$") | raw.isin(*COMMODITIES), raw)
        .when(raw.rlike("^[5689][0-9]{5}$"), F.concat(F.lit("sh"), raw))
        .when(raw.rlike("^[0-9]{6}$"), F.concat(F.lit("sz"), raw))
        .when(raw.rlike("^[0-9]{5}$"), F.concat(F.lit("hk"), raw))
        .when(raw.rlike("^[a-z][a-z0-9._-]{0,10}$"), F.concat(F.lit("us"), raw))
    )


def security_id(symbol: Column) -> Column:
    """The vendor's id of a canonical symbol: a market number, a point and the code."""
    code = F.substr(symbol, F.lit(3))
    return (
        F.when(symbol.rlike("^sh[0-9]+$"), F.concat(F.lit("1."), code))
        .when(symbol.rlike("^(sz|bj)[0-9]+$"), F.concat(F.lit("0."), code))
        .when(symbol.rlike("^hk[0-9]+$"), F.concat(F.lit("116."), code))
        .when(symbol.rlike("^us[a-z][a-z0-9.-]{0,10}$"), F.concat(F.lit("105."), F.upper(code)))
    )


def benchmark_of(symbol: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in BENCHMARKS.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, F.substr(symbol, F.lit(1), F.lit(2))), F.lit(OTHER_BENCHMARK))


def first_source(rows: DataFrame, key: str, source: str) -> DataFrame:
    """The rows of each key's first source (the least ``source``) that has any."""
    rank = F.rank().over(Window.partitionBy(key).orderBy(source))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def latest_disclosed(rows: DataFrame, as_of: str, quarters: int = 6) -> DataFrame:
    """By key the last period that was published by ``as_of``, at most so many quarters back.

    Rows are (key, stat_date, pub_date, value); of one period the last published counts.
    """
    day = F.lit(as_of).cast("date")
    known = rows.where((F.col("pub_date") <= day) & (F.col("stat_date") > F.add_months(day, -3 * quarters)) & F.col("value").isNotNull())
    last = F.max_by(F.struct("stat_date", "pub_date", "value"), F.struct("stat_date", "pub_date", "value"))
    return known.groupBy("key").agg(last.alias("r")).select("key", "r.*")


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def page_runs(pages: DataFrame, key: str, page: str, longest: int = 4) -> DataFrame:
    """Runs of consecutive pages, cut after ``longest`` pages: key, first_page, last_page, n."""
    rows = pages.select(key, page).distinct()
    rows = rows.withColumn("island", F.col(page) - F.row_number().over(Window.partitionBy(key).orderBy(page)))
    start = F.min(page).over(Window.partitionBy(key, "island"))
    part = F.floor((F.col(page) - start) / longest)
    return rows.withColumn("part", part).groupBy(key, "island", "part").agg(F.min(page).alias("first_page"), F.max(page).alias("last_page"), F.count(F.lit(1)).alias("n")).drop("island", "part")


def condition(value: Column, wanted: object) -> Column:
    """A declarative condition as a column: a plain value means equality, a mapping holds all its tests.

    Tests are gte, gt, lte, lt, eq, ne, in, contains, exists and any_of; ordered
    tests of a null are false.
    """
    if not isinstance(wanted, Mapping):
        return value.eqNullSafe(F.lit(wanted))
    tests = {
        "gte": lambda x: F.coalesce(value >= x, F.lit(False)),
        "gt": lambda x: F.coalesce(value > x, F.lit(False)),
        "lte": lambda x: F.coalesce(value <= x, F.lit(False)),
        "lt": lambda x: F.coalesce(value < x, F.lit(False)),
        "eq": lambda x: value.eqNullSafe(F.lit(x)),
        "ne": lambda x: ~value.eqNullSafe(F.lit(x)),
        "in": lambda xs: reduce(Column.__or__, [value.eqNullSafe(F.lit(x)) for x in xs], F.lit(False)),
        "contains": lambda x: F.coalesce(F.contains(value, F.lit(x)), F.lit(False)),
        "exists": lambda x: value.isNotNull() if x else value.isNull(),
        "any_of": lambda xs: reduce(Column.__or__, [condition(value, x) for x in xs], F.lit(False)),
    }
    return reduce(Column.__and__, [tests[name](x) for name, x in wanted.items()], F.lit(True))


def matched_rules(rows: DataFrame, rules: Mapping[str, Mapping[str, object]]) -> DataFrame:
    """``rows`` with a row for each rule all of whose fields hold: one projection for all rules."""
    hits = [F.when(reduce(Column.__and__, [condition(F.col(field), wanted) for field, wanted in fields.items()], F.lit(True)), F.lit(name)) for name, fields in rules.items()]
    return rows.withColumn("rule_id", F.explode(F.array_compact(F.array(*hits))))


def feedback_statistics(feedback: DataFrame, least: int = 10, rate: float = 0.6) -> DataFrame:
    """By rule of (rule_ids, accepted, decision): n, acceptance_rate, review_needed, decisions."""
    each = feedback.select(F.explode("rule_ids").alias("rule_id"), "accepted", "decision")
    by_decision = each.groupBy("rule_id", "decision").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("accepted").cast("int")).alias("yes"))
    named = F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "decision", F.col("n").cast("string")))), ",")
    out = by_decision.groupBy("rule_id").agg(F.sum("n").alias("n"), (F.sum("yes") / F.sum("n")).alias("acceptance_rate"), named.alias("decisions"))
    return out.withColumn("review_needed", (F.col("n") >= least) & (F.col("acceptance_rate") < rate))


def weighed(matches: DataFrame, least: float = 0.45) -> DataFrame:
    """By key of (key, direction, similarity, quality): the direction with most weight, its weight, that of all, and how many support any.

    Weights that differ in last bits only are equal, as these depend on the order of adding;
    of such directions the last by name is taken. Without any weight there is no direction.
    """
    weights = matches.where(F.col("similarity") >= least).groupBy("key", "direction").agg(F.sum(F.col("similarity") * F.col("quality")).alias("w"), F.count(F.lit(1)).alias("n"))
    found = weights.groupBy("key").agg(F.collect_list(F.struct("w", "direction")).alias("votes"), F.max("w").alias("best"), F.sum("w").alias("total"), F.sum("n").alias("supporting"))
    first = F.filter("votes", lambda v: (v["w"] == F.col("best")) | (v["w"] >= F.col("best") * (1 - 1e-12)))
    return found.select("key", F.array_max(F.transform(first, lambda v: v["direction"])).alias("direction"), "best", "total", "supporting")


def consensus(matches: DataFrame, least: float = 0.45) -> DataFrame:
    """By key of (key, direction, similarity, quality): the direction with most weight and its share, 0 of no weight."""
    share = F.coalesce(F.try_divide("best", "total"), F.lit(0.0))
    return weighed(matches, least).select("key", "direction", share.alias("strength"), "supporting")


def major_parts(parts: DataFrame, key: str, name: str, value: str, most: int = 3, share: float = 0.5) -> DataFrame:
    """The largest parts of each key until they make up ``share`` of the whole or are ``most``."""
    ranked = Window.partitionBy(key).orderBy(F.abs(value).desc(), name)
    own = F.try_divide(F.abs(value), F.sum(F.abs(value)).over(Window.partitionBy(key)))
    rows = parts.withColumn("share", own).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= most)
    before = F.coalesce(F.sum("share").over(ranked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return rows.withColumn("before", before).where(F.col("before") < share).drop("before")


def linked(hits: DataFrame, links: DataFrame, limit: int = 5) -> DataFrame:
    """Neighbours of hits (query_id, id, rank) over links (id, position, to) that aren't hits, first seen first."""
    chosen = hits.select("query_id", F.col("id").alias("to"))
    seen = hits.join(links, "id").groupBy("query_id", "to").agg(F.min(F.struct("rank", "position")).alias("first")).join(chosen, ["query_id", "to"], "left_anti")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("first"))
    return seen.withColumn("place", place).where(F.col("place") <= limit).select("query_id", "to", "place")
