"""Signals and what is said about them: scores, gates, states, context, duplicates, conflicts, cases, trends.

A signal row has asset, pattern, kind, direction, timeframe, state, confidence, start
and end (bar places, both included), and whatever else its operator names.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import ordered
from .bars import with_index

#: Weights of a signal's score, least spans of chart families, allowed changes of state.
KIND_WEIGHT = {"chart": 28, "trend": 22, "combination": 12, "simple": 4}
TIMEFRAME_WEIGHT = {"monthly": 28, "weekly": 18, "daily": 8, "intraday": 0}
STATE_WEIGHT = {"confirmed": 18, "candidate": 5, "detected": 0, "degraded": -12, "invalidated": -100, "expired": -100}
CONFIRMED_BONUS = 15
LEAST_SPAN = {"island": 2, "v_reversal": 8, "flag": 8, "multiple_top_bottom": 10, "head_and_shoulders": 15}
FEW_TURNS_ALLOWED = ("v_reversal", "rounding", "island", "base")
FAMILY_RANK = {"cup_with_handle": 5, "head_and_shoulders": 4, "island": 4, "base": 4, "multiple_top_bottom": 3, "rounding": 2, "v_reversal": 2, "consolidation": 1, "flag": 1}
RELATED = [{"cup_with_handle", "rounding"}, {"cup_with_handle", "consolidation"}, {"cup_with_handle", "flag"}, {"base", "consolidation"}, {"base", "rounding"}]


def looked_up(key: Column, values: Mapping[str, float], other: float = 0.0) -> Column:
    pairs = F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, float(v))])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(float(other)))


def base_score() -> Column:
    """Confidence in percent plus the weights of kind, timeframe and state, and a bonus if confirmed."""
    score = F.col("confidence") * 100 + looked_up(F.col("kind"), KIND_WEIGHT) + looked_up(F.col("timeframe"), TIMEFRAME_WEIGHT) + looked_up(F.col("state"), STATE_WEIGHT)
    return score + F.when(F.col("state") == "confirmed", CONFIRMED_BONUS).otherwise(0)


def rolling_threshold(rank: Column) -> Column:
    """The least confidence of the next chart: 0.65, 0.85, 0.93, then 0.02 more each, 0.995 at most."""
    return F.when(rank <= 0, 0.65).when(rank == 1, 0.85).when(rank == 2, 0.93).otherwise(F.least(F.lit(0.995), 0.93 + 0.02 * (rank - 2)))


def threshold_after(held: int) -> float:
    """``rolling_threshold`` of a number."""
    return (0.65, 0.85, 0.93)[held] if held < 3 else min(0.995, 0.93 + 0.02 * (held - 2))


def overlap_of_shorter(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    shared = F.greatest(F.lit(0), F.least(end, other_end) - F.greatest(start, other_start) + 1)
    return shared / F.greatest(F.lit(1), F.least(end - start, other_end - other_start) + 1)


def gate_reasons(family: Column, pivots: Column, amplitude: Column, least_chart: int = 20) -> Column:
    """Why a signal isn't let through; an empty array if it is."""
    span, chart = F.col("end") - F.col("start") + 1, F.col("kind") == "chart"
    tests = [
        (chart & (span < looked_up(family, LEAST_SPAN, least_chart)), "too short"),
        (~F.col("confidence").between(0, 1), "confidence out of range"),
        (chart & (amplitude > 0) & (amplitude < 2), "within the noise"),
        (chart & (pivots > 0) & (pivots < 3) & ~family.isin(*FEW_TURNS_ALLOWED), "too few turns"),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(reason)) for test, reason in tests]))


def moved_states(signals: DataFrame, transitions: DataFrame) -> DataFrame:
    """``signals`` (with id, state, event) with new_state: the first transition (priority, from_state, event, to_state) that fits; else what was detected is a candidate."""
    fits = signals.select("id", "state", "event").join(F.broadcast(transitions), (F.col("state") == F.col("from_state")) & (F.col("event") == F.col("when_event")))  # a rule table of a few rows
    first = fits.groupBy("id").agg(F.min_by("to_state", "priority").alias("moved"))
    other = F.when(F.col("state") == "detected", "candidate").otherwise(F.col("state"))
    return signals.join(first, "id", "left").withColumn("new_state", F.coalesce("moved", other)).drop("moved")


def context_adjustment(role: Column, trend: Column, position: Column, averages: Column) -> Column:
    """By how much a reversal's confidence changes with trend, place in the range (0 to 1) and averages."""
    bottom = F.when((position <= 0.4) & trend.isin("down", "range"), 0.08).when(position >= 0.7, -0.2).otherwise(0.0)
    top = F.when((position >= 0.6) & trend.isin("up", "range"), 0.08).when(position <= 0.3, -0.2).otherwise(0.0)
    own = F.when((role == "three rising") & (trend == "down"), -0.25).when(role == "bottom", bottom).when(role == "top", top).otherwise(0.0)
    against = ((averages == "bearish") & (F.col("direction") == "bullish") & ~((role == "three rising") & (trend == "down"))) | ((averages == "bullish") & (F.col("direction") == "bearish"))
    return own - F.when(against, 0.1).otherwise(0.0)


def grouped_duplicates(signals: DataFrame, gap: int = 1) -> DataFrame:
    """One row for signals of one asset, pattern, direction and timeframe that meet the one before them: grp, start, end, n, confidence."""
    keys = ["asset", "pattern", "direction", "timeframe"]
    w = Window.partitionBy(*keys).orderBy("start", "end", "confidence", "id")
    last_start, last_end = F.lag("start").over(w), F.lag("end").over(w)
    new = F.when(F.coalesce((last_start <= F.col("end") + gap) & (F.col("start") <= last_end + gap), F.lit(False)), 0).otherwise(1)
    return signals.withColumn("new", new).withColumn("grp", F.sum("new").over(w)).groupBy(*keys, "grp").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n"), F.max("confidence").alias("confidence"))


def conflicts(signals: DataFrame, separation: int = 1, block: int = 64) -> DataFrame:
    """Pairs of opposite signals of one asset and timeframe in one window, with the one of the higher score and the share of the shorter one that both cover.

    Signals meet by the blocks of bars that they (and ``separation`` bars around them)
    cover, so those that are far apart in a long history never meet; a pair counts in
    the first block that it shares. Only signals are shuffled, with nothing that follows
    from what else they carry; pairs, which are far more, pass from the join as they are made.
    """
    scored = signals.where(F.col("direction").isin("bullish", "bearish")).select("asset", "timeframe", "id", "direction", "start", "end", base_score().alias("score"))
    first_block = lambda start: F.floor((start - separation) / block)
    placed = scored.withColumn("block", F.explode(F.sequence(first_block(F.col("start")), F.floor((F.col("end") + separation) / block))))
    side = lambda direction, suffix: placed.where(F.col("direction") == direction).drop("direction").select("asset", "timeframe", "block", *[F.col(c).alias(f"{c}_{suffix}") for c in ("id", "start", "end", "score")])
    met = side("bullish", "up").join(side("bearish", "down"), ["asset", "timeframe", "block"])
    apart = F.greatest("start_up", "start_down") - F.least("end_up", "end_down")
    near = met.where((apart <= separation) & (F.col("block") == first_block(F.greatest("start_up", "start_down"))))
    shared = overlap_of_shorter(F.col("start_up"), F.col("end_up"), F.col("start_down"), F.col("end_down"))
    return near.select("asset", "timeframe", "id_up", "id_down", "score_up", "score_down", shared.alias("shared"), F.when(F.col("score_up") >= F.col("score_down"), F.col("id_up")).otherwise(F.col("id_down")).alias("winner"))


def case_scores(asked: DataFrame, cases: DataFrame, least: float = 0.30, top: int = 8, good: float = 0.65) -> DataFrame:
    """(query_id, case_id, similarity, rank): cases that share a pattern, by patterns, tags, context and quality.

    Only the classes of equal queries and of equal cases are compared, those that meet on a
    pattern. Of a class of cases, which score alike, the first ``top`` by id are enough,
    and the best are found once a class of queries.
    """
    known_by = ["patterns", "tags", "trend", "place"]
    named = lambda rows, columns: rows.withColumn("class", F.struct(*columns))
    queries, usable = named(asked, known_by), named(cases.where(F.col("quality") >= good), [*known_by, "quality"])
    first = F.row_number().over(Window.partitionBy("class").orderBy("case_id"))
    members = usable.select("class", "case_id").distinct().withColumn("turn", first).where(F.col("turn") <= top).drop("turn")
    kinds, others = queries.select("class").distinct(), members.select(F.col("class").alias("other")).distinct()
    on_pattern = lambda rows, c: rows.select(c, F.explode(F.array_distinct(f"{c}.patterns")).alias("p"))
    pairs = on_pattern(kinds, "class").join(on_pattern(others, "other"), "p").select("class", "other").distinct()
    rows = pairs.select("class", "other", "class.*", F.col("other.patterns").alias("p2"), F.col("other.tags").alias("t2"), F.col("other.trend").alias("r2"), F.col("other.place").alias("l2"), F.col("other.quality").alias("quality"))
    jaccard = lambda a, b: F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))
    known = lambda c: F.when(~F.col(c).isin("unknown", "any", ""), 1).otherwise(0)
    total = known("r2") + known("l2")
    hit = F.when(F.col("r2") == F.col("trend"), known("r2")).otherwise(0) + F.when(F.col("l2") == F.col("place"), known("l2")).otherwise(0)
    context = F.coalesce(F.try_divide(hit, total), F.lit(0.5))
    score = 0.52 * jaccard(F.col("patterns"), F.col("p2")) + 0.20 * jaccard(F.col("tags"), F.col("t2")) + 0.18 * context + 0.10 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("quality")))
    near = rows.select("class", "other", F.round(score, 9).alias("similarity")).where(F.col("similarity") >= least)
    best = F.row_number().over(Window.partitionBy("class").orderBy(F.col("similarity").desc(), "case_id"))
    found = near.join(members.withColumnRenamed("class", "other"), "other").select("class", "case_id", "similarity").withColumn("rank", best).where(F.col("rank") <= top)
    listed = found.groupBy("class").agg(F.collect_list(F.struct("case_id", "similarity", "rank")).alias("best"))  # ``top`` a class
    return queries.join(listed.withColumnRenamed("class", "own"), F.col("class").eqNullSafe(F.col("own"))).select("query_id", F.explode("best").alias("b")).select("query_id", "b.*")


def with_consensus(confidence: Column, direction: Column, confirmed: Column, agreed: Column, strength: Column, cases: Column) -> Column:
    """A confidence moved by at most 0.10 up or 0.12 down where three cases or more agree by 60 %."""
    counts = (cases >= 3) & (strength >= 0.60) & (agreed != "neutral")
    up, down = F.least(F.lit(1.0), confidence + F.least(F.lit(0.10), strength * 0.10)), F.greatest(F.lit(0.0), confidence - F.least(F.lit(0.12), strength * 0.12))
    return F.when(counts & (agreed == direction), up).when(counts & ~confirmed, down).otherwise(confidence)


def trend_direction(bars: DataFrame) -> DataFrame:
    """(symbol, trend): up, down, range or unknown, from the last 12 closes: a move of 12 % in 6 bars, then slope and averages."""
    w = ordered()
    back = Window.partitionBy("symbol").orderBy(F.col("ts").desc())
    rows = bars.select("symbol", "ts", "close", F.avg("close").over(w.rowsBetween(-9, 0)).alias("mean"), F.row_number().over(back).alias("back"), F.count(F.lit(1)).over(Window.partitionBy("symbol")).alias("n"))
    rows = rows.where("back <= 12").withColumns({"x": -F.col("back"), "y": F.ln(F.greatest("close", F.lit(1e-9)))})
    at = lambda c, k: F.max(F.when(F.col("back") == k, F.col(c)))
    six = F.col("back") <= 6
    middle = F.max(F.when(F.col("back") == F.least("n", F.lit(12)) - F.floor(F.least("n", F.lit(12)) / 2), F.col("close")))
    s = rows.groupBy("symbol").agg(F.max("n").alias("n"), F.regr_slope("y", "x").alias("slope"), F.max(F.when(six, F.col("close"))).alias("peak"), F.min(F.when(six, F.col("close"))).alias("trough"), at("close", 1).alias("last"), at("close", 3).alias("third"), at("mean", 1).alias("mean"), at("mean", 4).alias("mean4"), middle.alias("middle"))
    long = F.col("n") >= 6
    falls, rises = long & (F.col("last") < F.col("middle")) & (F.col("mean") < F.col("mean4")), long & (F.col("last") > F.col("middle")) & (F.col("mean") > F.col("mean4"))
    trend = (
        F.when(F.col("n") < 5, "unknown")
        .when((F.col("last") <= F.col("peak") * 0.88) & (F.col("last") < F.col("third")), "down")
        .when((F.col("last") >= F.col("trough") * 1.12) & (F.col("last") > F.col("third")), "up")
        .when((F.col("slope") > 0.008) | rises, "up")
        .when((F.col("slope") < -0.008) | falls, "down")
        .otherwise("range")
    )
    return s.select("symbol", trend.alias("trend"))


def synthesis(monthly: Column, weekly: Column, daily: Column, rising: Column, falling: Column) -> Column:
    """3, 2.1 and 1.2 points a trend by timeframe, 0.15 a pattern of the day."""
    side = lambda t: F.when(t == "up", 3).when(t == "down", -3).otherwise(0)
    return side(monthly) + side(weekly) * 0.7 + side(daily) * 0.4 + (rising - falling) * 0.15


def harmonised(monthly: Column, other: Column) -> Column:
    """What a shorter trend is inside the monthly one."""
    inside = F.when(other == monthly, F.concat(F.lit("with "), monthly)).when(other == "range", F.concat(F.lit("pause in "), monthly)).otherwise(F.concat(F.lit("against "), monthly))
    return F.when(monthly.isin("up", "down"), inside).otherwise(other)


def scored_pivots(bars: DataFrame, radius: int = 5, least: float = 0.60) -> DataFrame:
    """(symbol, idx, kind, price, confidence): extremes of ``radius`` bars to both sides by how far they stand out; of neighbours of one kind the more extreme."""
    around = ordered().rowsBetween(-radius, radius)
    whole = Window.partitionBy("symbol")
    full = F.count(F.lit(1)).over(around) == 2 * radius + 1
    rows = with_index(bars).select("symbol", "ts", F.col("bar_idx").alias("idx"), "high", "low", F.avg(F.col("high") - F.col("low")).over(whole).alias("usual"), full.alias("full"), F.max("high").over(around).alias("top"), F.min("low").over(around).alias("bottom"), F.percentile("high", 0.5).over(around).alias("mid_high"), F.percentile("low", 0.5).over(around).alias("mid_low"))
    usual = F.coalesce(F.nullif("usual", F.lit(0.0)), F.lit(1.0))
    score = lambda out: F.least(F.lit(0.98), F.greatest(F.lit(0.0), 0.52 + 0.12 * out / usual))
    high = F.when(F.col("full") & (F.col("high") >= F.col("top")), F.struct(F.lit(0).alias("side"), F.col("high").alias("price"), score(F.col("high") - F.col("mid_high")).alias("confidence")))
    low = F.when(F.col("full") & (F.col("low") <= F.col("bottom")), F.struct(F.lit(1).alias("side"), F.col("low").alias("price"), score(F.col("mid_low") - F.col("low")).alias("confidence")))
    found = rows.select("symbol", "idx", F.explode(F.array_compact(F.array(high, low))).alias("p")).select("symbol", "idx", "p.*").where(F.col("confidence") >= least)
    w = Window.partitionBy("symbol").orderBy("idx", "side")
    run = found.withColumn("run", F.sum(F.when(F.col("side") == F.lag("side").over(w), 0).otherwise(1)).over(w))
    extreme = F.struct(F.when(F.col("side") == 0, F.col("price")).otherwise(-F.col("price")).alias("by"), (-F.col("idx")).alias("earlier"))
    best = F.max_by(F.struct("idx", "price", "confidence"), extreme)
    return run.groupBy("symbol", "run", "side").agg(best.alias("b")).select("symbol", "b.idx", F.when(F.col("side") == 0, "high").otherwise("low").alias("kind"), "b.price", "b.confidence")


def scored_levels(bars: DataFrame, last: int = 8, per_side: int = 3) -> DataFrame:
    """The levels of the last pivots nearest to the close on both sides, with how many bars touched them."""
    back = Window.partitionBy("symbol").orderBy(F.col("ts").desc())
    usual = bars.withColumn("back", F.row_number().over(back)).where("back <= 60").groupBy("symbol").agg(F.coalesce(F.nullif(F.avg(F.col("high") - F.col("low")), F.lit(0.0)), F.lit(1.0)).alias("usual"), F.max_by("close", "ts").alias("close"))
    recent = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("idx").desc(), "kind"))
    levels = scored_pivots(bars).withColumn("recent", recent).where(F.col("recent") <= last).join(usual, "symbol")
    held = levels.groupBy("symbol").agg(F.collect_list(F.struct("idx", "kind", "price", "confidence", "usual", "close")).alias("levels"))  # ``last`` a symbol
    near = (F.abs(F.col("high") - F.col("level.price")) <= 0.25 * F.col("level.usual")) | (F.abs(F.col("low") - F.col("level.price")) <= 0.25 * F.col("level.usual"))
    touched = bars.join(held, "symbol").select("symbol", "high", "low", F.explode("levels").alias("level")).groupBy("symbol", "level").agg(F.count_if(near).alias("touches"))
    rows = touched.select("symbol", "level.*", "touches").withColumn("role", F.when(F.col("price") > F.col("close"), "resistance").otherwise("support"))
    score = 0.18 * F.col("touches") + F.col("confidence") - F.abs(F.col("price") - F.col("close")) / F.greatest(F.abs("close"), F.lit(1e-9))
    nearest = F.row_number().over(Window.partitionBy("symbol", "role").orderBy(F.abs(F.col("price") - F.col("close")), "idx"))
    return rows.withColumns({"score": score, "rank": nearest}).where(F.col("rank") <= per_side).select("symbol", "role", "rank", "idx", "kind", "price", "touches", "score")
