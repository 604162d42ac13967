"""Which of the signals of one case wins: score edits by a table of conflict rules, then the surest one.

A case (say a symbol's last bars) has signals in order. Nearly all rules only add to
scores, so the edits of a rule are a join of signals with signals of the same case
and rule by blocks of bars, and scores are sums of edits. Two rules prefer the
signal whose score is higher *so far*: for these, signals of their patterns fall
into islands (those that a chain of neighbours connects), and the pairs of an island
are folded in order. Islands of two patterns are small however long a case is.

Defined results: signals stand in the order of ``ord``; ties of the final score go to
the earlier one; a case without valid signals has no winner and is invalidated; a
null family is none; null evidence satisfies no ordered test.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.storage import once
from .judgment import CONFIRMED_BONUS, KIND_WEIGHT, STATE_WEIGHT, TIMEFRAME_WEIGHT, looked_up
from .records import condition


@dataclass(frozen=True)
class Rule:
    """Signals of two of ``patterns`` within ``apart`` bars, or of one with ``evidence``; ``way`` says who wins."""

    name: str
    patterns: tuple[str, ...]
    way: str
    priority: int
    winner: str | None = None
    needs_confirmation: bool = True
    apart: int = 1
    evidence: dict = field(default_factory=dict)
    by_trend: dict = field(default_factory=dict)


#: The conflict rules in their order, with the names, patterns and priorities that results show.
RULES = (
    Rule("conflict_doji_vs_shooting_star", ("doji", "shooting_star"), "named", 90, "shooting_star"),
    Rule("conflict_shooting_star_vs_evening_doji_star", ("shooting_star", "evening_doji_star"), "named", 92, "evening_doji_star"),
    Rule(
        "conflict_red_three_vs_reverse_three_bullish", ("red_three_soldiers", "three_reverse_bullish"), "trend", 93,
        by_trend={"up": "red_three_soldiers", "down": "three_reverse_bullish"},
    ),
    Rule("conflict_red_three_vs_three_black_crows", ("red_three_soldiers", "three_black_crows"), "confirmed", 94),
    Rule("conflict_bullish_engulfing_vs_evening_doji_star", ("bullish_engulfing", "evening_doji_star"), "confirmed", 90),
    Rule("conflict_bullish_engulfing_vs_piercing", ("bullish_engulfing", "piercing_pattern"), "named", 99, "bullish_engulfing", False),
    Rule("conflict_bearish_engulfing_vs_dark_cloud", ("bearish_engulfing", "dark_cloud_cover"), "named", 99, "bearish_engulfing", False),
    Rule("conflict_head_shoulders_top_vs_double_top", ("head_and_shoulders_top", "double_top"), "named", 98, "head_and_shoulders_top", False),
    Rule("conflict_head_shoulders_bottom_vs_double_bottom", ("head_and_shoulders_bottom", "double_bottom"), "named", 98, "head_and_shoulders_bottom", False),
    Rule("conflict_island_bottom_vs_continuation_down", ("island_reversal_bottom",), "invalid", 98, evidence={"continuation_down": True}),
    Rule("conflict_island_top_vs_continuation_up", ("island_reversal_top",), "invalid", 98, evidence={"continuation_up": True}),
    Rule("conflict_tower_bottom_two_bearish_only", ("tower_bottom",), "invalid", 86, evidence={"bearish_bar_count": {"lt": 3}}),
    Rule("conflict_high_parallel_one_bullish", ("high_parallel_bullish",), "invalid", 86, evidence={"bullish_bar_count": {"lt": 2}}),
    Rule("conflict_three_falling_non_contiguous", ("three_falling_candles",), "invalid", 88, evidence={"consecutive_bearish_bars": {"lt": 3}}),
    Rule("conflict_acceleration_vs_continuous_decline", ("acceleration_line", "continuous_decline"), "score", 90),
    Rule("conflict_duplicate_trendline", ("trendline_break", "dynamic_t_line"), "score", 84, needs_confirmation=False, apart=2),
    Rule("conflict_opposite_reversals_short_term", ("double_top", "double_bottom"), "both lose", 96, apart=5),
    Rule("conflict_opposite_head_shoulders_short_term", ("head_and_shoulders_top", "head_and_shoulders_bottom"), "both lose", 97, apart=5),
    Rule("conflict_opposite_islands_short_term", ("island_reversal_top", "island_reversal_bottom"), "both lose", 99, apart=5),
    Rule("conflict_confirmed_chart_vs_unconfirmed_candle", (), "chart over candle", 100),
    Rule("conflict_higher_timeframe_chart", (), "higher timeframe", 100),
)
EVIDENCE = ("continuation_down", "continuation_up", "bearish_bar_count", "bullish_bar_count", "consecutive_bearish_bars")
CANDLES = ("simple", "combination")
OVER_CANDLE, OVER_TIMEFRAME, BOTH_LOSE, INVALID = 20.0, 18.0, 16.0, 100.0
FULL_SCORE, LEAST_SURE = 130.0, 0.58
#: Names of this library's detectors that the rules know by another name.
CANONICAL = {
    "piercing": "piercing_pattern", "dark_cloud": "dark_cloud_cover", "three_red": "red_three_soldiers", "white_soldiers": "red_three_soldiers",
    "inverted_three": "three_reverse_bullish", "three_crows": "three_black_crows", "gap_twins_high": "high_parallel_bullish", "three_falling": "three_falling_candles",
    "acceleration": "acceleration_line", "gradual_decline": "continuous_decline", "triple_top": "double_top", "triple_bottom": "double_bottom",
    "compound_head_and_shoulders_top": "head_and_shoulders_top", "compound_head_and_shoulders_bottom": "head_and_shoulders_bottom",
}


def canonical(pattern: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in CANONICAL.items() for x in pair])
    return F.coalesce(F.try_element_at(names, pattern), pattern)


def scored(signals: DataFrame) -> DataFrame:
    weights = looked_up(F.col("kind"), KIND_WEIGHT) + looked_up(F.col("timeframe"), TIMEFRAME_WEIGHT) + looked_up(F.col("state"), STATE_WEIGHT)
    bonus = F.when(F.col("confirmed"), float(CONFIRMED_BONUS)).otherwise(0.0)
    return signals.withColumn("base", F.col("confidence") * 100 + weights + bonus)


def rule_edits(signals: DataFrame, matches: DataFrame) -> DataFrame:
    """Edits (case, ord, rule, delta) by expert rules (case, rule_id, winner, loser, adjustment, priority, applies_to) that a case fulfils."""
    own = signals.select("case", "ord", "pattern")
    met = own.join(matches.select("case", "rule_id", "winner", "loser", (F.col("adjustment") * 100).alias("move"), "priority", "applies_to"), "case")
    charts = F.col("rule_id").startswith("chart_") & F.array_contains(F.transform("applies_to", canonical), F.col("pattern"))
    wins = F.coalesce(F.col("pattern") == canonical(F.col("winner")), F.lit(False)) | F.coalesce(charts, F.lit(False))
    loses = F.coalesce(F.col("pattern") == canonical(F.col("loser")), F.lit(False))
    delta = F.when(wins, F.col("move") + F.col("priority") * 0.2).otherwise(0.0) - F.when(loses, F.abs("move") + F.col("priority") * 0.1).otherwise(0.0)
    return met.where(wins | loses).select("case", "ord", F.lit(-1).alias("rule"), delta.alias("delta"), F.lit(False).alias("beaten"))


PAIRED = ("ord", "pattern", "direction", "kind", "timeframe", "confirmed", "start", "end", "trend")


def met_pairs(left: DataFrame, right: DataFrame, keys: list[str], apart: Column | int, block: int, fields: Sequence[str] = PAIRED) -> DataFrame:
    """Rows of ``left`` with rows of ``right`` (``l`` and ``r``) of equal keys at most ``apart`` bars away, each pair once.

    Both sides meet in blocks of bars that they reach; a pair counts in the first block that both reach.
    """

    def placed(rows: DataFrame, name: str) -> DataFrame:
        reach = F.lit(apart) if isinstance(apart, int) else apart
        low, high = F.floor((F.col("start") - reach) / block), F.floor((F.col("end") + reach) / block)
        what = F.struct(*fields).alias(name)
        return rows.select(*keys, what, low.alias(f"{name}_low"), F.explode(F.sequence(low, high)).alias("block"), *([reach.alias("apart")] if name == "l" else []))

    both = placed(left, "l").join(placed(right, "r"), [*keys, "block"]).where(F.col("block") == F.greatest("l_low", "r_low"))
    return both.where(F.greatest("l.start", "r.start") - F.least("l.end", "r.end") <= F.col("apart")).drop("block", "l_low", "r_low", "apart")


def by_rule(rules: Sequence[Rule], value) -> Column:
    """``value(rule)`` for the number in the column ``rule``; null where it is None."""
    known = {i: value(r) for i, r in enumerate(rules) if value(r) is not None}
    out = F.lit(None)
    for i, v in known.items():
        out = F.when(F.col("rule") == i, F.lit(v)).otherwise(out)
    return out


def bonus(rule: Rule) -> float:
    return max(10.0, rule.priority * 0.25)


def pair_edits(signals: DataFrame, rules: Sequence[Rule], block: int) -> tuple[DataFrame, DataFrame]:
    """Edits of the rules on two patterns that only add, and the pairs of those that ask for scores."""
    numbers = {p: [i for i, r in enumerate(rules) if p in r.patterns and len(r.patterns) > 1] for r in rules for p in r.patterns}
    known = F.create_map(*[x for p, own in numbers.items() if own for x in (F.lit(p), F.array(*map(F.lit, own)))])
    rows = signals.withColumn("rule", F.explode(F.try_element_at(known, F.col("pattern"))))
    pairs = met_pairs(rows, rows, ["case", "rule"], by_rule(rules, lambda r: r.apart), block).where("l.ord < r.ord")
    way, same = by_rule(rules, lambda r: r.way), F.col("l.pattern") == F.col("r.pattern")
    wanted = by_rule(rules, lambda r: r.winner)
    for i, r in enumerate(rules):
        for trend, pattern in r.by_trend.items():
            wanted = F.when((F.col("rule") == i) & (F.lower("l.trend") == trend), pattern).otherwise(wanted)
    named = F.when(F.col("l.pattern") == wanted, "l").when(F.col("r.pattern") == wanted, "r")
    fits = lambda side: F.coalesce(((F.lower("l.trend") == "up") & (F.col(f"{side}.direction") == "bullish")) | ((F.lower("l.trend") == "down") & (F.col(f"{side}.direction") == "bearish")), F.lit(False))
    first = F.when(F.col("l.confirmed") & ~F.col("r.confirmed"), "l").when(F.col("r.confirmed") & ~F.col("l.confirmed"), "r").when(fits("l") & ~fits("r"), "l").when(fits("r") & ~fits("l"), "r")
    # of two signals with one pattern the rule names a pattern, and so the first of them
    first = F.when(first.isNotNull() & same, "l").otherwise(first)
    pairs = pairs.withColumns({"way": way, "sure": by_rule(rules, lambda r: r.needs_confirmation), "bonus": by_rule(rules, bonus).cast("double")})
    pairs = pairs.withColumn("wins", F.when(way.isin("named", "trend"), named).when(way == "confirmed", first))
    decided = pairs.where((F.col("wins").isNotNull()) & (~F.col("sure") | F.when(F.col("wins") == "l", F.col("l.confirmed")).otherwise(F.col("r.confirmed"))))
    edit = lambda side, delta, beaten: F.struct(F.col(f"{side}.ord").alias("ord"), delta.cast("double").alias("delta"), beaten.alias("beaten"))
    left = F.col("wins") == "l"
    two = F.array(edit("l", F.when(left, F.col("bonus")).otherwise(-F.col("bonus")), ~left), edit("r", F.when(left, -F.col("bonus")).otherwise(F.col("bonus")), left))
    both = F.array(*[edit(side, F.lit(-BOTH_LOSE), F.lit(False)) for side in ("l", "r")])
    lost = pairs.where("way = 'both lose'").select("case", "rule", F.explode(both).alias("e"))
    edits = decided.select("case", "rule", F.explode(two).alias("e")).unionByName(lost)
    return edits.select("case", "e.ord", "rule", "e.delta", "e.beaten"), pairs.where("way = 'score'").select("case", "rule", "l", "r", "sure", "bonus")


def own_edits(signals: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Edits of the rules on one pattern and its evidence: the signal is invalid."""
    hits = []
    for i, r in enumerate(rules):
        if r.way == "invalid":
            holds = F.col("pattern") == r.patterns[0]
            for name, wanted in r.evidence.items():
                holds = holds & condition(F.col(name), wanted)
            hits.append(F.when(holds, F.lit(i)))
    return signals.select("case", "ord", F.explode(F.array_compact(F.array(*hits))).alias("rule"), F.lit(-INVALID).alias("delta"), F.lit(True).alias("beaten"))


def chart_edits(signals: DataFrame, rules: Sequence[Rule], block: int) -> DataFrame:
    """Edits of the two rules by which confirmed charts beat candles of another direction near them."""
    charts, candles = signals.where((F.col("kind") == "chart") & F.col("confirmed")), signals.where(F.col("kind").isin(*CANDLES))
    pairs = met_pairs(charts, candles, ["case"], 1, block).where("l.direction <> r.direction")
    weight = lambda side: looked_up(F.col(f"{side}.timeframe"), TIMEFRAME_WEIGHT)
    hits = []
    for i, r in enumerate(rules):
        holds, size = {"chart over candle": (~F.col("r.confirmed"), OVER_CANDLE), "higher timeframe": (weight("l") > weight("r"), OVER_TIMEFRAME)}.get(r.way, (None, 0))
        if holds is not None:
            hits += [F.when(holds, F.struct(F.col(f"{side}.ord").alias("ord"), F.lit(i).alias("rule"), F.lit(sign * size).alias("delta"))) for side, sign in (("l", 1), ("r", -1))]
    return pairs.select("case", F.explode(F.array_compact(F.array(*hits))).alias("e")).select("case", "e.ord", "e.rule", "e.delta", F.lit(False).alias("beaten"))


def folded(pairs: DataFrame, scores: DataFrame, rule: int, apart: int) -> DataFrame:
    """Edits of one rule that prefers the higher score so far: pairs of an island of near signals in order, each on the scores that the last one left."""
    pairs = pairs.where(F.col("rule") == rule)
    ends = pairs.select("case", F.explode(F.array(F.struct("l.ord", "l.start", "l.end"), F.struct("r.ord", "r.start", "r.end"))).alias("s")).select("case", "s.*").distinct()
    by = Window.partitionBy("case").orderBy("start", "end", "ord")
    reached = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    placed = ends.withColumn("new", F.when(F.col("start") - reached <= apart, 0).otherwise(1)).withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    known = placed.join(scores, ["case", "ord"]).groupBy("case", "island").agg(F.collect_list(F.struct("ord", "score")).alias("held"))
    of = placed.select("case", F.col("ord").alias("of"), "island")
    order = F.struct(F.col("l.ord").alias("a"), F.col("r.ord").alias("b"), F.col("l.confirmed").alias("sure_a"), F.col("r.confirmed").alias("sure_b"), (F.col("l.pattern") == F.col("r.pattern")).alias("same"), "sure", "bonus")
    listed = pairs.withColumn("of", F.col("l.ord")).join(of, ["case", "of"]).groupBy("case", "island").agg(F.array_sort(F.collect_list(order)).alias("pairs"))

    def step(state: Column, p: Column) -> Column:
        score = lambda i: F.get(F.filter(state["held"], lambda h: h["ord"] == i), F.lit(0))["score"]
        left = p["same"] | (score(p["a"]) >= score(p["b"]))

        def moved(left: Column) -> Column:
            delta = lambda i: F.when(i == F.when(left, p["a"]).otherwise(p["b"]), p["bonus"]).when(i == F.when(left, p["b"]).otherwise(p["a"]), -p["bonus"]).otherwise(0.0)
            held = F.transform(state["held"], lambda h: F.struct(h["ord"].alias("ord"), (h["score"] + delta(h["ord"])).alias("score")))
            return F.struct(held.alias("held"), F.concat(state["beaten"], F.array(F.when(left, p["b"]).otherwise(p["a"]))).alias("beaten"))

        counts = ~p["sure"] | F.when(left, p["sure_a"]).otherwise(p["sure_b"])
        return F.when(counts, let(left, moved)).otherwise(state)

    start = F.struct(F.col("held").alias("held"), F.slice(F.transform("held", lambda h: h["ord"]), 1, 0).alias("beaten"))
    done = known.join(listed, ["case", "island"]).select("case", "held", F.aggregate("pairs", start, step).alias("end"))
    both = F.arrays_zip(F.transform("held", lambda h: h["score"]).alias("was"), F.col("end.held").alias("now"))
    each = done.select("case", F.col("end.beaten").alias("beaten"), F.explode(both).alias("s")).where("size(beaten) > 0")
    beaten = F.array_contains("beaten", F.col("s.now.ord"))
    moved = each.select("case", F.col("s.now.ord").alias("ord"), F.lit(rule).alias("rule"), (F.col("s.now.score") - F.col("s.was")).alias("delta"), beaten.alias("beaten"))
    return moved.where("beaten or delta <> 0")


def edits_of(signals: DataFrame, rules: Sequence[Rule] = RULES, matches: DataFrame | None = None, block: int = 64) -> DataFrame:
    """All edits (case, ord, rule, delta, beaten) of ``scored`` signals; rule -1 stands for expert rules."""
    added, asking = pair_edits(signals, rules, block)
    every = added.unionByName(own_edits(signals, rules)).unionByName(chart_edits(signals, rules, block))
    if matches is not None:
        every = every.unionByName(rule_edits(signals, matches))
    every, asking = once(every, "edits"), once(asking, "pairs")
    for i, r in enumerate(rules):
        if r.way == "score":
            before = every.where(F.col("rule") < i).groupBy("case", "ord").agg(F.sum("delta").alias("delta"))
            so_far = signals.select("case", "ord", "base").join(before, ["case", "ord"], "left").select("case", "ord", (F.col("base") + F.coalesce("delta", F.lit(0.0))).alias("score"))
            every = every.unionByName(once(folded(asking, so_far, i, r.apart), "edits"))
    return every


def resolve(signals: DataFrame, rules: Sequence[Rule] = RULES, matches: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Verdicts a case and roles a signal.

    ``signals``: case, ord, pattern (as the rules name it), kind, direction, timeframe,
    state, confirmed, confidence, start, end, family, trend and the columns of EVIDENCE.
    Verdicts: case, winner, pattern, direction, confidence, state, losers, rules.
    Roles: case, ord, score, suppressed, role (winner, loser, other or invalid).
    """
    rows = once(scored(signals), "signals")  # each rule asks for them
    edits = once(edits_of(rows, rules, matches), "edits")
    moved = edits.groupBy("case", "ord").agg(F.sum("delta").alias("delta"), F.max("beaten").alias("suppressed"), F.max(F.col("rule").isin(*[i for i, r in enumerate(rules) if r.way == "invalid"])).alias("struck"))
    rows = rows.join(moved, ["case", "ord"], "left").withColumns({"score": F.col("base") + F.coalesce("delta", F.lit(0.0)), "suppressed": F.coalesce("suppressed", F.lit(False))})
    rows = rows.withColumn("valid", (F.col("state") != "invalidated") & ~F.coalesce("struck", F.lit(False)))
    top = F.max_by(F.struct("ord", "pattern", "direction", "family", "state", "score"), F.when(F.col("valid"), F.struct(F.round("score", 9), -F.col("ord"))))
    won = rows.groupBy("case").agg(top.alias("w"))
    roles = rows.join(won, "case")
    other = F.col("direction") != F.col("w.direction")
    lost = F.col("suppressed") | other | F.coalesce(F.col("family") == F.col("w.family"), F.lit(False))
    role = F.when(~F.col("valid"), "invalid").when(F.col("ord") == F.col("w.ord"), "winner").when(lost, "loser").otherwise("other")
    roles = roles.withColumns({"role": role, "against": F.col("valid") & other})
    applied = edits.where("rule >= 0").groupBy("case").agg(F.collect_set("rule").alias("rules"))  # the rules of the table at most
    names = F.array(*[F.lit(r.name) for r in rules])
    both_lose = [i for i, r in enumerate(rules) if r.way == "both lose"]
    verdicts = roles.groupBy("case").agg(F.first("w").alias("w"), F.count_if(F.col("role") == "loser").alias("losers"), F.max("against").alias("against")).join(applied, "case", "left")
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("w.score") / FULL_SCORE))
    degraded = F.coalesce(F.exists("rules", lambda i: i.isin(*both_lose)), F.lit(False)) | (F.col("against") & (sure < LEAST_SURE))
    state = F.when(F.col("w").isNull(), "invalidated").when(degraded, "degraded").otherwise(F.col("w.state"))
    listed = F.transform(F.array_sort(F.coalesce("rules", F.array().cast("array<int>"))), lambda i: F.get(names, i))
    verdicts = verdicts.select("case", F.col("w.ord").alias("winner"), "w.pattern", "w.direction", F.when(F.col("w").isNotNull(), sure).otherwise(0.0).alias("confidence"), state.alias("state"), "losers", listed.alias("rules"))
    return verdicts, roles.select("case", "ord", "score", "suppressed", "role")
