"""Conflict rules against a plain loop over all pairs, one rule after the other."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tickloom.operators import judged, resolution
from tickloom.operators.bars import build
from tickloom.operators.judgment import CONFIRMED_BONUS, KIND_WEIGHT, STATE_WEIGHT, TIMEFRAME_WEIGHT, gate_reasons
from tickloom.sources.bars import supplier_walk

SCHEMA = (
    "case string, ord int, pattern string, kind string, direction string, timeframe string, state string, confirmed boolean, confidence double, start int, end int, family string, trend string, "
    "continuation_down boolean, continuation_up boolean, bearish_bar_count long, bullish_bar_count long, consecutive_bearish_bars long"
)
NAMES = [f.split()[0] for f in SCHEMA.split(", ")]
MATCHES = "case string, rule_id string, winner string, loser string, adjustment double, priority int, applies_to array<string>"


def near(a, b, apart=1):
    return max(a["start"], b["start"]) - min(a["end"], b["end"]) <= apart


def holds(value, wanted):
    if isinstance(wanted, dict):
        return value is not None and value < wanted["lt"]
    return value == wanted


def plain(signals, matches=()):
    """(verdict, {ord: (score, suppressed, role)}) of one case's signals in order."""
    score = {s["ord"]: s["confidence"] * 100 + KIND_WEIGHT[s["kind"]] + TIMEFRAME_WEIGHT[s["timeframe"]] + STATE_WEIGHT[s["state"]] + CONFIRMED_BONUS * s["confirmed"] for s in signals}
    for m in matches:
        for s in signals:
            if s["pattern"] == m["winner"] or m["rule_id"].startswith("chart_") and s["pattern"] in m["applies_to"]:
                score[s["ord"]] += m["adjustment"] * 100 + m["priority"] * 0.2
            if m["loser"] and s["pattern"] == m["loser"]:
                score[s["ord"]] -= abs(m["adjustment"] * 100) + m["priority"] * 0.1
    beaten, struck, applied, degraded = set(), set(), [], False
    for rule in resolution.RULES:
        if rule.way == "invalid":
            for s in signals:
                if s["pattern"] in rule.patterns and all(holds(s[k], w) for k, w in rule.evidence.items()):
                    struck.add(s["ord"])
                    beaten.add(s["ord"])
                    score[s["ord"]] -= 100
                    applied.append(rule.name)
            continue
        if not rule.patterns:
            for a in signals:
                for b in signals:
                    if a["kind"] != "chart" or not a["confirmed"] or b["kind"] not in ("simple", "combination") or a["direction"] == b["direction"] or not near(a, b):
                        continue
                    if rule.way == "chart over candle" and not b["confirmed"] or rule.way == "higher timeframe" and TIMEFRAME_WEIGHT[a["timeframe"]] > TIMEFRAME_WEIGHT[b["timeframe"]]:
                        size = 20 if rule.way == "chart over candle" else 18
                        score[a["ord"]] += size
                        score[b["ord"]] -= size
                        applied.append(rule.name)
            continue
        for i, a in enumerate(signals):
            for b in signals[i + 1 :]:
                if a["pattern"] not in rule.patterns or b["pattern"] not in rule.patterns or not near(a, b, rule.apart):
                    continue
                if rule.way == "both lose":
                    score[a["ord"]] -= 16
                    score[b["ord"]] -= 16
                    degraded = True
                    applied.append(rule.name)
                    continue
                wanted = rule.winner
                if rule.way == "trend":
                    wanted = rule.by_trend.get(a["trend"])
                elif rule.way == "confirmed":
                    fits = [s["pattern"] for s in (a, b) if (a["trend"], s["direction"]) in (("up", "bullish"), ("down", "bearish"))]
                    wanted = a["pattern"] if a["confirmed"] and not b["confirmed"] else b["pattern"] if b["confirmed"] and not a["confirmed"] else fits[0] if len(fits) == 1 else None
                elif rule.way == "score":
                    wanted = a["pattern"] if score[a["ord"]] >= score[b["ord"]] else b["pattern"]
                if wanted not in (a["pattern"], b["pattern"]):
                    continue
                winner, loser = (a, b) if a["pattern"] == wanted else (b, a)
                if rule.needs_confirmation and not winner["confirmed"]:
                    continue
                bonus = max(10, rule.priority / 4)
                score[winner["ord"]] += bonus
                score[loser["ord"]] -= bonus
                beaten.add(loser["ord"])
                applied.append(rule.name)
    valid = [s for s in signals if s["state"] != "invalidated" and s["ord"] not in struck]
    names = [r.name for r in resolution.RULES if r.name in applied]
    roles = {s["ord"]: "invalid" for s in signals}
    if not valid:
        return (None, None, None, 0.0, "invalidated", 0, names), {o: (round(score[o], 6), o in beaten, r) for o, r in roles.items()}
    top = max(valid, key=lambda s: (round(score[s["ord"]], 9), -s["ord"]))
    for s in valid:
        loses = s["ord"] in beaten or s["direction"] != top["direction"] or s["family"] and s["family"] == top["family"]
        roles[s["ord"]] = "winner" if s is top else "loser" if loses else "other"
    sure = max(0.0, min(1.0, score[top["ord"]] / 130))
    state = "degraded" if degraded or sure < 0.58 and any(s["direction"] != top["direction"] for s in valid) else top["state"]
    verdict = (top["ord"], top["pattern"], top["direction"], round(sure, 6), state, list(roles.values()).count("loser"), names)
    return verdict, {o: (round(score[o], 6), o in beaten, r) for o, r in roles.items()}


def random_signals(seed):
    rng = random.Random(seed)
    patterns = sorted({p for r in resolution.RULES for p in r.patterns}) + ["hammer", "flag"]
    out = []
    for case in range(60):
        trend, few = rng.choice(["up", "down", "range", None]), rng.sample(patterns, rng.randint(1, 6))
        for ord_ in range(rng.randint(1, 25)):
            start = rng.randint(0, 120)
            out.append((
                f"c{case}", ord_, rng.choice(few), rng.choice(list(KIND_WEIGHT)), rng.choice(["bullish", "bearish", "neutral"]), rng.choice(["daily", "weekly", "monthly"]),
                rng.choice(["confirmed", "candidate", "detected", "degraded", "invalidated"]), rng.random() < 0.4, rng.randint(0, 20) / 20, start, start + rng.choice([0, 1, 4, 30, 90]),
                rng.choice([None, "a", "b"]), trend, rng.choice([True, False, None]), rng.choice([True, False, None]), rng.choice([None, 1, 5]), rng.choice([None, 1, 5]), rng.choice([None, 2, 3]),
            ))
    return out


def check(spark, rows, matches):
    by, of = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r[0]].append(dict(zip(NAMES, r, strict=True)))
    for m in matches:
        of[m[0]].append(dict(zip(("case", "rule_id", "winner", "loser", "adjustment", "priority", "applies_to"), m, strict=True)))
    want = {case: plain(own, of[case]) for case, own in by.items()}
    verdicts, roles = resolution.resolve(spark.createDataFrame(rows, SCHEMA).repartition(3), matches=spark.createDataFrame(matches, MATCHES) if matches else None)
    got = {r["case"]: (r["winner"], r["pattern"], r["direction"], round(r["confidence"], 6), r["state"], r["losers"], r["rules"]) for r in verdicts.collect()}
    assert got == {c: v for c, (v, _) in want.items()}
    own = defaultdict(dict)
    for r in roles.collect():
        own[r["case"]][r["ord"]] = (round(r["score"], 6), r["suppressed"], r["role"])
    assert own == {c: r for c, (_, r) in want.items()}
    return want


def test_random_cases(spark):
    rows = [r for seed in range(2) for r in ((f"{seed}{x[0]}", *x[1:]) for x in random_signals(seed))]
    want = check(spark, rows, [])
    fired = {n for v, _ in want.values() for n in v[6]}
    assert fired == {r.name for r in resolution.RULES}


def test_expert_rules_move_scores(spark):
    rows = random_signals(9)
    matches = [(f"c{i}", "chart_x" if i % 2 else "x", "double_top", "hammer" if i % 3 else None, 0.1, 40, ["island_reversal_top"]) for i in range(60)]
    check(spark, rows, matches)


@pytest.mark.parametrize("n", [300])
def test_a_chain_of_one_case_is_folded_in_order(spark, n):
    rng = random.Random(1)
    rows = [("x", i, rng.choice(["trendline_break", "dynamic_t_line"]), "trend", "bullish", "daily", "candidate", rng.random() < 0.5, rng.random(), i // 3 * 4, i // 3 * 4 + rng.randint(0, 3), None, "up", None, None, None, None, None) for i in range(n)]
    check(spark, rows, [])


def test_judged_walks(spark):
    bars = build(supplier_walk(spark, "/root/testdata/sf0.001"))
    signals = judged.signals_of(bars, "weekly").cache()
    rows = [r.asDict() for r in signals.collect()]
    kept = [r for r in rows if not r["reasons"]]
    assert {r["kind"] for r in kept} >= {"simple", "combination", "chart"} and len(kept) < len(rows)
    by = defaultdict(list)
    for r in sorted(kept, key=lambda r: (r["case"], r["ord"])):
        by[r["case"]].append(r)
    want = {case: plain(own)[0] for case, own in by.items()}
    verdicts, _ = resolution.resolve(signals.where("size(reasons) = 0").drop("reasons"))
    assert {r["case"]: (r["winner"], r["pattern"], r["direction"], round(r["confidence"], 6), r["state"], r["losers"], r["rules"]) for r in verdicts.collect()} == want


def test_gate_asks_for_twenty_bars(spark):
    rows = spark.createDataFrame([("chart", 0, 18, 0.5), ("chart", 0, 19, 0.5), ("simple", 0, 0, 0.5)], "kind string, start int, end int, confidence double")
    got = rows.select(gate_reasons(F.lit("consolidation"), F.lit(4), F.lit(3.0)).alias("r")).collect()
    assert [r["r"] for r in got] == [["too short"], [], []]


def test_nothing_to_resolve(spark):
    verdicts, roles = resolution.resolve(spark.createDataFrame([], SCHEMA))
    assert verdicts.collect() == [] and roles.collect() == []
