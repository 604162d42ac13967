"""Human decisions over signals against plain loops on random cases with open and null scopes."""

import random

from tickloom.operators import overrides

FIELDS = ("ord", "pattern", "state", "confirmed", "confidence", "start", "end")
SIGNALS = "asset string, timeframe string, ord long, pattern string, state string, confirmed boolean, confidence double, start long, end long"
RECORDS = "record_id string, at string, asset string, timeframes array<string>, start long, end long, winner string, verdict string, remove array<string>, keep array<string>"


def plain(case, signals, records):
    signals, winner, applied, unmatched = [dict(zip(FIELDS, s[2:], strict=True)) for s in sorted(signals, key=lambda s: s[2])], None, [], []
    for rid, _, asset, frames, start, end, name, verdict, remove, keep in sorted(records, key=lambda r: (r[1] or "", r[0])):
        if asset and asset.strip().lower() != (case[0] or "").lower() or frames and case[1] not in frames:
            continue
        low, high = start if start is not None else end, end if end is not None else start
        if low is not None and not any(s["start"] <= high and s["end"] >= low for s in signals):
            continue
        if name is None:
            if verdict == "no_pattern":
                applied.append(rid)
                winner = None
                for s in signals:
                    s.update(state="invalidated", confirmed=False)
            continue
        alive = [s for s in signals if s["pattern"] == name and s["state"] not in ("invalidated", "expired")]
        if not alive:
            unmatched.append(rid)
            continue
        applied.append(rid)
        winner = alive[0]["ord"]
        for s in signals:
            if s is alive[0]:
                s.update(state="confirmed", confirmed=True, confidence=1.0)
            else:
                s.update(confirmed=False, state="invalidated" if s["pattern"] in (remove or []) or keep and s["pattern"] not in keep else s["state"])
    return [tuple(s.values()) for s in signals], winner, applied, unmatched


def test_random_cases(spark):
    rng = random.Random(12)
    names = [f"pattern_{c}" for c in "abcd"]
    some = lambda: rng.choice([None, [], rng.sample(names, 1), rng.sample(names, 2)])
    signals = []
    for n in range(240):
        start = rng.randint(0, 60)
        signals.append((rng.choice(["A", "b", "c", "d", None]), rng.choice(["day", "week", None]), n, rng.choice(names), rng.choice(["detected", "confirmed", "expired", "invalidated"]), rng.random() < 0.5, 0.5, start, start + rng.randint(0, 20)))
    records = []
    for n in range(40):
        winner = rng.choice([*names, *names, None])
        start = rng.choice([None, rng.randint(0, 90)])
        records.append((f"r{n:02}", rng.choice([None, "2024", "2025", f"2024-{n}"]), rng.choice(["a", " B ", "c", "", None, "z"]), rng.choice([None, [], ["day"], ["day", "week"]]), start, rng.choice([None, (start or 0) + 15]), winner, rng.choice(["no_pattern", None]) if winner is None and n % 5 == 0 else None, some(), some()))
    rows, cases = overrides.override(spark.createDataFrame(signals, SIGNALS), spark.createDataFrame(records, RECORDS))
    rows, cases = rows.collect(), {(r["asset"], r["timeframe"]): r for r in cases.collect()}
    assert cases.keys() == {s[:2] for s in signals}
    for key, case in cases.items():
        want, winner, applied, unmatched = plain(key, [s for s in signals if s[:2] == key], records)
        assert sorted(tuple(r[c] for c in FIELDS) for r in rows if (r["asset"], r["timeframe"]) == key) == sorted(want)
        assert (case["applied"], case["unmatched"]) == (applied, unmatched)
        assert case["winner"] == winner and (case["confidence"] == 1.0) == bool(applied)
    assert any(len(c["applied"]) > 1 for c in cases.values()) and any(c["unmatched"] for c in cases.values()) and any(c["winner"] for c in cases.values())


def test_no_records(spark):
    signals = spark.createDataFrame([("a", "day", 1, "pattern_a", "detected", True, 0.4, 1, 5)], SIGNALS)
    rows, cases = overrides.override(signals, spark.createDataFrame([], RECORDS))
    assert [tuple(r[c] for c in FIELDS) for r in rows.collect()] == [(1, "pattern_a", "detected", True, 0.4, 1, 5)]
    assert [tuple(r) for r in cases.collect()] == [("a", "day", None, None, None, [], [])]
    assert overrides.override(signals.where("false"), spark.createDataFrame([], RECORDS))[0].collect() == []
