"""What people decided about signals goes before what the rules decided.

Decisions apply one after the other, but little of that is left to do in order. Of the
signals of one pattern only the first living one can win, a decision strikes all the
others of a pattern or none, and what is struck stays so. So whether a decision acts
depends only on which patterns of its case still live, decisions of one kind (winner,
verdict, remove, keep) do to a case what the first of them did, and a fold over the
first of each kind finds when each pattern dies. Everything else is joins and sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import once
from .resolution import canonical
from .structure import merge_ranges

#: States in which a signal can't win, and the verdict that nothing is there.
DEAD, NOTHING = ("invalidated", "expired"), "no_pattern"
ANY = "*"
CASE = ("asset", "timeframe")
KIND = ("winner", "verdict", "remove", "keep")
RULE = "winner string, verdict string, remove array<string>, keep array<string>"
ORDER = "struct<at:string,record_id:string,verdict:string,start:long,end:long,winner:string,remove:array<string>,keep:array<string>>"


def folded(text: Column) -> Column:
    return F.nullif(F.lower(F.trim(text)), F.lit(""))


def placed(records: DataFrame) -> DataFrame:
    """Records that can act, by ``for_asset`` and ``for_frame`` (an open one under a key of its own), with ``place``, which rises with time, and ``kind``, what they say as JSON."""
    frames = F.when(F.array_contains("timeframes", ANY) | (F.coalesce(F.size("timeframes"), F.lit(0)) <= 0), F.array(F.lit(ANY))).otherwise(F.col("timeframes"))
    order = F.struct(
        F.coalesce("at", F.lit("")).alias("at"), "record_id", "verdict", F.coalesce("start", "end").alias("start"), F.coalesce("end", "start").alias("end"), canonical(F.col("winner")).alias("winner"),
        *[F.coalesce(F.transform(c, canonical), F.array().cast("array<string>")).alias(c) for c in ("remove", "keep")],
    ).cast(ORDER)
    rows = records.select(F.coalesce(folded("asset"), F.lit(ANY)).alias("for_asset"), F.explode(F.array_distinct(frames)).alias("for_frame"), order.alias("order"))
    rows = rows.where(F.col("order.winner").isNotNull() | (F.col("order.verdict") == NOTHING)).orderBy("order")
    kind = F.to_json(F.struct(*[f"order.{c}" for c in KIND])).alias("kind")
    return once(rows.select("for_asset", "for_frame", F.monotonically_increasing_id().alias("place"), "order.record_id", "order.start", "order.end", "order.winner", kind), "records")


def reached(signals: DataFrame) -> DataFrame:
    """Per case the bars that its signals cover, as ``spans`` that don't overlap; a signal that ends before it starts is a span of its own."""
    ends = signals.where("start is not null and end is not null").select(F.struct(*CASE).alias("case"), F.col("start").alias("start_idx"), F.col("end").alias("end_idx")).distinct()
    covered = merge_ranges(ends.where("start_idx <= end_idx"), "case", 0).drop("n").unionByName(ends.where("start_idx > end_idx"))
    spans = covered.groupBy("case").agg(F.collect_list(F.struct(F.col("start_idx").alias("start"), F.col("end_idx").alias("end"))).alias("spans"))
    return signals.select(*CASE).distinct().join(spans.select("case.*", "spans"), list(CASE), "left")


def keyed(cases: DataFrame, parts: int) -> DataFrame:
    """``cases`` under each key by which a record can mean them, those of open records once a part."""
    pairs = F.array(*[F.struct(a.alias("for_asset"), t.alias("for_frame")) for a in (folded(F.col("asset")), F.lit(ANY)) for t in (F.col("timeframe"), F.lit(ANY))])
    each = cases.withColumn("key", F.explode(F.array_distinct(pairs))).select(*cases.columns, "key.*")
    return each.withColumn("part", F.explode(F.sequence(F.lit(0), F.when(is_open(), parts - 1).otherwise(0))))


def is_open() -> Column:
    return F.coalesce((F.col("for_asset") == ANY) | (F.col("for_frame") == ANY), F.lit(False))


def matching(signals: DataFrame, rows: DataFrame, parts: int = 64) -> DataFrame:
    """(asset, timeframe, place, record_id, winner, kind): the records (as ``placed`` gives them) that are about a case.

    A record without asset, timeframes or span is about all of them; open ones are dealt
    over ``parts``, as all cases meet them. A span has to share a bar with a signal.
    """
    rows = rows.withColumn("part", F.when(is_open(), F.pmod(F.xxhash64("record_id"), F.lit(parts))).otherwise(0).cast("int"))
    keys = ["for_asset", "for_frame", "part"]
    told = [*CASE, "place", "record_id", "winner", "kind"]
    shares = lambda s: (s["start"] <= F.col("end")) & (s["end"] >= F.col("start"))
    backward = F.coalesce(F.col("start") > F.col("end"), F.lit(False))
    met = keyed(once(reached(signals), "cases"), parts).join(rows, keys)
    ahead = met.where(~backward & (F.col("start").isNull() | F.coalesce(F.exists("spans", shares), F.lit(False)))).select(told)
    # a span that ends before it starts has to lie within one signal
    ends = signals.select(*CASE, F.struct("start", "end").alias("s")).distinct()
    odd = met.where(backward).join(ends, list(CASE)).where(shares(F.col("s"))).select(told).distinct()
    return ahead.unionByName(odd)


def strikes(record: Column, name: Column) -> Column:
    """Whether a record strikes the signals of ``name`` that don't win by it."""
    has = lambda names: F.array_contains(names, name)
    out = F.coalesce(has(record["remove"]), F.lit(False)) | ((F.size(record["keep"]) > 0) & F.coalesce(~has(record["keep"]), F.lit(False)))
    return record["winner"].isNull() | out


def lives(signals: DataFrame, met: DataFrame) -> DataFrame:
    """(asset, timeframe, winner, ord, death): each pattern with a signal that can win, and the record that strikes the last of them, null if none."""
    first = met.groupBy(*CASE, "kind").agg(F.min("place").alias("place")).withColumn("rule", F.from_json("kind", RULE))
    kinds = first.groupBy(*CASE).agg(F.sort_array(F.collect_list(F.struct("place", "rule.*"))).alias("kinds"))  # one a kind
    able = signals.where("able").select(*CASE, "name", "ord", "able")
    alive = able.groupBy(*CASE).agg(F.collect_list("name").alias("alive")).join(kinds, list(CASE))
    start = F.struct(F.col("alive"), F.map_from_arrays(F.slice("alive", 1, 0), F.array().cast("array<long>")).alias("deaths"))

    def step(held: Column, r: Column) -> Column:
        acts = r["winner"].isNull() | F.array_contains(held["alive"], r["winner"])
        struck = lambda n: acts & F.coalesce(n != r["winner"], F.lit(True)) & strikes(r, n)
        gone = F.filter(held["alive"], struck)
        return F.struct(F.filter(held["alive"], lambda n: ~struck(n)).alias("alive"), F.map_concat(held["deaths"], F.map_from_arrays(gone, F.transform(gone, lambda n: r["place"]))).alias("deaths"))

    died = alive.select(*CASE, F.explode(F.aggregate("kinds", start, step)["deaths"]).alias("name", "death"))
    return able.join(died, [*CASE, "name"], "left").withColumnRenamed("name", "winner")


def override(signals: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The signals (asset, timeframe, ord, pattern, state, confirmed, confidence, start, end) as people left them, and a row a case with what was decided.

    The records of a case (asset and timeframe) apply one after the other, so the latest has
    the last word. One without a winner that says ``no_pattern`` invalidates all signals. One
    with a winner confirms the first signal of that pattern, by ``ord``, that isn't
    invalidated or expired, takes the confirmation from all others, and invalidates those
    in ``remove`` or, if ``keep`` has any, not in it; if there is no such signal it is
    unmatched. A case without records stays as it is, with a null winner and state. Signals
    of a null asset or timeframe are cases of their own that only open records reach.
    """
    known = signals.select(
        *[F.coalesce(c, F.lit("")).alias(c) for c in CASE], F.col("ord").cast("long").alias("ord"), canonical(F.col("pattern")).alias("name"), "pattern", "state", "confirmed",
        F.col("confidence").cast("double").alias("confidence"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"),
    )
    living = F.coalesce(F.col("name").isNotNull() & ~F.col("state").isin(*DEAD), F.lit(False))
    turn = Window.partitionBy(*CASE, "name", living).orderBy("ord", "pattern", "state", "confirmed", "confidence", "start", "end")
    known = once(known.withColumn("able", living & (F.row_number().over(turn) == 1)), "signals")  # plans that go on from here are large
    rows = placed(records)
    met = matching(known, rows)
    names = once(lives(known, met), "lives")  # a row a pattern of a case, for each of the records
    told = met.join(names, [*CASE, "winner"], "left")
    acts = F.col("winner").isNull() | (F.col("able") & F.coalesce(F.col("place") < F.col("death"), F.lit(True)))
    told = told.withColumn("acts", F.coalesce(acts, F.lit(False)))
    return left_as(known, told, rows.select("place", "record_id")), said_of(known, told)


def left_as(known: DataFrame, told: DataFrame, ids: DataFrame) -> DataFrame:
    """The signals after all records."""
    last = told.where("acts").groupBy(*CASE, "kind").agg(F.max("place").alias("place")).join(ids, "place").withColumn("rule", F.from_json("kind", RULE))
    deeds = last.groupBy(*CASE).agg(F.sort_array(F.collect_list(F.struct("place", "record_id", "rule.*"))).alias("deeds"))  # one a kind
    wins = lambda d: F.col("able") & F.coalesce(d["winner"] == F.col("name"), F.lit(False))
    empty = lambda d: d["winner"].isNull()
    by = lambda test: F.get(F.reverse(F.filter("deeds", test)), F.lit(0))["record_id"]
    groups = known.select(*CASE, "name", "able").distinct().join(deeds, list(CASE)).select(
        *CASE, "name", "able", wins(F.element_at("deeds", -1)).alias("sure"), F.exists("deeds", wins).alias("won"), F.exists("deeds", lambda d: ~wins(d) & strikes(d, F.col("name"))).alias("struck"),
        by(lambda d: empty(d) | wins(d)).alias("decided_by"), by(lambda d: ~empty(d) & ~wins(d)).alias("suppressed_by"),
    )
    same = [F.col(f"k.{c}").eqNullSafe(F.col(f"g.{c}")) for c in (*CASE, "name", "able")]
    rows = known.alias("k").join(groups.alias("g"), same, "left")
    return rows.select(
        *[F.nullif(F.col(f"k.{c}"), F.lit("")).alias(c) for c in CASE], "k.ord", "k.pattern", F.when(F.col("struck"), "invalidated").when(F.col("won"), "confirmed").otherwise(F.col("k.state")).alias("state"),
        F.coalesce("sure", "k.confirmed").alias("confirmed"), F.when(F.col("won"), 1.0).otherwise(F.col("k.confidence")).alias("confidence"), "k.start", "k.end", "decided_by", "suppressed_by",
    )


def said_of(known: DataFrame, told: DataFrame) -> DataFrame:
    """A row a case: the last record that acts, and the ids of those that did and of those that found no signal, in order."""
    ids = lambda test: F.transform(F.sort_array(F.collect_list(F.when(test, F.struct("place", "record_id")))), lambda r: r["record_id"])
    last = F.max(F.when(F.col("acts"), F.struct("place", "winner", "ord")))
    each = told.groupBy(*CASE).agg(last.alias("last"), ids(F.col("acts")).alias("applied"), ids(~F.col("acts")).alias("unmatched"))
    none = F.array().cast("array<string>")
    state = F.when(F.col("last").isNotNull(), F.when(F.col("last.winner").isNull(), "invalidated").otherwise("confirmed"))
    rows = known.select(*CASE).distinct().join(each, list(CASE), "left")
    return rows.select(
        *[F.nullif(c, F.lit("")).alias(c) for c in CASE], F.col("last.ord").alias("winner"), state.alias("state"), F.when(F.col("last").isNotNull(), 1.0).alias("confidence"),
        F.coalesce("applied", none).alias("applied"), F.coalesce("unmatched", none).alias("unmatched"),
    )
