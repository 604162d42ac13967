"""From detected patterns to judged signals: one shape for all, evidence of each one's span, the gate, and the verdict of each symbol.

Events that say the same (canonical pattern and span) are one signal with the
highest confidence. A case is a symbol's last ``recent`` bars. A signal stays a
candidate unless its detector confirmed it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import once
from . import candles, charts, evidence, resolution
from .bars import with_index
from .judgment import gate_reasons

FIELDS = ("symbol", "pattern", "kind", "direction", "confidence", "start", "end", "confirmed", "family", "height", "pivots", "level")
#: Patterns whose candles rise but which announce a fall.
AGAINST = {"three_reverse_bullish": "bearish"}


def from_candles(bars: DataFrame, recent: int | None = None) -> DataFrame:
    """FIELDS per candlestick of ``candles.detect``: of one bar simple, of more a combination; if asked only of each symbol's last bars."""
    found = candles.detect(bars, recent=recent, keep=("i",)).withColumn("end", F.col("i") - 1)
    pattern = resolution.canonical(F.col("pattern"))
    way = F.when(F.col("direction").isin("bull", "bullish"), "bullish").when(F.col("direction").isin("bear", "bearish"), "bearish").otherwise("neutral")
    for name, direction in AGAINST.items():
        way = F.when(pattern == name, direction).otherwise(way)
    none = F.lit(None)
    return found.select(
        "symbol", pattern.alias("pattern"), F.when(F.col("bars") == 1, "simple").otherwise("combination").alias("kind"), way.alias("direction"), F.lit(0.6).alias("confidence"),
        (F.col("end") - F.col("bars") + 1).cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.lit(False).alias("confirmed"), none.cast("string").alias("family"),
        none.cast("double").alias("height"), F.lit(0).alias("pivots"), none.cast("double").alias("level"),
    )


def from_charts(signals: DataFrame) -> DataFrame:
    """FIELDS per chart structure of ``charts.detect`` or ``charts.best``."""
    pattern = resolution.canonical(F.col("pattern")).alias("pattern")
    return signals.select("symbol", pattern, F.lit("chart").alias("kind"), "direction", "confidence", "start", "end", "confirmed", "family", "height", F.size("pivots").alias("pivots"), "level")


def merged(signals: DataFrame) -> DataFrame:
    """One signal for those of one symbol, pattern and span: the surest, of equal ones the confirmed, then by direction and kind."""
    order = [F.round("confidence", 9).desc(), F.col("confirmed").desc(), "direction", "kind"]
    ranked = signals.withColumn("rank", F.row_number().over(Window.partitionBy("symbol", "pattern", "start", "end").orderBy(*order)))
    return ranked.where("rank = 1").drop("rank")


def gated(signals: DataFrame, bars: DataFrame, timeframe: str, recent: int = 120) -> DataFrame:
    """What ``resolution.resolve`` takes, with the reasons of the gate (empty: it passes), for signals that end in the last ``recent`` bars."""
    history = once(evidence.history_evidence(bars).select("symbol", "trend", "atr", (F.col("bar_count") - 1).alias("last_idx")), "history")
    rows = merged(signals.select(*FIELDS).join(history.select("symbol", "last_idx"), "symbol").where(F.col("end") > F.col("last_idx") - recent)).join(history.drop("last_idx"), "symbol")
    ord_ = F.row_number().over(Window.partitionBy("symbol").orderBy("start", "end", "pattern")) - 1
    rows = once(rows.withColumn("ord", ord_).withColumn("id", F.concat_ws(":", "symbol", F.col("ord").cast("string"))), "signals")
    # bars before a symbol's first span say nothing of its spans
    first = rows.groupBy("symbol").agg(F.greatest(F.min("start"), F.lit(0)).alias("first"))
    asked = with_index(bars).join(first, "symbol").where(F.col("bar_idx") >= F.col("first")).drop("bar_idx", "first")
    spans = rows.join(first, "symbol").select("id", "symbol", *[(F.col(c) - F.col("first")).cast("int").alias(c) for c in ("start", "end")])
    told = evidence.span_evidence(spans, asked).select("id", *resolution.EVIDENCE)
    reasons = gate_reasons(F.coalesce("family", F.lit("")), F.col("pivots"), F.coalesce(F.col("height") / F.col("atr"), F.lit(0.0)))
    rows = rows.join(told, "id").withColumns({"case": F.col("symbol"), "timeframe": F.lit(timeframe), "state": F.when(F.col("confirmed"), "confirmed").when(F.col("kind") == "chart", "candidate").otherwise("detected"), "reasons": reasons})
    return rows.select("case", "ord", "pattern", "kind", "direction", "timeframe", "state", "confirmed", "confidence", "start", "end", "family", "trend", *resolution.EVIDENCE, "reasons")


def signals_of(bars: DataFrame, timeframe: str, recent: int = 120) -> DataFrame:
    """``gated`` candlesticks and chart structures of ``bars``."""
    bars = once(bars, "bars")  # patterns, histories and spans ask for them
    structures = once(charts.best(charts.detect(bars, daily=timeframe == "daily")), "structures")  # its plan is too large to go on from
    return gated(once(from_candles(bars, recent).unionByName(from_charts(structures)), "found"), bars, timeframe, recent)


def candles_of(bars: DataFrame, timeframe: str, recent: int = 120) -> DataFrame:
    """``gated`` candlesticks of ``bars``."""
    bars = once(bars, "bars")
    return gated(from_candles(bars, recent), bars, timeframe, recent)


def judge(bars: DataFrame, timeframe: str = "weekly", recent: int = 120) -> tuple[DataFrame, DataFrame]:
    """Verdicts and roles of the signals that pass the gate."""
    return resolution.resolve(signals_of(bars, timeframe, recent).where("size(reasons) = 0").drop("reasons"))
