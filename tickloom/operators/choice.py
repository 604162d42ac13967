"""Which chart signals of an asset stay when each next one has to be surer and clear of those that stay."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .judgment import FAMILY_RANK, RELATED, looked_up, rolling_threshold, threshold_after

#: Shares of a common span from which two signals exclude each other, and bars between two of one pattern.
OVERLAP, RELATED_OVERLAP, OTHER_OVERLAP, SPACING = 0.65, 0.40, 0.35, 20
ASKED = ("pattern", "direction", "family", "start", "end")


def excludes(one: tuple, other: tuple, overlap: float, spacing: int) -> bool:
    """Whether two signals (ASKED) exclude each other; those without a place, or more than ``spacing`` bars apart, don't."""
    (pattern, direction, family, start, end), (pattern2, direction2, family2, start2, end2) = one, other
    if None in (start, end, start2, end2) or max(start, start2) - min(end, end2) > spacing:
        return False
    if pattern == pattern2 and abs(end - end2) < spacing:
        return True
    share = max(0, min(end, end2) - max(start, start2) + 1) / max(1, max(end, end2) - min(start, start2) + 1)
    kin = {family, family2} in RELATED
    if (kin or family == family2 or direction != direction2) and share > (RELATED_OVERLAP if kin else overlap):
        return True
    return family != family2 and family in FAMILY_RANK and family2 in FAMILY_RANK and share > OTHER_OVERLAP


def stay(batches: Iterator[pa.RecordBatch], overlap: float, spacing: int) -> Iterator[pa.RecordBatch]:
    """The rows that stay, of assets one after the other with their signals in turn; only those that stay are kept in memory."""
    held: list[tuple] = []
    for batch in batches:
        kept, ranks = [], []
        columns = [batch.column(name).to_pylist() for name in ("place", "confidence", *ASKED)]
        for i, (place, confidence, *asked) in enumerate(zip(*columns, strict=True)):
            if place == 1:
                held = []
                least = threshold_after(0)
            if confidence < least or any(excludes(asked, h, overlap, spacing) for h in held):
                continue
            held.append(tuple(asked))
            least = threshold_after(len(held))
            kept.append(i)
            ranks.append(len(held))
        some = batch.take(pa.array(kept, "int64"))
        yield pa.RecordBatch.from_arrays([some.column("asset"), some.column("id"), pa.array(ranks, "int32"), some.column("start"), some.column("end")], ["asset", "id", "rank", "start", "end"])


def chart_set(signals: DataFrame, overlap: float = OVERLAP, spacing: int = SPACING) -> DataFrame:
    """(asset, id, rank, start, end) of the chart signals (with family) that stay.

    Signals take their turn by family, state and confidence, ties by id: a signal stays
    if it is sure enough for as many as stay already and none of these excludes it. As
    only those that stay can exclude, an asset's signals pass in order by the few that
    do, and no pair of signals is made. Signals under the first bar never stay and take
    part in nothing.
    """
    turn = Window.partitionBy("asset").orderBy(looked_up(F.col("family"), FAMILY_RANK).desc(), (F.col("state") == "confirmed").desc(), F.col("confidence").desc(), "id")
    able = signals.where((F.col("kind") == "chart") & (F.col("confidence") >= rolling_threshold(F.lit(0))))
    rows = able.select("asset", "id", F.col("confidence").cast("double").alias("confidence"), *ASKED, F.row_number().over(turn).alias("place"))  # in turn within each task
    of = {f.name: f for f in rows.schema}
    schema = StructType([of["asset"], of["id"], StructField("rank", IntegerType()), of["start"], of["end"]])
    return rows.mapInArrow(partial(stay, overlap=overlap, spacing=spacing), schema)
