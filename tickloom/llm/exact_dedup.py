"""Exact dedup by an extendible-hash index on shared files.

Texts are equal when they are identical after each run of white space
(``[\\x20\\x09-\\x0D]+``) has become one space; a null text counts as empty.

1. Marks. One scan writes (doc_id, 64-bit hash, SHA-256) of each row to the shared
   folder. Rows are counted by hash, combined in each map task before the shuffle,
   so a text that a third of all rows share costs one row a task.
2. Directory. A bucket is a prefix of the hash. The directory starts at the depth
   at which buckets are expected to be half full; every bucket with more than
   ``capacity`` hashes splits on the next bit, which doubles the directory there,
   until none is overfull. Hashes that agree in all 63 bits can't be split: they
   chain. Only overfull buckets are tables; all else is arithmetic on the hash.
3. Bytes. A hash that one row has is an entry. The rows of all other hashes are
   grouped by (hash, whole text), again combined before the shuffle, so equal hashes
   never decide: bytes do.
4. Index. Owner tasks take ranges of (bucket, hash), walk the chain of entries that
   share a hash, check that neighbours differ in bytes and in SHA-256, number it, and
   write the entries, sorted, to Parquet files in the shared folder.
5. Lookup. A row finds its bucket by the directory, and in the bucket its entry by
   (hash, SHA-256), which step 4 has shown to name one text. No text is moved, and
   Spark splits a skewed side.

Defined results: an empty table gives no rows; a null doc_id loses to any
other, and a group that has only null ids keeps null; rows that repeat a doc_id
and its text share one verdict and all count in ``group_size``; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh_path, text_or_empty

SPACE = r"[\x20\x09-\x0D]+"
MOST_DEPTH = 63
#: As many repeated hashes are sent to all tasks at most; beyond them all rows are grouped by text.
BROADCAST_HASHES = 500_000


def normalised(name: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(name), SPACE, " ")


def slot(depth: int) -> Column:
    """The first ``depth`` bits of the hash."""
    return F.shiftrightunsigned("hash", 64 - depth) if depth else F.lit(0).cast("long")


class Directory:
    """From depth ``start`` on, the overfull buckets of each depth; ``place`` gives rows their bucket."""

    def __init__(self, hashes: DataFrame, capacity: int, start: int) -> None:
        self.start, self.full = start, []
        rows, depth = hashes.select("hash"), start
        while depth < MOST_DEPTH:
            full = cut(rows.groupBy(slot(depth).alias("slot")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > capacity).select("slot"))
            if full.isEmpty():
                break
            self.full.append(full)
            rows = rows.withColumn("slot", slot(depth)).join(full, "slot", "left_semi").select("hash")
            depth += 1

    def place(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``depth`` and ``bucket``, the prefix at that depth moved to the front of 63 bits."""
        depth = F.lit(self.start)
        for level, full in enumerate(self.full, self.start):
            known = full.select(F.col("slot").alias(f"__slot_{level}"))
            rows = rows.join(known, slot(level) == F.col(f"__slot_{level}"), "left")
            depth = F.when(F.col(f"__slot_{level}").isNotNull(), level + 1).otherwise(depth)
        rows = rows.withColumn("depth", depth).drop(*[f"__slot_{level}" for level in range(self.start, self.start + len(self.full))])
        return rows.withColumn("bucket", F.expr(f"shiftleft(shiftright(shiftrightunsigned(hash, 1), {MOST_DEPTH} - depth), {MOST_DEPTH} - depth)"))


def marks(docs: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, carried columns, hash, text_sha256) of each row."""
    rows = docs.select("doc_id", *carried, normalised().alias("body"))
    return rows.select("doc_id", *carried, F.xxhash64("body").alias("hash"), F.sha2("body", 256).alias("text_sha256"))


def entries(docs: DataFrame, hashes: DataFrame, repeated: DataFrame, n_repeated: int) -> DataFrame:
    """(hash, text_sha256, body, keep_id, group_size), one row per distinct text; body only where rows share a hash."""
    rows = docs.select("doc_id", normalised().alias("body")).withColumn("hash", F.xxhash64("body"))
    if n_repeated <= BROADCAST_HASHES:
        rows = rows.join(F.broadcast(repeated), "hash", "left_semi")
    grouped = rows.groupBy("hash", "body").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    compared = grouped.join(repeated, "hash", "left_semi").select("hash", F.sha2("body", 256).alias("text_sha256"), "body", "keep_id", "group_size")
    single = hashes.where("group_size = 1").select("hash", "text_sha256", F.lit(None).cast("string").alias("body"), "keep_id", "group_size")
    return compared.unionByName(single)


def build_index(docs: DataFrame, marked: DataFrame, capacity: int = 4096, start: int | None = None) -> tuple[str, Directory]:
    """Write the index of ``docs``; the path of its files and the directory."""
    hashes = cut(marked.groupBy("hash").agg(F.min("text_sha256").alias("text_sha256"), F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    counted = hashes.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("group_size") > 1).alias("repeated")).first()
    found = Directory(hashes, capacity, max(0, ceil(log2(2 * counted["n"] / capacity))) if start is None and counted["n"] else start or 0)
    repeated = hashes.where("group_size > 1").select("hash")
    owned = found.place(entries(docs, hashes, repeated, counted["repeated"])).repartitionByRange("bucket", "hash")
    chain = Window.partitionBy("bucket", "hash").orderBy("text_sha256")
    differs = F.lag("text_sha256").over(chain).isNull() | ((F.lag("text_sha256").over(chain) != F.col("text_sha256")) & (F.lag("body").over(chain) != F.col("body")))
    index = owned.withColumns({"chain": F.row_number().over(chain), "differs": differs})
    checked = F.when(F.col("differs"), F.col("keep_id")).otherwise(F.raise_error(F.lit("two texts share hash and SHA-256")).cast(docs.schema["doc_id"].dataType))
    path = fresh_path(docs.sparkSession, "exact-index")
    index.select("bucket", "depth", "hash", "chain", "text_sha256", checked.alias("keep_id"), "group_size").write.parquet(path)
    return path, found


def exact_dedup(docs: DataFrame, capacity: int = 4096, start: int | None = None, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and the ``carried`` columns per row of ``docs``."""
    marked = cut(marks(docs, carried))
    path, found = build_index(docs, marked, capacity, start)
    index = docs.sparkSession.read.parquet(path).select("bucket", "hash", "text_sha256", "keep_id", "group_size")
    rows = found.place(marked).join(index, ["bucket", "hash", "text_sha256"])
    return rows.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", *carried)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM d
"""
