"""SimHash near-dedup with bit-sliced comparison.

1. Fingerprints. Words of the lower-cased text (A-Z only), shingles of
   ``shingle`` words, XXH64 with seed 42; a bit is set if it is set in more than
   half of the hashes. Fingerprints longer than 64 bits take the further words
   from the same hash by a mixing function.
2. Candidates. Equal fingerprints become one node. For a radius r the bits are
   cut into blocks and a table is kept for each choice of blocks that must
   agree, so two nodes within r share a key in at least one table: exact, with
   nothing capped. Wide fingerprints (``near_groups``) use bands instead.
3. Comparison. Rows are dealt by (table, key). A task stores the bit planes of
   its nodes vertically, 64 nodes a machine word, and compares all nodes of all
   its keys at distance 1, 2, 3, ... in the row order at once: one exclusive or
   a plane, distances held in carry-save counters, and words whose 64 lanes have
   all passed the radius are abandoned. Pairs already joined are skipped, and a
   key gives out a spanning star, never all its pairs.
4. A key with more than ``chunk`` nodes is cut into chunks by a hash, and every
   pair of chunks is a task of its own, so no task holds an unbounded group.
5. Components by alternating large-star and small-star steps; each step is cut
   by a checkpoint.

Defined results: null, empty and blank texts have fingerprint zero and link like
any other; texts with fewer words than a shingle are one shingle; an empty table
gives no rows; repeated rows share a fingerprint and a component; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce
from itertools import combinations, product
from math import acos, ceil, comb, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, giving_back, small, text_or_empty

SEED = 42
#: Fixed values of a public 64-bit mixing function.
MIX_STEP, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def mixed(hashes: np.ndarray, word: int) -> np.ndarray:
    """The hashes for word number ``word`` of a fingerprint; word 0 takes them as they are."""
    if not word:
        return hashes
    x = hashes + np.uint64((MIX_STEP * word) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_A)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_B)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str, shingle: int, distinct: bool = False) -> np.ndarray:
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if distinct and shingle == 1:
        return np.fromiter([xxh64_intdigest(w, SEED) for w in set(words)], dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()][: max(1, len(words) - shingle + 1)]
    stops = (ends - 1)[min(shingle, len(words)) - 1 :].tolist()
    return np.fromiter([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], dtype=np.uint64, count=len(starts))


def fingerprint(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """``words`` machine words of 64 majority bits."""
    out = np.zeros(words, dtype=np.uint64)
    for word in range(words):
        counts = np.zeros(64, dtype=np.int64)
        for at in range(0, len(hashes), 1 << 16):
            bits = np.unpackbits(mixed(hashes[at : at + (1 << 16)], word).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.int64)
        out[word] = np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, fp): 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(shingle_hashes(t, shingle)) for t in batch.column("text").to_pylist()]
            fps = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def block_masks(radius: int, agreeing: int = 2, bits: int = 64) -> list[int]:
    """Masks of ``agreeing`` blocks out of radius + agreeing: one of them is equal within the radius."""
    n = radius + agreeing
    edges = [bits * i // n for i in range(n + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [reduce(int.__or__, chosen) for chosen in combinations(blocks, agreeing)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


class Counters:
    """Distances of many lanes at once, one bit plane a digit, with a sticky overflow."""

    def __init__(self, n: int, radius: int) -> None:
        self.digits = [np.zeros(n, dtype=np.uint64) for _ in range(max(1, radius.bit_length()))]
        self.over = np.zeros(n, dtype=np.uint64)
        self.radius = radius

    def add(self, plane: np.ndarray, digit: int = 0) -> None:
        for d in range(digit, len(self.digits)):
            carry = self.digits[d] & plane
            self.digits[d] ^= plane
            plane = carry
        self.over |= plane

    def add3(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> None:
        """Three planes through one carry-save adder."""
        ab = a ^ b
        self.add(ab ^ c)
        carry = (a & b) | (ab & c)
        if len(self.digits) > 1:
            self.add(carry, 1)
        else:
            self.over |= carry

    def exceed(self) -> np.ndarray:
        greater, equal = self.over.copy(), ~self.over
        for d in reversed(range(len(self.digits))):
            if self.radius >> d & 1:
                equal = equal & self.digits[d]
            else:
                greater |= equal & self.digits[d]
                equal = equal & ~self.digits[d]
        return greater

    def keep(self, lanes: np.ndarray) -> None:
        self.digits = [d[lanes] for d in self.digits]
        self.over = self.over[lanes]


def shifted(plane: np.ndarray, at: np.ndarray, shift: int) -> np.ndarray:
    """Words ``at`` of the plane moved down by ``shift`` lanes."""
    q, r = divmod(shift, 64)
    low = plane[at + q]
    return low if not r else (low >> np.uint64(r)) | (plane[at + q + 1] << np.uint64(64 - r))


def close_lanes(planes: np.ndarray, active: np.ndarray, shift: int, radius: int, group: int = 12) -> np.ndarray:
    """Lanes j among the active ones whose distance to lane j + shift is within the radius."""
    packed = np.packbits(active, bitorder="little")
    packed = np.concatenate([packed, np.zeros(-len(packed) % 8, np.uint8)]).view(np.uint64)
    at = np.nonzero(packed)[0]
    live, counters = packed[at], Counters(len(at), radius)
    for first in range(0, len(planes), group):
        part = [planes[b][at] ^ shifted(planes[b], at, shift) for b in range(first, min(first + group, len(planes)))]
        while len(part) >= 3:
            counters.add3(part.pop(), part.pop(), part.pop())
        for plane in part:
            counters.add(plane)
        live = live & ~counters.exceed()
        stay = np.nonzero(live)[0]
        if not len(stay):
            return stay
        if len(stay) < len(at):
            at, live = at[stay], live[stay]
            counters.keep(stay)
    lanes = np.unpackbits(live.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    rows, bit = np.nonzero(lanes)
    return at[rows] * 64 + bit


def join_labels(labels: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Union the lanes of each pair; a label is the smallest lane of its set."""
    while True:
        a, b = labels[left], labels[right]
        if (a == b).all():
            return labels
        low = np.minimum(a, b)
        np.minimum.at(labels, a, low)
        np.minimum.at(labels, b, low)
        while (labels != labels[labels]).any():
            labels = labels[labels]


def joined_lanes(words: np.ndarray, run_ends: np.ndarray, radius: int) -> np.ndarray:
    """For each lane the first lane it is linked to; lanes of a run end before ``run_ends``."""
    n = len(words)
    labels, left = np.arange(n), run_ends - 1 - np.arange(n)
    if n < 2 or not left.max():
        return labels
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(n, -1), axis=1, bitorder="little").T
    packed = np.packbits(bits, axis=1, bitorder="little")
    longest = int(left.max())
    space = -packed.shape[1] % 8 + 8 * (longest // 64 + 2)
    planes = np.ascontiguousarray(np.pad(packed, ((0, 0), (0, space)))).view(np.uint64)
    for shift in range(1, longest + 1):
        active = left >= shift
        active[: n - shift] &= labels[: n - shift] != labels[shift:]
        if active.any():
            near = close_lanes(planes, active, shift, radius)
            if len(near):
                labels = join_labels(labels, near, near + shift)
    return labels


def compare_runs(keys: np.ndarray, words: np.ndarray, nodes: np.ndarray, radius: int, small: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, node) inside runs of equal keys: a spanning star for each set of linked nodes."""
    n = len(keys)
    starts = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0]
    sizes = np.diff(np.concatenate([starts, [n]]))
    out: list[tuple[np.ndarray, np.ndarray]] = []

    def compare(at: np.ndarray, ends: np.ndarray) -> None:
        first = joined_lanes(words[at], ends, radius)
        linked = np.nonzero(first != np.arange(len(at)))[0]
        out.append((nodes[at[linked]], nodes[at[first[linked]]]))

    few = (sizes > 1) & (sizes <= small)
    lanes = np.nonzero(np.repeat(few, sizes))[0]
    if len(lanes):
        compare(lanes, np.repeat(np.cumsum(sizes[few]), sizes[few]))
    for start, size in zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist(), strict=True):
        compare(np.arange(start, start + size), np.full(size, size))
    empty = np.zeros(0, nodes.dtype)
    return (np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])) if out else (empty, empty)


def chunk_pairs() -> Column:
    """The pairs of chunks that a row's ``node`` belongs to, of ``chunks`` ones; a single part without them."""
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("chunks")).cast("long")
    others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks").cast("long") - 1), lambda i: F.least(i, own) * F.lit(1 << 31) + F.greatest(i, own))
    return F.when(F.col("chunks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.array_distinct(others))


def links(keyed: DataFrame, radius: int, words: int, chunk: int = 2048) -> DataFrame:
    """Distinct links (u, v), u > v, among rows (tbl, key, node, fp): fp is a long, or binary if it has more words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def compared(rows: pa.Table) -> pa.RecordBatch:
            keys = rows.column("run").to_numpy()
            column = rows.column("fp")
            fps = (column.to_numpy().view(np.uint64) if words == 1 else np.frombuffer(b"".join(column.to_pylist()), dtype="<u8")).reshape(-1, words)
            u, v = compare_runs(keys, fps, rows.column("node").to_numpy(), radius)
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            if held.num_rows >= 50_000:
                keys = held.column("run").to_numpy()
                if whole := int(np.searchsorted(keys, keys[-1])):  # the last run may go on in the next batch
                    yield compared(held.slice(0, whole))
                    held = held.slice(whole)
        if held is not None and held.num_rows:
            yield compared(held)

    big = keyed.groupBy("tbl", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > chunk).select("tbl", "key", F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
    dealt = keyed.join(big, ["tbl", "key"], "left").withColumn("part", F.explode(chunk_pairs())).withColumn("run", F.xxhash64("tbl", "key", "part"))
    ordered = dealt.repartition("run").sortWithinPartitions("run").select("run", "node", "fp")
    return ordered.mapInArrow(run, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node that can be reached; nodes without links are left out."""
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        found = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if not found["n"] or found == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = found
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())


def simhash_groups(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint, component_id per row of ``docs``."""
    rows = cut(fingerprints(docs, shingle))
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    masks = [signed(m) for m in block_masks(radius)]
    tables = F.explode(F.array(*[F.struct(F.lit(t).alias("tbl"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)]))
    keyed = nodes.select("fp", tables.alias("k")).select("k.tbl", "k.key", F.col("fp").alias("node"), "fp")
    roots = components(links(keyed, radius, 1)).withColumnRenamed("node", "fp")
    placed = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = placed.groupBy("root").agg(F.min("first_id").alias("component_id")).join(placed, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: About how many bytes of text the sample of common shingles may have.
SAMPLE_BYTES = 64 << 20


def flip_share(similarity: Fraction, most: int = 8) -> float:
    """The largest chance that one bit differs for two sets of at least that similarity.

    Ties make it largest where the sets are small; sets that share everything
    but ``most`` elements are at the limit that holds for large ones.
    """

    def above(n: int, least: int) -> float:
        return sum(comb(n, k) for k in range(max(0, least), n + 1)) / 2**n

    worst = acos(2 * similarity / (1 + similarity)) / pi
    for apart in range(1, most + 1):
        least = ceil(apart * similarity / (1 - similarity))
        for shared, left in product((least, least + 1), range(apart + 1)):
            n, m = shared + left, shared + apart - left
            found = 0.0
            for k in range(shared + 1):
                p, q = above(left, n // 2 + 1 - k), above(apart - left, m // 2 + 1 - k)
                found += comb(shared, k) / 2**shared * (p * (1 - q) + q * (1 - p))
            worst = max(worst, found)
    return worst


def common_shingles(docs: DataFrame, shingle: int, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that three texts or more of a sample have, sorted, and how many; they only set an order, never a result. The sample has about ``sample`` texts and SAMPLE_BYTES at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(shingle_hashes(t, shingle)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64))], names=["h"])

    rows, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(text_or_empty()))).first()
    share = min(1.0, sample / max(rows, 1), SAMPLE_BYTES / max(size or 0, 1))
    chosen = docs.select(text_or_empty().alias("text")).sample(share, SEED)
    counts = chosen.mapInArrow(giving_back(run), "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").toArrow()
    hashes = counts.column("h").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], counts.column("n").to_numpy()[order]


def signatures(docs: DataFrame, ids: list[str], shingle: int, similarity: Fraction, words: int, sample: int) -> DataFrame:
    """(ids, text_key, node, fp, keys): equal shingle sets are one node; keys are its rarest shingles.

    With n shingles, n - ceil(similarity n) + 1 of them are keys, in one order for
    all texts, so two similar texts always have a key in common.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, shingle, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        known, counts = shared.value
        for batch in batches:
            nodes, fps, keys = [], [], []
            for text in batch.column("text").to_pylist():
                hashes = np.unique(shingle_hashes(text, shingle))
                nodes.append(signed(xxh64_intdigest(hashes.tobytes(), SEED)))
                fps.append(fingerprint(hashes, words).tobytes())
                rank = np.zeros(len(hashes), dtype=np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                    rank = np.where(known[at] == hashes, counts[at], 0)
                size = len(hashes) - ceil(similarity * len(hashes)) + 1 if len(hashes) else 0
                keys.append(hashes[np.argsort(rank, kind="stable")[:size]].view(np.int64))
            own = [batch.column(c) for c in [*ids, "text_key"]]
            yield pa.RecordBatch.from_arrays([*own, pa.array(nodes, pa.int64()), pa.array(fps, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=[*ids, "text_key", "node", "fp", "keys"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in ids)
    rows = docs.select(*ids, F.xxhash64(text_or_empty()).alias("text_key"), text_or_empty().alias("text"))
    return rows.mapInArrow(giving_back(run), f"{kinds}, text_key long, node long, fp binary, keys array<long>")


def similar_lanes(sets: list[np.ndarray], similarity: Fraction) -> np.ndarray:
    """For each set the first one of its component, by exact Jaccard similarity; pairs already joined are skipped."""
    n, labels = len(sets), np.arange(len(sets))
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    places = np.split(flat, np.cumsum(sizes)[:-1])
    marks = np.zeros(len(flat), dtype=np.int64)
    for i in range(n - 1):
        others = np.nonzero(labels[i + 1 :] != labels[i])[0] + i + 1
        if not len(others):
            continue
        marks[places[i]] = 1
        both = np.add.reduceat(marks[np.concatenate([places[j] for j in others])], np.concatenate([[0], np.cumsum(sizes[others])[:-1]]))
        marks[places[i]] = 0
        near = others[both * similarity.denominator >= similarity.numerator * (sizes[i] + sizes[others] - both)]
        if len(near):
            labels = join_labels(labels, np.full(len(near), i), near)
    return labels


def similar_links(docs: DataFrame, members: DataFrame, shingle: int, similarity: Fraction, chunk: int = 1024) -> DataFrame:
    """Links (u, v) of nodes with that exact similarity inside each root of ``members`` (node, root, text_key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}

        def compared() -> pa.RecordBatch:
            nodes = np.array(list(held), dtype=np.int64)
            first = nodes[similar_lanes(list(held.values()), similarity)] if len(held) else nodes
            linked = first != nodes
            return pa.RecordBatch.from_arrays([pa.array(nodes[linked]), pa.array(first[linked])], names=["u", "v"])

        for batch in batches:
            for key, node, text in zip(*[batch.column(c).to_pylist() for c in ("run", "node", "text")], strict=True):
                if key != at:
                    yield compared()
                    at, held = key, {}
                held[node] = np.unique(shingle_hashes(text, shingle))
        yield compared()

    big = members.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks")).where("chunks > 1")
    rows = docs.select(F.xxhash64(text_or_empty()).alias("text_key"), text_or_empty().alias("text"))
    texts = rows.join(small(members.select("text_key")), "text_key", "left_semi").dropDuplicates(["text_key"])
    dealt = texts.join(members, "text_key").join(big, "root", "left").withColumn("part", F.explode(chunk_pairs())).withColumn("run", F.xxhash64("root", "part"))
    return dealt.repartition("run").sortWithinPartitions("run").select("run", "node", "text").mapInArrow(giving_back(run), "u long, v long").distinct()


def near_rows(docs: DataFrame, ids: list[str], shingle: int = 5, similarity: float = 0.8, words: int = 4, sample: int = 10_000) -> DataFrame:
    """(ids, root) per row: the groups of ``near_groups``."""
    exact, bits = Fraction(str(similarity)), 64 * words
    share = flip_share(exact)
    radius = int(bits * share + 6 * np.sqrt(bits * share * (1 - share)))
    rows = cut(signatures(docs, ids, shingle, exact, words, sample))
    nodes = rows.groupBy("node").agg(F.min("text_key").alias("text_key"), F.min("fp").alias("fp"))
    dealt = rows.select(F.explode("keys").alias("key"), "node").repartition("key")  # without fingerprints, as most keys have one node
    shared = dealt.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("key")
    keyed = cut(dealt.join(shared, "key").dropDuplicates(["key", "node"]).join(nodes.select("node", "fp"), "node").select(F.lit(0).alias("tbl"), "key", "node", "fp"))
    maybe = cut(components(links(keyed, radius, words)).join(nodes.select("node", "text_key"), "node"))
    roots = components(similar_links(docs, maybe, shingle, exact))
    return rows.select(*ids, "node").join(roots, "node", "left").select(*ids, F.coalesce("root", "node").alias("root"))


def near_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, words: int = 4, sample: int = 10_000) -> DataFrame:
    """(doc_id, component_id) per row: groups of texts whose shingle sets have that Jaccard similarity.

    Candidates share one of the keys of ``signatures``, which misses no pair, and
    their fingerprints differ in no more bits than six standard errors above what
    the least similar pair has, so a pair is lost once in 10 ** 8. The groups that
    candidates form are then cut by the exact similarity of their shingle sets.
    """
    rows = cut(near_rows(docs, ["doc_id"], shingle, similarity, words, sample))
    named = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(named, "root").select("doc_id", "component_id")
