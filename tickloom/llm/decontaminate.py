"""Benchmark decontamination by template canonicalisation.

Texts become templates: lower-cased words, with numbers, names and units replaced
by typed placeholders whose values are kept as slots. Windows of ``window``
tokens are hash-joined between documents and benchmark items. For each item and
diagonal (document position minus item position) the slots must be consistent:
one value of the item always becomes the same value in the document; where it
doesn't, only windows whose slots are unchanged count. An item
leaks into a document if its consistent diagonals cover ``least_share`` of its
tokens or a run's worth of ``least_tokens`` of them.

Capitals inside a sentence mark names, so items are also indexed in small letters.

A window with fewer than half plain words says little as a template. With two plain
words or more it counts if its slots are unchanged, or if consistent windows cover
the whole item; with fewer, its hash holds the values themselves, so it only meets
windows that are copied word by word.

An item of ``SHORTEST`` to ``window - 1`` tokens is one window of its own length; the
documents are also searched with windows of each such length, and the whole item must
be found. A shorter item matches a document that is nothing else.

Before the join a document's windows pass a bitmap of the benchmark's window
hashes, of about 16 bits a window and 2 ** 24 bits (2 MB) at most, so it may
be broadcast; what it lets through by accident the join drops.

Defined results: null and empty texts never match; repeated items and repeated rows
count once; of items that cover equally much the one with the smallest id is named; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_rows, giving_back, text_or_empty

WINDOW = 8
SHORTEST = 4
MOST_BITS = 24
TOKEN = re.compile(r"([^\W\d_]+|\d+(?:[.,:/]\d+)*)")
#: Units that follow a number, and first names and titles taken as names wherever they stand.
UNITS = frozenset(
    "mm cm m km inch inches ft feet foot yard yards mile miles mg g kg t lb lbs oz ton tons gram grams kilogram kilograms ml l liter liters litre litres "
    "meter meters metre metres kilometer kilometers kilometre kilometres s sec secs second seconds min mins minute minutes h hr hrs hour hours day days "
    "week weeks month months year years cent cents dollar dollars euro euros pound pounds yen usd eur gbp percent pct degree degrees celsius fahrenheit "
    "kmh mph kph kw kwh w watt watts v volt volts hz khz mhz ghz kb mb gb tb byte bytes bit bits".split()
)
NAMES = frozenset(
    "alice bob carol carlos dave david emma eve frank grace henry ivan jack james jane jim joe john julia kate kevin laura lily linda lisa lucas lucy maria "
    "mark martin mary max mia michael mike nina noah olivia oscar paul peter rachel robert rosa sam samuel sarah sofia sophie steve susan thomas tim tom "
    "victor william anna ben charlie daniel ella george hannah isabel jessica marie hans klaus pierre jean juan pedro luis ana elena miguel".split()
)
NUMBER, NAME, UNIT, MAYBE_NAME = 1, 2, 3, 4
HELD_WORDS = 300_000


class Templates:
    """parse(text) gives a template: a hash for each token, the kinds and values of its placeholders, and the tokens' own hashes if it has any."""

    def __init__(self) -> None:
        from xxhash import xxh64_intdigest

        self.digest = xxh64_intdigest
        self.placeholder = {k: xxh64_intdigest(b"placeholder", k) for k in (NUMBER, NAME, UNIT)}
        self.words: dict[str, tuple[int, int, str]] = {}

    def look_up(self, word: str) -> tuple[int, int, str]:
        """Hash, what it may stand for (0: itself) and the folded word."""
        low = word.lower().replace("ß", "ss")
        kind = 0
        if word[0].isdigit():
            kind = NUMBER
        elif low in UNITS:
            kind = UNIT
        elif low in NAMES:
            kind = NAME
        elif len(word) > 1 and word[0].isupper() and word[1:].islower():
            kind = MAYBE_NAME
        if len(self.words) > HELD_WORDS:
            self.words.clear()
        found = self.words[word] = (self.digest(low), kind, low)
        return found

    def parse(self, text: str) -> tuple[np.ndarray, dict[int, int], dict[int, str], np.ndarray | None]:
        parts = TOKEN.split(text)
        get = self.words.get
        found = [get(w) or self.look_up(w) for w in parts[1::2]]
        hashes = np.array([f[0] for f in found], dtype=np.uint64)
        kinds: dict[int, int] = {}
        values: dict[int, str] = {}
        literal = None
        for i in [i for i, f in enumerate(found) if f[1]]:
            kind = found[i][1]
            if kind == UNIT and kinds.get(i - 1) != NUMBER:
                continue
            if kind == MAYBE_NAME:  # a capital inside a sentence
                if not i or parts[2 * i] not in (" ", ", "):
                    continue
                kind = NAME
            if literal is None:
                literal = hashes.copy()
            kinds[i], values[i] = kind, found[i][2]
            hashes[i] = self.placeholder[kind]
        return hashes, kinds, values, literal


def windows(hashes: np.ndarray, kinds: dict[int, int], width: int = WINDOW, literal: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, signed 64-bit hashes and lightness (half plain words or more) of the windows; ``literal`` are the tokens' own hashes."""
    if not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    width = min(width, len(hashes))
    n = len(hashes) - width + 1

    def mixed(tokens: np.ndarray, start: int) -> np.ndarray:
        out = np.full(n, start, dtype=np.uint64)
        for k in range(width):  # a polynomial in an odd number, mixed at the end
            out = out * np.uint64(0x9E3779B97F4A7C15) + tokens[k : k + n]
        return (out ^ (out >> np.uint64(32))).view(np.int64)

    found, at = mixed(hashes, width), np.arange(n)
    if not kinds:
        return at, found, np.ones(n, bool)
    held = np.zeros(len(hashes) + 1, dtype=np.int64)
    held[[i + 1 for i in kinds]] = 1
    held = np.cumsum(held)
    held = held[width:] - held[:-width]
    bare = width - held < 2
    if literal is not None and bare.any():
        found = np.where(bare, mixed(literal, width + 1000), found)
    return at, found, 2 * held <= width


def keyed_windows(rows: DataFrame, width: int, bitmap: np.ndarray | None = None, lengths: tuple[int, ...] = ()) -> DataFrame:
    """(key columns, n_tokens, width, at, hash, light, slots) of each window of ``width`` and ``lengths`` tokens; only those in the bitmap if there is one."""
    keys = [f for f in rows.schema.fields if f.name != "text"]
    shared = rows.sparkSession.sparkContext.broadcast(bitmap) if bitmap is not None else None
    names = [*[f.name for f in keys], "n_tokens", "width", "at", "hash", "light", "slots"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates()
        bits = shared.value if shared else None
        for batch in batches:
            took, out = [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                tokens, kinds, values, literal = templates.parse(text)
                for w in {min(width, len(tokens)), *[k for k in lengths if k < len(tokens)]}:
                    places, found, light = windows(tokens, kinds, w, literal)
                    if bits is not None and len(places):
                        low = found & (8 * len(bits) - 1)
                        hit = (bits[low >> 3] >> (low & 7).astype(np.uint8)) & 1 == 1
                        if not hit.any():
                            continue
                        places, found, light = places[hit], found[hit], light[hit]
                    for p, h, l in zip(places.tolist(), found.tolist(), light.tolist(), strict=True):
                        took.append(row)
                        out.append((len(tokens), w, p, h, l, [values.get(i, "") for i in range(p, p + w)]))
            own = [batch.column(f.name).take(pa.array(took, pa.int64())) for f in keys]
            columns = list(zip(*out, strict=True)) or [[]] * 6
            kinds_of = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([*own, *[pa.array(c, k) for c, k in zip(columns, kinds_of, strict=True)]], names=names)

    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in keys) + "n_tokens int, width int, at int, hash long, light boolean, slots array<string>"
    return rows.mapInArrow(giving_back(run), schema)


def bitmap_of(found: DataFrame) -> np.ndarray:
    """Bits set for the low bits of the hashes; at most 2 ** MOST_BITS places reach the driver."""
    bits = min(MOST_BITS, max(10, int(16 * found.count()).bit_length()))
    places = found.select(F.col("hash").bitwiseAND(F.lit((1 << bits) - 1)).cast("int").alias("low")).distinct().toArrow().column("low").to_numpy()
    out = np.zeros(1 << bits, dtype=np.uint8)
    out[places] = 1
    return np.packbits(out, bitorder="little")


def leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, least_share: float = 0.6, least_tokens: int = 13, least_consistent: float = 0.85) -> DataFrame:
    """(doc_id, text_key, item_id, covered, share, reparameterised) for each document and item that leaks into it."""
    written = F.explode(F.array_distinct(F.array(text_or_empty(), F.lower(text_or_empty()))))  # as it is, and as a copy in small letters would be
    distinct = items.select("item_id", written.alias("text")).groupBy("text").agg(F.min("item_id").alias("item_id")).select("item_id", "text")
    known = cut(keyed_windows(distinct, window))
    short = sorted(r["width"] for r in known.where(F.col("width").between(SHORTEST, window - 1)).select("width").distinct().collect())  # window - SHORTEST rows at most
    own = known.select("item_id", F.col("n_tokens").alias("item_tokens"), "width", F.col("at").alias("item_at"), "hash", F.col("slots").alias("item_slots"))
    rows = docs.select("doc_id", F.sha2(text_or_empty(), 256).alias("text_key"), text_or_empty().alias("text"))
    hits = keyed_windows(rows, window, bitmap_of(known), tuple(short)).join(own, ["hash", "width"])
    hits = hits.where((F.col("width") >= SHORTEST) | (F.col("n_tokens") == F.col("width")))

    pair_list = F.filter(F.zip_with("item_slots", "slots", lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: p["a"] != "")
    every = F.sequence("item_at", F.col("item_at") + F.col("width") - 1)
    none = F.array().cast("array<int>")
    diagonal = ["doc_id", "text_key", "item_id", "item_tokens", F.col("at") - F.col("item_at")]
    literal = F.when(F.col("slots") == F.col("item_slots"), every).otherwise(none)
    union = lambda name: F.array_distinct(F.flatten(F.collect_set(name))).alias(name)
    marked = hits.withColumns({"pairs": pair_list, "every": every, "literal": literal}).withColumn("covers", F.when(F.col("light"), F.col("every")).otherwise(F.col("literal")))
    by_diagonal = marked.groupBy(*diagonal).agg(*[union(c) for c in ("every", "covers", "literal", "pairs")])
    values = F.size(F.array_distinct(F.transform("pairs", lambda p: p["a"])))
    agrees = (F.size("pairs") == 0) | (values >= least_consistent * F.size("pairs"))
    whole = agrees & (F.size("every") == F.col("item_tokens"))
    consistent = by_diagonal.withColumn("covers", F.when(whole, F.col("every")).when(agrees, F.col("covers")).otherwise(F.col("literal")))
    by_item = consistent.groupBy("doc_id", "text_key", "item_id", "item_tokens").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("covers")))).alias("covered"), F.max(F.exists("pairs", lambda p: p["a"] != p["b"])).alias("reparameterised")
    )
    share = F.col("covered") / F.col("item_tokens")
    least = F.when(F.col("item_tokens") < window, 1.0).otherwise(least_share)
    return by_item.withColumn("share", share).where((F.col("share") >= least) | (F.col("covered") >= least_tokens)).select("doc_id", "text_key", "item_id", "covered", "share", "reparameterised")


def leaked_documents(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """One row per document that holds benchmark text: doc_id, contaminated, item_id (the most covered), n_items, covered, share, reparameterised."""
    found = leaks(docs, items, **options)
    best = F.min_by("item_id", F.struct(-F.col("share"), -F.col("covered"), "item_id"))
    return found.groupBy("doc_id").agg(F.lit(True).alias("contaminated"), best.alias("item_id"), F.count_distinct("item_id").alias("n_items"), F.max("covered").alias("covered"), F.max("share").alias("share"), F.max("reparameterised").alias("reparameterised"))


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows whose text holds benchmark text; rows are told by the SHA-256 of their text."""
    key = f"__text_key_{uuid.uuid4().hex[:8]}"
    bad = leaks(docs, items, **options).select(F.col("text_key").alias(key)).distinct()
    return drop_rows(docs.withColumn(key, F.sha2(text_or_empty(), 256)), bad, key).drop(key)
