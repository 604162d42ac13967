"""Alignment of two tokenizers: groups, links, and how often pairs of ids are linked.

Each task cuts long texts into parts at single spaces, where both tokenizers start
a new token (``check_model`` of the token counts proves it for the model at hand),
and takes parts of about ``SLICE_BYTES`` at a time. Tokens become bytes, and the two
lists of cumulative token ends, both in order, are merged in one pass: an end that
both have closes a group. So what a task holds follows from a slice, the links of
the documents in it, and a text that has no place to cut.

Per document the distinct linked pairs and how often each occurs are written to
the shared folder once. From these files Spark counts the documents of each pair,
takes the maxima per id of either side (at most a row an id of a vocabulary, so
they are broadcast), and joins both back. Pairs that make up more than one
131,072th of all rows are at most so many, and are joined by broadcast; all others
by a shuffle, in which no pair has more than that share.

Defined results: null and empty texts, and texts whose tokens' bytes differ from a
space and the text, have zeros and an empty string; rows that repeat each other are
documents of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, text_or_empty, tokenizer_path
from .encode import Encoder, gather
from .token_counts import PART_CHARS, check_model

SLICE_BYTES = 1 << 20
#: Pairs in one row of the written links; a document with more takes several rows.
PAIRS_A_ROW = 1 << 16
#: Groups with more links than this are counted by distinct ids.
MANY_LINKS = 4096
HOT = 1 << 17


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """The bytes of ids one after the other, with starts and lengths."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def __len__(self) -> int:
        return len(self.lengths)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return gather(self.flat, self.starts, self.lengths, ids)[0] if len(ids) else np.zeros(0, np.uint8)


def byte_vocabulary(library) -> Vocabulary:
    known = byte_level()
    tokens = [b""] * library.get_vocab_size()
    for token, i in library.get_vocab().items():
        # an added token isn't written in byte level
        tokens[i] = bytes(known[c] for c in token) if all(c in known for c in token) else token.encode()
    return Vocabulary(tokens)


def piece_vocabulary(model) -> Vocabulary:
    def of(i: int) -> bytes:
        piece = model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()

    return Vocabulary([of(i) for i in range(model.get_piece_size())])


def cut_both(text: str, most: int = PART_CHARS) -> list[str]:
    """``text`` in parts of at least ``most`` characters, cut at single spaces between characters that are neither white space nor a space mark."""
    parts, start, at = [], 0, most
    while (at := text.find(" ", at)) != -1:
        sides = text[at - 1 : at] + text[at + 1 : at + 2]
        if at > start and len(sides) == 2 and not any(c.isspace() or c == "▁" for c in sides):
            parts.append(text[start:at])
            start, at = at + 1, at + 1 + most
        else:
            at += 1
    return [*parts, text[start:]]


class Held:
    """What is known so far of one document."""

    def __init__(self) -> None:
        self.n_a = self.n_b = self.n_groups = self.n_links = 0
        self.good, self.hash = True, hashlib.sha256()
        self.pairs: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def result(self) -> tuple[tuple, np.ndarray, np.ndarray]:
        if not self.good or not self.n_a:
            return (0, 0, 0, 0, ""), np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs, times = self.pairs[0], self.times[0]
        if len(self.pairs) > 1:
            pairs, times = summed(np.concatenate(self.pairs), np.concatenate(self.times))
        return (self.n_a, self.n_b, self.n_groups, self.n_links, self.hash.hexdigest()), pairs, times


def summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their times."""
    if not len(keys):
        return keys, times
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(times[order], first)


class Aligner:
    def __init__(self, a: str, b: str) -> None:
        import sentencepiece

        self.encoder = Encoder(a)
        self.encoder.library.encode_special_tokens = True  # their strings are plain text
        self.model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(b))
        self.cuts = check_model(self.model)
        self.a, self.b = byte_vocabulary(self.encoder.library), piece_vocabulary(self.model)
        most = max(len(self.a), len(self.b))
        width = len(str(most))
        written = [str(i).encode() for i in range(most)]
        self.digits = np.frombuffer(b"".join(w.ljust(width) for w in written), dtype=np.uint8).reshape(most, width)
        self.n_digits = np.array([len(w) for w in written])

    def parts(self, text: str) -> list[str]:
        return cut_both(text) if self.cuts and len(text) > PART_CHARS else [text]

    def encode_a(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of a space and each part. With a letter in front, the space is as inside a text; the letter's id goes again."""
        ids, counts = [], []
        for _, own, ends in self.encoder.slices(pa.array(["x " + p for p in parts], pa.string())):
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            ids.append(np.delete(own, starts))
            counts.append(ends - starts - 1)
        return np.concatenate(ids).astype(np.int64), np.concatenate(counts)

    def encode_b(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = self.model.encode(parts, num_threads=1)
        counts = np.array([len(own) for own in lists], dtype=np.int64)
        return np.concatenate([np.array(own, dtype=np.int64) for own in lists]), counts

    def whole(self, vocabulary: Vocabulary, ids: np.ndarray, counts: np.ndarray, want: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Which parts' tokens have the part's bytes."""
        made = vocabulary.bytes_of(ids)
        if len(made) == len(want) and np.array_equal(made, want):
            return np.ones(len(sizes), bool)
        ends = np.concatenate([[0], np.cumsum(vocabulary.lengths[ids])])[np.concatenate([[0], np.cumsum(counts)])]
        at = np.concatenate([[0], np.cumsum(sizes)])
        return np.array([np.array_equal(made[ends[i] : ends[i + 1]], want[at[i] : at[i + 1]]) for i in range(len(sizes))], bool)

    def align(self, parts: list[str], owners: np.ndarray, held: list[Held]) -> None:
        """Add ``parts`` to the documents ``owners`` of ``held``; the parts of a document come in order."""
        want = np.frombuffer((" " + " ".join(parts)).encode(), dtype=np.uint8)
        sizes = np.array([len(p.encode()) + 1 for p in parts], dtype=np.int64)
        (ids_a, n_a), (ids_b, n_b) = self.encode_a(parts), self.encode_b(parts)
        good = self.whole(self.a, ids_a, n_a, want, sizes) & self.whole(self.b, ids_b, n_b, want, sizes)
        if not good.all():
            for owner in owners[~good]:
                held[owner].good = False
            ids_a, ids_b = ids_a[np.repeat(good, n_a)], ids_b[np.repeat(good, n_b)]
            n_a, n_b, owners = n_a[good], n_b[good], owners[good]
        if not len(owners):
            return
        # ends of tokens from the start of the slice on, and where both lists have the same
        ends_a, ends_b = np.cumsum(self.a.lengths[ids_a]), np.cumsum(self.b.lengths[ids_b])
        at = np.minimum(np.searchsorted(ends_b, ends_a), len(ends_b) - 1)
        last_a = np.flatnonzero(ends_b[at] == ends_a)
        last_b = at[last_a]
        size_a, size_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        part = np.searchsorted(np.cumsum(n_a), last_a, side="right")
        links = size_a * size_b
        groups = np.bincount(part, minlength=len(owners))
        linked = np.bincount(part, weights=links, minlength=len(owners)).astype(np.int64)
        written, ends = self.text_of(ids_a, ids_b, last_a, last_b, size_a, size_b)
        ends = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n_a + n_b)])]
        pairs, times, owner_of = self.pairs_of(ids_a, ids_b, last_a, last_b, size_a, size_b, owners[part])
        seen = memoryview(written)
        for i, owner in enumerate(owners.tolist()):
            doc = held[owner]
            first = ends[i] + (doc.n_a == 0)  # no semicolon before a document's first group
            doc.hash.update(seen[first : ends[i + 1]])
            doc.n_a, doc.n_b = doc.n_a + int(n_a[i]), doc.n_b + int(n_b[i])
            doc.n_groups, doc.n_links = doc.n_groups + int(groups[i]), doc.n_links + int(linked[i])
        starts = np.flatnonzero(np.diff(owner_of, prepend=-1))
        for start, end in zip(starts, [*starts[1:], len(owner_of)], strict=True):
            held[owner_of[start]].pairs.append(pairs[start:end])
            held[owner_of[start]].times.append(times[start:end])

    def text_of(self, ids_a, ids_b, last_a, last_b, size_a, size_b) -> tuple[np.ndarray, np.ndarray]:
        """``;a1,a2|b1`` a group in one array of bytes, and where each token's part ends."""
        n = len(ids_a) + len(ids_b)
        at_a = np.arange(len(ids_a)) + np.repeat(last_b - size_b + 1, size_a)
        at_b = np.arange(len(ids_b)) + np.repeat(last_a + 1, size_b)
        ids, signs = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
        ids[at_a], ids[at_b] = ids_a, ids_b
        signs[at_a[last_a - size_a + 1]], signs[at_b[last_b - size_b + 1]] = ord(";"), ord("|")
        rows = np.empty((n, 1 + self.digits.shape[1]), np.uint8)
        rows[:, 0], rows[:, 1:] = signs, self.digits[ids]
        sizes = 1 + self.n_digits[ids]
        return rows[np.arange(rows.shape[1]) < sizes[:, None]], np.cumsum(sizes)

    def pairs_of(self, ids_a, ids_b, last_a, last_b, size_a, size_b, owner) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (owner, pair) in order of owners: pairs, times, owners."""
        n, links = len(self.b), size_a * size_b
        shift = len(self.a) * n
        few = np.flatnonzero(links <= MANY_LINKS)
        group = np.repeat(few, links[few])
        nth = np.arange(len(group)) - np.repeat(np.cumsum(links[few]) - links[few], links[few])
        left = ids_a[last_a[group] - size_a[group] + 1 + nth // size_b[group]]
        right = ids_b[last_b[group] - size_b[group] + 1 + nth % size_b[group]]
        keys, times = np.unique(owner[group].astype(np.int64) * shift + left * n + right, return_counts=True)
        more = [(keys, times)]
        for g in np.flatnonzero(links > MANY_LINKS):
            left, times_a = np.unique(ids_a[last_a[g] - size_a[g] + 1 : last_a[g] + 1], return_counts=True)
            right, times_b = np.unique(ids_b[last_b[g] - size_b[g] + 1 : last_b[g] + 1], return_counts=True)
            more.append((int(owner[g]) * shift + np.add.outer(left * n, right).ravel(), np.multiply.outer(times_a, times_b).ravel()))
        if len(more) > 1:
            keys, times = summed(*(np.concatenate(x) for x in zip(*more, strict=True)))
        return keys % shift, times, keys // shift


HEAD = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def links(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> DataFrame:
    """number, doc_id, the columns of HEAD, pairs and times per document, written once.

    A pair is the A id times the size of B's vocabulary plus the B id. A document with
    very many pairs has more rows, in which the columns of HEAD are null.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["number", "doc_id", *HEAD, "pairs", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(a, b)
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, held = batch.column("doc_id"), [Held() for _ in range(batch.num_rows)]
            parts, owners, size, done = [], [], 0, 0

            def rows(upto: int) -> pa.RecordBatch:
                taken, heads, pairs, times = [], [], [], []
                for i in range(done, upto):
                    head, own, often = held[i].result()
                    held[i] = None
                    for at in range(0, max(len(own), 1), PAIRS_A_ROW):
                        taken.append(i)
                        heads.append((number + i, *(head if at == 0 else (None,) * len(HEAD))))
                        pairs.append(own[at : at + PAIRS_A_ROW])
                        times.append(often[at : at + PAIRS_A_ROW])
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in pairs], dtype=np.int64)]).astype(np.int32))
                flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (pairs, times)]
                lists = [pa.ListArray.from_arrays(offsets, pa.array(f, pa.int64())) for f in flat]
                kinds = [*[pa.int64()] * 5, pa.string()]
                columns = [pa.array(c, k) for c, k in zip(list(zip(*heads, strict=True)) or [[]] * 6, kinds, strict=True)]
                return pa.RecordBatch.from_arrays([columns[0], ids.take(pa.array(taken, pa.int64())), *columns[1:], *lists], names=names)

            for i, text in enumerate(batch.column("text")):
                text = text.as_py()
                for part in aligner.parts(text) if text else []:
                    parts.append(part)
                    owners.append(i)
                    size += len(part) if part.isascii() else len(part.encode())
                    if size >= SLICE_BYTES:
                        aligner.align(parts, np.array(owners), held)
                        parts, owners, size = [], [], 0
                        yield rows(i)
                        done = i
            if parts:
                aligner.align(parts, np.array(owners), held)
            yield rows(batch.num_rows)
            number += batch.num_rows

    schema = f"number long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
    path = fresh_path(docs.sparkSession, "links")
    docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, schema).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def pair_counts(written: DataFrame, b: str = "piece_bpe_32k.model") -> DataFrame:
    """pair, a, b, count (documents), best_a and best_b (whether the count is the id's highest), written once."""
    import sentencepiece

    n = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(b)).get_piece_size()
    counts = written.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("count"))
    path = fresh_path(written.sparkSession, "pair-counts")
    counts.select("pair", F.floor(F.col("pair") / n).cast("int").alias("a"), (F.col("pair") % n).cast("int").alias("b"), "count").write.parquet(path)
    counts = written.sparkSession.read.parquet(path)
    # a row an id of a vocabulary at most
    for side in ("a", "b"):
        best = counts.groupBy(side).agg(F.max("count").alias("most"))
        counts = counts.join(F.broadcast(best), side).withColumn(f"best_{side}", F.col("count") == F.col("most")).drop("most")
    return counts.select("pair", "a", "b", "count", "best_a", "best_b")


def align(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", hot: int = HOT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and n_best_b (as n_best, for B ids) per document."""
    written = links(docs, a, b)
    counts = pair_counts(written, b).select("pair", "count", "best_a", "best_b")
    path = fresh_path(docs.sparkSession, "pair-best")
    counts.write.parquet(path)
    counts = docs.sparkSession.read.parquet(path)
    (rows,) = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()
    often = F.col("count") > rows / hot
    common = F.broadcast(counts.where(often))
    each = written.select("number", F.explode(F.arrays_zip("pairs", "times")).alias("of")).select("number", F.col("of.pairs").alias("pair"), F.col("of.times").alias("times"))
    rare = each.join(common.select("pair"), "pair", "left_anti").join(counts.where(~often).hint("merge"), "pair")
    joined = each.join(common, "pair").unionByName(rare)
    sums = joined.groupBy("number").agg(
        F.sum(F.col("times") * F.col("count")).alias("count_sum"),
        F.sum(F.when(F.col("best_a"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.when(F.col("best_b"), F.col("times")).otherwise(0)).alias("n_best_b"),
    )
    heads = written.where("groups_sha256 is not null").select("number", "doc_id", *HEAD)
    found = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")]
    return heads.join(sums, "number", "left").select("doc_id", *HEAD[:4], *found, "groups_sha256", F.coalesce("n_best_b", F.lit(0).cast("long")).alias("n_best_b"))
