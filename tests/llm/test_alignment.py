"""Alignment against the libraries, token by token, and plain counting."""

import functools
import hashlib
import random
from collections import Counter, defaultdict

import pytest
import sentencepiece
from tokenizers import Tokenizer

from tickloom.llm import alignment
from tickloom.llm.common import table, tokenizer_path

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_best_b"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))


@functools.cache
def byte_of(c):
    """The usual table of byte-level vocabularies, made the usual way."""
    plain = list(range(ord("!"), ord("~") + 1)) + list(range(ord("¡"), ord("¬") + 1)) + list(range(ord("®"), ord("ÿ") + 1))
    if ord(c) in plain:
        return ord(c)
    return [b for b in range(256) if b not in plain][ord(c) - 256]


def groups(text, libraries):
    """[(A ids, B ids)] or none."""
    a, b = libraries
    if not text:
        return []
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    own_a = [bytes(map(byte_of, a.id_to_token(i))) for i in ids_a]
    own_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
    want = (" " + text).encode()
    if b"".join(own_a) != want or b"".join(own_b) != want:
        return []
    out, i, j, at, bt = [], 0, 0, 0, 0
    left, right = [], []
    while i < len(ids_a) or j < len(ids_b):
        if at <= bt:
            left.append(ids_a[i])
            at += len(own_a[i])
            i += 1
        else:
            right.append(ids_b[j])
            bt += len(own_b[j])
            j += 1
        if at == bt and left and right:
            out.append((left, right))
            left, right = [], []
    return out


def brute(rows, libraries):
    every = [(doc, groups(text, libraries)) for doc, text in rows]
    linked = [Counter((x, y) for left, right in found for x in left for y in right) for _, found in every]
    counts = Counter(pair for own in linked for pair in own)
    best_a, best_b = defaultdict(int), defaultdict(int)
    for (x, y), n in counts.items():
        best_a[x], best_b[y] = max(best_a[x], n), max(best_b[y], n)
    out = []
    for (doc, found), own in zip(every, linked, strict=True):
        text = ";".join(f"{','.join(map(str, left))}|{','.join(map(str, right))}" for left, right in found)
        out.append((
            doc, sum(len(x) for x, _ in found), sum(len(y) for _, y in found), len(found), sum(own.values()),
            sum(n for p, n in own.items() if counts[p] == best_a[p[0]]), sum(n * counts[p] for p, n in own.items()),
            hashlib.sha256(text.encode()).hexdigest() if found else "", sum(n for p, n in own.items() if counts[p] == best_b[p[1]]),
        ))
    return out


def same(got, want):
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


ODD = [
    None, "", " ", "  lead", "trail  ", "a", "\n", "tab\tand\r\nline", "▁mark ▁ inside", "<|endoftext|> and <s> and <0x41> and <unk>", "é é ﬁ Σίσυφος", "日本語のテキスト 🙂👩‍👩‍👧",
    "\0 zero", "it's  a 's test", "a" * 5000, " " * 3000, "ab " * 9000, "word " * 4000 + "\x1c" + " 12 34" * 3000, "x　y z w", "a​b﻿", "same text", "same text",
]


@pytest.mark.parametrize("hot", [alignment.HOT, 3])
def test_real_rows(spark, libraries, hot):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    same(alignment.align(docs.repartition(3), hot=hot), brute(rows, libraries))


def test_odd_rows(spark, libraries, monkeypatch):
    rng = random.Random(4)
    signs = list("ab  \n\t'.,é日🙂▁0😀") + ["the ", "ing", "  "]
    rows = [(i % 60, t) for i, t in enumerate(ODD + ["".join(rng.choices(signs, k=rng.randint(1, 60))) for _ in range(400)])] + [(None, "same text"), (None, None)]
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, n_a int, number int, pairs string").repartition(4)
    same(alignment.align(docs), brute(rows, libraries))


def test_small_slices_and_rows_give_the_same(spark, libraries, monkeypatch):
    texts = [t for t in ODD if t] + ["some words, and 12 more; " * 700]
    for name, value in (("SLICE_BYTES", 50), ("PAIRS_A_ROW", 3), ("MANY_LINKS", 1)):
        monkeypatch.setattr(alignment, name, value)
    aligner = alignment.Aligner("byte_bpe_50k.json", "piece_bpe_32k.model")
    for text in texts:
        held = [alignment.Held()]
        for part in alignment.cut_both(text, 20):
            aligner.align([part], alignment.np.array([0]), held)
        head, pairs, times = held[0].result()
        ((_, *want),) = brute([(0, text)], libraries)
        assert [*head[:4], head[4]] == [*want[:4], want[6]]
        own = Counter((x, y) for left, right in groups(text, libraries) for x in left for y in right)
        assert dict(zip(pairs.tolist(), times.tolist(), strict=True)) == {x * 32000 + y: n for (x, y), n in own.items()}


def test_pairs_over_several_rows(spark, libraries):
    text = " ".join(f"{i * 7919 % 100_000} w{i}" for i in range(60_000))
    rows = [(1, text), (2, "short"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert max(alignment.links(docs).groupBy("number").count().toPandas()["count"]) > 1
    same(alignment.align(docs), brute(rows, libraries))


def test_nothing(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_pair_counts(spark, libraries):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    counts = Counter(p for r in docs.collect() for p in {(x, y) for left, right in groups(r["text"], libraries) for x in left for y in right})
    got = {(r["a"], r["b"]): r["count"] for r in alignment.pair_counts(alignment.links(docs)).collect()}
    assert got == counts
