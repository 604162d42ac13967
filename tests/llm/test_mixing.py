"""Mixing against plain loops: targets, Sainte-Laguë by its sequence of quotients, and the words of every document."""

import hashlib
import heapq
import random
import re
from collections import defaultdict

import duckdb
import pytest

from tickloom.llm import mixing
from tickloom.llm.common import table

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_targets(sizes, share=1.5, most=2):
    """Targets of sources in order, by rounds."""
    weights = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
    total, full = share * sum(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in full]
        level = (total - sum(most * sizes[i] for i in full)) / max(sum(weights[i] for i in free), 1)
        over = [i for i in free if level * weights[i] > most * sizes[i]]
        if not over:
            return [most * sizes[i] if i in full else level * weights[i] for i in range(len(sizes))]
        full.update(over)


def plain_seats(targets, seats):
    """How many of the highest quotients each has."""
    won = [0] * len(targets)
    heap = [(-t, i) for i, t in enumerate(targets) if t > 0]
    heapq.heapify(heap)
    for _ in range(seats):
        _, i = heapq.heappop(heap)
        won[i] += 1
        heapq.heappush(heap, (-targets[i] / (2 * won[i] + 1), i))
    return won


def brute(rows, shards=mixing.SHARDS):
    """(doc_id, size, source_size, target, parts) of (doc_id, source, text)."""
    by = defaultdict(list)
    for doc, source, text in rows:
        text = text or ""
        place = int(hashlib.md5(f"7:{'' if doc is None else doc}:{text}".encode()).hexdigest()[:15], 16)
        by[source].append((place, doc is not None, doc, len(WORD.findall(text))))
    names = sorted((n for n in by if n is not None), key=str.encode) + [None] * (None in by)
    sizes = [sum(r[3] for r in by[n]) for n in names]
    targets = plain_targets(sizes)
    positive = [t for t in targets if t > 0]
    block = max(1, min(mixing.BLOCK, int(min(positive) / 1000))) if positive else 1
    blocks = round(sum(positive) / block)
    ends = [[min(q * block, 2 * n) for q, n in zip(plain_seats(targets, blocks * (i + 1) // shards), sizes, strict=True)] for i in range(shards)]
    out = []
    for i, name in enumerate(names):
        start = 0
        for _, _, doc, size in sorted(by[name], key=lambda r: (r[0], r[1], r[2] or 0, r[3])):
            parts = []
            for turn in range(2):
                begin = start + turn * sizes[i]
                for shard in range(shards):
                    low, high = max(begin, ends[shard - 1][i] if shard else 0), min(begin + size, ends[shard][i])
                    if high > low:
                        parts.append((shard, turn, low - begin, high - low))
            out.append((doc, size, sizes[i], pytest.approx(targets[i], rel=1e-9), parts))
            start += size
    return out


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "source", "text").collect()]


def same(got, want):
    order = lambda r: (repr(r[0]), r[1], r[2], repr(r[4]))
    got = [(r["doc_id"], r["size"], r["source_size"], r["target"], [tuple(p) for p in r["parts"]]) for r in got.collect()]
    assert sorted(got, key=order) == sorted(want, key=order)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_mix_of_real_rows(spark, sf):
    docs = table(spark, f"/root/testdata/{sf}", "documents")
    got = mixing.mix(docs)
    same(got, brute(rows_of(docs)))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/{sf}/documents.parquet'")
    want = con.execute(mixing.oracle_sql()).fetchall()
    assert sorted(map(tuple, mixing.mix_digest(docs.repartition(7)).collect())) == sorted(want)


def odd_rows():
    rng = random.Random(2)
    texts = [None, "", " \t\n", "one", "two words", "a\x0bb\x0cc\rd", "no break   here", "w " * 5000, "x" * 50_000, "same text here"]
    sources = ["b", "B", "", "é", "z", None, "hot", "hot", "hot", "empty"]
    rows = [(rng.choice([None, *range(60)]), s, "" if s == "empty" else rng.choice(texts)) for s in rng.choices(sources, k=300)]
    return rows + rows[:20] + [(1000 + i, f"small{i}", "only three words") for i in range(40)]


def test_mix_of_odd_rows(spark):
    schema = "doc_id long, source string, text string, size int, target string, range int, name int, place int"
    docs = spark.createDataFrame([(*r, 1, "t", 2, 3, 4) for r in odd_rows()], schema).repartition(5)
    same(mixing.mix(docs), brute(odd_rows()))
    same(mixing.mix(docs, ranges=2), brute(odd_rows()))
    digest = mixing.mix_digest(docs)
    assert digest.columns == ["doc_id", "size", "source_size", "target", "taken"]
    assert all(r["taken"] <= 2 * r["size"] for r in digest.collect())


def test_mix_of_nothing(spark):
    schema = "doc_id long, source string, text string"
    assert mixing.mix_digest(spark.createDataFrame([], schema)).collect() == []
    (row,) = mixing.mix_digest(spark.createDataFrame([(1, "a", None)], schema)).collect()
    assert tuple(row) == (1, 0, 0, 0.0, 0)


@pytest.mark.parametrize("seed", range(4))
def test_seats_are_the_highest_quotients(spark, seed):
    rng = random.Random(seed)
    aims = [rng.choice([0.0, 5.0, 5.0, 10.0, rng.random() * 1000]) for _ in range(rng.randint(1, 60))]
    houses = [0, 1, 7, len(aims), 500, 4000]
    rows = spark.createDataFrame(list(enumerate(aims)), "number long, target double")
    got = {(r["number"], r["house"]): r["seats"] for r in mixing.apportion(rows, houses).collect()}
    for h in houses:
        want = plain_seats(aims, h) if any(aims) else [0] * len(aims)
        assert [got.get((i, h), 0) for i in range(len(aims))] == want


def test_sources_come_near_their_targets(spark):
    got = mixing.mix_digest(table(spark, "/root/testdata/sf0.01", "documents")).groupBy("target", "source_size").agg({"taken": "sum"}).collect()
    assert got and all(abs(r["sum(taken)"] / r["target"] - round(r["sum(taken)"] / r["target"])) < 0.01 for r in got)


def test_mixed_texts_hold_the_words_taken(spark):
    rows = [(i, s, t) for i, (_, s, t) in enumerate(odd_rows())]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    text = {r[0]: WORD.findall(r[2] or "") for r in rows}
    parts = {r["doc_id"]: [tuple(p) for p in r["parts"]] for r in mixing.mix(docs).collect()}
    got = defaultdict(list)
    for r in mixing.mixed_texts(docs).collect():
        got[r["doc_id"]].append((r["shard"], r["round"], WORD.findall(r["text"])))
    for doc, own in parts.items():
        assert sorted(got[doc]) == sorted((s, t, text[doc][f : f + n]) for s, t, f, n in own)
