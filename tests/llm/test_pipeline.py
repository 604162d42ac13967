"""The pipeline's stages against brute force, and its contract."""

import re

import corpus_pipeline
from tickloom.llm import toxicity
from tickloom.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages_are_named_and_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "decontamination", "packing"]


def test_each_stage_keeps_and_drops_what_it_must(spark):
    docs = table(spark, SF, "documents")
    lexicon = toxicity.learn(docs, table(spark, SF, "labels"))
    bad = {r["doc_id"] for r in toxicity.score_documents(docs, lexicon).where("predicted = 1").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}

    clean = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert clean.columns == docs.columns
    left = {r["doc_id"] for r in clean.collect()}
    assert left == texts.keys() - bad

    first = {}
    for i in sorted(left):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[i]), i)
    unique = corpus_pipeline.drop_copies(spark, clean, SF)
    assert unique.columns == docs.columns and {r["doc_id"] for r in unique.collect()} == set(first.values())

    near = corpus_pipeline.drop_near_copies(spark, unique, SF)
    kept = {r["doc_id"] for r in near.collect()}
    assert near.columns == docs.columns and kept <= set(first.values()) and len(kept) > 0.9 * len(first)

    words = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower().replace("ß", "ss")))
    items = [words(r["text"]) for r in table(spark, SF, "benchmark").collect()]
    tested = corpus_pipeline.drop_benchmark_text(spark, near, SF)
    assert tested.columns == docs.columns
    assert {r["doc_id"] for r in tested.collect()} == {i for i in kept if not any(b in words(texts[i]) for b in items)}

    packed = corpus_pipeline.pack_sequences(spark, tested, SF)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in tested.collect()}


def test_run_equals_the_stages(spark):
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    got = corpus_pipeline.run(spark, SF)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, docs.select(columns).collect()))


def test_extra_and_null_columns_pass_through(spark):
    rows = [(1, "one fine text of some words", None), (2, None, "x"), (None, "another text", "y"), (3, "one fine text of some words", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    out = corpus_pipeline.drop_near_copies(spark, corpus_pipeline.drop_copies(spark, corpus_pipeline.drop_toxic(spark, docs, SF), SF), SF)
    assert sorted(map(repr, (tuple(r) for r in out.collect()))) == sorted(map(repr, rows[:3]))


def test_rows_are_dropped_by_row_and_not_by_doc_id(spark):
    long = "the old mill by the river ground corn for every farm of the valley until the flood took its wheel and the miller went to sea"
    toxic = "you idiot, you absolute moron"
    rows = [
        (None, "first fine text of one kind"), (None, "second fine text of another kind"), (None, "second  fine text of another kind"), (None, toxic),
        (1, "a text that two rows have"), (1, "a text that two rows have"), (2, "a text that two rows have"), (2, "a text of its own under the same id"),
        (None, "both rows have no id"), (None, "both rows have no id"), (None, long), (None, long + " again"), (3, toxic), (3, "a harmless text under one id with a toxic one"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    clean = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert sorted(map(repr, map(tuple, clean.collect()))) == sorted(repr(r) for r in rows if r[1] != toxic)
    unique = [tuple(r) for r in corpus_pipeline.drop_copies(spark, clean, SF).collect()]
    assert sorted((i, " ".join(t.split())) for i, t in unique if i) == [(1, "a text that two rows have"), (2, "a text of its own under the same id"), (3, "a harmless text under one id with a toxic one")]
    assert sorted(" ".join(t.split()) for i, t in unique if not i) == ["both rows have no id", "first fine text of one kind", "second fine text of another kind", long, long + " again"]
    near = [tuple(r) for r in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(unique, docs.schema), SF).collect()]
    assert len(near) == len(unique) - 1 and len({r for r in unique if r[1].startswith(long)} & set(near)) == 1
